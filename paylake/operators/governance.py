"""Governance jobs.

None of these collects a customer's records into one group: a subject export
is a set of JSON lines keyed by the customer, and shared-card detection
counts distinct customers instead of building their set.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paylake.functions.predicates import window_bounds

# --- fixed values ---------------------------------------------------------
# Retention (days) of the event collections, archive lifecycle (days -> class)
# and the erasure deadline.
RETENTION_DAYS = {"clickstream": 90, "app_logs": 30, "fraud_alerts": 30}
ARCHIVE_TRANSITIONS = [(90, "GLACIER"), (365, "DEEP_ARCHIVE")]
ARCHIVE_EXPIRE_DAYS = 2555
ERASURE_DEADLINE_HOURS = 72


# G01 -----------------------------------------------------------------
def pseudonymise(customers: DataFrame, email: str = "email", drop=("first_name", "last_name", "phone")) -> DataFrame:
    out = customers.withColumn("email_hash", F.sha2(F.lower(F.trim(F.col(email))), 256)).drop(email)
    return out.drop(*[c for c in drop if c in out.columns])


# G02 -----------------------------------------------------------------
def _start(df: DataFrame, ts: str, as_of, days: int):
    ntz = dict(df.dtypes)[ts] == "timestamp_ntz"
    return F.lit(window_bounds(as_of, days)[0]).cast("timestamp_ntz" if ntz else "timestamp")


def retain(df: DataFrame, ts: str, as_of, days: int) -> DataFrame:
    """What an overwrite keeps: rows from ``as_of - days`` on, whatever their
    upper end, and rows without a time. With ``expired`` that is every row."""
    return df.filter(F.col(ts).isNull() | (F.col(ts) >= _start(df, ts, as_of, days)))


def expired(df: DataFrame, ts: str, as_of, days: int) -> DataFrame:
    """Rows past the retention period (what a retention job deletes)."""
    return df.filter(F.col(ts) < _start(df, ts, as_of, days))


# G03 -----------------------------------------------------------------
def storage_class(df: DataFrame, date_col: str, as_of) -> DataFrame:
    age = F.datediff(F.lit(str(as_of)[:10]).cast("date"), F.col(date_col).cast("date"))
    cls = F.when(age >= ARCHIVE_EXPIRE_DAYS, "EXPIRED")
    for days, name in sorted(ARCHIVE_TRANSITIONS, reverse=True):
        cls = cls.when(age >= days, name)
    cls = cls.otherwise("STANDARD")
    return df.withColumns({"age_days": age, "storage_class": cls})


# G04 -----------------------------------------------------------------
def subject_export(tables: dict[str, tuple[DataFrame, str]], subject: str = "customer_id") -> DataFrame:
    """Every record of every table about each subject, as JSON lines:
    (customer_id, source_table, record). Written partitioned by a hash of the
    subject, one subject's export is a prefix read, and no subject's records
    are ever gathered into a single row or task."""
    parts = []
    for name, (df, key) in tables.items():
        parts.append(df.select(F.col(key).cast("string").alias(subject), F.lit(name).alias("source_table"),
                               F.to_json(F.struct(*[F.col(c) for c in df.columns])).alias("record")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


# G05 -----------------------------------------------------------------
def erase_all(tables: dict[str, tuple[DataFrame, str]], deleted_keys: DataFrame, deleted_key: str) -> dict[str, DataFrame]:
    """Every table without the rows of the deleted subjects: name -> (table, its subject column) in, name -> table out."""
    return {name: erase(df, deleted_keys, key, deleted_key) for name, (df, key) in tables.items()}


def erase(table: DataFrame, deleted_keys: DataFrame, key: str, deleted_key: str | None = None) -> DataFrame:
    dk = deleted_keys.select(F.col(deleted_key or key).alias(key)).distinct()
    return table.join(dk, key, "left_anti")


# G06 -----------------------------------------------------------------
def shared_cards(methods: DataFrame, fingerprint: str = "fingerprint", customer: str = "customer_id") -> DataFrame:
    """Fingerprints used by more than one customer: a row per fingerprint and
    customer with the customer's methods and the fingerprint's customers. All
    customers are listed; none is gathered into a list."""
    pairs = methods.groupBy(fingerprint, customer).agg(F.count(F.lit(1)).alias("n_methods"))
    shared = pairs.groupBy(fingerprint).agg(F.count(F.lit(1)).alias("n_customers")).filter("n_customers > 1")
    return pairs.join(shared, fingerprint)


# G07 -----------------------------------------------------------------
def exclude_opt_out(df: DataFrame, opt_outs: DataFrame, key: str = "customer_sk") -> DataFrame:
    return df.join(opt_outs.select(key).distinct(), key, "left_anti")


def apply_retention(spark, path: str, as_of, days: int, dry_run: bool = False) -> list[str]:
    """Physically enforce retention on a lake table laid out
    ``year=/month=/day=`` (``sources.sinks.write_lake``): partition
    directories whose day is before ``as_of - days`` are removed.

    Only directory listings and deletes through the table's Hadoop
    FileSystem (works for HDFS and object stores alike); no row is read, and
    the listing is bounded by the number of day partitions. Returns the
    removed (or, with ``dry_run``, the expired) partition paths.
    """
    import datetime as dt

    start = window_bounds(as_of, days)[0].date()
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def children(p, prefix):
        if not fs.exists(p):
            return []
        return [(s.getPath(), int(s.getPath().getName().split("=", 1)[1]))
                for s in fs.listStatus(p) if s.isDirectory() and s.getPath().getName().startswith(prefix)]

    removed = []
    for yp, y in children(root, "year="):
        for mp, m in children(yp, "month="):
            for dp, d in children(mp, "day="):
                if dt.date(y, m, d) < start:
                    removed.append(dp.toString())
                    if not dry_run:
                        fs.delete(dp, True)
    return removed
