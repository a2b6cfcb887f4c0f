"""Join operators.

Broadcast policy: a side is broadcast only when its size is bounded. Either
the caller knows it is bounded by a fixed domain (countries, currencies,
rates), or ``bounded_broadcast`` finds that the files it scans are under a
cap that leaves a wide margin for decompression; above the cap the join stays
a shuffle join (and AQE may still convert it at runtime from the real shuffle
sizes).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

# of compressed files: even at a tenfold growth in memory well under Spark's broadcast limits
DEFAULT_BROADCAST_CAP = 8 * 1024 * 1024


def estimated_bytes(df: DataFrame) -> int | None:
    """Compressed size of the relations that a dimension reads (no job is run).

    Catalyst's own estimate of a join is the *product* of its inputs, which
    rules out every dimension assembled from lookups. A dimension here is a
    key-unique table built by many-to-one lookups and aggregates, so it has no
    more rows than what it scans; the sum of the scanned files is what is
    checked (not a bound in memory: hence the small cap). A leaf without statistics (e.g. a local relation of unknown size) reports
    Spark's default size, which is far above any cap.
    """
    try:
        leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
        it = leaves.iterator()
        total = 0
        while it.hasNext():
            v = it.next().stats().sizeInBytes()
            total += v if isinstance(v, int) else int(v.toString())
        return total
    except Exception:  # e.g. a Connect session: leave the choice to AQE
        return None


def bounded_broadcast(df: DataFrame, cap_bytes: int = DEFAULT_BROADCAST_CAP) -> DataFrame:
    """Broadcast hint only when the bound is known and under ``cap_bytes``;
    otherwise the join stays a shuffle join (AQE may still switch it to a
    broadcast at runtime from the measured shuffle size)."""
    size = estimated_bytes(df)
    if size is not None and size <= cap_bytes:
        return F.broadcast(df)
    return df


# J01 / J02 ------------------------------------------------------------
def join_dim(fact: DataFrame, dim: DataFrame, key: str, how: str = "left",
             cap_bytes: int = DEFAULT_BROADCAST_CAP) -> DataFrame:
    """Fact to one dimension on ``key``; unmatched facts kept (null group)."""
    return fact.join(bounded_broadcast(dim, cap_bytes), on=key, how=how)


def join_dims(fact: DataFrame, dims: list[tuple[DataFrame, str]], how: str = "left") -> DataFrame:
    out = fact
    for dim, key in dims:
        out = join_dim(out, dim, key, how)
    return out


# J04 ------------------------------------------------------------------
FEATURE_DEFAULTS = {
    "tx_count_24h": ("int", 0),
    "tx_amount_sum_24h": ("double", 0.0),
    "velocity_score": ("double", 0.0),
    "risk_score": ("double", 0.0),
}


def lookup_features(tx: DataFrame, features: DataFrame, key: str = "customer_id",
                    feat_col: str = "features") -> DataFrame:
    """Attach the feature struct; when no document matches, the four typed
    zero defaults are used, a found document is returned as is."""
    f = features.select(F.col(key), F.col(feat_col).alias("_feat"), F.lit(True).alias("_found"))
    j = tx.join(f, on=key, how="left")
    cols = {}
    for name, (dtype, default) in FEATURE_DEFAULTS.items():
        cols[name] = F.when(F.col("_found"), F.col(f"_feat.{name}").cast(dtype)).otherwise(F.lit(default).cast(dtype))
    return (j.withColumn("feature_found", F.coalesce(F.col("_found"), F.lit(False)))
             .withColumns(cols).drop("_found"))


# J05 / S09 ------------------------------------------------------------
def anti_join(left: DataFrame, right: DataFrame, key) -> DataFrame:
    keys = [key] if isinstance(key, str) else list(key)
    return left.join(right.select(*keys).distinct(), on=keys, how="left_anti")


# J06 ------------------------------------------------------------------
def apply_outcomes(tx: DataFrame, refunds: DataFrame, disputes: DataFrame,
                   key: str = "transaction_id") -> DataFrame:
    """Propagate refund/dispute outcomes to the transaction status.

    Children are pre-aggregated to one row per transaction so the left joins
    never fan out facts.
    """
    r = refunds.groupBy(key).agg(
        F.max(F.when(F.col("status") == "succeeded", 1).otherwise(0)).alias("_refunded"),
        F.sum(F.when(F.col("status") == "succeeded", F.col("amount"))).alias("refunded_amount"))
    d = disputes.groupBy(key).agg(F.count(F.lit(1)).alias("_n_disputes"),
                                  F.max(F.when(F.col("status") == "lost", 1).otherwise(0)).alias("dispute_lost"))
    j = tx.join(r, key, "left").join(d, key, "left")
    status = (F.when(F.col("_n_disputes") > 0, "disputed")
              .when(F.col("_refunded") == 1, "refunded").otherwise(F.col("status")))
    return (j.withColumn("status", status)
             .withColumn("refunded_amount", F.coalesce(F.col("refunded_amount"), F.lit(0).cast("decimal(18,2)")))
             .withColumn("dispute_lost", F.coalesce(F.col("dispute_lost"), F.lit(0)))
             .drop("_refunded", "_n_disputes"))


# W03 ------------------------------------------------------------------
def validity_intervals(rates: DataFrame, keys=("from_currency", "to_currency"),
                       start: str = "effective_date") -> DataFrame:
    """[effective_date, next effective_date) per currency pair."""
    w = W.partitionBy(*keys).orderBy(F.col(start))
    return rates.withColumn("valid_to", F.lead(F.col(start)).over(w))


# J07 ------------------------------------------------------------------
def rate_calendar(rates: DataFrame, to_currency: str = "USD") -> tuple[DataFrame, DataFrame]:
    """((currency, day, rate) for every day from a currency's first rate to the last day of any
    rate, that last day as one row). Its size is currencies x days of the rates' history,
    whatever the number of transactions; of rates of one day any one counts."""
    own = rates.filter(F.col("to_currency") == to_currency)
    last = own.agg(F.max("effective_date").alias("last"))
    iv = validity_intervals(own).join(last.withColumn("to_currency", F.lit(to_currency)), "to_currency")
    until = F.coalesce(F.date_sub("valid_to", 1), F.col("last"))
    days = iv.filter(F.col("effective_date") <= until) \
        .select(F.col("from_currency").alias("_cur"), F.explode(F.sequence("effective_date", until)).alias("_day"), "rate")
    return days, last


def to_usd(tx: DataFrame, rates: DataFrame, amount: str = "amount", currency: str = "currency_code",
           date_col: str = "transaction_date") -> DataFrame:
    """As-of conversion: the latest rate with effective_date <= transaction day.

    An equi-join on (currency, day) with the rates of every day; days after the last rate meet
    that of the last day. So a long history of daily rates is one lookup a row, and a shuffle, if
    the calendar is too large to broadcast, spreads a currency over its days. USD passes through
    at rate 1; a day before the first rate has none.
    """
    days, last = rate_calendar(rates)
    end = F.coalesce(last.scalar(), F.lit("9999-12-31").cast("date"))
    j = tx.withColumn("_on", F.least(F.col(date_col), end)).join(days, (F.col(currency) == F.col("_cur")) & (F.col("_on") == F.col("_day")), "left")
    rate = F.when(F.col(currency) == "USD", F.lit(1).cast("decimal(18,8)")).otherwise(F.col("rate"))
    return (j.withColumn("fx_rate", rate)
             .withColumn("amount_usd_converted", (F.col(amount) * F.col("fx_rate")).cast("decimal(18,2)"))
             .drop("_cur", "_day", "_on", "rate"))


# J08 ------------------------------------------------------------------
def enrich_country(df: DataFrame, countries: DataFrame, key: str = "country_code") -> DataFrame:
    return df.join(countries, key, "left")


def enrich_mcc(df: DataFrame, mcc: DataFrame, key: str = "mcc_code") -> DataFrame:
    return df.join(mcc, key, "left")


# J09 ------------------------------------------------------------------
def orphans(child: DataFrame, parent: DataFrame, child_key: str, parent_key: str | None = None) -> DataFrame:
    """Child rows whose foreign key has no parent (null keys are not orphans)."""
    pk = parent_key or child_key
    p = parent.select(F.col(pk).alias("_pk")).distinct()
    return (child.filter(F.col(child_key).isNotNull())
                 .join(p, F.col(child_key) == F.col("_pk"), "left_anti"))
