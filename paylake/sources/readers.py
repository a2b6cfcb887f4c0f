"""Sources: explicit schemas at every source, permissive
string landing for untrusted payloads so a bad value becomes a data-quality
error instead of a failed job."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# --- fixed values ---------------------------------------------------------
# Column list of the labelled card-payment file.
PAYMENT_CSV_COLUMNS = [
    "trans_date_trans_time", "cc_num", "merchant", "category", "amt",
    "first", "last", "gender", "street", "city", "state", "zip",
    "lat", "long", "city_pop", "job", "dob", "trans_num",
    "unix_time", "merch_lat", "merch_long", "is_fraud",
]


def _fields(kind: T.DataType, *names: str) -> list[T.StructField]:
    return [T.StructField(n, kind) for n in names]


# Fields that the document collections declare.
CLICKSTREAM_SCHEMA = T.StructType([
    T.StructField("event_id", T.LongType()),
    *_fields(T.StringType(), "event_type", "session_id", "customer_id", "merchant_id", "page_url", "timestamp"),
    T.StructField("device", T.StructType(_fields(T.StringType(), "type", "os", "browser"))),
    T.StructField("geo", T.StructType(_fields(T.StringType(), "country", "city", "ip_hash"))),
])
FEATURES_SCHEMA = T.StructType([
    T.StructField("customer_id", T.StringType()),
    T.StructField("features", T.StructType([
        *_fields(T.IntegerType(), "tx_count_1h", "tx_count_24h", "tx_count_7d"),
        *_fields(T.DoubleType(), "tx_amount_sum_24h", "tx_amount_avg_30d"),
        *_fields(T.IntegerType(), "distinct_merchants_24h", "distinct_countries_24h"),
        *_fields(T.DoubleType(), "velocity_score", "risk_score", "chargeback_ratio_90d")])),
    *_fields(T.StringType(), "updated_at", "model_version"),
])
ALERT_SCHEMA = T.StructType([
    *_fields(T.StringType(), "transaction_id", "customer_id", "merchant_id"),
    T.StructField("score", T.DoubleType()),
    *_fields(T.StringType(), "decision", "model_version"),
    T.StructField("features_snapshot", T.MapType(T.StringType(), T.DoubleType())),
    T.StructField("reasons", T.ArrayType(T.StringType())),
    T.StructField("created_at", T.StringType()),
])

ENVELOPE_ITEM = "struct<order_key: bigint, line: int, amount: decimal(18,2)>"


# S01 -----------------------------------------------------------------
def read_raw(spark: SparkSession, path: str, since=None, until=None, schema: T.StructType | None = None) -> DataFrame:
    """Lake table laid out year=/month=/day=; the date range is a predicate
    on partition columns only, so Spark prunes directories before listing
    files (``PartitionFilters`` in the plan)."""
    r = spark.read
    if schema is not None:
        r = r.schema(schema)
    df = r.parquet(path)
    d = F.make_date("year", "month", "day")
    if since is not None:
        df = df.filter(d >= F.lit(str(since)).cast("date"))
    if until is not None:
        df = df.filter(d <= F.lit(str(until)).cast("date"))
    return df


# S02 -----------------------------------------------------------------
def read_payments_csv(spark: SparkSession, path: str, columns=PAYMENT_CSV_COLUMNS) -> DataFrame:
    """All-string schema in header order, label included; no inference pass over the data."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    return spark.read.schema(schema).option("header", True).option("escape", '"').option("mode", "PERMISSIVE").csv(path)


# S03 -----------------------------------------------------------------
def explode_envelope(df: DataFrame, col: str, item_schema: str = ENVELOPE_ITEM) -> DataFrame:
    """A payload is a list of records, or an object holding them under
    ``data``, else ``transactions``; anything else yields no rows."""
    s = F.trim(F.col(col))
    as_list = F.from_json(F.col(col), f"array<{item_schema}>")
    as_obj = F.from_json(F.col(col), f"struct<data: array<{item_schema}>, transactions: array<{item_schema}>>")
    items = (F.when(s.startswith("["), as_list)
             .when(s.startswith("{"), F.coalesce(as_obj.getField("data"), as_obj.getField("transactions")))
             )
    return df.select(F.explode(F.coalesce(items, F.array().cast(f"array<{item_schema}>"))).alias("r")).select("r.*")


def envelopes_from(lineitem: DataFrame) -> DataFrame:
    """One payload per line in one of the four shapes (by order key mod 4),
    so every shape of the API response is exercised by the whole table."""
    item = F.to_json(F.struct(F.col("l_orderkey").alias("order_key"), F.col("l_linenumber").alias("line"),
                              F.col("l_extendedprice").cast("decimal(18,2)").alias("amount")))
    arr = F.concat(F.lit("["), item, F.lit("]"))
    k = F.pmod(F.col("l_orderkey"), F.lit(4))
    payload = (F.when(k == 0, arr)
               .when(k == 1, F.concat(F.lit('{"data": '), arr, F.lit("}")))
               .when(k == 2, F.concat(F.lit('{"transactions": '), arr, F.lit("}")))
               .otherwise(F.lit("42")))
    return lineitem.select(payload.alias("payload"))


# S04 -----------------------------------------------------------------
def read_jdbc(spark: SparkSession, url: str, table: str, part_col: str | None = None,
              bounds: tuple[int, int] | None = None, num_partitions: int = 8,
              properties: dict | None = None) -> DataFrame:
    """Relational scan split into ``num_partitions`` range queries on a
    numeric column; later filters and column lists are pushed into the SQL."""
    r = spark.read.format("jdbc").option("url", url).option("dbtable", table)
    for k, v in (properties or {}).items():
        r = r.option(k, v)
    if part_col and bounds:
        r = (r.option("partitionColumn", part_col).option("lowerBound", bounds[0])
              .option("upperBound", bounds[1]).option("numPartitions", num_partitions))
    return r.load()


# S05 -----------------------------------------------------------------
def read_documents(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).option("mode", "PERMISSIVE").json(path)
