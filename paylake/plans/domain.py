"""Domain tables derived from the driver's parquet tables.

The given tables carry no payments domain, so the star schema and the event
collections are *derived* from them by Spark, and the same derivation is
written as SQL for the DuckDB oracle. Each Spark builder below has an SQL
twin (``*_SQL``) with identical semantics; ``with_ctes`` assembles them.

All derivations are narrow projections of a single scan except:
* ``recorded_transactions``: lineitem JOIN orders on the order key (the only
  big join; reports never redo it, ``fact_transaction`` is the written fact);
* ``dim_customer``: first order date per customer (partial aggregate).
"""

from __future__ import annotations

import hashlib
from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paylake.functions.scalar import pick
from paylake.session import read_table

# --- fixed values -------------------------------------------------------
# Merchant category codes as seeded in the reference (code, description,
# category), in their original order.
MCC_ROWS = [
    ("5411", "Grocery Stores, Supermarkets", "Retail"),
    ("5812", "Eating Places and Restaurants", "Food"),
    ("5813", "Drinking Places (Bars, Lounges)", "Food"),
    ("5814", "Fast Food Restaurants", "Food"),
    ("5999", "Miscellaneous Specialty Retail", "Retail"),
    ("7372", "Computer Software", "Digital"),
    ("7995", "Gambling", "Entertainment"),
    ("4722", "Travel Agencies", "Travel"),
    ("4511", "Airlines", "Travel"),
    ("5967", "Adult Content Services", "Entertainment"),
]
# Accepted transaction device types, currencies, and the two high-risk
# countries (NG, RU) of the reference's country list.
DEVICE_TYPES = ["mobile", "desktop", "tablet", "api", "other"]
CURRENCIES = ["USD", "EUR", "GBP", "JPY", "CAD", "AUD", "CHF", "SGD"]
HIGH_RISK_COUNTRIES = ["NG", "RU"]
# --- our mapping choices (not reference values) ----------------------------
# A nation is "high risk" when its key ends in 8 or 9 (2 of every 10, as in
# the reference's 10-country list). Event-type renames for the clickstream.
HIGH_RISK_NATION_MOD10 = (8, 9)
CLICK_EVENT_MAP = {
    "view": "page_view",
    "click": "checkout_start",
    "purchase": "checkout_complete",
    "error": "checkout_abandon",
    "signup": "form_submit",
}
CLICK_DEVICES = ["mobile", "desktop", "tablet", None]
AUDIT_ACTION_MAP = {
    "view": "READ",
    "click": "UPDATE",
    "purchase": "EXPORT",
    "error": "LOGIN_ADMIN",
    "signup": "DELETE",
}
AUDIT_RESOURCES = ["core.customers", "core.payment_methods", "core.transactions", "core.merchants"]
PAYMENT_CATEGORIES = ["grocery_pos", "shopping_net", "gas_transport", "misc_net",
                      "entertainment", "food_dining", "travel", "health_fitness"]

# default reference dates of the two derived domains
AS_OF_TX = "2001-06-30"      # lineitem / orders domain
AS_OF_EVENTS = "2024-01-31"  # events domain
AS_OF_INGEST = "1998-06-15"  # ingestion day of the card-payment domain


def _sql_list(values) -> str:
    return "[" + ", ".join("NULL" if v is None else "'" + v.replace("'", "''") + "'" for v in values) + "]"


def _case_map(col: str, mapping: dict) -> str:
    whens = " ".join(f"WHEN {col} = '{k}' THEN '{v}'" for k, v in mapping.items())
    return f"CASE {whens} END"


class Tables:
    """Lazy access to the driver tables of one scale-factor folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return read_table(self.spark, self.sf_dir, name)

    def stamp(self, *names: str) -> str:
        """This application and the state of the tables' files: the name of what is derived from them."""
        marks = []
        for f in sorted(f for n in names for f in getattr(self, n).inputFiles()):
            p = self.spark._jvm.org.apache.hadoop.fs.Path(self.spark._jvm.java.net.URI(f))
            status = p.getFileSystem(self.spark._jsc.hadoopConfiguration()).getFileStatus(p)
            marks.append((f, status.getLen(), status.getModificationTime()))
        return f"{self.spark.sparkContext.applicationId}-{hashlib.sha256(repr(marks).encode()).hexdigest()[:16]}"


# ------------------------------------------------------------------------
# fact_transaction
# ------------------------------------------------------------------------
def fact_transaction(t: Tables, as_of: str | None = None, days: int | None = None) -> DataFrame:
    """The written star fact (``plans.star``); ``as_of`` and ``days`` bound the days, and so the folders, that are read."""
    import datetime as dt

    from paylake.plans.star import fact
    since = dt.date.fromisoformat(as_of) - dt.timedelta(days=days) if as_of and days else None
    return fact(t, since, as_of)


def recorded_transactions(t: Tables) -> DataFrame:
    """Transactions as recorded, copies included: what the checks of raw data look at."""
    li = t.lineitem.select("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey",
                           "l_extendedprice", "l_discount", "l_returnflag",
                           "l_linestatus", "l_shipdate")
    o = t.orders.select(F.col("o_orderkey"), F.col("o_custkey"))
    j = li.join(o, li.l_orderkey == o.o_orderkey, "inner")
    amount = F.col("l_extendedprice").cast("decimal(18,2)")
    disc = F.col("l_discount").cast("decimal(4,2)")
    status = (F.when(F.col("l_returnflag") == "R", "refunded")
              .when(F.col("l_linestatus") == "F", "captured").otherwise("authorized"))
    score = (disc * 10).cast("decimal(5,4)")
    return j.select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("transaction_sk"),
        F.concat(F.lit("tx_"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).cast("string")).alias("transaction_id"),
        F.col("o_custkey").alias("customer_sk"),
        F.col("l_suppkey").alias("merchant_sk"),
        amount.alias("amount_usd"),
        disc.alias("discount"),
        score.alias("fraud_score"),
        F.when(score >= F.lit(0.7).cast("decimal(5,4)"), 1).otherwise(0).alias("is_high_fraud_risk"),
        status.alias("status"),
        F.when(status == "captured", (amount * (F.lit(1) - disc)).cast("decimal(18,4)"))
         .otherwise(F.lit(0).cast("decimal(18,4)")).alias("revenue_usd"),
        F.col("l_shipdate").alias("transaction_ts"),
        F.col("l_shipdate").cast("date").alias("transaction_date"),
        pick(DEVICE_TYPES, F.pmod(F.col("l_partkey"), F.lit(5))).alias("device_type"),
        F.pmod(F.col("l_partkey") + F.col("l_linenumber"), F.lit(2)).cast("int").alias("is_3d_secure"),
        pick(CURRENCIES, F.pmod(F.col("l_orderkey"), F.lit(8))).alias("currency_code"),
    )


RECORDED_SQL = f"""recorded_transactions AS (
  SELECT l_orderkey * 10 + l_linenumber AS transaction_sk,
         'tx_' || CAST(l_orderkey * 10 + l_linenumber AS VARCHAR) AS transaction_id,
         o_custkey AS customer_sk,
         l_suppkey AS merchant_sk,
         CAST(l_extendedprice AS DECIMAL(18,2)) AS amount_usd,
         CAST(l_discount AS DECIMAL(4,2)) AS discount,
         CAST(CAST(l_discount AS DECIMAL(4,2)) * 10 AS DECIMAL(5,4)) AS fraud_score,
         CASE WHEN CAST(CAST(l_discount AS DECIMAL(4,2)) * 10 AS DECIMAL(5,4)) >= 0.7 THEN 1 ELSE 0 END AS is_high_fraud_risk,
         CASE WHEN l_returnflag = 'R' THEN 'refunded' WHEN l_linestatus = 'F' THEN 'captured' ELSE 'authorized' END AS status,
         CASE WHEN l_returnflag <> 'R' AND l_linestatus = 'F'
              THEN CAST(CAST(l_extendedprice AS DECIMAL(18,2)) * (1 - CAST(l_discount AS DECIMAL(4,2))) AS DECIMAL(18,4))
              ELSE CAST(0 AS DECIMAL(18,4)) END AS revenue_usd,
         l_shipdate AS transaction_ts,
         CAST(l_shipdate AS DATE) AS transaction_date,
         {_sql_list(DEVICE_TYPES)}[l_partkey % 5 + 1] AS device_type,
         CAST((l_partkey + l_linenumber) % 2 AS INTEGER) AS is_3d_secure,
         {_sql_list(CURRENCIES)}[l_orderkey % 8 + 1] AS currency_code
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""


# ------------------------------------------------------------------------
# dimensions
# ------------------------------------------------------------------------
def dim_merchant(t: Tables) -> DataFrame:
    s = t.supplier.select("s_suppkey", "s_name", "s_nationkey")
    n = t.nation.select("n_nationkey", "n_name", "n_regionkey")
    r = t.region.select("r_regionkey", "r_name")
    geo = n.join(r, n.n_regionkey == r.r_regionkey, "left")
    j = s.join(F.broadcast(geo), s.s_nationkey == geo.n_nationkey, "left")
    idx = F.pmod(F.col("s_suppkey"), F.lit(10))
    return j.select(
        F.col("s_suppkey").alias("merchant_sk"),
        F.col("s_name").alias("business_name"),
        F.col("n_name").alias("country_code"),
        F.col("r_name").alias("region"),
        pick([m[0] for m in MCC_ROWS], idx).alias("mcc_code"),
        pick([m[2] for m in MCC_ROWS], idx).alias("mcc_category"),
    )


DIM_MERCHANT_SQL = f"""dim_merchant AS (
  SELECT s_suppkey AS merchant_sk, s_name AS business_name, n_name AS country_code, r_name AS region,
         {_sql_list([m[0] for m in MCC_ROWS])}[s_suppkey % 10 + 1] AS mcc_code,
         {_sql_list([m[2] for m in MCC_ROWS])}[s_suppkey % 10 + 1] AS mcc_category
  FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey
                LEFT JOIN region ON n_regionkey = r_regionkey)"""


def dim_customer(t: Tables) -> DataFrame:
    c = t.customer.select("c_custkey", "c_nationkey")
    n = t.nation.select("n_nationkey", "n_name", "n_regionkey")
    r = t.region.select("r_regionkey", "r_name")
    geo = n.join(r, n.n_regionkey == r.r_regionkey, "left")
    first = (t.orders.groupBy("o_custkey")
             .agg(F.min("o_orderdate").cast("date").alias("customer_since")))
    risk = (F.pmod(F.col("c_custkey"), F.lit(100)) * F.lit(0.01).cast("decimal(2,2)")).cast("decimal(5,4)")
    j = (c.join(F.broadcast(geo), c.c_nationkey == geo.n_nationkey, "left")
          .join(first, c.c_custkey == first.o_custkey, "left"))
    return j.select(
        F.col("c_custkey").alias("customer_sk"),
        F.col("n_name").alias("country_code"),
        F.col("r_name").alias("region"),
        F.when(F.pmod(F.col("n_nationkey"), F.lit(10)).isin(*HIGH_RISK_NATION_MOD10), 1)
         .otherwise(0).alias("country_is_high_risk"),
        risk.alias("risk_score"),
        F.when(risk < F.lit(0.3), "low").when(risk < F.lit(0.7), "medium").otherwise("high").alias("risk_tier"),
        F.col("customer_since"),
    )


DIM_CUSTOMER_SQL = f"""dim_customer AS (
  SELECT c_custkey AS customer_sk, n_name AS country_code, r_name AS region,
         CASE WHEN n_nationkey % 10 IN {tuple(HIGH_RISK_NATION_MOD10)} THEN 1 ELSE 0 END AS country_is_high_risk,
         CAST((c_custkey % 100) * 0.01 AS DECIMAL(5,4)) AS risk_score,
         CASE WHEN CAST((c_custkey % 100) * 0.01 AS DECIMAL(5,4)) < 0.3 THEN 'low'
              WHEN CAST((c_custkey % 100) * 0.01 AS DECIMAL(5,4)) < 0.7 THEN 'medium' ELSE 'high' END AS risk_tier,
         fo.customer_since
  FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey
                LEFT JOIN region ON n_regionkey = r_regionkey
                LEFT JOIN (SELECT o_custkey, CAST(MIN(o_orderdate) AS DATE) AS customer_since
                           FROM orders GROUP BY o_custkey) fo ON c_custkey = fo.o_custkey)"""


# ------------------------------------------------------------------------
# event collections derived from `events`
# ------------------------------------------------------------------------
def _props_k():
    return F.get_json_object(F.col("props"), "$.k").try_cast("int")


def clickstream(t: Tables) -> DataFrame:
    e = t.events.select("event_id", "ts", "user_id", "event_type", "props")
    k = _props_k()
    etype = F.lit(None).cast("string")
    for src, dst in CLICK_EVENT_MAP.items():
        etype = F.when(F.col("event_type") == src, dst).otherwise(etype)
    return e.select(
        F.col("event_id"),
        etype.alias("event_type"),
        F.concat(F.col("user_id").cast("string"), F.lit("-"), F.col("ts").cast("date").cast("string")).alias("session_id"),
        F.col("user_id").cast("string").alias("customer_id"),
        F.col("ts").alias("timestamp"),
        F.struct(pick(CLICK_DEVICES, F.pmod(k, F.lit(4))).alias("type"),
                 F.lit("os").alias("os"), F.lit("browser").alias("browser")).alias("device"),
    )


CLICKSTREAM_SQL = f"""clickstream AS (
  SELECT event_id, {_case_map('event_type', CLICK_EVENT_MAP)} AS event_type,
         CAST(user_id AS VARCHAR) || '-' || CAST(CAST(ts AS DATE) AS VARCHAR) AS session_id,
         CAST(user_id AS VARCHAR) AS customer_id,
         ts AS "timestamp",
         {_sql_list(CLICK_DEVICES)}[CAST(json_extract_string(props, '$.k') AS INTEGER) % 4 + 1] AS device_type
  FROM events)"""


def fraud_alerts(t: Tables) -> DataFrame:
    """Alert collection: one scored decision per event (score = value / 500)."""
    e = t.events.select("event_id", "ts", "user_id", "value", "props")
    score = (F.col("value") / 500).cast("decimal(5,4)")
    return e.select(
        F.concat(F.lit("ev_"), F.col("event_id").cast("string")).alias("transaction_id"),
        F.col("user_id").cast("string").alias("customer_id"),
        _props_k().cast("string").alias("merchant_id"),
        score.alias("score"),
        F.when(score < F.lit(0.3), "approve").when(score < F.lit(0.7), "review").otherwise("block").alias("decision"),
        F.col("ts").alias("created_at"),
    )


ALERTS_SQL = """fraud_alerts AS (
  SELECT 'ev_' || CAST(event_id AS VARCHAR) AS transaction_id,
         CAST(user_id AS VARCHAR) AS customer_id,
         CAST(CAST(json_extract_string(props, '$.k') AS INTEGER) AS VARCHAR) AS merchant_id,
         CAST(value / 500 AS DECIMAL(5,4)) AS score,
         CASE WHEN CAST(value / 500 AS DECIMAL(5,4)) < 0.3 THEN 'approve'
              WHEN CAST(value / 500 AS DECIMAL(5,4)) < 0.7 THEN 'review' ELSE 'block' END AS decision,
         ts AS created_at
  FROM events)"""


def audit_log(t: Tables) -> DataFrame:
    e = t.events.select("event_id", "ts", "user_id", "event_type", "value", "props")
    k = _props_k()
    action = F.lit(None).cast("string")
    for src, dst in AUDIT_ACTION_MAP.items():
        action = F.when(F.col("event_type") == src, dst).otherwise(action)
    approved = F.when(F.col("value") >= 50, F.concat(F.lit("admin_"), F.pmod(k, F.lit(7)).cast("string")))
    return e.select(
        F.col("event_id").alias("audit_id"),
        F.col("ts").alias("event_time"),
        F.when(F.pmod(F.col("user_id"), F.lit(10)) == 0, "admin").otherwise("user").alias("actor_type"),
        F.col("user_id").cast("string").alias("actor_id"),
        action.alias("action"),
        pick(AUDIT_RESOURCES, F.pmod(k, F.lit(4))).alias("resource_type"),
        F.col("event_id").cast("string").alias("resource_id"),
        F.concat_ws(".", F.lit("10"), F.lit("0"), F.pmod(F.col("user_id"), F.lit(256)).cast("string"),
                    F.pmod(F.col("event_id"), F.lit(256)).cast("string")).alias("ip_address"),
        (F.pmod(F.col("event_id"), F.lit(7)) != 0).alias("success"),
        F.to_json(F.struct(F.col("event_type").alias("reason"), approved.alias("approved_by"))).alias("metadata"),
    )


AUDIT_SQL = f"""audit_log AS (
  SELECT event_id AS audit_id, ts AS event_time,
         CASE WHEN user_id % 10 = 0 THEN 'admin' ELSE 'user' END AS actor_type,
         CAST(user_id AS VARCHAR) AS actor_id,
         {_case_map('event_type', AUDIT_ACTION_MAP)} AS action,
         {_sql_list(AUDIT_RESOURCES)}[CAST(json_extract_string(props, '$.k') AS INTEGER) % 4 + 1] AS resource_type,
         CAST(event_id AS VARCHAR) AS resource_id,
         '10.0.' || CAST(user_id % 256 AS VARCHAR) || '.' || CAST(event_id % 256 AS VARCHAR) AS ip_address,
         event_id % 7 <> 0 AS success,
         json_object('reason', event_type,
                     'approved_by', CASE WHEN value >= 50 THEN 'admin_' || CAST(CAST(json_extract_string(props, '$.k') AS INTEGER) % 7 AS VARCHAR) END) AS metadata
  FROM events)"""


def pipeline_runs(t: Tables) -> DataFrame:
    """Run log of the ingestion jobs, one run per event."""
    e = t.events.select("event_id", "ts", "event_type", "value", "props")
    return e.select(
        F.concat(F.lit("dag_"), F.col("event_type")).alias("dag_id"),
        F.lit("task").alias("task_id"),
        F.col("ts").alias("execution_date"),
        F.when(F.col("event_type") == "error", "failed").otherwise("success").alias("status"),
        _props_k().alias("records_processed"),
        F.when(F.col("event_type") == "error", _props_k()).otherwise(0).alias("records_failed"),
        F.col("value").cast("decimal(10,2)").alias("duration_seconds"),
    )


RUNS_SQL = """pipeline_runs AS (
  SELECT 'dag_' || event_type AS dag_id, 'task' AS task_id, ts AS execution_date,
         CASE WHEN event_type = 'error' THEN 'failed' ELSE 'success' END AS status,
         CAST(json_extract_string(props, '$.k') AS INTEGER) AS records_processed,
         CASE WHEN event_type = 'error' THEN CAST(json_extract_string(props, '$.k') AS INTEGER) ELSE 0 END AS records_failed,
         CAST(value AS DECIMAL(10,2)) AS duration_seconds
  FROM events)"""


# ------------------------------------------------------------------------
# card payments (validation / scoring domain)
# ------------------------------------------------------------------------
def _cents_to_units(c):
    """price / 100 in exact decimal arithmetic, rounded HALF_UP to 2 dp."""
    return (c.cast("decimal(12,2)") * F.lit(Decimal("0.01"))).cast("decimal(10,2)")


def payments_landing(t: Tables) -> DataFrame:
    return payments_landing_from(t.lineitem)


def payments_landing_from(lineitem: DataFrame) -> DataFrame:
    """All-string landing records, one per lineitem, with deterministic defects.

    Defects by ``pmod(id, p)``: amount text / negative / too large, missing
    merchant, latitude out of range, short card number. Works on a batch or
    a streaming lineitem frame alike.
    """
    li = lineitem.select("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey",
                           "l_quantity", "l_extendedprice", "l_shipdate")
    tid = F.col("l_orderkey") * 10 + F.col("l_linenumber")
    amt = _cents_to_units(F.col("l_extendedprice")).cast("string")
    amt = (F.when(F.pmod(tid, F.lit(17)) == 0, F.lit("abc"))
            .when(F.pmod(tid, F.lit(17)) == 1, F.lit("-5.00"))
            .when(F.pmod(tid, F.lit(17)) == 2, F.lit("99999.00")).otherwise(amt))
    lat = (F.pmod(F.col("l_partkey"), F.lit(170)) - 85 + F.lit(Decimal("0.123456"))).cast("decimal(10,6)").cast("string")
    lat = F.when(F.pmod(tid, F.lit(19)) == 0, F.lit("999")).otherwise(lat)
    lon = (F.pmod(F.col("l_suppkey") * 7, F.lit(350)) - 175 + F.lit(Decimal("0.654321"))).cast("decimal(10,6)").cast("string")
    mlat = (F.pmod(F.col("l_orderkey"), F.lit(170)) - 85 + F.lit(Decimal("0.5"))).cast("decimal(10,6)").cast("string")
    mlon = (F.pmod(F.col("l_orderkey") * 3, F.lit(350)) - 175 + F.lit(Decimal("0.25"))).cast("decimal(10,6)").cast("string")
    cc = F.concat(F.lit("4"), F.lpad(F.col("l_partkey").cast("string"), 15, "0"))
    cc = F.when(F.pmod(tid, F.lit(13)) == 0, F.lit("123")).otherwise(cc)
    merchant = F.when(F.pmod(tid, F.lit(11)) == 0, F.lit(None).cast("string")) \
                .otherwise(F.concat(F.lit("merchant_"), F.col("l_suppkey").cast("string")))
    return li.select(
        F.concat(F.lit("T"), F.col("l_orderkey").cast("string"), F.lit("-"), F.col("l_linenumber").cast("string")).alias("trans_num"),
        F.col("l_shipdate").cast("string").alias("trans_date_trans_time"),
        cc.alias("cc_num"),
        merchant.alias("merchant"),
        pick(PAYMENT_CATEGORIES, F.pmod(F.col("l_partkey"), F.lit(len(PAYMENT_CATEGORIES)))).alias("category"),
        amt.alias("amt"),
        lat.alias("lat"), lon.alias("long"), mlat.alias("merch_lat"), mlon.alias("merch_long"),
        (F.col("l_quantity") * 1000).cast("int").cast("string").alias("city_pop"),
        (F.unix_timestamp(F.col("l_shipdate").cast("timestamp")) + F.col("l_linenumber") * 3600).cast("string").alias("unix_time"),
        F.concat(F.lit("City"), F.pmod(F.col("l_suppkey"), F.lit(50)).cast("string")).alias("city"),
        pick(["CA", "NY", "TX", "FL", "WA"], F.pmod(F.col("l_suppkey"), F.lit(5))).alias("state"),
    )


PAYMENTS_SQL = f"""payments_landing AS (
  SELECT 'T' || CAST(l_orderkey AS VARCHAR) || '-' || CAST(l_linenumber AS VARCHAR) AS trans_num,
         CAST(l_shipdate AS VARCHAR) AS trans_date_trans_time,
         CASE WHEN (l_orderkey * 10 + l_linenumber) % 13 = 0 THEN '123'
              ELSE '4' || lpad(CAST(l_partkey AS VARCHAR), 15, '0') END AS cc_num,
         CASE WHEN (l_orderkey * 10 + l_linenumber) % 11 = 0 THEN NULL
              ELSE 'merchant_' || CAST(l_suppkey AS VARCHAR) END AS merchant,
         {_sql_list(PAYMENT_CATEGORIES)}[l_partkey % {len(PAYMENT_CATEGORIES)} + 1] AS category,
         CASE WHEN (l_orderkey * 10 + l_linenumber) % 17 = 0 THEN 'abc'
              WHEN (l_orderkey * 10 + l_linenumber) % 17 = 1 THEN '-5.00'
              WHEN (l_orderkey * 10 + l_linenumber) % 17 = 2 THEN '99999.00'
              ELSE CAST(CAST(CAST(l_extendedprice AS DECIMAL(12,2)) * 0.01 AS DECIMAL(10,2)) AS VARCHAR) END AS amt,
         CASE WHEN (l_orderkey * 10 + l_linenumber) % 19 = 0 THEN '999'
              ELSE CAST(CAST(l_partkey % 170 - 85 + 0.123456 AS DECIMAL(10,6)) AS VARCHAR) END AS lat,
         CAST(CAST((l_suppkey * 7) % 350 - 175 + 0.654321 AS DECIMAL(10,6)) AS VARCHAR) AS long,
         CAST(CAST(l_orderkey % 170 - 85 + 0.5 AS DECIMAL(10,6)) AS VARCHAR) AS merch_lat,
         CAST(CAST((l_orderkey * 3) % 350 - 175 + 0.25 AS DECIMAL(10,6)) AS VARCHAR) AS merch_long,
         CAST(CAST(l_quantity * 1000 AS INTEGER) AS VARCHAR) AS city_pop,
         CAST(CAST(epoch(l_shipdate) AS BIGINT) + l_linenumber * 3600 AS VARCHAR) AS unix_time,
         'City' || CAST(l_suppkey % 50 AS VARCHAR) AS city,
         ['CA', 'NY', 'TX', 'FL', 'WA'][l_suppkey % 5 + 1] AS state
  FROM lineitem)"""


def scored_transactions(t: Tables) -> DataFrame:
    return scored_transactions_from(t.lineitem)


def scored_transactions_from(lineitem: DataFrame) -> DataFrame:
    """Stored transaction table of the ingestion job (typed, scored, stamped).

    The probability here is the deterministic rule score of the lineitem
    discount, so reports over it have an SQL oracle; the model-scored
    variant is ``operators.scoring.score_batch``.
    """
    return scored_columns(scored_inputs(lineitem))


def scored_inputs(lineitem: DataFrame) -> DataFrame:
    """The scored transactions without the texts that follow from their keys (``scored_columns``)."""
    prob = (F.col("l_discount").cast("decimal(4,2)") * 10).cast("decimal(5,4)")
    return lineitem.select(
        "l_orderkey", "l_linenumber", "l_suppkey", "l_partkey",
        (F.col("l_shipdate") - F.make_dt_interval(F.pmod(F.col("l_orderkey"), F.lit(3)).cast("int"))).alias("trans_date_trans_time"),
        _cents_to_units(F.col("l_extendedprice")).alias("amt"),
        prob.alias("fraud_probability"),
        (prob >= F.lit(0.5)).alias("is_fraud_predicted"),
        (F.col("l_shipdate") + F.make_dt_interval(F.lit(0), (F.col("l_linenumber") * 3).cast("int"))).alias("ingested_at"),
    )


def scored_columns(rows: DataFrame) -> DataFrame:
    """The columns of the scored transactions, and those that their table is laid out by."""
    return rows.select(
        F.concat(F.lit("T"), F.col("l_orderkey").cast("string"), F.lit("-"), F.col("l_linenumber").cast("string")).alias("trans_num"),
        "trans_date_trans_time",
        F.concat(F.lit("4"), F.lpad(F.col("l_partkey").cast("string"), 15, "0")).alias("cc_num"),
        F.concat(F.lit("merchant_"), F.col("l_suppkey").cast("string")).alias("merchant"),
        pick(PAYMENT_CATEGORIES, F.pmod(F.col("l_partkey"), F.lit(len(PAYMENT_CATEGORIES)))).alias("category"),
        "amt",
        F.concat(F.lit("City"), F.pmod(F.col("l_suppkey"), F.lit(50)).cast("string")).alias("city"),
        pick(["CA", "NY", "TX", "FL", "WA"], F.pmod(F.col("l_suppkey"), F.lit(5))).alias("state"),
        "fraud_probability", "is_fraud_predicted", "ingested_at", *[c for c in ("ingest_day", "period") if c in rows.columns])


SCORED_SQL = f"""scored_transactions AS (
  SELECT 'T' || CAST(l_orderkey AS VARCHAR) || '-' || CAST(l_linenumber AS VARCHAR) AS trans_num,
         l_shipdate - to_days(CAST(l_orderkey % 3 AS INTEGER)) AS trans_date_trans_time,
         '4' || lpad(CAST(l_partkey AS VARCHAR), 15, '0') AS cc_num,
         'merchant_' || CAST(l_suppkey AS VARCHAR) AS merchant,
         {_sql_list(PAYMENT_CATEGORIES)}[l_partkey % {len(PAYMENT_CATEGORIES)} + 1] AS category,
         CAST(CAST(l_extendedprice AS DECIMAL(12,2)) * 0.01 AS DECIMAL(10,2)) AS amt,
         'City' || CAST(l_suppkey % 50 AS VARCHAR) AS city,
         ['CA', 'NY', 'TX', 'FL', 'WA'][l_suppkey % 5 + 1] AS state,
         CAST(CAST(l_discount AS DECIMAL(4,2)) * 10 AS DECIMAL(5,4)) AS fraud_probability,
         CAST(CAST(l_discount AS DECIMAL(4,2)) * 10 AS DECIMAL(5,4)) >= 0.5 AS is_fraud_predicted,
         l_shipdate + to_hours(CAST(l_linenumber * 3 AS INTEGER)) AS ingested_at
  FROM lineitem)"""


CTES = {
    "recorded_transactions": RECORDED_SQL,
    "dim_merchant": DIM_MERCHANT_SQL,
    "dim_customer": DIM_CUSTOMER_SQL,
    "clickstream": CLICKSTREAM_SQL,
    "fraud_alerts": ALERTS_SQL,
    "audit_log": AUDIT_SQL,
    "pipeline_runs": RUNS_SQL,
    "payments_landing": PAYMENTS_SQL,
    "scored_transactions": SCORED_SQL,
}


# table expression -> those it reads from
NEEDS: dict[str, list[str]] = {}


def with_ctes(names, body: str) -> str:
    """``body`` after the named table expressions and all that they read from, each once."""
    order: list[str] = []

    def add(name):
        for n in NEEDS.get(name, []):
            add(n)
        if name not in order:
            order.append(name)

    for n in names:
        add(n)
    return "WITH " + ",\n".join(CTES[n] for n in order) + "\n" + body
