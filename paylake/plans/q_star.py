"""Registered star-schema (Q15-Q21), join (J) and window (W) queries."""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from paylake.operators import joins as J
from paylake.operators.features import trailing, trailing_all
from paylake.plans import domain as D
from paylake.plans import star as S
from paylake.plans.base import AS_TX, T, _window, register
from paylake.streaming.ingest import run_dir

# Q15 ----------------------------------------------------------------------
register("q15_stg_transactions", D.with_ctes(["stg"], "SELECT * FROM stg"))(
    lambda s, d: S.stg_transactions(T(s, d)))
register("q15_stg_refunds", D.with_ctes(["stg_refunds"], "SELECT * FROM stg_refunds"))(lambda s, d: S.stg_refunds(T(s, d)))
register("q15_stg_disputes", D.with_ctes(["stg_disputes"], "SELECT * FROM stg_disputes"))(lambda s, d: S.stg_disputes(T(s, d)))


def _stg_rates(s, d):
    """The rates and the transactions that each serves (by currency and day)."""
    used = S.stg_transactions(T(s, d)).groupBy(F.col("currency_code").alias("from_currency")).agg(F.count(F.lit(1)).alias("n_tx"))
    return S.stg_exchange_rates(T(s, d)).join(used, "from_currency", "left")


register("q15_stg_exchange_rates", D.with_ctes(["stg", "rates"], """
SELECT r.*, n_tx FROM rates r LEFT JOIN (SELECT currency_code, COUNT(*) AS n_tx FROM stg GROUP BY 1) u
  ON r.from_currency = u.currency_code"""))(_stg_rates)

# Q16 / Q17 ---------------------------------------------------------------------
register("q16_dim_customer", D.with_ctes(["dim_customer"], "SELECT * FROM dim_customer"))(
    lambda s, d: D.dim_customer(T(s, d)))
register("q17_dim_merchant", D.with_ctes(["dim_merchant"], "SELECT * FROM dim_merchant"))(
    lambda s, d: D.dim_merchant(T(s, d)))

# Q18 ---------------------------------------------------------------------------
register("q18_dim_date", """
SELECT CAST(year(d) * 10000 + month(d) * 100 + day(d) AS INTEGER) AS date_sk, CAST(d AS DATE) AS date,
       CAST(year(d) AS INTEGER) AS year, CAST(quarter(d) AS INTEGER) AS quarter, CAST(month(d) AS INTEGER) AS month,
       CAST(day(d) AS INTEGER) AS day, CAST(isodow(d) AS INTEGER) AS iso_day_of_week,
       CAST(weekofyear(d) AS INTEGER) AS iso_week, isodow(d) IN (6, 7) AS is_weekend
FROM (SELECT unnest(generate_series(CAST(MIN(l_shipdate) AS DATE), CAST(MAX(l_shipdate) AS DATE), INTERVAL 1 DAY)) AS d
      FROM lineitem)""")(lambda s, d: S.dim_date(T(s, d).lineitem, "l_shipdate"))

# Q19 (with J06 outcomes, J07 as-of FX) -----------------------------------------------
register("q19_fact_transaction", D.with_ctes(["star"], "SELECT * FROM star"))(lambda s, d: S.fact_transaction_full(T(s, d)))


# The tables as three loads see them: one row in ten comes with the second load (copies of old
# transactions and new ones), some refunds and disputes and the rates from 1998 on with the third.
def _loads(t):
    li = t.lineitem
    no = F.when(F.col("l_partkey") % 10 == 0, 2).otherwise(1)
    late = lambda n: F.when(F.col("l_suppkey") % n == 0, 3).otherwise(1).alias("loaded_at")
    parts = [S.recorded_transactions(li.filter(no == k), t.orders).withColumn("loaded_at", F.lit(k)) for k in (1, 2)]
    rates = S.stg_exchange_rates(t).withColumn("loaded_at", F.when(F.col("effective_date") >= "1998-01-01", 3).otherwise(1))
    return parts[0].unionAll(parts[1]), S.raw_refunds(li, late(7)), S.raw_disputes(li, late(5)), rates


def incremental_fact(s, d):
    """A first load, then two merges over it; every row is what one load of all gives."""
    raw = _loads(T(s, d))
    upto = lambda k: [x.filter(F.col("loaded_at") <= k) for x in raw]
    table = S.FactTable(s, os.path.join(run_dir(s, "star-inc"), "fact"))
    tx, refunds, disputes, rates = upto(1)
    table.load_in_parts(S.joined_fact(S.latest_transactions(tx.select(*S.KEYED_COLUMNS)), S.latest_events(refunds), S.latest_events(disputes), rates)
                        .select(*S.LAID_COLUMNS), derive=S.derive_fact)
    for k in (2, 3):
        table.merge(*upto(k), since=k - 1)
        table.vacuum()  # no reader has opened the version before
    return table


register("q19_incremental_load", D.with_ctes(["star"], "SELECT * FROM star"))(lambda s, d: incremental_fact(s, d).read().select(*S.FACT_COLUMNS))

# Q20 / Q21 -----------------------------------------------------------------------
register("q20_mart_revenue_daily", D.with_ctes(["star", "dim_merchant"], """
SELECT f.transaction_date, m.region, COUNT(*) AS n_transactions,
       CAST(SUM(f.revenue_usd) AS DECIMAL(38,4)) AS revenue_usd,
       ROUND(100.0::DOUBLE * SUM(CASE WHEN f.status = 'captured' THEN 1 ELSE 0 END) / COUNT(*), 2) AS success_rate_pct
FROM star f LEFT JOIN dim_merchant m ON f.merchant_sk = m.merchant_sk
GROUP BY f.transaction_date, m.region"""))(
    lambda s, d: S.mart_revenue_daily(S.fact(T(s, d)), D.dim_merchant(T(s, d))))

register("q21_mart_fraud_analysis", D.with_ctes(["star", "dim_customer", "dim_merchant"], """
SELECT f.transaction_date, c.risk_tier, m.mcc_category, COUNT(*) AS n_transactions,
       CAST(SUM(f.is_high_fraud_risk) AS BIGINT) AS n_high_risk,
       ROUND(100.0::DOUBLE * SUM(f.is_high_fraud_risk) / COUNT(*), 2) AS fraud_rate_pct,
       CAST(SUM(f.amount_usd) AS DECIMAL(38,2)) AS volume_usd
FROM star f LEFT JOIN dim_customer c ON f.customer_sk = c.customer_sk
            LEFT JOIN dim_merchant m ON f.merchant_sk = m.merchant_sk
GROUP BY ALL"""))(
    lambda s, d: S.mart_fraud_analysis(S.fact(T(s, d)), D.dim_customer(T(s, d)), D.dim_merchant(T(s, d))))

# J01 / J02 ---------------------------------------------------------------------------
register("j01_fact_dim_left", D.with_ctes(["fact_transaction", "dim_merchant"], """
SELECT m.region, COUNT(*) AS n_tx FROM fact_transaction f LEFT JOIN dim_merchant m ON f.merchant_sk = m.merchant_sk
GROUP BY m.region"""))(
    lambda s, d: J.join_dim(D.fact_transaction(T(s, d)), D.dim_merchant(T(s, d)), "merchant_sk")
    .groupBy("region").agg(F.count(F.lit(1)).alias("n_tx")))

register("j02_fact_two_dims", D.with_ctes(["fact_transaction", "dim_customer", "dim_merchant"], """
SELECT c.risk_tier, m.mcc_category, COUNT(*) AS n_tx
FROM fact_transaction f LEFT JOIN dim_customer c USING (customer_sk) LEFT JOIN dim_merchant m USING (merchant_sk)
GROUP BY ALL"""))(
    lambda s, d: J.join_dims(D.fact_transaction(T(s, d)),
                             [(D.dim_customer(T(s, d)).select("customer_sk", "risk_tier"), "customer_sk"),
                              (D.dim_merchant(T(s, d)).select("merchant_sk", "mcc_category"), "merchant_sk")])
    .groupBy("risk_tier", "mcc_category").agg(F.count(F.lit(1)).alias("n_tx")))


# Feature lookup with typed defaults --------------------------------------------------
def _j04(s, d):
    from paylake.operators.features import as_feature_document, customer_features_reference
    from paylake.operators.ml import training_set
    t = T(s, d)
    fact, dc, dm = D.fact_transaction(t), D.dim_customer(t), D.dim_merchant(t)
    docs = as_feature_document(customer_features_reference(training_set(fact, dc, dm, AS_TX)), f"{AS_TX} 00:00:00", "v1")
    tx = fact.select("transaction_id", F.col("customer_sk").cast("string").alias("customer_id"))
    j = J.lookup_features(tx, docs)
    return j.groupBy("feature_found", "tx_count_24h").agg(F.count(F.lit(1)).alias("n_tx"))


F90 = f"""feat AS (SELECT CAST(customer_sk AS VARCHAR) AS customer_id,
           CAST(round_even(LEAST(COUNT(transaction_id) / 90, 200.0), 0) AS INTEGER) AS tx_count_24h
         FROM fact_transaction WHERE {_window('transaction_ts', AS_TX, 90)} GROUP BY customer_sk)"""
register("j04_lookup_features", D.with_ctes(["fact_transaction"], f"""
, {F90}
SELECT feat.customer_id IS NOT NULL AS feature_found, COALESCE(feat.tx_count_24h, 0) AS tx_count_24h, COUNT(*) AS n_tx
FROM fact_transaction f LEFT JOIN feat ON CAST(f.customer_sk AS VARCHAR) = feat.customer_id
GROUP BY ALL"""))(_j04)

# J05 anti-join lives in S09; J06 -------------------------------------------------------------
register("j06_apply_outcomes", D.with_ctes(["full_fact"], """
SELECT status, COUNT(*) AS n_tx, CAST(SUM(refunded_amount) AS DECIMAL(38,2)) AS refunded_amount
FROM full_fact GROUP BY status"""))(
    lambda s, d: J.apply_outcomes(S.stg_transactions(T(s, d)), S.stg_refunds(T(s, d)), S.stg_disputes(T(s, d)))
    .groupBy("status").agg(F.count(F.lit(1)).alias("n_tx"),
                           F.sum("refunded_amount").cast("decimal(38,2)").alias("refunded_amount")))

# J07 ------------------------------------------------------------------------------------------
register("j07_to_usd", D.with_ctes(["full_fact"], """
SELECT currency_code, fx_rate, COUNT(*) AS n_tx, CAST(SUM(CAST(amount * fx_rate AS DECIMAL(18,2))) AS DECIMAL(38,2)) AS amount_usd
FROM full_fact GROUP BY ALL"""))(
    lambda s, d: J.to_usd(S.stg_transactions(T(s, d)).withColumn("transaction_date", F.col("created_at").cast("date")),
                          S.stg_exchange_rates(T(s, d)), amount="amount")
    .groupBy("currency_code", "fx_rate").agg(F.count(F.lit(1)).alias("n_tx"),
                                             F.sum("amount_usd_converted").cast("decimal(38,2)").alias("amount_usd")))


# J08 -------------------------------------------------------------------------------------------
def _j08(s, d):
    t = T(s, d)
    mcc = s.createDataFrame(D.MCC_ROWS, "mcc_code string, description string, category string")
    m = D.dim_merchant(t).select("merchant_sk", "mcc_code")
    return J.enrich_mcc(m, mcc).select("merchant_sk", "mcc_code", "description", "category")


register("j08_enrich_mcc", D.with_ctes(["dim_merchant"], "SELECT merchant_sk, mcc_code, v.description, v.category FROM dim_merchant LEFT JOIN (VALUES " + ", ".join(
    "('{}', '{}', '{}')".format(*[x.replace("'", "''") for x in r]) for r in D.MCC_ROWS) + ") v(code, description, category) ON mcc_code = v.code"))(_j08)

# J08, country half: a code outside the reference list keeps its row with nulls
register("j08_enrich_country", D.with_ctes(["dim_customer"], """
SELECT customer_sk, country_code, CASE country_code WHEN 'NG' THEN 'Africa' WHEN 'FR' THEN 'Europe' WHEN 'US' THEN 'America' END AS ref_region,
       CASE country_code WHEN 'NG' THEN 1 WHEN 'FR' THEN 0 WHEN 'US' THEN 0 END AS ref_high_risk FROM dim_customer"""))(
    lambda s, d: J.enrich_country(
        D.dim_customer(T(s, d)).select("customer_sk", "country_code"),
        s.createDataFrame([("NG", "Africa", 1), ("FR", "Europe", 0), ("US", "America", 0)],
                          "country_code string, ref_region string, ref_high_risk int")))

# J09 --------------------------------------------------------------------------------------------
register("j09_orphans", """
SELECT 'lineitem.l_partkey' AS relationship, COUNT(*) AS n_orphans FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part)
UNION ALL SELECT 'orders.o_custkey', COUNT(*) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)
UNION ALL SELECT 'lineitem.l_orderkey', COUNT(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders)""")(
    lambda s, d: J.orphans(T(s, d).lineitem, T(s, d).part, "l_partkey", "p_partkey").agg(F.count(F.lit(1)).alias("n_orphans"))
    .select(F.lit("lineitem.l_partkey").alias("relationship"), "n_orphans")
    .unionByName(J.orphans(T(s, d).orders, T(s, d).customer, "o_custkey", "c_custkey").agg(F.count(F.lit(1)).alias("n_orphans"))
                 .select(F.lit("orders.o_custkey").alias("relationship"), "n_orphans"))
    .unionByName(J.orphans(T(s, d).lineitem, T(s, d).orders, "l_orderkey", "o_orderkey").agg(F.count(F.lit(1)).alias("n_orphans"))
                 .select(F.lit("lineitem.l_orderkey").alias("relationship"), "n_orphans")))


# Trailing per-customer windows ----------------------------------------------------------------
def _w02(s, d):
    ev = T(s, d).events.select("event_id", "user_id", "ts", "value")
    out = trailing(ev, "user_id", "ts", 86400, "value")
    return out.select("event_id", F.col("value_count_86400s").alias("n_prev_24h"),
                      F.round("value_sum_86400s", 4).alias("sum_prev_24h"))


register("w02_trailing_24h", """
SELECT event_id,
       COUNT(value) OVER w AS n_prev_24h,
       ROUND(COALESCE(SUM(value) OVER w, 0), 4) AS sum_prev_24h
FROM (SELECT *, CAST(epoch(CAST(ts AS TIMESTAMPTZ)) AS BIGINT) AS sec FROM events)
WINDOW w AS (PARTITION BY user_id ORDER BY sec RANGE BETWEEN 86400 PRECEDING AND 1 PRECEDING)""")(_w02)

_W = [("1h", 3600), ("24h", 86400), ("7d", 604800), ("30d", 2592000), ("90d", 7776000)]
register("w02_trailing_windows", "SELECT event_id, " + ", ".join(
    f"COUNT(value) OVER (PARTITION BY user_id ORDER BY sec RANGE BETWEEN {n} PRECEDING AND 1 PRECEDING) AS n_{k}" for k, n in _W) + """
FROM (SELECT *, CAST(epoch(CAST(ts AS TIMESTAMPTZ)) AS BIGINT) AS sec FROM events)""")(
    lambda s, d: trailing_all(T(s, d).events.select("event_id", "user_id", "ts", "value"), "user_id", "ts", "value")
    .select("event_id", *[F.col(f"value_count_{n}s").alias(f"n_{k}") for k, n in _W]))

# the sums of all windows as well (values as decimals, so both sides add exactly)
register("w02_trailing_sums", "SELECT event_id, " + ", ".join(
    f"COALESCE(SUM(v) OVER (PARTITION BY user_id ORDER BY sec RANGE BETWEEN {n} PRECEDING AND 1 PRECEDING), 0)::DECIMAL(38,4) AS s_{k}" for k, n in _W) + """
FROM (SELECT *, CAST(value AS DECIMAL(18,4)) AS v, CAST(epoch(CAST(ts AS TIMESTAMPTZ)) AS BIGINT) AS sec FROM events)""")(
    lambda s, d: trailing_all(T(s, d).events.select("event_id", "user_id", "ts", F.col("value").cast("decimal(18,4)").alias("value")), "user_id", "ts", "value")
    .select("event_id", *[F.col(f"value_sum_{n}s").cast("decimal(38,4)").alias(f"s_{k}") for k, n in _W]))

# Validity intervals of a keyed, dated series from the data ----------------------------------
register("w03_validity_intervals", """
SELECT o_orderpriority, effective_date,
       lead(effective_date) OVER (PARTITION BY o_orderpriority ORDER BY effective_date) AS valid_to
FROM (SELECT DISTINCT o_orderpriority, CAST(o_orderdate AS DATE) AS effective_date FROM orders)""")(
    lambda s, d: J.validity_intervals(
        T(s, d).orders.select("o_orderpriority", F.col("o_orderdate").cast("date").alias("effective_date")).distinct(),
        keys=("o_orderpriority",)))
