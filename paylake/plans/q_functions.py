"""Registered function-level queries.

Each is a small query over a whole derived table exercising one operator.
"""

from __future__ import annotations


from pyspark.sql import functions as F

from paylake.functions import aggregates as A
from paylake.functions import predicates as P
from paylake.functions import scalar as SF
from paylake.plans import domain as D
from paylake.operators.joins import join_dim
from paylake.plans.base import AS_TX, T, _window, register

FACT = ["fact_transaction"]


def fact(s, d):
    return D.fact_transaction(T(s, d))


# ---------------------------------------------------------------- F
register("f01_month_offset", D.with_ctes(FACT, """
SELECT CAST(date_trunc('month', transaction_date) AS DATE) AS month_start,
       (year(DATE '2001-06-30') - year(transaction_date)) * 12 + (month(DATE '2001-06-30') - month(transaction_date)) AS months_before,
       COUNT(*) AS n FROM fact_transaction GROUP BY ALL"""))(
    lambda s, d: fact(s, d).groupBy(SF.month_start("transaction_date").alias("month_start"),
                                    SF.month_offset("transaction_date", F.lit(AS_TX).cast("date")).alias("months_before"))
    .agg(F.count(F.lit(1)).alias("n")))

register("f02_shift", D.with_ctes(FACT, """
SELECT transaction_date + 30 AS due_date,
       CAST(transaction_date + INTERVAL 1 MONTH AS DATE) AS next_month, COUNT(*) AS n
FROM fact_transaction GROUP BY ALL"""))(
    lambda s, d: fact(s, d).groupBy(SF.shift("transaction_date", 30).alias("due_date"),
                                    SF.shift("transaction_date", 1, "month").alias("next_month"))
    .agg(F.count(F.lit(1)).alias("n")))

register("f03_day", "SELECT CAST(ts AS DATE) AS day, COUNT(*) AS n FROM events GROUP BY 1")(
    lambda s, d: T(s, d).events.groupBy(SF.day("ts").alias("day")).agg(F.count(F.lit(1)).alias("n")))


def _f04(s, d):
    e = T(s, d).events.select("event_id", F.unix_timestamp(F.col("ts").cast("timestamp")).alias("u"))
    si, co = SF.hour_cyclic("u")
    return e.select("event_id", SF.hour_of_day("u").cast("int").alias("hour"),
                    (F.round(si, 9) + 0.0).alias("hour_sin"), (F.round(co, 9) + 0.0).alias("hour_cos"))


register("f04_hour_cyclic", """
SELECT event_id, CAST(floor((CAST(floor(epoch(ts)) AS BIGINT) % 86400) / 3600) AS INTEGER) AS hour,
       ROUND(sin(floor((CAST(floor(epoch(ts)) AS BIGINT) % 86400) / 3600) * (2 * pi()) / 24), 9) + 0.0 AS hour_sin,
       ROUND(cos(floor((CAST(floor(epoch(ts)) AS BIGINT) % 86400) / 3600) * (2 * pi()) / 24), 9) + 0.0 AS hour_cos
FROM events""")(_f04)

register("f05_degree_distance", D.with_ctes(["payments_landing"], """
SELECT trans_num, ROUND(sqrt(pow(TRY_CAST(lat AS DOUBLE) - TRY_CAST(merch_lat AS DOUBLE), 2)
                  + pow(TRY_CAST(long AS DOUBLE) - TRY_CAST(merch_long AS DOUBLE), 2)), 9) AS distance
FROM payments_landing"""))(
    lambda s, d: D.payments_landing(T(s, d)).select(
        "trans_num", F.round(SF.degree_distance(*[SF.to_number(c) for c in ["lat", "long", "merch_lat", "merch_long"]]), 9)
        .alias("distance")))

register("f06_log_amount", D.with_ctes(FACT, """
SELECT transaction_id, ROUND(ln(1 + CAST(amount_usd AS DOUBLE)), 9) AS log_amt FROM fact_transaction"""))(
    lambda s, d: fact(s, d).select("transaction_id", F.round(SF.log_amount(F.col("amount_usd").cast("double")), 9).alias("log_amt")))

register("f07_rounding", """
SELECT l_orderkey, l_linenumber,
       CAST(ROUND(CAST(CAST(l_extendedprice AS DECIMAL(18,2)) / 7 AS DECIMAL(38,6)), 0) AS DOUBLE) AS half_up,
       CAST(round_even(CAST(CAST(l_extendedprice AS DECIMAL(18,2)) / 7 AS DECIMAL(38,6)), 0) AS DOUBLE) AS half_even
FROM lineitem""")(
    lambda s, d: T(s, d).lineitem.select(
        "l_orderkey", "l_linenumber",
        SF.round_half_up((F.col("l_extendedprice").cast("decimal(18,2)") / 7).cast("decimal(38,6)"), 0).cast("double").alias("half_up"),
        SF.round_half_even((F.col("l_extendedprice").cast("decimal(18,2)") / 7).cast("decimal(38,6)"), 0).cast("double").alias("half_even")))

register("f08_nullif_coalesce", """
SELECT l_returnflag, COUNT(NULLIF(l_linestatus, 'O')) AS n_not_open,
       COUNT(*) AS n, CAST(SUM(CAST(COALESCE(NULLIF(l_discount, 0), -1) < 0 AS INTEGER)) AS BIGINT) AS n_zero_discount
FROM lineitem GROUP BY 1""")(
    lambda s, d: T(s, d).lineitem.groupBy("l_returnflag").agg(
        F.count(SF.nullif("l_linestatus", "O")).alias("n_not_open"), F.count(F.lit(1)).alias("n"),
        F.sum((F.coalesce(SF.nullif("l_discount", 0.0), F.lit(-1.0)) < 0).cast("long")).cast("long").alias("n_zero_discount")))

register("f09_clamp", "SELECT event_id, LEAST(GREATEST(value / 50, 0.1), 1.0) AS clamped FROM events")(
    lambda s, d: T(s, d).events.select("event_id", SF.clamp(F.col("value") / 50, 0.1, 1.0).alias("clamped")))

register("f10_sha256", "SELECT c_custkey, sha256(c_name) AS name_hash FROM customer")(
    lambda s, d: T(s, d).customer.select("c_custkey", SF.sha256_hex("c_name").alias("name_hash")))

register("f11_pick_pad", D.with_ctes(FACT, f"""
SELECT lpad(CAST(merchant_sk AS VARCHAR), 8, '0') AS merchant_code,
       {D._sql_list(D.CURRENCIES)}[merchant_sk % 8 + 1] AS home_currency, COUNT(*) AS n
FROM fact_transaction GROUP BY ALL"""))(
    lambda s, d: fact(s, d).groupBy(SF.pad("merchant_sk", 8).alias("merchant_code"),
                                    SF.pick(D.CURRENCIES, F.pmod("merchant_sk", F.lit(8))).alias("home_currency"))
    .agg(F.count(F.lit(1)).alias("n")))

register("f11_bucket", D.with_ctes(FACT, """
SELECT CAST(('0x' || substr(md5(CAST(merchant_sk AS VARCHAR)), 1, 8)) AS BIGINT) % 16 AS bucket, COUNT(DISTINCT merchant_sk) AS n_merchants, COUNT(*) AS n
FROM fact_transaction GROUP BY 1"""))(
    lambda s, d: fact(s, d).groupBy(SF.bucket("merchant_sk", 16).alias("bucket"), "merchant_sk").agg(F.count(F.lit(1)).alias("_n"))
    .groupBy("bucket").agg(F.count(F.lit(1)).alias("n_merchants"), F.sum("_n").alias("n")))

register("f12_mask_card", D.with_ctes(["payments_landing"], """
SELECT trans_num, '***' || right(cc_num, 4) AS card FROM payments_landing"""))(
    lambda s, d: D.payments_landing(T(s, d)).select("trans_num", SF.mask_card("cc_num").alias("card")))

register("f13_json", """
SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events""")(
    lambda s, d: T(s, d).events.select("event_id", SF.json_field("props", "k").cast("int").alias("k")))

register("f13_json_object", """
SELECT event_id, '{"event_id":' || CAST(event_id AS VARCHAR) || ',"event_type":"' || event_type || '"}' AS doc FROM events""")(
    lambda s, d: T(s, d).events.select("event_id", SF.json_object("event_id", "event_type").alias("doc")))

# the set per user is bounded by the event-type domain (5 values) and is
# deduplicated map-side, so a hot user does not grow it
register("f14_array_ops", """
SELECT user_id, COUNT(DISTINCT event_type) AS n_types,
       bool_or(event_type = 'purchase') AS has_purchase FROM events GROUP BY 1""")(
    lambda s, d: T(s, d).events.groupBy("user_id").agg(F.collect_set("event_type").alias("types"))
    .select("user_id", SF.size("types").cast("long").alias("n_types"), SF.contains("types", "purchase").alias("has_purchase")))

register("f15_to_number", D.with_ctes(["payments_landing"], """
SELECT trans_num, COALESCE(TRY_CAST(amt AS DOUBLE), -1.0) AS amt_num FROM payments_landing"""))(
    lambda s, d: D.payments_landing(T(s, d)).select("trans_num", SF.to_number("amt", -1.0).alias("amt_num")))

# ---------------------------------------------------------------- P
register("p01_lookback", D.with_ctes(FACT, f"""
SELECT COUNT(*) AS n_30d FROM fact_transaction WHERE {_window('transaction_ts', AS_TX, 30)}"""))(
    lambda s, d: P.lookback(fact(s, d), "transaction_ts", AS_TX, 30).agg(F.count(F.lit(1)).alias("n_30d")))

register("p02_on_day", "SELECT COUNT(*) AS n FROM events WHERE CAST(ts AS DATE) = DATE '2024-01-15'")(
    lambda s, d: P.on_day(T(s, d).events, "ts", "2024-01-15").agg(F.count(F.lit(1)).alias("n")))

register("p03_member_of", "SELECT event_type, COUNT(*) AS n FROM events WHERE event_type IN ('purchase', 'error') GROUP BY 1")(
    lambda s, d: T(s, d).events.filter(P.member_of("event_type", ["purchase", "error"])).groupBy("event_type")
    .agg(F.count(F.lit(1)).alias("n")))

register("p04_having", D.with_ctes(FACT, """
SELECT customer_sk, COUNT(*) AS n FROM fact_transaction GROUP BY 1 HAVING COUNT(*) >= 60"""))(
    lambda s, d: A.n_rows(fact(s, d), "customer_sk", "n").filter(F.col("n") >= 60))

register("p05_safe_ratio", D.with_ctes(FACT, """
SELECT merchant_sk, ROUND(CAST(SUM(is_high_fraud_risk) AS DOUBLE) / NULLIF(SUM(CASE WHEN status = 'refunded' THEN 1 ELSE 0 END), 0), 6) AS risk_per_refund
FROM fact_transaction GROUP BY 1"""))(
    lambda s, d: fact(s, d).groupBy("merchant_sk").agg(
        F.round(P.safe_ratio(F.sum("is_high_fraud_risk"), A.sum_if(F.col("status") == "refunded")), 6).alias("risk_per_refund")))

register("p06_json_path", D.with_ctes(["audit_log"], """
SELECT metadata->>'reason' AS reason, COUNT(metadata->>'approved_by') AS n_approved FROM audit_log GROUP BY 1"""))(
    lambda s, d: D.audit_log(T(s, d)).groupBy(SF.json_field("metadata", "reason").alias("reason"))
    .agg(F.count(SF.json_field("metadata", "approved_by")).alias("n_approved")))

register("p07_nested_default", D.with_ctes(["clickstream"], """
SELECT COALESCE(device_type, 'unknown') AS device_type, COUNT(*) AS n FROM clickstream GROUP BY 1"""))(
    lambda s, d: D.clickstream(T(s, d)).groupBy(P.with_default("device.type", "unknown").alias("device_type"))
    .agg(F.count(F.lit(1)).alias("n")))

register("p08_coerce_features", D.with_ctes(["payments_landing"], """
SELECT COUNT(*) FILTER (WHERE TRY_CAST(amt AS DOUBLE) IS NULL) AS n_bad_amt,
       CAST(SUM(CAST(trunc(COALESCE(TRY_CAST(city_pop AS DOUBLE), 0)) AS BIGINT)) AS BIGINT) AS city_pop_total
FROM payments_landing"""))(
    lambda s, d: P.coerce_features(D.payments_landing(T(s, d))).agg(
        F.count_if(F.col("amt").isNull()).alias("n_bad_amt"), F.sum("city_pop").cast("long").alias("city_pop_total")))

register("p09_risky_open", D.with_ctes(FACT, """
SELECT status, COUNT(*) AS n FROM fact_transaction WHERE fraud_score > 0.5 GROUP BY 1"""))(
    lambda s, d: P.risky(fact(s, d)).groupBy("status").agg(F.count(F.lit(1)).alias("n")))

register("p09_open_statuses", """
SELECT status, COUNT(*) AS n FROM (
  SELECT CASE (l_orderkey * 10 + l_linenumber) % 6 WHEN 0 THEN 'pending' WHEN 1 THEN 'authorized' WHEN 2 THEN 'captured'
              WHEN 3 THEN 'failed' WHEN 4 THEN 'refunded' ELSE 'disputed' END AS status FROM lineitem)
WHERE status IN ('pending', 'failed', 'disputed') GROUP BY 1""")(
    lambda s, d: P.open_statuses(T(s, d).lineitem.select(
        SF.pick(["pending", "authorized", "captured", "failed", "refunded", "disputed"],
                F.pmod(F.col("l_orderkey") * 10 + F.col("l_linenumber"), F.lit(6))).alias("status")))
    .groupBy("status").agg(F.count(F.lit(1)).alias("n")))

register("p10_live", """
SELECT COUNT(*) AS n_live FROM customer WHERE NOT (c_acctbal < 0)""")(
    lambda s, d: P.live(T(s, d).customer.withColumn("deleted_at", F.when(F.col("c_acctbal") < 0, F.lit("2001-01-01").cast("date"))))
    .agg(F.count(F.lit(1)).alias("n_live")))

register("p11_split_rejected", D.with_ctes(["payments_landing"], """
SELECT merchant IS NOT NULL AS accepted, COUNT(*) AS n FROM payments_landing GROUP BY 1"""))(
    lambda s, d: (lambda ok, bad: ok.agg(F.count(F.lit(1)).alias("n")).select(F.lit(True).alias("accepted"), "n")
                  .unionByName(bad.agg(F.count(F.lit(1)).alias("n")).select(F.lit(False).alias("accepted"), "n")))(
        *P.split_rejected(D.payments_landing(T(s, d)), "merchant")))

# ---------------------------------------------------------------- A
register("a01_n_rows", D.with_ctes(FACT, "SELECT status, COUNT(*) AS n_rows FROM fact_transaction GROUP BY 1"))(
    lambda s, d: A.n_rows(fact(s, d), "status"))
register("a02_n_distinct", D.with_ctes(FACT, "SELECT merchant_sk, COUNT(DISTINCT customer_sk) AS n_distinct FROM fact_transaction GROUP BY 1"))(
    lambda s, d: A.n_distinct(fact(s, d), "merchant_sk", "customer_sk"))
register("a03_n_distinct_if", D.with_ctes(FACT, """
SELECT merchant_sk, COUNT(DISTINCT CASE WHEN is_high_fraud_risk = 1 THEN customer_sk END) AS n_distinct_if
FROM fact_transaction GROUP BY 1"""))(
    lambda s, d: A.n_distinct_if(fact(s, d), "merchant_sk", "customer_sk", F.col("is_high_fraud_risk") == 1))
register("a04_totals", "SELECT event_type, ROUND(SUM(value), 4) AS sum_value, ROUND(AVG(value), 6) AS avg_value, MAX(value) AS max_value FROM events GROUP BY 1")(
    lambda s, d: A.totals(T(s, d).events, "event_type", "value").select(
        "event_type", F.round("sum_value", 4).alias("sum_value"), F.round("avg_value", 6).alias("avg_value"),
        F.col("max_value")))
register("a05_sum_if", D.with_ctes(FACT, """
SELECT region, CAST(SUM(CASE WHEN status = 'captured' THEN amount_usd ELSE 0 END) AS DECIMAL(38,2)) AS captured_usd,
       COUNT(*) FILTER (WHERE status = 'refunded') AS n_refunded
FROM fact_transaction f JOIN (SELECT s_suppkey, r_name AS region FROM supplier JOIN nation ON s_nationkey = n_nationkey
                              JOIN region ON n_regionkey = r_regionkey) m ON f.merchant_sk = m.s_suppkey GROUP BY 1"""))(
    lambda s, d: join_dim(fact(s, d), D.dim_merchant(T(s, d)).select("merchant_sk", "region"), "merchant_sk", "inner")
    .groupBy("region").agg(A.sum_if(F.col("status") == "captured", "amount_usd").cast("decimal(38,2)").alias("captured_usd"),
                           A.count_if(F.col("status") == "refunded").alias("n_refunded")))
register("a06_percentile", "SELECT event_type, ROUND(quantile_cont(value, 0.95), 6) AS p95 FROM events GROUP BY 1")(
    lambda s, d: A.pctl_by(T(s, d).events, ["event_type"], "value", 0.95, "p95").withColumn("p95", F.round("p95", 6)))
register("a07_set_flags", """
SELECT user_id, COUNT(DISTINCT event_type) AS set_size, MAX(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) AS has_error
FROM events GROUP BY 1""")(
    lambda s, d: A.set_size(T(s, d).events, "user_id", "event_type").join(
        T(s, d).events.groupBy("user_id").agg(A.has_any(F.col("event_type") == "error").alias("has_error")), "user_id"))
register("a08_two_level", """
SELECT event_type, COUNT(*) AS n_users, ROUND(AVG(n), 6) AS avg_per_user
FROM (SELECT user_id, event_type, COUNT(*) AS n FROM events GROUP BY 1, 2) GROUP BY 1""")(
    lambda s, d: A.two_level(T(s, d).events, ["user_id", "event_type"], ["event_type"],
                             [F.count(F.lit(1)).alias("n")],
                             [F.count(F.lit(1)).alias("n_users"), F.round(F.avg("n"), 6).alias("avg_per_user")]))
register("a09_distinct_keys", D.with_ctes(FACT, """
SELECT DISTINCT customer_sk, CAST(date_trunc('month', transaction_date) AS DATE) AS tx_month FROM fact_transaction WHERE status = 'captured'"""))(
    lambda s, d: A.distinct_keys(fact(s, d).filter(F.col("status") == "captured")
                                 .select("customer_sk", SF.month_start("transaction_date").alias("tx_month")),
                                 ["customer_sk", "tx_month"]))
register("a10_pct", """
SELECT event_type, ROUND(CAST(SUM(CASE WHEN value > 50 THEN 1 ELSE 0 END) AS DOUBLE) / NULLIF(COUNT(*), 0) * 100, 2) AS pct_high,
       ROUND(CAST(SUM(CASE WHEN value > 99 THEN 1 ELSE 0 END) AS DOUBLE) / CAST(GREATEST(SUM(CASE WHEN value > 50 THEN 1 ELSE 0 END), 1) AS DOUBLE) * 100, 2) AS pct_top
FROM events GROUP BY 1""")(
    lambda s, d: T(s, d).events.groupBy("event_type").agg(
        A.pct(A.sum_if(F.col("value") > 50), F.count(F.lit(1))).alias("pct_high"),
        A.pct(A.sum_if(F.col("value") > 99), A.sum_if(F.col("value") > 50), floor_den=True).alias("pct_top")))
register("a11_histogram", """
SELECT CAST(LEAST(floor((value - 0) / 10.0), 9) AS INTEGER) AS bin, COUNT(*) AS n FROM events
WHERE value >= 0 AND value <= 100 GROUP BY 1""")(lambda s, d: A.histogram(T(s, d).events, "value", 0.0, 100.0, 10))
register("a12_label_rate", D.with_ctes(FACT, """
SELECT device_type, AVG(CAST(is_high_fraud_risk AS DOUBLE)) AS label_rate FROM fact_transaction GROUP BY 1"""))(
    lambda s, d: A.label_rate(fact(s, d), "device_type", "is_high_fraud_risk"))

# ---------------------------------------------------------------- L
register("l01_sort_nulls", D.with_ctes(["fact_transaction", "dim_customer"], """
SELECT c.risk_tier, CAST(SUM(f.amount_usd) AS DECIMAL(38,2)) AS volume
FROM fact_transaction f LEFT JOIN dim_customer c USING (customer_sk) GROUP BY 1 ORDER BY volume DESC NULLS LAST"""))(
    lambda s, d: join_dim(fact(s, d), D.dim_customer(T(s, d)).select("customer_sk", "risk_tier"), "customer_sk")
    .groupBy("risk_tier").agg(F.sum("amount_usd").cast("decimal(38,2)").alias("volume"))
    .orderBy(F.col("volume").desc_nulls_last(), F.col("risk_tier").asc_nulls_first()))
register("l02_top_k", D.with_ctes(FACT, """
SELECT customer_sk, CAST(SUM(revenue_usd) AS DECIMAL(38,4)) AS revenue FROM fact_transaction GROUP BY 1
ORDER BY revenue DESC, customer_sk LIMIT 10"""))(
    lambda s, d: fact(s, d).groupBy("customer_sk").agg(F.sum("revenue_usd").cast("decimal(38,4)").alias("revenue"))
    .orderBy(F.col("revenue").desc(), "customer_sk").limit(10))


def _l03(s, d):
    from paylake.operators.ml import training_set
    t = T(s, d)
    capped = training_set(fact(s, d), D.dim_customer(t), D.dim_merchant(t), AS_TX, days=365, cap=5000)
    return capped.agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct("transaction_id").alias("n_ids"))


register("l03_cap", D.with_ctes(["fact_transaction", "dim_customer", "dim_merchant"], f"""
, x AS (SELECT f.transaction_id, row_number() OVER (ORDER BY substr(md5(f.transaction_id || '|42'), 1, 13), f.transaction_id) AS r
        FROM fact_transaction f LEFT JOIN dim_customer c USING (customer_sk) LEFT JOIN dim_merchant m USING (merchant_sk)
        WHERE {_window('f.transaction_ts', AS_TX, 365)})
SELECT COUNT(*) AS n_rows, COUNT(DISTINCT transaction_id) AS n_ids FROM x WHERE r <= 5000"""))(_l03)


def _l03_rows(s, d):
    from paylake.operators.ml import training_set
    t = T(s, d)
    return training_set(D.fact_transaction(t, AS_TX, 365), D.dim_customer(t), D.dim_merchant(t), AS_TX, days=365, cap=5000).select("transaction_id")


# which rows the cap keeps
register("l03_cap_rows", D.with_ctes(["fact_transaction"], f"""
SELECT transaction_id FROM fact_transaction WHERE {_window('transaction_ts', AS_TX, 365)}
QUALIFY row_number() OVER (ORDER BY substr(md5(transaction_id || '|42'), 1, 13), transaction_id) <= 5000"""))(_l03_rows)


# P09 on a layout made for it: rare statuses sorted together, read back by status
def _p09_layout(s, d):
    from paylake.sources.sinks import write_skipping
    from paylake.streaming.ingest import run_dir
    key = F.col("l_orderkey") * 10 + F.col("l_linenumber")
    status = SF.pick(["pending", "authorized", "captured", "failed", "refunded", "disputed"], F.pmod(key, F.lit(6)))
    path = run_dir(s, "skipping") + "/transactions"
    write_skipping(T(s, d).lineitem.select(status.alias("status"), key.alias("transaction_sk"), F.col("l_extendedprice").alias("amount")), path,
                   ["status", "transaction_sk"], bloom={"transaction_sk": 1_000_000})
    return P.open_statuses(s.read.parquet(path)).groupBy("status").agg(
        F.count(F.lit(1)).alias("n"), F.sum("transaction_sk").alias("keys"))


register("p09_skipping_layout", """
SELECT status, COUNT(*) AS n, CAST(SUM(k) AS BIGINT) AS keys FROM (
  SELECT l_orderkey * 10 + l_linenumber AS k, CASE (l_orderkey * 10 + l_linenumber) % 6 WHEN 0 THEN 'pending' WHEN 1 THEN 'authorized' WHEN 2 THEN 'captured'
              WHEN 3 THEN 'failed' WHEN 4 THEN 'refunded' ELSE 'disputed' END AS status FROM lineitem)
WHERE status IN ('pending', 'failed', 'disputed') GROUP BY 1""")(_p09_layout)
