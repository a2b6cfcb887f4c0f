"""Registered data-quality (V01-V13) and source/sink (S01-S14) queries."""

from __future__ import annotations

import os

from pyspark.sql import functions as F
from pyspark.sql import types as T_

from paylake.operators import quality as Q
from paylake.operators.joins import join_dim
from paylake.plans import domain as D
from paylake.plans.base import AS_IN, AS_TX, T, _window, register
from paylake.sources import changes as C
from paylake.sources import readers as RD
from paylake.sources import sinks as SK
from paylake.streaming.ingest import run_dir

LANDING = D.with_ctes(["payments_landing"], "")


def _sql_errors() -> list[str]:
    """Oracle twin of the validator: one CASE per rule, in rule order."""
    out = [f"CASE WHEN {f} IS NULL THEN '{Q.MSG_MISSING.format(field=f)}' END" for f in Q.REQUIRED_FIELDS]
    v = "TRY_CAST(amt AS DOUBLE)"
    bad = f"(amt IS NOT NULL AND ({v} IS NULL OR isnan({v})))"
    pre = lambda m: m.split("{value}")[0].replace("'", "''")
    out.append(f"CASE WHEN {bad} THEN '{pre(Q.MSG_AMOUNT_NOT_NUMERIC)}' || amt END")
    out.append(f"CASE WHEN NOT {bad} AND {v} <= 0 THEN '{pre(Q.MSG_AMOUNT_NOT_POSITIVE)}' || amt END")
    out.append(f"CASE WHEN NOT {bad} AND {v} > {Q.AMOUNT_MAX} THEN '{pre(Q.MSG_AMOUNT_TOO_LARGE)}' || amt END")
    for f, lo, hi in Q.COORDINATE_BOUNDS:
        fv = f"TRY_CAST({f} AS DOUBLE)"
        out.append(f"CASE WHEN {f} IS NULL THEN NULL WHEN {fv} IS NULL THEN '{f} non numérique: ' || {f} "
                   f"WHEN isnan({fv}) OR NOT ({fv} BETWEEN {lo} AND {hi}) THEN '{f} hors limites: ' || {f} END")
    out.append(f"CASE WHEN cc_num IS NOT NULL AND length(cc_num) < {Q.CARD_MIN_LENGTH} "
               f"THEN '{pre(Q.MSG_CARD_TOO_SHORT)}' || cc_num END")
    return out


ERRS = _sql_errors()
N_SCHEMA = len(Q.REQUIRED_FIELDS)
VERDICT_SQL = f"""verdict AS (
  SELECT *, concat_ws('; ', {', '.join(ERRS)}) AS error_message,
         {' + '.join(f'CAST(({e}) IS NOT NULL AS INTEGER)' for e in ERRS)} AS n_errors,
         {' + '.join(f'CAST(({e}) IS NOT NULL AS INTEGER)' for e in ERRS[:N_SCHEMA])} AS n_schema_errors
  FROM payments_landing)"""
D.CTES["verdict"] = VERDICT_SQL

# Verdict per record --------------------------------------------
register("v05_validate", D.with_ctes(["payments_landing", "verdict"], """
SELECT trans_num, CASE WHEN n_errors = 0 THEN 'valid' ELSE 'rejected' END AS data_quality_status,
       n_errors, error_message FROM verdict"""))(
    lambda s, d: Q.verdict(D.payments_landing(T(s, d))))

# Stored probabilities with bad ones among them
def _v06(s, d):
    n = F.col("rn")
    p = (F.when(n % 23 == 0, F.lit(None)).when(n % 29 == 0, F.lit(1.5)).when(n % 31 == 0, F.lit(-0.25))
         .when(n % 37 == 0, F.lit(float("nan"))).otherwise(F.col("fraud_probability").cast("double")))
    x = T(s, d).lineitem.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("rn"),
                                (F.col("l_discount").cast("decimal(4,2)") * 10).cast("decimal(5,4)").alias("fraud_probability"))
    x = x.withColumn("fraud_probability", p)
    return x.select(F.col("rn").alias("transaction_sk"), F.when(Q.rule_probability()[0].message.isNull(), "ok")
                    .when(F.col("fraud_probability").isNull(), "null").otherwise("out_of_range").alias("outcome"))


register("v06_probability_rule", """
SELECT l_orderkey * 10 + l_linenumber AS transaction_sk,
       CASE WHEN (l_orderkey * 10 + l_linenumber) % 23 = 0 THEN 'null'
            WHEN (l_orderkey * 10 + l_linenumber) % 29 = 0 OR (l_orderkey * 10 + l_linenumber) % 31 = 0
              OR (l_orderkey * 10 + l_linenumber) % 37 = 0 THEN 'out_of_range'
            WHEN l_discount * 10 > 1 THEN 'out_of_range' ELSE 'ok' END AS outcome
FROM lineitem""")(_v06)

# V07 -------------------------------------------------------------------
register("v07_dq_summary", D.with_ctes(["payments_landing", "verdict"], """
SELECT check_name, check_type, COUNT(*) AS records_checked,
       CAST(SUM(p) AS BIGINT) AS records_passed,
       CAST(ROUND(CAST(SUM(p) AS DOUBLE) / COUNT(*), 4) AS DECIMAL(5,4)) AS pass_rate
FROM (SELECT 'schema_validation' AS check_name, 'schema' AS check_type, CASE WHEN n_schema_errors = 0 THEN 1 ELSE 0 END AS p FROM verdict
      UNION ALL
      SELECT 'business_rules', 'rule', CASE WHEN n_errors - n_schema_errors = 0 THEN 1 ELSE 0 END FROM verdict) x
GROUP BY check_name, check_type"""))(
    lambda s, d: Q.dq_summary(Q.dq_log(Q.validate(D.payments_landing(T(s, d))), execution_date=AS_IN)))

# V08 -------------------------------------------------------------------
register("v08_quality_gate", D.with_ctes(["payments_landing", "verdict"], f"""
SELECT COUNT(*) AS records,
       ROUND(CAST(SUM(CASE WHEN n_errors = 0 THEN 1 ELSE 0 END) AS DOUBLE) / COUNT(*), 4) AS pass_rate,
       ROUND(GREATEST({', '.join(f'CAST(SUM(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END) AS DOUBLE) / COUNT(*)' for c in Q.REQUIRED_FIELDS)}), 4) AS max_null_ratio,
       ROUND(CAST(SUM(CASE WHEN n_errors = 0 THEN 1 ELSE 0 END) AS DOUBLE) / COUNT(*), 4) >= {Q.MIN_PASS_RATE}
         AND ROUND(GREATEST({', '.join(f'CAST(SUM(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END) AS DOUBLE) / COUNT(*)' for c in Q.REQUIRED_FIELDS)}), 4) <= {Q.MAX_NULL_RATIO} AS passed
FROM verdict"""))(lambda s, d: Q.quality_gate(Q.validate(D.payments_landing(T(s, d))), Q.REQUIRED_FIELDS))


# V09-V11 ----------------------------------------------------------------
def _fact_rules():
    return [Q.rule_accepted("status", Q.ACCEPTED_VALUES["tx_status"]),
            Q.rule_accepted("device_type", Q.ACCEPTED_VALUES["device_type"]),
            Q.rule_range("fraud_score", 0, 1), Q.rule_range("amount_usd", 0, None, lo_open=True),
            Q.rule_length("currency_code", 3), Q.rule_length("country_code", 2)]


def _rules_query(s, d):
    t = T(s, d)
    f = join_dim(D.fact_transaction(t), D.dim_customer(t).select("customer_sk", "country_code"), "customer_sk")
    return Q.rule_report(f, _fact_rules())


_acc = lambda c, k: f"{c} IS NOT NULL AND {c} NOT IN ({', '.join(repr(v) for v in Q.ACCEPTED_VALUES[k])})"
register("v09_v11_rule_report", D.with_ctes(["fact_transaction", "dim_customer"], f"""
, f AS (SELECT f.*, c.country_code FROM fact_transaction f LEFT JOIN dim_customer c ON f.customer_sk = c.customer_sk)
SELECT rule_name, n_checked, n_failed FROM (
  SELECT COUNT(*) AS n_checked,
    CAST(SUM(CASE WHEN {_acc('status', 'tx_status')} THEN 1 ELSE 0 END) AS BIGINT) AS accepted_status,
    CAST(SUM(CASE WHEN {_acc('device_type', 'device_type')} THEN 1 ELSE 0 END) AS BIGINT) AS accepted_device_type,
    CAST(SUM(CASE WHEN fraud_score IS NOT NULL AND (fraud_score < 0 OR fraud_score > 1) THEN 1 ELSE 0 END) AS BIGINT) AS range_fraud_score,
    CAST(SUM(CASE WHEN amount_usd IS NOT NULL AND amount_usd <= 0 THEN 1 ELSE 0 END) AS BIGINT) AS range_amount_usd,
    CAST(SUM(CASE WHEN currency_code IS NOT NULL AND length(currency_code) <> 3 THEN 1 ELSE 0 END) AS BIGINT) AS length_currency_code,
    CAST(SUM(CASE WHEN country_code IS NOT NULL AND length(country_code) <> 2 THEN 1 ELSE 0 END) AS BIGINT) AS length_country_code
  FROM f) UNPIVOT (n_failed FOR rule_name IN (accepted_status, accepted_device_type, range_fraud_score,
                                               range_amount_usd, length_currency_code, length_country_code))"""))(_rules_query)

register("v11_row_count_gate", """
SELECT 'row_count' AS gate, COUNT(*) AS n_rows, COUNT(*) >= 1000 AS passed FROM lineitem JOIN orders ON l_orderkey = o_orderkey""")(
    lambda s, d: Q.gate_row_count(D.recorded_transactions(T(s, d)), 1000))

# All eight value lists and five ranges, each with good and bad values
def _contract_rows(t):
    n = F.col("l_orderkey") * 10 + F.col("l_linenumber")
    of = lambda m, *v: F.element_at(F.array(*[F.lit(x) for x in v]), (F.pmod(n, F.lit(m)) % len(v) + 1).cast("int"))
    return t.lineitem.select(
        of(101, "pending", "verified", "rejected", "suspended", "expired").alias("kyc_status"),
        of(103, "company", "individual", "nonprofit", "government", "trust", None).alias("business_type"),
        of(107, "active", "suspended", "terminated", "paused").alias("merchant_status"),
        of(109, "card", "bank_account", "wallet", "crypto", "cash").alias("method_type"),
        of(113, "pending", "authorized", "captured", "failed", "refunded", "disputed", "void").alias("tx_status"),
        of(127, "mobile", "desktop", "tablet", "api", "other", "tv", None).alias("device_type"),
        of(131, "pending", "succeeded", "failed", "disputed").alias("refund_status"),
        of(137, "needs_response", "under_review", "won", "lost", "open").alias("dispute_status"),
        ((F.pmod(n, F.lit(140)) - 20) / 100).alias("risk_score"), ((F.pmod(n, F.lit(130)) - 10) / 100).alias("fraud_score"),
        (F.pmod(n, F.lit(50)) - 5).alias("amount"), (F.pmod(n, F.lit(60)) - 3).alias("refund_amount"),
        F.pmod(n, F.lit(15)).alias("exp_month"))


def _contract_rules():
    lists = ["kyc_status", "business_type", "merchant_status", "method_type", "tx_status", "device_type", "refund_status", "dispute_status"]
    return [*[Q.rule_accepted(c, Q.ACCEPTED_VALUES[c]) for c in lists], Q.rule_range("risk_score", 0, 1), Q.rule_range("fraud_score", 0, 1),
            Q.rule_range("amount", 0, None, lo_open=True), Q.rule_range("refund_amount", 0, None, lo_open=True), Q.rule_range("exp_month", 1, 12)]


register("v09_v10_contract_rules", """
WITH x AS (SELECT l_orderkey * 10 + l_linenumber AS n FROM lineitem),
f AS (SELECT 'accepted_kyc_status' AS rule_name, n % 101 % 5 = 4 AS bad FROM x
  UNION ALL SELECT 'accepted_business_type', n % 103 % 6 = 4 FROM x
  UNION ALL SELECT 'accepted_merchant_status', n % 107 % 4 = 3 FROM x
  UNION ALL SELECT 'accepted_method_type', n % 109 % 5 = 4 FROM x
  UNION ALL SELECT 'accepted_tx_status', n % 113 % 7 = 6 FROM x
  UNION ALL SELECT 'accepted_device_type', n % 127 % 7 = 5 FROM x
  UNION ALL SELECT 'accepted_refund_status', n % 131 % 4 = 3 FROM x
  UNION ALL SELECT 'accepted_dispute_status', n % 137 % 5 = 4 FROM x
  UNION ALL SELECT 'range_risk_score', n % 140 < 20 OR n % 140 > 120 FROM x
  UNION ALL SELECT 'range_fraud_score', n % 130 < 10 OR n % 130 > 110 FROM x
  UNION ALL SELECT 'range_amount', n % 50 <= 5 FROM x
  UNION ALL SELECT 'range_refund_amount', n % 60 <= 3 FROM x
  UNION ALL SELECT 'range_exp_month', n % 15 < 1 OR n % 15 > 12 FROM x)
SELECT rule_name, COUNT(*) AS n_checked, CAST(SUM(CASE WHEN bad THEN 1 ELSE 0 END) AS BIGINT) AS n_failed FROM f GROUP BY 1""")(
    lambda s, d: Q.rule_report(_contract_rows(T(s, d)), _contract_rules()))

# V12 -------------------------------------------------------------------
register("v12_duplicates", D.with_ctes(["recorded_transactions"], """
SELECT transaction_sk, COUNT(*) AS n_copies FROM recorded_transactions GROUP BY transaction_sk HAVING COUNT(*) > 1"""))(
    lambda s, d: Q.duplicates(D.recorded_transactions(T(s, d)), "transaction_sk"))


# Every declared unique key
def _keys(s, d):
    t = T(s, d)
    return Q.key_report({
        "email": (t.customer.select(F.concat(F.lit("c"), F.floor(F.col("c_custkey") / 3).cast("string"), F.lit("@example.com")).alias("email")), ["email"]),
        "trans_num": (D.payments_landing(t), ["trans_num"]),
        "rate": (t.orders.select(F.col("o_orderpriority").alias("from_currency"), F.col("o_orderstatus").alias("to_currency"),
                                 F.col("o_orderdate").cast("date").alias("effective_date")), ["from_currency", "to_currency", "effective_date"]),
        "alert": (t.events.select(F.concat(F.lit("tx_"), F.floor(F.col("event_id") / 2).cast("string")).alias("transaction_id")), ["transaction_id"])})


register("v12_declared_keys", """
WITH k AS (SELECT 'email' AS key_name, CAST(c_custkey // 3 AS VARCHAR) AS k, COUNT(*) AS n FROM customer GROUP BY 2
  UNION ALL SELECT 'trans_num', CAST(l_orderkey AS VARCHAR) || '-' || CAST(l_linenumber AS VARCHAR), COUNT(*) FROM lineitem GROUP BY 2
  UNION ALL SELECT 'rate', o_orderpriority || '|' || o_orderstatus || '|' || CAST(CAST(o_orderdate AS DATE) AS VARCHAR), COUNT(*) FROM orders GROUP BY 2
  UNION ALL SELECT 'alert', CAST(event_id // 2 AS VARCHAR), COUNT(*) FROM events GROUP BY 2)
SELECT key_name, COUNT(*) FILTER (WHERE n > 1) AS n_duplicate_keys, CAST(COALESCE(SUM(n) FILTER (WHERE n > 1), 0) AS BIGINT) AS n_rows
FROM k GROUP BY 1""")(_keys)

# Clickstream and alert documents, with missing keys, broken JSON and unknown values among them
CLICK_DOC_SCHEMA = T_.StructType([
    T_.StructField("event_type", T_.StringType()), T_.StructField("session_id", T_.StringType()),
    T_.StructField("customer_id", T_.StringType()), T_.StructField("timestamp", T_.StringType()),
    T_.StructField("device", T_.StructType([T_.StructField("type", T_.StringType())]))])
ALERT_DOC_SCHEMA = T_.StructType([
    T_.StructField("transaction_id", T_.StringType()), T_.StructField("customer_id", T_.StringType()),
    T_.StructField("score", T_.DoubleType()), T_.StructField("decision", T_.StringType()), T_.StructField("created_at", T_.StringType())])


def _v13(s, d):
    i, c = F.col("event_id"), D.clickstream(T(s, d))
    kind = F.when(i % 13 == 0, F.lit("add_to_cart")).when(i % 17 == 0, F.lit("payment_method_select")).otherwise(F.col("event_type"))
    doc = F.to_json(F.struct(kind.alias("event_type"), F.when(i % 7 != 0, F.col("session_id")).alias("session_id"), "customer_id",
                             F.col("timestamp").cast("string").alias("timestamp"), "device"))
    docs = c.select("event_id", F.when(i % 11 == 0, F.lit("{broken")).otherwise(doc).alias("doc"))
    v = Q.validate_clickstream(docs, "doc", CLICK_DOC_SCHEMA)
    return v.select("event_id", "valid", F.array_join("errors", "; ").alias("errors"))


register("v13_validate_document", """
SELECT event_id, event_id % 11 <> 0 AND event_id % 13 <> 0 AND event_id % 7 <> 0 AND (event_id % 17 = 0 OR event_type IN ('view', 'click', 'purchase', 'error', 'signup')) AS valid,
       CASE WHEN event_id % 11 = 0 THEN 'missing required key: event_type; missing required key: session_id; missing required key: timestamp'
            ELSE concat_ws('; ',
              CASE WHEN event_id % 13 <> 0 AND event_id % 17 <> 0 AND event_type NOT IN ('view', 'click', 'purchase', 'error', 'signup') THEN 'missing required key: event_type' END,
              CASE WHEN event_id % 7 = 0 THEN 'missing required key: session_id' END,
              CASE WHEN event_id % 13 = 0 THEN 'event_type not accepted' END) END AS errors
FROM events""")(_v13)


def _v13_alerts(s, d):
    i = F.col("event_id")
    doc = F.to_json(F.struct(F.when(i % 6 != 0, F.concat(F.lit("tx_"), i.cast("string"))).alias("transaction_id"),
                             ((F.pmod(i, F.lit(140)) - 20) / 100).alias("score"),
                             F.element_at(F.array(F.lit("approve"), F.lit("review"), F.lit("block"), F.lit("hold")), (i % 4 + 1).cast("int")).alias("decision"),
                             F.when(i % 9 != 0, F.col("ts").cast("string")).alias("created_at")))
    docs = T(s, d).events.select("event_id", F.when(i % 10 == 0, F.lit("[1, 2")).otherwise(doc).alias("doc"))
    return Q.validate_alerts(docs, "doc", ALERT_DOC_SCHEMA).select("event_id", "valid", F.array_join("errors", "; ").alias("errors"))


register("v13_validate_alerts", """
SELECT event_id, errors = '' AS valid, errors FROM (
  SELECT event_id, CASE WHEN event_id % 10 = 0 THEN 'missing required key: transaction_id; missing required key: score; missing required key: created_at'
    ELSE concat_ws('; ', CASE WHEN event_id % 6 = 0 THEN 'missing required key: transaction_id' END,
                         CASE WHEN event_id % 9 = 0 THEN 'missing required key: created_at' END,
                         CASE WHEN event_id % 140 < 20 OR event_id % 140 > 120 THEN 'score out of range' END,
                         CASE WHEN event_id % 4 = 3 THEN 'decision not accepted' END) END AS errors FROM events)""")(_v13_alerts)

# S13 write + S01 pruned read -------------------------------------------
def _lake(s, d):
    path = os.path.join(run_dir(s, "lake"), "transactions")
    fact = D.fact_transaction(T(s, d)).select("transaction_sk", "customer_sk", "amount_usd", "transaction_date")
    SK.write_lake(fact, path, "transaction_date")
    return path


def _per_month(df):
    return df.groupBy("year", "month").agg(F.count(F.lit(1)).alias("n_rows"),
                                           F.sum("amount_usd").cast("decimal(38,2)").alias("amount_usd"))


_LAKE_SQL = """
SELECT year(transaction_date) AS year, month(transaction_date) AS month, COUNT(*) AS n_rows,
       CAST(SUM(amount_usd) AS DECIMAL(38,2)) AS amount_usd
FROM fact_transaction {where} GROUP BY 1, 2"""

register("s13_write_lake", D.with_ctes(["fact_transaction"], _LAKE_SQL.format(where="")))(
    lambda s, d: _per_month(RD.read_raw(s, _lake(s, d))))

register("s01_read_raw", D.with_ctes(["fact_transaction"], _LAKE_SQL.format(
    where="WHERE transaction_date BETWEEN DATE '2001-01-01' AND DATE '2001-06-30'")))(
    lambda s, d: _per_month(RD.read_raw(s, _lake(s, d), since="2001-01-01", until="2001-06-30")))


# The labelled 22-column file, written from the landing rows and read with its schema
def _s02(s, d):
    path = os.path.join(run_dir(s, "csv"), "payments")
    t = T(s, d)
    x = D.payments_landing(t).withColumns({
        "first": F.lit("First"), "last": F.concat(F.lit("O'Name, "), F.col("city")), "gender": F.lit("F"), "street": F.lit('1 "Main" St'),
        "zip": F.lit("01234"), "job": F.lit(None).cast("string"), "dob": F.lit("1980-01-31"),
        "is_fraud": F.when(F.col("trans_num").endswith("-7"), "1").otherwise("0")})
    x.select(*RD.PAYMENT_CSV_COLUMNS).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)
    return RD.read_payments_csv(s, path)


register("s02_payments_csv", LANDING + """SELECT *, 'First' AS "first", 'O''Name, ' || city AS "last", 'F' AS gender, '1 "Main" St' AS street,
  '01234' AS zip, CAST(NULL AS VARCHAR) AS job, '1980-01-31' AS dob, CASE WHEN trans_num LIKE '%-7' THEN '1' ELSE '0' END AS is_fraud
FROM payments_landing""")(_s02)


# JSON envelopes ------------------------------------------------------
def _s03(s, d):
    li = T(s, d).lineitem
    return RD.explode_envelope(RD.envelopes_from(li), "payload")


register("s03_explode_envelope", """
SELECT l_orderkey AS order_key, l_linenumber AS line, CAST(l_extendedprice AS DECIMAL(18,2)) AS amount
FROM lineitem WHERE l_orderkey % 4 <> 3""")(_s03)


# Nested documents ---------------------------------------------------
def _s05(s, d):
    path = os.path.join(run_dir(s, "docs"), "clickstream")
    c = D.clickstream(T(s, d))
    c.select("event_id", "event_type", "session_id", "customer_id", F.col("timestamp").cast("string").alias("timestamp"),
             "device").write.mode("overwrite").json(path)
    docs = RD.read_documents(s, path, RD.CLICKSTREAM_SCHEMA)
    return docs.groupBy(F.coalesce(F.col("device.type"), F.lit("unknown")).alias("device_type"), "event_type") \
               .agg(F.count(F.lit(1)).alias("n_events"))


register("s05_read_documents", D.with_ctes(["clickstream"], """
SELECT COALESCE(device_type, 'unknown') AS device_type, event_type, COUNT(*) AS n_events FROM clickstream GROUP BY ALL"""))(_s05)


# All declared fields of the three collections
def _s05_clickstream(s, d):
    path = os.path.join(run_dir(s, "docs"), "clickstream-all")
    e = T(s, d).events
    page = F.concat(F.lit("/p/"), (F.col("event_id") % 7).cast("string"))
    merchant = F.when(F.col("event_id") % 3 != 0, F.concat(F.lit("m"), (F.col("event_id") % 11).cast("string")))
    geo = F.struct(F.concat(F.lit("c"), (F.col("user_id") % 5).cast("string")).alias("country"), F.lit("x").alias("city"),
                   F.sha2(F.col("user_id").cast("string"), 256).alias("ip_hash"))
    D.clickstream(T(s, d)).join(e.select("event_id", page.alias("page_url"), merchant.alias("merchant_id"), geo.alias("geo")), "event_id") \
        .withColumn("timestamp", F.col("timestamp").cast("string")).write.mode("overwrite").json(path)
    docs = RD.read_documents(s, path, RD.CLICKSTREAM_SCHEMA)
    return docs.select("event_id", "merchant_id", "page_url", F.col("geo.country").alias("country"), F.col("geo.ip_hash").alias("ip_hash"),
                       F.col("device.type").alias("device_type"))


register("s05_read_clickstream_fields", D.with_ctes(["clickstream"], """
SELECT c.event_id, CASE WHEN c.event_id % 3 <> 0 THEN 'm' || CAST(c.event_id % 11 AS VARCHAR) END AS merchant_id,
       '/p/' || CAST(c.event_id % 7 AS VARCHAR) AS page_url, 'c' || CAST(e.user_id % 5 AS VARCHAR) AS country,
       sha256(CAST(e.user_id AS VARCHAR)) AS ip_hash, c.device_type
FROM clickstream c JOIN events e ON c.event_id = e.event_id"""))(_s05_clickstream)


def _s05_alerts(s, d):
    path = os.path.join(run_dir(s, "docs"), "alerts")
    a = D.fraud_alerts(T(s, d))
    reasons = F.when(F.col("score") >= 0.1, F.array(F.lit("high_amount"), F.col("decision"))).otherwise(F.array().cast("array<string>"))
    a.withColumns({"model_version": F.lit("rule-based"), "features_snapshot": F.create_map(F.lit("score"), F.col("score").cast("double")),
                   "reasons": reasons, "created_at": F.col("created_at").cast("string")}).write.mode("overwrite").json(path)
    docs = RD.read_documents(s, path, RD.ALERT_SCHEMA)
    return docs.select("transaction_id", "customer_id", "merchant_id", "score", "decision", "model_version",
                       F.col("features_snapshot")["score"].alias("snapshot"), F.array_join("reasons", ",").alias("reasons"))


register("s05_read_alerts", D.with_ctes(["fraud_alerts"], """
SELECT transaction_id, customer_id, merchant_id, CAST(score AS DOUBLE) AS score, decision, 'rule-based' AS model_version,
       CAST(score AS DOUBLE) AS snapshot, CASE WHEN score >= 0.1 THEN 'high_amount,' || decision ELSE '' END AS reasons FROM fraud_alerts"""))(_s05_alerts)


# Change feed -> current state ----------------------------------------
def _changes(t):
    """Order changes: status updates at ship time, deletions of returned orders."""
    li = t.lineitem.select("l_orderkey", "l_linestatus", "l_returnflag", "l_shipdate")
    upd = li.select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_linestatus").alias("o_orderstatus"),
                    F.col("l_shipdate").alias("changed_at"),
                    F.when(F.col("l_returnflag") == "R", "d").otherwise("u").alias("op"))
    return upd


def _s07(s, d):
    t = T(s, d)
    base = t.orders.select("o_orderkey", "o_orderstatus")
    return C.apply_changes(base, _changes(t), "o_orderkey", "changed_at")


register("s07_apply_changes", """
WITH ch AS (SELECT l_orderkey AS o_orderkey, l_linestatus AS o_orderstatus, l_shipdate AS changed_at,
                   CASE WHEN l_returnflag = 'R' THEN 'd' ELSE 'u' END AS op FROM lineitem),
allr AS (SELECT o_orderkey, o_orderstatus, NULL::TIMESTAMP AS changed_at, 'base' AS op FROM orders
         UNION ALL SELECT * FROM ch),
ranked AS (SELECT *, row_number() OVER (PARTITION BY o_orderkey
                                         ORDER BY changed_at DESC NULLS LAST, o_orderstatus DESC, op DESC) AS rn FROM allr)
SELECT o_orderkey, o_orderstatus FROM ranked WHERE rn = 1 AND op <> 'd'""")(_s07)

# Incremental load ----------------------------------------------------
register("s08_incremental", D.with_ctes(["fact_transaction"], f"""
SELECT transaction_sk, amount_usd, transaction_ts FROM fact_transaction
WHERE transaction_ts > (SELECT COALESCE(MAX(transaction_ts), TIMESTAMP '1900-01-01')
                        FROM fact_transaction WHERE transaction_ts < TIMESTAMP '{AS_TX}')"""))(
    lambda s, d: C.incremental(
        D.fact_transaction(T(s, d)).select("transaction_sk", "amount_usd", "transaction_ts"),
        D.fact_transaction(T(s, d)).filter(F.col("transaction_ts") < F.lit(AS_TX).cast("timestamp_ntz")),
        "transaction_ts"))


# Idempotent keyed insert ----------------------------------------------
def _s09(s, d):
    t = T(s, d)
    landing = D.payments_landing(t).select("trans_num", "amt", "category")
    stored = landing.filter(F.lit(False)).unionAll(  # rows already in the table
        T(s, d).lineitem.filter("l_linenumber <= 3").select(
            F.concat(F.lit("T"), F.col("l_orderkey").cast("string"), F.lit("-"), F.col("l_linenumber").cast("string")).alias("trans_num"),
            F.lit("1").alias("amt"), F.lit("x").alias("category")))
    return C.insert_ignore(stored, landing, "trans_num")


register("s09_insert_ignore", D.with_ctes(["payments_landing"], """
, b AS (SELECT trans_num, amt, category,
               row_number() OVER (PARTITION BY trans_num ORDER BY amt, category) AS rn FROM payments_landing)
SELECT trans_num, amt, category FROM b
WHERE rn = 1 AND trans_num NOT IN (SELECT 'T' || CAST(l_orderkey AS VARCHAR) || '-' || CAST(l_linenumber AS VARCHAR) FROM lineitem WHERE l_linenumber <= 3)"""))(_s09)


# Keyed upsert of feature documents -------------------------------------
def _s10(s, d):
    from paylake.operators.features import customer_features_reference
    from paylake.operators.ml import training_set
    t = T(s, d)
    fact, dc, dm = D.fact_transaction(t), D.dim_customer(t), D.dim_merchant(t)
    old = customer_features_reference(training_set(fact, dc, dm, "2001-03-31"))
    new = customer_features_reference(training_set(fact, dc, dm, AS_TX))
    return C.upsert(old.select("customer_id", "tx_count_7d"), new.select("customer_id", "tx_count_7d"),
                    "customer_id", version="v2001.06.30").select(
        "customer_id", "tx_count_7d", F.coalesce("model_version", F.lit("old")).alias("model_version"))


def _feat_sql(as_of: str) -> str:
    return f"""SELECT CAST(customer_sk AS VARCHAR) AS customer_id,
        CAST(trunc(LEAST(COUNT(transaction_id) * 7 / 90, 500.0)) AS INTEGER) AS tx_count_7d
      FROM fact_transaction WHERE {_window('transaction_ts', as_of, 90)} AND customer_sk IS NOT NULL
      GROUP BY customer_sk"""


register("s10_upsert", D.with_ctes(["fact_transaction"], f"""
, old AS ({_feat_sql('2001-03-31')}), new AS ({_feat_sql(AS_TX)})
SELECT customer_id, tx_count_7d, 'old' AS model_version FROM old WHERE customer_id NOT IN (SELECT customer_id FROM new)
UNION ALL SELECT customer_id, tx_count_7d, 'v2001.06.30' FROM new"""))(_s10)


# Dead letter -------------------------------------------------------------
register("s11_dead_letter", D.with_ctes(["payments_landing", "verdict"], """
SELECT trans_num, 'validation_error' AS error_type, error_message, 'api' AS source FROM verdict WHERE n_errors > 0"""))(
    lambda s, d: SK.to_dead_letter(Q.split_valid(Q.validate(D.payments_landing(T(s, d))))[1], created_at=AS_IN)
    .select(F.get_json_object("raw_data", "$.trans_num").alias("trans_num"), "error_type", "error_message", "source"))

# Run log -------------------------------------------------------------
register("s12_log_run", D.with_ctes(["payments_landing", "verdict"], f"""
SELECT 'stream_ingest' AS dag_id, 'validate' AS task_id, TIMESTAMP '{AS_IN} 00:00:00' AS execution_date,
       CASE WHEN SUM(CASE WHEN n_errors > 0 THEN 1 ELSE 0 END) > 0 THEN 'partial' ELSE 'success' END AS status,
       COUNT(*) AS records_processed,
       CAST(SUM(CASE WHEN n_errors > 0 THEN 1 ELSE 0 END) AS BIGINT) AS records_failed,
       CAST(1.5 AS DECIMAL(10,2)) AS duration_seconds, CAST(NULL AS VARCHAR) AS error_message
FROM verdict"""))(
    lambda s, d: SK.log_run(D.payments_landing(T(s, d)),
                            Q.split_valid(Q.validate(D.payments_landing(T(s, d))))[1],
                            "stream_ingest", "validate", f"{AS_IN} 00:00:00", 1.5)
    .withColumn("execution_date", F.col("execution_date").cast("timestamp_ntz")))


# Ratio-controlled replay -------------------------------------------------
def _s14(s, d):
    from paylake.sources.replay import replay_sample
    t = T(s, d)
    labelled = D.payments_landing(t).withColumn(
        "is_fraud", F.when(F.col("trans_num").endswith("-7") | F.col("trans_num").endswith("-6"), 1).otherwise(0))
    return replay_sample(labelled, "is_fraud", "trans_num", n=200, ratio=0.3, seed=42,
                         as_of=f"{AS_IN} 12:00:00").select("trans_num", "original_id", "is_fraud_src")


register("s14_replay_sample", D.with_ctes(["payments_landing"], f"""
, lab AS (SELECT trans_num, CASE WHEN trans_num LIKE '%-7' OR trans_num LIKE '%-6' THEN 1 ELSE 0 END AS is_fraud
          FROM payments_landing),
ranked AS (SELECT *, row_number() OVER (PARTITION BY is_fraud ORDER BY md5(trans_num || '|42'), trans_num) AS r FROM lab),
picked AS (SELECT * FROM ranked WHERE (is_fraud = 1 AND r <= 60) OR (is_fraud = 0 AND r <= 140)),
numbered AS (SELECT *, row_number() OVER (ORDER BY is_fraud DESC, r) - 1 AS i FROM picked)
SELECT 'REPLAY-' || CAST(epoch_ms(TIMESTAMP '{AS_IN} 12:00:00') AS VARCHAR) || '-' || CAST(i AS VARCHAR) || '-' || substr(trans_num, 1, 16) AS trans_num,
       trans_num AS original_id, is_fraud AS is_fraud_src
FROM numbered"""))(_s14)
