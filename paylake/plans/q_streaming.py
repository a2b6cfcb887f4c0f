"""Registered streaming queries.

Each builder runs a Structured Streaming query to completion
(``availableNow``) over a driver table read as a file stream, writes its
output through ``foreachBatch`` into the shared checkpoint folder, and
returns that output as a batch DataFrame.
"""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from paylake.operators.features import as_feature_document, customer_features_reference
from paylake.plans import domain as D
from paylake.plans.q_models import IP_COUNTRIES, XDEPS, _extract
from paylake.plans import q_quality  # noqa: F401  (its SQL parts are used here)
from paylake.plans.base import AS_TX, T, register
from paylake.streaming import ingest as I
from paylake.streaming import maintain as K
from paylake.streaming import monitors as M


def _ingest(s, d):
    landing = D.payments_landing_from(I.table_stream(s, d, "lineitem"))
    out = I.run_dir(s, "ingest")
    I.run_ingest(landing, out).awaitTermination()
    return out


LANDING_ORDER = "trans_date_trans_time, cc_num, merchant, category, amt, lat, long, merch_lat, merch_long, city_pop, unix_time, city, state"

# T01 -------------------------------------------------------------------------
register("t01_stream_ingest", D.with_ctes(["payments_landing", "verdict"], f"""
, v AS (SELECT *, row_number() OVER (PARTITION BY trans_num ORDER BY {LANDING_ORDER}) AS rn FROM verdict WHERE n_errors = 0)
SELECT trans_num, amt,
       CAST(ROUND(LEAST(TRY_CAST(amt AS DECIMAL(12,2)) * 0.0001, 1), 4) AS DECIMAL(5,4)) AS fraud_probability,
       COALESCE(LEAST(TRY_CAST(amt AS DECIMAL(12,2)) * 0.0001, 1) >= 0.5, false) AS is_fraud_predicted,
       'amount-rule' AS model_version
FROM v WHERE rn = 1"""))(
    lambda s, d: I.read_store(s, os.path.join(_ingest(s, d), "transactions"))
    .select("trans_num", "amt", "fraud_probability", "is_fraud_predicted", "model_version"))

# T01 with the trained model as scorer: loaded from where it was saved
def _t01_model(s, d):
    from paylake.plans.q_models import payment_model
    model, version = payment_model(s, d)
    out = I.run_dir(s, "ingest-model")
    I.run_ingest(D.payments_landing_from(I.table_stream(s, d, "lineitem")), out, I.model_scorer(model, version)).awaitTermination()
    return I.read_store(s, os.path.join(out, "transactions")).select("trans_num", "fraud_probability", "is_fraud_predicted", "model_version")


register("t01_stream_ingest_model")(_t01_model)

# T03 -------------------------------------------------------------------------
register("t03_dead_letter_branch", D.with_ctes(["payments_landing", "verdict"], """
SELECT trans_num, error_message FROM verdict WHERE n_errors > 0"""))(
    lambda s, d: s.read.parquet(os.path.join(_ingest(s, d), "dead_letter"))
    .select(F.get_json_object("raw_data", "$.trans_num").alias("trans_num"), "error_message"))

# T02 -------------------------------------------------------------------------
register("t02_dedup_stream", D.with_ctes(["scored_transactions"], "SELECT DISTINCT trans_num FROM scored_transactions"))(
    lambda s, d: I.collect_stream(
        I.dedup_stream(D.scored_transactions_from(I.table_stream(s, d, "lineitem")), "trans_num", "ingested_at")
        .select("trans_num"), "dedup", s))

# T04 -------------------------------------------------------------------------
register("t04_fraud_alerts", D.with_ctes(["scored_transactions"], """
SELECT trans_num, '***' || right(cc_num, 4) AS card, merchant, category, CAST(amt AS VARCHAR) AS amt, fraud_probability
FROM scored_transactions WHERE is_fraud_predicted"""))(
    lambda s, d: I.collect_stream(I.fraud_alerts(D.scored_transactions_from(I.table_stream(s, d, "lineitem"))), "alerts", s))


# T05 -------------------------------------------------------------------------
def _t05(s, d):
    t = T(s, d)
    docs = I.stored_once(as_feature_document(customer_features_reference(_extract(t)), f"{AS_TX} 00:00:00", "v1"),
                         os.path.join(I.run_dir(s, "features"), "customer"))
    li = I.table_stream(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice")
    o = t.orders.select("o_orderkey", "o_custkey")
    sk = F.col("l_orderkey") * 10 + F.col("l_linenumber")
    tx = li.join(o, li.l_orderkey == o.o_orderkey).select(
        F.concat(F.lit("tx_"), sk.cast("string")).alias("transaction_id"),
        F.col("o_custkey").cast("string").alias("customer_id"),
        F.col("l_extendedprice").cast("decimal(18,2)").alias("amount_usd"),
        F.element_at(F.array(*[F.lit(c) for c in IP_COUNTRIES]), (F.pmod(sk, F.lit(10)) + 1).cast("int")).alias("ip_country"))
    scored = I.score_stream(tx, docs).select("transaction_id", "score", F.array_join("reasons", ",").alias("reasons"),
                                             "decision")
    return I.collect_stream(scored, "score", s)


def _t05_sql():
    from paylake.plans.q_models import _conds, _score
    from paylake.operators.scoring import RULES
    return D.with_ctes(XDEPS + ["x01", "recorded_transactions"], f"""
, sc AS (SELECT f.transaction_id, CAST(LEAST(GREATEST({_score}, 0), 1) AS DECIMAL(5,4)) AS score,
                concat_ws(',', {', '.join(f"CASE WHEN {c} THEN '{n}' END" for c, (n, _, _) in zip(_conds, RULES))}) AS reasons
         FROM recorded_transactions f LEFT JOIN x01 x ON CAST(f.customer_sk AS VARCHAR) = x.customer_id)
SELECT transaction_id, score, reasons,
       CASE WHEN score < 0.3 THEN 'approve' WHEN score < 0.7 THEN 'review' ELSE 'block' END AS decision FROM sc""")


register("t05_score_stream", _t05_sql())(_t05)


# T06 -------------------------------------------------------------------------
def _alert_stream(s, d):
    e = I.table_stream(s, d, "events")
    return e.select(F.col("ts").alias("created_at"), _decision(),
                    (F.col("value") / 100).alias("latency_s"), "user_id")


register("t06_request_rate", """
SELECT time_bucket(INTERVAL '5 minutes', ts) AS window_start,
       CASE WHEN CAST(value / 500 AS DECIMAL(5,4)) < 0.3 THEN 'approve'
            WHEN CAST(value / 500 AS DECIMAL(5,4)) < 0.7 THEN 'review' ELSE 'block' END AS decision,
       COUNT(*) AS n, COUNT(*) / 300.0 AS rate_per_s
FROM events GROUP BY ALL""")(
    lambda s, d: I.collect_stream(M.request_rate(_alert_stream(s, d), "created_at", "decision"), "rate", s, "update",
                                  ["window_start", "decision"]))


register("t06_request_rate_overall", """
SELECT time_bucket(INTERVAL '5 minutes', ts) AS window_start, COUNT(*) AS n, COUNT(*) / 300.0 AS rate_per_s FROM events GROUP BY ALL""")(
    lambda s, d: I.collect_stream(M.request_rate(_alert_stream(s, d), "created_at"), "rate-all", s, "update", ["window_start"]))
register("t06_request_rate_sliding", """
SELECT time_bucket(INTERVAL '1 minute', ts) - k * INTERVAL 1 MINUTE AS window_start, COUNT(*) AS n, COUNT(*) / 300.0 AS rate_per_s
FROM events, range(5) r(k) GROUP BY ALL""")(
    lambda s, d: I.collect_stream(M.request_rate(_alert_stream(s, d), "created_at", slide="1 minute"), "rate-slide", s, "update", ["window_start"]))

# T07 -------------------------------------------------------------------------
def _t07(s, d):
    counts = I.collect_stream(M.bucket_counts(_alert_stream(s, d), "created_at", "latency_s"), "latency", s, "update",
                              ["window_start", "bucket"])
    return M.bucket_quantiles(counts)


_B = M.LATENCY_BUCKETS
_bucket_sql = "CASE " + " ".join(f"WHEN value / 100 <= {b} THEN {i}" for i, b in enumerate(_B)) + f" ELSE {len(_B)} END"
_upper = "CASE " + " ".join(f"WHEN bucket = {i} THEN {b}" for i, b in enumerate(_B)) + " END"
_lower = "CASE WHEN bucket = 0 THEN 0.0 " + " ".join(f"WHEN bucket = {i + 1} THEN {b}" for i, b in enumerate(_B)) + " END"
register("t07_latency_quantiles", f"""
WITH c AS (SELECT time_bucket(INTERVAL '5 minutes', ts) AS window_start, {_bucket_sql} AS bucket, COUNT(*) AS n
           FROM events GROUP BY ALL),
w AS (SELECT *, SUM(n) OVER (PARTITION BY window_start ORDER BY bucket ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum,
             SUM(n) OVER (PARTITION BY window_start) AS total, {_lower} AS lower, {_upper} AS upper FROM c),
x AS (SELECT *, cum - n AS before FROM w)
SELECT window_start,
{', '.join(f'''       ROUND(MAX(CASE WHEN before < total * {q} AND cum >= total * {q}
                      THEN CASE WHEN upper IS NULL THEN lower ELSE lower + (upper - lower) * (total * {q} - before) / n END END), 6) AS p{int(round(q * 100))}''' for q in (0.5, 0.95, 0.99))}
FROM x GROUP BY window_start""")(_t07)

# T08 -------------------------------------------------------------------------
register("t08_sessionize", """
WITH e AS (SELECT user_id, ts, CASE WHEN lag(ts) OVER (PARTITION BY user_id ORDER BY ts) IS NULL
                                      OR ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 30 MINUTE
                                    THEN 1 ELSE 0 END AS new_s FROM events),
g AS (SELECT *, SUM(new_s) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS sid FROM e)
SELECT user_id, MIN(ts) AS session_start, MAX(ts) + INTERVAL 30 MINUTE AS session_end, COUNT(*) AS n_events
FROM g GROUP BY user_id, sid""")(
    # session windows stream in append mode only (a session is final once the
    # watermark passes its end); the registered check runs the same plan on
    # the whole table so every session, including still-open ones, is compared
    lambda s, d: M.sessionize(T(s, d).events, "user_id", "ts"))

# T09 -------------------------------------------------------------------------
register("t09_sliding_counters", """
SELECT user_id, time_bucket(INTERVAL '15 minutes', ts) - k * INTERVAL 15 MINUTE AS window_start, COUNT(*) AS n
FROM events, range(4) r(k) GROUP BY ALL""")(
    lambda s, d: I.collect_stream(M.sliding_counters(I.table_stream(s, d, "events"), "user_id", "ts"), "sliding", s, "update",
                                  ["user_id", "window_start"]))

# The counter of each user's latest window goes into the feature document
def _t09_upsert(s, d):
    counters = I.collect_stream(M.sliding_counters(I.table_stream(s, d, "events"), "user_id", "ts"), "sliding-docs", s, "update",
                                ["user_id", "window_start"])
    docs = T(s, d).customer.select(F.col("c_custkey").cast("long").alias("user_id"), F.lit(-1).cast("long").alias("tx_count_1h"))
    return M.update_features(docs, counters, "user_id", "tx_count_1h")


register("t09_feature_upsert", """
WITH w AS (SELECT user_id, time_bucket(INTERVAL '15 minutes', ts) AS window_start, COUNT(*) AS n FROM events GROUP BY ALL),
last AS (SELECT user_id, n FROM w QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY window_start DESC) = 1)
SELECT user_id, n AS tx_count_1h FROM last
UNION ALL SELECT c_custkey, -1 FROM customer WHERE c_custkey NOT IN (SELECT user_id FROM last)""")(_t09_upsert)

# Event stream source (file stream; a Kafka topic is the drop-in) ---------
register("s06_events_stream", """
SELECT event_type, COUNT(*) AS n, ROUND(SUM(value), 4) AS value FROM events GROUP BY 1""")(
    lambda s, d: I.collect_stream(I.table_stream(s, d, "events").groupBy("event_type").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("value")), "events", s, "complete"))


# --- several micro-batches, late rows to the dead letters ---------------------------------------
# Events arrive in six batches by day; every 50th comes two batches late, some of the last minutes one late.
N_BATCHES = 6
_SLICE = "least(5, (day(ts) - 1) div 5)"
ARRIVAL = (f"CASE WHEN event_id % 50 = 7 THEN least(5, {_SLICE} + 2) "
           f"WHEN event_id % 3 = 0 AND day(ts) % 5 = 0 AND hour(ts) = 23 AND minute(ts) >= 52 THEN least(5, {_SLICE} + 1) ELSE {_SLICE} END")
LATE_SQL = f"""WITH arrived AS (SELECT *, {ARRIVAL.replace(" div ", " // ")} AS batch FROM events),
marks AS (SELECT b.batch, MAX(a.ts) AS mark FROM (SELECT DISTINCT batch FROM arrived) b JOIN arrived a ON a.batch < b.batch GROUP BY 1),
judged AS (SELECT a.*, COALESCE(ts < mark - INTERVAL 10 MINUTE, false) AS late FROM arrived a LEFT JOIN marks USING (batch)),
kept AS (SELECT * FROM judged WHERE NOT late)
"""


def in_batches(s, name, rows, batch, n, start):
    """Let ``rows`` arrive as ``n`` batches (column ``batch``): each is written to the source's folder,
    then the stream that ``start(stream, out)`` starts takes what is new. Returns the output folder."""
    out = I.run_dir(s, name)
    source = os.path.join(out, "source")
    for k in range(n):
        rows.filter(F.col(batch) == k).drop(batch).write.mode("append").parquet(source)
        stream = I.read_events_stream(s, source, rows.drop(batch).schema)
        start(stream, out).awaitTermination()
    return out


def _arriving(s, d):
    return T(s, d).events.withColumn("batch", F.expr(ARRIVAL))


def _monitored(s, d, name, columns, start):
    return in_batches(s, name, _arriving(s, d).select("event_id", "ts", "user_id", "batch", *columns), "batch", N_BATCHES, start)


def _decision():
    score = (F.col("value") / 500).cast("decimal(5,4)")
    return F.when(score < 0.3, "approve").when(score < 0.7, "review").otherwise("block").alias("decision")


def _t06_batches(s, d):
    keys = ["window_start", "decision"]
    out = _monitored(s, d, "rate-batches", [_decision()], lambda st, out: K.run_counts(st, out, "ts", keys, K.rate_counts("ts", "decision")))
    return K.rates(K.counts(s, out, keys).read())


register("t06_rate_batches", LATE_SQL + """
SELECT time_bucket(INTERVAL '5 minutes', ts) AS window_start,
       CASE WHEN CAST(value / 500 AS DECIMAL(5,4)) < 0.3 THEN 'approve'
            WHEN CAST(value / 500 AS DECIMAL(5,4)) < 0.7 THEN 'review' ELSE 'block' END AS decision,
       COUNT(*) AS n, COUNT(*) / 300.0 AS rate_per_s FROM kept GROUP BY ALL""")(_t06_batches)


def _t06_accounted(s, d):
    """Every event is either counted or among the dead letters."""
    keys = ["window_start"]
    out = _monitored(s, d, "rate-dead", [], lambda st, out: K.run_counts(st, out, "ts", keys, K.rate_counts("ts")))
    dead = K.dead_letters(s, out).select(
        F.get_json_object("raw_data", "$.event_id").cast("long").alias("event_id"), "error_type", F.col("batch_id").cast("long").alias("batch"))
    stored = K.counts(s, out, keys).read().agg(F.sum("n").alias("n_stored")).withColumn("error_type", F.lit("late_event"))
    return dead.join(stored, "error_type")


register("t06_late_rows", LATE_SQL + """
SELECT event_id, 'late_event' AS error_type, batch, (SELECT COUNT(*) FROM kept) AS n_stored FROM judged WHERE late""")(_t06_accounted)


def _t07_batches(s, d):
    keys = ["window_start", "bucket"]
    out = _monitored(s, d, "latency-batches", [(F.col("value") / 100).alias("latency_s")],
                     lambda st, out: K.run_counts(st, out, "ts", keys, K.latency_counts("ts", "latency_s")))
    return M.bucket_quantiles(K.counts(s, out, keys).read())


register("t07_latency_batches", LATE_SQL + f""", c AS (SELECT time_bucket(INTERVAL '5 minutes', ts) AS window_start, {_bucket_sql} AS bucket, COUNT(*) AS n
           FROM kept GROUP BY ALL),
w AS (SELECT *, SUM(n) OVER (PARTITION BY window_start ORDER BY bucket ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum,
             SUM(n) OVER (PARTITION BY window_start) AS total, {_lower} AS lower, {_upper} AS upper FROM c),
x AS (SELECT *, cum - n AS before FROM w)
SELECT window_start,
{', '.join(f'''       ROUND(MAX(CASE WHEN before < total * {q} AND cum >= total * {q}
                      THEN CASE WHEN upper IS NULL THEN lower ELSE lower + (upper - lower) * (total * {q} - before) / n END END), 6) AS p{int(round(q * 100))}''' for q in (0.5, 0.95, 0.99))}
FROM x GROUP BY window_start""")(_t07_batches)


def _t09_batches(s, d):
    """The counters of rows in time, and the feature documents of all customers with the latest of each."""
    keys = ["user_id", "window_start"]
    out = _monitored(s, d, "counter-batches", [], lambda st, out: K.run_counts(st, out, "ts", keys, K.key_counts("user_id", "ts")))
    docs = T(s, d).customer.select(F.col("c_custkey").cast("long").alias("user_id"), F.lit(-1).cast("long").alias("tx_count_1h"))
    return M.update_features(docs, K.counts(s, out, keys).read(), "user_id", "tx_count_1h")


register("t09_feature_batches", LATE_SQL + """,
w AS (SELECT user_id, time_bucket(INTERVAL '15 minutes', ts) AS window_start, COUNT(*) AS n FROM kept GROUP BY ALL),
last AS (SELECT user_id, n FROM w QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY window_start DESC) = 1)
SELECT user_id, n AS tx_count_1h FROM last
UNION ALL SELECT c_custkey, -1 FROM customer WHERE c_custkey NOT IN (SELECT user_id FROM last)""")(_t09_batches)


# T08 as a stream
def _t08_stream(s, d):
    out = _monitored(s, d, "session-batches", [], lambda st, out: K.run_sessions(st, out, "user_id", "ts"))
    return K.sessions(s, out, "user_id", flush=True)


register("t08_session_stream", LATE_SQL + """, e AS (SELECT user_id, ts, CASE WHEN lag(ts) OVER (PARTITION BY user_id ORDER BY ts) IS NULL
                                      OR ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 30 MINUTE
                                    THEN 1 ELSE 0 END AS new_s FROM kept),
g AS (SELECT *, SUM(new_s) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS sid FROM e)
SELECT user_id, MIN(ts) AS session_start, MAX(ts) + INTERVAL 30 MINUTE AS session_end, COUNT(*) AS n_events
FROM g GROUP BY user_id, sid""")(_t08_stream)


# T02 over batches: copies of a transaction arrive in different batches, some rows late
_TX_BATCH = "l_partkey % 4"
_TX_SQL = f"""WITH a AS (SELECT l_orderkey * 10 + l_linenumber AS tx, {_TX_BATCH} AS batch,
  TIMESTAMP '2024-01-01' + to_minutes(CAST(30 * ({_TX_BATCH}) - CASE WHEN l_suppkey % 5 = 0 THEN 45 ELSE l_suppkey % 7 END AS BIGINT)) AS ts,
  CAST(l_extendedprice AS DECIMAL(18,2)) AS amount FROM lineitem),
marks AS (SELECT b.batch, MAX(a.ts) AS mark FROM (SELECT DISTINCT batch FROM a) b JOIN a ON a.batch < b.batch GROUP BY 1),
j AS (SELECT a.*, COALESCE(ts < mark - INTERVAL 10 MINUTE, false) AS late FROM a LEFT JOIN marks USING (batch))
"""


def _arriving_tx(s, d):
    batch = F.expr(_TX_BATCH)
    minutes = (F.lit(30) * batch - F.when(F.col("l_suppkey") % 5 == 0, 45).otherwise(F.col("l_suppkey") % 7)).cast("int")
    return T(s, d).lineitem.select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("tx"), batch.alias("batch"),
        F.timestamp_add("MINUTE", minutes, F.lit("2024-01-01").cast("timestamp")).alias("ts"),
        F.col("l_extendedprice").cast("decimal(18,2)").alias("amount"))


def _t02_batches(s, d):
    out = in_batches(s, "dedup-batches", _arriving_tx(s, d), "batch", 4, lambda st, out: K.run_dedup(st, out, "tx", "ts"))
    stored = I.read_store(s, os.path.join(out, "rows")).select("tx", "amount", F.lit("stored").alias("state"))
    dead = K.dead_letters(s, out).select(F.get_json_object("raw_data", "$.tx").cast("long").alias("tx"),
                                         F.get_json_object("raw_data", "$.amount").cast("decimal(18,2)").alias("amount"), F.lit("late").alias("state"))
    return stored.unionAll(dead)


register("t02_dedup_batches", _TX_SQL + """SELECT tx, amount, 'late' AS state FROM j WHERE late
UNION ALL SELECT tx, amount, 'stored' FROM (
  SELECT * FROM j WHERE NOT late QUALIFY row_number() OVER (PARTITION BY tx ORDER BY batch, ts, amount) = 1)""")(_t02_batches)


# T05's alert sink over batches: the first score of a transaction stays
def _t05_alerts(s, d):
    t = T(s, d)
    docs = as_feature_document(customer_features_reference(_extract(t)), f"{AS_TX} 00:00:00", "v1")
    features = I.stored_once(docs, os.path.join(I.run_dir(s, "alert-features"), "customer"))
    li = t.lineitem.select("l_orderkey", "l_linenumber", "l_extendedprice", "l_suppkey")
    o = t.orders.select("o_orderkey", "o_custkey")
    sk = F.col("l_orderkey") * 10 + F.col("l_linenumber")
    requests = li.join(o, li.l_orderkey == o.o_orderkey).select(
        F.concat(F.lit("tx_"), sk.cast("string")).alias("transaction_id"), F.col("o_custkey").cast("string").alias("customer_id"),
        F.col("l_suppkey").cast("string").alias("merchant_id"), F.col("l_extendedprice").cast("decimal(18,2)").alias("amount_usd"),
        F.element_at(F.array(*[F.lit(c) for c in IP_COUNTRIES]), (F.pmod(sk, F.lit(10)) + 1).cast("int")).alias("ip_country"),
        F.pmod("l_suppkey", F.lit(3)).alias("batch"))
    out = in_batches(s, "alert-store", requests, "batch", 3, lambda st, out: I.run_scoring(st, features, out))
    return I.read_store(s, os.path.join(out, "fraud_alerts")).select("transaction_id", "customer_id", "merchant_id", "score", "decision",
                                                                     F.array_join("reasons", ",").alias("reasons"))


def _t05_alerts_sql():
    from paylake.plans.q_models import _conds, _score
    from paylake.operators.scoring import RULES
    return D.with_ctes(XDEPS + ["x01", "recorded_transactions"], f"""
, sc AS (SELECT f.transaction_id, CAST(f.customer_sk AS VARCHAR) AS customer_id, CAST(f.merchant_sk AS VARCHAR) AS merchant_id, f.merchant_sk % 3 AS batch,
                CAST(LEAST(GREATEST({_score}, 0), 1) AS DECIMAL(5,4)) AS score,
                concat_ws(',', {', '.join(f"CASE WHEN {c} THEN '{n}' END" for c, (n, _, _) in zip(_conds, RULES))}) AS reasons
         FROM recorded_transactions f LEFT JOIN x01 x ON CAST(f.customer_sk AS VARCHAR) = x.customer_id)
SELECT transaction_id, customer_id, merchant_id, score, CASE WHEN score < 0.3 THEN 'approve' WHEN score < 0.7 THEN 'review' ELSE 'block' END AS decision, reasons
FROM sc QUALIFY row_number() OVER (PARTITION BY transaction_id ORDER BY batch, customer_id, merchant_id, score) = 1""")


register("t05_alert_store", _t05_alerts_sql())(_t05_alerts)
