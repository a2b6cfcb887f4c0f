"""Named reports.

Each report is a function of DataFrames and parameters. Window filters are
applied on the raw scan column before any join so they reach the Parquet
scan; dimensions go through ``join_dim`` (size-checked broadcast).
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paylake.functions.aggregates import has_any, pct, sum_if
from paylake.functions.predicates import lookback, on_day, window_bounds
from paylake.functions.scalar import mask_card, month_offset, round_avg
from paylake.operators.joins import join_dim

PRIVILEGED_ACTIONS = ["DELETE", "UPDATE", "EXPORT", "LOGIN_ADMIN", "GRANT", "REVOKE"]
SENSITIVE_RESOURCES = ["core.customers", "core.payment_methods", "core.transactions"]


# Q01 ------------------------------------------------------------------
def revenue_by_region(fact: DataFrame, dim_merchant: DataFrame, as_of, days: int = 30) -> DataFrame:
    f = lookback(fact, "transaction_ts", as_of, days).select(
        "transaction_sk", "customer_sk", "merchant_sk", "revenue_usd", "amount_usd",
        "status", "is_high_fraud_risk")
    j = join_dim(f, dim_merchant.select("merchant_sk", "region", "country_code"), "merchant_sk")
    g = ["region", "country_code"]
    # A transaction belongs to one customer, so both distinct counts come out
    # of a level plan - (group, customer, tx) -> (group, customer) -> group -
    # which shuffles each row about once, instead of an Expand that copies
    # every row per distinct expression before the shuffle.
    l1 = j.groupBy(*g, "customer_sk", "transaction_sk").agg(
        F.count(F.lit(1)).alias("n"), F.sum("revenue_usd").alias("rev"), F.sum("amount_usd").alias("amt"),
        F.count("amount_usd").alias("n_amt"), sum_if(F.col("status") == "captured").alias("cap"),
        F.sum("is_high_fraud_risk").alias("risk"))
    l2 = l1.groupBy(*g, "customer_sk").agg(
        F.count("transaction_sk").alias("n_tx"), F.sum("n").alias("n"), F.sum("rev").alias("rev"),
        F.sum("amt").alias("amt"), F.sum("n_amt").alias("n_amt"), F.sum("cap").alias("cap"),
        F.sum("risk").alias("risk"))
    out = l2.groupBy(*g).agg(
        F.sum("n_tx").alias("transactions"),
        F.count("customer_sk").alias("unique_customers"),
        F.sum("rev").cast("decimal(38,4)").alias("net_revenue_usd"),
        F.round((F.sum("amt") / F.nullif(F.sum("n_amt"), F.lit(0))).cast("decimal(18,6)"), 2)
         .cast("decimal(18,2)").alias("avg_ticket_usd"),
        F.round(F.sum("cap").cast("double") / F.nullif(F.sum("n"), F.lit(0)) * 100, 2).alias("success_rate_pct"),
        F.sum("risk").cast("long").alias("high_risk_tx_count"),
    )
    return out.orderBy(F.col("net_revenue_usd").desc_nulls_last(), "region", "country_code")


# Q02 ------------------------------------------------------------------
def top_fraud_merchants(fact: DataFrame, dim_merchant: DataFrame, as_of, days: int = 90,
                        min_tx: int = 50, min_rate: float = 0.05, n: int = 20) -> DataFrame:
    f = lookback(fact, "transaction_ts", as_of, days).select(
        "merchant_sk", "is_high_fraud_risk", "amount_usd", "fraud_score")
    # aggregate on the fact key first, then attach the few dimension columns
    agg = f.groupBy("merchant_sk").agg(
        F.count(F.lit(1)).alias("total_tx"),
        F.sum("is_high_fraud_risk").cast("long").alias("high_risk_tx"),
        F.sum("amount_usd").alias("_vol"),
        sum_if(F.col("is_high_fraud_risk") == 1, F.col("amount_usd")).alias("_risk_vol"),
        round_avg("fraud_score", 3).cast("decimal(18,3)").alias("avg_fraud_score"),
    ).filter(F.col("total_tx") >= min_tx)
    agg = agg.filter(F.col("high_risk_tx").cast("double") / F.nullif(F.col("total_tx"), F.lit(0)) >= min_rate)
    j = join_dim(agg, dim_merchant.select("merchant_sk", "business_name", "country_code", "mcc_category"),
                 "merchant_sk")
    out = j.select(
        "business_name", "country_code", "mcc_category", "total_tx", "high_risk_tx",
        F.round(F.col("high_risk_tx").cast("double") / F.nullif(F.col("total_tx"), F.lit(0)) * 100, 2).alias("fraud_rate_pct"),
        "avg_fraud_score",
        F.round("_risk_vol", 2).cast("decimal(38,2)").alias("at_risk_volume_usd"),
        F.round("_vol", 2).cast("decimal(38,2)").alias("total_volume_usd"),
        "merchant_sk",
    )
    return out.orderBy(F.col("at_risk_volume_usd").desc(), "merchant_sk").limit(n).drop("merchant_sk")


# Q03 ------------------------------------------------------------------
def cohort_retention(dim_customer: DataFrame, fact: DataFrame, as_of, months: int = 12,
                     offsets=(1, 3, 6)) -> DataFrame:
    cohorts = lookback(dim_customer, "customer_since", as_of, months, unit="month").select(
        "customer_sk", F.trunc("customer_since", "MM").alias("cohort_month"))
    hi = window_bounds(as_of, 0)[1]
    # no cohort starts before this month, and only activity from the cohort's month on counts: prunes all years before
    first = window_bounds(as_of, months, "month")[0].replace(day=1)
    activity = (fact.filter((F.col("status") == "captured")
                            & (F.col("transaction_ts") >= F.lit(first).cast("timestamp_ntz"))
                            & (F.col("transaction_ts") < F.lit(hi).cast("timestamp_ntz")))
                    .select("customer_sk", F.trunc("transaction_date", "MM").alias("tx_month"))
                    .distinct())
    j = (cohorts.join(activity, "customer_sk", "inner")
                .filter(F.col("tx_month") >= F.col("cohort_month"))
                .select("cohort_month", "customer_sk",
                        month_offset("cohort_month", "tx_month").alias("month_offset")))
    # one row per (cohort, customer) with offset flags -> plain sums after,
    # instead of several COUNT(DISTINCT CASE ...) (each would add an Expand)
    per_cust = j.groupBy("cohort_month", "customer_sk").agg(
        *[has_any(F.col("month_offset") == k).alias(f"_m{k}") for k in offsets])
    aggs = [F.count(F.lit(1)).alias("cohort_size")]
    aggs += [F.sum(f"_m{k}").cast("long").alias(f"active_m{k}") for k in offsets]
    out = per_cust.groupBy("cohort_month").agg(*aggs)
    for k in offsets:
        out = out.withColumn(f"retention_m{k}_pct", F.round(
            F.lit(100.0) * F.col(f"active_m{k}") / F.nullif(F.col("cohort_size"), F.lit(0)), 2))
    return out.orderBy("cohort_month")


# Q04 ------------------------------------------------------------------
def fraud_map(fact: DataFrame, dim_customer: DataFrame, dim_merchant: DataFrame, as_of,
              days: int = 60, min_tx: int = 30, n: int = 100) -> DataFrame:
    f = lookback(fact, "transaction_ts", as_of, days).select(
        "customer_sk", "merchant_sk", "is_high_fraud_risk", "fraud_score", "amount_usd")
    j = join_dim(f, dim_customer.select("customer_sk", F.col("country_code").alias("customer_country"),
                                        F.col("region").alias("customer_region")), "customer_sk")
    j = join_dim(j, dim_merchant.select("merchant_sk", "mcc_category"), "merchant_sk")
    out = j.groupBy("mcc_category", "customer_country", "customer_region").agg(
        F.count(F.lit(1)).alias("total_tx"),
        F.sum("is_high_fraud_risk").cast("long").alias("high_risk_tx"),
        F.round(F.lit(100.0) * F.sum("is_high_fraud_risk") / F.nullif(F.count(F.lit(1)), F.lit(0)), 2).alias("fraud_rate_pct"),
        round_avg("fraud_score", 3).cast("decimal(18,3)").alias("avg_fraud_score"),
        # exact percentile: Spark keeps a value->count map, and the score has
        # at most 10,001 distinct values (decimal(5,4) in [0,1]), so the
        # buffer stays bounded even for a hot segment
        F.round(F.percentile(F.col("fraud_score").cast("double"), F.lit(0.95)), 3).alias("p95_fraud_score"),
        F.sum("amount_usd").cast("decimal(38,2)").alias("total_volume_usd"),
        sum_if(F.col("is_high_fraud_risk") == 1, F.col("amount_usd")).cast("decimal(38,2)").alias("at_risk_volume_usd"),
    ).filter(F.col("total_tx") >= min_tx)
    return out.orderBy(F.col("fraud_rate_pct").desc(), F.col("total_volume_usd").desc(),
                       "mcc_category", "customer_country").limit(n)


# Q05 ------------------------------------------------------------------
def audit_review(log: DataFrame, as_of, days: int = 7, n: int = 500) -> DataFrame:
    f = lookback(log, "event_time", as_of, days).filter(
        F.col("resource_type").isin(*SENSITIVE_RESOURCES) & F.col("action").isin(*PRIVILEGED_ACTIONS))
    out = f.select(
        "event_time", "actor_type", "actor_id", "action", "resource_type", "resource_id",
        "ip_address", "success",
        F.get_json_object("metadata", "$.reason").alias("reason"),
        F.get_json_object("metadata", "$.approved_by").alias("approved_by"),
        "audit_id")
    return out.orderBy(F.col("event_time").desc(), F.col("audit_id").desc()).limit(n).drop("audit_id")


# Q06 ------------------------------------------------------------------
def audit_by_actor(log: DataFrame, as_of, days: int = 7) -> DataFrame:
    actions = [a for a in PRIVILEGED_ACTIONS if a != "LOGIN_ADMIN"]
    f = lookback(log, "event_time", as_of, days).filter(F.col("action").isin(*actions))
    out = f.groupBy("actor_id", "action").agg(
        F.count(F.lit(1)).alias("n_events"),
        sum_if(~F.col("success")).cast("long").alias("n_failures"),
        F.max("event_time").alias("last_seen"))
    return out.orderBy(F.col("n_events").desc(), "actor_id", "action")


# Q07 ------------------------------------------------------------------
def checkout_funnel(events: DataFrame, as_of, days: int = 7) -> DataFrame:
    e = lookback(events, "timestamp", as_of, days).select(
        "session_id", F.coalesce(F.col("device.type"), F.lit("unknown")).alias("device_type"), "event_type")
    sessions = e.groupBy("session_id", "device_type").agg(
        has_any(F.col("event_type") == "page_view").alias("v"),
        has_any(F.col("event_type") == "checkout_start").alias("s"),
        has_any(F.col("event_type") == "checkout_complete").alias("c"),
        has_any(F.col("event_type") == "checkout_abandon").alias("a"))
    out = sessions.groupBy("device_type").agg(
        F.count(F.lit(1)).alias("sessions"),
        F.sum("v").cast("long").alias("viewed"),
        F.sum("s").cast("long").alias("started_checkout"),
        F.sum("c").cast("long").alias("completed"),
        F.sum("a").cast("long").alias("abandoned"))
    out = out.select("*",
                     pct("started_checkout", "viewed", 2, floor_den=True).alias("start_rate_pct"),
                     pct("completed", "started_checkout", 2, floor_den=True).alias("completion_rate_pct"))
    return out.orderBy(F.col("sessions").desc(), "device_type")


# Q08 ------------------------------------------------------------------
def top_alerted_customers(alerts: DataFrame, as_of, days: int = 30, n: int = 50) -> DataFrame:
    a = lookback(alerts, "created_at", as_of, days).filter(F.col("decision").isin("review", "block"))
    # two-level plan: (customer, merchant) first, so the distinct-merchant
    # count is a plain count and a hot customer is pre-aggregated per merchant
    per_m = a.groupBy("customer_id", "merchant_id").agg(
        F.count(F.lit(1)).alias("n"),
        sum_if(F.col("decision") == "block").alias("b"),
        sum_if(F.col("decision") == "review").alias("r"),
        F.sum("score").alias("s"),
        F.max("score").alias("mx"),
        F.max("created_at").alias("last"))
    out = per_m.groupBy("customer_id").agg(
        F.sum("n").alias("alerts_total"),
        F.sum("b").cast("long").alias("blocks"),
        F.sum("r").cast("long").alias("reviews"),
        F.round((F.sum("s") / F.sum("n")).cast("decimal(18,6)"), 3).cast("decimal(18,3)").alias("avg_score"),
        F.round(F.max("mx"), 3).cast("decimal(18,3)").alias("max_score"),
        F.count("merchant_id").alias("merchants_touched"),
        F.max("last").alias("last_alert"))
    return out.orderBy(F.col("alerts_total").desc(), F.col("avg_score").desc(), "customer_id").limit(n)


# Q09 ------------------------------------------------------------------
def daily_summary(tx: DataFrame, as_of) -> DataFrame:
    """Rows ingested on ``as_of``, grouped by transaction day, newest group."""
    t = on_day(tx, "ingested_at", as_of)
    return _summary(t.select(F.to_date("trans_date_trans_time").alias("transaction_date"), F.lit(1).alias("n"),
                             F.col("amt").alias("amount"), "is_fraud_predicted"))


def daily_summary_of(sums: DataFrame) -> DataFrame:
    """``daily_summary`` from the sums of one ingestion day (``sources.scored_store``)."""
    return _summary(sums.select("transaction_date", "n", "amount", "is_fraud_predicted"))


def _summary(t: DataFrame) -> DataFrame:
    fraud = F.col("is_fraud_predicted")
    n, frauds = F.sum("n"), sum_if(fraud, F.col("n"))
    out = t.groupBy("transaction_date").agg(
        n.cast("long").alias("total_transactions"), frauds.cast("long").alias("total_frauds"),
        F.round(F.lit(100.0) * frauds / n, 2).alias("fraud_rate_pct"),
        F.round(F.sum("amount"), 2).cast("decimal(38,2)").alias("total_amount"),
        F.round(sum_if(fraud, F.col("amount")), 2).cast("decimal(38,2)").alias("fraud_amount"))
    return out.orderBy(F.col("transaction_date").desc()).limit(1)


def daily_summary_or_default(tx: DataFrame, as_of) -> DataFrame:
    """Always one row: zeros when nothing was ingested that day."""
    return summary_or_default(daily_summary(tx, as_of))


def summary_or_default(summary: DataFrame) -> DataFrame:
    s = summary.withColumn("_k", F.lit(1))
    spine = summary.sparkSession.range(1).select(F.lit(1).alias("_k"))
    j = spine.join(s, "_k", "left")
    return j.select(
        "transaction_date",
        F.coalesce("total_transactions", F.lit(0).cast("long")).alias("total_transactions"),
        F.coalesce("total_frauds", F.lit(0).cast("long")).alias("total_frauds"),
        F.coalesce("fraud_rate_pct", F.lit(0.0)).alias("fraud_rate_pct"),
        F.coalesce("total_amount", F.lit(0).cast("decimal(38,2)")).alias("total_amount"),
        F.coalesce("fraud_amount", F.lit(0).cast("decimal(38,2)")).alias("fraud_amount"))


# Q10 ------------------------------------------------------------------
def daily_frauds(tx: DataFrame, as_of) -> DataFrame:
    t = on_day(tx, "ingested_at", as_of).filter(F.col("is_fraud_predicted"))
    return t.select("trans_date_trans_time", "cc_num", "merchant", "category", "amt", "city", "state",
                    "fraud_probability", "trans_num") \
            .orderBy(F.col("fraud_probability").desc_nulls_first(), "trans_num")


# Q11 ------------------------------------------------------------------
def top_fraud_categories(tx: DataFrame, as_of, n: int = 10) -> DataFrame:
    t = on_day(tx, "ingested_at", as_of)
    return top_categories_of(t.select("category", "is_fraud_predicted", F.lit(1).cast("long").alias("n"), F.col("amt").alias("amount"),
                                      F.when(F.col("amt").isNotNull(), 1).otherwise(0).cast("long").alias("n_amount")), n)


def top_categories_of(sums: DataFrame, n: int = 10) -> DataFrame:
    """``top_fraud_categories`` from the sums of one ingestion day."""
    out = sums.filter(F.col("is_fraud_predicted")).groupBy("category").agg(
        F.sum("n").cast("long").alias("fraud_count"),
        F.round((F.sum("amount") / F.nullif(F.sum("n_amount"), F.lit(0))).cast("decimal(18,6)"), 2).cast("decimal(18,2)").alias("avg_fraud_amount"))
    return out.orderBy(F.col("fraud_count").desc(), "category").limit(n)


# Q12 ------------------------------------------------------------------
def pipeline_health(runs: DataFrame, as_of, days: int = 7) -> DataFrame:
    r = lookback(runs, "execution_date", as_of, days)
    return r.groupBy("dag_id").agg(
        F.count(F.lit(1)).alias("total_runs"),
        sum_if(F.col("status") == "success").cast("long").alias("successes"),
        sum_if(F.col("status") == "failed").cast("long").alias("failures"),
        round_avg("duration_seconds", 2).cast("decimal(18,2)").alias("avg_duration"),
        F.round(F.avg(F.col("records_processed").cast("double")), 0).alias("avg_records"))


# Q13 ------------------------------------------------------------------
def freshness(df: DataFrame, table_name: str, load_col: str, as_of, max_age_hours: float = 6.0) -> DataFrame:
    a = dt.datetime.fromisoformat(str(as_of)) if not isinstance(as_of, dt.datetime) else as_of
    last = df.agg(F.max(load_col).alias("last_loaded_at"))
    age_s = F.unix_timestamp(F.lit(a).cast("timestamp")) - F.unix_timestamp(F.col("last_loaded_at").cast("timestamp"))
    return last.select(
        F.lit(table_name).alias("table_name"), "last_loaded_at",
        F.round(age_s.cast("double") / 3600, 2).alias("age_hours"),
        (age_s > F.lit(max_age_hours * 3600)).alias("is_stale"))


# Q14 ------------------------------------------------------------------
def daily_report(tx: DataFrame, as_of, n_frauds: int = 20) -> DataFrame:
    """KPIs + top categories + first frauds (masked card) as one tidy table."""
    return _report(daily_summary(tx, as_of), top_fraud_categories(tx, as_of), daily_frauds(tx, as_of).limit(n_frauds))


def daily_report_of(sums: DataFrame, rows: DataFrame, as_of, n_frauds: int = 20) -> DataFrame:
    """``daily_report`` from one day's sums and rows: the rows are read once, for the list of frauds."""
    return _report(daily_summary_of(sums), top_categories_of(sums), daily_frauds(rows, as_of).limit(n_frauds))


def _report(s: DataFrame, cats: DataFrame, fr: DataFrame) -> DataFrame:
    kpis = s.select(F.lit("summary").alias("section"), F.lit(1).alias("rank"), F.explode(F.array(
        F.struct(F.lit("total_transactions").alias("field"), F.col("total_transactions").cast("string").alias("value")),
        F.struct(F.lit("total_frauds").alias("field"), F.col("total_frauds").cast("string").alias("value")),
        F.struct(F.lit("fraud_rate_pct").alias("field"), F.col("fraud_rate_pct").cast("decimal(18,2)").cast("string").alias("value")),
        F.struct(F.lit("total_amount").alias("field"), F.col("total_amount").cast("string").alias("value")),
        F.struct(F.lit("fraud_amount").alias("field"), F.col("fraud_amount").cast("string").alias("value")),
    )).alias("kv")).select("section", "rank", "kv.field", "kv.value")
    from pyspark.sql import Window as W
    # the two unpartitioned rank windows below run on at most n (10 / 20)
    # rows: they follow a limit
    cats = cats.withColumn("rank", F.row_number().over(W.orderBy(F.col("fraud_count").desc(), "category")))
    cats = cats.select(F.lit("category").alias("section"), "rank", F.col("category").alias("field"),
                       F.concat_ws("|", F.col("fraud_count").cast("string"), F.col("avg_fraud_amount").cast("string")).alias("value"))
    fr = fr.withColumn("rank", F.row_number().over(W.orderBy(F.col("fraud_probability").desc_nulls_first(), "trans_num")))
    fr = fr.select(F.lit("fraud").alias("section"), "rank", F.col("trans_num").alias("field"),
                   F.concat_ws("|", F.col("trans_date_trans_time").cast("string"), mask_card("cc_num"),
                               F.col("merchant"), F.col("amt").cast("string"),
                               F.col("fraud_probability").cast("string")).alias("value"))
    return kpis.unionByName(cats).unionByName(fr)


# Q22 ------------------------------------------------------------------
SEARCH_TERMS = ["the", "and", "de", "le"]


def search_feedback(docs: DataFrame, labels: DataFrame, terms=SEARCH_TERMS) -> DataFrame:
    """Keyword search over whole texts + sentiment counts per language.

    Tokens are maximal runs of letters, lower-cased; a document matches when
    any token equals a term. Sentiment comes from the label table (toxic ->
    negative, quality -> positive, otherwise neutral).
    """
    toks = F.split(F.lower(F.col("text")), r"[^\p{L}]+")
    d = docs.select("doc_id", "lang", F.arrays_overlap(toks, F.array(*[F.lit(t) for t in terms])).alias("hit"))
    return _by_sentiment(d, labels)


def search_feedback_index(index, docs: DataFrame, labels: DataFrame, terms=SEARCH_TERMS) -> DataFrame:
    """``search_feedback`` from an inverted index (``sources.text_index``): postings of the terms
    only, no text; the sentiment is joined last."""
    hits = index.any_of(list(terms)).withColumn("_hit", F.lit(True))
    d = docs.select("doc_id", "lang").join(hits, "doc_id", "left").withColumn("hit", F.coalesce("_hit", F.lit(False))).drop("_hit")
    return _by_sentiment(d, labels)


def _by_sentiment(docs: DataFrame, labels: DataFrame) -> DataFrame:
    j = docs.join(labels.select("doc_id", "quality", "toxic"), "doc_id", "left")
    sentiment = (F.when(F.col("toxic") == 1, "negative").when(F.col("quality") == 1, "positive")
                 .otherwise("neutral"))
    return j.groupBy("lang", sentiment.alias("sentiment")).agg(
        F.count(F.lit(1)).alias("n_docs"),
        sum_if(F.col("hit")).cast("long").alias("n_matching"))


# Q23 ------------------------------------------------------------------
def log_levels(events: DataFrame, as_of, days: int = 30) -> DataFrame:
    e = lookback(events, "ts", as_of, days)
    level = (F.when(F.col("event_type") == "error", "ERROR").when(F.col("value") > 90, "WARN")
             .otherwise("INFO"))
    return e.groupBy(F.col("event_type").alias("service"), level.alias("level"),
                     F.date_trunc("hour", F.col("ts")).alias("hour")).agg(F.count(F.lit(1)).alias("n_logs"))
