"""Customer and merchant features.

All are one ``groupBy().agg()`` over a bounded look-back, with conditional
aggregates relative to an explicit ``as_of`` - no per-row Python.
"""

from __future__ import annotations

import math

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from paylake.functions.predicates import lookback, window_bounds
from paylake.operators.joins import join_dim

FEATURE_FIELDS = ["tx_count_1h", "tx_count_24h", "tx_count_7d", "tx_amount_sum_24h", "tx_amount_avg_30d",
                  "distinct_merchants_24h", "distinct_countries_24h", "velocity_score", "risk_score",
                  "chargeback_ratio_90d"]


# X01 -----------------------------------------------------------------
def customer_features_reference(extract: DataFrame, key: str = "customer_sk") -> DataFrame:
    """Feature formulas exactly as the reference computes them from its
    90-day extract (names notwithstanding): the "30d" mean and "24h" sum are
    over the whole extract, counts are scaled from the 90-day count, and
    rounding is half-even as in pandas. Rows with a null customer are dropped.
    """
    g = extract.filter(F.col(key).isNotNull()).groupBy(key).agg(
        F.count("transaction_id").alias("tx_count_90d"),
        F.avg(F.col("amount_usd").cast("double")).alias("tx_amount_avg_30d"),
        F.sum(F.col("amount_usd").cast("double")).alias("tx_amount_sum_24h"),
        F.avg(F.col("label").cast("double")).alias("high_risk_rate"))
    c24 = F.bround(F.least(F.col("tx_count_90d") / 90, F.lit(200.0)), 0).cast("int")
    g = g.withColumn("tx_count_24h", c24)
    return g.select(
        F.col(key).cast("string").alias("customer_id"),
        F.bround(F.least(F.col("tx_count_24h") / 24, F.lit(50.0)), 0).cast("int").alias("tx_count_1h"),
        "tx_count_24h",
        F.least(F.col("tx_count_90d") * 7 / 90, F.lit(500.0)).cast("int").alias("tx_count_7d"),
        "tx_amount_sum_24h", "tx_amount_avg_30d",
        F.least(F.col("tx_count_24h"), F.lit(30)).alias("distinct_merchants_24h"),
        F.bround(F.least(F.col("tx_count_24h") / 10, F.lit(5.0)), 0).cast("int").alias("distinct_countries_24h"),
        F.least(F.col("tx_count_24h") / 20, F.lit(1.0)).alias("velocity_score"),
        F.least(F.col("high_risk_rate"), F.lit(1.0)).alias("risk_score"),
        (F.col("high_risk_rate") * 0.1).alias("chargeback_ratio_90d"))


def as_feature_document(features: DataFrame, updated_at, version: str) -> DataFrame:
    """Feature-store document shape: customer_id, features struct, stamp, version."""
    return features.select(
        "customer_id", F.struct(*FEATURE_FIELDS).alias("features"),
        F.lit(updated_at).cast("timestamp").alias("updated_at"), F.lit(version).alias("model_version"))


def _since(as_of, seconds: int):
    hi = window_bounds(as_of, 0)[1]
    return F.lit(hi - dt.timedelta(seconds=seconds)).cast("timestamp_ntz")


# X02 -----------------------------------------------------------------
def customer_features(fact: DataFrame, merchant_country: DataFrame, disputes: DataFrame, as_of,
                      ts: str = "transaction_ts") -> DataFrame:
    """Features as their names mean: true trailing windows ending at the end
    of ``as_of``, distinct merchants/countries in 24 h, dispute-based
    chargeback ratio over 90 days."""
    f = lookback(fact, ts, as_of, 90).select("transaction_id", "customer_sk", "merchant_sk", "amount_usd",
                                             "is_high_fraud_risk", ts)
    f = join_dim(f, merchant_country.select("merchant_sk", "country_code"), "merchant_sk")
    # a dispute of a transaction in the look-back cannot be older than it
    if "created_at" in disputes.columns:
        disputes = lookback(disputes, "created_at", as_of, 90, bounded=False)
    d = disputes.select("transaction_id").distinct().withColumn("_disputed", F.lit(1))
    f = f.join(d, "transaction_id", "left")
    t = F.col(ts)
    in1h, in24h, in7d, in30d = (t >= _since(as_of, 3600)), (t >= _since(as_of, 86400)), \
        (t >= _since(as_of, 7 * 86400)), (t >= _since(as_of, 30 * 86400))
    # two levels instead of two COUNT(DISTINCT) next to other aggregates
    # (which would Expand every row 3x): one row per (customer, merchant) -
    # a merchant has one country - then plain sums and a single distinct
    g1 = f.groupBy("customer_sk", "merchant_sk", "country_code").agg(
        F.count_if(in1h).alias("c1h"), F.count_if(in24h).alias("c24h"), F.count_if(in7d).alias("c7d"),
        F.sum(F.when(in24h, F.col("amount_usd"))).alias("s24h"),
        F.sum(F.when(in30d, F.col("amount_usd").cast("double"))).alias("s30d"),
        F.count_if(in30d).alias("c30d"),
        F.sum(F.col("is_high_fraud_risk").cast("double")).alias("risk_sum"),
        F.sum(F.coalesce(F.col("_disputed"), F.lit(0)).cast("double")).alias("disp_sum"),
        F.count(F.lit(1)).alias("n"))
    g = g1.groupBy("customer_sk").agg(
        F.sum("c1h").cast("int").alias("tx_count_1h"),
        F.sum("c24h").cast("int").alias("tx_count_24h"),
        F.sum("c7d").cast("int").alias("tx_count_7d"),
        F.coalesce(F.sum("s24h"), F.lit(0)).cast("double").alias("tx_amount_sum_24h"),
        (F.sum("s30d") / F.nullif(F.sum("c30d"), F.lit(0))).alias("tx_amount_avg_30d"),
        F.sum((F.col("c24h") > 0).cast("int")).cast("int").alias("distinct_merchants_24h"),
        F.countDistinct(F.when(F.col("c24h") > 0, F.col("country_code"))).cast("int").alias("distinct_countries_24h"),
        (F.sum("risk_sum") / F.sum("n")).alias("risk_score"),
        (F.sum("disp_sum") / F.sum("n")).alias("chargeback_ratio_90d"))
    g = g.withColumn("velocity_score", F.least(F.col("tx_count_24h") / 20, F.lit(1.0)))
    return g.select(F.col("customer_sk").cast("string").alias("customer_id"), *FEATURE_FIELDS)


# X03 -----------------------------------------------------------------
def merchant_features(fact: DataFrame, as_of, ts: str = "transaction_ts") -> DataFrame:
    f = lookback(fact, ts, as_of, 90)
    t = F.col(ts)
    in24h, in7d, in30d = (t >= _since(as_of, 86400)), (t >= _since(as_of, 7 * 86400)), (t >= _since(as_of, 30 * 86400))
    return f.groupBy("merchant_sk").agg(
        F.count_if(in24h).cast("int").alias("tx_count_24h"),
        F.count_if(in7d).cast("int").alias("tx_count_7d"),
        F.count_if(in30d).cast("int").alias("tx_count_30d"),
        F.count(F.lit(1)).cast("int").alias("tx_count_90d"),
        F.coalesce(F.sum(F.when(in30d, F.col("amount_usd"))), F.lit(0)).cast("decimal(38,2)").alias("tx_amount_sum_30d"),
        F.round(F.avg(F.col("is_high_fraud_risk").cast("double")), 6).alias("high_risk_rate_90d"))


# W02 -----------------------------------------------------------------
TRAILING_WINDOWS = {"1h": 3600, "24h": 86400, "7d": 7 * 86400, "30d": 30 * 86400, "90d": 90 * 86400}


def trailing(df: DataFrame, key: str, ts: str, seconds: int, value: str, exclude_current: bool = True) -> DataFrame:
    """Point-in-time trailing count and sum per key over ``seconds`` before each
    row (excluding the row itself for leakage-free training rows).

    A key's rows are cut into time buckets of the window's length; each row
    goes to its own bucket and, as context, to the next one, so a frame never
    leaves its bucket and a key with a third of all rows is spread over as
    many tasks as its history has buckets. Rows without a key or time keep a
    frame of their own kind (null key, null time)."""
    sec = F.unix_timestamp(F.col(ts).cast("timestamp"))
    hi = -1 if exclude_current else 0
    x = df.withColumn("_sec", sec).withColumn("_own", F.floor(F.col("_sec") / seconds))
    x = x.withColumn("_b", F.explode(F.when(F.col("_own").isNull(), F.array(F.lit(None).cast("long")))
                                     .otherwise(F.array(F.col("_own"), F.col("_own") + 1))))
    w = W.partitionBy(key, "_b").orderBy("_sec").rangeBetween(-seconds, hi)
    x = x.withColumns({f"{value}_count_{seconds}s": F.count(F.col(value)).over(w),
                       f"{value}_sum_{seconds}s": F.coalesce(F.sum(F.col(value)).over(w), F.lit(0.0))})
    return x.filter(F.col("_own").isNull() | (F.col("_b") == F.col("_own"))).drop("_sec", "_own", "_b")


def trailing_all(df: DataFrame, key: str, ts: str, value: str, windows=None) -> DataFrame:
    """All trailing windows of the feature contract, 1 h to 90 d, by prefix sums: for each window
    the values that are not null and their sum over the ``seconds`` before each row, the row's own
    second excluded.

    A key's time is cut into slices that divide every window. What lies in whole slices is a
    difference of cumulative sums over the (key, slice) totals; what is left are the rows at the
    two edges. The far edge lies as far into its slice as the row into its own, so each row is
    sent, slim, to the slices for which it can be at an edge, and one running sum by the place in
    the slice serves all windows: rows are shuffled once, by (key, slice), and a key with half of
    them is spread over its slices. Sums are exact for integers and decimals; other values are
    added as decimals of 9 places. A row without a time has nothing before it; rows without a key
    belong together."""
    windows = windows or TRAILING_WINDOWS
    size = math.gcd(*windows.values())
    kind = df.schema[value].dataType.simpleString()
    exact = "decimal(38,9)" if kind in ("double", "float", "string") else "decimal(38,0)" if not kind.startswith("decimal") else \
        f"decimal(38,{kind[8:-1].split(',')[1]})"
    out_type = kind if kind.startswith("decimal") else "double"
    row = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    # the key in a struct: null keys are equal there, so window and join share one exchange
    x = df.select(F.struct(F.col(key)).alias("_k"), F.unix_timestamp(F.col(ts).cast("timestamp")).alias("_t"),
                  F.col(value).cast(exact).alias("_v"), row.alias("_row"))
    none = x.filter("_t IS NULL")
    x = x.filter("_t IS NOT NULL").withColumn("_q", F.col("_t") - 1)
    one = F.when(F.col("_v").isNotNull(), 1).otherwise(0).cast("long")
    zero = F.lit(0).cast(exact)

    # whole slices: totals, and the slices that rows ask from though nothing lies there
    slices = x.select("_k", F.explode(F.array(
        F.struct(F.floor(F.col("_t") / size).alias("s"), one.alias("n"), F.coalesce("_v", zero).alias("v")),
        F.struct(F.floor(F.col("_q") / size).alias("s"), F.lit(0).cast("long").alias("n"), zero.alias("v")))).alias("p")) \
        .groupBy("_k", F.col("p.s").alias("_s")).agg(F.sum("p.n").alias("n"), F.sum("p.v").cast(exact).alias("v"))
    upto = lambda c, k: F.coalesce(F.sum(c).over(  # noqa: E731  (unbounded frames: each total is added once)
        W.partitionBy("_k").orderBy("_s").rangeBetween(W.unboundedPreceding, -k)), F.lit(0))
    whole = slices.select("_k", "_s", *[
        (upto(c, 1) - upto(c, n // size + 1)).alias(f"_{c}{n}") for n in windows.values() for c in ("n", "v")])

    # edges: role 0 is the row's own slice, role n the one that many seconds before
    far = [F.struct((F.floor(F.col("_t") / size) + n // size).alias("s"), F.pmod("_t", F.lit(size)).alias("o"), F.lit(n).alias("r")) for n in windows.values()]
    own = F.struct(F.floor(F.col("_t") / size).alias("s"), F.pmod("_t", F.lit(size)).alias("o"), F.lit(0).alias("r"))
    ask = F.struct(F.floor(F.col("_q") / size).alias("s"), F.pmod("_q", F.lit(size)).alias("o"), F.lit(-1).alias("r"))
    sent = x.withColumn("p", F.explode(F.array(ask, own, *far))).select(
        "_k", F.col("p.s").alias("_s"), F.col("p.o").alias("_o"), F.col("p.r").alias("_r"), one.alias("_one"), "_v",
        F.when(F.col("p.r") == -1, F.col("_row")).alias("_row"))
    place = W.partitionBy("_k", "_s").orderBy("_o").rangeBetween(W.unboundedPreceding, W.currentRow)
    role = lambda c, r: F.coalesce(F.sum(F.when(F.col("_r") == r, F.col(c))).over(place), F.lit(0))
    edges = sent.select("_k", "_s", "_r", "_row", *[
        (role(c, 0) - role(c, n)).alias(f"_e{c}{n}") for n in windows.values() for c in ("_one", "_v")]).filter("_r = -1")
    joined = edges.join(whole, ["_k", "_s"])
    names = [(f"{value}_count_{n}s", f"{value}_sum_{n}s", n) for n in windows.values()]
    done = joined.select("_row.*", *[c for cn, sn, n in names for c in (
        (F.col(f"_n{n}") + F.col(f"_e_one{n}")).cast("long").alias(cn), (F.col(f"_v{n}") + F.col(f"_e_v{n}")).cast(out_type).alias(sn))])
    return done.unionByName(none.select("_row.*", *[c for cn, sn, _ in names for c in (
        F.lit(0).cast("long").alias(cn), F.lit(0).cast(out_type).alias(sn))]))
