"""Windowed stream monitors.

Event-time columns are cast to ``timestamp`` before ``withWatermark`` (the
driver's parquet stores zone-less timestamps, which cannot carry a
watermark). Rows later than the watermark are dropped by Spark's stateful
operators, so callers that must account for them flag lateness first.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# --- fixed values ---------------------------------------------------------
# Latency histogram bucket upper bounds (seconds) of the scoring service.
LATENCY_BUCKETS = [0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0]
DEFAULT_WATERMARK = "10 minutes"


def _wm(df: DataFrame, ts: str, delay: str) -> DataFrame:
    return df.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, delay)


# T06 -----------------------------------------------------------------
def request_rate(stream: DataFrame, ts: str, by: str | None = None, window: str = "5 minutes",
                 slide: str | None = None, delay: str = DEFAULT_WATERMARK, window_seconds: int = 300) -> DataFrame:
    s = _wm(stream, ts, delay)
    w = F.window(ts, window, slide) if slide else F.window(ts, window)
    keys = [w.alias("w")] + ([F.col(by)] if by else [])
    g = s.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return g.select(F.col("w.start").cast("timestamp_ntz").alias("window_start"), *([by] if by else []),
                    "n", (F.col("n") / float(window_seconds)).alias("rate_per_s"))


# T07 -----------------------------------------------------------------
def bucket_counts(stream: DataFrame, ts: str, latency: str, window: str = "5 minutes",
                  buckets=LATENCY_BUCKETS, delay: str = DEFAULT_WATERMARK) -> DataFrame:
    """Per window: count per histogram bucket (bucket = first bound >= value,
    index len(buckets) = +Inf)."""
    s = _wm(stream, ts, delay)
    idx = F.lit(len(buckets))
    for i in reversed(range(len(buckets))):
        idx = F.when(F.col(latency) <= buckets[i], F.lit(i)).otherwise(idx)
    g = s.groupBy(F.window(ts, window).alias("w"), idx.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    return g.select(F.col("w.start").cast("timestamp_ntz").alias("window_start"), "bucket", "n")


def bucket_quantiles(counts: DataFrame, qs=(0.5, 0.95, 0.99), buckets=LATENCY_BUCKETS) -> DataFrame:
    """Quantile by linear interpolation inside the bucket that reaches the
    rank (histogram-quantile rule); a rank in the +Inf bucket returns the
    largest finite bound. Runs on the small per-window bucket table."""
    bounds = F.array(*[F.lit(float(b)) for b in buckets])
    upper = F.when(F.col("bucket") < len(buckets), F.element_at(bounds, F.col("bucket") + 1))
    lower = F.when(F.col("bucket") == 0, F.lit(0.0)).otherwise(
        F.element_at(bounds, F.least(F.col("bucket"), F.lit(len(buckets)))))
    w = W.partitionBy("window_start").orderBy("bucket")
    c = counts.withColumns({
        "cum": F.sum("n").over(w.rowsBetween(W.unboundedPreceding, W.currentRow)),
        "total": F.sum("n").over(W.partitionBy("window_start")),
        "lower": lower, "upper": upper})
    c = c.withColumn("before", F.col("cum") - F.col("n"))
    outs = []
    for q in qs:
        rank = F.col("total") * q
        hit = (F.col("before") < rank) & (F.col("cum") >= rank)
        val = F.when(F.col("upper").isNull(), F.col("lower")).otherwise(
            F.col("lower") + (F.col("upper") - F.col("lower")) * (rank - F.col("before")) / F.col("n"))
        outs.append(F.round(F.max(F.when(hit, val)), 6).alias(f"p{int(round(q * 100))}"))
    return c.groupBy("window_start").agg(*outs)


# T08 -----------------------------------------------------------------
def sessionize(stream: DataFrame, key: str, ts: str, gap: str = "30 minutes",
               delay: str = DEFAULT_WATERMARK) -> DataFrame:
    s = _wm(stream, ts, delay)
    g = s.groupBy(F.col(key), F.session_window(ts, gap).alias("s")).agg(F.count(F.lit(1)).alias("n_events"))
    return g.select(key, F.col("s.start").cast("timestamp_ntz").alias("session_start"),
                    F.col("s.end").cast("timestamp_ntz").alias("session_end"), "n_events")


# T09 -----------------------------------------------------------------
def sliding_counters(stream: DataFrame, key: str, ts: str, window: str = "1 hour", slide: str = "15 minutes",
                     delay: str = DEFAULT_WATERMARK) -> DataFrame:
    s = _wm(stream, ts, delay)
    g = s.groupBy(F.col(key), F.window(ts, window, slide).alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return g.select(key, F.col("w.start").cast("timestamp_ntz").alias("window_start"), "n")


def update_features(docs: DataFrame, counters: DataFrame, key: str, field: str) -> DataFrame:
    """Feature documents with ``field`` replaced by the count of each key's
    latest window; keys without counters keep their document."""
    from paylake.sources.changes import latest_per_key, upsert
    last = latest_per_key(counters, key, ["window_start"]).select(key, F.col("n").alias(field))
    return upsert(docs, last, key)
