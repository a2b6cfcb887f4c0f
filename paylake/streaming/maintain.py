"""Stateful stream results kept in tables, with late rows set apart.

Each stream keeps the latest event time of its batches. A row further behind it
than the allowed delay goes to the dead letters, in the same stream and before
anything stateful sees it, so what is stored and what is dead add up to what
arrived. The rest is deduplicated, counted or joined to sessions; results live
in versioned tables, and a repeated batch changes nothing.
"""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from paylake.sources.aggregate_store import AggregateStore
from paylake.sources.sinks import to_dead_letter, write_batch
from paylake.streaming import monitors as M
from paylake.streaming.ingest import keyed_append, path_exists, prune_batches, split_late

DELAY_SECONDS = 600
MARKS = "_event_time"


def on_time(batch: DataFrame, batch_id: int, out: str, event_time: str, delay_seconds: int = DELAY_SECONDS) -> DataFrame:
    """The rows of a micro-batch that are in time; the late ones are written to ``out``/dead_letter."""
    rows, late = split_late(batch, batch_id, os.path.join(out, MARKS), event_time, delay_seconds)
    dead = to_dead_letter(late.withColumn("errors", F.array(F.lit("late event"))), "late_event", "stream")
    write_batch(dead, os.path.join(out, "dead_letter"), batch_id)
    return rows


def run(stream: DataFrame, out: str, event_time: str, handle: Callable[[DataFrame, int], None],
        delay_seconds: int = DELAY_SECONDS, available_now: bool = True, processing_time: str = "1 minute"):
    """Start one stream whose late rows go to the dead letters and whose other rows ``handle`` gets, batch by batch."""
    w = stream.writeStream.option("checkpointLocation", os.path.join(out, "_checkpoint")).foreachBatch(
        lambda batch, i: handle(on_time(batch, i, out, event_time, delay_seconds), i))
    return (w.trigger(availableNow=True) if available_now else w.trigger(processingTime=processing_time)).start()


def dead_letters(spark: SparkSession, out: str) -> DataFrame:
    return spark.read.parquet(os.path.join(out, "dead_letter"))


# T02 -----------------------------------------------------------------
def run_dedup(stream: DataFrame, out: str, key: str, event_time: str, **options):
    """First row of each key, for ever (a keyed store), late rows apart."""
    return run(stream, out, event_time, lambda rows, i: keyed_append(rows, os.path.join(out, "rows"), i, key), **options)


# T06, T07, T09 ---------------------------------------------------------
def counts(spark: SparkSession, out: str, keys: list[str]) -> AggregateStore:
    return AggregateStore(spark, os.path.join(out, "counts"), keys, sums=["n"])


def run_counts(stream: DataFrame, out: str, event_time: str, keys: list[str], partial: Callable[[DataFrame], DataFrame], **options):
    """Counts ``n`` per ``keys``: ``partial`` counts one batch, the store adds them up."""
    def handle(rows, i):
        store = counts(rows.sparkSession, out, keys)
        store.add(partial(rows).select(*keys, "n"), i)
        if store.compact():
            store.vacuum()
    return run(stream, out, event_time, handle, **options)


def rates(merged: DataFrame, window_seconds: int = 300) -> DataFrame:
    return merged.withColumn("rate_per_s", F.col("n") / float(window_seconds))


# T08 -------------------------------------------------------------------
def merge_sessions(parts: DataFrame, key: str, gap_seconds: int) -> DataFrame:
    """(key, first, last, n): partial sessions less than ``gap_seconds`` apart joined to one."""
    order = W.partitionBy(key).orderBy("first", "last")
    seen = F.max("last").over(order.rowsBetween(W.unboundedPreceding, -1))
    begins = F.when(seen.isNull() | (F.col("first") >= seen + F.expr(f"INTERVAL {int(gap_seconds)} SECONDS")), 1).otherwise(0)
    return parts.withColumn("_b", begins).withColumn("_s", F.sum("_b").over(order)) \
        .groupBy(key, "_s").agg(F.min("first").alias("first"), F.max("last").alias("last"), F.sum("n").alias("n")).drop("_s")


def slice_sessions(events: DataFrame, key: str, ts: str, gap_seconds: int, slice_seconds: int = 6 * 3600) -> DataFrame:
    """Partial sessions within slices of time, so that a key with very many events is spread over tasks."""
    t = F.col(ts).cast("timestamp")
    cut = F.floor(F.unix_seconds(t) / slice_seconds)
    e = events.filter(t.isNotNull()).select(key, t.alias("t"), cut.alias("_slice"))
    order = W.partitionBy(key, "_slice").orderBy("t")
    before = F.lag("t").over(order)
    begins = F.when(before.isNull() | (F.col("t") >= before + F.expr(f"INTERVAL {int(gap_seconds)} SECONDS")), 1).otherwise(0)
    return e.withColumn("_b", begins).withColumn("_p", F.sum("_b").over(order)).groupBy(key, "_slice", "_p").agg(
        F.min("t").alias("first"), F.max("t").alias("last"), F.count(F.lit(1)).alias("n")).drop("_slice", "_p")


def run_sessions(stream: DataFrame, out: str, key: str, event_time: str, gap_seconds: int = 1800,
                 delay_seconds: int = DELAY_SECONDS, **options):
    """Sessions in append mode: each batch joins its events to the open sessions; those that no row
    in time can reach any more are appended to ``out``/sessions, the others stay open."""
    def handle(rows, i):
        spark = rows.sparkSession
        parts = slice_sessions(rows, key, event_time, gap_seconds)
        held = open_sessions(spark, out, before=i)
        merged = merge_sessions(parts if held is None else parts.unionByName(held), key, gap_seconds)
        mark = spark.read.parquet(os.path.join(out, MARKS)).filter(F.col("batch_id").cast("long") <= i).agg(F.max("mark")).first()[0]
        if mark is None:  # no row had a readable time
            mark = "1900-01-01"
        done = F.col("last") + F.expr(f"INTERVAL {int(gap_seconds)} SECONDS") <= F.lit(mark).cast("timestamp") - F.expr(f"INTERVAL {int(delay_seconds)} SECONDS")
        both = merged.withColumn("open", ~done)
        # one pass writes both; a repeated batch replaces what it wrote
        write_batch(both, os.path.join(out, "sessions"), i, buckets="open")
        # what earlier batches left open; the batch before is needed should this one be repeated
        prune_batches(spark, os.path.join(out, "sessions", "open=true"), i - 1 if held is None else last_batch(spark, out, i))
    return run(stream, out, event_time, handle, delay_seconds=delay_seconds, **options)


def open_sessions(spark: SparkSession, out: str, before: int | None = None) -> DataFrame | None:
    """The sessions that the last batch (before ``before``) left open; None if there was none."""
    path = os.path.join(out, "sessions")
    if not path_exists(spark, path):
        return None
    last = last_batch(spark, out, before)
    if last is None:
        return None
    return spark.read.parquet(path).filter(F.col("open") & (F.col("batch_id").cast("long") == last)).drop("open", "batch_id")


def last_batch(spark: SparkSession, out: str, before: int | None = None) -> int | None:
    """The last batch (before ``before``): every one has a mark, also one that left no session open."""
    ids = spark.read.parquet(os.path.join(out, MARKS)).select(F.col("batch_id").cast("long").alias("b"))
    return (ids if before is None else ids.filter(F.col("b") < before)).agg(F.max("b")).first()[0]


def sessions(spark: SparkSession, out: str, key: str, gap_seconds: int = 1800, flush: bool = False) -> DataFrame:
    """The closed sessions; with ``flush``, at the stream's end, also those still open."""
    rows = spark.read.parquet(os.path.join(out, "sessions")).filter(~F.col("open")).drop("open", "batch_id")
    if flush:
        rows = rows.unionByName(open_sessions(spark, out))
    return rows.select(key, F.col("first").cast("timestamp_ntz").alias("session_start"),
                       (F.col("last") + F.expr(f"INTERVAL {int(gap_seconds)} SECONDS")).cast("timestamp_ntz").alias("session_end"),
                       F.col("n").alias("n_events"))


# partial counts of one batch for ``run_counts``
def rate_counts(ts: str, by: str | None = None) -> Callable[[DataFrame], DataFrame]:
    return lambda rows: M.request_rate(rows, ts, by)


def latency_counts(ts: str, latency: str) -> Callable[[DataFrame], DataFrame]:
    return lambda rows: M.bucket_counts(rows, ts, latency)


def key_counts(key: str, ts: str) -> Callable[[DataFrame], DataFrame]:
    return lambda rows: M.sliding_counters(rows, key, ts)
