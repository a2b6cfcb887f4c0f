"""Minute ingestion as one Structured Streaming plan.

source -> rule columns -> split -> score -> prediction check ->
``foreachBatch`` writing the accepted rows, the dead-letter rows (input and
prediction errors), the alerts and a run-log row. Each write
lands in the batch's own ``batch_id=`` partition with dynamic overwrite, and
the keyed insert skips ids already stored by *earlier* batches, so a batch
replayed after an executor or driver failure (same batch id, from the
checkpoint) replaces its own output instead of duplicating it.
"""

from __future__ import annotations

import datetime as dt
import os
import time
from decimal import Decimal
from collections.abc import Callable

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paylake.functions.scalar import mask_card
from paylake.operators.quality import rule_probability, split_valid, validate
from paylake.session import checkpoint_root
from paylake.sources.keyed_store import KeyedStore
from paylake.sources.sinks import log_run, to_dead_letter, write_batch

DQ_COLS = ["schema_errors", "rule_errors", "errors", "data_quality_status"]


# S06 -----------------------------------------------------------------
def read_events_stream(spark: SparkSession, path: str, schema, fmt: str = "parquet",
                       max_files_per_trigger: int | None = None) -> DataFrame:
    """File stream source (a Kafka source is a drop-in where the connector is
    installed: ``readStream.format("kafka")`` + ``from_json`` of the value)."""
    r = spark.readStream.schema(schema).format(fmt)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    return r.load(path)


def table_stream(spark: SparkSession, sf_dir: str, name: str, max_files_per_trigger: int | None = None) -> DataFrame:
    """Stream one of the driver tables (glob path: the file source lists it)."""
    schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    return read_events_stream(spark, f"{sf_dir}/{name}*.parquet", schema, "parquet", max_files_per_trigger)


def run_dir(spark: SparkSession, tag: str) -> str:
    """Fresh folder for one run under the shared checkpoint root."""
    return os.path.join(checkpoint_root(spark), "runs", f"{tag}-{time.time_ns()}")


def amount_scorer(df: DataFrame) -> DataFrame:
    """Deterministic stand-in scorer: probability = min(amt / 10,000, 1), in
    exact decimal arithmetic (no binary rounding ties)."""
    p = F.least(F.col("amt").cast("string").try_cast("decimal(12,2)") * F.lit(Decimal("0.0001")),
                F.lit(Decimal("1")))
    return df.withColumns({"_p": p}).withColumns({
        "fraud_probability": F.round("_p", 4).cast("decimal(5,4)"),
        "is_fraud_predicted": F.coalesce(F.col("_p") >= Decimal("0.5"), F.lit(False)),
        "model_version": F.lit("amount-rule")}).drop("_p")


# T04 -----------------------------------------------------------------
def fraud_alerts(scored: DataFrame) -> DataFrame:
    """Predicted frauds -> masked alert records (batch or stream)."""
    return scored.filter(F.col("is_fraud_predicted")).select(
        "trans_num", mask_card("cc_num").alias("card"), "merchant", "category",
        F.col("amt").cast("string").alias("amt"), "fraud_probability")


# The stored keys of the keyed insert are spread over so many hash buckets at first.
KEY_BUCKETS = 16
COMPACT_EVERY = 16


# T01 / T03 -----------------------------------------------------------
def ingest_batch(batch: DataFrame, batch_id: int, out: str, scorer: Callable[[DataFrame], DataFrame],
                 key: str = "trans_num", min_partitions: int | None = None,
                 dag_id: str = "stream_ingest", event_time: str | None = None, delay_seconds: int = 600) -> None:
    """One micro-batch: part off late rows, validate, score, check the
    predictions, keyed insert, dead letters (late rows, input and prediction
    errors), alerts, run-log row.

    With ``event_time``, a row more than ``delay_seconds`` behind the latest
    event time of earlier batches is late: it goes to the dead letters before
    any stateful step, not silently away."""
    started = time.time()
    spark = batch.sparkSession
    late = None
    if event_time:
        batch, late = split_late(batch, batch_id, os.path.join(out, "_event_time"), event_time, delay_seconds)
    # a micro-batch has as many partitions as its source (topic partitions,
    # files): when that is below the cluster's cores, spread it round-robin
    # (no key, so no skew) before the per-row validation and scoring work
    want = min_partitions or spark.sparkContext.defaultParallelism
    if batch.rdd.getNumPartitions() < want:
        batch = batch.repartition(want)
    # the batch feeds several writes: validate it once and keep it for the
    # duration of the batch (recomputed from the replayable source if an
    # executor holding blocks is lost)
    v = validate(batch).persist(StorageLevel.MEMORY_AND_DISK)
    valid, rejected = split_valid(v)
    scored = scorer(valid.drop(*DQ_COLS))
    kept = [v]
    if getattr(scorer, "costly", False):  # the store, the dead letters and the run log read the scores: a model is applied once
        scored = scored.persist(StorageLevel.MEMORY_AND_DISK)
        kept.append(scored)
    # V06 on the model output: a null or out-of-range probability is not
    # stored as a prediction but sent to the dead-letter sink
    pmsg = rule_probability("fraud_probability")[0].message
    scored = scored.withColumn("_pmsg", pmsg)
    bad_pred = scored.filter(F.col("_pmsg").isNotNull()).withColumn("errors", F.array("_pmsg")).drop("_pmsg")
    scored = scored.filter(F.col("_pmsg").isNull()).drop("_pmsg")
    # keyed insert: of the stored keys only those files are read that may hold one of the batch
    new = keyed_append(scored, os.path.join(out, "transactions"), batch_id, key)
    stamp = dt.datetime.fromtimestamp(started, dt.timezone.utc).strftime("%Y-%m-%d %H:%M:%S")
    dead = to_dead_letter(rejected, "validation_error", "api", created_at=stamp).unionByName(
        to_dead_letter(bad_pred, "prediction_error", "model", created_at=stamp))
    if late is not None:
        late = late.withColumn("errors", F.array(F.lit("late event")))
        dead = dead.unionByName(to_dead_letter(late, "late_event", "api", created_at=stamp))
    write_batch(dead, os.path.join(out, "dead_letter"), batch_id)
    write_batch(fraud_alerts(new), os.path.join(out, "alerts"), batch_id)
    failed = [rejected, bad_pred] + ([late] if late is not None else [])
    run = log_run(v if late is None else v.select(key).unionAll(late.select(key)), failed, dag_id, f"batch_{batch_id}", dt.datetime.now(dt.timezone.utc).replace(tzinfo=None),
                  round(time.time() - started, 2))
    write_batch(run, os.path.join(out, "pipeline_runs"), batch_id)
    for x in kept:
        x.unpersist()


def run_ingest(landing: DataFrame, out: str, scorer: Callable[[DataFrame], DataFrame] = amount_scorer,
               available_now: bool = True, processing_time: str = "1 minute",
               event_time: str | None = None, delay_seconds: int = 600):
    """Start the ingestion stream; returns the StreamingQuery.

    Give the source a rate limit (``maxFilesPerTrigger`` /
    ``maxOffsetsPerTrigger``) so that a backlog arrives in batches."""
    w = (landing.writeStream.foreachBatch(lambda df, bid: ingest_batch(df, bid, out, scorer, event_time=event_time, delay_seconds=delay_seconds))
         .option("checkpointLocation", os.path.join(out, "_checkpoint")))
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime=processing_time)
    return w.start()


def split_late(batch: DataFrame, batch_id: int, marks: str, event_time: str,
               delay_seconds: int) -> tuple[DataFrame, DataFrame]:
    """(rows in time, late rows). ``marks`` holds the latest event time up to
    each of the last batches; a replayed batch is judged by the batches before it, so the
    split is the same. A row without a readable time is never late."""
    spark = batch.sparkSession
    ts = F.col(event_time).cast("string").try_cast("timestamp")
    mark = None
    if path_exists(spark, marks):
        before = spark.read.parquet(marks).select(F.col("batch_id").cast("long").alias("b"), "mark").filter(F.col("b") < batch_id)
        last, mark = before.agg(F.max("b"), F.max("mark")).first()
        if last is not None:  # a mark covers all batches up to its own; this batch may be repeated yet
            prune_batches(spark, marks, last)
    write_batch(batch.agg(F.max(ts).alias("mark")).select(F.greatest("mark", F.lit(mark).cast("timestamp")).alias("mark")), marks, batch_id)
    if mark is None:
        return batch, batch.filter(F.lit(False))
    late = F.coalesce(ts < F.lit(mark) - F.expr(f"INTERVAL {int(delay_seconds)} SECONDS"), F.lit(False))
    return batch.filter(~late), batch.filter(late)


def prune_batches(spark: SparkSession, path: str, before: int) -> None:
    """Drop the ``batch_id=`` folders under ``path`` of batches before a number."""
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    for status in fs.listStatus(p) if fs.exists(p) else []:
        name = status.getPath().getName()
        if name.startswith("batch_id=") and name[9:].isdigit() and int(name[9:]) < before:
            fs.delete(status.getPath(), True)


def model_scorer(model, version: str) -> Callable[[DataFrame], DataFrame]:
    """The trained pipeline as the stream's scorer (it takes the raw payment inputs)."""
    from paylake.operators.ml import MODEL_FEATURES
    from paylake.operators.scoring import score_batch

    def score(df: DataFrame) -> DataFrame:
        return score_batch(df, model, version, MODEL_FEATURES)

    score.costly = True
    return score


# T02 -----------------------------------------------------------------
def dedup_stream(stream: DataFrame, key: str, ts: str, delay: str = "10 minutes") -> DataFrame:
    """Drop repeats of ``key`` seen within the watermark delay (bounded state);
    the keyed insert of T01 covers repeats arriving later."""
    s = stream.withColumn(ts, F.col(ts).cast("timestamp"))
    return s.withWatermark(ts, delay).dropDuplicatesWithinWatermark([key])


# T05 -----------------------------------------------------------------
def score_stream(tx: DataFrame, features: DataFrame) -> DataFrame:
    """Stream-static: feature lookup (typed defaults when absent), rule
    score, decision. Every decision is emitted; the alert sink keeps the
    first per transaction id (unique key) via ``insert_ignore``."""
    from paylake.operators.joins import lookup_features
    from paylake.operators.scoring import decide, rule_score
    j = lookup_features(tx, features, key="customer_id")
    s = rule_score(j, amount="amount_usd")
    return s.withColumn("decision", decide("score"))


def keyed_append(rows: DataFrame, path: str, batch_id: int, key: str, buckets: int = KEY_BUCKETS) -> DataFrame:
    """Store the rows whose ``key`` is not stored yet (first one wins, as a unique index would
    enforce); replay-safe per batch id. Returns the rows stored. Every ``COMPACT_EVERY`` batches
    the store's files are merged."""
    store = KeyedStore(rows.sparkSession, path, key, buckets)
    if batch_id and batch_id % COMPACT_EVERY == 0:
        store.compact()
        store.vacuum()
    return store.insert(rows, batch_id)


def read_store(spark: SparkSession, path: str) -> DataFrame:
    """The rows of a keyed store, whichever its key."""
    return KeyedStore(spark, path, "").read()


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether a table's folder is there, on any Hadoop-compatible store."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def alerts_batch(batch: DataFrame, batch_id: int, out: str, features: DataFrame,
                 model_version: str = "rule-based") -> None:
    """T05 sink: score every request, persist one alert per transaction id."""
    scored = score_stream(batch, features)
    alerts = scored.select(
        "transaction_id", "customer_id", F.col("merchant_id") if "merchant_id" in scored.columns
        else F.lit(None).cast("string").alias("merchant_id"),
        "score", "decision", F.lit(model_version).alias("model_version"), "reasons")
    keyed_append(alerts, os.path.join(out, "fraud_alerts"), batch_id, "transaction_id")


def run_scoring(requests: DataFrame, features: DataFrame, out: str, available_now: bool = True):
    """Start the online-scoring stream (stream-static feature lookup). The
    feature documents are written once and looked up there, not recomputed in
    every micro-batch."""
    features = stored_once(features, os.path.join(out, "_features"))
    w = (requests.writeStream.foreachBatch(lambda df, bid: alerts_batch(df, bid, out, features))
         .option("checkpointLocation", os.path.join(out, "_checkpoint")))
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 seconds")
    return w.start()


def stored_once(df: DataFrame, path: str) -> DataFrame:
    """``df`` as a written table (written when the folder is not there yet)."""
    if not path_exists(df.sparkSession, os.path.join(path, "_SUCCESS")):
        df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)


def collect_stream(df: DataFrame, name: str, spark: SparkSession, output_mode: str = "append",
                   keys: list[str] | None = None) -> DataFrame:
    """Run ``df`` to completion (availableNow) into a parquet table in the
    shared checkpoint folder and return the final result as a batch frame.

    Each micro-batch lands in its own ``batch_id=`` partition. ``append``:
    the union. ``update``: a key may be re-emitted by later batches, so the
    latest version per ``keys`` wins (an upsert expressed as a read-side
    aggregate). ``complete``: every batch holds the whole result; the last
    one is it."""
    root = run_dir(spark, name)
    q = (df.writeStream.outputMode(output_mode)
         .foreachBatch(lambda b, bid: write_batch(b, os.path.join(root, "out"), bid))
         .option("checkpointLocation", os.path.join(root, "_checkpoint"))
         .trigger(availableNow=True).start())
    q.awaitTermination()
    out = _read_or_empty(spark, os.path.join(root, "out"), df.schema)
    if "batch_id" not in out.columns:
        return out
    out = out.withColumn("batch_id", F.col("batch_id").cast("long"))
    if output_mode == "update":
        if not keys:
            raise ValueError("update mode needs the result keys")
        from paylake.sources.changes import latest_per_key
        return latest_per_key(out, keys, ["batch_id"]).drop("batch_id")
    if output_mode == "complete":
        last = out.agg(F.max("batch_id").alias("_last"))
        return out.join(F.broadcast(last), out.batch_id == last._last).drop("batch_id", "_last")
    return out.drop("batch_id")


def _read_or_empty(spark: SparkSession, path: str, schema) -> DataFrame:
    """A parquet table, or an empty frame when nothing was written yet
    (works on any Hadoop-compatible store, not only local paths)."""
    from pyspark.errors import AnalysisException
    try:
        return spark.read.parquet(path)
    except AnalysisException:
        return spark.createDataFrame([], schema)
