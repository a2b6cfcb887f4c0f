"""Sinks: dead letter, run log, partitioned lake export.

Writes are idempotent per batch: each sink writes a batch into its own
``batch_id=`` partition with dynamic partition overwrite, so a retried batch
replaces its earlier attempt instead of appending twice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


# S11 -----------------------------------------------------------------
def to_dead_letter(rejected: DataFrame, error_type: str = "validation_error", source: str = "api",
                   errors_col: str = "errors", created_at=None) -> DataFrame:
    """Raw record as JSON + error type + messages joined with '; ' + source."""
    data_cols = [c for c in rejected.columns
                 if c not in (errors_col, "schema_errors", "rule_errors", "data_quality_status")]
    return rejected.select(
        F.to_json(F.struct(*[F.col(c) for c in data_cols])).alias("raw_data"),
        F.lit(error_type).alias("error_type"),
        F.array_join(F.col(errors_col), "; ").alias("error_message"),
        F.lit(source).alias("source"),
        (F.lit(created_at).cast("timestamp") if created_at else F.current_timestamp()).alias("created_at"))


# S12 -----------------------------------------------------------------
def log_run(processed: DataFrame, failed: DataFrame | list[DataFrame], dag_id: str, task_id: str, execution_date,
            duration_seconds: float, error_message: str | None = None) -> DataFrame:
    """One-row run log from two counts; built as an aggregate, never collected.
    ``failed`` may be several frames (validation and prediction errors)."""
    p = processed.agg(F.count(F.lit(1)).alias("records_processed"))
    frames = [x.select(F.lit(1).alias("_one")) for x in (failed if isinstance(failed, list) else [failed])]
    every = frames[0]
    for x in frames[1:]:
        every = every.unionAll(x)
    f = every.agg(F.count(F.lit(1)).alias("records_failed"))
    # two one-row aggregates joined on a constant key
    j = p.withColumn("_k", F.lit(1)).join(f.withColumn("_k", F.lit(1)), "_k").drop("_k")
    return j.select(
        F.lit(dag_id).alias("dag_id"), F.lit(task_id).alias("task_id"),
        F.lit(execution_date).cast("timestamp").alias("execution_date"),
        F.when(F.col("records_failed") > 0, "partial").otherwise("success").alias("status"),
        F.col("records_processed").alias("records_processed"),
        F.col("records_failed").alias("records_failed"),
        F.lit(duration_seconds).cast("decimal(10,2)").alias("duration_seconds"),
        F.lit(error_message).cast("string").alias("error_message"))


def write_batch(df: DataFrame, path: str, batch_id: int | str, fmt: str = "parquet", buckets: str | None = None) -> None:
    """Replay-safe append: the batch lands in its own partition, replaced on
    retry (below ``buckets`` partitions when the table has them)."""
    (df.withColumn("batch_id", F.lit(str(batch_id)))
       .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
       .partitionBy(*([buckets] if buckets else []), "batch_id").format(fmt).save(path))


# S13 -----------------------------------------------------------------
def write_lake(df: DataFrame, path: str, date_col: str, compression: str = "snappy",
               mode: str = "overwrite", max_records_per_file: int = 5_000_000) -> None:
    """Partitioned export laid out year/month/day.

    Rows are clustered by the partition columns first so each task writes a
    few large files per day instead of one small file per (task, day). The
    REBALANCE hint lets AQE split a hot day over several writers by measured
    size and merge small ones, at every size of input.
    """
    d = F.col(date_col)
    out = df.withColumns({"year": F.year(d), "month": F.month(d), "day": F.dayofmonth(d)})
    (out.hint("rebalance", "year", "month", "day").sortWithinPartitions("year", "month", "day")
        .write.mode(mode).option("partitionOverwriteMode", "dynamic")
        .option("compression", compression).option("maxRecordsPerFile", max_records_per_file)
        .partitionBy("year", "month", "day").parquet(path))


# P09 -----------------------------------------------------------------
def write_skipping(df: DataFrame, path: str, by: list[str], bloom: dict[str, int] | None = None, row_group_rows: int = 1_000_000,
                   row_group_bytes: int = 128 << 20) -> None:
    """Write rows sorted by ``by`` over all files, so that a filter on its first columns skips files
    and row groups by their statistics; equality on a column of ``bloom`` (column -> distinct
    values expected) also by Bloom filters. Give ``by`` a last column that tells equal rows apart,
    so that a frequent value is spread over files."""
    w = df.repartitionByRange(*by).sortWithinPartitions(*by).write.option("parquet.block.size", row_group_bytes) \
        .option("parquet.block.row.count.limit", row_group_rows)
    for c, n in (bloom or {}).items():
        w = w.option(f"parquet.bloom.filter.enabled#{c}", "true").option(f"parquet.bloom.filter.expected.ndv#{c}", n)
    w.option("compression", "zstd").parquet(path)
