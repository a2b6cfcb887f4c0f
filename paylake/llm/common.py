"""Shared helpers: written intermediates, code shipping, connected components."""

from __future__ import annotations

import uuid
from itertools import count

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paylake.session import checkpoint_root, ship


def release() -> None:
    """Give memory that this worker has freed back to the system (workers live on between tasks)."""
    import ctypes

    import pyarrow as pa
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def tidy(run):
    """A task's function that gives its memory back at the end."""
    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            release()
    return wrapped


class Scratch:
    """Tables written under the shared checkpoint folder.

    A written table cuts lineage: what reads it survives the loss of any
    executor. ``drop`` removes tables that nothing reads any more.
    """

    def __init__(self, spark: SparkSession, tag: str):
        ship(spark)
        self.spark = spark
        self.root = f"{checkpoint_root(spark).rstrip('/')}/paylake-{tag}-{uuid.uuid4().hex}"

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        df.write.option("compression", "zstd").parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        jvm = self.spark._jvm
        for n in names:
            p = jvm.org.apache.hadoop.fs.Path(self.path(n))
            p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)


def with_own_columns(docs: DataFrame, run) -> DataFrame:
    """``run`` over ``docs`` with the columns it does not know under names that clash with none of
    its own; its result has the columns of ``docs`` under their names again."""
    known = {"doc_id", "text", "n_chars"}
    inner = [c if c in known else f"extra_{i}" for i, c in enumerate(docs.columns)]
    return run(docs.toDF(*inner)).select(*[F.col(i).alias(c) for i, c in zip(inner, docs.columns, strict=True)])


def raw_text(col: str = "text"):
    """The UTF-8 bytes of a text; null counts as empty."""
    return F.coalesce(F.col(col).cast("binary"), F.lit(b"").cast("binary"))


def crc32_of_id(col: str = "doc_id"):
    """crc32 of the id written as text (null id: of the empty text)."""
    return F.crc32(F.coalesce(F.col(col).cast("string"), F.lit("")).cast("binary"))


def connected_components(edges: DataFrame, scratch: Scratch, tag: str = "cc") -> DataFrame:
    """(node, component): the smallest node reachable over ``edges`` (a, b).

    Alternating large-star / small-star: every round relinks each node's
    larger neighbours, then its smaller ones, to its smallest neighbour, until
    nothing changes. Only minima per node are aggregated (partially, before
    the shuffle), so a hub with a third of all links is no single group; the
    join with the minima is one that AQE splits. Nodes without links are not
    returned. Self links and repeated links are ignored.
    """
    lo, hi = F.least("a", "b"), F.greatest("a", "b")
    cur = scratch.save(edges.filter("a <> b").select(hi.alias("u"), lo.alias("v")).distinct(), f"{tag}0")
    stamp = F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))
    before = cur.agg(*stamp).first()
    for i in count(1):
        both = cur.unionAll(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        m = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(m, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        m = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(m, "u").select(
            F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        nxt = scratch.save(small.distinct(), f"{tag}{i}")
        after = nxt.agg(*stamp).first()
        scratch.drop(f"{tag}{i - 1}")
        if after == before:
            break
        cur, before = nxt, after
    roots = nxt.select(F.col("v").alias("node")).distinct().withColumn("component", F.col("node"))
    return nxt.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(roots)
