"""Exact, distributed "k rows with the smallest seeded hash" selection.

Used by the training cap (L03), the stratified split (M05) and the replay
sampler (S14). ``orderBy(hash).limit(k)`` would plan a TakeOrderedAndProject:
every task keeps its k best rows and all of them are merged in ONE task, i.e.
up to k x tasks rows through a single task. Here rows are hashed into
buckets, per-bucket counts (at most groups x buckets rows) locate the bucket
where the quota is reached, rows below it are selected, rows above it are
not, and only the rows of that one bucket are ranked.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# 16,384 buckets: the one ranked bucket holds ~1/16k of a group (about
# 0.6 M rows of a 10 B-row group), the count table stays tiny.
DEFAULT_BUCKETS = 16384


def unit_hash(id_col: str, seed: int) -> Column:
    """Uniform value in [0, 1) from the MD5 of "<id>|<seed>" (first 52 bits;
    the order equals the order of the hex digest prefix)."""
    h = F.conv(F.substring(F.md5(F.concat_ws("|", F.col(id_col).cast("string"), F.lit(str(seed)))), 1, 13), 16, 10)
    return h.cast("double") / float(16 ** 13)


def select_smallest(df: DataFrame, id_col: str, seed: int, quota: Callable[[Column], Column],
                    by: list[str] | None = None, n_buckets: int = DEFAULT_BUCKETS,
                    out_col: str = "_selected") -> DataFrame:
    """Adds boolean ``out_col``: within each ``by`` group, True for exactly
    ``min(quota(n_group), n_group)`` rows - those with the smallest
    (hash, id). ``quota`` maps the group size column to the wanted count."""
    by = list(by or [])
    u = unit_hash(id_col, seed)
    x = df.withColumns({"_u": u, "_b": F.least(F.floor(u * n_buckets), F.lit(n_buckets - 1)).cast("int")})
    counts = x.groupBy(*by, "_b").agg(F.count(F.lit(1)).alias("_c"))
    # counts: at most (groups x n_buckets) rows, so these windows are small
    w = W.partitionBy(*by).orderBy("_b").rowsBetween(W.unboundedPreceding, W.currentRow)
    c = counts.withColumns({"_cum": F.sum("_c").over(w), "_n": F.sum("_c").over(W.partitionBy(*by))})
    c = c.withColumn("_k", quota(F.col("_n")).cast("long")).withColumn("_before", F.col("_cum") - F.col("_c"))
    groups = c.select(*by, "_n", "_k").distinct()
    cut = c.filter((F.col("_before") < F.col("_k")) & (F.col("_cum") >= F.col("_k"))) \
           .select(*by, F.col("_b").alias("_cut"), (F.col("_k") - F.col("_before")).alias("_need"))
    # groups and cut have one row per group: bounded, broadcast
    info = groups.join(F.broadcast(cut), by, "left") if by else groups.withColumn("_j", F.lit(1)).join(
        F.broadcast(cut.withColumn("_j", F.lit(1))), "_j", "left").drop("_j")
    x = x.join(F.broadcast(info), by, "left") if by else x.withColumn("_j", F.lit(1)).join(
        F.broadcast(info.withColumn("_j", F.lit(1))), "_j", "left").drop("_j")
    in_cut = F.coalesce(F.col("_b") == F.col("_cut"), F.lit(False))
    ranked = x.filter(in_cut).withColumn(
        out_col, F.row_number().over(W.partitionBy(*by).orderBy("_u", id_col)) <= F.col("_need"))
    rest = x.filter(~in_cut).withColumn(
        out_col, F.when(F.col("_cut").isNull(), F.col("_k") >= F.col("_n")).otherwise(F.col("_b") < F.col("_cut")))
    return ranked.unionByName(rest).drop("_u", "_b", "_cut", "_need", "_n", "_k")
