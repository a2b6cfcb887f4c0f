"""Aggregation helpers.

All are ordinary ``groupBy().agg()`` plans, so Spark runs a partial
(map-side) aggregate before the exchange; only one row per group and task
crosses the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from paylake.functions.scalar import _c


def _keys(keys):
    return [keys] if isinstance(keys, str) else list(keys or [])


# A01
def n_rows(df: DataFrame, keys, name: str = "n_rows") -> DataFrame:
    return df.groupBy(*_keys(keys)).agg(F.count(F.lit(1)).alias(name))


# A02
def n_distinct(df: DataFrame, keys, col: str, approx: bool = False, name: str = "n_distinct") -> DataFrame:
    agg = F.approx_count_distinct(col) if approx else F.countDistinct(col)
    return df.groupBy(*_keys(keys)).agg(agg.alias(name))


# A03
def n_distinct_if(df: DataFrame, keys, col: str, cond: Column, name: str = "n_distinct_if") -> DataFrame:
    """Count distinct ``col`` where ``cond`` holds.

    Planned as distinct (keys, col, flag) first and a plain sum after, so
    Catalyst does not add an ``Expand`` per distinct expression.
    """
    k = _keys(keys)
    flagged = df.select(*k, F.col(col), F.when(cond, 1).otherwise(0).alias("_f"))
    per_key = flagged.groupBy(*k, col).agg(F.max("_f").alias("_f"))
    return per_key.groupBy(*k).agg(F.sum("_f").cast("long").alias(name))


# A04
def totals(df: DataFrame, keys, col: str) -> DataFrame:
    return df.groupBy(*_keys(keys)).agg(
        F.sum(col).alias(f"sum_{col}"), F.avg(col).alias(f"avg_{col}"), F.max(col).alias(f"max_{col}"))


# A05
def sum_if(cond: Column, value=1) -> Column:
    v = F.lit(value) if not isinstance(value, (Column, str)) else _c(value)
    return F.sum(F.when(cond, v).otherwise(F.lit(0)))


def count_if(cond: Column) -> Column:
    return F.count_if(cond)


# A06
def pctl(col, q: float = 0.95) -> Column:
    """Exact continuous percentile (buffers the group's values)."""
    return F.percentile(_c(col).cast("double"), F.lit(q))


def pctl_by(df, by: list[str], col: str, q: float, out: str, buckets: int = 4096):
    """Exact continuous percentile per group without a buffer of its values:
    counts per value, then per equal-width bucket of values (at most
    ``buckets`` rows a group) to find the buckets of the two ranks around q,
    and only their values are ranked. Nulls don't count; a group of nulls gives null."""
    v = df.select(*by, _c(col).cast("double").alias("_v")).groupBy(*by, "_v").agg(F.count(F.lit(1)).alias("_c"))
    ends = v.groupBy(*by).agg(F.min("_v").alias("_lo"), F.max("_v").alias("_hi"), F.sum(F.when(F.col("_v").isNotNull(), F.col("_c"))).alias("_n"))
    same = F.lit(True)
    for b in by:
        same = same & F.col(b).eqNullSafe(F.col(f"_k_{b}"))
    key = lambda x: x.withColumnsRenamed({b: f"_k_{b}" for b in by})
    at = (F.col("_v") - F.col("_lo")) / F.nullif(F.col("_hi") - F.col("_lo"), F.lit(0.0)) * buckets
    x = v.filter("_v is not null").join(key(ends), same).withColumn("_b", F.coalesce(F.least(F.floor(at), F.lit(buckets - 1)), F.lit(0))) \
        .drop(*[f"_k_{b}" for b in by])
    w = W.partitionBy(*by).orderBy("_b")
    sums = x.groupBy(*by, "_b", "_n").agg(F.sum("_c").alias("_m")).withColumn("_before", F.sum("_m").over(w) - F.col("_m"))
    rank = F.lit(q) * (F.col("_n") - 1)
    lo, hi = F.floor(rank), F.ceil(rank)
    hit = sums.filter((F.col("_before") <= hi) & (F.col("_before") + F.col("_m") > lo)).select(*by, F.col("_b").alias("_hb"), "_before")
    near = x.join(key(hit), same & (F.col("_b") == F.col("_hb"))).drop(*[f"_k_{b}" for b in by])
    w = W.partitionBy(*by, "_b").orderBy("_v")
    near = near.withColumn("_from", F.col("_before") + F.sum("_c").over(w) - F.col("_c"))
    pick = lambda r: F.max(F.when((F.col("_from") <= r) & (F.col("_from") + F.col("_c") > r), F.col("_v")))
    found = near.groupBy(*by).agg(pick(lo).alias("_a"), pick(hi).alias("_z"), F.max(rank - lo).alias("_f")) \
        .select(*by, (F.col("_a") + (F.col("_z") - F.col("_a")) * F.col("_f")).alias(out))
    return ends.select(*by).join(key(found), same, "left").select(*by, out)


def pctl_approx(col, q: float = 0.95, accuracy: int = 10000) -> Column:
    """Bounded-memory percentile for skewed groups (opt-in)."""
    return F.percentile_approx(_c(col).cast("double"), q, accuracy)


# A07
def has_any(cond: Column) -> Column:
    """Group-level membership flag without collecting a set."""
    return F.max(F.when(cond, 1).otherwise(0))


def set_size(df: DataFrame, keys, col: str, name: str = "set_size") -> DataFrame:
    return df.groupBy(*_keys(keys)).agg(F.countDistinct(col).alias(name))


# A08
def two_level(df: DataFrame, inner_keys, outer_keys, inner_aggs, outer_aggs) -> DataFrame:
    inner = df.groupBy(*_keys(inner_keys)).agg(*inner_aggs)
    return inner.groupBy(*_keys(outer_keys)).agg(*outer_aggs)


# A09
def distinct_keys(df: DataFrame, keys) -> DataFrame:
    return df.select(*_keys(keys)).distinct()


# A10
def pct(num, den, scale: int = 2, floor_den: bool = False) -> Column:
    """100 * num / den rounded; den 0 -> null, or den floored at 1."""
    n = _c(num).cast("double")
    if floor_den:
        return F.round(n / F.greatest(_c(den), F.lit(1)).cast("double") * 100, scale)
    return F.round(n / F.nullif(_c(den), F.lit(0)).cast("double") * 100, scale)


# A11
def histogram(df: DataFrame, col: str, lo: float, hi: float, n: int = 10) -> DataFrame:
    """Equal-width bins over [lo, hi], last bin right-closed, out-of-range dropped."""
    width = (hi - lo) / n if hi > lo else 1.0
    b = F.least(F.floor((F.col(col) - F.lit(lo)) / F.lit(width)), F.lit(n - 1)).cast("int")
    inside = (F.col(col) >= lo) & (F.col(col) <= hi)
    return df.filter(inside).groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


# A12
def label_rate(df: DataFrame, keys, label: str = "label", name: str = "label_rate") -> DataFrame:
    return df.groupBy(*_keys(keys)).agg(F.avg(F.col(label).cast("double")).alias(name))
