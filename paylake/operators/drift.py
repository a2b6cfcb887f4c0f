"""Population stability index.

Bins are 10 equal-width intervals on the *baseline's* [min, max], the last
one right-closed. Current values outside that range are not counted in any
bin but stay in the denominator; a zero share becomes 1e-6.

All features are handled in one pass: both inputs are stacked into a long
(feature, value, side) form, the baseline range is one aggregate per feature,
and the binned counts are one aggregate over (feature, side, bin). Everything
after that works on at most features x 2 x (bins + 1) rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

EPS = 1e-6
DRIFT_THRESHOLD = 0.2


def _long(df: DataFrame, cols: list[str], side: str) -> DataFrame:
    pairs = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("x")) for c in cols])
    return (df.select(F.explode(pairs).alias("r")).select("r.*")
              .filter(F.col("x").isNotNull()).withColumn("side", F.lit(side)))


def psi_many(baseline: DataFrame, current: DataFrame, cols: list[str], bins: int = 10) -> DataFrame:
    """One row per feature: feature, psi (6 dp), drift flag."""
    b, c = _long(baseline, cols, "e"), _long(current, cols, "a")
    rng = b.groupBy("feature").agg(F.min("x").alias("lo"), F.max("x").alias("hi"))  # one row per feature
    x, lo, hi = F.col("x"), F.col("lo"), F.col("hi")
    width = (hi - lo) / bins
    binx = F.when(hi == lo, F.lit(0)).otherwise(F.least(F.floor((x - lo) / width), F.lit(bins - 1))).cast("int")
    inside = (x >= lo) & (x <= hi)
    counts = (b.unionByName(c).join(F.broadcast(rng), "feature")
               .groupBy("feature", "side", F.when(inside, binx).alias("bin"))
               .agg(F.count(F.lit(1)).alias("cnt")))
    # from here on: at most features x 2 x (bins + 1) rows
    tot = counts.groupBy("feature").agg(
        F.sum(F.when(F.col("side") == "e", F.col("cnt"))).alias("n_e"),
        F.sum(F.when(F.col("side") == "a", F.col("cnt"))).alias("n_a"))
    per_bin = counts.filter(F.col("bin").isNotNull()).groupBy("feature", "bin").agg(
        F.sum(F.when(F.col("side") == "e", F.col("cnt"))).alias("c_e"),
        F.sum(F.when(F.col("side") == "a", F.col("cnt"))).alias("c_a"))
    spine = rng.select("feature", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    j = spine.join(per_bin, ["feature", "bin"], "left").join(tot, "feature", "left")
    pe = F.coalesce(F.col("c_e"), F.lit(0)) / F.greatest(F.coalesce(F.col("n_e"), F.lit(0)), F.lit(1))
    pa = F.coalesce(F.col("c_a"), F.lit(0)) / F.greatest(F.coalesce(F.col("n_a"), F.lit(0)), F.lit(1))
    pe = F.when(pe == 0, F.lit(EPS)).otherwise(pe)
    pa = F.when(pa == 0, F.lit(EPS)).otherwise(pa)
    terms = j.select("feature", ((pa - pe) * F.log(pa / pe)).alias("t"))
    return terms.groupBy("feature").agg(F.sum("t").alias("psi")).select(
        "feature", F.round("psi", 6).alias("psi"), (F.col("psi") > DRIFT_THRESHOLD).alias("drift"))


def psi(baseline: DataFrame, current: DataFrame, col: str, bins: int = 10) -> DataFrame:
    """One row: feature, psi, drift flag."""
    return psi_many(baseline, current, [col], bins)
