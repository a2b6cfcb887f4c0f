"""Ratio-controlled replay of a labelled table."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from paylake.functions.sampling import select_smallest, unit_hash


def replay_sample(df: DataFrame, label: str, id_col: str, n: int, ratio: float = 0.3, seed: int = 42,
                  as_of=None, ts_col: str = "trans_date_trans_time") -> DataFrame:
    """Pick exactly round(n * ratio) positives and the rest negatives, each
    class in a seeded hash order (deterministic; a class with fewer rows than
    its share is repeated as often as needed, an empty one is an error), drop
    the label, re-key ``REPLAY-<epoch ms>-<i>-<first 16 of id>`` and re-stamp
    the event time with ``as_of``.

    Each class is selected with ``functions.sampling.select_smallest``
    (bucketed, exact, no single-task merge of per-task top-k lists); only
    the n sampled rows are numbered, in one ordered pass (n is the requested
    sample size, the feature).
    """
    n_pos = int(round(n * ratio))
    n_neg = n - n_pos
    x = df.withColumn("_pos", F.coalesce((F.col(label) == 1).cast("int"), F.lit(0)))
    have = {r["_pos"]: r["count"] for r in x.groupBy("_pos").count().collect()}  # two rows
    copies = {}
    for k, want in ((1, n_pos), (0, n_neg)):
        if want and not have.get(k):
            raise ValueError(f"no rows with label {k} to replay")
        copies[k] = -(-want // have[k]) if want else 1
    x = x.withColumn("_copy", F.explode(F.sequence(F.lit(0), F.when(F.col("_pos") == 1, copies[1] - 1).otherwise(copies[0] - 1))))
    x = x.withColumn("_rid", F.when(F.col("_copy") == 0, F.col(id_col).cast("string"))
                     .otherwise(F.concat_ws("#", F.col(id_col).cast("string"), F.col("_copy").cast("string"))))
    x = select_smallest(x, "_rid", seed, lambda cnt: F.when(F.col("_pos") == 1, F.lit(n_pos)).otherwise(F.lit(n_neg)),
                        by=["_pos"])
    picked = x.filter("_selected").drop("_selected").withColumn("_h", unit_hash("_rid", seed))
    i = F.row_number().over(W.orderBy(F.col("_pos").desc(), "_h", "_rid")) - 1
    a = as_of if isinstance(as_of, dt.datetime) else dt.datetime.fromisoformat(str(as_of))
    ms = F.unix_millis(F.lit(a).cast("timestamp"))
    out = picked.withColumn("_i", i).withColumns({
        "original_id": F.col(id_col),
        "is_fraud_src": F.col(label),
        id_col: F.concat_ws("-", F.lit("REPLAY"), ms.cast("string"), F.col("_i").cast("string"),
                            F.substring(F.col(id_col).cast("string"), 1, 16)),
    })
    if ts_col in out.columns:
        out = out.withColumn(ts_col, F.lit(a.isoformat(sep=" ", timespec="seconds")))
    return out.drop("_h", "_i", "_pos", "_copy", "_rid", label)
