"""Change-feed and keyed-write operators.

Plain Parquet has no MERGE, so keyed writes are expressed as set operations
(anti-join + union) that Catalyst plans as shuffle or broadcast joins. Latest
row per key is an aggregate (``max`` of a struct ordered by the change
order), which Spark pre-aggregates map-side: a key holding a third of all
changes is reduced inside each task before the shuffle. Spark plans it as a
sort aggregate, so each task sorts its own rows, on either side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SENTINEL_LOAD_TIME = "1900-01-01 00:00:00"


def _keys(k):
    return [k] if isinstance(k, str) else list(k)


def latest_per_key(df: DataFrame, keys, order_cols) -> DataFrame:
    """One row per key: the one with the greatest ``order_cols`` (remaining
    columns break exact ties, so the choice is deterministic)."""
    keys, order_cols = _keys(keys), _keys(order_cols)
    rest = [c for c in df.columns if c not in keys and c not in order_cols]
    packed = F.struct(*[F.col(c).alias(f"_o{i}") for i, c in enumerate(order_cols)],
                      *[F.col(c) for c in rest])
    g = df.groupBy(*keys).agg(F.max(packed).alias("_r"))
    return g.select(*keys, *[F.col(f"_r._o{i}").alias(c) for i, c in enumerate(order_cols)],
                    *[F.col(f"_r.{c}") for c in rest]).select(*df.columns)


# S07 -----------------------------------------------------------------
def apply_changes(base: DataFrame, changes: DataFrame, keys, order_col: str,
                  op_col: str = "op", delete_value: str = "d") -> DataFrame:
    """Insert/update/delete log -> current state per key.

    The newest change of each key (ties: the greatest by the other columns) decides: it replaces
    the key's row, adds one, or with a delete removes it; rows of other keys stay as they are.
    ``base`` has one row a key, ``changes`` its columns, the change order and the operation. Both
    are read once and meet in one join on the key, by which the changes are already laid out.
    """
    keys = _keys(keys)
    cols = list(base.columns)
    newest = latest_per_key(changes.select(*cols, *[c for c in (order_col, op_col) if c not in cols]), keys, [order_col])
    new = newest.select(*keys, *[F.col(c).alias(f"_new_{c}") for c in newest.columns if c not in keys])
    both = base.join(new, keys, "full").filter(F.col(f"_new_{op_col}").isNull() | (F.col(f"_new_{op_col}") != delete_value))
    changed = F.col(f"_new_{op_col}").isNotNull()
    return both.select(*[F.col(c) if c in keys else F.when(changed, F.col(f"_new_{c}")).otherwise(F.col(c)).alias(c) for c in cols])


# S08 -----------------------------------------------------------------
def incremental(src: DataFrame, target: DataFrame, load_col: str,
                target_load_col: str | None = None) -> DataFrame:
    """Rows of ``src`` loaded after the target's high-water mark
    (1900-01-01 when the target is empty). The mark is a scalar subquery,
    so it is computed by Spark, not on the driver."""
    tcol = target_load_col or load_col
    mark = target.select(F.coalesce(F.max(tcol), F.lit(SENTINEL_LOAD_TIME).cast(src.schema[load_col].dataType)))
    try:
        return src.filter(F.col(load_col) > mark.scalar())
    except AttributeError:  # Spark < 4: one-row join on a constant key
        m = mark.toDF("_mark").withColumn("_k", F.lit(1))
        return (src.withColumn("_k", F.lit(1)).join(F.broadcast(m), "_k")
                   .filter(F.col(load_col) > F.col("_mark")).drop("_k", "_mark"))


# S09 -----------------------------------------------------------------
def first_per_key(df: DataFrame, keys) -> DataFrame:
    """One deterministic row per key (the smallest by the other columns)."""
    keys = _keys(keys)
    rest = [c for c in df.columns if c not in keys]
    if not rest:
        return df.distinct()
    g = df.groupBy(*keys).agg(F.min(F.struct(*rest)).alias("_r"))
    return g.select(*keys, *[F.col(f"_r.{c}") for c in rest]).select(*df.columns)


def insert_ignore(target: DataFrame, batch: DataFrame, key) -> DataFrame:
    """``INSERT ... ON CONFLICT (key) DO NOTHING``: the rows of the batch whose
    key is new (one copy per key within the batch). Returns the rows to
    append; their count is the inserted count."""
    keys = _keys(key)
    return first_per_key(batch, keys).join(target.select(*keys).distinct(), keys, "left_anti")


# S10 -----------------------------------------------------------------
def upsert(target: DataFrame, updates: DataFrame, key, stamp: Column | None = None,
           version: str | None = None, order_col: str | None = None) -> DataFrame:
    """Keyed replace: target rows without an update, plus the updates
    (stamped with time and version when given). Of several updates of a key
    the one with the greatest ``order_col`` stays (ties, or without one: the
    greatest by the other columns), so keys stay unique."""
    keys = _keys(key)
    rest = [c for c in updates.columns if c not in keys]
    u = latest_per_key(updates, keys, [order_col] if order_col else rest) if rest else updates.distinct()
    if stamp is not None:
        u = u.withColumn("updated_at", stamp)
    if version is not None:
        u = u.withColumn("model_version", F.lit(version))
    kept = target.join(u.select(*keys).distinct(), keys, "left_anti")
    return kept.unionByName(u, allowMissingColumns=True)
