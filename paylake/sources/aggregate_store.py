"""Sums kept up to date: a partial aggregate per batch, merged when read.

Every part is a written table that the manifest names, so a batch that is
written again changes nothing, and ``compact`` swaps many parts for their sum
in one commit.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paylake.sources.manifest import Manifest

KNOWN_BATCHES = 100  # a stream repeats its last batch only


class AggregateStore:
    """``keys`` and additive columns ``sums`` (counts, sums); columns ``lows`` and ``highs`` keep the
    least and greatest. With ``by``, one of the keys, parts are sorted by it, so that a reader of
    few of its values skips row groups."""

    def __init__(self, spark: SparkSession, root: str, keys: list[str], sums: list[str] = (), lows: list[str] = (),
                 highs: list[str] = (), by: str | None = None):
        self.spark, self.root, self.keys, self.by = spark, root.rstrip("/"), list(keys), by
        self.how = [*((c, F.sum) for c in sums), *((c, F.min) for c in lows), *((c, F.max) for c in highs)]
        self.manifest = Manifest(spark, root)

    def state(self) -> tuple[int, dict]:
        seen, state = self.manifest.read()
        return seen, state or {"parts": [], "batches": [], "schema": None}

    def add(self, partial: DataFrame, batch_id) -> None:
        """Add a batch's rows; ``partial`` is aggregated here, so it need not be."""
        seen, state = self.state()
        batch = str(batch_id)
        if batch in state["batches"]:
            return
        merged = self._merge(partial)
        state["parts"].append({"path": self._write(merged), "batch": batch})
        state["schema"] = state["schema"] or merged.schema.json()
        state["batches"] = [*state["batches"], batch][-KNOWN_BATCHES:]
        self.manifest.commit(seen, state)

    def _merge(self, rows: DataFrame) -> DataFrame:
        out = rows.groupBy(*self.keys).agg(*[f(c).alias(c) for c, f in self.how])
        return out.select(*self.keys, *[F.col(c).cast(rows.schema[c].dataType).alias(c) for c, _ in self.how])

    def _write(self, df: DataFrame) -> str:
        path = f"data/{uuid.uuid4().hex}"
        if self.by:
            df.repartitionByRange(*self.keys).sortWithinPartitions(self.by).write.parquet(f"{self.root}/{path}")
        else:
            df.hint("rebalance").write.parquet(f"{self.root}/{path}")
        return path

    def _parts(self, state: dict, parts: list[dict]) -> DataFrame:
        return self.spark.read.schema(T.StructType.fromJson(json.loads(state["schema"]))).parquet(
            *[f"{self.root}/{p['path']}" for p in parts])

    def read(self, where=None) -> DataFrame | None:
        """The merged sums of all batches (None before the first); ``where`` is a condition on the keys."""
        _, state = self.state()
        if not state["parts"]:
            return None
        rows = self._parts(state, state["parts"])
        return self._merge(rows if where is None else rows.filter(where))

    def compact(self, most: int = 8) -> bool:
        """Swap the parts for one once there are more than ``most``."""
        seen, state = self.state()
        if len(state["parts"]) <= most:
            return False
        old = state["parts"]
        state["parts"] = [{"path": self._write(self._merge(self._parts(state, old))), "batch": None}]
        self.manifest.commit(seen, state)
        return True

    def vacuum(self) -> None:
        """Drop parts that the current version does not name (when no reader uses an older one)."""
        _, state = self.state()
        live = {p["path"] for p in state["parts"]}
        for name in self.manifest.folders(f"{self.root}/data"):
            if f"data/{name}" not in live:
                self.manifest.delete(f"{self.root}/data/{name}")
        self.manifest.prune()
