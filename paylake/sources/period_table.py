"""A table in folders by period (month or day of a date column), named by a manifest.

A reader of some days opens the folders of their periods and lists no others;
a writer puts new folders beside the old ones and swaps or adds them in one
commit. Readers go on with the version they opened.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paylake.session import free_shuffles
from paylake.sources.manifest import Manifest

PART_ROWS = 20_000_000  # rows that are laid out at once where a table is written in parts; shuffled, some 80 bytes each
NO_PERIOD = "__HIVE_DEFAULT_PARTITION__"  # the folder of rows without a day
KNOWN_BATCHES = 100  # a stream repeats its last batch only


class PeriodTable:
    def __init__(self, spark: SparkSession, root: str, date_col: str, grain: str = "month"):
        self.spark, self.root, self.date_col, self.grain = spark, root.rstrip("/"), date_col, grain
        self.manifest = Manifest(spark, root)

    def state(self) -> tuple[int, dict]:
        seen, state = self.manifest.read()
        return seen, state or {"periods": {}, "batches": [], "schema": None}

    def period(self) -> Column:
        return F.date_format(self._first_day(), "yyyy-MM-dd")

    def _first_day(self) -> Column:
        return F.trunc(self.date_col, "MM") if self.grain == "month" else F.col(self.date_col).cast("date")

    def periods(self) -> dict[str, list[str]]:
        """Period -> its folders; as many periods as the data span, and a folder a batch until ``compact``."""
        return self.state()[1]["periods"]

    def _write(self, rows: DataFrame, *order, derive=None) -> dict[str, list[str]]:
        name = f"data/{uuid.uuid4().hex}"
        # a day, not its text, goes through the shuffle; the folders are named alike
        laid = rows.withColumn("period", self._first_day()).hint("rebalance", "period").sortWithinPartitions("period", self.date_col, *order)
        (laid if derive is None else derive(laid)) \
            .write.partitionBy("period").parquet(f"{self.root}/{name}")
        found = (n for n in self.manifest.folders(f"{self.root}/{name}") if n.startswith("period="))
        return {n[len("period="):]: [f"{name}/{n}"] for n in found}

    def _parts(self, rows: dict[str, int]) -> list[list[str]]:
        """Periods in runs of some ``PART_ROWS`` rows, from their rows."""
        parts, n = [], 0
        for p in sorted(rows):
            if not parts or n + rows[p] > PART_ROWS:
                parts, n = [*parts, []], 0
            parts[-1].append(p)
            n += rows[p]
        return parts

    def _count(self, rows: DataFrame) -> dict[str, int]:
        return {p or NO_PERIOD: n for p, n in rows.groupBy(self.period().alias("period")).count().collect()}  # a row a period

    def _of(self, rows: DataFrame, periods: list[str]) -> DataFrame:
        """The rows of some periods."""
        return rows.filter(F.coalesce(self.period(), F.lit(NO_PERIOD)).isin(periods))

    def load_in_parts(self, rows: DataFrame, derive=None) -> None:
        """``load`` for a table that should not stand on the disk three times, as it is joined, laid out and written: what
        ``rows`` is made by has left its shuffles before rows are laid out, and they are, some periods at a time."""
        scratch = f"{self.root}/scratch-{uuid.uuid4().hex}"
        rows.write.parquet(scratch)
        free_shuffles(self.spark)
        made = self.spark.read.schema(rows.schema).parquet(scratch)
        parts, written = self._parts(self._count(made)), {}
        for part in parts:
            written |= self._write(made if len(parts) == 1 else self._of(made, part), derive=derive)
            free_shuffles(self.spark)
        seen, state = self.state()
        schema = (rows if derive is None else derive(rows)).schema
        self.manifest.commit(seen, {**state, "periods": written, "schema": schema.json()})
        self.manifest.delete(scratch)

    def load(self, rows: DataFrame, derive=None) -> None:
        """Replace the whole table; ``derive`` adds columns that follow from a row's others, after rows are shuffled and sorted."""
        seen, state = self.state()
        schema = (rows if derive is None else derive(rows)).schema
        self.manifest.commit(seen, {**state, "periods": self._write(rows, derive=derive), "schema": schema.json()})

    def append(self, rows: DataFrame, batch_id, *order, derive=None) -> list[str]:
        """Add a batch's rows, sorted by day and then ``order``; a batch that is written again changes
        nothing. ``derive`` as in ``load``. Returns its folders."""
        seen, state = self.state()
        batch = str(batch_id)
        known = {b: f for b, f in state["batches"]}
        if batch in known:
            return known[batch]
        new = self._write(rows, *order, derive=derive)
        folders = [f for v in new.values() for f in v]
        for p, f in new.items():
            state["periods"][p] = state["periods"].get(p, []) + f
        state["schema"] = state["schema"] or (rows if derive is None else derive(rows)).schema.json()
        state["batches"] = [*state["batches"], [batch, folders]][-KNOWN_BATCHES:]
        self.manifest.commit(seen, state)
        return folders

    def compact(self, most: int = 8) -> list[str]:
        """Periods with more than ``most`` folders besides those of the last batch, which may be
        asked for yet, get one. Returns the periods."""
        seen, state = self.state()
        last = set(state["batches"][-1][1]) if state["batches"] else set()
        many = [p for p, v in state["periods"].items() if len([f for f in v if f not in last]) > most]
        if many:
            old = [f for p in many for f in state["periods"][p] if f not in last]
            new = self._write(self.folders(old))
            for p in many:
                state["periods"][p] = new.get(p, []) + [f for f in state["periods"][p] if f in last]
            self.manifest.commit(seen, state)
        return many

    def vacuum(self) -> None:
        """Drop folders that the current version does not name (when no reader uses an older one)."""
        live = {f for v in self.periods().values() for f in v}
        for name in self.manifest.folders(f"{self.root}/data"):
            found = [f"data/{name}/{n}" for n in self.manifest.folders(f"{self.root}/data/{name}")]
            for f in [f for f in found if f not in live] if live & set(found) else [f"data/{name}"]:
                self.manifest.delete(f"{self.root}/{f}")

    def folders(self, paths: list[str]) -> DataFrame:
        """The rows of some folders of the table."""
        schema = T.StructType.fromJson(json.loads(self.state()[1]["schema"]))
        if not paths:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.root}/{f}" for f in paths])

    def read(self, since=None, until=None, only: list[str] | None = None) -> DataFrame:
        """Rows of the days from ``since`` to ``until``; only folders of their periods are opened."""
        low = str(since)[:7 if self.grain == "month" else 10] if since else ""
        df = self.folders([f for p, v in sorted(self.periods().items())
                           if p >= low and (not until or p <= str(until)[:10]) and (only is None or p in only) for f in v])
        if since:
            df = df.filter(F.col(self.date_col) >= F.lit(str(since)[:10]).cast("date"))
        if until:
            df = df.filter(F.col(self.date_col) <= F.lit(str(until)[:10]).cast("date"))
        return df
