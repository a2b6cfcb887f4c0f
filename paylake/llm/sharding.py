"""Shards of documents by best-fit-decreasing bin packing of indivisible groups.

Rows of equal text form a group that stays together; its size is the sum of
its rows'. Groups, largest first, go into the open shard with the least room
that still holds them, found in a balanced tree over remaining capacities.
With a fixed capacity this gives few shards; for a fixed number of shards the
least capacity is searched with which best fit needs no more of them, and
groups that are larger than an even share of what is left get a shard of
their own first.

Best fit does not ask which of several groups of one size it places, so the
plan is made from the counts of sizes alone. For the plan a size is rounded up
to 14 significant bits: at most 2^13 values per power of two, under half a
million numbers however many documents there are, and a shard is under 1/8192
fuller or emptier than with exact sizes (sizes under 16 KiB are exact). Groups
then take their places by their rank among equal sizes.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from paylake.llm.common import Scratch, raw_text, ship, tidy

SHARDS = 40
ROW_BYTES = 16
ROWS_PER_WINDOW = 100_000
SIGNIFICANT_BITS = 14
HOT_SHARE = 1000  # a group with more than one row in so many is hot; there are fewer than that


class RoomTree:
    """A balanced (AA) tree over remaining capacities; a node holds the shards that have that room."""

    class Node:
        __slots__ = ("room", "shards", "level", "left", "right")

        def __init__(self, room, shard):
            self.room, self.shards, self.level, self.left, self.right = room, [shard], 1, None, None

    def __init__(self):
        self.root = None

    def tightest(self, size: int) -> int | None:
        """The least room that is ``size`` at least."""
        node, best = self.root, None
        while node:
            if node.room < size:
                node = node.right
            else:
                best, node = node.room, node.left
        return best

    def add(self, room: int, shard: int) -> None:
        self.root = self._add(self.root, room, shard)

    def take(self, room: int) -> int:
        """Remove and return a shard with exactly that room."""
        node = self.root
        while node.room != room:
            node = node.right if node.room < room else node.left
        shard = node.shards.pop()
        if not node.shards:
            self.root = self._remove(self.root, room)
        return shard

    @staticmethod
    def _skew(n):
        if n and n.left and n.left.level == n.level:
            up = n.left
            n.left, up.right = up.right, n
            return up
        return n

    @staticmethod
    def _split(n):
        if n and n.right and n.right.right and n.right.right.level == n.level:
            up = n.right
            n.right, up.left = up.left, n
            up.level += 1
            return up
        return n

    def _add(self, n, room, shard):
        if n is None:
            return self.Node(room, shard)
        if room == n.room:
            n.shards.append(shard)
            return n
        if room < n.room:
            n.left = self._add(n.left, room, shard)
        else:
            n.right = self._add(n.right, room, shard)
        return self._split(self._skew(n))

    def _remove(self, n, room):
        if n is None:
            return None
        if room < n.room:
            n.left = self._remove(n.left, room)
        elif room > n.room:
            n.right = self._remove(n.right, room)
        elif n.left is None:
            return n.right
        elif n.right is None:
            return n.left
        else:  # the next larger room takes this node's place
            heir = n.right
            while heir.left:
                heir = heir.left
            n.room, n.shards = heir.room, heir.shards
            n.right = self._remove(n.right, heir.room)
        level = 1 + min(n.left.level if n.left else 0, n.right.level if n.right else 0)
        if level < n.level:
            n.level = level
            if n.right and n.right.level > level:
                n.right.level = level
        n = self._skew(n)
        n.right = self._skew(n.right)
        if n.right:
            n.right.right = self._skew(n.right.right)
        n = self._split(n)
        n.right = self._split(n.right)
        return n


def plan_size(size: int) -> int:
    """A size rounded up to SIGNIFICANT_BITS bits."""
    shift = max(0, size.bit_length() - SIGNIFICANT_BITS)
    return -(-size >> shift) << shift


def _plan_size(size: str) -> Column:
    unit = f"shiftleft(1L, greatest(0, length(bin({size})) - {SIGNIFICANT_BITS}))"
    return F.expr(f"(({size} + {unit} - 1) div {unit}) * {unit}")


def pack(sizes: list[tuple[int, int]], capacity: int, most: int | None = None) -> list[tuple[int, int, int, int]] | None:
    """Rows (size, first rank, groups, shard) of best fit over ``sizes`` (size, count), largest
    first; None if it needs more than ``most`` shards. The shard with the least room that holds
    a group still is the one with the least room after taking it, so it takes all that it can."""
    rooms, plan, shards = RoomTree(), [], 0
    for size, count in sizes:
        if size > capacity:
            return None
        rank = 0
        while rank < count:
            room = rooms.tightest(size)
            if room is None:
                if shards == most:
                    return None
                room, shard, shards = capacity, shards, shards + 1
            else:
                shard = rooms.take(room)
            n = min(count - rank, room // size)
            plan.append((size, rank, n, shard))
            if room > n * size:
                rooms.add(room - n * size, shard)
            rank += n
    return plan


def plan_shards(sizes: list[tuple[int, int]], shards: int) -> list[tuple[int, int, int, int]]:
    """A plan for at most ``shards`` shards with the least capacity that a bisection finds;
    groups beyond an even share of the rest are set apart, each in a shard of its own."""
    left, plan = sorted(((s, n) for s, n in sizes if n), reverse=True), []
    total, free, apart = sum(s * n for s, n in left), shards, Counter()
    while left and free > 1 and left[0][0] * free > total:
        size, n = left.pop(0)
        plan.append((size, apart[size], 1, shards - free))
        apart[size], total, free = apart[size] + 1, total - size, free - 1
        if n > 1:
            left.insert(0, (size, n - 1))
    if not left:
        return plan
    low = max(left[0][0], -(-total // free))
    step = 0
    while (best := pack(left, low + step, free)) is None:
        step = 2 * step + max(1, low >> 24)
    high, low = low + step, low + (step + 1) // 2
    while low < high:  # ends at a capacity that fits; best fit is nearly, not strictly, monotone
        middle = (low + high) // 2
        if (p := pack(left, middle, free)) is None:
            low = middle + 1
        else:
            high, best = middle, p
    return plan + [(s, r + apart[s], n, b + shards - free) for s, r, n, b in best]


def _rows(docs: DataFrame, keep: list[str]) -> DataFrame:
    text = raw_text()
    return docs.select(
        *[F.col(c) for c in keep], (F.octet_length(text).cast("long") + ROW_BYTES).alias("_size"), F.crc32(text).alias("_crc"),
        F.unhex(F.sha2(text, 256)).alias("_group"), F.monotonically_increasing_id().alias("_row"))


def _numbered(df: DataFrame, by: list[str], salt: Column, order: list[str], total: int, name: str) -> DataFrame:
    """``df`` with the place of each row among those of equal ``by``, gapless from 0: rows are
    ranked within salted parts, and the parts' counts added up, so no key is one task."""
    salted = df.withColumn("_salt", F.pmod(salt, F.lit(max(1, math.ceil(total / ROWS_PER_WINDOW)))))
    before = salted.groupBy(*by, "_salt").count().withColumn(
        "_before", F.sum("count").over(W.partitionBy(*by).orderBy("_salt")) - F.col("count")).drop("count")
    rank = F.row_number().over(W.partitionBy(*by, "_salt").orderBy(*order)) - 1
    return salted.withColumn(name, rank).join(before, [*by, "_salt"]) \
        .withColumn(name, (F.col(name) + F.col("_before")).cast("long")).drop("_salt", "_before")


def _assign(rows: DataFrame, scratch: Scratch, planner) -> DataFrame:
    """``rows`` with ``shard`` and ``slot``; ``planner`` makes the plan from (size, count) pairs."""
    spark = rows.sparkSession
    groups = scratch.save(
        rows.groupBy("_group").agg(F.count(F.lit(1)).alias("_n"), F.sum("_size").alias("_bytes"))
        .withColumn("_plan", _plan_size("_bytes")), "groups")
    sizes = sorted(((r[0], r[1]) for r in groups.groupBy("_plan").count().collect()), reverse=True)  # bounded, see above
    plan = np.array(sorted(planner(sizes)), dtype=np.int64).reshape(-1, 4)
    shared = spark.sparkContext.broadcast(plan)
    n_groups = sum(n for _, n in sizes)
    ranked = _numbered(groups, ["_plan"], F.xxhash64("_group"), ["_group"], n_groups, "_rank")

    def place(batches):
        p = shared.value
        kinds, code = np.unique(p[:, 0], return_inverse=True)
        keys = (code.astype(np.int64) << 44) + p[:, 1]
        for b in batches:
            size, rank = b.column("_plan").to_numpy(), b.column("_rank").to_numpy()
            at = np.searchsorted(keys, (np.searchsorted(kinds, size) << 44) + rank, side="right") - 1
            yield pa.RecordBatch.from_arrays(
                [b.column("_group"), b.column("_n"), pa.array(p[at, 3].astype(np.int32))], ["_group", "_n", "shard"])

    placed = scratch.save(ranked.select("_group", "_n", "_plan", "_rank").mapInArrow(
        tidy(place), "_group binary, _n long, shard int"), "placed")
    total = rows.count()
    hot = F.broadcast(placed.filter(F.col("_n") * HOT_SHARE > total).select("_group", F.col("shard").alias("_hot")))
    marked = rows.join(hot, "_group", "left")
    cool = marked.filter("_hot IS NULL").drop("_hot").join(placed.drop("_n"), "_group")
    all_rows = marked.filter("_hot IS NOT NULL").withColumnRenamed("_hot", "shard").unionByName(cool)
    return _numbered(all_rows, ["shard"], F.xxhash64("_row"), ["_row"], total, "slot")


def assign(docs: DataFrame, shards: int | None = SHARDS, capacity: int | None = None, with_text: bool = False) -> DataFrame:
    """A row per document: doc_id, size (UTF-8 bytes of the text and 16), text_crc32, shard (from
    0), slot (gapless from 0 in each shard); with ``with_text`` also the text.

    ``capacity`` asks for as few shards as best fit needs of that many bytes (a larger group is
    an error), else there are ``shards`` shards of nearly equal bytes. A null text counts as
    empty and shares the group of empty texts; rows of equal text, and repeated rows, share a
    shard; doc_id may be null or repeat. An empty table gives no rows.
    """
    ship(docs.sparkSession)
    scratch = Scratch(docs.sparkSession, "shards")
    rows = scratch.save(_rows(docs, ["doc_id"] + ["text"] * with_text), "rows")

    def planner(sizes):
        plan = pack(sizes, capacity) if capacity else plan_shards(sizes, shards)
        if plan is None:
            raise ValueError(f"a group of {sizes[0][0]} bytes exceeds the capacity of {capacity}")
        return plan

    out = scratch.save(_assign(rows, scratch, planner).select(
        "doc_id", F.col("_size").alias("size"), F.col("_crc").alias("text_crc32"), "shard", "slot",
        *(["text"] if with_text else [])), "result")
    scratch.drop("rows", "groups", "placed")
    return out


def write_shards(assigned: DataFrame, path: str) -> None:
    """Write ``assign(..., with_text=True)`` as one folder a shard, its files in order of slot."""
    assigned.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot") \
        .write.partitionBy("shard").option("compression", "zstd").parquet(path)


def by_bytes(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """``assign`` under the law that the shards' sizes are near equal; the law has no grown shard."""
    return assign(docs, shards).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                                       F.lit(None).cast("int").alias("grown_shard"))
