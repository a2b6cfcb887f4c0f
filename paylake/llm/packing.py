"""Best-fit-decreasing packing of token pieces into fixed-size sequences.

The order of equal lengths does not matter to best fit, so the plan is made
from the counts of each length (at most ``capacity`` numbers, whatever the
number of documents): lengths in falling order, each put into the tightest
open bin, found in a segment tree over remaining capacities in
O(log capacity). All bins of one remaining capacity form runs of bin numbers,
so one lookup places a whole run, exactly as best fit would place its pieces
one by one. The plan has a row for each placed run; every run belongs to a
final bin pattern, of which each length opens at most three, each with at
most sqrt(2 * capacity) lengths: 1.1 million rows for 4,096, in practice some
thousands. Pieces get their rank among equal lengths by a salted window and
look their bin up in the plan.
"""

from __future__ import annotations

import math
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from paylake.llm.common import Scratch, raw_text, ship, tidy
from paylake.llm.word_tokens import encode_each

CAPACITY = 4096
END_ID = 1
ROWS_PER_WINDOW = 100_000


class OpenBins:
    """Segment tree over remaining capacities; a leaf holds the runs (first bin, count) with that much room."""

    def __init__(self, capacity: int):
        self.base = 1 << capacity.bit_length()
        self.any = bytearray(2 * self.base)
        self.runs: dict[int, list[tuple[int, int]]] = defaultdict(list)

    def _mark(self, room: int, value: int) -> None:
        i = self.base + room
        self.any[i] = value
        while i > 1:
            i >>= 1
            self.any[i] = self.any[2 * i] | self.any[2 * i + 1]

    def add(self, room: int, first: int, n: int) -> None:
        if room and n:
            if not self.runs[room]:
                self._mark(room, 1)
            self.runs[room].append((first, n))

    def take(self, room: int) -> tuple[int, int]:
        run = self.runs[room].pop()
        if not self.runs[room]:
            self._mark(room, 0)
        return run

    def tightest(self, length: int) -> int | None:
        """The least room that is ``length`` at least and has a bin."""
        i = self.base + length
        if self.any[i]:
            return length
        while i > 1:
            if not i & 1 and self.any[i + 1]:
                i += 1
                while i < self.base:
                    i = 2 * i if self.any[2 * i] else 2 * i + 1
                return i - self.base
            i >>= 1
        return None


def plan_bins(counts: dict[int, int], capacity: int = CAPACITY) -> np.ndarray:
    """Rows (length, first rank, first bin, pieces a bin, offset), by length and rank."""
    bins, plan, next_bin = OpenBins(capacity), [], 0
    for length in sorted((n for n in counts if 0 < n <= capacity), reverse=True):
        left, rank = counts[length], 0
        while left:
            room = bins.tightest(length)
            if room is None:
                room, first = capacity, next_bin
                have = -(-left // (capacity // length))
                next_bin += have
            else:
                first, have = bins.take(room)
            each = room // length
            full, part = divmod(min(left, have * each), each)
            if full:
                plan.append((length, rank, first, each, capacity - room))
                bins.add(room - each * length, first, full)
            if part:
                plan.append((length, rank + full * each, first + full, part, capacity - room))
                bins.add(room - part * length, first + full, 1)
            bins.add(room, first + full + bool(part), have - full - bool(part))
            rank += full * each + part
            left -= full * each + part
    return np.array(sorted(plan), dtype=np.int64).reshape(-1, 5)


def cut_pieces(docs: DataFrame, capacity: int = CAPACITY, end_id: int = END_ID, vocabulary: str | None = None,
               with_ids: bool = False) -> DataFrame:
    """A row per piece: doc_id, piece, start, length, ids_crc32 (and ids). A document's ids are
    its tokens and ``end_id``; a longer one is cut every ``capacity`` ids. A null
    text is empty: one piece that holds only ``end_id``."""
    ship(docs.sparkSession)
    end = np.array([end_id], dtype="<u4").tobytes()

    def run(batches):
        for b in batches:
            rows, n = defaultdict(list), 0
            doc_ids = b.column(0).to_pylist()
            for doc_id, ids in zip(doc_ids, encode_each(b.column(1).to_pylist(), vocabulary), strict=True):
                ids += end
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at:at + 4 * capacity]
                    rows["doc_id"].append(doc_id)
                    rows["piece"].append(k)
                    rows["start"].append(at // 4)
                    rows["length"].append(len(part) // 4)
                    rows["ids_crc32"].append(zlib.crc32(part))
                    if with_ids:
                        rows["ids"].append(np.frombuffer(part, dtype="<i4"))
                        n += len(part)
                if n > 1 << 24:
                    yield batch(rows)
                    rows, n = defaultdict(list), 0
            if rows:
                yield batch(rows)

    kinds = {"doc_id": pa.int64(), "piece": pa.int32(), "start": pa.int64(), "length": pa.int64(),
             "ids_crc32": pa.int64()} | ({"ids": pa.list_(pa.int32())} if with_ids else {})

    def batch(rows):
        return pa.RecordBatch.from_arrays([pa.array(rows[k], t) for k, t in kinds.items()], list(kinds))

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    return docs.select(F.col("doc_id").cast("long"), raw_text()).mapInArrow(tidy(run), schema)


def best_fit(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` (doc_id, piece, length, ids_crc32, ...) plus sequence_id and offset.

    ``pieces`` is read more than once: pass a written table. Equal pieces take
    places in order of doc_id, piece and checksum; pieces whose length is null,
    under 1 or over ``capacity`` get no sequence (null). An empty table stays empty.
    """
    ship(pieces.sparkSession)
    by_length = pieces.groupBy("length").count().collect()  # at most a row per length up to the capacity
    plan = plan_bins({r[0]: r[1] for r in by_length if r[0]}, capacity)
    salts = max(1, math.ceil(sum(r[1] for r in by_length) / ROWS_PER_WINDOW))
    # a number of the row, where there is one, spreads also pieces of one doc_id (or none)
    numbered = "_row" in pieces.columns
    salted = pieces.withColumn("_salt", F.pmod(F.xxhash64(*(["_row"] if numbered else ["doc_id", "piece"])), F.lit(salts)))
    before = salted.groupBy("length", "_salt").count().withColumn(
        "_before", F.sum("count").over(W.partitionBy("length").orderBy("_salt")) - F.col("count")).drop("count")
    order = W.partitionBy("length", "_salt").orderBy("doc_id", "piece", "ids_crc32")
    ranked = salted.withColumn("_rank", F.row_number().over(order) - 1).join(before, ["length", "_salt"], "left") \
        .withColumn("_rank", F.col("_rank") + F.col("_before")).drop("_salt", "_before")
    shared = pieces.sparkSession.sparkContext.broadcast(plan)
    names = [c for c in ranked.columns if c != "_rank"]

    def place(batches):
        p = shared.value
        keys = (p[:, 0] << 42) + p[:, 1]
        for b in batches:
            length = b.column("length").fill_null(0).to_numpy(zero_copy_only=False)
            rank = b.column("_rank").fill_null(0).to_numpy(zero_copy_only=False)
            ok = (length > 0) & (length <= capacity)
            at = np.searchsorted(keys, (np.where(ok, length, 0) << 42) + rank, side="right") - 1
            row = p[np.maximum(at, 0)] if len(p) else np.ones((len(length), 5), dtype=np.int64)
            nth = rank - row[:, 1]
            yield pa.RecordBatch.from_arrays(
                [b.column(c) for c in names] + [pa.array(row[:, 2] + nth // row[:, 3], mask=~ok),
                                                pa.array(row[:, 4] + nth % row[:, 3] * length, mask=~ok)],
                [*names, "sequence_id", "offset"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ranked.schema if f.name != "_rank")
    return ranked.mapInArrow(tidy(place), f"{schema}, sequence_id long, offset long")


def pack(docs: DataFrame, capacity: int = CAPACITY, end_id: int = END_ID, vocabulary: str | None = None) -> DataFrame:
    """All documents as pieces with their sequence and place: doc_id, piece, start, length,
    ids_crc32, sequence_id, offset. Rows that repeat are packed as often as they occur."""
    pieces = Scratch(docs.sparkSession, "pack").save(
        cut_pieces(docs, capacity, end_id, vocabulary).withColumn("_row", F.monotonically_increasing_id()), "pieces")
    return best_fit(pieces, capacity).select(
        "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def sequences(placed: DataFrame, pieces_with_ids: DataFrame) -> DataFrame:
    """(sequence_id, ids): the packed ids, at most a capacity each. ``pieces_with_ids`` is
    ``cut_pieces(..., with_ids=True)`` of the same documents, whose doc_ids are unique."""
    both = placed.select("doc_id", "piece", "sequence_id", "offset").join(
        pieces_with_ids.select("doc_id", "piece", "ids"), ["doc_id", "piece"])
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))  # bounded by the capacity
    return both.groupBy("sequence_id").agg(F.flatten(F.transform(parts, lambda x: x["ids"])).alias("ids"))
