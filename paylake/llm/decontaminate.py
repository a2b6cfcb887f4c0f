"""Benchmark decontamination by the q-gram lemma, verified by banded alignment.

Texts are compared in bytes, A-Z lower-cased, each run of white space as one
space. A benchmark item is cut into segments of at most ``SEGMENT`` bytes, and
into passages of ``PASSAGE`` bytes that overlap by half, so a document that
holds a part of an item is found too; a segment or passage of n bytes matches
where it aligns, whole, to a stretch of the document with at most
k = floor(ERROR * n) edits, an item of under ``MIN_SEGMENT`` bytes where it
occurs as it is. Items too short for a sampled q-gram (under ``SHORT`` bytes)
are looked up as numbers at every place of the document. Of the document's q-grams every
``STEP``-th is looked up: such a stretch holds floor((n - k - Q + 1) / STEP) of
them at least, an edit spoils Q / STEP at most, and the others occur in the
segment, within k diagonals of each other. So hits are counted in overlapping
diagonal bands, and only bands that reach the bound are aligned. The segments are a stated query set, sent to every task in blocks
of bounded size; the documents are read once a block and never shuffled.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paylake.llm.common import Scratch, raw_text, ship, tidy, with_own_columns

Q, STEP = 8, 4
ERROR = 0.08
SEGMENT = 400
PASSAGE = 100
MIN_SEGMENT = 40  # shorter items have no budget of edits
SHORT = Q + STEP - 1  # from here on one sampled q-gram at least lies within an item
BLOCK_BYTES = 1 << 20  # an index of so many bytes takes some 400 MB
GROUP_BYTES = 1 << 19
ROUGH = 1 << 18
_WEIGHT = np.uint64(0x9E3779B97F4A7C15)


def normalise(raw: bytes) -> bytes:
    return b" ".join(raw.lower().split())


def positions(raw: bytes) -> np.ndarray:
    """The place in ``raw`` of each byte of its normalised form, and its length last."""
    b = np.frombuffer(raw, dtype=np.uint8)
    space = np.isin(b, [0x20, 9, 10, 11, 12, 13])
    keep = ~space
    first = space.copy()
    first[1:] &= ~space[:-1]
    word = np.flatnonzero(keep)
    if len(word):  # the first of each inner run of white space
        keep[word[0]:word[-1]] |= first[word[0]:word[-1]]
    return np.append(np.flatnonzero(keep), len(b))


def budget(n: int, error: float = ERROR) -> int:
    return math.floor(error * n) if n >= MIN_SEGMENT else 0


def windows(t: bytes, size: int) -> list[bytes]:
    """``t`` whole if it is no longer than ``size``, else windows of that size that overlap by half or more
    (without a space at an end)."""
    if len(t) <= size:
        return [t]
    n = math.ceil((len(t) - size / 2) / (size / 2))
    return [t[s:s + size].strip() for s in np.linspace(0, len(t) - size, n).astype(int).tolist()]


def segments(item: bytes) -> list[bytes]:
    """Of the normalised item the segments (itself, if it is short) and the passages."""
    t = normalise(item)
    if not t:
        return []
    return list(dict.fromkeys([*windows(t, SEGMENT), *windows(t, PASSAGE)]))


def grams(b: bytes, step: int = 1) -> np.ndarray:
    """Every ``step``-th 8-byte gram as a number."""
    n = max(0, len(b) - Q + 1)
    out = np.empty(len(range(0, n, step)), dtype="<u8")
    for o in range(0, min(Q, n), step):
        out[o // step::Q // step] = np.frombuffer(b, dtype="<u8", offset=o, count=len(range(o, n, Q)))
    return out


def align(pattern: bytes, text: bytes, k: int) -> tuple[int, int, int] | None:
    """(edits, start, end) of the best stretch of ``text`` for the whole pattern with at most k edits:
    the fewest edits, then the smallest end, then the smallest start."""
    at = text.find(pattern)
    if at >= 0:
        return 0, at, at + len(pattern)
    if not k:
        return None

    end_costs = _banded(pattern, text, k, len(text) - len(pattern) + k, True)
    end = int(end_costs.argmin())
    best = int(end_costs[end])
    if best > k:
        return None
    back = text[max(0, end - len(pattern) - best):end][::-1]
    long = int(np.flatnonzero(_banded(pattern[::-1], back, best, best, False) == best)[-1])
    return best, end - long, end


def _banded(pattern: bytes, text: bytes, below: int, above: int, free: bool) -> np.ndarray:
    """The edits from the whole pattern to a stretch of ``text`` that ends at each place (and, unless
    ``free``, begins at 0), over alignments that stay on diagonals -below to above; others count as many."""
    m, n, width, many = len(pattern), len(text), below + above + 1, 1 << 30
    if width <= 0:
        return np.full(n + 1, many)
    padded = np.full(n + m + width + 1, 256, dtype=np.int16)  # place j of the text is at j + below
    padded[below:below + n] = np.frombuffer(text, dtype=np.uint8)[:len(padded) - below]
    steps = np.arange(width)
    row = np.full(width + 1, many)  # cell d: the diagonal d - below; one more beyond the band
    row[below:width] = 0 if free else steps[:width - below]
    for i, c in enumerate(pattern):
        new = np.minimum(row[:-1] + (padded[i:i + width] != c), row[1:] + 1)
        new[:max(0, below - i - 1)] = many  # before the text
        row[:-1] = np.minimum.accumulate(new - steps) + steps
    out = np.full(n + 1, many)
    first = m - below  # the place that the band's first cell ends at
    at = np.arange(max(first, 0), min(first + width - 1, n) + 1)
    out[at] = np.minimum(row[at - first], many)
    return out


class Short:
    """Items (item id, bytes) of under ``SHORT`` bytes, found where they occur as they are."""

    def __init__(self, parts: list[tuple[int, bytes]]):
        self.by_length = []
        for n in sorted({len(p) for _, p in parts}):
            own = [(i, p) for i, p in parts if len(p) == n]
            key = np.concatenate([self._keys(p, n) for _, p in own])
            order = np.argsort(key, kind="stable")
            self.by_length.append((n, *np.unique(key[order], return_index=True, return_counts=True), [own[k] for k in order]))

    @staticmethod
    def _keys(b: bytes, n: int) -> np.ndarray:
        """A number for the ``n`` bytes at each place; that of up to 8 bytes is the bytes themselves."""
        if n >= Q:
            g = grams(b)
            return g[:max(0, len(b) - n + 1)] * _WEIGHT + g[n - Q:] if n > Q else g
        g = grams(b + bytes(Q - 1))[:max(0, len(b) - n + 1)]
        return g & np.uint64((1 << 8 * n) - 1)

    def matches(self, whole: bytes, starts: np.ndarray):
        """(text, item id, 0, start, end): the first place of each item in each text of ``whole``."""
        for n, known, first, count, own in self.by_length:
            key = self._keys(whole, n)
            slot = np.searchsorted(known, key)
            slot[slot == len(known)] = 0
            at = np.flatnonzero(known[slot] == key)
            text = np.searchsorted(starts, at, side="right") - 1
            inside = at + n < starts[text + 1]  # none runs over the byte between two texts
            at, text = at[inside], text[inside]
            pair, place = np.unique(text * len(known) + slot[at], return_index=True)
            for x, s in zip(pair.tolist(), at[place].tolist(), strict=True):
                i, k = divmod(x, len(known))
                s -= int(starts[i])
                for item, p in own[first[k]:first[k] + count[k]]:
                    a = s if n <= Q else whole.find(p, int(starts[i]) + s, int(starts[i + 1]) - 1) - int(starts[i])
                    if a >= 0:
                        yield i, item, 0, a, a + n


class Index:
    """The q-grams of a block of segments (item id, bytes)."""

    def __init__(self, parts: list[tuple[int, bytes]], error: float = ERROR):
        self.short = Short([x for x in parts if len(x[1]) < SHORT])
        parts = [x for x in parts if len(x[1]) >= SHORT]
        self.parts = parts
        self.k = np.array([budget(len(p), error) for _, p in parts], dtype=np.int64)
        stretch = np.array([len(p) for _, p in parts], dtype=np.int64) - self.k
        self.least = np.maximum(1, (stretch - Q + 1) // STEP - Q // STEP * self.k)
        g = [grams(p) for _, p in parts]
        self.own = [(x[o], o) for x in g for o in [np.argsort(x, kind="stable")]]
        every = np.concatenate([*g, np.zeros(0, "<u8")])
        part = np.repeat(np.arange(len(parts)), [len(x) for x in g])
        place = np.concatenate([*(np.arange(len(x)) for x in g), np.zeros(0, np.int64)])
        order = np.argsort(every, kind="stable")
        self.part, self.place = part[order], place[order].astype(np.int64)
        self.known, self.first, self.count = np.unique(every[order], return_index=True, return_counts=True)
        self.bits = 20
        self.filter = np.zeros(1 << self.bits, dtype=bool)
        self.filter[self._slot(self.known)] = True
        self.band = int(max(64, 2 ** math.ceil(math.log2(self.k.max(initial=1) + 1))))

    def _slot(self, g: np.ndarray) -> np.ndarray:
        return (g * _WEIGHT) >> np.uint64(64 - self.bits)

    def candidates(self, text: bytes) -> list[tuple[int, int]]:
        """(segment, first diagonal of the band): bands that hold enough hits. Bands are 2 * ``band`` diagonals
        wide and start every ``band``, which no segment's budget exceeds."""
        g = grams(text, STEP)
        at = np.flatnonzero(self.filter[self._slot(g)])
        if not len(at):
            return []
        slot = np.searchsorted(self.known, g[at])
        slot[slot == len(self.known)] = 0
        ok = self.known[slot] == g[at]
        at, slot = at[ok] * STEP, slot[ok]
        n = self.count[slot]
        own = np.repeat(self.first[slot] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        part, diagonal = self.part[own], np.repeat(at, n) - self.place[own] + (1 << 40)
        band = diagonal // self.band
        # rough counts first (colliding bands only raise them), exact ones for what they leave
        slots = (part * 0x9E3779B1 + band) & (ROUGH - 1)
        rough = np.bincount(slots, minlength=ROUGH)
        rough = rough + np.roll(rough, -1)  # of this band and the next
        least = self.least[part]
        here, before = rough[slots] >= least, rough[slots - 1] >= least
        key = np.concatenate([((part << 42) + band)[here], ((part << 42) + band - 1)[before]])
        key, hits = np.unique(key, return_counts=True)
        part = key >> 42
        key, part = key[hits >= self.least[part]], part[hits >= self.least[part]]
        return list(zip(part.tolist(), (((key & ((1 << 42) - 1)) * self.band) - (1 << 40)).tolist(), strict=True))

    def holds(self, part: int, text: bytes) -> bool:
        """Whether all q-grams of a stretch reach the whole bound, n - Q + 1 - k * Q, within k diagonals."""
        known, place = self.own[part]
        k, g = int(self.k[part]), grams(text)
        left, right = np.searchsorted(known, g), np.searchsorted(known, g, side="right")
        n = right - left
        own = place[np.repeat(left - (np.cumsum(n) - n), n) + np.arange(n.sum())]
        band = (np.repeat(np.arange(len(g)), n) - own + len(known)) // (k + 1)
        hits = np.bincount(band, minlength=1)
        hits[:-1] += hits[1:]
        return hits.max() >= len(known) - k * Q

    def matches(self, texts: list[bytes]):
        """(text, item id, edits, start, end): the best match of every segment that matches, in normalised bytes."""
        starts = np.cumsum([0, *(len(t) + 1 for t in texts)])
        whole = b"\0".join(texts)
        # the fewest edits, then the first start, then the longest stretch
        best = {(i, item): (e, s, -end) for i, item, e, s, end in self.short.matches(whole, starts)}
        for part, diagonal in self.candidates(whole):
            item, p = self.parts[part]
            k = int(self.k[part])
            lo, hi = diagonal - k, diagonal + 2 * self.band + len(p) + k
            i = max(0, int(np.searchsorted(starts, max(lo, 0), side="right")) - 1)
            while i < len(texts) and starts[i] < hi:
                s = max(lo - int(starts[i]), 0)
                near = texts[i][s:max(0, hi - int(starts[i]))]
                found = align(p, near, k) if self.holds(part, near) else None
                if found:
                    found = (found[0], s + found[1], -s - found[2])
                    best[i, item] = min(best.get((i, item), found), found)
                i += 1
        for (i, item), (e, s, end) in sorted(best.items()):
            yield i, item, e, s, -end


def blocks(benchmark: DataFrame):
    """The benchmark's segments in blocks of about ``BLOCK_BYTES`` (a block at a time reaches the driver)."""
    b = benchmark.filter("item_id is not null and text is not null").select(
        F.col("item_id").cast("long").alias("item_id"), raw_text().alias("raw")).distinct()
    total = b.agg(F.sum(F.length("raw"))).first()[0] or 0
    n = max(1, math.ceil(total / BLOCK_BYTES))
    for i in range(n):
        rows = b.filter(F.pmod(F.xxhash64("item_id", "raw"), F.lit(n)) == i).orderBy("item_id", "raw").collect()
        yield [(r[0], s) for r in rows for s in segments(bytes(r[1]))]


def find(docs: DataFrame, benchmark: DataFrame, error: float = ERROR) -> DataFrame:
    """doc_id, item_id, edits, start, end: where documents hold a benchmark item (or a segment or passage of it).

    A row per document and item, the best match: that of the segment or passage
    with the fewest edits; start and end are byte places in the document's text.
    Null and empty texts and items match nothing; items of under ``MIN_SEGMENT``
    bytes match without edits only. Rows that repeat are reported as often
    as they occur; a null doc_id is reported as null.
    """
    spark = docs.sparkSession
    ship(spark)
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), raw_text().alias("raw"))
    out = None
    for parts in blocks(benchmark):
        shared = spark.sparkContext.broadcast(parts)

        def run(batches, shared=shared):
            index = Index(shared.value, error) if shared.value else None
            for b in batches:
                ids, raws = b.column(0).to_pylist(), b.column(1).to_pylist()
                rows, at = [], 0
                while index and at < len(raws):
                    texts, size, first = [], 0, at
                    while at < len(raws) and size < GROUP_BYTES:
                        texts.append(normalise(raws[at]))
                        size += len(texts[-1])
                        at += 1
                    for i, item, edits, s, e in index.matches(texts):
                        place = positions(raws[first + i])
                        rows.append((ids[first + i], item, edits, int(place[s]), int(place[e - 1]) + 1 if e else 0))
                cols = list(zip(*rows, strict=True)) if rows else [[]] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols],
                                                 ["doc_id", "item_id", "edits", "start", "end"])

        part = src.mapInArrow(tidy(run), "doc_id long, item_id long, edits long, start long, end long")
        out = part if out is None else out.unionAll(part)
    # an item lies in one block: a row per document and item already
    return out


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, error: float = ERROR) -> DataFrame:
    """``docs`` without the rows whose text holds a benchmark item or a passage of one; columns as they
    were. Null and empty texts stay, repeated rows are judged alike."""
    return with_own_columns(docs, lambda d: _without_items(d, benchmark, error))


def _without_items(docs: DataFrame, benchmark: DataFrame, error: float) -> DataFrame:
    spark = docs.sparkSession
    scratch = Scratch(spark, "clean")
    text = docs.columns.index("text")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    for i, parts in enumerate(blocks(benchmark)):
        if i:  # a block a pass, so that a task holds one index
            docs = scratch.save(docs, f"{i}")
            scratch.drop(f"{i - 1}")
        shared = spark.sparkContext.broadcast(parts)

        def run(batches, shared=shared):
            index = Index(shared.value, error) if shared.value else None
            for b in batches:
                texts = b.column(text).to_pylist()
                keep = np.ones(len(texts), dtype=bool)
                at = 0
                while index and at < len(texts):
                    group, size, first = [], 0, at
                    while at < len(texts) and size < GROUP_BYTES:
                        group.append(normalise((texts[at] or "").encode()))
                        size += len(group[-1])
                        at += 1
                    keep[[first + m[0] for m in index.matches(group)]] = False
                yield b.filter(pa.array(keep))

        docs = docs.mapInArrow(tidy(run), schema)
    return docs
