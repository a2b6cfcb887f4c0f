"""Exact substring deduplication over suffix arrays of distributed shards.

A byte is removed when a string of ``LENGTH`` bytes that covers it also starts
earlier: in a smaller doc_id, or earlier in the same document.

Sharding. Every window of ``LENGTH`` bytes is given to its anchor, the place of
the least hash among its grams (the leftmost at a tie). Equal windows have equal
anchor grams, so they meet in the shard of that gram. Consecutive windows with
one anchor travel together as a stretch of text. A stretch equal to an earlier
one goes whole (equal stretches are merged before the shuffle already); a
gram that occurs in one stretch only has nothing to sort. What remains, the
different stretches that share a gram, is sorted with its common-prefix values
by external induced sorting (``induced_sort``): runs of suffixes with LENGTH
bytes in common are equal windows, and all but the first in document order go.
A gram of more than ``HOT`` different stretches would fill a shard, so its
stretches are cut into their windows, each a gram of its own.

Between the steps only hashes, places and repeated stretches are shuffled; texts
move compressed, once to fetch the stretches and once to cut the results.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paylake.llm.common import Scratch, raw_text, release, ship, tidy, with_own_columns
from paylake.llm.induced_sort import sort_suffixes
from paylake.llm.minhash import mix, powers

LENGTH = 100
GRAM = 24
CHUNK = 1 << 17
MERGE_ROWS = 400_000
SHARD_BYTES = 4 << 20  # of text sorted at once; a smaller shard needs less memory and some more time
HOT = 20_000
NO_ID = -(1 << 63)
_BYTES: list[np.ndarray] = []
ROW = "key long, hash long, hash2 long, doc long, place long, n int"
NAMES = [c.split()[0] for c in ROW.split(", ")]


def _byte_table() -> np.ndarray:
    if not _BYTES:
        _BYTES.append(mix(np.arange(256, dtype=np.uint64) + np.uint64(0xA5A5)) | np.uint64(1))
    return _BYTES[0]


def _joined(pieces):
    """Rows of (doc, place, bytes) cut to ``CHUNK`` windows each, as many at a time as hold that number of bytes;
    rows of less than a window are left out."""
    group, held = [], 0
    for doc, base, raw in pieces:
        for at in range(0, len(raw) - LENGTH + 1, CHUNK):
            part = raw[at:at + CHUNK + LENGTH - 1]
            if group and held + len(part) > CHUNK + LENGTH - 1:
                yield group
                group, held = [], 0
            group.append((doc, base + at, part))
            held += len(part)
    if group:
        yield group


def stretches(group, gram: int = GRAM):
    """(key, hash, hash2, doc, place, windows) of each stretch in the parts of a group: the windows at place,
    place + 1, ... with one anchor.
    The two hashes are of different kinds, a polynomial and a sum of scrambled grams: 128 bits in all."""
    span = LENGTH - gram + 1  # grams in a window
    b = np.frombuffer(b"".join([raw for _, _, raw in group]), np.uint8)
    size = np.array([len(raw) for _, _, raw in group], dtype=np.int64)
    start, windows = np.cumsum(size) - size, size - LENGTH + 1
    up, down = powers(CHUNK + LENGTH)
    total = np.zeros(len(b) + 1, dtype=np.uint64)
    np.cumsum(_byte_table()[b] * up[:len(b)], out=total[1:])
    grams = mix((total[gram:] - total[:-gram]) * down[:len(b) - gram + 1])
    low = (grams & ~np.uint64((1 << 20) - 1)) | np.arange(len(grams), dtype=np.uint64)
    width = 1
    while 2 * width <= span:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    if span > width:
        low = np.minimum(low[:len(low) - (span - width)], low[span - width:])
    own = np.repeat(start - (np.cumsum(windows) - windows), windows) + np.arange(windows.sum())  # none over two parts
    anchor = (low[own] & np.uint64((1 << 20) - 1)).astype(np.int64)
    new = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))
    n = np.diff(new, append=len(anchor))
    first = own[new]
    end = first + n + LENGTH - 1
    h = mix((total[end] - total[first]) * down[first] + n.astype(np.uint64))
    short = grams if gram == GRAM else mix((total[GRAM:] - total[:-GRAM]) * down[:len(b) - GRAM + 1])
    sums = np.zeros(len(short) + 1, dtype=np.uint64)
    np.cumsum(short, out=sums[1:])
    h2 = mix(sums[end - GRAM + 1] - sums[first])
    part = np.searchsorted(start, first, side="right") - 1
    doc, base = (np.array([x[k] for x in group], dtype=np.int64) for k in (0, 1))
    return (grams[anchor[new]].view(np.int64), h.view(np.int64), h2.view(np.int64), doc[part],
            base[part] + first - start[part], n)


def _merged(start: np.ndarray, length: np.ndarray):
    """Places in order joined where they touch: (start, length)."""
    if not len(start):
        return start, length
    end = np.maximum.accumulate(start + length)
    new = np.concatenate([[True], start[1:] > end[:-1]])
    last = np.append(np.flatnonzero(new)[1:] - 1, len(start) - 1)
    return start[new], end[last] - start[new]


def _gone(doc, place, n):
    """Rows that say which bytes go: the hash is 0, n the negative length. Windows that touch in a text are joined."""
    order = np.lexsort((place, doc))
    doc, place, size = doc[order], place[order], n[order].astype(np.int64) + LENGTH - 1
    if not len(doc):
        return [np.zeros(0, np.int64)] * 6
    other = np.concatenate([[False], doc[1:] != doc[:-1]])
    line = (np.cumsum(other) << 32) + place  # texts one after the other
    end = np.maximum.accumulate(line + size)
    new = np.concatenate([[True], line[1:] > end[:-1]]) | other
    last = np.append(np.flatnonzero(new)[1:] - 1, len(doc) - 1)
    doc, place = doc[new], place[new]
    none = np.zeros(len(doc), np.int64)
    return [mix(doc.view(np.uint64)).view(np.int64), none, none, doc, place, line[new] - end[last]]


def _batch(cols):
    kinds = [pa.int64()] * 5 + [pa.int32()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], NAMES)


def _distinct(rows):
    """Of equal stretches the first in document order, and the bytes of the others."""
    key, h, h2, doc, place, n = (np.concatenate(x) for x in zip(*rows, strict=True))
    order = np.lexsort((place, doc, h, key))
    one = (key[order[1:]] == key[order[:-1]]) & (h[order[1:]] == h[order[:-1]])
    if (one & (h2[order[1:]] != h2[order[:-1]])).any():  # the first hash collides somewhere
        order = np.lexsort((place, doc, h2, h, key))
    key, h, h2, doc, place, n = (x[order] for x in (key, h, h2, doc, place, n))
    again = np.concatenate([[False], (key[1:] == key[:-1]) & (h[1:] == h[:-1]) & (h2[1:] == h2[:-1])])
    keep = np.flatnonzero(~again)
    keep = keep[np.lexsort((place[keep], doc[keep]))]
    yield _batch([x[keep] for x in (key, h, h2, doc, place, n)])
    if again.any():
        yield _batch(_gone(doc[again], place[again], n[again]))


def _emit(pieces, gram: int):
    """Rows of (doc, place, bytes), merged within about ``MERGE_ROWS`` stretches."""
    rows, held = [], 0
    for group in _joined(pieces):
        rows.append(stretches(group, gram))
        held += len(rows[-1][0])
        if held > MERGE_ROWS:
            yield from _distinct(rows)
            rows, held = [], 0
    if rows:
        yield from _distinct(rows)


def _compare(batches):
    """Of rows sorted by key, hashes, doc and place: those that repeat an earlier stretch as bytes to remove,
    and the first of each stretch where its key has several."""
    last = None  # the last class's first row, and whether its key has an earlier class
    shared = False
    tail = None  # key and hashes of the last row
    for b in batches:
        n = b.column(5).to_numpy()
        cols = [b.column(i).to_numpy() for i in range(6)]
        gone = n < 0
        if gone.any():
            yield _batch([c[gone] for c in cols])
            cols = [c[~gone] for c in cols]
        if not len(cols[0]):
            continue
        key, h, h2 = cols[:3]
        before = tail or (~int(key[0]), 0, 0)
        again = np.concatenate([[key[0] == before[0]], key[1:] == key[:-1]])
        for x, y in ((h, before[1]), (h2, before[2])):
            again &= np.concatenate([[x[0] == y], x[1:] == x[:-1]])
        tail = int(key[-1]), int(h[-1]), int(h2[-1])
        if again.any():
            yield _batch(_gone(cols[3][again], cols[4][again], cols[5][again]))
        first = [c[~again] for c in cols]
        if not len(first[0]):
            continue
        if last is not None:
            first = [np.concatenate([x, c]) for x, c in zip(last, first, strict=True)]
        k = first[0]
        prev = np.concatenate([[shared if last is not None else False], k[1:] == k[:-1]])
        follow = np.concatenate([k[1:] == k[:-1], [False]])
        several = (prev | follow)[:-1]
        if several.any():
            yield _batch([c[:-1][several] for c in first])
        last, shared = [c[-1:] for c in first], bool(prev[-1])
    if last is not None and shared:
        yield _batch(last)


def _grouped(rows: DataFrame) -> DataFrame:
    return rows.repartition("key").sortWithinPartitions("key", "hash", "hash2", "doc", "place").mapInArrow(tidy(_compare), ROW)


def _sort_shards(texts: DataFrame, shards: int, memory: int) -> DataFrame:
    """Bytes to remove among stretches (key, doc, place, n, raw) that share a key, by induced sorting."""
    def clean(rows):
        size = np.array([len(r[4]) for r in rows], dtype=np.int64)
        start = np.concatenate([[0], np.cumsum(size + 1)])[:-1]
        text = np.frombuffer(b"\0".join([r[4] for r in rows]), np.uint8).astype(np.int32) + 2
        text[start[1:] - 1] = 1  # between stretches
        pos, lcp = sort_suffixes(text, LENGTH, memory)
        group = np.cumsum(lcp < LENGTH, dtype=np.int32)
        del lcp, text
        many = np.bincount(group)[group] > 1
        pos, group = pos[many], group[many]
        own = np.searchsorted(start, pos, side="right") - 1
        doc, place, n = (np.array([r[k] for r in rows], dtype=np.int64) for k in (1, 2, 3))
        offset = pos - start[own]
        ok = offset < n[own]
        doc, place, group = doc[own][ok], (place[own] + offset)[ok], group[ok]
        order = np.lexsort((place, doc, group))
        doc, place, group = doc[order], place[order], group[order]
        again = np.concatenate([[False], group[1:] == group[:-1]])
        return _gone(doc[again], place[again], np.ones(int(again.sum()), np.int64))

    def run(batches):
        shard, rows = None, []
        for b in batches:
            for s, *r in zip(*(b.column(i).to_pylist() for i in range(6)), strict=True):
                if s != shard:
                    if rows:
                        yield _batch(clean(rows))
                        release()
                    shard, rows = s, []
                rows.append(r)
        if rows:
            yield _batch(clean(rows))

    return texts.select(F.pmod("key", F.lit(shards)).cast("int").alias("shard"), "key", "doc", "place", "n", "raw") \
        .repartition("shard").sortWithinPartitions("shard", "key", "doc", "place").mapInArrow(tidy(run), ROW)


def _numbered(docs: DataFrame, scratch: Scratch) -> tuple[DataFrame, bool]:
    """``docs`` with ``_doc``, a number that orders texts by doc_id, then by a 128-bit hash of the text. Where no
    doc_id repeats it is the doc_id; else the different texts are numbered. A null doc_id counts as the smallest.
    The second result is whether numbers may repeat (equal rows have one)."""
    doc = F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID))
    if docs.groupBy(doc.alias("d")).count().filter("count > 1").isEmpty():
        return docs.withColumn("_doc", doc), False
    key = {"_null_id": F.col("doc_id").isNull(), "_id": doc, "_hash": F.md5(raw_text())}
    keyed = docs.withColumns(key)
    order = [F.desc("_null_id"), F.asc("_id"), F.asc("_hash")]
    ids = scratch.save(keyed.select(*key).distinct().orderBy(*order).withColumn("_doc", F.monotonically_increasing_id()), "ids")
    own = [F.col(f"`{c}`") for c in docs.columns]
    return scratch.save(keyed.join(ids.hint("merge"), list(key)).select(*own, "_doc"), "numbered"), True


def _keyed(docs: DataFrame, extra: tuple = ()) -> DataFrame:
    """doc (its number) and the compressed bytes of each text."""
    ship(docs.sparkSession)
    src = docs.select(F.col("_doc").alias("doc"), raw_text().alias("raw"), *extra)

    def run(batches):
        import zstandard
        z = zstandard.ZstdCompressor(level=1)
        at = 1
        for b in batches:
            yield b.set_column(at, "raw", pa.array([z.compress(x) for x in b.column(at).to_pylist()], pa.binary()))

    return src.mapInArrow(tidy(run), src.schema)


def _unpack(z: bytes) -> bytes:
    import zstandard
    return zstandard.ZstdDecompressor().decompress(z)


def _fetch(docs: DataFrame, places: DataFrame, several: bool) -> DataFrame:
    """``places`` (key, hash, doc, place, n) with the bytes of their stretches, as raw."""
    packed = _keyed(docs)
    if several:
        packed = packed.dropDuplicates(["doc"])
    per_doc = places.groupBy("doc").agg(F.sort_array(F.collect_list(F.struct("place", "n", "key"))).alias("at"))
    # a list is no longer than its document

    def run(batches):
        for b in batches:
            out = []
            for doc, raw, at in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                raw = _unpack(raw)
                for x in at:
                    s = x["place"]
                    out.append((x["key"], doc, x["place"], x["n"], raw[s:s + x["n"] + LENGTH - 1]))
            cols = list(zip(*out, strict=True)) or [[]] * 5
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)],
                                             ["key", "doc", "place", "n", "raw"])

    return packed.join(per_doc.hint("merge"), "doc").select("doc", "raw", "at").mapInArrow(
        tidy(run), "key long, doc long, place long, n int, raw binary")


def removals(docs: DataFrame, scratch: Scratch, several: bool, shard_bytes: int | None = None,
             memory: int = 96 << 20) -> DataFrame:
    """(doc, spans): for each numbered text with bytes to remove their places (start, end), joined and in order.
    ``several``: equal rows may repeat a number."""
    ship(docs.sparkSession)
    src = docs.select(F.col("_doc").alias("doc"), F.lit(0).cast("long").alias("base"), raw_text().alias("raw"))
    if several:
        src = src.dropDuplicates(["doc"])

    def scan(batches):
        def pieces():
            for b in batches:
                yield from zip(*(b.column(i).to_pylist() for i in range(3)), strict=True)
        yield from _emit(pieces(), GRAM)

    found = scratch.save(_grouped(src.mapInArrow(tidy(scan), ROW)), "found")
    open_rows = found.filter("n > 0")
    texts = scratch.save(_fetch(docs, open_rows, several), "stretches")
    size = texts.groupBy("key").agg(F.count(F.lit(1)).alias("m"), F.sum(F.length("raw")).alias("bytes"))
    hot = scratch.save(size.filter(F.col("m") > HOT).select("key"), "hot")
    total = texts.agg(F.sum(F.length("raw") + 1)).first()[0] or 0
    shards = max(1, math.ceil(total / (shard_bytes or SHARD_BYTES)))
    parts = [found.filter("n < 0"), _sort_shards(texts.join(hot, "key", "left_anti"), shards, memory)]
    if not hot.isEmpty():
        def cut(batches):
            def pieces():
                for b in batches:
                    yield from zip(*(b.column(i).to_pylist() for i in range(3)), strict=True)
            yield from _emit(pieces(), LENGTH)

        windows = texts.join(hot, "key", "left_semi").select("doc", "place", "raw").mapInArrow(tidy(cut), ROW)
        parts.append(_grouped(windows).filter("n < 0"))
    every = parts[0]
    for p in parts[1:]:
        every = every.unionAll(p)
    spans = every.select("doc", F.col("place").alias("start"), (-F.col("n")).alias("size"))
    out = scratch.save(spans.groupBy("doc").agg(F.sort_array(F.collect_list(F.struct("start", "size"))).alias("spans")), "spans")
    scratch.drop("found", "stretches", "hot")
    return out


def _spans(spans) -> tuple[np.ndarray, np.ndarray]:
    if not spans:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    start = np.array([x["start"] for x in spans], dtype=np.int64)
    start, size = _merged(start, np.array([x["size"] for x in spans], dtype=np.int64))
    return start, start + size


def _kept(raw: bytes, start: np.ndarray, end: np.ndarray) -> bytes:
    at = np.concatenate([[0], end]).tolist()
    return b"".join([raw[a:b] for a, b in zip(at, [*start.tolist(), len(raw)], strict=True)])


def _with_spans(docs: DataFrame, extra: tuple = (), shard_bytes: int | None = None) -> DataFrame:
    scratch = Scratch(docs.sparkSession, "suffix")
    numbered, several = _numbered(docs, scratch)
    spans = removals(numbered, scratch, several, shard_bytes)
    return _keyed(numbered, extra).join(spans.hint("merge"), "doc", "left")


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for each row.

    A null text is empty. Rows that repeat a doc_id and its text are one
    document, with the same result each; texts that share a doc_id are ordered
    by a 128-bit hash. A null doc_id counts as the smallest.
    """
    def run(batches):
        for b in batches:
            out = []
            for doc, raw, spans in zip(*(b.column(c).to_pylist() for c in ("doc_id", "raw", "spans")), strict=True):
                raw = _unpack(raw)
                start, end = _spans(spans)
                out.append((doc, len(raw), int((end - start).sum()), len(start),
                            hashlib.sha256(_kept(raw, start, end)).hexdigest()))
            names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
            cols = list(zip(*out, strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, [pa.int64()] * 4 + [pa.string()], strict=True)], names)

    extra = F.col("doc_id").cast("long").alias("doc_id")
    return _with_spans(docs, (extra,)).select("doc_id", "raw", "spans").mapInArrow(
        tidy(run), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def drop_repeated_text(docs: DataFrame, shard_bytes: int | None = None) -> DataFrame:
    """``docs`` with the repeated bytes cut from ``text`` (characters cut in half go whole; a null
    stays null) and ``n_chars``, where there is one, counted anew."""
    return with_own_columns(docs, lambda d: _without_repeats(d, shard_bytes))


def _without_repeats(docs: DataFrame, shard_bytes: int | None) -> DataFrame:
    names = docs.columns
    had = docs.withColumn("_null", F.col("text").isNull())
    rest = [c for c in names if c != "text"]
    extra = F.struct(*[F.col(f"`{c}`") for c in rest], "_null").alias("_rest")
    x = _with_spans(had, (extra,), shard_bytes).select("raw", "spans", "_rest")

    def run(batches):
        for b in batches:
            out = []
            for raw, spans in zip(*(b.column(c).to_pylist() for c in ("raw", "spans")), strict=True):
                raw = _unpack(raw)
                out.append(_kept(raw, *_spans(spans)).decode("utf-8", "ignore"))
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string()), b.column("_rest")], ["text", "_rest"])

    schema = x.select(F.lit("").alias("text"), "_rest").schema
    y = x.mapInArrow(tidy(run), schema)
    text = F.when(~F.col("_rest._null"), F.col("text"))
    cols = {c: text if c == "text" else F.col(f"_rest.`{c}`") for c in names}
    if "n_chars" in cols:
        cols["n_chars"] = F.length(F.coalesce(text, F.lit(""))).cast(docs.schema["n_chars"].dataType)
    return y.select(*[c.alias(n) for n, c in cols.items()])
