"""Near-duplicate documents by circulant MinHash, confirmed on full shingle sets.

One permutation scatters a set's shingles over a universe, a second one,
circularly shifted by 0, 1, 2, ..., gives every coordinate of the signature:
coordinate k is the least ``pi[(sigma(x) + k) mod D]``. With pi written out
past its end, the coordinates of one shingle are a contiguous slice of pi.

Documents with equal sets form a class; its first document stands for it.
Signatures are cut into bands; classes that agree in a band meet in a bucket.
Links are found in two rounds, so that no bucket is expanded into all pairs:
every member against its bucket's first member, and, once those links have
merged classes into components, members of different components that still
share a bucket, in blocks of bounded size that return only the links that
merge components. A candidate is dropped early only
when sizes rule the link out or the signatures agree far less than a link
would (see ``ERRORS``); every link is confirmed on the two full sets.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paylake.llm.common import Scratch, connected_components, raw_text, ship, tidy, with_own_columns

SHINGLE = 5
# 24 bands of 5: a pair at 0.85 misses every band with probability (1 - 0.85^5)^24 < 1e-6, one at 0.8 < 1e-4
BANDS, ROWS = 24, 5
UNIVERSE = 1 << 20
# the usual limit of near-duplicate stages on word shingles
PIPELINE_PERCENT = 80
SEED = 20240611
# coordinates of the whole signature (the first ones make the bands), one byte each where it is compared
COORDINATES = 256
# no check is made where signatures agree so many standard errors less than a link's do on average
ERRORS = 4.5
BLOCK = 1024
_TABLES: list = []


def _tables():
    if not _TABLES:
        rng = np.random.default_rng(SEED)
        k = COORDINATES
        pi = rng.permutation(UNIVERSE).astype(np.uint32)
        pi = np.concatenate([pi, pi[:k]])
        byte = rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        space = np.zeros(256, dtype=bool)
        space[[0x20, *range(0x09, 0x0E)]] = True
        _TABLES.append((np.lib.stride_tricks.sliding_window_view(pi, k), byte, space))
    return _TABLES[0]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


_POWERS: list = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base mod 2^64 and of its inverse, ``n`` at least."""
    if _POWERS and len(_POWERS[0][0]) >= n:
        return _POWERS[0]
    base = 0x9E3779B97F4A7C15
    size = max(n, 1 << 16)
    found = _powers(base, size), _powers(pow(base, -1, 1 << 64), size)
    if size <= 1 << 18:  # longer ones are not kept
        _POWERS[:] = [found]
    return found


def word_hashes(raw: bytes) -> np.ndarray:
    """A 64-bit hash of each word (A-Z lower-cased, split at white space 20, 09-0D)."""
    _, byte, space = _tables()
    b = np.frombuffer(raw.lower(), dtype=np.uint8)
    gap = np.concatenate([[True], space[b], [True]])
    edge = np.flatnonzero(gap[1:] != gap[:-1])
    start, end = edge[::2], edge[1::2]
    up, down = powers(len(b) + 1)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(byte[b] * up[:len(b)], dtype=np.uint64)])
    h = (total[end] - total[start]) * down[start]
    return mix(h + (end - start).astype(np.uint64))


def shingle_set(raw: bytes) -> np.ndarray:
    """Sorted distinct shingle hashes; fewer than five words make one shingle, none an empty set."""
    w = word_hashes(raw)
    if not len(w):
        return w
    n = max(1, len(w) - SHINGLE + 1)
    h = np.zeros(n, dtype=np.uint64)
    for k in range(min(SHINGLE, len(w))):
        h = mix(h * np.uint64(3) + w[k:k + n])
    return np.unique(h)


def signature(s: np.ndarray) -> np.ndarray:
    """The circulant MinHash coordinates of a non-empty set."""
    rows = _tables()[0]
    at = (mix(s ^ np.uint64(SEED)) >> np.uint64(44)).astype(np.int64)
    out = rows[at[:4096]].min(axis=0)
    for i in range(4096, len(at), 4096):
        np.minimum(out, rows[at[i:i + 4096]].min(axis=0), out=out)
    return out


def band_keys(sig: np.ndarray) -> np.ndarray:
    h = np.zeros(BANDS, dtype=np.uint64)
    for x in sig[:BANDS * ROWS].reshape(BANDS, ROWS).T:
        h = mix(h * np.uint64(5) + x.astype(np.uint64))
    return mix(h + np.arange(BANDS, dtype=np.uint64)).view(np.int64)


def early(percent: int) -> float:
    """Share of equal coordinates under which a link at ``percent`` is ruled out."""
    p = percent / 100
    return p - ERRORS * float(np.sqrt(p * (1 - p) / COORDINATES))


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def sets(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, set_id (hash of the whole set, null if empty), keys (band keys), sig (a byte per
    coordinate), tag (32 bits per band key)."""
    ship(docs.sparkSession)

    def run(batches):
        for b in batches:
            n, ids, keys, sigs, tags = [], [], [], [], []
            for raw in b.column(1).to_pylist():
                s = shingle_set(raw)
                n.append(len(s))
                if len(s):
                    sig = signature(s)
                    ids.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                    keys.append(band_keys(sig))
                    sigs.append((sig & 0xFF).astype(np.uint8).tobytes())
                    tags.append(keys[-1].astype("<u4").tobytes())
                else:
                    for x in (ids, keys, sigs, tags):
                        x.append(None)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.binary()), pa.array(keys, pa.list_(pa.int64())),
                 pa.array(sigs, pa.binary()), pa.array(tags, pa.binary())],
                ["doc_id", "n_shingles", "set_id", "keys", "sig", "tag"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), raw_text()).mapInArrow(
        tidy(run), "doc_id long, n_shingles long, set_id binary, keys array<long>, sig binary, tag binary")


def near(rows: DataFrame, percent: int) -> DataFrame:
    """``rows`` (a, b, na, nb, siga, sigb) whose sizes and signatures leave a link possible: a, b."""
    def run(batches):
        k = COORDINATES
        for b in batches:
            x, y = (np.frombuffer(b"".join(b.column(c).to_pylist()), np.uint8).reshape(-1, k) for c in ("siga", "sigb"))
            ok = pa.array((x == y).mean(axis=1) >= early(percent))
            yield pa.RecordBatch.from_arrays([b.column("a").filter(ok), b.column("b").filter(ok)], ["a", "b"])

    fits = F.least("na", "nb") * 100 >= F.greatest("na", "nb") * percent
    return rows.filter(fits).select("a", "b", "siga", "sigb").mapInArrow(tidy(run), "a long, b long")


def confirm(pairs: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """The distinct ``pairs`` (a, b) whose full sets are similar enough. ``texts``: doc_id, raw.

    Pairs are grouped by ``a`` in blocks of ``BLOCK`` others; a task reads a's
    text once per block, then the others one by one.
    """
    n_of = pairs.groupBy("a").agg(F.count(F.lit(1)).alias("n"))
    split = pairs.join(n_of, "a").withColumn(
        "block", F.pmod(F.xxhash64("b"), F.ceil(F.col("n") / BLOCK))).select("a", "block", "b")
    heads = split.select("a", "block").distinct().join(texts, F.col("a") == F.col("doc_id")) \
        .select("a", "block", F.lit(None).cast("long").alias("b"), "raw")
    rest = split.join(texts, F.col("b") == F.col("doc_id")).select("a", "block", "b", "raw")
    both = heads.unionAll(rest).repartition("a", "block").sortWithinPartitions("a", "block", F.col("b").asc_nulls_first())

    def run(batches):
        key, own = None, []
        for t in batches:
            out = [], []
            for a, block, b, raw in zip(*(t.column(i).to_pylist() for i in range(4)), strict=True):
                if b is None:
                    if (a, block) != key:
                        key, own = (a, block), []
                    own.append(shingle_set(raw))  # several where a doc_id repeats
                elif any(similar(x, shingle_set(raw), percent) for x in own):
                    out[0].append(a)
                    out[1].append(b)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], ["a", "b"])

    return both.mapInArrow(tidy(run), "a long, b long")


def _open_pairs(own, doc, comp, n, sig, tag, percent: int, key: int):
    """For each row of a block (pair) the rows after it that may link to it and meet it in no earlier band."""
    one = own.min() == own.max()
    here = tag == np.uint32(key & 0xFFFFFFFF)
    for r in range(len(doc)):
        ok = (comp != comp[r]) & ((doc > doc[r]) if one else (own > own[r]))
        ok &= np.minimum(n, n[r]) * 100 >= np.maximum(n, n[r]) * percent
        at = np.flatnonzero(ok)
        if len(at):
            at = at[(sig[at] == sig[r]).mean(axis=1) >= early(percent)]
        if len(at):
            both = tag[at] == tag[r]
            at = at[here[at, both.argmax(axis=1)]]
        if len(at):
            yield r, at


def _groups(batches, width: int):
    """(key, rows) of consecutive rows with equal first three columns."""
    key, rows = None, []
    for t in batches:
        for r in zip(*(t.column(i).to_pylist() for i in range(width)), strict=True):
            if r[:3] != key:
                if rows:
                    yield key, rows
                key, rows = r[:3], []
            rows.append(r[3:])
    if rows:
        yield key, rows


def _columns(rows):
    own, doc, comp, n = (np.array([r[k] for r in rows], dtype=np.int64) for k in range(4))
    sig, tag = (np.frombuffer(b"".join([r[k] for r in rows]), kind).reshape(len(rows), -1) for k, kind in ((4, np.uint8), (5, "<u4")))
    return own, doc, comp, n, sig, tag


def links_across(members: DataFrame, texts: DataFrame, scratch: Scratch, percent: int) -> DataFrame:
    """Confirmed links (a, b) between different components within buckets, enough to merge all that are linked.

    ``members``: key, doc, comp, n, sig, tag. A bucket of more than ``BLOCK``
    members is cut into blocks, and every pair of blocks goes to a task of its
    own. A first pass finds the members that have a candidate, a second one
    reads their texts. Of a pair that shares several bands only the first counts.
    """
    size = members.groupBy("key").agg(F.count(F.lit(1)).alias("m"))
    cut = members.join(size, "key").withColumn("blocks", F.ceil(F.col("m") / BLOCK).cast("int")) \
        .withColumn("own", F.pmod(F.xxhash64("doc"), F.col("blocks")).cast("int"))
    place = ["key", "i", "j"]
    rows = cut.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "doc", "comp", "n", "sig", "tag")

    def find(batches):
        names = [*place, "own", "doc", "comp", "n", "sig", "tag"]
        kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary()]
        for key, group in _groups(batches, 9):
            cols, live = _columns(group), set()
            for r, at in _open_pairs(*cols, percent, key[0]):
                live.add(r)
                live.update(at.tolist())
            if live:
                out = [(*key, *group[r]) for r in sorted(live)]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)

    schema = "key long, i int, j int, own int, doc long, comp long, n long, sig binary, tag binary"
    live = scratch.save(rows.repartition(*place).sortWithinPartitions(*place, "doc").mapInArrow(tidy(find), schema), "live")
    read = live.join(texts.withColumnRenamed("doc_id", "doc"), "doc").select(
        *place, "own", "doc", "comp", "n", "sig", "tag", "raw").repartition(*place).sortWithinPartitions(*place, "doc")

    def confirm_open(batches):
        for key, group in _groups(batches, 10):
            cols, known, root, found = _columns(group), {}, {}, []

            def top(c):
                while c in root:
                    c = root[c]
                return c

            def own_set(r):
                if r not in known:
                    known[r] = shingle_set(group[r][6])
                return known[r]

            for r, at in _open_pairs(*cols, percent, key[0]):
                for k in at.tolist():
                    x, y = top(group[r][2]), top(group[k][2])
                    if x != y and similar(own_set(r), own_set(k), percent):
                        root[x] = y
                        found.append((group[r][1], group[k][1]))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found, strict=True)], ["a", "b"])

    return read.mapInArrow(tidy(confirm_open), "a long, b long")


def components(docs: DataFrame, percent: int = 85) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: the groups of documents linked at ``percent`` Jaccard similarity.

    A document without words or text is linked with nothing. A null doc_id
    gets a null component and is kept; rows that repeat a doc_id are one
    document of the graph (with all their texts' copies) and each returned. Other columns are ignored.
    """
    s = Scratch(docs.sparkSession, "minhash")
    all_sets = s.save(sets(docs), "sets")
    known = all_sets.filter("doc_id is not null and set_id is not null")
    classes = known.groupBy("set_id").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n"))
    # a representative's row per class; equal sets have equal signatures and keys
    reps = known.join(classes.select("set_id", "rep"), "set_id").filter("doc_id = rep") \
        .groupBy("set_id").agg(F.first("rep").alias("doc"), F.first("n_shingles").alias("n"),
                               F.first("keys").alias("keys"), F.first("sig").alias("sig"), F.first("tag").alias("tag"))
    posts = reps.select("doc", F.explode("keys").alias("key"))
    buckets = posts.groupBy("key").agg(F.min("doc").alias("first"), F.max("doc").alias("last")).filter("first < last")
    posts = s.save(posts.join(buckets.select("key", "first"), "key"), "posts")  # only keys that several classes share
    sigs = s.save(reps.select("doc", "n", "sig", "tag").join(posts.select("doc").distinct(), "doc", "left_semi"), "sigs")
    texts = s.save(docs.select(F.col("doc_id").cast("long").alias("doc_id"), raw_text().alias("raw"))
                   .join(sigs.select(F.col("doc").alias("doc_id")).distinct().hint("merge"), "doc_id", "left_semi"), "texts")
    side = lambda x: sigs.select(F.col("doc").alias(x), F.col("n").alias(f"n{x}"), F.col("sig").alias(f"sig{x}"))
    star = posts.filter("doc <> first").select(F.col("first").alias("a"), F.col("doc").alias("b")).distinct()
    stars = near(star.join(side("a"), "a").join(side("b"), "b"), percent)
    links = s.save(confirm(s.save(stars, "stars"), texts, percent), "links")
    merged = connected_components(links, s, "first")
    placed = posts.join(merged.withColumnRenamed("node", "doc"), "doc", "left") \
        .select("key", "doc", F.coalesce("component", "doc").alias("comp"))
    mixed = placed.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo < hi").select("key")
    members = placed.join(mixed, "key").join(sigs, "doc").select("key", "doc", "comp", "n", "sig", "tag")
    found = s.save(links_across(members, texts, s, percent), "more")
    own = known.select("doc_id", "set_id").join(classes.select("set_id", "rep"), "set_id")
    copies = own.select(F.col("doc_id").alias("a"), F.col("rep").alias("b")).filter("a <> b")
    # copies join the graph only where a doc_id repeats with different texts; else the class's component is theirs
    linked = connected_components(merged.select(F.col("node").alias("a"), F.col("component").alias("b")).unionAll(found), s, "all")
    whole = _with_copies(own, copies, linked, s)
    out = s.save(all_sets.select("doc_id", "n_shingles").join(whole, "doc_id", "left").select(
        "doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"),
        F.coalesce(F.coalesce("component", "doc_id") == F.col("doc_id"), F.lit(True)).alias("kept")), "out")
    s.drop("sets", "posts", "sigs", "texts", "stars", "links", "live", "more")
    return out


def _with_copies(own: DataFrame, copies: DataFrame, linked: DataFrame, s: Scratch) -> DataFrame:
    """(doc_id, component) of every document that is linked or a copy."""
    roots = own.select("doc_id", "rep").distinct()
    labelled = roots.join(linked.withColumnRenamed("node", "rep"), "rep", "left") \
        .select("doc_id", F.coalesce("component", "rep").alias("component"))
    several = labelled.groupBy("doc_id").agg(F.min("component").alias("component"), F.max("component").alias("_hi"))
    apart = several.filter("component <> _hi")
    if apart.isEmpty():
        return several.drop("_hi")
    bridges = labelled.join(apart.select("doc_id"), "doc_id").select(F.col("doc_id").alias("a"), F.col("component").alias("b"))
    joined = connected_components(bridges.unionAll(linked.select(F.col("node").alias("a"), F.col("component").alias("b")))
                                  .unionAll(copies), s, "ids").withColumnRenamed("node", "doc_id")
    return several.drop("_hi").join(joined.withColumnRenamed("component", "_c"), "doc_id", "left") \
        .select("doc_id", F.coalesce("_c", "component").alias("component"))


def drop_near_duplicates(docs: DataFrame, percent: int = 85) -> DataFrame:
    """One document of each group stays, that with the smallest id (one without an id only if none has any);
    columns as they were. Rows that repeat a doc_id are documents of their own, as are rows without an id;
    of rows with equal id (or none) and text one stays."""
    return with_own_columns(docs, lambda d: _first_of_groups(d, percent))


def _first_of_groups(docs: DataFrame, percent: int) -> DataFrame:
    doc = F.col("doc_id").cast("long")
    if docs.groupBy(doc.alias("d")).count().filter("count > 1 or d is null").isEmpty():
        kept = components(docs, percent).filter("kept").select(F.col("doc_id").alias("_id"))
        return docs.join(kept, doc == F.col("_id"), "left_semi")
    s = Scratch(docs.sparkSession, "rows")
    rows = s.save(docs.withColumn("_row", F.monotonically_increasing_id()), "rows")
    found = components(rows.select(F.col("_row").alias("doc_id"), "text"), percent)
    ids = rows.select("_row", doc.alias("d"), F.md5(raw_text()).alias("h"))
    # rows without words are linked with nothing: there only equal rows are a group
    blank = F.col("n_shingles") == 0
    group = [F.when(~blank, F.col("component_id")), F.when(blank, F.col("d")), F.when(blank, F.col("h"))]
    best = ids.join(found, F.col("_row") == F.col("doc_id")) \
        .groupBy(*[g.alias(f"g{i}") for i, g in enumerate(group)]) \
        .agg(F.min(F.struct(F.col("d").isNull().alias("none"), "d", "h", "_row")).alias("best"))
    kept = s.save(best.select(F.col("best._row").alias("_row")), "kept")
    return rows.join(kept, "_row", "left_semi").select(*[F.col(f"`{c}`") for c in docs.columns])
