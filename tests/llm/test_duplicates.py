import hashlib
import random

import numpy as np
import pytest

import corpus_pipeline
from paylake.llm import cap_filters, induced_sort, minhash, suffix_dedup
from paylake.llm.common import Scratch, connected_components
from paylake.llm.induced_sort import sort_suffixes

from . import brute


@pytest.mark.parametrize("shape", ["path", "star", "random", "rings"])
def test_components(spark, shape):
    rng = random.Random(shape)
    pairs = {"path": [(i, i + 1) for i in range(60)], "star": [(i, 500) for i in range(80)],
             "random": [(rng.randrange(100), rng.randrange(100)) for _ in range(70)],
             "rings": [(10 * r + i, 10 * r + (i + 3) % 10) for r in range(6) for i in range(10)]}[shape]
    pairs += pairs[:5] + [(7, 7)]
    edges = spark.createDataFrame(pairs, "a long, b long")
    got = {r.node: r.component for r in connected_components(edges, Scratch(spark, "cc-test")).collect()}
    nodes = {x for p in pairs if p[0] != p[1] for x in p}
    assert got == brute.groups([p for p in pairs if p[0] != p[1]], nodes)


def test_components_of_nothing(spark):
    edges = spark.createDataFrame([], "a long, b long")
    assert connected_components(edges, Scratch(spark, "cc-test")).count() == 0


def near_texts():
    """Chains of near copies, exact copies, short texts and strangers."""
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(400)]
    out = {}
    for g in range(25):
        base = [rng.choice(words) for _ in range(rng.choice([30, 80, 200]))]
        for c in range(rng.choice([1, 2, 6, 12])):
            t = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 3])):
                t[rng.randrange(len(t))] = rng.choice(words)
            out[len(out) * 3 + 5] = " ".join(t)
            if c % 4 == 3:
                base = t  # drift: the group is a chain
    out |= {1: "a b c", 2: "A  b\tc", 3: "", 4: None, 6: "a b c d", 7: "a b c d e"}
    return out


@pytest.mark.parametrize("block", [1024, 3])
def test_near_duplicates_against_all_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(minhash, "BLOCK", block)
    texts = near_texts()
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(5)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.components(docs).collect()}
    assert got == brute.near_duplicates(texts, 85)
    assert len({c for _, c in got.values()}) < len(got) - 20


def test_near_duplicates_whole_table(spark, sf, texts):
    import __spark_entry__ as E
    got = E.queries()["op8_circulant_minhash"](spark, sf).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute.near_duplicates(texts, 85)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_near_duplicates_awkward_rows(spark, odd, empty):
    got = minhash.components(odd).collect()
    assert len(got) == odd.count()
    by = {r.doc_id: r for r in got}
    assert by[5].component_id == 4 and not by[5].kept and by[None].kept and by[None].component_id is None
    assert by[1].n_shingles == by[2].n_shingles == by[3].n_shingles == 0 and by[3].kept
    assert minhash.components(empty).count() == 0
    kept = minhash.drop_near_duplicates(odd)
    assert kept.columns == odd.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(map(str, [1, 2, 3, 4, 6, 7, 8, None]))
    assert minhash.drop_near_duplicates(empty).count() == 0


def test_a_doc_id_with_two_texts_joins_their_groups(spark):
    a, b = (" ".join(f"{c}{i}" for i in range(40)) for c in "ab")
    docs = spark.createDataFrame([(9, a), (9, b), (3, a), (4, b), (5, "x")], "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in minhash.components(docs).collect()}
    assert got == {9: 3, 3: 3, 4: 3, 5: 5}


def test_rows_with_repeated_or_no_ids_are_compared_one_by_one(spark):
    a, b, c, d = (" ".join(f"{c}{i}" for i in range(60)) for c in "abcd")
    near = lambda t: t + " more"
    rows = [(9, a), (9, b), (3, near(a)), (9, c), (9, c), (None, d), (None, near(d)), (None, near(b)), (None, "x"), (None, "x"),
            (None, "y"), (8, ""), (8, ""), (7, ""), (None, None), (None, " ")]
    docs = spark.createDataFrame([(i, t, k) for k, (i, t) in enumerate(rows)], "doc_id long, text string, n int").repartition(3)
    kept = minhash.drop_near_duplicates(docs, 80)
    got = sorted(((r.doc_id, r.text) for r in kept.collect()), key=str)
    assert kept.columns == docs.columns
    assert [x for x in got if x[1] not in (d, near(d))] == sorted(
        [(3, near(a)), (9, b), (9, c), (None, "x"), (None, "y"), (8, ""), (7, ""), (None, None), (None, " ")], key=str)
    assert len(got) == 10


def test_signature_estimates_similarity():
    rng = np.random.default_rng(0)
    for share in (0.3, 0.6, 0.9):
        est = []
        for _ in range(30):
            x = rng.integers(0, 1 << 63, 400, dtype=np.uint64)
            both = int(400 * share)
            y = np.concatenate([x[:both], rng.integers(0, 1 << 63, 400 - both, dtype=np.uint64)])
            est.append((minhash.signature(np.unique(x)) == minhash.signature(np.unique(y))).mean())
        assert np.mean(est) == pytest.approx(both / (800 - both), abs=0.03)


def unit_rows(seed=0, n=400, d=64):
    rng = np.random.default_rng(seed)
    rows, vecs = [], []
    for i in range(n):
        v = rng.normal(size=d)
        if vecs and rng.random() < 0.5:
            w = vecs[rng.integers(len(vecs))]
            v = w if rng.random() < 0.3 else w + v * rng.choice([0.02, 0.05, 0.06]) * np.linalg.norm(w) * np.sqrt(64 / d) / 1.0 / np.sqrt(1)
        vecs.append(v)
        rows.append((i * 2 + 1, [float(np.float32(x)) for x in v], int(rng.integers(3))))
    return rows


def exact_links(rows, limit=0.93):
    out, pairs = {r[0]: 0 for r in rows}, []
    for i, (a, x, la) in enumerate(rows):
        for b, y, lb in rows[:i]:
            if la == lb and np.dot(x, y) / (np.linalg.norm(x) * np.linalg.norm(y)) >= limit:
                out[a] += 1
                out[b] += 1
                pairs.append((a, b))
    comp = brute.groups(pairs, out)
    return {i: (out[i], comp[i]) for i in out}


@pytest.mark.parametrize("d,block", [(64, 1024), (64, 4), (5, 1024), (1, 1024)])
def test_embeddings_against_all_pairs(spark, monkeypatch, d, block):
    monkeypatch.setattr(cap_filters, "BLOCK", block)
    rows = unit_rows(d, 400 if d > 5 else 80, d)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(3)
    got = {r.vec_id: (r.n_links, r.component_id) for r in cap_filters.near_duplicates(df).collect()}
    want = exact_links(rows)
    assert sum(n for n, _ in want.values()) > 40 or d == 1
    if d >= 5:
        missed = sum(want[i][0] - got[i][0] for i in want)
        assert missed <= 0.01 * sum(n for n, _ in want.values()) and all(got[i][0] <= want[i][0] for i in want)
    else:
        assert got == want


def test_embeddings_whole_table(spark, sf):
    import __spark_entry__ as E
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    got = E.queries()["op4_cap_filters"](spark, sf).collect()
    assert {r.vec_id: (r.n_links, r.component_id) for r in got} == exact_links(rows)
    assert all(r.kept == (r.vec_id == r.component_id) for r in got)


def test_embeddings_awkward_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0], 1, "a"), (2, [2.0, 0.0], 1, "b"), (3, [1.0, 0.0], 2, "c"), (4, [0.0, 0.0], 1, None), (5, None, 1, "d"),
            (6, [], 1, "e"), (7, [nan, 1.0], 1, "f"), (8, [inf, 1.0], 1, "g"), (9, [None, 1.0], 1, "h"), (10, [1.0, 0.0], None, "i"),
            (11, [1.0, 0.0, 0.0], 1, "j"), (None, [1.0, 0.0], 1, "k"), (12, [1.0, 0.0], 1, "l"), (13, [1e300, 0.0], 1, "m"), (2, [2.0, 0.0], 1, "n")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, component_id string")
    got = cap_filters.near_duplicates(df).collect()
    assert len(got) == len(rows)
    by = {r.vec_id: r for r in got}
    assert {i for i in by if i and by[i].component_id == 1} == {1, 2, 12, 13}
    assert by[1].n_links == by[12].n_links == 4 and all(by[i].n_links == 0 for i in (3, 4, 5, 6, 7, 8, 9, 10, 11, None))
    assert cap_filters.near_duplicates(df.limit(0)).count() == 0


def test_embeddings_of_repeated_ids_are_vectors_of_their_own(spark):
    rows = [(1, [1.0, 0.0], 1), (1, None, 1), (2, [0.0, 1.0], 1), (2, [0.0, 0.0], 1), (3, [1.0, 1.0], None),
            (5, [1.0, 0.0], 2), (5, [0.0, 1.0], 3), (6, [1.0, 0.0], 2), (7, [0.0, 1.0], 3), (4, [0.0, 1.0], 3), (5, [1.0, 0.01], 2)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = sorted((r.vec_id, r.n_links, r.component_id) for r in cap_filters.near_duplicates(df).collect())
    assert got == [(1, 0, 1), (1, 0, 1), (2, 0, 2), (2, 0, 2), (3, 0, 3), (4, 2, 4), (5, 2, 4), (5, 2, 5), (5, 2, 5), (6, 2, 5), (7, 2, 4)]


@pytest.mark.parametrize("seed", range(40))
def test_induced_sort_against_plain_sort(seed, tmp_path):
    rng = random.Random(seed)
    n, k = rng.randrange(1, 150), rng.randrange(1, 5)
    t = [rng.randrange(1, k + 1) for _ in range(n)]
    if seed % 3 == 0:
        t = (t[:6] * n)[:n]
    if seed % 7 == 0:
        t = [1] * n
    end = [*t, 0]
    order = sorted(range(n + 1), key=lambda i: end[i:])
    lcp = [0]
    for a, b in zip(order, order[1:]):
        m = 0
        while max(a, b) + m <= n and end[a + m] == end[b + m]:
            m += 1
        lcp.append(m)
    pos, got = sort_suffixes(np.array(t), 200, memory=150 if seed % 2 else 1 << 20, folder=str(tmp_path))
    assert pos.tolist() == order and np.minimum(got, 200).tolist() == lcp
    assert not list(tmp_path.iterdir())


@pytest.mark.parametrize("block", [3, 1 << 16])
@pytest.mark.parametrize("seed", range(4))
def test_induced_sort_of_longer_texts(seed, block, monkeypatch):
    monkeypatch.setattr(induced_sort, "BLOCK", block)
    rng = random.Random(seed)
    t = [rng.randrange(1, (3, 28, 300, 28)[seed]) for _ in range(4000)]
    if seed == 3:
        t = t[:500] * 3 + [1] * 60 + t[:900] + [27] * 300 + t[700:1500]
    end = [*t, 0]
    order = sorted(range(len(end)), key=lambda i: end[i:i + 1800])
    pos, lcp = sort_suffixes(np.array(t), 2000)
    assert pos.tolist() == order
    for i in range(1, len(order), 7):
        a, b = end[order[i - 1]:], end[order[i]:]
        assert min(lcp[i], 2000) == min(next(k for k, (x, y) in enumerate(zip(a, b)) if x != y), 2000)


def test_induced_sort_passes_whole_queues(monkeypatch):
    """A queue's small parts are passed on together: the calls grow with the symbols, not with their square."""
    calls, real = [], induced_sort.Induction._pass
    monkeypatch.setattr(induced_sort.Induction, "_pass", lambda self, source, *a: (calls.append(len(source[0])), real(self, source, *a))[1])
    rng = np.random.default_rng(1)
    sort_suffixes(rng.integers(1, 101, 200_000), 100)
    assert sum(calls) > 400_000 and len(calls) < 2 * 100 * 10


@pytest.mark.parametrize("names", [4, 50_000, 3_000_000])
def test_names_are_sorted_by_growing_prefixes(names):
    rng = np.random.default_rng(names)
    s = rng.integers(1, names, 300)
    s = np.concatenate([s, s[:200], s[50:], np.full(40, 2), s[:200]])
    assert induced_sort.sort_names(s).tolist() == sorted(range(len(s)), key=lambda i: s[i:].tolist())


def test_short_texts_are_scanned_together(monkeypatch):
    """Many texts a call, with the rows that each text has on its own."""
    rng = random.Random(3)
    docs = [(i, 0, bytes(rng.choice(b"abc ") for _ in range(rng.choice([0, 99, 100, 130, 400, 900])))) for i in range(400)]
    calls, real = [], suffix_dedup.stretches
    monkeypatch.setattr(suffix_dedup, "stretches", lambda *a: (calls.append(1), real(*a))[1])
    rows = lambda pieces: [r for b in suffix_dedup._emit(pieces, 24) for r in zip(*(c.to_pylist() for c in b.columns))]
    together, n = rows(docs), len(calls)
    alone = [r for d in docs for r in rows([d])]
    assert n <= 2 and sorted(together) == sorted(alone) and {r[3] for r in alone} == {i for i, _, t in docs if len(t) >= 100}


def repeated_docs():
    rng = random.Random(5)
    text = lambda n: bytes(rng.choice(b"abcdefgh ") for _ in range(n))
    line, docs = text(150), {}
    for i in range(60):
        d = text(rng.choice([0, 40, 99, 100, 300, 900]))
        for _ in range(rng.choice([0, 0, 1, 2])):
            at = rng.randrange(len(d) + 1)
            d = d[:at] + rng.choice([line, line[20:130], line[:99]]) + d[at:]
        docs[i * 2 - 20] = rng.choice(list(docs.values())) if docs and i % 9 == 0 else d
    docs |= {200: b"z" * 5000, 201: b"z" * 120, 202: b"xy" * 400, 203: "é".encode() * 90, 204: b"", 205: "qé".encode() * 70}
    return docs


@pytest.mark.parametrize("hot,shard,merge,chunk", [(20_000, 1 << 22, 400_000, 1 << 17), (2, 3000, 50, 64)])
def test_repeats_against_every_window(spark, monkeypatch, hot, shard, merge, chunk):
    for k, v in dict(HOT=hot, SHARD_BYTES=shard, MERGE_ROWS=merge).items():
        monkeypatch.setattr(suffix_dedup, k, v)
    monkeypatch.setattr(suffix_dedup, "CHUNK", chunk)
    docs = repeated_docs()
    df = spark.createDataFrame([(i, d.decode()) for i, d in docs.items()], "doc_id long, text string").repartition(4)
    got = {r.doc_id: tuple(r)[1:] for r in suffix_dedup.digests(df).collect()}
    assert got == brute.repeated(docs)


def test_repeats_whole_table(spark, sf, texts):
    import __spark_entry__ as E
    got = {r.doc_id: tuple(r)[1:] for r in E.queries()["op10_induced_suffix_dedup"](spark, sf).collect()}
    assert got == brute.repeated({i: (t or "").encode() for i, t in texts.items()})


def test_repeats_awkward_rows(spark, odd, empty):
    got = suffix_dedup.digests(odd).collect()
    assert len(got) == odd.count()
    by = {r.doc_id: r for r in got}
    assert by[1].n_bytes == by[2].n_bytes == 0 and by[6].n_removed == 30000 - 1 and by[6].n_spans == 1
    assert suffix_dedup.digests(empty).count() == 0
    cut = suffix_dedup.drop_repeated_text(odd)
    assert cut.columns == odd.columns and [f.dataType for f in cut.schema] == [f.dataType for f in odd.schema]
    rows = {(r.doc_id, r.lang): r for r in cut.collect()}
    assert rows[1, "en"].text is None and rows[6, "de"].text == "A" and rows[6, "de"].n_chars == 1 and rows[1, "en"].kept == "k"
    assert suffix_dedup.drop_repeated_text(empty).count() == 0


def test_repeats_in_texts_that_share_a_doc_id(spark):
    a, b = "abcdefghij" * 9 + "0123456789" * 2, "x" * 50
    rows = [(1, b + a), (1, a + b), (1, a + b), (2, a)]
    got = suffix_dedup.digests(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == 4 and [r.n_removed for r in got if r.doc_id == 2] == [110]
    first = [r for r in got if r.doc_id == 1]
    assert sorted(r.n_removed for r in first) in ([0, 0, 110], [0, 110, 110])


@pytest.mark.parametrize("doc_id", [1, None, -(1 << 63)])
def test_texts_with_one_doc_id_and_equal_checksums(spark, doc_id):
    import zlib
    y, z = "".join(chr(97 + i * i % 23) for i in range(70)) * 2, "other words " * 20
    a, b = "plumless" + y + z, "buckeroo" + y + z
    assert zlib.crc32(a.encode()) == zlib.crc32(b.encode())
    docs = spark.createDataFrame([(doc_id, a), (doc_id, b), (doc_id, b), (7, "x" * 30)], "doc_id long, text string").repartition(3)
    rows = suffix_dedup.digests(docs).collect()
    got = {(r.doc_id, r.n_bytes, r.kept_sha256): r.n_removed for r in rows}
    order = sorted((a, b), key=lambda t: hashlib.md5(t.encode()).hexdigest())
    want = {(doc_id, len(a), v[3]): v[1] for v in brute.repeated({i: t.encode() for i, t in enumerate(order)}).values()}
    assert got == want | {(7, 30, hashlib.sha256(b"x" * 30).hexdigest()): 0} and len(rows) == 4 and len(want) == 2


def test_pipeline_stages(spark, sf, texts):
    """Each stage against its own operator or brute force on what the stage before kept."""
    from paylake.llm import decontaminate, toxicity
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    columns, scratch = docs.columns, Scratch(spark, "pipeline-test")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "minhash", "suffix_dedup", "decontamination", "packing"]
    kept = [docs]
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        kept.append(scratch.save(stage(spark, kept[-1], sf), str(i)))
    assert all(k.columns == columns for k in kept[:-1])
    rows = [{r.doc_id: r.text for r in k.select("doc_id", "text").collect()} for k in kept[:-1]]
    good = {r.doc_id for r in toxicity.detect(docs, labels).collect() if not r.predicted}
    assert set(rows[1]) == good
    groups = brute.near_duplicates(rows[1], 80)
    assert set(rows[2]) == {i for i, (_, c) in groups.items() if i == c}
    sizes = brute.repeated({i: t.encode() for i, t in rows[2].items()})
    assert set(rows[3]) == set(rows[2])
    assert all(len(rows[3][i].encode()) in range(n - gone - 6, n - gone + 1) for i, (n, gone, *_) in sizes.items())
    items = [(r.item_id, decontaminate.normalise(r.text.encode())) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    clean = {i: decontaminate.normalise(t.encode()) for i, t in rows[3].items()}
    assert set(rows[4]) <= {i for i, t in clean.items() if not any(p in t for _, p in items)}
    assert len(rows[4]) >= 0.9 * len(rows[3])
    assert {r.doc_id for r in kept[-1].collect()} == set(rows[4])
    run = corpus_pipeline.run(spark, sf)
    assert sorted((r.doc_id, r.piece, r.ids_crc32) for r in run.collect()) == sorted((r.doc_id, r.piece, r.ids_crc32) for r in kept[-1].collect())


def test_pipeline_stages_take_awkward_rows(spark, odd, empty, tmp_path):
    spark.createDataFrame([(4, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "a benchmark item of some words, long enough to be looked for"), (2, None)],
                          "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for docs in (odd, empty):
        for name, stage in corpus_pipeline.STAGES:
            docs = Scratch(spark, "odd").save(stage(spark, docs, str(tmp_path)), name)
        assert "sequence_id" in docs.columns


def test_stages_take_any_column_names(spark, sf):
    """Names that the stages use inside, with repeated and null ids."""
    import corpus_pipeline as P
    names = ["_row", "_id", "_doc", "_score", "_null", "_hash", "_rest", "_null_id", "h", "d", "best", "extra_0", "sig"]
    rows = [(i if i % 5 else None, f"a short text of number {i // 2} with some more words in it " * 3, "en", "s", 1) for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long") \
        .selectExpr("*", *[f"'{n}' as {n}" for n in names])
    for name, stage in P.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns, name
        assert {tuple(r) for r in out.select(names).collect()} <= {tuple(names)}, name


def test_stretches_are_equal_only_by_both_hashes():
    """Rows of one key and first hash: those with another second hash stay, also where they alternate."""
    import numpy as np

    from paylake.llm import suffix_dedup as X
    h2 = np.array([1, 2, 1, 2, 1, 3], dtype=np.int64)
    one = np.ones(6, dtype=np.int64)
    rows = [one, 5 * one, h2, np.arange(6, dtype=np.int64), 0 * one, one]
    got = [b for b in X._distinct([tuple(rows)])]
    kept = [r for b in got for r in b.to_pylist() if r["n"] > 0]
    assert [(r["doc"], r["hash2"]) for r in kept] == [(0, 1), (1, 2), (5, 3)]
    assert sorted(r["doc"] for b in got for r in b.to_pylist() if r["n"] < 0) == [2, 3, 4]
    order = np.lexsort((rows[3], h2))
    out = [r for b in X._compare([X._batch([c[order] for c in rows])]) for r in b.to_pylist()]
    assert sorted(r["doc"] for r in out if r["n"] < 0) == [2, 3, 4] and sorted(r["doc"] for r in out if r["n"] > 0) == [0, 1, 5]
