import zlib

import numpy as np
import pytest

from paylake.llm import langid, toxicity, url_filter


def test_language_accuracy(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = {r.doc_id: r for r in langid.identify(docs).collect()}
    lang = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    assert set(got) == set(lang)
    held = [i for i in got if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(got[i].held_out == (i in set(held)) for i in got)
    assert np.mean([got[i].lang_pred == lang[i] for i in held]) >= 0.95
    assert all(0 <= r.score <= 1 for r in got.values())


def test_language_learns_nothing_from_held_out_rows(spark, sf):
    from pyspark.sql import functions as F
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    held = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 0
    other = docs.withColumn("lang", F.when(held, "xx").otherwise(F.col("lang")))
    key = lambda d: sorted(map(tuple, langid.identify(d).collect()))
    assert key(docs) == key(other)


def test_language_awkward_rows(spark, odd, empty):
    got = {r.doc_id: r for r in langid.identify(odd).collect()}
    assert got[1].lang_pred == got[2].lang_pred == got[3].lang_pred == "und" and got[1].score == 0
    assert langid.identify(odd).count() == odd.count()
    assert langid.identify(empty).count() == 0
    none = langid.identify(odd.selectExpr("doc_id", "text", "cast(null as string) lang"))
    assert {r.lang_pred for r in none.collect()} == {"und"}


def test_every_language_of_many_is_learned(spark):
    words = {f"l{k:03}": chr(0x4E00 + 3 * k) + chr(0x4E01 + 3 * k) for k in range(300)}
    rows = [(i * 300 + k, " ".join([w] * (3 + i)), lang) for k, (lang, w) in enumerate(words.items()) for i in range(2 if k < 290 else 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(docs)
    assert model["langs"] == sorted(words)
    got = {r.doc_id: r.lang_pred for r in langid.predict(docs, model).collect()}
    assert len({got[i] for i, *_ in rows}) > 285 and np.mean([got[i] == lang for i, _, lang in rows]) > 0.95


def test_temperature_calibrates():
    rng = np.random.default_rng(0)
    logits = rng.normal(size=(4000, 3))
    p = langid.softmax(logits)
    y = np.array([rng.choice(3, p=x) for x in p])
    assert langid.temperature(5 * logits, y) == pytest.approx(5, rel=0.15)


def test_chunks_count_alike(monkeypatch):
    c = langid.codes("The quick brown fox, jumps over 12 lazy dogs. " * 50)
    whole = langid.ngram_counts(c)
    monkeypatch.setattr(langid, "CHUNK", 17)
    assert (langid.ngram_counts(c) == whole).all() and whole.sum() == 3 * len(c) - 3


BAD = ("awful", "nasty", "vile")


@pytest.fixture(scope="module")
def toxic_docs(spark):
    rng = np.random.default_rng(1)
    vocabulary = [f"{a}{b}{c}" for a in "bdfgklmnprst" for b in "aeiou" for c in ("n", "sh", "rt", "lo", "mi")]
    docs, labels = [], []
    for i in range(3000):
        w = rng.choice(vocabulary, rng.integers(20, 120)).tolist()
        toxic = rng.random() < 0.12
        if toxic:
            for _ in range(3):
                w.insert(rng.integers(len(w)), str(rng.choice(BAD)))
        docs.append((i, " ".join(w)))
        if rng.random() < 0.6:
            labels.append((i, 1, int(toxic)))
    return (spark.createDataFrame(docs, "doc_id long, text string"),
            spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), dict(docs))


def test_toxicity_on_held_out_rows(toxic_docs):
    docs, labels, texts = toxic_docs
    got = {r.doc_id: r for r in toxicity.detect(docs, labels).collect()}
    truth = {i: any(b in t.split() for b in BAD) for i, t in texts.items()}
    held = [i for i in got if zlib.crc32(str(i).encode()) % 4 == 2]
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i in got)
    hit = [i for i in held if got[i].predicted]
    assert np.mean([truth[i] for i in hit]) >= 0.95 and np.mean([got[i].predicted for i in held if truth[i]]) >= 0.95
    assert all(got[i].predicted == int(got[i].score >= 0.3) for i in got)


def test_toxicity_ignores_held_out_labels(spark, toxic_docs):
    from pyspark.sql import functions as F
    docs, labels, _ = toxic_docs
    other = labels.withColumn("toxic", F.when(toxicity.fold_held(), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    key = lambda x: sorted(map(tuple, toxicity.detect(docs, x).collect()))
    assert key(labels) == key(other)


def test_toxicity_awkward_rows(spark, odd, empty):
    labels = spark.createDataFrame([(4, 1), (None, 1), (4, 1), (6, 0), (7, None)], "doc_id long, toxic int")
    got = toxicity.detect(odd, labels).collect()
    assert len(got) == odd.count() and all(0 <= r.score <= 1 for r in got)
    assert toxicity.detect(empty, labels).count() == 0
    assert len(toxicity.detect(odd, labels.limit(0)).collect()) == odd.count()
    kept = toxicity.drop_toxic(odd, labels)
    assert kept.columns == odd.columns and kept.count() <= odd.count()


def test_urls_match_sql_and_awkward_rows(spark):
    import duckdb
    urls = [None, "", "no scheme", "http://A.NET/x", "http://a.net", "https://b.Example.NET/en/1", "x://example.net/en", "s://example.com/de/?q",
            "s://org/fr/#a", "s://notorg/fr/", "s://u/?casino", "s://u/casinos", "s://free.win/now", "s://free/free-xfree", "s://h/free\n://bet",
            "http://h?x/y#z", "http://h#/net/", "://net/", "http://\u00c9COLE.example.org/fr/a b", "s://u/p%20xxx"]
    rows = [(i, u, "h") for i, u in enumerate(urls)] + [(None, "s://k/", None), (0, None, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'z' host", "'y' verdict", "1 weight")
    got = sorted((str(r.page_id), r.host, r.path, str(r.rule), r.verdict) for r in url_filter.filter_urls(pages).collect())
    c = duckdb.connect()
    c.execute("CREATE TABLE pages (page_id BIGINT, url VARCHAR, html VARCHAR)")
    c.executemany("INSERT INTO pages VALUES (?, ?, ?)", rows)
    want = sorted((str(r[0]), r[1], r[2], str(r[3]), r[4]) for r in c.execute(url_filter.sql()).fetchall())
    assert got == want
    by = {r.page_id: r for r in url_filter.filter_urls(pages).collect() if r.page_id}
    assert by[10].verdict == "block" and by[11].verdict == "allow" and by[12].verdict == "block" and by[13].verdict == "allow"
    assert url_filter.filter_urls(pages.limit(0)).count() == 0


def test_wide_toxic_vocabulary_is_learned(spark):
    """1,500 toxic words, a few to a text: no cap on what is learned."""
    rng = np.random.default_rng(3)
    word = lambda k, c: c + "".join(chr(97 + int(x)) for x in rng.integers(0, 26, 7)) + str(k)[:0]
    bad, good = [word(k, "q") for k in range(1500)], [word(k, "m") for k in range(4000)]
    rows, labels = [], []
    for i in range(6000):
        toxic = i % 5 == 0
        w = list(rng.choice(good, 30)) + (list(rng.choice(bad, 6)) if toxic else [])
        rows.append((i, " ".join(w)))
        labels.append((i, int(toxic)))
    got = toxicity.detect(spark.createDataFrame(rows, "doc_id long, text string"),
                          spark.createDataFrame(labels, "doc_id long, toxic int")).collect()
    y = {i: t for i, t in labels}
    held = [r for r in got if r.held_out]
    assert np.mean([r.predicted for r in held if y[r.doc_id]]) >= 0.7
    assert np.mean([r.predicted for r in held if not y[r.doc_id]]) <= 0.01
