"""How far the sources of each language differ, and by which terms.

Documents become exact sparse count vectors as CountVectorizer defines them,
with one vocabulary per language, a least document frequency and no limit on
its size. That class keeps its vocabulary on the driver, which nothing bounds;
here the vocabulary is a table. Vectors of one (language, source) are summed in
each task before the shuffle, like Summarizer's buffers but sparse.

Pairs of sources are evaluated over the terms that both have only. A term that
just one of them has, or neither, contributes by its count alone, so those sums
come from the histogram of counts of each source. All numbers are integers.
"""

from __future__ import annotations

from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from paylake.llm.common import Scratch, raw_text, ship, tidy

MIN_DF = 3
SCALE = 1_000_000_000
TOP_TERMS = 200
HELD = 600_000  # entries of partial sums that a task holds before it hands them on
ONE_DOC = 1 << 40  # an entry holds documents and occurrences in one number; a task's texts hold fewer terms than this
CHUNK = 1 << 18  # pair evaluations at a time

_TERM = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def terms(text: bytes) -> list[bytes]:
    """Runs of letters A-Z (lower-cased), a-z and all characters beyond ASCII, in order."""
    return text.translate(_TERM).split()


def _labelled(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source"), raw_text())


def count_terms(docs: DataFrame) -> DataFrame:
    """(lang, source, term, docs, n): summed document vectors of each group; ``docs`` counts the
    documents that have the term. Null text, lang and source are empty; each row is a document.
    A group whose documents have no term has one row with a null term."""
    ship(docs.sparkSession)

    def run(batches):
        sums, groups, size = defaultdict(dict), set(), 0
        for b in batches:
            for lang, source, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
                groups.add((lang, source))
                held = sums[lang, source]
                get, before = held.get, len(held)
                for t, n in Counter(terms(text)).items():  # the document's vector
                    held[t] = get(t, 0) + ONE_DOC + n
                size += len(held) - before
                if size > HELD:
                    yield out(sums)
                    sums.clear()
                    size = 0
        yield out(sums, groups)

    def out(sums, groups=()):
        cols = [[], [], [], [], []]
        for (lang, source), held in sums.items():
            cols[0] += [lang] * len(held)
            cols[1] += [source] * len(held)
            cols[2] += held
            cols[3] += [v >> 40 for v in held.values()]
            cols[4] += [v & ONE_DOC - 1 for v in held.values()]
        for lang, source in groups:
            for c, v in zip(cols, (lang, source, None, 0, 0), strict=True):
                c.append(v)
        kinds = pa.string(), pa.string(), pa.binary(), pa.int64(), pa.int64()
        arrays = [pa.array(c, t) for c, t in zip(cols, kinds, strict=True)]
        arrays[2] = arrays[2].cast(pa.string(), safe=False)
        return pa.RecordBatch.from_arrays(arrays, ["lang", "source", "term", "docs", "n"])

    parts = _labelled(docs).mapInArrow(tidy(run), "lang string, source string, term string, docs long, n long")
    return parts.groupBy("lang", "source", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("n"))


def vocabulary(counts: DataFrame, min_df: int = MIN_DF) -> DataFrame:
    """(lang, term, total): terms in at least ``min_df`` documents of the language."""
    return counts.filter("term IS NOT NULL").groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("total")) \
        .filter(F.col("docs") >= min_df).drop("docs")


def vectors(docs: DataFrame, vocab: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, lang, terms: map term -> count): each document's sparse vector over its language's
    vocabulary. A document without kept terms has none; rows that share a key share a vector."""
    letters = F.translate(F.coalesce("text", F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = docs.select(key, F.coalesce("lang", F.lit("")).alias("lang"), F.explode(
        F.regexp_extract_all(letters, F.lit(r"([^\x00-\x40\x5B-\x60\x7B-\x7F]+)"), 1)).alias("term"))
    n = words.groupBy(key, "lang", "term").count().join(vocab.select("lang", "term"), ["lang", "term"])
    return n.groupBy(key, "lang").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("term", "count")))).alias("terms"))


def _share(n, total, v):
    """p = 1 + floor(SCALE * (n + 1) / (total + v)), exact beyond 64 bits in between."""
    return F.lit(1) + F.expr(f"(CAST({SCALE} AS DECIMAL(10,0)) * (CAST({n} AS DECIMAL(20,0)) + 1)) div ({total} + {v})")


def _f(p: str, q: str):
    return F.expr(f"(({p} - {q}) * ({p} - {q})) div {q}")


def _shared_terms(rows: DataFrame) -> DataFrame:
    """(lang, source, item, part): over terms that both have, f(p, q) less what f would be were
    the term missing on either or both sides. ``rows``: lang, term, source, p, base."""
    rows = rows.select("lang", "term", "source", "p", "base").repartition("lang", "term").sortWithinPartitions("lang", "term")
    ship(rows.sparkSession)

    def f(p, q):
        return (p - q) * (p - q) // q

    def run(batches):
        rest = None
        for b in batches:
            if not b.num_rows:
                continue
            t = pa.Table.from_batches([b])
            t = pa.concat_tables([rest, t]) if rest is not None else t
            last = _starts(t)[-1]  # the last term may go on in the next batch
            rest = t.slice(last)
            yield from pairs(t.slice(0, last))
        if rest is not None:
            yield from pairs(rest)

    def _starts(t):
        new = np.ones(t.num_rows, dtype=bool)
        if t.num_rows > 1:
            differ = pc.or_(pc.not_equal(t["lang"].slice(1), t["lang"].slice(0, t.num_rows - 1)),
                            pc.not_equal(t["term"].slice(1), t["term"].slice(0, t.num_rows - 1)))
            new[1:] = differ.to_numpy(zero_copy_only=False) if isinstance(differ, pa.Array) else differ.to_numpy()
        return np.flatnonzero(new)

    def pairs(t):
        if not t.num_rows:
            return
        starts = _starts(t)
        end = np.repeat(np.append(starts[1:], t.num_rows), np.diff(np.append(starts, t.num_rows)))
        lang, source = (t[c].combine_chunks().dictionary_encode() for c in ("lang", "source"))
        lc, sc = (a.indices.to_numpy().astype(np.int64) for a in (lang, source))
        p, base = t["p"].to_numpy(), t["base"].to_numpy()
        ls, ss = len(lang.dictionary), len(source.dictionary)
        keys, values = [], []
        held, shift = 0, 1
        i = np.arange(t.num_rows)
        while len(i := i[i + shift < end[i]]):  # i and i + shift have one term
            for at in range(0, len(i), CHUNK):
                a = i[at:at + CHUNK]
                for x, y in ((a, a + shift), (a + shift, a)):
                    v = f(p[x], p[y]) - f(p[x], base[y]) - f(base[x], p[y]) + f(base[x], base[y])
                    k, where = np.unique((lc[x] * ss + sc[x]) * ss + sc[y], return_inverse=True)
                    total = np.zeros(len(k), dtype=np.int64)
                    np.add.at(total, where, v)
                    keys.append(k)
                    values.append(total)
                    held += len(k)
                if held > CHUNK:
                    k, v = merge(keys, values)
                    keys, values, held = [k], [v], 0
                    if len(k) > CHUNK // 2:
                        yield out(k, v, lang, source, ss)
                        keys, values = [], []
            shift += 1
        if keys:
            yield out(*merge(keys, values), lang, source, ss)

    def merge(keys, values):
        k, where = np.unique(np.concatenate(keys), return_inverse=True)
        total = np.zeros(len(k), dtype=np.int64)
        np.add.at(total, where, np.concatenate(values))
        return k, total

    def out(k, v, lang, source, ss):
        return pa.RecordBatch.from_arrays(
            [lang.dictionary.take(pa.array(k // (ss * ss))), source.dictionary.take(pa.array(k // ss % ss)),
             source.dictionary.take(pa.array(k % ss)), pa.array(v)], ["lang", "source", "item", "part"])

    return rows.mapInArrow(tidy(run), "lang string, source string, item string, part long")


def audit(docs: DataFrame, min_df: int = MIN_DF, top: int = TOP_TERMS) -> DataFrame:
    """lang, source, part, item, value, rank: for every (lang, source) of ``docs`` its distance to
    each other source of the language (part pair, all ranks) and the terms it uses more than the
    language does (part term, ranks to ``top``).

    Null text, lang and source are empty. A language that keeps no term has pairs of value 0.
    Ties in value rank by item in UTF-8 order. An empty table gives no rows; repeated rows are
    documents of their own; further columns are ignored.
    """
    scratch = Scratch(docs.sparkSession, "divergence")
    counts = scratch.save(count_terms(docs), "counts")
    vocab = scratch.save(vocabulary(counts, min_df), "vocabulary")
    lang = vocab.groupBy("lang").agg(F.count(F.lit(1)).alias("v"), F.sum("total").alias("lang_n"))
    kept = scratch.save(
        counts.filter("term IS NOT NULL").join(vocab, ["lang", "term"]).select("lang", "source", "term", "n", "total"), "kept")
    n = kept.groupBy("lang", "source").agg(F.sum("n").alias("source_n"))
    groups = counts.select("lang", "source").distinct().join(n, ["lang", "source"], "left").join(lang, "lang", "left") \
        .na.fill(0, ["source_n", "v", "lang_n"])
    groups = scratch.save(groups.withColumn("base", F.when(F.col("v") > 0, _share("0L", "source_n", "nullif(v, 0)"))), "groups")
    rows = kept.join(groups, ["lang", "source"]).withColumn("p", _share("n", "source_n", "v"))

    term = rows.withColumn("q", _share("total", "lang_n", "v")).filter("p > q") \
        .select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), _f("p", "q").alias("value"))
    order = W.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    term = term.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)  # cut in each task before the shuffle

    # a term that one side alone has depends on its count there and the other side's base only
    by_count = rows.groupBy("lang", "source", "n", "p", "base").agg(F.count(F.lit(1)).alias("h"))
    other = groups.select("lang", F.col("source").alias("other"), F.col("base").alias("other_base"))
    single = by_count.join(other, "lang").filter("source <> other")
    nothing = _f("base", "other_base")
    to_other = single.groupBy("lang", "source", F.col("other").alias("item")).agg(
        F.sum(F.col("h") * (_f("p", "other_base") - nothing)).alias("part"))
    from_other = single.groupBy("lang", F.col("other").alias("source"), F.col("source").alias("item")).agg(
        F.sum(F.col("h") * (_f("other_base", "p") - _f("other_base", "base"))).alias("part"))
    none = groups.join(other, "lang").filter("source <> other").select(
        "lang", "source", F.col("other").alias("item"), F.coalesce(F.col("v") * nothing, F.lit(0).cast("long")).alias("part"))
    pair = none.unionByName(to_other).unionByName(from_other).unionByName(_shared_terms(rows)) \
        .groupBy("lang", "source", "item").agg(F.sum("part").alias("value")) \
        .select("lang", "source", F.lit("pair").alias("part"), "item", "value") \
        .withColumn("rank", F.row_number().over(order))
    out = scratch.save(pair.unionByName(term).withColumn("rank", F.col("rank").cast("int")), "result")
    scratch.drop("counts", "vocabulary", "kept", "groups")
    return out


def sql(min_df: int = MIN_DF, top: int = TOP_TERMS) -> str:
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    p = f"CAST(1 + ({SCALE}::HUGEINT * ({{n}} + 1)) // ({{total}} + v) AS BIGINT)"
    f = "(({p} - {q}) * ({p} - {q})) // {q}"
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, COALESCE(lang, '') AS lang, COALESCE(source, '') AS source, COALESCE(text, '') AS text FROM documents),
w AS (SELECT r, lang, source, translate(unnest(regexp_extract_all(text, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')), '{letters}', '{letters.lower()}') AS term FROM d),
vocab AS (SELECT lang, term, COUNT(*) AS total FROM w GROUP BY ALL HAVING COUNT(DISTINCT r) >= {min_df}),
l AS (SELECT lang, COUNT(*) AS v, CAST(SUM(total) AS BIGINT) AS lang_n FROM vocab GROUP BY 1),
c AS (SELECT lang, source, term, COUNT(*) AS n FROM w JOIN vocab USING (lang, term) GROUP BY ALL),
g AS (SELECT DISTINCT lang, source FROM d),
s AS (SELECT lang, source, CAST(COALESCE(SUM(n), 0) AS BIGINT) AS source_n FROM g LEFT JOIN c USING (lang, source) GROUP BY ALL),
cell AS (SELECT lang, source, term, COALESCE(n, 0) AS n, {p.format(n="COALESCE(n, 0)", total="source_n")} AS p, {p.format(n="total", total="lang_n")} AS q
         FROM s JOIN l USING (lang) JOIN vocab USING (lang) LEFT JOIN c USING (lang, source, term)),
pairs AS (SELECT a.lang, a.source, b.source AS item, CAST(SUM({f.format(p="a.p", q="b.p")}) AS BIGINT) AS value
          FROM cell a JOIN cell b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
item AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, COALESCE(value, 0) AS value
         FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
         LEFT JOIN pairs ON pairs.lang = a.lang AND pairs.source = a.source AND pairs.item = b.source
         UNION ALL SELECT lang, source, 'term', term, {f.format(p="p", q="q")} FROM cell WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank
FROM item QUALIFY part = 'pair' OR rank <= {top}"""
