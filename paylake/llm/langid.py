"""Language identification: sparse multinomial logistic regression on TF-IDF
character n-grams, trained with follow-the-regularised-leader (FTRL-proximal,
L1 and L2 penalties), scores calibrated by a temperature.

Document frequencies cover every training row; the weights are fitted on a
sample of about ``SAMPLE_ROWS`` rows shared out evenly over the languages (eight
a language at least, so every language is learned), over the buckets that the
sample touches; predictions read whole texts.
"""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paylake.llm.common import crc32_of_id, ship, tidy

BUCKETS = 1 << 15
ORDERS = (1, 2, 3)
SAMPLE_ROWS = 3000
CHUNK = 1 << 18
ALPHA, BETA, L1, L2, EPOCHS = 0.5, 1.0, 0.002, 0.01, 4
_LETTER: list[np.ndarray] = []


def letters() -> np.ndarray:
    if not _LETTER:
        _LETTER.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), dtype=bool, count=0x110000))
    return _LETTER[0]


def codes(text: str) -> np.ndarray:
    """Lower-cased letters as code points; each run of anything else is one 32, as are both ends.
    Empty when the text has no letter."""
    c = np.frombuffer(text.lower().encode("utf-32-le", "replace"), dtype="<u4")
    c = np.where(letters()[c], c, 32)
    c = np.concatenate([[32], c, [32]])
    keep = np.ones(len(c), dtype=bool)
    keep[1:] = (c[1:] != 32) | (c[:-1] != 32)
    c = c[keep]
    return c.astype(np.uint64) if len(c) > 1 else c[:0].astype(np.uint64)


def ngram_counts(c: np.ndarray) -> np.ndarray:
    """Counts of hashed n-grams over ``BUCKETS``, chunk by chunk."""
    out = np.zeros(BUCKETS, dtype=np.int64)
    for s in range(0, len(c), CHUNK):
        part = c[s:s + CHUNK + max(ORDERS) - 1]
        h = np.zeros(len(part), dtype=np.uint64)
        for n in range(1, max(ORDERS) + 1):
            m = len(part) - n + 1
            if m <= 0:
                break
            h = h[:m] * np.uint64(0x9E3779B97F4A7C15) + part[n - 1:n - 1 + m]
            if n in ORDERS:
                x = ((h + np.uint64(n)) * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(64 - 15)
                out += np.bincount(x[:CHUNK].astype(np.int64), minlength=BUCKETS)
    return out


def features(counts: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, values): (1 + log tf) * idf, of length 1, with the constant feature last."""
    idx = np.flatnonzero(counts)
    v = (1 + np.log(counts[idx])) * idf[idx]
    v /= max(np.sqrt(v @ v), 1e-12)
    return np.append(idx, BUCKETS), np.append(v, 1.0)


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def ftrl(rows: list[tuple[np.ndarray, np.ndarray, int]], m: int, k: int, seed: int = 7) -> np.ndarray:
    """Weights (m, k) of rows over m features."""
    z, n = np.zeros((m, k)), np.zeros((m, k))

    def weight(zi, ni):
        return np.where(np.abs(zi) <= L1, 0, -(zi - np.sign(zi) * L1) / ((BETA + np.sqrt(ni)) / ALPHA + L2))

    rng = np.random.default_rng(seed)
    for _ in range(EPOCHS):
        for r in rng.permutation(len(rows)):
            idx, v, y = rows[r]
            zi, ni = z[idx], n[idx]
            w = weight(zi, ni)
            p = softmax(v @ w)
            p[y] -= 1
            g = v[:, None] * p
            n[idx] = ni + g * g
            z[idx] = zi + g - (np.sqrt(ni + g * g) - np.sqrt(ni)) / ALPHA * w
    return weight(z, n)


def temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """The divisor of the logits with the least log loss, by bisection of a unimodal curve."""
    if not len(y):
        return 1.0
    loss = lambda t: -np.log(np.maximum(softmax(logits / t)[np.arange(len(y)), y], 1e-12)).mean()
    lo, hi = np.log(0.05), np.log(20.0)
    for _ in range(40):
        a, b = lo + (hi - lo) / 3, hi - (hi - lo) / 3
        lo, hi = (lo, b) if loss(np.exp(a)) < loss(np.exp(b)) else (a, hi)
    return float(np.exp((lo + hi) / 2))


def document_frequencies(train: DataFrame) -> tuple[np.ndarray, int]:
    """Documents that hold each bucket (at most ``BUCKETS`` numbers reach the driver), and all documents."""
    def run(batches):
        df = np.zeros(BUCKETS + 1, dtype=np.int64)
        for b in batches:
            for t in b.column(0).to_pylist():
                df[:BUCKETS] += ngram_counts(codes(t or "")) > 0
                df[BUCKETS] += 1
        idx = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(idx), pa.array(df[idx])], ["bucket", "n"])

    rows = train.select("text").mapInArrow(tidy(run), "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    df = np.zeros(BUCKETS + 1, dtype=np.int64)
    for i, n in rows:
        df[i] = n
    return df[:BUCKETS], int(df[BUCKETS])


def fit(docs: DataFrame, sample_rows: int = SAMPLE_ROWS) -> dict:
    """Model of ``docs`` (doc_id, text, lang): languages, weights, idf and temperature.

    Rows without text or lang teach nothing; every language is learned. The sample is chosen by a hash of the row, so
    repeated rows count once.
    """
    spark = docs.sparkSession
    ship(spark)
    train = docs.filter("lang is not null and text is not null").select("doc_id", "text", "lang")
    counts = train.groupBy("lang").count().collect()
    langs = sorted(r[0] for r in counts)
    if not langs:
        return {"langs": [], "weights": np.zeros((1, 0)), "slot": np.zeros(BUCKETS + 1, np.int32), "idf": np.ones(BUCKETS), "temperature": 1.0}
    df, n = document_frequencies(train)
    idf = np.log((1 + n) / (1 + df)) + 1
    each = max(8, sample_rows // len(langs))
    share = spark.createDataFrame([(r[0], min(1.0, each / r[1])) for r in counts], "lang string, _share double")
    sample = train.join(F.broadcast(share), "lang").withColumn("_h", F.xxhash64("doc_id", "text", "lang")) \
        .filter(F.pmod("_h", F.lit(1 << 30)) < F.col("_share") * (1 << 30)) \
        .select("_h", "text", "lang").dropDuplicates(["_h"])

    def train_task(batches):  # one task: the sample is bounded
        rows, where = [], {x: i for i, x in enumerate(langs)}
        for b in batches:
            for h, t, lang in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                c = codes(t)
                if len(c):
                    idx, v = features(ngram_counts(c), idf)
                    rows.append((h, idx.astype(np.int32), v.astype(np.float32), where[lang]))
        rows.sort(key=lambda r: r[0])
        held = [r[1:] for i, r in enumerate(rows) if i % 5 == 0]
        used = [r[1:] for i, r in enumerate(rows) if i % 5] or held
        taught = {y for *_, y in used}
        used += [r for r in held if r[2] not in taught]  # a language of few rows is not only held out
        touched = np.unique(np.concatenate([np.zeros(0, np.int32), *(idx for idx, *_ in used)]))
        slot = np.full(BUCKETS + 1, len(touched), dtype=np.int32)  # the last row of the weights is 0
        slot[touched] = np.arange(len(touched))
        w = ftrl([(slot[idx], v, y) for idx, v, y in used], len(touched) + 1, len(langs))
        t = temperature(np.array([v @ w[slot[idx]] for idx, v, _ in held]).reshape(len(held), len(langs)),
                        np.array([y for *_, y in held], dtype=np.int64))
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps((w.astype(np.float32), slot, t))])], ["model"])

    w, slot, t = pickle.loads(sample.repartition(1).mapInArrow(tidy(train_task), "model binary").first()[0])
    return {"langs": langs, "weights": w, "slot": slot, "idf": idf.astype(np.float32), "temperature": t}


def predict(docs: DataFrame, model: dict) -> DataFrame:
    """doc_id, lang_pred, score. ``und`` with score 0 when the text is null or has no letter
    (or nothing was learned). Only the text is read."""
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = shared.value
        for b in batches:
            langs, scores = [], []
            for t in b.column(1).to_pylist():
                c = codes(t or "")
                if len(c) and m["langs"]:
                    idx, v = features(ngram_counts(c), m["idf"])
                    p = softmax(v @ m["weights"][m["slot"][idx]] / m["temperature"])
                    langs.append(m["langs"][int(p.argmax())])
                    scores.append(float(p.max()))
                else:
                    langs.append("und")
                    scores.append(0.0)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        tidy(run), "doc_id long, lang_pred string, score double")


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score: learned from the rows whose crc32(doc_id) mod 5 is not 0."""
    held = F.pmod(crc32_of_id(), F.lit(5)) == 0
    model = fit(docs.filter(~held))
    out = predict(docs, model)
    return out.select("doc_id", held.alias("held_out"), "lang_pred", "score")
