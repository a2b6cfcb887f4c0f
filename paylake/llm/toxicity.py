"""Toxicity by non-negative positive-unlabelled (nnPU) learning.

Positives are confirmed toxic texts, the rest is unlabelled text of which a
share (the class prior) is toxic as well. The risk of the negative class is
estimated as unlabelled minus prior times positive and kept from going below
zero: a step that would make it negative is reversed. The model is a linear
one over the words and word beginnings that a text holds, in numpy.

Fitted on a bounded sample (``POSITIVES`` toxic and ``UNLABELLED`` other rows,
expected sizes); the prior is counted over all training labels; every text is
scored whole.
"""

from __future__ import annotations

import pickle
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paylake.llm.common import crc32_of_id, ship, tidy, with_own_columns

POSITIVES, UNLABELLED = 2500, 7500
PREFIXES = (3, 4, 5)
THRESHOLD = 0.3
STEPS, RATE, DECAY, GAMMA = 600, 0.05, 1e-4, 0.5
CACHE_WORDS = 200_000
_WORDS = re.compile(r"[^\W\d_]+")


def word_features(word: str) -> list[int]:
    """32-bit ids of a word and its beginnings."""
    return [zlib.crc32(("=" + word).encode())] + [zlib.crc32(("^" + word[:n]).encode()) for n in PREFIXES if len(word) >= n]


def words(text: str) -> set[str]:
    return set(_WORDS.findall(text.lower()))


def text_features(text: str, cache: dict) -> np.ndarray:
    out = set()
    for w in words(text):
        f = cache.get(w)
        if f is None:
            if len(cache) > CACHE_WORDS:
                cache.clear()
            f = cache[w] = word_features(w)
        out.update(f)
    return np.fromiter(out, dtype=np.uint32, count=len(out))


def choose(pos: list[np.ndarray], unl: list[np.ndarray], prior: float) -> np.ndarray:
    """Features that toxic texts hold much more often than the others can: all with enough support and lift."""
    ids, n_pos = np.unique(np.concatenate(pos), return_counts=True)
    ids, n_pos = (x[n_pos >= max(2, len(pos) // 200)] for x in (ids, n_pos))
    n_unl = np.zeros(len(ids))
    for f in unl:
        at = np.searchsorted(ids, f)
        at[at == len(ids)] = 0
        if len(ids):
            n_unl[at[ids[at] == f]] += 1
    # two standard errors against the feature on both sides, so that few positives bring few features
    seen = n_unl - prior * len(unl) * n_pos / len(pos)
    rate = np.maximum(0, n_pos - 2 * np.sqrt(n_pos)) / len(pos)
    other = (np.maximum(0, seen) + 2 * np.sqrt(np.maximum(0, seen)) + 1) / ((1 - prior) * max(1, len(unl)))
    lift = np.log((rate + 1e-6) / other)
    return ids[lift > np.log(2)]


def active(features: np.ndarray, ids: np.ndarray) -> np.ndarray:
    at = np.searchsorted(ids, features)
    at[at == len(ids)] = 0
    return at[ids[at] == features] if len(ids) else at[:0]


def train(pos: list[np.ndarray], unl: list[np.ndarray], n: int, prior: float) -> tuple[np.ndarray, float]:
    """nnPU with the (bounded) sigmoid loss and Adam over rows of active features; (weights, bias)."""
    rows = pos + unl
    flat = np.concatenate([*rows, np.zeros(0, np.int64)]).astype(np.int64)
    owner = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    is_pos = np.arange(len(rows)) < len(pos)
    w = np.zeros(n + 1)
    w[n] = np.log(prior / (1 - prior))
    m, v = np.zeros(n + 1), np.zeros(n + 1)
    for step in range(1, STEPS + 1):
        g = np.bincount(owner, weights=w[flat], minlength=len(rows)) + w[n]
        s = 1 / (1 + np.exp(-np.clip(g, -50, 50)))  # sigmoid loss: s of calling a row negative, 1 - s of positive
        slope = s * (1 - s)
        p, u = 1 / max(1, len(pos)), 1 / max(1, len(unl))
        negative = u * s[~is_pos].sum() - prior * p * s[is_pos].sum()
        d_negative = np.where(is_pos, -prior * p, u) * slope
        d = np.where(is_pos, -prior * p * slope, 0) + d_negative if negative >= 0 else -GAMMA * d_negative
        grad = np.append(np.bincount(flat, weights=d[owner], minlength=n)[:n], d.sum())
        grad[:n] += DECAY * w[:n]
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        w -= RATE * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-8)
    return w[:n], float(w[n]) + match_prior(np.bincount(owner, weights=w[flat], minlength=len(rows))[~is_pos] + w[n], prior)


def match_prior(g: np.ndarray, prior: float) -> float:
    """The shift of the unlabelled rows' logits at which their mean score is the class prior."""
    lo, hi = -20.0, 20.0
    for _ in range(60 if len(g) else 0):
        mid = (lo + hi) / 2
        lo, hi = (lo, mid) if (1 / (1 + np.exp(-np.clip(g + mid, -50, 50)))).mean() > prior else (mid, hi)
    return (lo + hi) / 2


def class_prior(labels: DataFrame) -> float:
    n, k = labels.filter("toxic is not null").agg(F.count(F.lit(1)), F.sum("toxic")).first()
    return float(np.clip((k or 0) / n if n else 0.05, 0.005, 0.995))


def fit(docs: DataFrame, labels: DataFrame, positives: int = POSITIVES, unlabelled: int = UNLABELLED) -> dict:
    """Model from ``docs`` (doc_id, text) and ``labels`` (doc_id, toxic), both already cut to training rows.

    The prior is the toxic share of the labelled rows. Null texts, null ids of
    labels and repeated rows teach nothing more. Without a toxic row every score is the prior.
    """
    spark = docs.sparkSession
    ship(spark)
    prior = class_prior(labels)
    toxic = labels.filter("toxic = 1 and doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    n_pos, n_docs = toxic.count(), docs.count()
    if not n_pos or not n_docs:
        return {"ids": np.zeros(0, np.uint32), "weights": np.zeros(0), "bias": float(np.log(prior / (1 - prior)))}
    unit = lambda *c: F.pmod(F.xxhash64(*c), F.lit(1 << 30)) / float(1 << 30)
    chosen = toxic.filter(unit("doc_id") < positives / n_pos).withColumn("_pos", F.lit(True))
    # chosen: about ``positives`` ids
    sample = docs.filter("text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text") \
        .join(F.broadcast(chosen), "doc_id", "left") \
        .withColumns({"_pos": F.coalesce("_pos", F.lit(False)),
                      "_unl": unit("doc_id", "text", F.lit("u")) < unlabelled / n_docs}) \
        .filter("_pos or _unl").groupBy(F.xxhash64("text").alias("_h")) \
        .agg(F.first("text").alias("text"), F.max("_pos").alias("_pos"), F.max("_unl").alias("_unl"))

    def train_task(batches):  # one task: the sample is bounded
        rows, cache = [], {}
        for b in batches:
            for h, t, *kinds in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                rows.append((h, text_features(t, cache), *kinds))
        rows.sort(key=lambda r: r[0])
        pos, unl = [f for _, f, y, _ in rows if y], [f for _, f, _, u in rows if u]
        model = {"ids": np.zeros(0, np.uint32), "weights": np.zeros(0), "bias": float(np.log(prior / (1 - prior)))}
        if pos:
            ids = choose(pos, unl, prior)
            w, bias = train([active(f, ids) for f in pos], [active(f, ids) for f in unl], len(ids), prior)
            model = {"ids": ids, "weights": w, "bias": bias}
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)])], ["model"])

    return pickle.loads(sample.repartition(1).mapInArrow(tidy(train_task), "model binary").first()[0])


def scorer(model: dict):
    """text -> score; keeps the features of words it has met."""
    table = dict(zip(model["ids"].tolist(), model["weights"].tolist(), strict=True))
    cache: dict[str, tuple] = {}

    def score(text: str | None) -> float:
        found = set()
        if text and table:
            for w in words(text):
                f = cache.get(w)
                if f is None:
                    if len(cache) > CACHE_WORDS:
                        cache.clear()
                    f = cache[w] = tuple(x for x in word_features(w) if x in table)
                if f:
                    found.update(f)
        g = model["bias"] + sum(table[x] for x in sorted(found))
        return 1 / (1 + float(np.exp(-np.clip(g, -50, 50))))

    return score


def predict(docs: DataFrame, model: dict) -> DataFrame:
    """``docs`` plus ``_score`` (0 to 1) of each whole text; a null text counts as empty."""
    spark = docs.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(model)
    text = docs.columns.index("text")

    def run(batches):
        score = scorer(shared.value)
        for b in batches:
            yield b.append_column("_score", pa.array([score(t) for t in b.column(text).to_pylist()], pa.float64()))

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(tidy(run), f"{schema}, _score double")


def fold_held() -> object:
    return F.pmod(crc32_of_id(), F.lit(4)) == 2


def detect(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted (score >= 0.3). Learned from the rows whose crc32(doc_id) mod 4 is not 2."""
    model = fit(docs.filter(~fold_held()), labels.filter(~fold_held()))
    out = predict(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), model)
    return out.select("doc_id", fold_held().alias("held_out"), F.col("_score").alias("score"),
                      (F.col("_score") >= THRESHOLD).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without the rows that the model calls toxic (a null text counts as empty, repeated
    rows are judged alike); columns as they were."""
    model = fit(docs.select("doc_id", "text").filter(~fold_held()), labels.filter(~fold_held()))
    return with_own_columns(docs, lambda d: predict(d, model).filter(F.col("_score") < THRESHOLD).select(*d.columns))
