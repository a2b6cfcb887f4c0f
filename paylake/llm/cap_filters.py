"""Near-duplicate embeddings by spherical-cap filters from random product codes.

A vector, turned by each of ``TURNS`` random structured rotations (sign flips
and Hadamard transforms), is cut into two blocks, each with a codebook of
random unit vectors. The filter directions are all pairs of codewords; list decoding
(sort one block's products, search for what each of the other's needs) finds
every direction whose cap holds the vector without going through all of them.
Vectors of a label meet in the caps they share and are verified there in
double precision. ``codes`` sizes the codebooks so that a pair at the limit
shares ``SHARED`` caps on average and none of 400 simulated pairs is missed.

Equal vectors of a label form a class and enter once, with their number.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paylake.llm.common import Scratch, connected_components, ship, tidy

MIN_COS = 0.93
TAU = 3.5  # cap height in standard deviations of a random direction's product
MAX_HEIGHT = 0.6
SHARED = 20
TURNS = 8
BLOCK = 1024
SEED = 77
_CODES: dict = {}


def _turn(x: np.ndarray, signs: np.ndarray) -> np.ndarray:
    """Three rounds of sign flips and a normalised Hadamard transform of the rows."""
    n = x.shape[1]
    for s in signs:
        x = x * s
        h = 1
        while h < n:
            x = x.reshape(-1, n // (2 * h), 2, h)
            x = np.concatenate([x[:, :, :1] + x[:, :, 1:], x[:, :, :1] - x[:, :, 1:]], axis=2).reshape(-1, n)
            h *= 2
        x = x / np.sqrt(n)
    return x


def _units(rng, n: int, d: int) -> np.ndarray:
    x = rng.standard_normal((n, d))
    return x / np.linalg.norm(x, axis=1, keepdims=True)


class Codes:
    """Codebooks for vectors of ``dim`` components and a cosine limit; the same wherever they are built."""

    def __init__(self, dim: int, min_cos: float):
        rng = np.random.default_rng([SEED, dim])
        self.dim, self.width = dim, max(4, 1 << (dim - 1).bit_length())
        self.signs = rng.choice([-1.0, 1.0], (TURNS, 3, self.width))
        self.height = min(TAU / np.sqrt(self.width), MAX_HEIGHT)
        a = np.zeros((400, self.width))
        a[:, :dim] = _units(rng, 400, dim)
        other = np.zeros_like(a)
        other[:, :dim] = rng.standard_normal((400, dim))
        other -= (other * a).sum(axis=1, keepdims=True) * a
        norm = np.linalg.norm(other, axis=1, keepdims=True)
        b = min_cos * a + np.sqrt(max(0.0, 1 - min_cos ** 2)) * other / np.where(norm > 1e-9, norm, 1)
        q = 8
        while True:
            half = self.width // 2
            self.books = [(_units(rng, q, half), _units(rng, q, half)) for _ in range(TURNS)]
            both = self._shared(a[:100], b[:100])
            need = int(np.ceil(q * np.sqrt(SHARED / max(both.mean(), 1e-3))))
            if need <= q and (self._shared(a, b) > 0).all():
                break
            q = min(max(need, q + q // 8), 4 * q)

    def _shared(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        both = zip(self._decode(a), self._decode(b), strict=True)
        return np.array([len(np.intersect1d(x, y, assume_unique=True)) for x, y in both], dtype=float)

    def _decode(self, wide: np.ndarray):
        half, q, out = self.width // 2, len(self.books[0][0]), [[] for _ in wide]
        for r, (signs, (left, right)) in enumerate(zip(self.signs, self.books, strict=True)):
            turned = _turn(wide, signs)
            p, s = turned[:, :half] @ left.T / np.sqrt(2), turned[:, half:] @ right.T / np.sqrt(2)
            order = np.argsort(-s, axis=1, kind="stable")
            for k, o in enumerate(order):
                n = np.searchsorted(-s[k][o], p[k] - self.height, side="left")  # of each left word: how many right words do
                some = np.flatnonzero(n)
                n = n[some]
                first = np.repeat(np.cumsum(n) - n, n)
                out[k].append((r * q + np.repeat(some, n)) * q + o[np.arange(n.sum()) - first])
        return [np.concatenate(x) for x in out]

    def decode(self, x: np.ndarray):
        """For each row of unit vectors the numbers of all filters whose cap holds it."""
        wide = np.zeros((len(x), self.width))
        wide[:, :self.dim] = x
        return self._decode(wide)


def codes(dim: int, min_cos: float = MIN_COS) -> Codes:
    if (dim, min_cos) not in _CODES:
        _CODES[dim, min_cos] = Codes(dim, min_cos)
    return _CODES[dim, min_cos]


def _matrix(rows: list) -> np.ndarray:
    """Rows scaled by their largest component, so that no square overflows."""
    x = np.array(rows, dtype=np.float64)
    return x / np.abs(x).max(axis=1, keepdims=True)


def filters(classes: DataFrame, min_cos: float) -> DataFrame:
    """label, dim, filter, rep: every cap that holds a class's vector."""
    ship(classes.sparkSession)

    def run(batches):
        for b in batches:
            labels, reps, vectors = (b.column(c) for c in ("label", "rep", "embedding"))
            vectors = vectors.to_pylist()
            dims = np.array([len(v) for v in vectors])
            for d in np.unique(dims).tolist():
                own = np.flatnonzero(dims == d)
                for s in range(0, len(own), 2000):
                    at = own[s:s + 2000]
                    x = _matrix([vectors[i] for i in at])
                    x /= np.linalg.norm(x, axis=1, keepdims=True)
                    found = list(codes(d, min_cos).decode(x))
                    back = pa.array(np.repeat(at, [len(f) for f in found]))
                    hits = np.concatenate(found).astype(np.int64)
                    yield pa.RecordBatch.from_arrays(
                        [labels.take(back), pa.array(np.full(len(hits), d, dtype=np.int32)), pa.array(hits), reps.take(back)],
                        ["label", "dim", "filter", "rep"])

    kind = classes.schema["label"].dataType.simpleString()
    return classes.select("label", "rep", "embedding").mapInArrow(tidy(run), f"label {kind}, dim int, filter long, rep long")


def links(classes: DataFrame, scratch: Scratch, min_cos: float) -> DataFrame:
    """Distinct (a, b), a < b: representatives whose vectors are linked. A cap of more than
    ``BLOCK`` classes is cut into blocks; every pair of blocks is a group of its own."""
    posts = scratch.save(filters(classes, min_cos), "posts")
    cap = ["label", "dim", "filter"]
    size = posts.groupBy(*cap).agg(F.count(F.lit(1)).alias("m")).filter("m > 1")
    cut = posts.join(size, cap).withColumn("blocks", F.ceil(F.col("m") / BLOCK).cast("int")) \
        .withColumn("own", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")) \
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    vectors = classes.select("label", F.size("embedding").alias("dim"), "rep", "embedding")
    rows = cut.join(vectors, ["label", "dim", "rep"]).select(
        *cap, F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "rep", "embedding") \
        .repartition(*cap, "i", "j").sortWithinPartitions(*cap, "i", "j", "rep")

    def pairs(group: list):
        own, rep = (np.array([g[k] for g in group], dtype=np.int64) for k in (0, 1))
        x = _matrix([g[2] for g in group])
        norm = np.sqrt((x * x).sum(axis=1))
        ok = (x @ x.T) / (norm[:, None] * norm[None, :]) >= min_cos
        ok &= (own[:, None] != own[None, :]) | (own.min() == own.max())
        i, j = np.nonzero(np.triu(ok, 1))
        keep = rep[i] != rep[j]
        return np.minimum(rep[i], rep[j])[keep], np.maximum(rep[i], rep[j])[keep]

    def run(batches):
        key, group = None, []

        def done():
            if len(group) > 1:
                a, b = pairs(group)
                if len(a):
                    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

        for b in batches:
            for r in zip(*(b.column(k).to_pylist() for k in range(8)), strict=True):
                if r[:5] != key:
                    yield from done()
                    key, group = r[:5], []
                group.append(r[5:])
        yield from done()

    return rows.mapInArrow(tidy(run), "a long, b long").distinct()


def near_duplicates(embeddings: DataFrame, min_cos: float = MIN_COS) -> DataFrame:
    """vec_id, n_links, component_id, kept for each row of ``embeddings`` (vec_id, embedding, label).

    A vector that is null, empty, zero or holds a null or non-finite component,
    and a row without label or vec_id, links with nothing; only vectors with
    as many components are compared. Equal vectors are linked without being
    paired. Rows that repeat a vec_id are vectors of their own, each with its own
    links; a component's id is the least vec_id among all its vectors. Other columns are ignored.
    """
    s = Scratch(embeddings.sparkSession, "caps")
    e = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), "label",
                          F.col("embedding").cast("array<double>").alias("embedding"))
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    ok = F.coalesce(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & finite & F.exists("embedding", lambda x: x != 0.0), F.lit(False))
    usable, rest = e.filter(ok), e.filter(~ok)
    # a class has a number of its own: a vec_id may occur in several classes
    classes = s.save(usable.groupBy("label", "embedding").agg(F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("n"))
                     .withColumn("rep", F.monotonically_increasing_id()), "classes")
    found = s.save(links(classes, s, min_cos), "links")
    both = found.unionAll(found.select(F.col("b").alias("a"), F.col("a").alias("b")))
    degree = both.join(classes.select(F.col("rep").alias("b"), "n"), "b").groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("more"))
    component = connected_components(found, s).withColumnRenamed("node", "rep").join(classes.select("rep", "least"), "rep")
    ends = component.groupBy("component").agg(F.min("least").alias("reach"))
    reach = component.select("rep", "component").join(ends, "component").select("rep", "reach")
    known = classes.join(degree, "rep", "left").join(reach, "rep", "left")
    linked = usable.join(known, ["label", "embedding"]).select(
        "vec_id", (F.col("n") - 1 + F.coalesce("more", F.lit(0))).alias("n_links"),
        F.coalesce("reach", "least").alias("component_id"))
    alone = rest.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    out = s.save(linked.unionAll(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True))), "out")
    s.drop("classes", "posts", "links")
    return out
