"""A random forest over cells: the learner and the model of the payment forest.

A tree learner of MLlib sees a row only as the bins of its features, so rows with
equal bins, label and weight are one *cell* with a number of rows. The forest is
MLlib's own: the same candidate thresholds, a Poisson bootstrap of rows (of n equal
rows a tree draws Poisson(n) in all), features drawn for each node, weighted Gini
gain, the least number of rows a node, the depth, and siblings that predict alike
merged. What differs is the work: cells are counted in one pass, and each tree is
grown by one task from all cells, instead of a pass over all rows and a shuffle of
every node's sums a level.

The six payment fields follow from four quantities (``log_amt`` has the bins of
``amt``, the hour's sine and cosine have 24 pairs), so that 32 bins and two labels
give at most 32 x 32 x 32 x 24 x 2 = 1.6 million cells, whatever the rows. Inputs
with more than ``MAX_CELLS`` go to MLlib's learner.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark import keyword_only
from pyspark.ml.base import Model
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param.shared import HasFeaturesCol, HasPredictionCol, HasProbabilityCol, HasRawPredictionCol
from pyspark.ml.util import DefaultParamsReader, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paylake.session import checkpoint_root, ship

# What reaches the driver and each Python worker: some 15 bytes a cell.
MAX_CELLS = 1 << 21
LEAF = 255  # a cut that no bin is above
NODES_AT_ONCE = 2048
SPLIT_SAMPLE = 10_000  # rows that the thresholds are chosen from, as MLlib does (at least bins squared)


# Thresholds and cells --------------------------------------------------
def thresholds(values: np.ndarray, weight: np.ndarray, most: int) -> np.ndarray:
    """MLlib's candidate thresholds of a continuous feature: midpoints between all distinct values, or
    where those are too many, between the values nearest to equal strides of weight."""
    found, place = np.unique(values, return_inverse=True)
    if len(found) - 1 <= most:
        return (found[:-1] + found[1:]) / 2.0
    count = np.bincount(place, weight)
    stride = count.sum() / (most + 1)
    out, current, target = [], count[0], stride
    for i in range(1, len(found)):
        previous, current = current, current + count[i]
        if abs(previous - target) < abs(current - target):
            out.append((found[i - 1] + found[i]) / 2.0)
            target += stride
    return np.array(out)


def bin_matrix(features: pa.Array, splits: list[np.ndarray]) -> np.ndarray:
    """Bins by feature and row: how many thresholds a value is above (NaN: above all)."""
    x = features.flatten().to_numpy(zero_copy_only=False).reshape(-1, len(splits))
    return np.stack([np.searchsorted(s, x[:, i], "left") for i, s in enumerate(splits)]).astype(np.uint8)


def _bits(max_bins: int) -> int:
    return max(1, (max_bins - 1).bit_length())


def cells_of(rows: DataFrame, splits: list[np.ndarray], max_bins: int) -> DataFrame:
    """(key, label, weight, n): the rows of each cell; ``rows`` has features as an array, label and weight."""
    bits = _bits(max_bins)

    def keys(batches):
        for b in batches:
            m = bin_matrix(b.column(0), splits).astype(np.int64)
            key = np.zeros(b.num_rows, np.int64)
            for row in m:
                key = (key << bits) | row
            yield pa.RecordBatch.from_arrays([pa.array(key), b.column(1), b.column(2)], ["key", "label", "weight"])

    return rows.mapInArrow(keys, "key long, label double, weight double").groupBy("key", "label", "weight").agg(F.count(F.lit(1)).alias("n"))


# Growing ----------------------------------------------------------------
def _gini(stat: np.ndarray) -> np.ndarray:
    total = stat.sum(-1)
    total = np.where(total > 0, total, 1.0)
    out = np.ones(total.shape)
    for k in range(stat.shape[-1]):  # in the library's order, so that gains tie where its gains do
        out -= (stat[..., k] / total) ** 2
    return out


def grow(bins: np.ndarray, label: np.ndarray, weight: np.ndarray, drawn: np.ndarray, splits: list[int], classes: int, depth: int,
         min_rows: int, per_node: int, rng, min_gain: float = 0.0) -> dict[str, np.ndarray]:
    """One tree: ``drawn`` rows of each cell (bins by feature and cell). ``splits`` are the thresholds a feature has.
    Returns its nodes, the two children of one side by side: feature, cut (bins up to it go left), left child, class shares."""
    usable = np.array([i for i, s in enumerate(splits) if s], np.int64)
    wide = max(splits, default=0) + 1
    at = np.flatnonzero(drawn)
    bins, y, count = bins[:, at], label[at].astype(np.int64), drawn[at].astype(np.float64)
    w = count * weight[at]
    node, nodes, levels = np.zeros(len(at), np.int64), 1, []
    for level in range(depth + 1):
        stat = np.bincount(node * classes + y, w, nodes * classes).reshape(nodes, classes)
        best, feature, cut = np.zeros(nodes), np.zeros(nodes, np.int64), np.full(nodes, LEAF, np.int64)
        if level < depth and len(usable):
            if per_node >= len(usable):
                asked = np.broadcast_to(usable, (nodes, len(usable)))
            else:
                asked = usable[rng.random((nodes, len(usable))).argsort(1)[:, :per_node]]
            own = _gini(stat)
            for j in range(asked.shape[1]):
                f = asked[:, j]
                key = node * wide + bins[f[node], np.arange(len(node))]
                sums = np.bincount(key * classes + y, w, nodes * wide * classes).reshape(nodes, wide, classes)
                rows = np.bincount(key, count, nodes * wide).reshape(nodes, wide)
                for lo in range(0, nodes, NODES_AT_ONCE):
                    part = slice(lo, lo + NODES_AT_ONCE)
                    left = sums[part].cumsum(1)
                    total = left[:, -1:]
                    left = left[:, :-1]
                    right = total - left
                    n_left = rows[part].cumsum(1)
                    n_right = n_left[:, -1:] - n_left[:, :-1]
                    weight_of = total.sum(-1)
                    gain = own[part, None] - left.sum(-1) / weight_of * _gini(left) - right.sum(-1) / weight_of * _gini(right)
                    gain[(n_left[:, :-1] < min_rows) | (n_right < min_rows) | (gain < min_gain)] = -1.0
                    k = gain.argmax(1)
                    g = gain[np.arange(len(k)), k]
                    better = np.flatnonzero(g > best[part])
                    best[lo + better], feature[lo + better], cut[lo + better] = g[better], f[lo + better], k[better]
        parted = best > 0
        levels.append((stat, feature, cut, parted))
        if not parted.any():
            break
        keep = parted[node]
        bins, y, w, count, node = bins[:, keep], y[keep], w[keep], count[keep], node[keep]
        right = bins[feature[node], np.arange(len(node))] > cut[node]
        node = 2 * (np.cumsum(parted) - 1)[node] + right
        nodes = 2 * int(parted.sum())
    return _joined(levels)


def _joined(levels) -> dict[str, np.ndarray]:
    """The nodes of all levels in one array each, without siblings that are leaves and predict alike."""
    start = np.cumsum([0] + [len(x[0]) for x in levels])
    stat, feature, cut = (np.concatenate([x[i] for x in levels]) for i in range(3))
    inner = np.concatenate([x[3] for x in levels])
    left = np.arange(len(stat))
    for i, x in enumerate(levels):
        left[start[i]:start[i + 1]][x[3]] = start[i + 1] + 2 * np.arange(int(x[3].sum()))
    says = stat.argmax(1)
    for i in reversed(range(len(levels))):
        at = start[i] + np.flatnonzero(inner[start[i]:start[i + 1]])
        a = left[at]
        inner[at[~inner[a] & ~inner[a + 1] & (says[a] == says[a + 1])]] = False
    alive = np.zeros(len(stat), bool)
    alive[0] = True
    for i in range(len(levels)):
        at = start[i] + np.flatnonzero((alive & inner)[start[i]:start[i + 1]])
        alive[left[at]] = alive[left[at] + 1] = True
    place = np.cumsum(alive) - 1
    left = np.where(inner, place[left], place)[alive]
    inner = inner[alive]
    return {"feature": np.where(inner, feature[alive], 0).astype(np.uint8), "cut": np.where(inner, cut[alive], LEAF).astype(np.uint8),
            "left": left.astype(np.int32), "share": stat[alive] / stat[alive].sum(1, keepdims=True)}


def votes(trees: list[dict[str, np.ndarray]], bins: np.ndarray, classes: int) -> np.ndarray:
    """The trees' class shares, summed, by row."""
    n = bins.shape[1]
    flat, row = np.ascontiguousarray(bins).ravel(), np.arange(n)
    out = np.zeros((n, classes))
    for t in trees:
        offset = t["feature"].astype(np.int64) * n
        node = np.zeros(n, np.int32)
        while True:
            after = t["left"][node] + (flat[offset[node] + row] > t["cut"][node])
            if np.array_equal(after, node):  # a leaf is its own left child
                break
            node = after.astype(np.int32, copy=False)
        out += t["share"][node]
    return out


# Estimator --------------------------------------------------------------
PER_NODE = {"all": lambda n: n, "sqrt": lambda n: math.ceil(math.sqrt(n))}


class CellForest(RandomForestClassifier):
    """MLlib's classifier with the same parameters, grown from cells."""

    def _fit(self, dataset: DataFrame):
        get = self.getOrDefault
        strategy = {"auto": "sqrt" if get("numTrees") > 1 else "all"}.get(get("featureSubsetStrategy"), get("featureSubsetStrategy"))
        plain = (get("impurity") == "gini" and get("minWeightFractionPerNode") == 0.0 and get("maxBins") <= 256 and strategy in PER_NODE
                 and get("subsamplingRate") == 1.0 and not get("leafCol") and not self.isSet("thresholds")
                 and "nominal" not in dataset.schema[get("featuresCol")].metadata.get("ml_attr", {}).get("attrs", {}))
        model = self._grown(dataset, strategy) if plain else None
        return super()._fit(dataset) if model is None else model

    def _grown(self, dataset: DataFrame, strategy: str):
        """The model, or None where there are too many cells."""
        get, spark = self.getOrDefault, dataset.sparkSession
        ship(spark)
        checkpoint_root(spark)
        weight = F.col(get("weightCol")).cast("double") if self.isDefined("weightCol") and get("weightCol") else F.lit(1.0)
        rows = dataset.select(vector_to_array(get("featuresCol")).alias("f"), F.col(get("labelCol")).cast("double").alias("label"), weight.alias("weight"))
        n = dataset.count()
        if not n:
            return None
        max_bins = min(get("maxBins"), n)
        wanted = max(max_bins ** 2, SPLIT_SAMPLE)
        sample = (rows.sample(False, wanted / n, get("seed")) if wanted < n else rows).select("f", "weight").toArrow()  # some 10,000 rows
        width = len(sample["f"][0])
        x = sample["f"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
        w = sample["weight"].to_numpy()
        splits = [thresholds(x[:, i][~np.isnan(x[:, i])], w[~np.isnan(x[:, i])], max_bins - 1) for i in range(width)]
        bits = _bits(max_bins)
        if width * bits > 62:
            return None
        cells = cells_of(rows, splits, max_bins).checkpoint()
        if cells.count() > MAX_CELLS:
            return None
        t = cells.toArrow().sort_by([("key", "ascending"), ("label", "ascending"), ("weight", "ascending")])
        label = t["label"].to_numpy()
        if np.isnan(label).any() or (label < 0).any() or (label != np.floor(label)).any():
            raise ValueError("labels must be whole numbers from 0 on")
        classes = max(2, int(label.max()) + 1)
        key = t["key"].to_numpy()
        bins = np.stack([(key >> (bits * (width - 1 - i))) & ((1 << bits) - 1) for i in range(width)]).astype(np.uint8)
        shared = spark.sparkContext.broadcast((bins, label.astype(np.uint8), t["weight"].to_numpy(), t["n"].to_numpy().astype(np.int64)))
        trees, per_node = get("numTrees"), PER_NODE[strategy](width)
        depth, min_rows, min_gain, seed = get("maxDepth"), get("minInstancesPerNode"), get("minInfoGain"), get("seed")
        draw, sizes = get("bootstrap") and trees > 1, [len(s) for s in splits]

        def run(batches):
            for b in batches:
                for tree in b.column(0).to_pylist():
                    bins, label, weight, n = shared.value
                    rng = np.random.default_rng([seed & (2 ** 63 - 1), tree])
                    got = grow(bins, label, weight, rng.poisson(n) if draw else n, sizes, classes, depth, min_rows, per_node, rng, min_gain)
                    yield pa.RecordBatch.from_pylist([{"tree": tree} | {k: np.ascontiguousarray(v).tobytes() for k, v in got.items()}], schema=TREE_ARROW)

        grown = spark.range(0, trees, 1, trees).mapInArrow(run, TREE_SCHEMA).toArrow()  # a tree: at most 2 ** (depth + 1) nodes
        shared.unpersist()
        model = CellForestModel(featuresCol=get("featuresCol"), predictionCol=get("predictionCol"), probabilityCol=get("probabilityCol"),
                                rawPredictionCol=get("rawPredictionCol"))
        return model._of(grown.sort_by("tree"), splits, classes)


# Model ------------------------------------------------------------------
TREE_SCHEMA = "tree long, feature binary, cut binary, left binary, share binary"
TREE_ARROW = pa.schema([("tree", pa.int64()), *[(c, pa.binary()) for c in ("feature", "cut", "left", "share")]])


class CellForestModel(Model, HasFeaturesCol, HasPredictionCol, HasProbabilityCol, HasRawPredictionCol, MLWritable, MLReadable):
    """The trained forest; adds the same three columns as MLlib's. All trees share the candidate thresholds,
    so that a row is binned once and walked down each tree in numpy, a batch of rows at a time."""

    @keyword_only
    def __init__(self, featuresCol="features", predictionCol="prediction", probabilityCol="probability", rawPredictionCol="rawPrediction"):
        super().__init__()
        self._set(**self._input_kwargs)
        self.table, self.splits, self.classes, self._shared = None, [], 2, None

    def _of(self, table: pa.Table, splits, classes: int) -> "CellForestModel":
        self.table, self.splits, self.classes = table, [np.asarray(s, np.float64) for s in splits], classes
        return self

    def copy(self, extra=None):
        return super().copy(extra)._of(self.table, self.splits, self.classes)

    @property
    def numClasses(self) -> int:
        return self.classes

    @property
    def getNumTrees(self) -> int:
        return self.table.num_rows

    def trees(self) -> list[dict[str, np.ndarray]]:
        read = lambda v, t: np.frombuffer(v, t)
        return [{"feature": read(r["feature"], np.uint8), "cut": read(r["cut"], np.uint8), "left": read(r["left"], np.int32),
                 "share": read(r["share"], np.float64).reshape(-1, self.classes)} for r in self.table.to_pylist()]

    def _transform(self, df: DataFrame) -> DataFrame:
        ship(df.sparkSession)
        if self._shared is None:
            self._shared = df.sparkSession.sparkContext.broadcast((self.trees(), self.splits, self.classes))
        shared = self._shared

        def score(features: pa.Array) -> pa.Array:
            trees, splits, classes = shared.value
            out = votes(trees, bin_matrix(features, splits), classes)
            return pa.ListArray.from_arrays(np.arange(0, out.size + 1, classes, dtype=np.int32), out.ravel())

        # not deterministic as far as the optimizer is told: a filter on a score must not walk the trees once more
        raw = F.arrow_udf(score, "array<double>").asNondeterministic()
        get = self.getOrDefault
        x = df.withColumn("_votes", raw(vector_to_array(get("featuresCol"))))
        v = [F.col("_votes")[i] for i in range(self.classes)]
        total = sum(v[1:], v[0])
        return x.withColumns({
            get("rawPredictionCol"): array_to_vector("_votes"),
            get("probabilityCol"): array_to_vector(F.array(*[c / total for c in v])),
            get("predictionCol"): (F.array_position("_votes", F.array_max("_votes")) - 1).cast("double")}).drop("_votes")

    def write(self) -> MLWriter:
        return _Writer(self)

    @classmethod
    def read(cls) -> MLReader:
        return _Reader()


class _Writer(MLWriter):
    def __init__(self, model: CellForestModel):
        super().__init__()
        self.model = model

    def saveImpl(self, path: str) -> None:
        m = self.model
        DefaultParamsWriter.saveMetadata(m, path, self.sparkSession, {"splits": [s.tolist() for s in m.splits], "classes": m.classes})
        self.sparkSession.createDataFrame(m.table, TREE_SCHEMA).repartition(1).write.parquet(f"{path}/data")


class _Reader(MLReader):
    def load(self, path: str) -> CellForestModel:
        meta = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        model = CellForestModel()
        model._resetUid(meta["uid"])
        DefaultParamsReader.getAndSetParams(model, meta)
        table = self.sparkSession.read.parquet(f"{path}/data").select(*TREE_ARROW.names).toArrow().sort_by("tree")
        return model._of(table, meta["splits"], meta["classes"])
