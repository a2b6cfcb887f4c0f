"""Feature vectors, training extract, splits, models, metrics.

Training and evaluation run on Spark MLlib (distributed tree learners and
evaluators). Model outputs cannot equal the reference's libraries bit for
bit; what is promised is the metric gates and determinism by seed.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from paylake.functions.predicates import coerce_features, lookback
from paylake.functions.sampling import DEFAULT_BUCKETS, select_smallest, unit_hash
from paylake.functions.scalar import degree_distance, hour_of_day, log_amount
from paylake.operators.joins import join_dim
from paylake.session import checkpoint_root

# --- fixed values ---------------------------------------------------------
# Model inputs of the payment model and its 6 engineered outputs, in order.
MODEL_FEATURES = ["amt", "lat", "long", "city_pop", "unix_time", "merch_lat", "merch_long"]
VECTOR_FIELDS = ["amt", "log_amt", "city_pop", "distance_to_merchant", "hour_sin", "hour_cos"]
# Hyper-parameters: forest (100 trees, depth 15, min split 10), boosted trees
# (100 rounds, depth 5, rate 0.1, row/column sampling 0.8), 5 folds, seed 42.
FOREST_PARAMS = dict(numTrees=100, maxDepth=15, minInstancesPerNode=5)
# How the forest is computed where its rows are too different for cells (operators.forest), not what: each row's node
# in each tree is kept from level to level, so that no level sends all trees to all tasks and walks every row down them once more.
FOREST_RUN = dict(cacheNodeIds=True)
BOOSTED_PARAMS = dict(maxIter=100, maxDepth=5, stepSize=0.1, subsamplingRate=0.8, featureSubsetStrategy="0.8")
CV_FOLDS = 5
SEED = 42
GATES = {"recall": 0.5, "precision": 0.15}
AUC_MIN = 0.85
AUC_BUCKETS = 4096
CATEGORICAL = ["device_type", "risk_tier", "mcc_category"]
NUMERIC = ["amount_usd", "is_3d_secure", "country_is_high_risk"]


# M01 -----------------------------------------------------------------
def payment_features(df: DataFrame) -> DataFrame:
    """The 6 engineered columns; inputs coerced, nulls -> 0 first."""
    x = coerce_features(df, MODEL_FEATURES)
    x = x.fillna(0.0, subset=[c for c in ["amt", "lat", "long", "merch_lat", "merch_long"]])
    h = hour_of_day(F.col("unix_time"))
    ang = h * F.lit(2 * math.pi) / 24
    return x.withColumns({
        "log_amt": log_amount("amt"),
        "distance_to_merchant": degree_distance("lat", "long", "merch_lat", "merch_long"),
        "hour_sin": F.sin(ang), "hour_cos": F.cos(ang),
        "city_pop": F.col("city_pop").cast("double"),
    })


# The same engineering as a pipeline stage, so that a saved model takes the seven
# raw inputs: bad or missing values -> 0, then the six fields under names of their own.
SERVED = [f"f_{c}" for c in VECTOR_FIELDS]
_RAW = ", ".join(
    (f"coalesce(try_cast(cast(`{c}` AS string) AS double), 0D)" if c not in ("city_pop", "unix_time")
     else f"cast(coalesce(try_cast(cast(`{c}` AS string) AS double), 0D) AS bigint)") + f" AS _r_{c}"
    for c in MODEL_FEATURES)
_HOUR = "floor(pmod(_r_unix_time, 86400) / 3600) * (2 * pi()) / 24"
ENGINEERING_SQL = f"""SELECT *, _r_amt AS f_amt, log1p(_r_amt) AS f_log_amt, cast(_r_city_pop AS double) AS f_city_pop,
    sqrt(pow(_r_lat - _r_merch_lat, 2) + pow(_r_long - _r_merch_long, 2)) AS f_distance_to_merchant,
    sin({_HOUR}) AS f_hour_sin, cos({_HOUR}) AS f_hour_cos FROM (SELECT *, {_RAW} FROM __THIS__)"""


def engineering_stage():
    from pyspark.ml.feature import SQLTransformer
    return SQLTransformer(statement=ENGINEERING_SQL)


def payment_vector_stage(output: str = "raw_features", inputs=VECTOR_FIELDS):
    from pyspark.ml.feature import VectorAssembler
    return VectorAssembler(inputCols=list(inputs), outputCol=output, handleInvalid="keep")


# M02 -----------------------------------------------------------------
def scaler_stages(n_rows: int, width: int, input_col: str = "raw_features", output: str = "features"):
    """Mean 0, population deviation 1: MLlib divides by the sample deviation,
    the second stage by its ratio sqrt((n - 1) / n)."""
    from pyspark.ml.feature import ElementwiseProduct, StandardScaler
    from pyspark.ml.linalg import Vectors
    ratio = math.sqrt(n_rows / (n_rows - 1)) if n_rows > 1 else 1.0
    return [StandardScaler(inputCol=input_col, outputCol=f"{output}_sample", withMean=True, withStd=True),
            ElementwiseProduct(inputCol=f"{output}_sample", outputCol=output, scalingVec=Vectors.dense([ratio] * width))]


# M03 -----------------------------------------------------------------
def categories(df: DataFrame, cols=CATEGORICAL) -> dict[str, list[str]]:
    """The sorted categories of each column, null as 'unknown': what is fixed at fit time (a model's columns, so few)."""
    x = fill_categoricals(df, cols)
    return {c: sorted(r[0] for r in x.select(f"{c}_f").distinct().collect()) for c in cols}


def one_hot_fields(cats: dict[str, list[str]]) -> list[str]:
    return [f"{c}_oh_{i}" for c, v in cats.items() for i in range(1, len(v))]


def one_hot_stages(cats: dict[str, list[str]]):
    """A 0/1 column for each category but the alphabetically first. A
    category never seen in training gets zeros, as the source's serving does."""
    from pyspark.ml.feature import SQLTransformer
    quote = lambda v: "'" + v.replace("\\", "\\\\").replace("'", "\\'") + "'"
    cols = [f"CASE WHEN coalesce(cast(`{c}` AS string), 'unknown') = {quote(x)} THEN 1D ELSE 0D END AS `{c}_oh_{i}`"
            for c, v in cats.items() for i, x in enumerate(v) if i]
    return [SQLTransformer(statement="SELECT *" + "".join(f", {x}" for x in cols) + " FROM __THIS__")]


def fill_categoricals(df: DataFrame, cols=CATEGORICAL) -> DataFrame:
    return df.withColumns({f"{c}_f": F.coalesce(F.col(c).cast("string"), F.lit("unknown")) for c in cols})


# M04 -----------------------------------------------------------------
def training_set(fact: DataFrame, dim_customer: DataFrame, dim_merchant: DataFrame, as_of,
                 days: int = 90, cap: int | None = None, seed: int = SEED) -> DataFrame:
    """Labelled extract over the look-back, two left joins. ``cap`` keeps a
    deterministic hash-ordered subset (the source's arbitrary LIMIT)."""
    f = lookback(fact, "transaction_ts", as_of, days).select(
        "transaction_id", "customer_sk", "merchant_sk", "amount_usd", "device_type", "is_3d_secure",
        "fraud_score", F.when(F.col("is_high_fraud_risk") == 1, 1).otherwise(0).alias("label"),
        "transaction_date")
    if cap is not None:
        # exact hash-ordered cap without funnelling k rows per task into one; before the joins, which
        # neither add nor drop rows, so that they see the rows that stay
        f = select_smallest(f, "transaction_id", seed, lambda n: F.lit(cap)).filter("_selected").drop("_selected")
    j = join_dim(f, dim_customer.select("customer_sk", "risk_tier", "country_is_high_risk"), "customer_sk")
    return join_dim(j, dim_merchant.select("merchant_sk", "mcc_category"), "merchant_sk")


# M05 -----------------------------------------------------------------
def _unit_hash(id_col: str, seed: int) -> F.Column:
    return unit_hash(id_col, seed)


def stratified_split(df: DataFrame, label: str, id_col: str, test_frac: float = 0.2, seed: int = SEED,
                     n_buckets: int = DEFAULT_BUCKETS) -> DataFrame:
    """Adds ``is_test``: per class, exactly round(test_frac * n_class) rows
    with the smallest seeded hash go to test (``functions.sampling``: no
    window over a whole class, one class may be 99 % of the data)."""
    return select_smallest(df, id_col, seed, lambda n: F.round(n * test_frac), by=[label],
                           n_buckets=n_buckets, out_col="is_test")


def fold_column(df: DataFrame, id_col: str, folds: int = CV_FOLDS, seed: int = SEED,
                label: str = "label", n_buckets: int = 4096) -> DataFrame:
    """Fold id 0..folds-1, stratified: in seeded hash order the rows of a
    class are dealt round the folds, so each class is spread evenly to one
    row. Ranks come from hash buckets (a class is never sorted in one task)."""
    x = df.withColumn("_u", _unit_hash(id_col, seed)).withColumn(
        "_b", F.least(F.floor(F.col("_u") * n_buckets), F.lit(n_buckets - 1)).cast("int"))
    counts = x.groupBy(label, "_b").count()
    # at most classes x buckets rows
    before = counts.withColumn("_before", F.sum("count").over(W.partitionBy(label).orderBy("_b")) - F.col("count")).drop("count")
    rank = F.row_number().over(W.partitionBy(label, "_b").orderBy("_u", id_col)) - 1
    return x.withColumn("_r", rank).join(before, [label, "_b"]).withColumn(
        "fold", F.pmod(F.col("_r") + F.col("_before"), F.lit(folds)).cast("int")).drop("_u", "_b", "_r", "_before")


# M06 / M07 -----------------------------------------------------------
def class_weights(df: DataFrame, label: str = "label") -> DataFrame:
    """weight = n / (2 * n_class), as a column (balanced classes)."""
    stats = df.groupBy(label).agg(F.count(F.lit(1)).alias("_nc"))
    tot = stats.agg(F.sum("_nc").alias("_n")).withColumn("_k", F.lit(1))
    wts = stats.withColumn("_k", F.lit(1)).join(F.broadcast(tot), "_k") \
               .select(label, (F.col("_n") / (2.0 * F.col("_nc"))).alias("weight"))
    return df.join(F.broadcast(wts), label, "left")


def evenly(df: DataFrame, key: str) -> DataFrame:
    """The rows spread over the cores: a level of a tree takes as long as its slowest task, and each
    task has sums for all nodes, so a whole number of equal rounds is what costs least."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(-(-df.rdd.getNumPartitions() // cores) * cores, key)


def forest_pipeline(features_col: str = "features", label: str = "label", weight: str | None = "weight"):
    from paylake.operators.forest import CellForest
    kw = dict(FOREST_PARAMS, **FOREST_RUN, featuresCol=features_col, labelCol=label, seed=SEED)
    if weight:
        kw["weightCol"] = weight
    return CellForest(**kw)


def boosted_classifier(features_col: str = "features", label: str = "label", max_iter: int | None = None):
    from pyspark.ml.classification import GBTClassifier
    kw = dict(BOOSTED_PARAMS, featuresCol=features_col, labelCol=label, seed=SEED)
    if max_iter:
        kw["maxIter"] = max_iter
    return GBTClassifier(**kw)


def payment_pipeline(classifier, n_rows: int):
    """Raw inputs to prediction: what is saved and served is what was trained."""
    from pyspark.ml import Pipeline
    return Pipeline(stages=[engineering_stage(), payment_vector_stage(inputs=SERVED),
                            *scaler_stages(n_rows, len(SERVED)), classifier])


def tabular_pipeline(classifier, cats: dict[str, list[str]]):
    """amount/3DS/high-risk numerics + one-hot categoricals."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import VectorAssembler
    asm = VectorAssembler(inputCols=NUMERIC + one_hot_fields(cats), outputCol="features", handleInvalid="keep")
    return Pipeline(stages=[*one_hot_stages(cats), asm, classifier])


def prepare_tabular(df: DataFrame) -> DataFrame:
    x = fill_categoricals(df)
    return x.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in NUMERIC})


# M08 -----------------------------------------------------------------
def cv_auc(pipeline, df: DataFrame, folds: int = CV_FOLDS, label: str = "label",
           parallelism: int | None = None) -> list[float]:
    """Cross-validated AUC on a ``fold`` column: one fit per fold on the
    other folds, AUC on the held-out fold. The fold fits are submitted from
    a thread pool so Spark interleaves their (many small) jobs; returns the
    per-fold AUCs (mean = the CV score).

    Leading stages that learn nothing run once, for all folds, and what they
    give is checkpointed: a fold's passes read the vectors, and its jobs (five a
    tree) carry no plan of how they came about."""
    from concurrent.futures import ThreadPoolExecutor
    from itertools import takewhile

    from pyspark.ml import Pipeline, Transformer
    from pyspark.ml.evaluation import BinaryClassificationEvaluator

    ev = BinaryClassificationEvaluator(labelCol=label, metricName="areaUnderROC")
    first = list(takewhile(lambda x: isinstance(x, Transformer), pipeline.getStages()))
    rest = pipeline.getStages()[len(first):]
    if first:
        checkpoint_root(df.sparkSession)
        for stage in first:
            df = stage.transform(df)
        if len(rest) == 1:  # the learner: its inputs are all that is read
            read = [rest[0].getOrDefault(p) for p in ("featuresCol", "labelCol", "weightCol") if rest[0].hasParam(p) and rest[0].isDefined(p)]
            df = df.select(*dict.fromkeys([*read, label, "fold"]))
        df, pipeline = df.checkpoint(), Pipeline(stages=rest)

    def one(k: int) -> float:
        model = pipeline.fit(df.filter(F.col("fold") != k))
        return float(ev.evaluate(model.transform(df.filter(F.col("fold") == k))))

    with ThreadPoolExecutor(max_workers=parallelism or folds) as pool:
        return list(pool.map(one, range(folds)))


# M09 -----------------------------------------------------------------
def metrics(pred: DataFrame, label: str = "label", prediction: str = "prediction",
            probability: str = "probability") -> DataFrame:
    """One row: tp, fp, fn, tn, precision, recall, f1, auc (distributed)."""
    from pyspark.ml.functions import vector_to_array
    y, p = F.col(label).cast("int"), F.col(prediction).cast("int")
    c = pred.agg(
        F.sum(((y == 1) & (p == 1)).cast("long")).alias("tp"),
        F.sum(((y == 0) & (p == 1)).cast("long")).alias("fp"),
        F.sum(((y == 1) & (p == 0)).cast("long")).alias("fn"),
        F.sum(((y == 0) & (p == 0)).cast("long")).alias("tn"))
    prec = F.col("tp") / F.nullif(F.col("tp") + F.col("fp"), F.lit(0))
    rec = F.col("tp") / F.nullif(F.col("tp") + F.col("fn"), F.lit(0))
    c = c.withColumns({"precision": prec, "recall": rec})
    c = c.withColumn("f1", 2 * F.col("precision") * F.col("recall")
                     / F.nullif(F.col("precision") + F.col("recall"), F.lit(0.0)))
    auc = auc_of(pred.select(vector_to_array(F.col(probability)).getItem(1).alias("_s"), y.alias("_y")))
    return c.withColumn("_k", F.lit(1)).join(auc.withColumn("_k", F.lit(1)), "_k").drop("_k")


def auc_of(scored: DataFrame, score: str = "_s", label: str = "_y") -> DataFrame:
    """ROC AUC as a distributed rank statistic (Mann-Whitney with ties) on
    the exact scores: negatives below a score are those of the lower buckets
    of scores (a table of at most ``AUC_BUCKETS`` rows) plus those below it in
    its own bucket, so no task sorts all scores."""
    g = scored.groupBy(F.col(score).cast("double").alias(score)).agg(
        F.sum((F.col(label) == 1).cast("long")).alias("pos"), F.sum((F.col(label) == 0).cast("long")).alias("neg"))
    g = g.withColumn("_b", F.floor(F.col(score) * AUC_BUCKETS))
    low = g.groupBy("_b").agg(F.sum("neg").alias("_n"))
    low = low.select(F.col("_b").alias("_lb"), (F.sum("_n").over(W.orderBy("_b")) - F.col("_n")).alias("_low"))
    w = W.partitionBy("_b").orderBy(score).rowsBetween(W.unboundedPreceding, -1)
    g = g.withColumn("_in", F.coalesce(F.sum("neg").over(w), F.lit(0))).join(low, F.col("_b").eqNullSafe(F.col("_lb")))
    g = g.withColumn("neg_below", F.col("_low") + F.col("_in"))
    s = g.agg(F.sum(F.col("pos") * (F.col("neg_below") + F.col("neg") / 2.0)).alias("u"),
              F.sum("pos").alias("np"), F.sum("neg").alias("nn"))
    return s.select((F.col("u") / F.nullif(F.col("np") * F.col("nn"), F.lit(0))).alias("auc"))


def gate(metrics_df: DataFrame, mins: dict | None = None, auc_min: float | None = None) -> DataFrame:
    """Adds ``passed``: every named metric at or above its minimum."""
    mins = dict(GATES if mins is None else mins)
    if auc_min is not None:
        mins["auc"] = auc_min
    cond = F.lit(True)
    for k, v in mins.items():
        cond = cond & F.coalesce(F.col(k) >= v, F.lit(False))
    return metrics_df.withColumn("passed", cond)


def assert_gate(gated: DataFrame) -> None:
    """Raise when the (one-row) gate failed - the deploy stop of the source."""
    row = gated.select("passed").first()
    if row is None or not row["passed"]:
        raise ValueError("model below quality gate")


# M15 -----------------------------------------------------------------
def model_version(ds: str) -> str:
    return "v" + ds.replace("-", ".")


def save_model(model, path: str) -> str:
    model.write().overwrite().save(path)
    return path


def load_model(path: str):
    from pyspark.ml import PipelineModel
    return PipelineModel.load(path)


def registry_row(spark, name: str, version: str, uri: str, auc: float | None, canary_pct: int = 5,
                 deployed_at=None) -> DataFrame:
    return spark.createDataFrame(
        [(name, version, canary_pct, uri, auc, deployed_at)],
        "name string, current_version string, canary_pct int, model_uri string, auc double, deployed_at timestamp")


class ModelRegistry:
    """The versions of each model, append-only: a registration is a commit that fails if another
    job registered in between (``LostRace``), so none is lost unseen. The last row of a name is
    its current version; scorers load by name."""

    def __init__(self, spark, root: str):
        from paylake.sources.manifest import Manifest
        self.spark, self.manifest = spark, Manifest(spark, root)

    def rows(self) -> list[dict]:
        return (self.manifest.read()[1] or {"models": []})["models"]

    def register(self, name: str, version: str, uri: str, metrics: dict | None = None, canary_pct: int = 5, deployed_at=None,
                 seen: int | None = None) -> int:
        """Append a version; ``seen`` is the registry's number that the decision was based on (else the newest)."""
        last, state = self.manifest.read()
        models = (state or {"models": []})["models"]
        row = {"name": name, "version": version, "uri": uri, "metrics": metrics or {}, "canary_pct": canary_pct,
               "deployed_at": None if deployed_at is None else str(deployed_at)}
        return self.manifest.commit(last if seen is None else seen, {"models": [*models, row]})

    def current(self, name: str) -> dict | None:
        return next((r for r in reversed(self.rows()) if r["name"] == name), None)

    def load(self, name: str):
        """(model, version) of the current version."""
        row = self.current(name)
        if row is None:
            raise LookupError(f"no model is registered as {name}")
        return load_model(row["uri"]), row["version"]

    def table(self) -> DataFrame:
        """Every registration: name, place, version, uri, canary_pct, deployed_at, metrics, whether it is current."""
        rows = self.rows()
        last = {r["name"]: i for i, r in enumerate(rows)}
        return self.spark.createDataFrame(
            [(r["name"], i, r["version"], r["uri"], r["canary_pct"], r["deployed_at"], {k: float(v) for k, v in r["metrics"].items()},
              last[r["name"]] == i) for i, r in enumerate(rows)],
            "name string, place int, version string, model_uri string, canary_pct int, deployed_at string, metrics map<string,double>, is_current boolean")
