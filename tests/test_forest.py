"""The forest grown from cells is MLlib's: the same trees where nothing is drawn, as good ones where rows and features are."""

import os

import numpy as np
import pytest
from pyspark.ml import Pipeline
from pyspark.ml.classification import DecisionTreeClassifier, RandomForestClassifier
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from paylake.operators import forest as FO
from paylake.operators import ml as ML
from paylake.streaming.ingest import run_dir


def _rows(spark, n, classes=2):
    r = np.random.default_rng(7)
    x = r.normal(size=(n, 3)).round(2)
    y = (x[:, 0] * x[:, 1] + 0.3 * r.normal(size=n) > 0.2).astype(int) + (classes == 3) * (x[:, 2] > 0.8)
    df = spark.createDataFrame([(i, *map(float, a), int(min(b, classes - 1)), [0.5, 2.0, 1.5][min(b, classes - 1)]) for i, (a, b) in enumerate(zip(x, y))],
                               "id long, a double, b double, c double, label int, weight double")
    return VectorAssembler(inputCols=["a", "b", "c"], outputCol="features").transform(df).checkpoint()


@pytest.mark.parametrize("classes, depth, least", [(2, 6, 5), (2, 15, 1), (3, 5, 3)])
def test_one_tree_is_the_librarys(spark, classes, depth, least):
    df = _rows(spark, 3000, classes)
    kw = dict(maxDepth=depth, minInstancesPerNode=least, labelCol="label", weightCol="weight", seed=3)
    theirs = DecisionTreeClassifier(**kw).fit(df)
    ours = FO.CellForest(numTrees=1, featureSubsetStrategy="all", bootstrap=False, **kw).fit(df)
    assert isinstance(ours, FO.CellForestModel) and len(ours.trees()[0]["cut"]) == theirs.numNodes
    p = lambda m: {r.id: (r.p, r.prediction) for r in m.transform(df).select("id", vector_to_array("probability").alias("p"), "prediction").collect()}
    a, b = p(theirs), p(ours)
    assert all(np.allclose(a[i][0], b[i][0], atol=1e-9) and a[i][1] == b[i][1] for i in a)


def test_equal_rows_are_drawn_as_rows(spark):
    """A cell of n rows is n rows: the least number of rows a node counts them, and a tree draws Poisson(n) of them."""
    df = _rows(spark, 400)
    many = df.crossJoin(spark.range(40).select()).select(*df.columns)
    kw = dict(maxDepth=8, minInstancesPerNode=60, labelCol="label", weightCol="weight", seed=3)
    theirs = DecisionTreeClassifier(**kw).fit(many)
    ours = FO.CellForest(numTrees=1, featureSubsetStrategy="all", bootstrap=False, **kw).fit(many)
    assert len(ours.trees()[0]["cut"]) == theirs.numNodes > 10
    bins, one = np.zeros((1, 2), np.uint8), np.ones(2)
    drawn = [FO.grow(bins, np.array([0, 1]), one, np.random.default_rng(k).poisson([4000, 4000]), [0], 2, 3, 1, 1, None)["share"][0, 0] for k in range(200)]
    assert 0.003 < np.std(drawn) < 0.009  # of 8000 rows; drawn cell by cell it would be some 0.3


def test_forest_scores_as_well_and_is_served_as_saved(spark):
    df = _rows(spark, 6000)
    train, test = df.filter("id % 4 > 0").checkpoint(), df.filter("id % 4 = 0").checkpoint()
    kw = dict(numTrees=30, maxDepth=8, minInstancesPerNode=5, labelCol="label", weightCol="weight", seed=42)
    ev = BinaryClassificationEvaluator(labelCol="label")
    ours = Pipeline(stages=[FO.CellForest(**kw)]).fit(train)
    auc = ev.evaluate(ours.transform(test))
    assert abs(auc - ev.evaluate(RandomForestClassifier(**kw).fit(train).transform(test))) < 0.01
    again = FO.CellForest(**kw).fit(train.repartition(5))
    score = lambda m: sorted(map(tuple, m.transform(test).select("id", vector_to_array("probability")[1], vector_to_array("rawPrediction")[1], "prediction").collect()))
    loaded = ML.load_model(ML.save_model(ours, os.path.join(run_dir(spark, "test-forest"), "m")))
    assert score(loaded) == score(ours) == score(again)


def test_forest_is_grown_without_a_pass_a_level(spark, monkeypatch):
    """One pass counts cells, and a task a tree grows it; rows with too many cells go to the library's learner."""
    df = _rows(spark, 2000)
    jobs = lambda: len(spark.sparkContext.statusTracker().getJobIdsForGroup("forest"))
    spark.sparkContext.setJobGroup("forest", "forest")
    try:
        model = ML.forest_pipeline(weight="weight").fit(df)
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert isinstance(model, FO.CellForestModel) and model.getNumTrees == 100 and jobs() < 12
    monkeypatch.setattr(FO, "MAX_CELLS", 100)
    small = FO.CellForest(numTrees=2, maxDepth=3, labelCol="label").fit(df)
    assert type(small).__name__ == "RandomForestClassificationModel"


def test_forest_is_walked_once_for_filters_on_its_score(spark):
    df = _rows(spark, 500)
    out = FO.CellForest(numTrees=3, maxDepth=3, labelCol="label").fit(df).transform(df)
    p = vector_to_array("probability")[1]
    plan = out.withColumn("p", p).filter(F.col("p") > 0.4).select("p", F.round("p", 2))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1


def test_model_is_applied_once_to_a_batch(spark):
    """The keyed insert, the dead letters, the alerts and the run log read a batch's scores; the model gives them once."""
    from paylake.streaming import ingest as I
    seen = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def probability(amt):
        seen.add(1)
        return float(amt) / 10000

    class Scorer:
        def transform(self, df):
            return df.withColumn("probability", array_to_vector(F.array(F.lit(0.0), probability("amt"))))

    rows = [(f"t{i}", "9999.5" if i % 8 == 0 else "20000.0" if i % 8 == 1 else "10.5", "4000000000000001", "m", "c") for i in range(64)]
    batch = spark.createDataFrame([*rows, ("t99", "abc", "4000000000000001", "m", "c")], "trans_num string, amt string, cc_num string, merchant string, category string")
    out = run_dir(spark, "once")
    I.ingest_batch(batch, 0, out, I.model_scorer(Scorer(), "v1"))
    assert seen.value == 64
    assert I.read_store(spark, os.path.join(out, "transactions")).count() == 56
    dead = spark.read.parquet(os.path.join(out, "dead_letter")).groupBy("error_type").count().collect()
    assert {r.error_type: r["count"] for r in dead} == {"validation_error": 1, "prediction_error": 8}
    assert spark.read.parquet(os.path.join(out, "alerts")).count() == 8
    assert tuple(spark.read.parquet(os.path.join(out, "pipeline_runs")).select("records_processed", "records_failed").first()) == (65, 9)
    assert not spark.sparkContext._jsc.getPersistentRDDs()
