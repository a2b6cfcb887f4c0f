"""Streaming replay safety, session windows in append mode, ML helpers."""

import os
import time

from pyspark.sql import functions as F

from paylake.operators import ml as ML
from paylake.plans import domain as D
from paylake.streaming import ingest as I
from paylake.streaming import monitors as M

SF = "/root/testdata/sf0.001"


def test_ingest_batch_replay_is_idempotent(spark):
    t = D.Tables(spark, SF)
    landing = D.payments_landing(t)
    out = I.run_dir(spark, "test-ingest")
    I.ingest_batch(landing, 0, out, I.amount_scorer)
    n0 = I.read_store(spark, os.path.join(out, "transactions")).count()
    I.ingest_batch(landing, 0, out, I.amount_scorer)           # retried batch 0
    n1 = I.read_store(spark, os.path.join(out, "transactions")).count()
    I.ingest_batch(landing, 1, out, I.amount_scorer)           # same rows again in batch 1
    tx = I.read_store(spark, os.path.join(out, "transactions"))
    assert n0 == n1 == tx.count() == tx.select("trans_num").distinct().count()
    dl = spark.read.parquet(os.path.join(out, "dead_letter"))
    assert dl.filter("batch_id = '0'").count() == dl.filter("batch_id = '1'").count() > 0


def test_stream_ingest_end_to_end(spark):
    landing = D.payments_landing_from(I.table_stream(spark, SF, "lineitem"))
    out = I.run_dir(spark, "test-stream")
    I.run_ingest(landing, out).awaitTermination()
    tx = I.read_store(spark, os.path.join(out, "transactions"))
    batch = D.payments_landing(D.Tables(spark, SF))
    from paylake.operators.quality import validate
    n_valid_keys = validate(batch).filter("data_quality_status = 'valid'").select("trans_num").distinct().count()
    assert tx.count() == n_valid_keys


def test_sessionize_streaming_append(spark):
    s = M.sessionize(I.table_stream(spark, SF, "events"), "user_id", "ts")
    out = I.collect_stream(s, "test-sessions", spark, "append")
    batch = M.sessionize(D.Tables(spark, SF).events, "user_id", "ts")
    # closed sessions (watermark passed) equal the batch result; open ones wait
    assert 0 < out.count() <= batch.count()
    assert out.join(batch, ["user_id", "session_start", "session_end", "n_events"], "left_anti").count() == 0


def test_stratified_split_is_exact(spark):
    df = spark.range(1000).select(F.col("id").cast("string").alias("id"),
                                  (F.col("id") % 10 == 0).cast("int").alias("label"))
    s = ML.stratified_split(df, "label", "id", 0.2, 42, n_buckets=16)
    got = {(r.label, r.is_test): r["count"] for r in s.groupBy("label", "is_test").count().collect()}
    assert got[(1, True)] == 20 and got[(0, True)] == 180 and got[(0, False)] == 720
    s2 = ML.stratified_split(df, "label", "id", 0.2, 42, n_buckets=16)
    assert s.filter("is_test").select("id").exceptAll(s2.filter("is_test").select("id")).count() == 0


def test_payment_vector_shape(spark):
    row = ("125.50", "40.7128", "-74.0060", "8336817", "1371816893", "40.7200", "-74.0100")
    df = spark.createDataFrame([row], ", ".join(f"{c} string" for c in ML.MODEL_FEATURES))
    x = ML.payment_features(df)
    v = ML.payment_vector_stage().transform(x).first().raw_features
    assert len(v) == 6 and abs(v[0] - 125.5) < 1e-9


def test_one_hot_drops_alphabetically_first_and_zeros_the_unseen(spark):
    from pyspark.ml import Pipeline
    df = spark.createDataFrame([("mobile", "low", "Food"), ("desktop", "high", "It's"), (None, "low", "Food")],
                               "device_type string, risk_tier string, mcc_category string")
    cats = ML.categories(df)
    assert cats["device_type"] == ["desktop", "mobile", "unknown"]
    fields = ML.one_hot_fields(cats)
    assert fields == ["device_type_oh_1", "device_type_oh_2", "risk_tier_oh_1", "mcc_category_oh_1"]
    new = df.unionByName(spark.createDataFrame([("watch", "low", "It's")], df.schema))
    got = [tuple(r) for r in Pipeline(stages=ML.one_hot_stages(cats)).fit(df).transform(new).select(*fields).collect()]
    assert got == [(1, 0, 1, 0), (0, 0, 0, 1), (0, 1, 1, 0), (0, 0, 1, 1)]


def test_serving_equals_training(spark):
    """The saved pipeline takes the seven raw inputs; columns that were engineered before change nothing."""
    import os
    from pyspark.ml.classification import DecisionTreeClassifier
    from paylake.operators.scoring import score_batch
    from paylake.streaming.ingest import run_dir
    rows = [(str(i), str(10.5 * i) if i % 9 else "abc", "40.1", "-74.0", str(1000 * i), str(1371816893 + 3600 * i), "40.2",
             None if i % 7 == 0 else "-74.5", int(i % 24 > 12)) for i in range(200)]
    raw = spark.createDataFrame(rows, "id string, " + ", ".join(f"{c} string" for c in ML.MODEL_FEATURES) + ", label int")
    model = ML.payment_pipeline(DecisionTreeClassifier(maxDepth=4, seed=1), 200).fit(raw)
    path = ML.save_model(model, os.path.join(run_dir(spark, "test-model"), "m"))
    loaded = ML.load_model(path)
    served = lambda df: {r.id: (r.fraud_probability, r.is_fraud_predicted) for r in score_batch(df, loaded, "v1", ML.MODEL_FEATURES).collect()}
    a = served(raw.drop("label"))
    assert a == served(ML.payment_features(raw).drop("label")) and len({p for p, _ in a.values()}) > 1
    assert len(served(raw.select("id", "amt"))) == 200  # absent inputs count as 0
    z = model.transform(raw).select("features")
    from pyspark.ml.functions import vector_to_array
    dev = z.select(vector_to_array("features")[0].alias("z")).agg(F.stddev_pop("z"), F.avg("z")).first()
    assert abs(dev[0] - 1) < 1e-9 and abs(dev[1]) < 1e-9


def test_folds_are_stratified(spark):
    df = spark.range(1003).select(F.col("id").cast("string").alias("id"), (F.col("id") % 10 == 0).cast("int").alias("label"))
    n = {(r.label, r.fold): r["count"] for r in ML.fold_column(df, "id", n_buckets=16).groupBy("label", "fold").count().collect()}
    assert {n[1, k] for k in range(5)} <= {20, 21} and {n[0, k] for k in range(5)} <= {180, 181}


def test_auc_keeps_close_scores_apart(spark):
    df = spark.createDataFrame([(0.5 + 1e-9, 1), (0.5, 0), (0.2, 1), (0.2 - 1e-9, 0)], "_s double, _y int")
    assert ML.auc_of(df).first().auc == 0.75


def test_auc_and_gate(spark):
    df = spark.createDataFrame([(0.9, 1), (0.8, 1), (0.3, 0), (0.8, 0), (0.1, 0)], "_s double, _y int")
    auc = ML.auc_of(df).first().auc
    assert abs(auc - (5.5 / 6)) < 1e-9
    m = spark.createDataFrame([(0.6, 0.2)], "recall double, precision double")
    assert ML.gate(m).first().passed is True
    assert ML.gate(m, {"recall": 0.7}).first().passed is False


def test_update_mode_across_micro_batches(spark):
    """Four time-ordered files -> four micro-batches; the latest version of
    every sliding window equals the batch computation."""
    ev = D.Tables(spark, SF).events
    src = I.run_dir(spark, "test-multibatch-src")
    bounds = ["2024-01-01", "2024-01-08", "2024-01-15", "2024-01-22", "2024-02-01"]
    for lo, hi in zip(bounds, bounds[1:]):
        ev.filter((F.col("ts") >= F.lit(lo).cast("timestamp_ntz")) & (F.col("ts") < F.lit(hi).cast("timestamp_ntz"))) \
          .coalesce(1).write.mode("append").parquet(src)
    stream = I.read_events_stream(spark, src, ev.schema, max_files_per_trigger=1)
    got = I.collect_stream(M.sliding_counters(stream, "user_id", "ts"), "test-multibatch", spark, "update",
                           ["user_id", "window_start"])
    exp = M.sliding_counters(ev, "user_id", "ts")
    assert got.count() == exp.count()
    assert got.exceptAll(exp.select(*got.columns)).count() == 0


def test_alert_sink_first_score_wins(spark):
    feats = spark.createDataFrame([("c1", (12, 5.0, 0.9, 0.6))],
                                  "customer_id string, features struct<tx_count_24h:int, tx_amount_sum_24h:double, velocity_score:double, risk_score:double>")
    req = "transaction_id string, customer_id string, amount_usd double, ip_country string"
    out = I.run_dir(spark, "test-alerts")
    I.alerts_batch(spark.createDataFrame([("t1", "c1", 50.0, "FR"), ("t2", "c9", 6000.0, "NG")], req), 0, out, feats)
    I.alerts_batch(spark.createDataFrame([("t1", "c1", 9999.0, "RU"), ("t3", "c9", 10.0, "FR")], req), 1, out, feats)
    a = {r.transaction_id: r for r in I.read_store(spark, os.path.join(out, "fraud_alerts")).collect()}
    assert sorted(a) == ["t1", "t2", "t3"]
    assert a["t1"].decision == "block" and str(a["t1"].score) == "0.7000"   # first score kept
    assert a["t2"].reasons == ["high_amount", "very_high_amount", "high_risk_country"]


def test_cv_auc_parallel_folds(spark):
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler
    df = spark.range(400).select(F.col("id").cast("string").alias("id"), (F.col("id") % 7).cast("double").alias("x"),
                                 (F.col("id") % 7 >= 4).cast("int").alias("label"))
    df = ML.fold_column(df, "id", folds=3)
    pipe = Pipeline(stages=[VectorAssembler(inputCols=["x"], outputCol="features"),
                            RandomForestClassifier(numTrees=5, maxDepth=3, seed=1)])
    aucs = ML.cv_auc(pipe, df, folds=3)
    assert len(aucs) == 3 and min(aucs) > 0.99


def test_late_rows_go_to_the_dead_letters(spark):
    """Three batches: rows behind the latest event time of earlier batches are parted off, a replay parts off the same."""
    cols = ["trans_num", "trans_date_trans_time", "cc_num", "merchant", "category", "amt", "lat", "long", "merch_lat", "merch_long",
            "city_pop", "unix_time", "city", "state"]
    row = lambda i, at: (f"L{i}", at, "4" * 16, "m", "c", "10.0", "1", "1", "1", "1", "5", "1371816893", "x", "CA")
    day = "2024-01-01 "
    batches = [[row(1, day + "10:00:00"), row(2, day + "10:30:00")],
               [row(3, day + "10:25:00"), row(4, day + "10:15:00"), row(5, day + "11:00:00")],
               [row(6, day + "10:40:00"), row(7, "not a time"), row(8, day + "11:30:00")]]
    out = I.run_dir(spark, "test-late")
    for b in (0, 1, 1, 2):
        I.ingest_batch(spark.createDataFrame(batches[b], cols), b, out, I.amount_scorer, event_time="trans_date_trans_time")
    dead = spark.read.parquet(os.path.join(out, "dead_letter"))
    late = dead.filter("error_type = 'late_event'").select(F.get_json_object("raw_data", "$.trans_num")).collect()
    assert sorted(r[0] for r in late) == ["L4", "L6"]
    assert {r.trans_num for r in I.read_store(spark, os.path.join(out, "transactions")).collect()} == {"L1", "L2", "L3", "L5", "L7", "L8"}
    runs = {r.task_id: (r.records_processed, r.records_failed) for r in spark.read.parquet(os.path.join(out, "pipeline_runs")).collect()}
    assert runs["batch_1"] == (3, 1) and runs["batch_2"] == (3, 1)
    assert dead.filter("year(created_at) < 2020").count() == 0


def test_keyed_store_files_replay_and_compaction(spark):
    """One file a bucket and batch, two after compaction; a repeated batch changes nothing; the first row of a key stays."""
    from paylake.sources.keyed_store import KeyedStore
    store = KeyedStore(spark, os.path.join(I.run_dir(spark, "test-store"), "t"), "k", buckets=8)
    rows = lambda lo, hi, v: spark.range(lo, hi).selectExpr("concat('k', id) k", f"{v} v")
    assert store.insert(rows(0, 1000, 0), 0).count() == 1000
    assert store.insert(rows(900, 1500, 1), 1).count() == 500
    before = store.files_per_bucket()
    assert store.insert(rows(900, 1500, 1), 1).count() == 500 and store.files_per_bucket() == before == dict.fromkeys(range(8), 2)
    store.insert(rows(1490, 1600, 2), 2)
    assert max(store.files_per_bucket().values()) == 3
    store.compact()
    store.vacuum()
    assert max(store.files_per_bucket().values()) == 2
    assert store.insert(rows(1490, 1600, 2), 2).count() == 100, "the last batch can be repeated after a compaction"
    got = {r.v: r["count"] for r in store.read().groupBy("v").count().collect()}
    assert got == {0: 1000, 1: 500, 2: 100} and store.read().select("k").distinct().count() == 1600


def test_keyed_store_bloom_filters_skip_files(spark):
    from paylake.sources.keyed_store import KeyedStore
    store = KeyedStore(spark, os.path.join(I.run_dir(spark, "test-bloom"), "t"), "k", buckets=4)
    rows = lambda *ids: spark.createDataFrame([(f"k{i}",) for i in ids], "k string")
    store.insert(rows(*range(5000)), 0)
    store.insert(rows(*range(6000, 6010)), 1)
    _, state = store.state()
    new = [f for f in state["files"] if f["batch"] == "1"]
    older = {**state, "files": [f for f in state["files"] if f["batch"] == "0"]}
    assert len(new) > 1 and store._may_hold(new, older) == []  # keys not stored: no file is read
    store.insert(rows(17, 7000), 2)
    _, state = store.state()
    hit = store._may_hold(store._write(rows(17).selectExpr("k", "xxhash64(k) _hash", "cast(pmod(xxhash64(k), 4) as int) _bucket"), 4, None), state)
    assert [f["batch"] for f in hit] == ["0"]


def test_keyed_store_splits_full_buckets_and_loses_no_race(spark):
    import pytest
    from paylake.sources.keyed_store import KeyedStore
    from paylake.sources.manifest import LostRace, Manifest
    store = KeyedStore(spark, os.path.join(I.run_dir(spark, "test-split"), "t"), "k", buckets=2, rows_per_bucket=100)
    for b in range(3):
        store.insert(spark.range(100 * b, 100 * b + 200).selectExpr("concat('k', id) k", f"{b} v"), b)
    store.compact()
    assert store.state()[1]["buckets"] == 4 and store.read().count() == 400
    assert store.insert(spark.range(0, 401).selectExpr("concat('k', id) k", "9 v"), 3).count() == 1
    with pytest.raises(LostRace):
        Manifest(spark, store.root).commit(1, {})


def test_forest_reads_stored_rows_in_even_parts(spark):
    """The split, weights and training read the stored payments, not lineitem and every rule once more each."""
    from paylake.operators import ml as ML
    from paylake.plans import domain as D
    from paylake.plans import q_models as QM
    rows = QM._payments_train(D.Tables(spark, "/root/testdata/sf0.001"))
    assert all("paylake-payments" in f for f in rows.inputFiles()) and rows.count() == QM._labelled_payments(D.Tables(spark, "/root/testdata/sf0.001")).count()
    assert ML.evenly(rows, "trans_num").rdd.getNumPartitions() % spark.sparkContext.defaultParallelism == 0
    assert ML.forest_pipeline().getCacheNodeIds()


def test_keyed_store_joins_large_batches_without_filters(spark):
    """A batch as large as the store meets the stored keys in a join; filters are built when a small batch comes."""
    from paylake.sources.keyed_store import KeyedStore
    store = KeyedStore(spark, os.path.join(I.run_dir(spark, "test-direct"), "t"), "k", buckets=4)
    rows = lambda lo, hi: spark.range(lo, hi).selectExpr("concat('k', id) k")
    store.insert(rows(0, 2000), 0)
    assert store.insert(rows(1000, 3000), 1).count() == 1000
    assert all(f["bloom"] is None for f in store.state()[1]["files"]) and not store.manifest.folders(f"{store.root}/bloom")
    assert store.insert(rows(2990, 3010), 2).count() == 10 and store.read().count() == 3010
    assert all(f["bloom"] for f in store.state()[1]["files"] if f["batch"] in ("0", "1"))
    store.vacuum()
    assert store.insert(rows(2990, 3020), 3).count() == 10 and store.read().distinct().count() == 3020


def test_cv_auc_runs_the_stages_that_learn_nothing_once(spark):
    from pyspark.ml import Pipeline, Transformer
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import StandardScaler, VectorAssembler
    runs = []

    class Seen(Transformer):
        def _transform(self, df):
            runs.append(1)
            return df.withColumn("x2", F.col("x") * 2)

    df = spark.range(400).select("id", (F.col("id") % 7).cast("double").alias("x"), (F.col("id") % 7 > 3).cast("int").alias("label"))
    df = ML.fold_column(df, "id", folds=3)
    learner = LogisticRegression(featuresCol="v", labelCol="label", maxIter=5)
    before = [Seen(), VectorAssembler(inputCols=["x", "x2"], outputCol="v")]
    aucs = ML.cv_auc(Pipeline(stages=[*before, learner]), df, folds=3)
    assert len(runs) == 1 and len(aucs) == 3 and min(aucs) > 0.99
    scaled = [VectorAssembler(inputCols=["x", "x2"], outputCol="u"), StandardScaler(inputCol="u", outputCol="v")]
    assert ML.cv_auc(Pipeline(stages=[Seen(), *scaled, learner]), df, folds=3) == aucs and len(runs) == 2
