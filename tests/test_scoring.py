"""Rule score, decisions and feature lookup (reference cases, noise removed)."""

from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from paylake.operators import scoring as SC
from paylake.operators.joins import lookup_features

SCHEMA = "amount_usd double, tx_count_24h int, velocity_score double, risk_score double, ip_country string"


@pytest.mark.parametrize("row,score,reasons", [
    ((20.0, 0, 0.0, 0.0, "FR"), "0.10", []),
    ((6000.0, 0, 0.0, 0.0, "FR"), "0.45", ["high_amount", "very_high_amount"]),
    ((50.0, 0, 0.0, 0.0, "NG"), "0.25", ["high_risk_country"]),
    ((100.0, 15, 0.85, 0.6, "FR"), "0.70", ["high_velocity_24h", "velocity_anomaly", "high_customer_risk"]),
    ((9000.0, 20, 0.9, 0.9, "RU"), "1.00", ["high_amount", "very_high_amount", "high_velocity_24h",
                                             "velocity_anomaly", "high_customer_risk", "high_risk_country"]),
])
def test_rule_score(spark, row, score, reasons):
    r = SC.rule_score(spark.createDataFrame([row], SCHEMA)).withColumn("d", SC.decide("score")).first()
    assert r.score == Decimal(score) and r.reasons == reasons


def test_velocity_case_blocks(spark):
    r = SC.rule_score(spark.createDataFrame([(100.0, 15, 0.85, 0.6, "FR")], SCHEMA)) \
        .select(SC.decide("score").alias("d")).first()
    assert r.d == "block"


@pytest.mark.parametrize("s,d", [(0.0, "approve"), (0.29, "approve"), (0.3, "review"), (0.5, "review"),
                                 (0.69, "review"), (0.7, "block"), (1.0, "block")])
def test_decide(spark, s, d):
    assert spark.createDataFrame([(s,)], "s double").select(SC.decide("s").alias("d")).first().d == d


def test_lookup_defaults_and_hit(spark):
    tx = spark.createDataFrame([("t1", "c1"), ("t2", "c2")], "transaction_id string, customer_id string")
    feats = spark.createDataFrame([("c1", (12, 5.0, 0.9, 0.4))],
                                  "customer_id string, features struct<tx_count_24h:int, tx_amount_sum_24h:double, velocity_score:double, risk_score:double>")
    rows = {r.transaction_id: r for r in lookup_features(tx, feats).collect()}
    assert rows["t2"].feature_found is False and rows["t2"].tx_count_24h == 0 and rows["t2"].risk_score == 0.0
    assert rows["t1"].feature_found is True and rows["t1"].tx_count_24h == 12 and rows["t1"].velocity_score == 0.9


def test_canary_share(spark):
    df = spark.range(20000).select(F.concat(F.lit("tx_"), F.col("id").cast("string")).alias("tid"))
    share = SC.canary(df, "tid", 5).filter("model_route = 'canary'").count() / 20000
    assert 0.04 < share < 0.06
