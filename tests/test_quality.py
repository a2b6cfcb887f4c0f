"""Validator cases of the reference tests, plus edge cases, as literal rows."""

import math

import pytest
from pyspark.sql import functions as F

from paylake.operators import quality as Q

COLS = ["trans_num", "amt", "cc_num", "merchant", "category", "lat", "long", "merch_lat", "merch_long",
        "city_pop", "unix_time"]
VALID = dict(trans_num="TXN001", amt="125.50", cc_num="4111111111111111", merchant="shop", category="grocery_pos",
             lat="40.7128", long="-74.0060", merch_lat="40.7200", merch_long="-74.0100", city_pop="8336817",
             unix_time="1371816893")


def run(spark, **changes):
    rec = dict(VALID, **changes)
    df = spark.createDataFrame([tuple(rec[c] for c in COLS)], ", ".join(f"{c} string" for c in COLS))
    return Q.validate(df).select("errors", "data_quality_status").first()


def test_valid_record(spark):
    r = run(spark)
    assert r.data_quality_status == "valid" and r.errors == []


@pytest.mark.parametrize("amt,msg", [("-50", "Montant <= 0: -50"), ("0", "Montant <= 0: 0"),
                                     ("99999", "Montant suspect (> 50k): 99999"),
                                     ("abc", "Montant non numérique: abc"), ("NaN", "Montant non numérique: NaN")])
def test_amount_rules(spark, amt, msg):
    r = run(spark, amt=amt)
    assert r.data_quality_status == "rejected" and r.errors == [msg]


def test_amount_boundary_passes(spark):
    assert run(spark, amt="50000").errors == []


def test_latitude(spark):
    assert run(spark, lat="999").errors == ["lat hors limites: 999"]
    assert run(spark, lat="90").errors == [] and run(spark, lat="-90").errors == []


def test_card_length(spark):
    assert run(spark, cc_num="123").errors == ["N° carte trop court: 123"]


def test_missing_and_order(spark):
    r = run(spark, merchant=None, amt="-1")
    assert r.errors == ["Champ manquant ou null: merchant", "Montant <= 0: -1"]


def test_empty_string_passes_required(spark):
    assert run(spark, merchant="").errors == []


def test_missing_column_fails_schema(spark):
    cols = [c for c in COLS if c != "trans_num"]
    df = spark.createDataFrame([tuple(VALID[c] for c in cols)], ", ".join(f"{c} string" for c in cols))
    r = Q.validate(df).first()
    assert r.schema_errors == ["Champ manquant ou null: trans_num"]


@pytest.mark.parametrize("p,ok", [(0.85, True), (1.5, False), (None, False), (0.0, True), (1.0, True)])
def test_probability(spark, p, ok):
    df = spark.createDataFrame([(p,)], "fraud_probability double")
    msg = df.select(Q.rule_probability()[0].message.alias("m")).first().m
    assert (msg is None) == ok


def test_dq_log_two_rows_per_record(spark):
    df = spark.createDataFrame([tuple(VALID[c] for c in COLS), tuple(dict(VALID, trans_num="T2", amt="-1")[c] for c in COLS)],
                               ", ".join(f"{c} string" for c in COLS))
    log = Q.dq_log(Q.validate(df), execution_date="2024-01-01")
    assert log.count() == 4
    summ = {r.check_name: r for r in Q.dq_summary(log).collect()}
    assert float(summ["business_rules"].pass_rate) == 0.5 and float(summ["schema_validation"].pass_rate) == 1.0


def test_separator_in_value_does_not_split(spark):
    r = run(spark, amt="a\u001fb")
    assert len(r.errors) == 1 and r.errors[0].startswith("Montant non numérique")


def test_duplicates_and_gate(spark):
    df = spark.createDataFrame([("a",), ("a",), ("b",)], "k string")
    assert [r.k for r in Q.duplicates(df, "k").collect()] == ["a"]
    assert Q.gate_row_count(df, 1, 2).first().passed is False


def test_a_filter_on_the_status_has_each_rule_once(spark):
    """Pushed through projections, the filter would hold every rule once more, and its parsing of numbers many times."""
    from paylake.operators import quality as Q
    from paylake.plans import domain as D
    rejected = Q.split_valid(Q.validate(D.payments_landing(D.Tables(spark, "/root/testdata/sf0.001"))))[1]
    plan = rejected._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Champ manquant ou null: merchant") == 1


def test_tables_are_read_with_splits_that_tasks_can_sort(spark):
    from paylake import session
    before = {k: spark.conf.get(k, None) for k in session.TUNED}
    try:
        spark.conf.set("spark.sql.codegen.hugeMethodLimit", "65535")
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(128 << 20))
        session.read_table(spark, "/root/testdata/sf0.001", "lineitem")
        assert int(spark.conf.get("spark.sql.codegen.hugeMethodLimit")) == 8000
        assert spark.conf.get("spark.sql.files.maxPartitionBytes").rstrip("b") == str(32 << 20)
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(16 << 20))  # the caller's own choice stays
        session.read_table(spark, "/root/testdata/sf0.001", "lineitem")
        assert spark.conf.get("spark.sql.files.maxPartitionBytes").rstrip("b") == str(16 << 20)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)
