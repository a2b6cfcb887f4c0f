"""Plan properties the library relies on at scale (checked on sf0.001)."""

import __spark_entry__ as E
from paylake.operators import ml as ML
from paylake.operators.joins import join_dim
from paylake.operators.quality import validate
from paylake.plans import domain as D

SF = "/root/testdata/sf0.001"

def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()

def test_q01_reads_only_its_periods_of_the_fact(spark):
    df = E.queries()["q01_revenue_by_region"](spark, SF)
    p = plan(df)
    assert "GreaterThanOrEqual(transaction_date" in p and "Expand" not in p
    fact = [f for f in df.inputFiles() if "period=" in f]
    assert {f.split("period=")[1][:10] for f in fact} == {"2001-05-01", "2001-06-01"}
    schema = [x for x in p.split("ReadSchema: ") if x.startswith("struct<transaction_sk")][0].split(">")[0]
    assert "device_type" not in schema and "fx_rate" not in schema

def test_dimension_broadcast_respects_cap(spark):
    t = D.Tables(spark, SF)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        fact = D.fact_transaction(t).select("merchant_sk", "amount_usd")
        dim = D.dim_merchant(t).select("merchant_sk", "region")
        assert "BroadcastHashJoin" in plan(join_dim(fact, dim, "merchant_sk"))
        assert "SortMergeJoin" in plan(join_dim(fact, dim, "merchant_sk", cap_bytes=0))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", str(64 * 1024 * 1024))

def test_cap_has_no_single_task_topk(spark):
    t = D.Tables(spark, SF)
    df = ML.training_set(D.fact_transaction(t), D.dim_customer(t), D.dim_merchant(t), D.AS_OF_TX, days=365, cap=100)
    p = plan(df)
    assert "TakeOrderedAndProject" not in p and "GlobalLimit" not in p
    assert df.count() == 100

def test_validation_stays_out_of_higher_order_functions(spark):
    p = plan(validate(D.payments_landing(D.Tables(spark, SF))))
    assert "lambdafunction" not in p.lower()

def test_dedup_is_an_aggregate_not_a_window(spark):
    p = plan(E.queries()["q15_stg_transactions"](spark, SF))
    assert "Window" not in p and "Aggregate" in p
