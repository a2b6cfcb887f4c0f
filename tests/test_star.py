"""The written fact: later copies, late refunds, disputes and rates give the rows of one load."""

import datetime as dt
import os
from decimal import Decimal

import pytest

from paylake.plans import domain as D
from paylake.plans import star as S
from paylake.plans.q_star import incremental_fact
from paylake.streaming.ingest import run_dir

SF = "/root/testdata/sf0.001"
TX = ("transaction_sk long, transaction_id string, customer_sk long, merchant_sk long, amount decimal(18,2), currency_code string, status string, "
      "fraud_score decimal(5,4), device_type string, is_3d_secure int, discount decimal(4,2), created_at timestamp_ntz, loaded_at int")
EVENT = "transaction_sk long, amount decimal(18,2), status string, created_at timestamp_ntz, loaded_at int"
RATE = "from_currency string, to_currency string, rate decimal(18,8), effective_date date, loaded_at int"


def tx(sk, day, amount, load, currency="EUR"):
    return (sk, f"tx_{sk}", 1, 2, Decimal(amount), currency, "captured", Decimal("0.1"), "api", 0, Decimal("0.10"),
            dt.datetime.fromisoformat(day), load)


def event(sk, amount, status, day, load):
    return sk, Decimal(amount), status, dt.datetime.fromisoformat(day), load


def rate(value, day, load, currency="EUR"):
    return currency, "USD", Decimal(value), dt.date.fromisoformat(day), load


@pytest.mark.parametrize("grain", ["month", "day"])
def test_merge_equals_one_load_and_rewrites_only_what_changed(spark, grain):
    txs = [tx(11, "2024-01-05", "10", 1), tx(12, "2024-02-05", "20", 1), tx(13, "2024-03-05", "30", 1), tx(14, "2024-04-05", "40", 1),
           tx(15, "2024-05-05", "50", 1), tx(16, "2024-05-06", "60", 1, "JPY"),
           tx(11, "2024-06-07", "11", 2),   # a later copy moves to another day
           tx(12, "2024-02-01", "99", 2),   # an older copy that comes late changes nothing
           tx(17, "2024-07-01", "70", 2)]
    refunds = [event(13, "30", "succeeded", "2024-03-09", 3), event(13, "5", "pending", "2024-03-08", 1), event(14, "1", "succeeded", "2024-04-06", 1)]
    disputes = [event(14, "40", "lost", "2024-04-09", 3)]
    rates = [rate("1.1", "2024-01-01", 1), rate("0.01", "2024-01-01", 1, "JPY"), rate("1.2", "2024-05-01", 4)]
    frames = [spark.createDataFrame(r, s) for r, s in ((txs, TX), (refunds, EVENT), (disputes, EVENT), (rates, RATE))]

    def one_load(k):
        a, b, c, r = (f.filter(f"loaded_at <= {k}") for f in frames)
        return sorted(map(tuple, S.build_fact(S.latest_transactions(a.drop("loaded_at")), S.latest_events(b), S.latest_events(c), r)
                          .select(*S.FACT_COLUMNS).collect()))

    table = S.FactTable(spark, os.path.join(run_dir(spark, "test-fact"), "f"), grain)
    a, b, c, r = (f.filter("loaded_at <= 1") for f in frames)
    table.load(S.build_fact(S.latest_transactions(a.drop("loaded_at")), S.latest_events(b), S.latest_events(c), r))
    opened = table.read()
    first = table.periods()
    want = {2: ["2024-01-05", "2024-02-05", "2024-06-07", "2024-07-01"], 3: ["2024-03-05", "2024-04-05"], 4: ["2024-05-05", "2024-06-07", "2024-07-01"]}
    for k in (2, 3, 4):
        before = table.periods()
        done = table.merge(*(f.filter(f"loaded_at <= {k}") for f in frames), since=k - 1)
        assert done == sorted({d if grain == "day" else d[:7] + "-01" for d in want[k]})
        assert all(table.periods().get(p) == f for p, f in before.items() if p not in done)
        assert sorted(map(tuple, table.read().select(*S.FACT_COLUMNS).collect())) == one_load(k)
    assert opened.count() == 6 and len(first) >= 5, "a reader keeps the version it opened"
    got = {x.transaction_sk: x for x in table.read().collect()}
    assert got[13].status == "refunded" and got[14].status == "disputed" and str(got[15].fx_rate) == "1.20000000" and len(got) == 7
    assert {x.transaction_sk for x in table.read("2024-05-01", "2024-06-30").collect()} == {11, 15, 16}
    assert table.merge(*frames, since=9) == []  # nothing new


def test_three_loads_of_the_tables(spark):
    table = incremental_fact(spark, SF)
    full = S.fact_transaction_full(D.Tables(spark, SF))
    got = table.read().select(*S.FACT_COLUMNS)
    assert got.exceptAll(full).count() == full.exceptAll(got).count() == 0 and got.count() > 1000


def test_the_fact_is_laid_out_before_columns_are_derived(spark):
    """What follows from a row's other columns is neither shuffled nor sorted with it."""
    from paylake.plans import star as S
    t = S.Tables(spark, "/root/testdata/sf0.001")
    joined = S.fact_transaction_all(t)
    assert not {"transaction_id", "amount_usd", "revenue_usd", "date_sk", "is_high_fraud_risk"} & set(joined.columns)
    stored = S.stored_fact(t).read()
    assert set(S.FACT_COLUMNS) <= set(stored.columns) and "period" not in stored.columns
    assert stored.select(*S.FACT_COLUMNS).exceptAll(S.fact_transaction_full(t)).count() == 0


def test_later_loads_are_laid_out_before_columns_are_derived(spark, monkeypatch):
    # ids, dollars, flags and the date key went through every shuffle of a load
    laid, write = [], S.FactTable._write
    monkeypatch.setattr(S.FactTable, "_write", lambda self, rows, *order, derive=None: laid.append(rows.columns) or write(self, rows, *order, derive=derive))
    got = incremental_fact(spark, SF).read()
    assert len(laid) == 3 and all(c == S.LAID_COLUMNS for c in laid) and "transaction_id" not in S.LAID_COLUMNS
    want = S.fact_transaction_full(D.Tables(spark, SF)).select(*S.FACT_COLUMNS)
    assert sorted(map(str, got.select(*S.FACT_COLUMNS).collect())) == sorted(map(str, want.collect()))


def test_fact_of_days_is_the_fact_and_writes_nothing(spark, tmp_path):
    from pyspark.sql import functions as F
    d = str(tmp_path)
    li = spark.read.parquet(f"{SF}/lineitem.parquet")
    # later copies: of some days' rows, rows that leave these days and rows that come in
    later = li.filter("l_orderkey % 3 = 0").withColumns({"l_shipdate": F.expr("l_shipdate + INTERVAL 45 DAYS"), "l_extendedprice": F.col("l_extendedprice") + 1})
    li.unionByName(later.select(*li.columns)).write.parquet(f"{d}/lineitem.parquet")
    for name in ("orders", "customer", "supplier", "nation", "region"):
        spark.read.parquet(f"{SF}/{name}.parquet").write.parquet(f"{d}/{name}.parquet")
    t = D.Tables(spark, d)
    days = S.fact_of_days(t, "2001-04-01", "2001-06-30")
    assert not S._fact_table(t).periods()
    got = days.localCheckpoint()
    want = S.fact(t, "2001-04-01", "2001-06-30")
    assert sorted(got.columns) == sorted(want.columns) and dict(got.dtypes) == dict(want.dtypes)
    want = want.select(*got.columns).localCheckpoint()
    assert got.count() > 100 and got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0
    assert S._fact_table(t).periods()
    assert S.fact_of_days(t, "2001-04-01", "2001-06-30").select(*got.columns).exceptAll(got).count() == 0


def test_loads_in_parts_leave_one_version_on_the_disk(spark, monkeypatch):
    """Wide rows are shuffled some periods at a time; earlier versions and scratch tables are gone at the end."""
    from paylake.session import checkpoint_root
    from paylake.sources import period_table as P
    monkeypatch.setattr(P, "PART_ROWS", 2500)
    laid, write = [], S.FactTable._write
    monkeypatch.setattr(S.FactTable, "_write", lambda self, rows, *order, derive=None: laid.append(write(self, rows, *order, derive=derive)) or laid[-1])
    table = incremental_fact(spark, SF)
    assert 6 <= len(laid) <= 12 and all(len(x) > 1 for x in laid)
    rows = table.read().select(*S.FACT_COLUMNS)
    full = S.fact_transaction_full(D.Tables(spark, SF))
    assert sorted(map(str, rows.collect())) == sorted(map(str, full.collect()))
    m = table.manifest
    there = {f"data/{n}/{f}" for n in m.folders(f"{table.root}/data") for f in m.folders(f"{table.root}/data/{n}")}
    assert there == {f for v in table.periods().values() for f in v}
    assert not [n for n in m.folders(table.root) + m.folders(checkpoint_root(spark)) if n.startswith(("scratch-", "paylake-merge-"))]


def test_rows_without_a_day_survive_a_merge(spark):
    none = lambda sk, load: (*tx(sk, "2024-01-01", "5", load)[:-2], None, load)
    txs = spark.createDataFrame([tx(21, "2024-01-05", "10", 1), none(22, 1), none(23, 1), none(23, 2), none(24, 2)], TX)
    events, rates = spark.createDataFrame([], EVENT), spark.createDataFrame([rate("1.1", "2024-01-01", 1)], RATE)
    table = S.FactTable(spark, os.path.join(run_dir(spark, "test-none"), "f"))
    table.load_in_parts(S.joined_fact(S.latest_transactions(txs.filter("loaded_at = 1").select(*S.KEYED_COLUMNS)), S.latest_events(events), S.latest_events(events), rates)
                        .select(*S.LAID_COLUMNS), derive=S.derive_fact)
    table.merge(txs, events, events, rates, since=1)
    table.vacuum()
    assert sorted(r[0] for r in table.read().select("transaction_sk").collect()) == [21, 22, 23, 24]
