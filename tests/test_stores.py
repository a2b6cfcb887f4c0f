"""Versioned stores, the text index, trailing windows, rate calendar, erasure by file, skipping layout, registry."""

import datetime as dt
import os
import random
import uuid

import pytest
from pyspark.sql import functions as F

from paylake.operators.erasure import SubjectTable
from paylake.operators.features import trailing_all
from paylake.operators.joins import to_usd
from paylake.operators.ml import ModelRegistry
from paylake.plans import domain as D
from paylake.sources.aggregate_store import AggregateStore
from paylake.sources.manifest import LostRace, Manifest
from paylake.sources.period_table import PeriodTable
from paylake.sources.scored_store import ScoredStore
from paylake.sources.sinks import write_skipping
from paylake.sources.text_index import TextIndex
from paylake.streaming import maintain as K
from paylake.streaming.ingest import run_dir

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_manifest_passes_over_an_unfinished_version(spark):
    m = Manifest(spark, run_dir(spark, "test-manifest"))
    assert m.read() == (0, None)
    assert m.commit(0, {"a": 1}) == 1
    m.spark._jvm.org.apache.hadoop.fs.FileSystem.get(spark._jsc.hadoopConfiguration())
    out = m._fs().create(m._path(f"{m.folder}/000000002.json"), False)
    out.write(bytearray(b'{"a": '))
    out.close()
    assert m.read() == (2, {"a": 1})
    assert m.commit(2, {"a": 3}) == 3 and m.read() == (3, {"a": 3})
    with pytest.raises(LostRace):
        m.commit(2, {"a": 4})


def test_aggregate_store_adds_each_batch_once(spark):
    store = AggregateStore(spark, run_dir(spark, "test-sums"), ["k"], sums=["n"], lows=["lo"], highs=["hi"], by="k")
    assert store.read() is None
    for b in (0, 1, 1, 2, 3):
        store.add(spark.range(12).selectExpr("id % 3 k", "1L n", f"id + {b} lo", f"id + {b} hi"), b)
    want = [(0, 16, 0, 12), (1, 16, 1, 13), (2, 16, 2, 14)]
    assert sorted((r.k, r.n, r.lo, r.hi) for r in store.read().collect()) == want
    assert store.compact(most=2) and not store.compact(most=2)
    store.vacuum()
    assert sorted((r.k, r.n, r.lo, r.hi) for r in store.read().collect()) == want
    assert "EqualTo(k,1)" in plan(store.read(F.col("k") == 1)) and store.read(F.col("k") == 1).count() == 1


def test_texts_of_scored_rows_are_added_after_the_layout(spark, monkeypatch):
    # texts that follow from the keys went through the shuffle and sort by period
    from paylake.plans import registry
    laid, write = [], PeriodTable._write
    monkeypatch.setattr(PeriodTable, "_write", lambda self, rows, *order, derive=None: laid.append(rows) or write(self, rows, *order, derive=derive))
    t = D.Tables(spark, SF)
    monkeypatch.setattr(D.Tables, "stamp", lambda self, *names: "test-" + uuid.uuid4().hex)
    store = registry.stored_scored(t)
    assert not [f.name for f in laid[0].schema if f.dataType.simpleString() == "string"]
    want = D.scored_transactions(t)
    assert store.rows.read().columns == [*want.columns, "ingest_day"]
    assert sorted(map(str, store.rows.read().drop("ingest_day").collect())) == sorted(map(str, want.collect()))


def test_reports_read_one_ingestion_day(spark):
    store = ScoredStore(spark, run_dir(spark, "test-scored"))
    store.add(D.scored_transactions(D.Tables(spark, SF)), "all")
    day = str(store.rows.read().filter("ingest_day > '1998-06-10'").agg(F.min("ingest_day")).first()[0])
    assert f"EqualTo(ingest_day,{day})" in plan(store.day(day))
    rows = store.day_rows(day)
    assert {f.split("period=")[1][:10] for f in rows.inputFiles()} == {day[:7] + "-01"}
    assert rows.count() == store.day(day).agg(F.sum("n")).first()[0] > 0


def test_period_table_appends_once_and_compacts(spark):
    t = PeriodTable(spark, run_dir(spark, "test-periods"), "d")
    rows = lambda b: spark.range(60).selectExpr(f"date_add(date'2024-01-01', cast(id as int)) d", f"id + {b} v")
    for b in (0, 1, 1, 2, 3):
        t.append(rows(b), b)
    assert {p: len(f) for p, f in t.periods().items()} == {"2024-01-01": 4, "2024-02-01": 4} and t.read().count() == 240
    opened = t.read("2024-01-20", "2024-01-31")
    assert t.compact(most=2) == ["2024-01-01", "2024-02-01"] and t.compact(most=2) == []
    assert {len(f) for f in t.periods().values()} == {2} and t.read().count() == 240 and opened.count() == 48
    t.append(rows(3), 3)  # the last batch again, after the compaction
    assert t.read().count() == 240 and t.folders(t.append(rows(3), 3)).count() == 60


def test_text_index_reads_its_terms_buckets(spark):
    docs = spark.createDataFrame([(1, "The cat, the hat"), (2, "cat the THE cat"), (3, None), (4, ""), (5, "hat cat"), (5, "the end"), (None, "the cat")],
                                 "doc_id long, text string")
    index = TextIndex(spark, run_dir(spark, "test-index"), buckets=16)
    index.add(docs.filter("doc_id < 4"), 0)
    index.add(docs.filter("doc_id >= 4 or doc_id is null"), 1)
    index.add(docs.filter("doc_id >= 4"), 1)  # repeated
    ids = lambda df: sorted((r[0] or -1) for r in df.collect())
    assert ids(index.any_of(["Hat", "end"])) == [1, 5]
    assert ids(index.all_of(["cat", "the"])) == [-1, 1, 2, 5]
    assert {r.doc_id: r.n_places for r in index.phrase(["the", "cat"]).collect()} == {1: 1, 2: 1, None: 1}
    assert {r.doc_id: r.n_places for r in index.phrase(["cat"]).collect()} == {1: 1, 2: 2, 5: 1, None: 1}
    assert ids(index.phrase(["hat", "cat"])) == [5] and index.any_of(["none"]).count() == 0
    assert {r.term: (r.n_docs, r.n_places) for r in index.document_counts(["hat"]).collect()} == {"hat": (2, 2)}
    p = plan(index.postings(["cat"]))
    assert "PartitionFilters: [bucket" in p.replace("isnotnull(bucket", "bucket") and "term" in p.split("PushedFilters")[1][:120]


def test_trailing_windows_by_prefix_sums(spark):
    """Against a plain count; a key with half of the rows, ties in time, nulls, times at slice ends."""
    rnd = random.Random(1)
    base = int(dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc).timestamp())
    rows = []
    for i in range(1500):
        at = base + rnd.choice([rnd.randrange(120 * 86400), rnd.randrange(48) * 3600, rnd.randrange(300), rnd.randrange(100) * 86400 + 1])
        rows.append((i, rnd.choice(["hot", "hot", "a", "b", None]), None if i % 97 == 0 else at, None if i % 13 == 0 else rnd.randrange(100)))
    df = spark.createDataFrame(rows, "id long, k string, sec long, v long").withColumn("ts", F.timestamp_seconds("sec"))
    windows = {"1h": 3600, "24h": 86400, "7d": 604800, "30d": 2592000, "90d": 7776000}
    got = {r.id: r for r in trailing_all(df, "k", "ts", "v").collect()}
    assert len(got) == len(rows)
    for i, k, at, _ in rows:
        for n in windows.values():
            past = [] if at is None else [v for _, k2, t2, v in rows if k2 == k and t2 is not None and at - n <= t2 < at and v is not None]
            assert (got[i][f"v_count_{n}s"], got[i][f"v_sum_{n}s"]) == (len(past), float(sum(past))), (i, n)
    p = plan(trailing_all(df, "k", "ts", "v"))
    assert p.count("Expand") == 0 and p.count("rangebetween") + p.count("RangeFrame") > 0


def test_twenty_years_of_daily_rates(spark):
    start = dt.date(2000, 1, 1)
    rates = spark.range(7300).select(F.date_add(F.lit(start), F.col("id").cast("int")).alias("effective_date"), (F.col("id") / 1000 + 1).cast("decimal(18,8)").alias("r")) \
        .crossJoin(spark.createDataFrame([("EUR", 0), ("JPY", 3)], "from_currency string, skip int")) \
        .filter("skip = 0 or dayofweek(effective_date) = 2").selectExpr("from_currency", "'USD' to_currency", "r rate", "effective_date")
    days = ["1999-12-31", "2000-01-01", "2010-05-05", "2019-12-26", "2031-01-01"]
    tx = spark.createDataFrame([(c, dt.date.fromisoformat(x), "100.00") for c in ("EUR", "JPY", "USD", "XXX") for x in days],
                               "currency_code string, transaction_date date, a string").withColumn("amount", F.col("a").cast("decimal(18,2)"))
    out = to_usd(tx, rates)
    known = {}
    for r in rates.collect():
        known.setdefault(r.from_currency, []).append((r.effective_date, r.rate))
    for r in out.collect():
        past = [x for x in sorted(known.get(r.currency_code, [])) if x[0] <= r.transaction_date]
        assert r.fx_rate == (1 if r.currency_code == "USD" else past[-1][1] if past else None), r
    joins = [x for x in plan(out).split("\n") if "Join" in x and "currency_code" in x]
    assert joins and not any(">=" in x or "<=" in x for x in joins)


def test_erasure_rewrites_only_files_with_the_subjects(spark):
    root = run_dir(spark, "test-erase")
    table = SubjectTable(spark, root, "who", buckets=8)
    table.append(spark.range(2000).selectExpr("if(id % 50 = 0, NULL, id % 400) who", "id v"), cluster=True)
    table.append(spark.createDataFrame([(7, 9001), (8, 9002), (None, 9003)], "who long, v long"))
    before, rows = set(table.read().inputFiles()), table.read().count()
    gone = spark.createDataFrame([(7,), (7,), (390,), (12345,), (None,)], "who long")
    files = table.files_of(gone.filter("who is not null"))
    assert 0 < len(files) < len(before)
    proof = table.erase(gone, "r1").first()
    assert tuple(proof)[:5] == ("r1", 3, 2, 11, len(files))
    after = set(table.read().inputFiles())
    assert {f.split("/")[-1] for f in before & after} == {f.split("/")[-1] for f in before} - {f.split("/")[-1] for f in files}
    assert not any(os.path.exists(f.replace("file:", "").replace("//", "/")) for f in files)
    assert table.read().count() == rows - 11 and table.read().filter("who in (7, 390)").count() == 0
    assert table.read().filter("who is null").count() == 41
    assert tuple(table.erase(gone, "r1").first()) == tuple(proof) and table.read().count() == rows - 11  # repeated
    assert table.erase(spark.createDataFrame([(99999,)], "who long"), "r2").first().files_rewritten == 0


def scanned(df):
    """Rows that the scan gave to the filter (what row groups were not skipped)."""
    df.collect()
    node = df._jdf.queryExecution().executedPlan()
    todo, n = [node], 0
    while todo:
        x = todo.pop()
        if x.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
            todo.append(x.executedPlan())
            continue
        if x.getClass().getSimpleName().endswith("QueryStageExec"):
            todo.append(x.plan())
            continue
        if x.getClass().getSimpleName() == "FileSourceScanExec":
            n += x.metrics().apply("numOutputRows").value()
        kids = x.children()
        todo += [kids.apply(i) for i in range(kids.size())]
    return n


def test_sorted_layout_skips_row_groups(spark):
    df = spark.range(100_000).selectExpr("if(id % 100 = 0, 'failed', if(id % 50 = 1, 'disputed', 'captured')) status", "id * 7919 % 100003 k")
    path = os.path.join(run_dir(spark, "test-skip"), "t")
    write_skipping(df, path, ["status", "k"], bloom={"k": 100_000}, row_group_rows=2000)
    t = spark.read.parquet(path)
    assert t.count() == 100_000
    rare = t.filter("status in ('failed', 'disputed')")
    assert scanned(rare.select("k")) <= 0.1 * 100_000 and rare.count() == 3000
    assert scanned(t.filter("k = 4242").select("status")) <= 0.25 * 100_000  # by statistics and Bloom filters


def test_model_registry_keeps_versions_and_loses_no_race(spark):
    r = ModelRegistry(spark, run_dir(spark, "test-registry"))
    with pytest.raises(LookupError):
        r.load("m")
    r.register("m", "v1", "models/1", {"auc": 0.8})
    r.register("other", "v1", "models/o")
    seen = r.manifest.read()[0]
    r.register("m", "v2", "models/2", {"auc": 0.9}, canary_pct=10)
    with pytest.raises(LostRace):
        r.register("m", "v3", "models/3", seen=seen)
    assert r.current("m")["version"] == "v2" and r.current("other")["version"] == "v1"
    rows = {(x.name, x.version): (x.is_current, x.canary_pct, x.metrics.get("auc")) for x in r.table().collect()}
    assert rows == {("m", "v1"): (False, 5, 0.8), ("m", "v2"): (True, 10, 0.9), ("other", "v1"): (True, 5, None)}


def test_sessions_over_batches_close_once_and_a_repeated_batch_changes_nothing(spark):
    from paylake.streaming.ingest import read_events_stream
    at = lambda m: dt.datetime(2024, 1, 1) + dt.timedelta(minutes=m)
    batches = [[(1, at(0)), (1, at(20)), (2, at(0))], [(1, at(45)), (2, at(100)), (3, None)], [(1, at(80)), (2, at(95)), (1, at(300))], [(9, at(50)), (2, at(301))]]
    root = run_dir(spark, "test-sessions-batches")
    schema = "u long, ts timestamp"

    def go(out, source):
        K.run_sessions(read_events_stream(spark, source, spark.createDataFrame([], schema).schema), out, "u", "ts").awaitTermination()

    out, source = os.path.join(root, "out"), os.path.join(root, "in")
    for i, b in enumerate(batches):
        spark.createDataFrame(b, schema).coalesce(1).write.mode("append").parquet(source)
        go(out, source)
        if i == 2:
            closed = K.sessions(spark, out, "u").count()
            assert closed == 3  # user 1 until 80, user 2 at 0 and 95 to 100; the one at 300 is open
    got = sorted((r.u, (r.session_start - at(0)).seconds // 60, (r.session_end - at(0)).seconds // 60, r.n_events) for r in K.sessions(spark, out, "u", flush=True).collect())
    assert got == [(1, 0, 75, 3), (1, 300, 330, 1), (2, 0, 30, 1), (2, 95, 130, 2), (2, 301, 331, 1)]
    dead = sorted(r.raw_data[:6] for r in K.dead_letters(spark, out).collect())
    assert dead == ['{"u":1', '{"u":9']  # 80 when 100 was seen before, 50 when 300 was


def test_text_index_makes_no_row_of_a_word(spark):
    """Positions are found within each text: nothing is counted, shuffled or spilled word by word."""
    from paylake.sources.text_index import places
    docs = spark.createDataFrame([(1, "b a b A c"), (1, "b a b A c"), (1, "c"), (2, None), (3, " - "), (None, "z")], "doc_id long, text string")
    df = places(docs, "doc_id")
    assert sorted((r.doc_id or -1, r.term, r.positions) for r in df.collect()) == [
        (-1, "z", [0]), (1, "a", [1, 3]), (1, "b", [0, 2]), (1, "c", [0]), (1, "c", [4])]
    assert "collect_set" not in plan(df) and "posexplode" not in plan(df)
    index = TextIndex(spark, run_dir(spark, "test-index-words"), buckets=4)
    index.add(spark.createDataFrame([(1, "no no no"), (1, "no no"), (2, "no")], "doc_id long, text string"), 0)
    assert {r.doc_id: r.n_places for r in index.phrase(["no", "no"]).collect()} == {1: 3}
