import hashlib
import random

import pytest

from paylake.llm import decontaminate, fixity
from paylake.llm.common import Scratch

from .brute import fuzzy


def leaks():
    rng = random.Random(2)
    words = ["".join(rng.choice("abcdefghijklm") for _ in range(rng.choice([2, 4, 7]))) for _ in range(150)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    items = {i: text(rng.choice([14, 30, 60])) for i in range(12)}
    items[12] = text(300)
    docs = {}
    for i in range(120):
        t = text(rng.choice([0, 5, 60, 200]))
        if i % 3 == 0:
            p = list(items[rng.randrange(13)])
            for _ in range(rng.choice([0, 1, 4, 9, 14])):
                at = rng.randrange(len(p))
                p[at:at + rng.choice([0, 1])] = rng.choice(["", "x", "qq"])
            t = t[:rng.randrange(len(t) + 1)] + "".join(p).upper().replace(" ", " \n ") + t[-30:]
        docs[i] = t
    return docs, items


def test_matches_are_all_within_the_budget_and_none_is_missed(spark):
    docs, items = leaks()
    rows = decontaminate.find(spark.createDataFrame(list(docs.items()), "doc_id long, text string").repartition(3),
                              spark.createDataFrame(list(items.items()), "item_id long, text string")).collect()
    want = {}
    norm = {i: decontaminate.normalise(t.encode()) for i, t in docs.items()}
    for j, item in items.items():
        for p in decontaminate.segments(item.encode()):
            for i, t in norm.items():
                e = fuzzy(p, t)
                if e <= decontaminate.budget(len(p)):
                    want[i, j] = min(e, want.get((i, j), e))
    assert {(r.doc_id, r.item_id): r.edits for r in rows} == want and len(rows) == len(want) and len(want) > 25
    for r in rows:
        part = decontaminate.normalise(docs[r.doc_id].encode()[r.start:r.end])
        assert min(fuzzy(p, part) for p in decontaminate.segments(items[r.item_id].encode())) == r.edits


def test_whole_table_finds_every_item_held(spark, sf, texts):
    import __spark_entry__ as E
    got = {(r.doc_id, r.item_id) for r in E.queries()["op2_qgram_decontamination"](spark, sf).collect()}
    items = {r.item_id: decontaminate.normalise(r.text.encode()) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()}
    held = {(i, j) for i, t in texts.items() for j, p in items.items() if p in decontaminate.normalise(t.encode())}
    assert held <= got and len(got) <= len(held) + 2


def test_blocks_of_the_benchmark_give_the_same(spark, monkeypatch):
    docs, items = leaks()
    d = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    b = spark.createDataFrame(list(items.items()), "item_id long, text string")
    whole = sorted(map(tuple, decontaminate.find(d, b).collect()))
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 900)
    assert sorted(map(tuple, decontaminate.find(d, b).collect())) == whole
    left = {r.doc_id for r in decontaminate.drop_contaminated(d, b).collect()}
    assert left == set(docs) - {r[0] for r in whole}


def test_decontamination_awkward_rows(spark, odd, empty):
    b = spark.createDataFrame([(1, "A" * 90), (1, "A" * 90), (2, None), (3, ""), (None, "x y z " * 20), (4, "short"), (5, "x y z " * 500)],
                              "item_id long, text string")
    rows = decontaminate.find(odd, b).collect()
    assert {(r.doc_id, r.item_id) for r in rows} == {(6, 1), (7, 5)} and all(r.edits == 0 for r in rows)
    assert decontaminate.find(empty, b).count() == 0 and decontaminate.find(odd, b.limit(0)).count() == 0
    kept = decontaminate.drop_contaminated(odd, b)
    assert kept.columns == odd.columns and kept.count() == odd.count() - 2


def test_parts_of_items_and_short_items_are_found(spark):
    rng = random.Random(5)
    text = lambda n: " ".join("".join(rng.choice("abcdefghijklm") for _ in range(6)) for _ in range(n))
    whole, long = text(56), text(300)
    short = {3: "why is grass green?", 4: "7 x 8?", 5: "is it so", 6: "is it so?", 7: "is it so? y", 8: "\u00df?", 9: "What is the boiling point of lead?",
             10: "why is grass green?", 11: "is it so? n"}
    docs = {1: text(20) + whole[60:360] + text(20), 2: text(20) + long[630:900].upper() + text(20), 3: "x" * 50 + " Why  is\ngrass green? " + text(9),
            4: "7 x 8?", 5: "z IS it so? y", 6: text(40), 7: "is it", 8: " so?", 9: "\u00df? " + text(3) + "what is the boiling  point of lead?!",
            10: "what is the boiling point of leat?", 11: None, 12: "is it so? Z is it so? n"}
    items = {1: whole, 2: long, **short}
    d = spark.createDataFrame(list(docs.items()), "doc_id long, text string").repartition(2)
    b = spark.createDataFrame(list(items.items()), "item_id long, text string")
    rows = decontaminate.find(d, b).collect()
    got = {(r.doc_id, r.item_id) for r in rows}
    norm = {i: decontaminate.normalise((t or "").encode()) for i, t in docs.items()}
    want = {(1, 1), (2, 2)} | {(i, j) for i, t in norm.items() for j, p in short.items() if decontaminate.normalise(p.encode()) in t}
    assert got == want and len(rows) == len(want) and all(r.edits == 0 for r in rows) and (12, 11) in want and (12, 7) not in want
    for r in rows:
        part = decontaminate.normalise(docs[r.doc_id].encode()[r.start:r.end])
        assert part in [decontaminate.normalise(p) for p in decontaminate.segments(items[r.item_id].encode())]
    assert {r.doc_id for r in decontaminate.drop_contaminated(d, b).collect()} == {6, 7, 8, 10, 11}


def test_positions_follow_normalised_bytes():
    for raw in (b"", b"  ", b"a", b" a  b\n\nc ", b"\tx\t", b"ab"):
        n, at = decontaminate.normalise(raw), decontaminate.positions(raw)
        assert len(at) == len(n) + 1
        assert all(raw.lower()[p:p + 1] == n[i:i + 1] or n[i:i + 1] == b" " for i, p in enumerate(at[:-1].tolist()))


@pytest.fixture()
def pages(spark):
    rows = [(i, f"http://h{i % 3}.org/{i}", "x" * (i * 37 % 4000)) for i in range(2500)]
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def tree(spark, records):
    return fixity.build(records, Scratch(spark, "fixity-test"), "t")


def test_audit_finds_exactly_the_damage(spark, pages):
    import zlib
    got = {r.page_id: r for r in fixity.audit_pages(pages).collect()}
    assert len(got) == 2500
    bad = {i for i in got if zlib.crc32(str(i).encode()) % 97 == 0}
    assert {i for i, r in got.items() if r.status == "corrupt"} == bad and {r.status for r in got.values()} == {"ok", "corrupt"}
    rec = {r.page_id: bytes(r.record) for r in fixity.warc_records(pages).collect()}
    ends = {}
    for i in sorted(got):
        r = got[i]
        assert r.digest == hashlib.sha256(rec[i]).hexdigest() and r.offset == ends.get(r.file, 0)
        ends[r.file] = r.offset + r.length
    assert rec[5].startswith(b"WARC/1.0\r\n") and b"Content-Length: 185\r\n\r\n" in rec[5]


def test_missing_and_extra_records_and_files(spark, pages):
    records = fixity.warc_records(pages)
    a, b = records.filter("page_id <> 7 and file <> 'pages-2'"), records.filter("page_id not in (3, 1999)")
    got = {(r.file, r.offset): r.status for r in fixity.audit(tree(spark, a), tree(spark, b)).collect()}
    where = {r.page_id: (r.file, r.offset) for r in records.select("page_id", "file", "offset").collect()}
    want = {where[7]: "extra", where[3]: "missing", where[1999]: "missing"} | {where[i]: "extra" for i in range(2000, 2500)}
    assert got == want


def test_sound_replicas_have_equal_roots(spark, pages):
    records = fixity.warc_records(pages)
    a, b = tree(spark, records), tree(spark, records.repartition(7))
    assert sorted(map(tuple, a.roots.collect())) == sorted(map(tuple, b.roots.collect())) and fixity.audit(a, b).count() == 0


def test_fixity_awkward_rows(spark):
    rows = [(1, None, None), (1, None, None), (None, "u", "h"), (None, None, None), (2, "a\r\nb", "é" * 200_000), (-5, "", "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'q' file", "9 offset", "'s' status")
    got = fixity.audit_pages(pages).collect()
    assert len(got) == 6 and {r.file for r in got if r.page_id == 2} == {"pages-0"} and {r.file for r in got if r.page_id == -5} == {"pages--1"}
    assert fixity.audit_pages(pages.limit(0)).count() == 0


def test_plan_of_an_audit_holds_one_level(spark, pages):
    # the differing nodes of a level were planned anew for each tree of each level below: 521 shuffles
    records = fixity.warc_records(pages)
    plan = fixity.audit(tree(spark, records), tree(spark, fixity.damaged(records)))._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("Join") <= 3 and plan.count("Scan parquet") <= 4
