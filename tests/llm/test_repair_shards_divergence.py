"""Conversation repair, sharding and source divergence against plain versions."""

import hashlib
import random
import zlib

import pytest

from paylake.llm import sharding as S
from paylake.llm import source_divergence as D
from paylake.llm import turn_repair as R

from . import brute

# --- op11: conversation repair -----------------------------------------------------------
ROLES = ["user", "assistant", "system", "tool", "u", "", "user", "assistant"]


@pytest.mark.parametrize("limit,mod", [(1 << 16, R.HASH_MOD), (8, R.HASH_MOD), (8, 7), (1 << 16, 3)])
def test_repair_is_least(limit, mod):
    """Also with nodes committed early and with hashes that collide."""
    rnd = random.Random(5)
    for _ in range(400):
        turns = [(rnd.choice(ROLES), rnd.choice("abc"), rnd.random() < .2, False) for _ in range(rnd.choice([0, 1, 2, 3, 5, 8, 13, 40]))]
        turns = [(a, b, x, not x and rnd.random() < .3) for a, b, x, _ in turns]
        r = R.Repair(limit, mod)
        for role, text, x, cut in turns:
            r.turn(role, role[:1], text.encode(), x, cut)
        assert r.result()[:3] == brute.repair(turns)


def test_long_conversation_is_committed():
    rnd, r = random.Random(1), R.Repair(1 << 12)
    for _ in range(30_000):
        role = rnd.choice(["user", "assistant", "tool"])
        r.turn(role, role[0], b"some words.", rnd.random() < .1, False)
    assert len(r.edits) < 1 << 13 and len(r.result()[1]) >= 30_000


def faults(rows):
    """Faults, illegal pairs, gaps and the brute repair of one conversation's (turn, role, text)."""
    rows = sorted(((t is not None, t or 0, r, x) for t, r, x in rows))
    seen, turns, kinds = set(), [], {"b": 0, "d": 0, "t": 0, "": 0}
    for _, _, role, text in rows:
        body = text.rstrip(R.SPACE)
        k = "b" if not body else "d" if (role, text) in seen else "t" if body[-1] not in ".!?" else ""
        seen.add((role, text))
        kinds[k] += 1
        turns.append((role, text, k in ("b", "d"), k == "t"))
    known = [t for ok, t, _, _ in rows if ok]
    gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
    illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:], strict=False))
    return (gaps, kinds["b"], kinds["d"], kinds["t"], illegal, *brute.repair(turns))


def damaged(rows):
    out = {}
    for conv, turn, role, text in rows:
        code = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if code == 1 else "".join(c for c in text if c not in ".!?") if code == 2 else text
        out.setdefault(conv, [])
        out[conv] += [(turn, "user" if code == 4 else role, text)] * (0 if code == 0 else 2 if code == 3 else 1)
    return out


def conversations(spark):
    rnd = random.Random(3)
    rows = [(rnd.choice([*range(150), None]), rnd.choice([*range(12), None, -3]), rnd.choice([*ROLES, None]),
             rnd.choice(["Hi.", "Hi.", "so it is", "", " \n\t", None, "Ö!\n", "a b?" * 5000, "x.y"])) for _ in range(1500)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    return rows, df.selectExpr("*", "1 again", "2 blank", "'x' code", "3 audit", "4 cut", "5 cost")


def test_repair_of_a_table(spark):
    rows, df = conversations(spark)
    got = {r[0]: tuple(r)[1:9] for r in R.repair(R.damage(df)).collect()}
    assert got == {c: faults(v) for c, v in damaged(rows).items()}


def test_repaired_turns_have_the_digest(spark):
    rows, df = conversations(spark)
    turns = R.damage(df)
    audits = R.repair(turns)
    text = {}
    for c, p, role, t in R.repaired_turns(turns, audits).collect():
        text.setdefault(c, {})[p] = f"{role}:{t}"
    for r in audits.collect():
        lines = text.get(r["conv_id"], {})
        assert sorted(lines) == list(range(len(lines)))
        assert hashlib.sha256("\n".join(lines[k] for k in sorted(lines)).encode()).hexdigest() == r["repaired_sha256"]


def test_one_conversation_holds_most_rows(spark):
    df = spark.range(30_000).selectExpr("if(id % 100 = 0, id, 7L) conv_id", "id div 2 turn", "if(id % 3 = 0, 'user', 'assistant') role",
                                        "concat('word ', id % 4000, '.') text")
    got = {r["conv_id"]: r for r in R.repair(df).collect()}
    assert len(got) == 301 and got[7]["duplicate"] > 15_000
    rows = [(i // 2, "user" if i % 3 == 0 else "assistant", f"word {i % 4000}.") for i in range(30_000) if i % 100]
    assert tuple(got[7])[1:6] == faults(rows[:1] + rows[1:])[:5]


def test_no_conversations(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert R.repair(R.damage(df)).collect() == []


# --- op12: shards ------------------------------------------------------------------------
def test_room_tree():
    rnd, tree, ref = random.Random(1), S.RoomTree(), []
    for _ in range(5000):
        size = rnd.randint(1, 300)
        if ref and rnd.random() < .5:
            room = tree.tightest(size)
            assert room == min((r for r in ref if r >= size), default=None)
            if room:
                tree.take(room)
                ref.remove(room)
        else:
            tree.add(size, 0)
            ref.append(size)

    def depth(n):
        return 0 if n is None else 1 + max(depth(n.left), depth(n.right))
    assert depth(tree.root) <= 2 * len(set(ref)).bit_length()


def test_runs_equal_one_by_one():
    rnd = random.Random(2)
    for _ in range(100):
        capacity = rnd.randint(50, 400)
        sizes = [rnd.randint(1, 50) for _ in range(rnd.randint(0, 200))]
        counts = sorted(((s, sizes.count(s)) for s in set(sizes)), reverse=True)
        loads = {}
        for s, _, n, b in S.pack(counts, capacity):
            loads[b] = loads.get(b, 0) + s * n
        assert sorted(loads.values()) == sorted(brute.best_fit_plan(sizes, capacity))


def test_plan_places_every_group_once():
    rnd = random.Random(3)
    for big in ([], [10**6], [10**6, 10**6, 7 * 10**5]):
        sizes = [S.plan_size(int(rnd.lognormvariate(7, 1)) + 16) for _ in range(5000)] + [S.plan_size(b) for b in big]
        counts = sorted(((s, sizes.count(s)) for s in set(sizes)), reverse=True)
        loads, ranks = {}, {}
        for s, r, n, b in S.plan_shards(counts, 40):
            loads[b] = loads.get(b, 0) + s * n
            ranks.setdefault(s, []).extend(range(r, r + n))
        assert all(sorted(ranks[s]) == list(range(n)) for s, n in counts) and sum(loads.values()) == sum(sizes)
        rest = sorted(loads.values())[:40 - len(big)]
        assert len(loads) == 40 and rest[-1] - rest[0] <= 0.01 * rest[-1]


def test_plan_size():
    for n in [*range(1, 40_000, 7), 10**9 + 1, 2**40 - 1]:
        assert n <= S.plan_size(n) <= n * (1 + 2.0 ** (1 - S.SIGNIFICANT_BITS)) + 1


def check_shards(rows, docs, shards):
    """Sizes, checksums, gapless slots, whole groups, near equal sizes."""
    assert len(rows) == len(docs)
    want = sorted((str(i), len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in docs)
    assert sorted((str(r["doc_id"]), r["size"], r["text_crc32"]) for r in rows) == want
    loads, slots, where = dict.fromkeys(range(shards), 0), {}, {}
    for r in rows:
        loads[r["shard"]] += r["size"]
        slots.setdefault(r["shard"], []).append(r["slot"])
        assert where.setdefault((r["size"], r["text_crc32"]), r["shard"]) == r["shard"]
    assert all(sorted(v) == list(range(len(v))) for v in slots.values()) and set(loads) == set(range(shards))
    return loads


def test_shards_of_documents(spark, sf, monkeypatch):
    monkeypatch.setattr(S, "ROWS_PER_WINDOW", 30)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = S.by_bytes(docs).collect()
    loads = check_shards(rows, [(r[0], r[1]) for r in docs.select("doc_id", "text").collect()], 40)
    groups = {}
    for r in rows:
        groups[r["text_crc32"]] = groups.get(r["text_crc32"], 0) + r["size"]
        assert r["law"] == "bytes" and r["grown_shard"] is None
    # no shard is fuller than the least bound but for one small group
    assert max(loads.values()) <= max(max(groups.values()), sum(loads.values()) // 40 * 1.2)


def test_hot_text_null_ids_and_clashing_columns(spark, monkeypatch):
    monkeypatch.setattr(S, "ROWS_PER_WINDOW", 100)
    df = spark.range(3000).selectExpr(
        "if(id % 3 = 0, NULL, id) doc_id", "case id % 3 when 0 then 'the same text' when 1 then concat('text ', id) else if(id % 2 = 0, '', NULL) end text",
        "1 _size", "2 _row", "3 shard", "4 slot", "5 _group")
    rows = S.assign(df, 7).collect()
    check_shards(rows, [(r[0], r[1]) for r in df.select("doc_id", "text").collect()], 7)


def test_fixed_capacity_written_and_read(spark, odd, empty, tmp_path):
    got = S.assign(odd, capacity=60_100, with_text=True)
    S.write_shards(got, str(tmp_path / "shards"))
    back = spark.read.parquet(str(tmp_path / "shards"))
    assert sorted(map(str, back.select(got.columns).collect())) == sorted(map(str, got.collect()))
    assert back.groupBy("shard").sum("size").agg({"sum(size)": "max"}).first()[0] <= 60_100
    with pytest.raises(ValueError):
        S.assign(odd, capacity=100)
    assert S.by_bytes(empty).collect() == []


# --- op13: source divergence -------------------------------------------------------------
def test_divergence_of_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert {tuple(r) for r in D.audit(docs).collect()} == brute.divergence(docs.select("text", "lang", "source").collect())


def test_divergence_of_awkward_rows(spark, odd, empty, monkeypatch):
    monkeypatch.setattr(D, "HELD", 20)
    monkeypatch.setattr(D, "CHUNK", 16)
    rnd = random.Random(4)
    rows = [(" ".join(rnd.choice(["Ab", "ab", "É", "x1y", "the", "of", "日本", "z" * 3000]) for _ in range(rnd.randint(0, 9))),
             rnd.choice(["en", "de", None, ""]), rnd.choice(["a", "b", "c", None, "é"])) for _ in range(300)]
    rows += [(None, "xx", "a"), ("only once", "xx", "b"), ("", "yy", "a")]
    df = spark.createDataFrame(rows, "text string, lang string, source string").selectExpr("*", "1 n", "2 v", "3 base", "'q' term", "4 rank")
    assert {tuple(r) for r in D.audit(df, top=3).collect()} == brute.divergence(rows, top=3)
    assert {tuple(r) for r in D.audit(odd).collect()} == brute.divergence(odd.select("text", "lang", "source").collect())
    assert D.audit(empty).collect() == []


def test_vectors_sum_to_the_counts(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    counts = D.count_terms(docs)
    vocab = D.vocabulary(counts)
    sums = D.vectors(docs, vocab).selectExpr("lang", "explode(terms) as (term, n)").groupBy("lang", "term").sum("n")
    assert sorted(map(tuple, sums.collect())) == sorted(map(tuple, vocab.select("lang", "term", "total").collect()))
