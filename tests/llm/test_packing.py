import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from paylake.llm import packing, token_orc
from paylake.llm.common import Scratch
from paylake.llm.word_tokens import WordEncoder, encoder, vocabulary_path

from .brute import best_fit_decreasing


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(vocabulary_path())


@pytest.mark.parametrize("seed", range(6))
def test_plan_is_best_fit_decreasing(seed):
    rng = random.Random(seed)
    capacity = rng.choice([10, 64, 200])
    lengths = [min(capacity, 1 + int(rng.expovariate(4 / capacity))) for _ in range(rng.choice([1, 50, 800]))]
    counts = Counter(lengths)
    used = defaultdict(list)
    for (length, rank, first, each, offset), after in zip(
            (p := packing.plan_bins(counts, capacity)).tolist(), [*p.tolist()[1:], None], strict=True):
        last = after[1] if after and after[0] == length else counts[length]
        for r in range(rank, last):
            used[first + (r - rank) // each].append((offset + (r - rank) % each * length, length))
    n, room = best_fit_decreasing(lengths, capacity)
    assert len(used) == n and sum(map(len, used.values())) == len(lengths)
    left = []
    for bin_ in used.values():
        at = 0
        for offset, length in sorted(bin_):
            assert offset == at
            at += length
        left.append(capacity - at)
    assert sorted(left) == room


def test_word_encoder_equals_the_library(tokenizer, texts):
    odd = ["", " ", "A <|startoftext|> b", "Don't I\u0301.. x,y. , .a. it's 3. \u00c9COLE stra\u00dfe", "\u0130\u1e9e \u03a3\u03a3 a\u2003b", "\x1c a\x85b"]
    for t in [*odd, *list(texts.values())[:80]]:
        got = np.frombuffer(encoder().encode([t.encode()])[0], "<u4").tolist()
        assert got == tokenizer.encode(t, add_special_tokens=False).ids, t


def test_every_code_point_equals_the_library(tokenizer):
    points = [c for c in range(1, 0x110000) if not 0xD800 <= c < 0xE000]
    for at in range(0, len(points), 4000):
        text = " ".join(f"{chr(c)} a{chr(c)}b {chr(c)}x." for c in points[at:at + 4000])
        want = np.array(tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()
        assert encoder().encode([text.encode()])[0] == want, hex(points[at])


def test_letters_digits_and_marks_are_looked_up_by_themselves(tokenizer, monkeypatch):
    enc, rng = WordEncoder(vocabulary_path()), random.Random(9)
    whole, asked = type(enc.cache)._whole, []
    monkeypatch.setattr(type(enc.cache), "_whole", lambda self, text: asked.append(text) or whole(self, text))
    # each of these words was given to the whole tokenizer
    enc.encode([" ".join(f"w{'abcdefghij'[i % 10]}{i}&&& caf\u00e9{'abc'[i % 3] * (i % 40)}.*** (x{i},z)" for i in range(500)).encode()])
    assert len(asked) < 30, asked[:40]
    parts = ["don", "'s", "'", "7", "42", "&&&", ".", ",", "-", "(", ")", "_", "\u00e9", "\u00df", "\u0130", "\u0307", "\u03a3", "\u4e2d", "\u00b2",
             "\u0338", "\x01", "\x7f", "\u00a0", "A", "Zz", "<", "=", ">", "\u1e9e", "\ud55c", "\u01c5", "\u2019"]
    for _ in range(20000):
        word = "".join(rng.choices(parts, k=rng.randint(1, 6)))
        want = np.array(tokenizer.encode(word, add_special_tokens=False).ids, dtype="<u4").tobytes()
        assert enc.encode([word.encode()])[0] == want, ascii(word)
    points = list(range(128, 0x2400))
    for at in range(0, len(points), 4000):
        text = " ".join(f"{chr(c)}.&& a{chr(c)}, =1{chr(c)}" for c in points[at:at + 4000])
        want = np.array(tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()
        assert enc.encode([text.encode()])[0] == want, hex(points[at])


def test_words_are_looked_up_once_for_some_megabytes(tokenizer, texts, monkeypatch):
    from paylake.llm import word_tokens
    enc, asked = WordEncoder(vocabulary_path()), []
    words = enc.cache

    class Asked(dict):
        def __getitem__(self, word):
            asked.append(word)
            return words[word]

    enc.cache = Asked()
    odd = ["", " ", "A <|startoftext|> b", "\x1c a\x85b", "\t a \n\x0b\x0c\rb. ", "a\u0301 A\u0301", "caf\u00e9.\" caf\u00e9. &. '&", "\u00aa \u00b5 \u00df7"]
    rows = [t.encode() for t in [*odd, *list(texts.values())[:40]] * 3] + [b"\xff\xfe a. \xc3", b"\x00 a\x00"]
    want = [np.array(tokenizer.encode(t.decode("utf-8", "replace"), add_special_tokens=False).ids, dtype="<u4").tobytes() for t in rows]
    assert enc.encode(rows) == want
    assert len(asked) == len(set(asked))
    monkeypatch.setattr(word_tokens, "TEXT_BYTES", 100)
    assert WordEncoder(vocabulary_path(), cache_words=50).encode(rows) == want == list(word_tokens.encode_each(rows))
    assert enc.encode([]) == []


def expected_pieces(rows, tokenizer, end):
    for doc_id, text in rows:
        yield doc_id, [*tokenizer.encode(text or "", add_special_tokens=False).ids, end]


def crc(ids):
    return zlib.crc32(np.array(ids, dtype="<u4").tobytes())


def test_pack_whole_table(spark, sf, tokenizer, texts):
    import __spark_entry__ as E
    got = E.queries()["op1_best_fit_packing"](spark, sf).collect()
    want = {}
    for doc_id, ids in expected_pieces(texts.items(), tokenizer, 1):
        for k in range(0, len(ids), 4096):
            want[doc_id, k // 4096] = (k, len(ids[k:k + 4096]), crc(ids[k:k + 4096]))
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in got} == want and len(got) == len(want)
    check_places(got, 4096)
    assert len({r.sequence_id for r in got}) == best_fit_decreasing([w[1] for w in want.values()], 4096)[0]


def check_places(rows, capacity):
    at = defaultdict(list)
    for r in rows:
        at[r.sequence_id].append((r.offset, r.length))
    for x in at.values():
        end = 0
        for offset, length in sorted(x):
            assert offset == end
            end += length
        assert end <= capacity


def test_pack_awkward_rows(spark, odd, empty, tokenizer):
    got = packing.pack(odd).collect()
    check_places(got, 4096)
    assert sorted((r.doc_id is not None, r.doc_id or 0, r.piece) for r in got) == sorted(
        (i is not None, i or 0, k // 4096)
        for i, ids in expected_pieces([(r.doc_id, r.text) for r in odd.collect()], tokenizer, 1) for k in range(0, len(ids), 4096))
    assert packing.pack(empty).count() == 0


def test_sequences_hold_the_ids(spark, odd, tokenizer):
    docs = odd.filter("doc_id in (2, 4, 7)")
    placed = packing.pack(docs, capacity=64)
    rows = {r.sequence_id: r.ids for r in packing.sequences(placed, packing.cut_pieces(docs, 64, with_ids=True)).collect()}
    for r in placed.collect():
        assert crc(rows[r.sequence_id][r.offset:r.offset + r.length]) == r.ids_crc32


def test_small_windows_give_the_same_sequences(spark, sf, monkeypatch):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    a = packing.pack(docs).agg({"sequence_id": "max"}).first()[0]
    monkeypatch.setattr(packing, "ROWS_PER_WINDOW", 7)
    b = packing.pack(docs).collect()
    check_places(b, 4096)
    assert max(r.sequence_id for r in b) == a


def test_orc_round_trip(spark, sf, tokenizer, texts):
    import __spark_entry__ as E
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in E.queries()["op9_token_orc"](spark, sf).collect()}
    at, want = 0, {}
    for doc_id, ids in expected_pieces(sorted(texts.items()), tokenizer, 2):
        want[doc_id] = (at, len(ids), crc(ids))
        at += len(ids)
    assert got == want


def test_orc_awkward_rows_and_pruning(spark, odd, empty):
    path = Scratch(spark, "orc-test").path("ids")
    token_orc.write_ids(odd, path)
    rows = token_orc.digests(token_orc.read_ids(spark, path)).collect()
    assert len(rows) == odd.count()
    assert sorted(r.start for r in rows)[0] == 0 and sum(r.n_tokens for r in rows) == max(r.start + r.n_tokens for r in rows)
    one = token_orc.read_ids(spark, path).filter("doc_id = 4")
    assert one.count() == 1 and "EqualTo(doc_id,4)" in one._jdf.queryExecution().toString()
    other = Scratch(spark, "orc-test").path("none")
    token_orc.write_ids(empty, other)
    assert token_orc.digests(token_orc.read_ids(spark, other)).count() == 0
