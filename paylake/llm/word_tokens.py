"""Token ids of whole texts with the tokenizers library, each distinct word once.

A tokenizer that drops white space encodes a text as the concatenation of its
white-space-separated words, so a word is encoded by the library when a worker
first meets it and looked up from then on, once for some megabytes of text. Texts
with one of the tokenizer's added tokens, and tokenizers that keep white space,
are encoded whole.
"""

from __future__ import annotations

import codecs
import os
import re
import string
import unicodedata

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

DEFAULT_VOCABULARY = "word_bpe_49k.json"
# texts are taken together up to so many bytes
TEXT_BYTES = 8 << 20
_ENCODERS: dict[str, "WordEncoder"] = {}
# an apostrophe may belong to the letters behind it
MARKS = string.punctuation.replace("'", "").encode()
RUNS = re.compile(rb"[A-Za-z]+|[0-9]|[" + re.escape(MARKS) + rb"]+")


def vocabulary_path(name: str = DEFAULT_VOCABULARY) -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


def encoder(path: str | None = None) -> "WordEncoder":
    """The worker's encoder for a vocabulary file (kept between tasks)."""
    path = path or vocabulary_path()
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


class _Numbers(dict):
    """id -> its four bytes."""

    def __missing__(self, i: int) -> bytes:
        self[i] = b = i.to_bytes(4, "little")
        return b


class _Words(dict):
    """word (UTF-8) -> its ids as little-endian unsigned 32-bit bytes; unknown words are encoded when looked up."""

    def __init__(self, tok, lower: bool):
        self.tok, self.lower = tok, lower
        self.model = tok.model
        self.old: dict[bytes, bytes] = {}
        # the byte-level alphabet: printable bytes stand for themselves, the others for 256, 257, ...
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in set(plain)]
        alphabet = {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}
        self.alphabet = "".join([alphabet[b] for b in range(256)])
        self.numbers = _Numbers()
        # the model may be asked directly where it gives what the whole tokenizer does
        tests = ["word", "anblewh", "\u00e9cole", "stra\u00dfe", "ci\u00f3n\u00f1a"]
        self.direct = all(self._direct(t) == self._whole(t) for t in tests)
        # and a last full stop or comma looked up alone where the tokenizer always parts it from a letter
        self.stops = all(self._whole(t + c) == self._whole(t) + self._whole(c) for t in ("word", "anblewh", "a", "xqz") for c in ".,")
        # and runs of letters, digits and runs of marks, where it always parts those
        marks = MARKS.decode()
        tests = [f"{t}{c}" for t in ("word", "\u00e9cole", "7") for c in marks] + [f"word{c}{d}xqz" for c in marks for d in marks]
        tests += ["2024", "a1", "1a", "x9y", "3.14", "(7)", "--a--b", "1,000.50%", "\u00e9&&&", "word***"]
        self.parted = all(self._whole(t) == b"".join([self._whole(r.decode()) for r in self._runs(t.encode())]) for t in tests)

    def _whole(self, text: str) -> bytes:
        return np.array(self.tok.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _direct(self, text: str) -> bytes:
        if not text.isascii():
            text = codecs.charmap_decode(text.encode(), "strict", self.alphabet)[0]
        numbers = self.numbers
        return b"".join([numbers[t.id] for t in self.model.tokenize(text)])

    def _plain(self, text: str) -> str:
        return unicodedata.normalize("NFC", text.lower() if self.lower else text)

    def _letters(self, text: str, plain: str) -> bool:
        """Whether a text is letters, also for the model: lower-casing may bring marks that the tokenizer parts from letters."""
        return text.isalpha() and plain.isalpha() and max(text + plain) < "\u0250"

    def _runs(self, word: bytes) -> list[bytes]:
        """The parts of a word that are encoded by themselves; of a word with other letters than a-z only the last marks are."""
        if word.isascii():
            runs = RUNS.findall(word)
            return runs if sum(map(len, runs)) == len(word) else [word]
        head = word.rstrip(MARKS)
        text = head.decode("utf-8", "replace")
        return [head, word[len(head):]] if len(head) < len(word) and self._letters(text, self._plain(text)) else [word]

    @staticmethod
    def _small(word: bytes) -> bool:
        """Whether a word is of letters up to U+00FF that lower-casing and composition leave as they are."""
        if word.isascii():
            return word.isalpha() and word.islower()
        text = word.decode("utf-8", "replace")
        return text.isalpha() and text.islower() and max(text) < "\u0100"

    def turn_over(self) -> None:
        """Start anew, with the words met so far at hand until the next time."""
        self.old = dict(self)
        self.clear()

    def __missing__(self, word: bytes) -> bytes:
        ids = self.old.get(word)
        if ids is None:
            head = word.rstrip(MARKS)
            if len(head) == len(word):
                ids = self._direct(word.decode()) if self.direct and self._small(word) else self._new(word)
            elif self.parted and self._small(head):
                met = head in self
                ids = self[head] + self[word[len(head):]]
                if not met:  # it may never come again: kept by its parts alone
                    return ids
            else:
                ids = self._new(word)
        self[word] = ids
        return ids

    def _new(self, word: bytes) -> bytes:
        if word.isalpha() and self.direct:  # of bytes: a-z and A-Z only
            text = word.decode()
            return self._direct(text.lower() if self.lower else text)
        if self.stops and len(word) > 1 and word[-1] in b".," and 97 <= word[-2] <= 122:
            return self[word[:-1]] + self[word[-1:]]
        if self.parted and len(runs := self._runs(word)) > 1:
            return b"".join([self[r] for r in runs])
        text = word.decode("utf-8", "replace")
        plain = self._plain(text)
        if self.direct and self._letters(text, plain):
            return self._direct(plain)
        return self._whole(text)


class WordEncoder:
    """``encode(texts)``: for each UTF-8 text its ids, as little-endian unsigned 32-bit bytes.

    About ``cache_words`` words are kept, those not met for long are dropped
    (memory bound); that never changes a result.
    """

    def __init__(self, path: str, cache_words: int = 500_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.tok = Tokenizer.from_file(path)
        self.cache_words = cache_words
        self.added = [t.content.encode() for t in self.tok.get_added_tokens_decoder().values()]
        ids = lambda t: self.tok.encode(t, add_special_tokens=False).ids
        self.by_word = ids("a b\n c") == ids("a") + ids("b") + ids("c")
        self.lower = ids("ABC") == ids("abc")
        self.cache = _Words(self.tok, self.lower)

    def _whole(self, text: bytes) -> bytes:
        ids = self.tok.encode(text.decode("utf-8", "replace"), add_special_tokens=False).ids
        return np.array(ids, dtype="<u4").tobytes()

    def encode(self, texts) -> list[bytes]:
        out, at, words, size = [], [], [], 0
        for raw in texts:
            if not self.by_word or any(a in raw for a in self.added):
                out.append(self._whole(raw))
                continue
            # A-Z may be lowered first unless a combining mark follows somewhere (it could compose with the letter)
            if self.lower and b"\xcc" not in raw and b"\xcd" not in raw:
                raw = raw.lower()
            at.append(len(out))
            out.append(b"")
            words.append(raw)
            size += len(raw)
            if size > TEXT_BYTES:
                self._by_words(words, at, out)
                at, words, size = [], [], 0
        if words:
            self._by_words(words, at, out)
        return out

    def _by_words(self, texts: list[bytes], at: list[int], out: list[bytes]) -> None:
        """Put the ids of the texts into ``out``, each distinct word of theirs looked up once."""
        lists = pc.ascii_split_whitespace(pa.array(texts, pa.large_binary()).view(pa.large_string()))
        found = lists.values.dictionary_encode()
        ids = list(map(self.cache.__getitem__, found.dictionary.view(pa.large_binary()).to_numpy(zero_copy_only=False)))
        if 2 * len(self.cache) > self.cache_words:
            self.cache.turn_over()
        n = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        flat, first = np.frombuffer(b"".join(ids), "<u4"), np.cumsum(n) - n
        word = found.indices.to_numpy()
        n = n[word]
        ends = np.concatenate([[0], np.cumsum(n)])
        raw = flat[np.repeat(first[word] - ends[:-1], n) + np.arange(ends[-1])].tobytes()
        ends = (4 * ends[lists.offsets.to_numpy()]).tolist()
        for i, start, end in zip(at, ends[:-1], ends[1:], strict=True):
            out[i] = raw[start:end]


def encode_each(texts: list[bytes], path: str | None = None):
    """Yields the ids of each text in order."""
    enc, some, size = encoder(path), [], 0
    for t in texts:
        some.append(t)
        size += len(t)
        if size > TEXT_BYTES:
            yield from enc.encode(some)
            some, size = [], 0
    yield from enc.encode(some)
