"""External induced sorting of the suffixes of a text, with common-prefix values.

Suffixes are of type L (larger than the next one) or S. The leftmost S suffixes
of each run are sorted first: their substrings get names by an induction, and
the text of names is sorted in turn. Every other suffix is then induced: going
up through the sorted suffixes, each one's predecessor of type L joins the queue
of its first symbol, going down the same for type S. A queue hands its entries
out in the order in which they came, so the queues of all symbols together are
the priority queue of the induction. They hold tuples (position, common prefix
with the entry before) and go to files past ``memory`` bytes, so a text far
larger than memory needs memory for its symbols and types only. The common
prefix of two entries is one more than the least between the entries that
induced them. All steps work on whole runs of a queue with numpy.
"""

from __future__ import annotations

import os
import tempfile

import numpy as np

NONE = np.int32(1 << 30)


class Queue:
    """First in, first out, for (position, common prefix); spills to a file of the task's own."""

    def __init__(self, store: "Store"):
        self.store, self.parts, self.file, self.spilled = store, [], None, []

    def push(self, pos: np.ndarray, lcp: np.ndarray) -> None:
        if len(pos):
            self.parts.append((pos.astype(np.int32), lcp.astype(np.int32)))
            self.store.grown(len(pos) * 8)

    def spill(self) -> None:
        if not self.parts:
            return
        if self.file is None:
            self.file = tempfile.TemporaryFile(dir=self.store.folder)  # gone with the task
        self.file.seek(0, os.SEEK_END)
        for pos, lcp in self.parts:
            self.file.write(pos.tobytes())
            self.file.write(lcp.tobytes())
            self.spilled.append(len(pos))
        self.parts = []

    def take(self):
        """The parts pushed since the last call, in order."""
        if self.spilled:
            self.file.seek(0)
            for n in self.spilled:
                yield np.frombuffer(self.file.read(4 * n), np.int32), np.frombuffer(self.file.read(4 * n), np.int32)
            self.spilled = []
            self.file.truncate(0)
            self.file.seek(0)
        parts, self.parts = self.parts, []
        for p in parts:
            self.store.held -= len(p[0]) * 8
            yield p


class Store:
    """All queues of an induction, bounded in memory."""

    def __init__(self, symbols: int, memory: int, folder: str | None = None):
        self.memory, self.held, self.folder = memory, 0, folder
        self.queues = [Queue(self) for _ in range(symbols)]

    def grown(self, n: int) -> None:
        self.held += n
        if self.held > self.memory:
            for q in self.queues:
                q.spill()
            self.held = 0

    def close(self) -> None:
        for q in self.queues:
            if q.file is not None:
                q.file.close()


def s_types(t: np.ndarray) -> np.ndarray:
    """Which suffixes are smaller than the next one; the last symbol is the unique smallest."""
    n = len(t)
    turn = np.flatnonzero(t[1:] != t[:-1])
    out = np.zeros(n, dtype=bool)
    up = t[turn + 1] > t[turn]
    out[:n - 1] = np.repeat(up, np.diff(turn, prepend=-1))
    out[n - 1] = True
    return out


def run_ends(t: np.ndarray, at: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Length of the run of equal symbols that starts at each position (``ends``: last place of every run)."""
    return ends[np.searchsorted(ends, at)] - at + 1


BLOCK = 1 << 16  # entries of a queue that are passed on at once


def blocks(pos: np.ndarray, lcp: np.ndarray):
    """Both in parts of ``BLOCK`` entries."""
    for a in range(0, len(pos), BLOCK):
        yield pos[a:a + BLOCK], lcp[a:a + BLOCK]


def joined(parts: list):
    """A queue's parts, small ones joined, in arrays of their own."""
    held, n = [], 0
    for k, p in enumerate(parts):
        held.append(p)
        n += len(p[0])
        if n >= BLOCK or k == len(parts) - 1:
            yield from blocks(np.concatenate([x[0] for x in held]), np.concatenate([x[1] for x in held]))
            held, n = [], 0


def range_least(x: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """The least of x[first] to x[last] for each pair of places, over two overlapping powers of two."""
    if not len(first):
        return x[:0]
    level = np.frexp((last - first + 1).astype(np.float64))[1] - 1
    top = int(level.max())
    table = np.empty((top + 1, len(x)), x.dtype)
    table[0] = x
    for k in range(top):
        n = len(x) - (2 << k) + 1
        np.minimum(table[k, :n], table[k, 1 << k:n + (1 << k)], out=table[k + 1, :n])
    row = level * np.int64(len(x))
    flat = table.reshape(-1)
    return np.minimum(flat[row + first], flat[row + last + 1 - (1 << level)])


class Induction:
    """One induction over ``t`` (symbols 0 to k - 1, the last one 0 and unique) from sorted seeds."""

    def __init__(self, t: np.ndarray, k: int, stype: np.ndarray, memory: int, folder: str | None = None):
        kind = np.uint8 if k < 256 else np.uint16
        self.t, self.k, self.stype, self.memory, self.folder = t.astype(kind), k, stype, memory, folder
        self.ends = np.append(np.flatnonzero(t[1:] != t[:-1]), len(t) - 1)
        self.none = np.iinfo(kind).max

    def _before(self, want_s: bool) -> np.ndarray:
        """For each suffix the first symbol of its predecessor, where that is of the wanted type."""
        wanted = self.stype[:-1] if want_s else ~self.stype[:-1]
        return np.append(self.none, np.where(wanted, self.t[:-1], self.none)).astype(self.t.dtype)

    def _pass(self, source, target: Store, before: np.ndarray, least: np.ndarray, values: bool) -> None:
        """Push the predecessors of a part of the order into their queues."""
        pos, lcp = source
        symbol = before[pos]
        at = np.flatnonzero(symbol != self.none)
        symbol = symbol[at]
        order = np.argsort(symbol, kind="stable")
        at, symbol = at[order], symbol[order]
        cut = np.flatnonzero(symbol[1:] != symbol[:-1]) + 1
        first, last = np.append(0, cut)[:len(symbol)], np.append(cut, len(symbol))[:len(symbol)]
        used = symbol[first]
        value = np.zeros(len(at), np.int32)
        if values:
            ahead = np.minimum.accumulate(lcp)
            since = at.copy()  # the entry after the one with the same symbol before
            since[1:] = at[:-1] + 1
            since[first] = at[first]
            value[:] = range_least(lcp, since, at)
            value[first] = np.minimum(ahead[at[first]], least[used])
            value += 1
            np.minimum(least, ahead[-1], out=least)
            behind = np.append(np.minimum.accumulate(lcp[::-1])[::-1], NONE)
            least[used] = behind[at[last - 1] + 1]
        pos = pos[at] - 1
        for u, s, e in zip(used.tolist(), first.tolist(), last.tolist(), strict=True):
            target.queues[u].push(pos[s:e], value[s:e])

    def run(self, seeds: list[np.ndarray], seed_lcp: list[np.ndarray], values: bool = True):
        """``seeds``: for each symbol its sorted seeds; yields (positions, lcp) of all suffixes in order, by queue.
        Without ``values`` the order alone is right."""
        k, t = self.k, self.t
        left, right = Store(k, self.memory, self.folder), Store(k, self.memory, self.folder)
        kept = Store(k, self.memory, self.folder)  # the L suffixes of each symbol, for the way down
        least = np.full(k, -1, dtype=np.int32)  # so that a queue's first entry has common prefix 0
        last_l = np.full(k, -1, dtype=np.int64)
        before = self._before(False)
        for c in range(k):
            fresh = True
            while True:
                parts = list(left.queues[c].take())
                if not parts:
                    break
                for pos, lcp in joined(parts):
                    if fresh:
                        lcp[0], fresh = 0, False
                    kept.queues[c].push(pos, lcp)
                    last_l[c] = pos[-1]
                    self._pass((pos, lcp), left, before, least, values)
            if len(seeds[c]):
                lcp = seed_lcp[c].copy()
                lcp[0] = 0 if fresh else self._meet(last_l[c], seeds[c][0])
                for part in blocks(seeds[c], lcp):
                    self._pass(part, left, before, least, values)
        least[:] = -1
        before = self._before(True)
        out = []
        for c in range(k - 1, -1, -1):
            smaller, fresh, last_s = [], True, -1
            if c == 0:
                smaller.append((np.array([len(t) - 1], np.int32), np.zeros(1, np.int32)))
            while c:
                parts = list(right.queues[c].take())
                if not parts:
                    break
                for pos, lcp in joined(parts):
                    if fresh:
                        lcp[0], fresh = 0, False
                    last_s = int(pos[-1])
                    smaller.append((pos, lcp))
                    self._pass((pos, lcp), right, before, least, values)
            s_pos, s_lcp = (np.concatenate([x[i] for x in smaller]) if smaller else np.zeros(0, np.int32) for i in (0, 1))
            held = list(kept.queues[c].take())
            l_pos, l_lcp = (np.concatenate([x[i] for x in held]) if held else np.zeros(0, np.int32) for i in (0, 1))
            # upwards, an entry's value is with the smaller one before it; downwards with the larger one
            if len(l_pos):
                down = np.append(l_lcp[1:], 0)[::-1].astype(np.int32)
                down[0] = self._meet(int(l_pos[-1]), last_s) if last_s >= 0 else 0
                for part in blocks(l_pos[::-1], down):
                    self._pass(part, right, before, least, values)
            s_up = np.append(s_lcp[1:], 0)[::-1].astype(np.int32)[:len(s_pos)]
            if len(s_pos) and len(l_pos):
                s_up[0] = self._meet(int(l_pos[-1]), int(s_pos[-1]))
            out.append((np.concatenate([l_pos, s_pos[::-1]]), np.concatenate([l_lcp.astype(np.int32), s_up])))
        for s in (left, right, kept):
            s.close()
        return out[::-1]

    def _meet(self, a: int, b: int) -> int:
        """Common prefix of an L and an S suffix with the same first symbol: the shorter of their first runs."""
        return int(run_ends(self.t, np.array([a, b]), self.ends).min())


def by_symbol(t: np.ndarray, k: int, pos: np.ndarray, lcp: np.ndarray):
    """Sorted positions cut into one array per first symbol."""
    cut = np.searchsorted(t[pos], np.arange(k + 1))
    return ([pos[a:b] for a, b in zip(cut[:-1], cut[1:], strict=True)], [lcp[a:b] for a, b in zip(cut[:-1], cut[1:], strict=True)])


def sort_names(s: np.ndarray) -> np.ndarray:
    """Order of the suffixes of a text over a large alphabet (names from 1): the sorted prefix grows threefold each
    round (twofold where three ranks don't fit into 63 bits), for suffixes that are not told apart yet."""
    n, step = len(s), 1
    rank = np.append(s, 0).astype(np.int64)  # from 1; 0 is the end
    base = int(rank.max()) + 1
    order = np.empty(n, dtype=np.int64)
    place = at = np.arange(n)  # the suffixes still together, and their places in the order
    while len(at):
        key, parts = rank[at], 3 if base ** 3 < 1 << 63 else 2
        for k in range(1, parts):
            key = key * base + rank[np.minimum(at + k * step, n)]
        by = np.argsort(key)
        key, at = key[by], at[by]
        order[place] = at
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        size = np.diff(first, append=len(at))
        rank[at] = np.repeat(place[first] + 1, size)
        together = np.repeat(size > 1, size)
        place, at = place[together], at[together]
        base, step = n + 1, step * parts
    return order


class Prefixes:
    """Hashes of all prefixes, for equality and common prefixes of substrings."""

    def __init__(self, t: np.ndarray):
        from paylake.llm.minhash import mix, powers
        self.n = len(t)
        self.up = powers(self.n + 1)[0]
        symbols = mix(np.arange(int(t.max()) + 1, dtype=np.uint64) + np.uint64(0x51ED270B)) | np.uint64(1)
        self.total = np.zeros(self.n + 1, dtype=np.uint64)
        np.cumsum(symbols[t] * self.up[:self.n], out=self.total[1:])

    def equal(self, a: np.ndarray, b: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Whether the substrings of a length at two places are equal."""
        return (self.total[a + length] - self.total[a]) * self.up[b] == (self.total[b + length] - self.total[b]) * self.up[a]

    def common(self, a: np.ndarray, b: np.ndarray, limit: int) -> np.ndarray:
        """Common prefix lengths, at most ``limit``."""
        out = np.zeros(len(a), dtype=np.int64)
        room = self.n - np.maximum(a, b)
        start_a, up_a, start_b, up_b = self.total[a], self.up[a], self.total[b], self.up[b]
        step = 1 << max(0, limit.bit_length() - 1)
        while step:
            to = out + step
            ok = to <= room
            to = np.minimum(to, room)
            ok &= (self.total[a + to] - start_a) * up_b == (self.total[b + to] - start_b) * up_a
            out += np.where(ok, step, 0)
            step >>= 1
        return np.minimum(out, limit)


SMALL_ALPHABET = 1024


def sort_suffixes(symbols: np.ndarray, limit: int, memory: int = 96 << 20, folder: str | None = None):
    """(positions, lcp) of all suffixes in order; common prefixes are right up to ``limit``.

    ``symbols``: integers from 1, under 2^31 of them; a suffix that is a prefix of another is the smaller one.
    """
    t = np.append(symbols, 0).astype(np.int32, copy=False)
    k = int(t.max()) + 1
    if k > SMALL_ALPHABET:  # the text of names of a recursion
        order = np.append(len(t) - 1, sort_names(t[:-1]))
        lcp = np.zeros(len(order), dtype=np.int32)
        return order, lcp
    stype = s_types(t)
    seeds = np.flatnonzero(stype & ~np.concatenate([[True], stype[:-1]])).astype(np.int32)
    if not len(seeds):
        seeds = np.array([len(t) - 1], np.int32)
    work = Induction(t, k, stype, memory, folder)
    # name the seeds' substrings (each up to the next seed): an induction from seeds in any order sorts them
    first = seeds[np.argsort(t[seeds], kind="stable")]
    named = np.concatenate([p for p, _ in work.run(*by_symbol(t, k, first, np.zeros(len(first), np.int32)), values=False)])
    is_seed = np.zeros(len(t), dtype=bool)
    is_seed[seeds] = True
    named = named[is_seed[named]]
    which = (np.cumsum(is_seed, dtype=np.int32) - 1)[named]
    del first, is_seed
    length = np.append(np.diff(seeds) + 1, 1)[which]
    alike = Prefixes(t).equal(named[:-1], named[1:], np.minimum(length[:-1], length[1:])) & (length[1:] == length[:-1])
    names = np.empty(len(seeds), dtype=np.int32)
    names[which] = np.append(0, np.cumsum(~alike)) + 1
    distinct = not alike.any()
    del which, length, alike
    if distinct:
        order = named
    else:
        del named
        order = seeds[sort_suffixes(names, 0, memory, folder)[0][1:]]
    del names
    lcp = np.zeros(len(order), dtype=np.int32)
    if limit:
        prefix = Prefixes(t)  # anew: the sort of the names has the memory to itself
        for i in range(1, len(order), BLOCK):
            lcp[i:i + BLOCK] = prefix.common(order[i - 1:i + BLOCK - 1][:len(order) - i], order[i:i + BLOCK], limit)
        del prefix
    parts = by_symbol(t, k, order, lcp)
    del order, lcp, t
    out = work.run(*parts)
    pos = np.concatenate([p for p, _ in out])
    lcp = np.concatenate([x for _, x in out])
    return pos, lcp
