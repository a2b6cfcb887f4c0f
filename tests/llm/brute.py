"""Plain versions of the operators, for small inputs."""

import hashlib
import re
from collections import defaultdict


def groups(pairs, nodes):
    parent = {n: n for n in nodes}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = top(a), top(b)
        parent[max(a, b)] = min(a, b)
    return {n: top(n) for n in nodes}


def shingles(text):
    w = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    if len(w) < 5:
        return frozenset([tuple(w)]) if w else frozenset()
    return frozenset(tuple(w[k:k + 5]) for k in range(len(w) - 4))


def near_duplicates(texts, percent):
    """doc_id -> (set size, component)."""
    sets = {i: shingles(t) for i, t in texts.items()}
    by = defaultdict(set)
    for i, s in sets.items():
        for x in s:
            by[x].add(i)
    pairs = set()
    for i, s in sets.items():
        for j in set().union(*(by[x] for x in s)) if s else ():
            both = len(s & sets[j])
            if i < j and 100 * both >= percent * (len(s) + len(sets[j]) - both):
                pairs.add((i, j))
    comp = groups(pairs, texts)
    return {i: (len(sets[i]), comp[i]) for i in texts}


def repeated(docs, length=100):
    """doc_id -> (bytes, removed, runs, sha256 of the rest)."""
    seen, out = set(), {}
    for i, raw in sorted(docs.items()):
        gone = bytearray(len(raw))
        for p in range(len(raw) - length + 1):
            w = raw[p:p + length]
            if w in seen:
                gone[p:p + length] = b"\1" * length
            seen.add(w)
        rest = bytes(c for c, g in zip(raw, gone) if not g)
        runs = sum(1 for k, g in enumerate(gone) if g and (k == 0 or not gone[k - 1]))
        out[i] = (len(raw), sum(gone), runs, hashlib.sha256(rest).hexdigest())
    return out


def fuzzy(pattern, text):
    """The fewest edits between the pattern and any stretch of the text."""
    row = [0] * (len(text) + 1)
    for i, p in enumerate(pattern, 1):
        new = [i]
        for j, t in enumerate(text, 1):
            new.append(min(row[j - 1] + (p != t), row[j] + 1, new[j - 1] + 1))
        row = new
    return min(row)


def best_fit_decreasing(lengths, capacity):
    """The number of bins when each length, longest first, goes to the fullest bin that has room."""
    room = []
    for n in sorted(lengths, reverse=True):
        fit = [r for r in room if r >= n]
        if fit:
            room.remove(min(fit))
            room.append(min(fit) - n)
        else:
            room.append(capacity - n)
    return len(room), sorted(room)


def repair(turns):
    """Least (cost, edits) and the repaired text's digest over turns (role, text, unusable, truncated)."""
    def close(states):
        grown = True
        while grown:
            grown = False
            for s, to, line in (("n", "u", "user:"), ("s", "u", "user:"), ("a", "u", "user:"), ("u", "a", "assistant:")):
                if s in states:
                    new = (states[s][0] + 3, states[s][1] + "I", states[s][2] + [line])
                    if to not in states or new[:2] < states[to][:2]:
                        states[to], grown = new, True
        return states

    states = close({"n": (0, "", [])})
    for role, text, unusable, cut in turns:
        new = {}

        def put(to, cost, edits, lines):
            if to not in new or (cost, edits) < new[to][:2]:
                new[to] = (cost, edits, lines)

        for s, (cost, edits, lines) in states.items():
            put(s, cost + 4, edits + "D", lines)
            if unusable:
                continue
            dear = cost + 3 * cut
            if role[:1] == "s" and s == "n":
                put("s", dear, edits + "K", [*lines, f"{role}:{text}"])
            to, as_role = ("a", "assistant") if s == "u" else ("u", "user")
            if role[:1] == to:
                put(to, dear, edits + "K", [*lines, f"{role}:{text}"])
            put(to, dear + 3, edits + "R", [*lines, f"{as_role}:{text}"])
        states = close(new)
    cost, edits, lines = min((states[k] for k in "na" if k in states), key=lambda z: z[:2])
    return cost, edits, hashlib.sha256("\n".join(lines).encode()).hexdigest()


def best_fit_plan(sizes, capacity):
    """Loads of the shards when each size, largest first, goes where the least room is left that holds it."""
    loads = []
    for n in sorted(sizes, reverse=True):
        fit = [k for k, used in enumerate(loads) if capacity - used >= n]
        if fit:
            loads[max(fit, key=lambda k: loads[k])] += n
        else:
            loads.append(n)
    return loads


def divergence(docs, min_df=3, top=200):
    """{(lang, source, part, item, value, rank)} over docs (text, lang, source)."""
    docs = [(t or "", la or "", s or "") for t, la, s in docs]
    out = set()
    for lang in {d[1] for d in docs}:
        df, total, by = defaultdict(int), defaultdict(int), defaultdict(lambda: defaultdict(int))
        for text, la, source in docs:
            if la == lang:
                found = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text)
                found = ["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in w) for w in found]
                by[source]
                for w in set(found):
                    df[w] += 1
                for w in found:
                    total[w] += 1
                    by[source][w] += 1
        kept = [w for w in df if df[w] >= min_df]
        n = {s: sum(c[w] for w in kept) for s, c in by.items()}
        whole = sum(total[w] for w in kept)
        p = {s: {w: 1 + 10**9 * (c[w] + 1) // (n[s] + len(kept)) for w in kept} for s, c in by.items()}
        q = {w: 1 + 10**9 * (total[w] + 1) // (whole + len(kept)) for w in kept}
        f = lambda a, b: (a - b) * (a - b) // b
        for s in by:
            pair = [(o, sum(f(p[s][w], p[o][w]) for w in kept)) for o in by if o != s]
            term = [(w, f(p[s][w], q[w])) for w in kept if by[s][w] > 0 and p[s][w] > q[w]]
            for part, rows, most in (("pair", pair, None), ("term", term, top)):
                rows.sort(key=lambda r: (-r[1], r[0].encode()))
                out |= {(lang, s, part, item, v, k) for k, (item, v) in enumerate(rows[:most], 1)}
    return out
