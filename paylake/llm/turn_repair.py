"""Least-cost repair of conversation structure, with an audit of the edits.

The turns of a conversation stream through a dynamic program in order. It has
four states, by what the repaired conversation ends with: nothing, a system
turn, a user turn, an assistant turn. A state holds its cost, the edits that
lead to it and a running SHA-256 of the repaired text, so no text is kept.
Edit strings are persistent: a node per prefix, shared by all strings that
begin with it, with binary-lifting ancestors and a rolling hash. Of two edit
strings of one cost the least wins; they are compared by searching their
longest common prefix over the hashes, and the node found is verified by
identity (equal strings are one node, because an edit string fixes how many
turns it consumed and the state it leads to). When nodes grow many, what all
states share is moved into plain bytes and dead branches are dropped.

One shuffle by conversation; duplicates and the order come from sorts that
spill. A conversation's digest runs over its text in order, so one task reads
a conversation, however long, but holds only its edits.
"""

from __future__ import annotations

import hashlib
from array import array

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from paylake.llm.common import ship, tidy

SPACE = " \t\n\v\f\r"
KEEP, REROLE, DELETE, INSERT = b"KRDI"
REROLE_COST, DELETE_COST, INSERT_COST, TRUNCATED_COST = 3, 4, 3, 3
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
FOLLOWS = {"su", "ua", "au"}
HASH_BASE, HASH_MOD = 1_000_003, (1 << 61) - 1
NODES_BEFORE_COMMIT = 1 << 16


class Edits:
    """Strings of edits as linked nodes; node 0 is the empty string (or what ``done`` holds)."""

    def __init__(self, mod: int = HASH_MOD):
        self.mod = mod
        self.edit, self.hash = bytearray(1), [0]
        self.depth, self.first = array("q", [0]), array("q", [0, 0])
        self.ups = array("q")  # ancestors at distance 1, 2, 4, ... of each node, from first[node] on
        self.done = bytearray()

    def __len__(self) -> int:
        return len(self.edit)

    def add(self, parent: int, edit: int) -> int:
        node, ups, first = len(self.edit), self.ups, self.first
        at, k = parent, 0
        while True:
            ups.append(at)
            if k >= first[at + 1] - first[at]:
                break
            at, k = ups[first[at] + k], k + 1
        self.first.append(len(ups))
        self.edit.append(edit)
        self.hash.append((self.hash[parent] * HASH_BASE + edit) % self.mod)
        self.depth.append(self.depth[parent] + 1)
        return node

    def lift(self, node: int, by: int) -> int:
        k = 0
        while by:
            if by & 1:
                node = self.ups[self.first[node] + k]
            by, k = by >> 1, k + 1
        return node

    def _fork(self, a: int, b: int, same) -> tuple[int, int]:
        """The children, on the way to two nodes of one depth, of their deepest common prefix."""
        for k in reversed(range(self.first[a + 1] - self.first[a])):
            if k < self.first[a + 1] - self.first[a]:
                p, q = self.ups[self.first[a] + k], self.ups[self.first[b] + k]
                if not same(p, q):
                    a, b = p, q
        return a, b

    def precedes(self, a: int, x: int, b: int, y: int) -> bool:
        """Whether the string of node a and then edit x is less than that of b and then y."""
        da, db = self.depth[a], self.depth[b]
        short = min(da, db)
        p, q = self.lift(a, da - short), self.lift(b, db - short)
        if p == q:
            if da == db:
                return x < y
            nx = x if da == short else self.edit[self.lift(a, da - short - 1)]
            ny = y if db == short else self.edit[self.lift(b, db - short - 1)]
            return nx < ny if nx != ny else da < db
        c, d = self._fork(p, q, lambda i, j: self.hash[i] == self.hash[j])
        if self.ups[self.first[c]] != self.ups[self.first[d]]:  # the hashes of two different prefixes collide
            c, d = self._fork(p, q, lambda i, j: i == j)
        return self.edit[c] < self.edit[d]

    def text(self, node: int, below: int = 0) -> bytes:
        out = bytearray()
        while node != below:
            out.append(self.edit[node])
            node = self.ups[self.first[node]]
        out.reverse()
        return bytes(out)

    def string(self, node: int) -> str:
        return (self.done + self.text(node)).decode()

    def commit(self, heads: list[int]) -> tuple[Edits, list[int]]:
        """Only what leads to ``heads``, their common prefix as bytes; and the new numbers of the heads."""
        top = heads[0]
        for h in heads[1:]:
            d = min(self.depth[top], self.depth[h])
            p, q = self.lift(top, self.depth[top] - d), self.lift(h, self.depth[h] - d)
            top = p if p == q else self.ups[self.first[self._fork(p, q, lambda i, j: i == j)[0]]]
        out, number = Edits(self.mod), {top: 0}
        out.done, out.hash[0] = self.done + self.text(top), self.hash[top]
        for h in heads:
            way = []
            while h not in number:
                way.append(h)
                h = self.ups[self.first[h]]
            for n in reversed(way):
                number[n] = out.add(number[self.ups[self.first[n]]], self.edit[n])
        return out, [number[h] for h in heads]


def _moves(initial: str, unusable: bool, extra: int) -> list[list[tuple[int, int, int]]]:
    """For each state: the (state before, edit, cost) that a turn offers."""
    to = [[(s, DELETE, DELETE_COST)] for s in range(4)]
    if not unusable:
        if initial == "s":
            to[SYSTEM].append((NOTHING, KEEP, extra))
        edit, cost = (KEEP, extra) if initial == "u" else (REROLE, REROLE_COST + extra)
        to[USER] += [(s, edit, cost) for s in (NOTHING, SYSTEM, ASSISTANT)]
        edit, cost = (KEEP, extra) if initial == "a" else (REROLE, REROLE_COST + extra)
        to[ASSISTANT].append((USER, edit, cost))
    return to


MOVES = {(i, x, e): _moves(i, x, e) for i in ("s", "u", "a", "") for x in (False, True) for e in (0, TRUNCATED_COST)}
INSERTS = [(USER, (NOTHING, SYSTEM, ASSISTANT), b"user:"), (ASSISTANT, (USER,), b"assistant:")]


class Repair:
    """The program over one conversation: ``turn`` for each of its turns, then ``result``."""

    def __init__(self, nodes_before_commit: int = NODES_BEFORE_COMMIT, mod: int = HASH_MOD):
        self.limit = nodes_before_commit
        self.edits = Edits(mod)
        self.at: list[tuple | None] = [(0, 0, hashlib.sha256(), False), None, None, None]  # cost, node, digest, system
        self._insert()

    def _best(self, options, states):
        best = None
        for s, edit, cost in options:
            if (old := states[s]) is None:
                continue
            cost += old[0]
            if best is None or cost < best[0] or cost == best[0] and self.edits.precedes(old[1], edit, states[best[1]][1], best[2]):
                best = cost, s, edit
        return best

    def _take(self, best, states, line: bytes, system: bool = False):
        cost, s, edit = best
        _, node, digest, had = states[s]
        node = self.edits.add(node, edit)
        if edit != DELETE:
            digest = digest.copy()
            digest.update(line if s == NOTHING else b"\n" + line)
        return cost, node, digest, had or system

    def _insert(self) -> None:
        for to, before, line in INSERTS:
            options = [(s, INSERT, INSERT_COST) for s in before]
            best, old = self._best(options, self.at), self.at[to]
            if best and (old is None or best[0] < old[0] or best[0] == old[0] and not self._older(old, best)):
                self.at[to] = self._take(best, self.at, line)

    def _older(self, old, best) -> bool:
        """Whether a state's own string is less than that of an insert (of the same cost)."""
        node = old[1]
        return self.edits.precedes(self.edits.ups[self.edits.first[node]], self.edits.edit[node], self.at[best[1]][1], best[2])

    def turn(self, role: str, initial: str, text: bytes, unusable: bool, truncated: bool) -> None:
        before, after = self.at, []
        for to, options in enumerate(MOVES[initial if initial in ("s", "u", "a") else "", unusable, TRUNCATED_COST * truncated]):
            best = self._best(options, before)
            if best is None:
                after.append(None)
                continue
            as_role = role.encode() if best[2] == KEEP else (b"", b"", b"user", b"assistant")[to]
            after.append(self._take(best, before, as_role + b":" + text, to == SYSTEM))
        self.at = after
        self._insert()
        # dearer than the assistant's state by more than what that state needs to do the same: never cheapest again
        limit = self.at[ASSISTANT][0]
        if self.at[SYSTEM] and self.at[SYSTEM][0] > limit:
            self.at[SYSTEM] = None
        if self.at[NOTHING] and self.at[NOTHING][0] > limit + DELETE_COST:
            self.at[NOTHING] = None
        if len(self.edits) > self.limit:
            live = [s for s in range(4) if self.at[s]]
            self.edits, nodes = self.edits.commit([self.at[s][1] for s in live])
            for s, n in zip(live, nodes, strict=True):
                self.at[s] = (self.at[s][0], n, *self.at[s][2:])
            self.limit = max(self.limit, 2 * len(self.edits))

    def result(self) -> tuple[int, str, str, bool]:
        """Cost, edits, digest of the repaired text, and whether it begins with a system turn."""
        a, n = self.at[ASSISTANT], self.at[NOTHING]
        if n and (n[0] < a[0] or n[0] == a[0] and n[1] != a[1] and self.edits.string(n[1]) < self.edits.string(a[1])):
            a = n
        return a[0], self.edits.string(a[1]), a[2].hexdigest(), a[3]


def damage(conversations: DataFrame) -> DataFrame:
    """The fixed damage of the audit: by crc32 of ``conv_id:turn`` modulo 20 a row is dropped
    (kept here with ``dropped`` set, so that its conversation stays known), emptied, robbed of
    ``.!?``, repeated, or given the role user. Null roles, texts and, in the key, null ids and
    turns count as one space."""
    one = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    code = F.pmod(F.crc32(F.concat_ws(":", one("conv_id"), one("turn")).cast("binary")), F.lit(20))
    rows = conversations.select("conv_id", "turn", one("role").alias("role"), one("text").alias("text"), code.alias("code"))
    text = F.when(F.col("code").isin(0, 1), "").when(F.col("code") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    return rows.select(
        "conv_id", "turn", F.when(F.col("code") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"),
        (F.col("code") == 0).alias("dropped"),
        F.explode(F.sequence(F.lit(1), F.when(F.col("code") == 3, 2).otherwise(1))).alias("copy")).drop("copy")


def _ordered(turns: DataFrame) -> DataFrame:
    """Rows of one conversation in one partition, in order, with the faults that need only SQL."""
    one = lambda c: F.coalesce(F.col(c), F.lit(" ")).alias(c)
    dropped = "dropped" if "dropped" in turns.columns else F.lit(False).alias("dropped")
    rows = turns.select("conv_id", "turn", one("role"), one("text"), dropped).repartition("conv_id")
    same = W.partitionBy("conv_id", "role", "text", "dropped").orderBy(F.asc_nulls_first("turn"))
    body = F.rtrim("text", F.lit(SPACE))
    return rows.select(
        "*", (F.row_number().over(same) > 1).alias("again"), (body == "").alias("blank"),
        (~F.substring(body, -1, 1).isin(".", "!", "?")).alias("cut"),
    ).sortWithinPartitions("conv_id", F.asc_nulls_first("turn"), "role", "text", "again")


OUT = {"conv_id": None, "gaps": pa.int64(), "blank": pa.int64(), "duplicate": pa.int64(), "truncated": pa.int64(),
       "illegal": pa.int64(), "cost": pa.int64(), "audit": pa.string(), "repaired_sha256": pa.string(), "starts_system": pa.bool_()}


class _Conversation:
    def __init__(self, conv_id):
        self.conv_id, self.repair = conv_id, Repair()
        self.low = self.high = None
        self.distinct = self.blank = self.duplicate = self.truncated = self.illegal = 0
        self.initial = None

    def add(self, turn, role, text, again, blank, cut) -> None:
        if turn is not None:
            if self.low is None:
                self.low = turn
            if turn != self.high:
                self.distinct += 1
            self.high = turn
        again, cut = again and not blank, cut and not (blank or again)
        self.blank, self.duplicate, self.truncated = self.blank + blank, self.duplicate + again, self.truncated + cut
        initial = role[:1]
        if self.initial is not None:
            self.illegal += self.initial + initial not in FOLLOWS
        self.initial = initial
        self.repair.turn(role, initial, text, blank or again, cut)

    def row(self) -> tuple:
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.distinct
        return (self.conv_id, gaps, self.blank, self.duplicate, self.truncated, self.illegal, *self.repair.result())


def repair(turns: DataFrame) -> DataFrame:
    """A row per conv_id of ``turns`` (conv_id, turn, role, text; rows with ``dropped`` only make
    the conversation known): faults, cost, the least audit string and the repaired text's digest.

    Order: turn (nulls first), then role and text, so rows of one turn have one order and
    repeated rows are neighbours. Null roles and texts are one space; rows with a null conv_id
    form one conversation; an empty role is no legal one. A conversation without rows has zeros,
    an empty audit and the digest of the empty text. Further columns are ignored.
    """
    ship(turns.sparkSession)
    kind = turns.schema["conv_id"].dataType.simpleString()
    rows = _ordered(turns).select("conv_id", "turn", "role", F.col("text").cast("binary"), "again", "blank", "cut", "dropped")

    def run(batches):
        cur, done, id_type = None, [], None
        for b in batches:
            id_type = b.schema.field(0).type
            for conv_id, turn, role, text, again, blank, cut, dropped in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if cur is None or conv_id != cur.conv_id:
                    if cur:
                        done.append(cur.row())
                    cur = _Conversation(conv_id)
                if not dropped:
                    cur.add(turn, role, text, again, blank, cut)
            if len(done) > 2000:
                yield out(done, id_type)
                done = []
        if cur:
            yield out([*done, cur.row()], id_type)

    def out(done, id_type):
        return pa.RecordBatch.from_arrays(
            [pa.array(c, t or id_type) for c, t in zip(zip(*done, strict=True), OUT.values(), strict=True)], list(OUT))

    return rows.mapInArrow(tidy(run), f"conv_id {kind}, gaps long, blank long, duplicate long, truncated long, illegal long, "
                                      "cost long, audit string, repaired_sha256 string, starts_system boolean")


def repaired_turns(turns: DataFrame, audits: DataFrame) -> DataFrame:
    """(conv_id, position, role, text): the repaired conversations of ``repair``'s audits over the
    same ``turns``. Edits and turns meet by their number, so a long conversation is spread over tasks."""
    order = W.partitionBy("conv_id").orderBy("at")
    ops = audits.select("conv_id", "starts_system", F.posexplode(F.split("audit", "")).alias("at", "edit")).filter("edit <> ''")
    ops = ops.withColumn("n", F.sum(F.when(F.col("edit") != "I", 1).otherwise(0)).over(order)) \
        .withColumn("position", F.sum(F.when(F.col("edit") != "D", 1).otherwise(0)).over(order) - 1).filter("edit <> 'D'")
    role = F.when((F.col("position") - F.col("starts_system").cast("int")) % 2 == 0, "user").otherwise("assistant")
    one = lambda c: F.coalesce(F.col(c), F.lit(" ")).alias(c)
    rows = turns.filter(~F.col("dropped")) if "dropped" in turns.columns else turns
    rows = rows.select("conv_id", "turn", one("role"), one("text"))
    rows = rows.withColumn("n", F.row_number().over(W.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), "role", "text")))
    old = rows.select(F.col("conv_id").alias("c"), F.col("n").alias("m"), F.col("role").alias("r"), F.col("text").alias("t"))
    joined = ops.join(old, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("n") == F.col("m")) & (F.col("edit") != "I"), "left")
    return joined.select("conv_id", F.col("position").cast("long").alias("position"),
                         F.when(F.col("edit") == "K", F.col("r")).otherwise(role).alias("role"),
                         F.coalesce("t", F.lit("")).alias("text"))


def sql() -> str:
    """The audit as SQL: a fold over each conversation's turns, the edits and texts as strings."""
    dear = "{'c': 1000000000000, 'a': '', 't': ''}"

    def to(state, cost, edit, line):
        text = f"CASE WHEN {state}.t IS NULL THEN {line} ELSE {state}.t || chr(10) || {line} END" if line else f"{state}.t"
        return f"{{'c': {state}.c + {cost}, 'a': {state}.a || '{edit}', 't': {text}}}"

    def least(*options):
        return f"list_sort([{', '.join(options)}])[1]"

    def usable(when, option):
        return f"CASE WHEN NOT r.x {when} THEN {option} ELSE {dear} END"

    def into(role, befores):
        line = f"'{role}:' || r.text"
        return [usable(f"AND r.i = '{role[0]}'", to(s, "r.e", "K", "r.role || ':' || r.text")) for s in befores] + \
               [usable(f"AND r.i <> '{role[0]}'", to(s, "3 + r.e", "R", line)) for s in befores]

    turn = (f"{{'n': {to('q.n', 4, 'D', None)}, 's': {least(to('q.s', 4, 'D', None), usable("AND r.i = 's'", to('q.n', 'r.e', 'K', "r.role || ':' || r.text")))}, "
            f"'u': {least(to('q.u', 4, 'D', None), *into('user', ('q.n', 'q.s', 'q.a')))}, 'a': {least(to('q.a', 4, 'D', None), *into('assistant', ('q.u',)))}}}")
    user = least("p.u", *(to(s, 3, "I", "'user:'") for s in ("p.n", "p.s", "p.a")))
    closed = f"list_transform([{{'n': p.n, 's': p.s, 'u': {user}, 'a': p.a}}], lambda w: {{'n': w.n, 's': w.s, 'u': w.u, 'a': {least('w.a', to('w.u', 3, 'I', "'assistant:'"))}}})[1]"
    step = f"list_transform([{turn}], lambda p: {closed})[1]"
    start = ("{'n': {'c': 0::BIGINT, 'a': '', 't': NULL::VARCHAR}, 's': {'c': 1000000000000::BIGINT, 'a': '', 't': ''}, "
             "'u': {'c': 3::BIGINT, 'a': 'I', 't': 'user:'}, 'a': {'c': 6::BIGINT, 'a': 'II', 't': 'user:' || chr(10) || 'assistant:'}}")
    space = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
    return f"""
WITH RECURSIVE bits AS (
  SELECT i AS b, i AS v, 0 AS k FROM range(256) t(i)
  UNION ALL
  SELECT b, CASE WHEN v % 2 = 1 THEN xor(3988292384, v // 2) ELSE v // 2 END, k + 1 FROM bits WHERE k < 8),
crc AS (SELECT list(v ORDER BY b) AS t FROM bits WHERE k = 8),
keyed AS (
  SELECT conv_id, turn, COALESCE(role, ' ') AS role, COALESCE(text, ' ') AS text,
         COALESCE(CAST(conv_id AS VARCHAR), ' ') || ':' || COALESCE(CAST(turn AS VARCHAR), ' ') AS k FROM conversations),
coded AS (
  SELECT keyed.*, xor(4294967295, list_reduce(list_transform(string_split(k, ''), lambda c: CAST(ascii(c) AS BIGINT)),
      lambda h, c: xor(t[xor(h, c) % 256 + 1], h // 256), 4294967295::BIGINT)) % 20 AS code
  FROM keyed, crc),
damaged AS (
  SELECT conv_id, turn, CASE WHEN code = 4 THEN 'user' ELSE role END AS role,
         CASE code WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM coded, (VALUES (1), (2)) v(n) WHERE code <> 0 AND (n = 1 OR code = 3)),
seen AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST) > 1 AS again,
         left(role, 1) AS i, rtrim(text, {space}) AS body FROM damaged),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, again) AS n FROM seen),
faulty AS (
  SELECT *, CASE WHEN body = '' THEN 'b' WHEN again THEN 'd' WHEN right(body, 1) NOT IN ('.', '!', '?') THEN 't' ELSE '' END AS fault,
         lag(i) OVER (PARTITION BY conv_id ORDER BY n) || i AS pair FROM placed),
folded AS (
  SELECT conv_id, COALESCE(MAX(turn) - MIN(turn) + 1 - COUNT(DISTINCT turn), 0) AS gaps,
         COUNT(*) FILTER (fault = 'b') AS blank, COUNT(*) FILTER (fault = 'd') AS duplicate,
         COUNT(*) FILTER (fault = 't') AS truncated, COUNT(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal,
         list({{'i': i, 'role': role, 'text': text, 'x': fault IN ('b', 'd'), 'e': CASE WHEN fault = 't' THEN 3 ELSE 0 END}} ORDER BY n) AS turns
  FROM faulty GROUP BY conv_id),
ended AS (
  SELECT *, list_reduce(turns, lambda q, r: {step}, {start}) AS z FROM folded),
best AS (SELECT *, list_sort([z.n, z.a])[1] AS w FROM ended)
SELECT i.conv_id, COALESCE(gaps, 0) AS gaps, COALESCE(blank, 0) AS blank, COALESCE(duplicate, 0) AS duplicate,
       COALESCE(truncated, 0) AS truncated, COALESCE(illegal, 0) AS illegal, COALESCE(w.c, 0) AS cost,
       COALESCE(w.a, '') AS audit, sha256(COALESCE(w.t, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) i LEFT JOIN best ON i.conv_id IS NOT DISTINCT FROM best.conv_id"""
