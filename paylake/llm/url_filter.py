"""URL filter: host and path rules first, then a weighted vocabulary.

Terms are found in the whole lower-cased (A-Z) URL with an Aho-Corasick
automaton; a hit counts only where the characters on both sides are not a-z or
0-9. Every distinct term adds its weight once; a URL is blocked when the sum
reaches ``limit``: one strict term does, or several soft ones.
"""

from __future__ import annotations

from collections import defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paylake.llm.common import ship, tidy

# A small vocabulary; callers pass their own.
STRICT = ("porn", "xxx", "hentai", "casino", "viagra", "warez", "malware", "phishing", "escorts", "torrent")
SOFT = ("free", "win", "bonus", "cheap", "adult", "pills", "dating", "prize", "loan", "bet", "hot", "crack")
LIMIT = 2
# Fixed values: (verdict, host and path).
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WORD = frozenset(LOWER + "0123456789")


def weights(strict=STRICT, soft=SOFT, limit: int = LIMIT) -> dict[str, int]:
    return dict.fromkeys(soft, 1) | dict.fromkeys(strict, limit)


def host_and_path(url: str = "url"):
    """Host and path columns of a URL; both empty when it is null or has no ``://``."""
    u = F.coalesce(F.col(url), F.lit(""))
    at = F.instr(u, "://")
    rest = F.when(at > 0, F.substring(u, at + 3, F.length(u))).otherwise("")
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"^[^?#]*", 0)
    return F.translate(host, UPPER, LOWER), path


def _judge(rules):
    by_host = defaultdict(list)
    for verdict, rule in rules:
        host, slash, path = rule.partition("/")
        by_host[host].append((-len(rule), verdict != "block", slash + path, rule, verdict))
    for x in by_host.values():
        x.sort()

    def judge(host: str, path: str):
        best = None
        while host:
            for r in by_host.get(host, ()):
                if path.startswith(r[2]):
                    best = min(best, r) if best else r
                    break
            host = host.partition(".")[2]
        return best

    return judge


def _automaton(terms):
    import ahocorasick
    a = ahocorasick.Automaton()
    for t in terms:
        a.add_word(t, t)
    a.make_automaton()
    return a


def _hits(automaton, text: str) -> set[str]:
    n, out = len(text), set()
    for end, term in automaton.iter(text):
        start = end - len(term) + 1
        if (start == 0 or text[start - 1] not in _WORD) and (end + 1 == n or text[end + 1] not in _WORD):
            out.add(term)
    return out


def filter_urls(pages: DataFrame, rules=RULES, terms: dict[str, int] | None = None, limit: int = LIMIT) -> DataFrame:
    """page_id, host, path, rule, verdict, weight and terms (the distinct ones hit, sorted).

    A rule fits its host and subdomains when the path starts with the rule's;
    the longest rule wins, at equal length a blocking one. Without a rule the
    vocabulary decides; a null or empty url has no hit and is allowed. Rows that
    repeat are judged alike; other columns of ``pages`` are not read.
    """
    ship(pages.sparkSession)
    terms = weights() if terms is None else terms
    host, path = host_and_path()
    src = pages.select(F.col("page_id").cast("long").alias("page_id"), host.alias("host"), path.alias("path"),
                       F.translate(F.coalesce(F.col("url"), F.lit("")), UPPER, LOWER).alias("low"))

    def run(batches):
        judge, automaton = _judge(rules), _automaton(terms) if terms else None
        for b in batches:
            cols = [], [], [], []
            for h, p, low in zip(*(b.column(i).to_pylist() for i in (1, 2, 3)), strict=True):
                rule = judge(h, p)
                found = sorted(_hits(automaton, low)) if automaton else []
                weight = sum(terms[t] for t in found)
                verdict = rule[4] if rule else "block" if weight >= limit else "allow"
                for c, v in zip(cols, (rule and rule[3], verdict, weight, found), strict=True):
                    c.append(v)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), b.column(2), pa.array(cols[0], pa.string()), pa.array(cols[1], pa.string()),
                 pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.list_(pa.string()))],
                ["page_id", "host", "path", "rule", "verdict", "weight", "terms"])

    return src.mapInArrow(tidy(run), "page_id long, host string, path string, rule string, verdict string, "
                               "weight long, terms array<string>")


def sql(rules=RULES, strict=STRICT, soft=SOFT, limit: int = LIMIT) -> str:
    """The same verdicts in SQL, for few rules and terms."""
    parts = [(v, r, *r.partition("/")) for v, r in sorted(rules, key=lambda x: (-len(x[1]), x[0] != "block"))]
    fits = [(v, r, f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{s + p}')") for v, r, h, s, p in parts]
    rule = "CASE " + " ".join(f"WHEN {c} THEN '{r}'" for _, r, c in fits) + " END"
    said = "CASE rule " + " ".join(f"WHEN '{r}' THEN '{v}'" for v, r, _ in fits)
    hit = "CASE WHEN regexp_matches(low, '(^|[^a-z0-9]){}([^a-z0-9]|$)') THEN {} ELSE 0 END"
    weight = " + ".join(hit.format(t, w) for t, w in weights(strict, soft, limit).items())
    return f"""
    WITH a AS (SELECT page_id, coalesce(url, '') AS u, strpos(coalesce(url, ''), '://') AS cut FROM pages),
    b AS (SELECT page_id, translate(u, '{UPPER}', '{LOWER}') AS low,
                 CASE WHEN cut > 0 THEN substr(u, cut + 3) ELSE '' END AS rest FROM a),
    c AS (SELECT *, regexp_extract(rest, '^[^/?#]*') AS h FROM b),
    d AS (SELECT page_id, low, translate(h, '{UPPER}', '{LOWER}') AS host,
                 regexp_extract(substr(rest, length(h) + 1), '^[^?#]*') AS path FROM c),
    e AS (SELECT *, {rule} AS rule, {weight} AS weight FROM d)
    SELECT page_id, host, path, rule,
           {said} ELSE CASE WHEN weight >= {limit} THEN 'block' ELSE 'allow' END END AS verdict
    FROM e"""
