"""Merkle fixity audit of WARC files against a replica.

Records are hashed; the hashes of each 64 KiB range of offsets are hashed in
order, those of 16 ranges again, and so on up to a root for each file. Two
replicas agree where their roots do. Where they don't, only the branches that
differ are followed down, level by level, to the records that are damaged,
missing or extra. Trees are written once; an audit of sound files reads the roots alone.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from paylake.llm.common import Scratch

RANGE_BITS = 16  # 64 KiB of offsets in a leaf range
FAN_BITS = 4  # 16 children to a node
LEVELS = 5  # ranges of 64 KiB, 1 MiB, 16 MiB, 256 MiB, 4 GiB; a root joins the last ones
RECORDS_PER_FILE = 1000


def _records(pages: DataFrame, per_file: int) -> DataFrame:
    """file, length, record and page_id, with ``_order``, the place among the pages of one id."""
    url, html = F.coalesce("url", F.lit("")), F.coalesce("html", F.lit(""))
    pid = F.col("page_id").cast("long")
    same = F.concat(F.md5(url), F.md5(html))
    file = F.coalesce(F.concat(F.lit("pages-"), F.floor(pid / per_file).cast("string")),
                      F.concat(F.lit("no-id-"), F.hex(F.xxhash64(url, html))))
    head = F.concat(F.lit("WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:"), F.coalesce(pid.cast("string"), F.lit("")),
                    F.lit(">\r\nWARC-Target-URI: "), F.regexp_replace(url, r"[\r\n]", " "), F.lit("\r\nContent-Type: text/html\r\nContent-Length: "),
                    F.octet_length(html).cast("string"), F.lit("\r\n\r\n"))
    rec = pages.select(pid.alias("page_id"), file.alias("file"), same.alias("_order"),
                       F.concat(head, html, F.lit("\r\n\r\n")).cast("binary").alias("record"))
    return rec.withColumn("length", F.octet_length("record").cast("long"))


def _placed(records: DataFrame) -> DataFrame:
    """``records`` with their offsets; a file is bounded by its number of ids, so is the window."""
    order = W.partitionBy("file").orderBy(F.col("page_id").asc_nulls_first(), "_order").rowsBetween(W.unboundedPreceding, -1)
    return records.withColumn("offset", F.coalesce(F.sum("length").over(order), F.lit(0)).cast("long")).drop("_order")


def warc_records(pages: DataFrame, per_file: int = RECORDS_PER_FILE) -> DataFrame:
    """file, offset, length, record (bytes) and page_id: ``pages`` (page_id, url, html) as WARC response records.

    A file holds the pages of ``per_file`` consecutive ids in order of id and a 256-bit hash of
    url and html; pages without an id are dealt to files of their own by a hash of url and html.
    Null url and html are empty. Rows that repeat make records that repeat.
    """
    return _placed(_records(pages, per_file)).select("file", "offset", "length", "record", "page_id")


@dataclass
class Tree:
    """``records``: file, offset, length, digest and what came with them; ``levels[k]``: file, node, digest; ``roots``: file, digest."""
    records: DataFrame
    levels: list[DataFrame]
    roots: DataFrame


def _joined(children: DataFrame, keys: list[str], place: str) -> DataFrame:
    """Digest of the children's digests in order of place (a node's children are bounded by its range)."""
    listed = F.sort_array(F.collect_list(F.struct(F.col(place).alias("p"), F.col("digest").alias("d"))))
    text = F.array_join(F.transform(listed, lambda x: F.concat(x["p"].cast("string"), F.lit(":"), x["d"])), "\n")
    return children.groupBy(*keys).agg(F.sha2(text.cast("binary"), 256).alias("digest"))


def build(records: DataFrame, scratch: Scratch, name: str) -> Tree:
    """The written tree of ``records`` (file, offset, length, record or its digest, and other columns, which are kept).

    An empty table has no roots. Records that share a file and offset count in order of their digests.
    """
    own = [c for c in records.columns if c not in ("record", "digest")]
    digest = "digest" if "digest" in records.columns else F.sha2("record", 256).alias("digest")
    leaf = scratch.save(records.select(*own, digest), f"{name}-records")
    levels, below = [], None
    for k in range(LEVELS):
        if below is None:
            nodes = _joined(leaf.withColumn("node", F.shiftright("offset", RANGE_BITS)), ["file", "node"], "offset")
        else:
            nodes = _joined(below.withColumnRenamed("node", "child").withColumn("node", F.shiftright("child", FAN_BITS)),
                            ["file", "node"], "child")
        below = scratch.save(nodes, f"{name}-level{k}")
        levels.append(below)
    return Tree(leaf, levels, scratch.save(_joined(below, ["file"], "node"), f"{name}-roots"))


def _differing(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Keys whose digests differ or that one side lacks."""
    both = a.select(*keys, F.col("digest").alias("da")).join(b.select(*keys, F.col("digest").alias("db")), keys, "full")
    return both.filter(~F.col("da").eqNullSafe(F.col("db"))).select(*keys)


def audit(a: Tree, b: Tree) -> DataFrame:
    """The records at fault: file, offset, digest (of ``a``), replica_digest, status: ``corrupt``, ``missing`` in the replica or ``extra`` there.

    Each level joins only the children of the nodes that differ above. The differing nodes of a level are written before the
    next one reads them, for both trees, so that no plan holds more than a level. Records that share file and offset are compared as sets.
    """
    s = Scratch(a.records.sparkSession, "fixity-audit")
    bad = s.save(_differing(a.roots, b.roots, ["file"]), "roots")
    for k in range(LEVELS - 1, -1, -1):
        up = "file" if k == LEVELS - 1 else ["file", "_up"]

        def below(t: Tree, k=k, up=up) -> DataFrame:
            x = t.levels[k].withColumn("_up", F.shiftright("node", FAN_BITS))
            return x.join(bad, up, "left_semi")

        bad = s.save(_differing(below(a), below(b), ["file", "node"]).withColumnRenamed("node", "_up"), f"level{k}")

    def records(t: Tree, digest: str) -> DataFrame:
        x = t.records.select("file", "offset", F.shiftright("offset", RANGE_BITS).alias("_up"), "digest")
        return x.join(bad, ["file", "_up"], "left_semi").groupBy("file", "offset").agg(
            F.concat_ws(" ", F.sort_array(F.collect_set("digest"))).alias(digest))

    both = records(a, "digest").join(records(b, "replica_digest"), ["file", "offset"], "full")
    status = F.when(F.col("digest").isNull(), "extra").when(F.col("replica_digest").isNull(), "missing").otherwise("corrupt")
    return both.filter(~F.col("digest").eqNullSafe(F.col("replica_digest"))).withColumn("status", status)


def damaged(records: DataFrame, every: int = 97) -> DataFrame:
    """A replica with faults: of the records whose crc32(page_id) mod ``every`` is 0 the byte after the first half is
    overwritten with ``#`` (with ``%`` where it was one)."""
    hit = F.pmod(F.crc32(F.coalesce(F.col("page_id").cast("string"), F.lit("")).cast("binary")), F.lit(every)) == 0
    at = F.expr("substring(record, cast(floor(length / 2) as int) + 1, 1)")
    new = F.when(at == F.lit(b"#"), F.lit(b"%")).otherwise(F.lit(b"#"))
    return records.withColumn("record", F.when(hit, F.concat(
        F.expr("substring(record, 1, cast(floor(length / 2) as int))"), new,
        F.expr("substring(record, cast(floor(length / 2) as int) + 2)"))).otherwise(F.col("record")))


def audit_pages(pages: DataFrame) -> DataFrame:
    """A row per page: page_id, file, offset, length, digest and status (``ok`` or what the audit of the damaged replica found).

    Both replicas' records are hashed where the pages are read; only digests and lengths are shuffled."""
    s = Scratch(pages.sparkSession, "fixity")
    hashed = damaged(_records(pages, RECORDS_PER_FILE).withColumn("digest", F.sha2("record", 256))) \
        .withColumn("replica", F.sha2("record", 256)).drop("record")
    slim = s.save(_placed(hashed), "digests")
    a, b = build(slim.drop("replica"), s, "a"), build(slim.drop("digest").withColumnRenamed("replica", "digest"), s, "b")
    found = audit(a, b).select("file", "offset", "status")
    out = a.records.join(found, ["file", "offset"], "left").select(
        "page_id", "file", "offset", "length", "digest", F.coalesce("status", F.lit("ok")).alias("status"))
    return out


def sql(per_file: int = RECORDS_PER_FILE, every: int = 97) -> str:
    """The same rows by hashing every record, for unique page ids. DuckDB has no crc32, so the damaged ids
    are those whose record differs, which the audit must find; they are listed by a bitwise crc32 in SQL."""
    return f"""
    WITH RECURSIVE
    t AS (SELECT i AS b, i::BIGINT AS v, 0 AS k FROM range(256) r(i)
          UNION ALL SELECT b, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END, k + 1 FROM t WHERE k < 8),
    c AS (SELECT page_id, CAST(page_id AS VARCHAR) AS s, 1 AS i, 4294967295::BIGINT AS crc FROM pages
          UNION ALL
          SELECT c.page_id, c.s, c.i + 1, xor(c.crc >> 8, t.v) FROM c
          JOIN t ON t.k = 8 AND t.b = (xor(c.crc, ascii(substr(c.s, c.i, 1))) & 255) WHERE c.i <= length(c.s)),
    h AS (SELECT page_id, xor(crc, 4294967295) AS crc FROM c WHERE i = length(s) + 1),
    r AS (SELECT page_id, 'pages-' || CAST(page_id // {per_file} AS VARCHAR) AS file,
                 'WARC/1.0' || chr(13) || chr(10) || 'WARC-Type: response' || chr(13) || chr(10) || 'WARC-Record-ID: <urn:page:'
                 || CAST(page_id AS VARCHAR) || '>' || chr(13) || chr(10) || 'WARC-Target-URI: '
                 || regexp_replace(coalesce(url, ''), '[\\r\\n]', ' ', 'g') || chr(13) || chr(10) || 'Content-Type: text/html'
                 || chr(13) || chr(10) || 'Content-Length: ' || CAST(strlen(coalesce(html, '')) AS VARCHAR)
                 || chr(13) || chr(10) || chr(13) || chr(10) || coalesce(html, '') || chr(13) || chr(10) || chr(13) || chr(10) AS record
          FROM pages)
    SELECT r.page_id, file,
           CAST(coalesce(sum(strlen(record)) OVER (PARTITION BY file ORDER BY r.page_id
                ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "offset",
           strlen(record) AS length, sha256(record) AS digest,
           CASE WHEN h.crc % {every} = 0 THEN 'corrupt' ELSE 'ok' END AS status
    FROM r JOIN h ON h.page_id = r.page_id"""
