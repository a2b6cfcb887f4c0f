"""Token ids in ORC: integer run-length encoding, row indexes, Bloom filters on doc_id.

Rows are range-partitioned and sorted by document id, so each file and each
stripe covers a narrow range of ids: a lookup prunes files and stripes by
their minimum and maximum, row groups by the index, and the rest by the Bloom
filter. Spark reads stripes in parallel.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from paylake.llm.common import raw_text, ship, tidy
from paylake.llm.word_tokens import encode_each

END_ID = 2
STRIPE_BYTES = 16 << 20
INDEX_ROWS = 1000
SCHEMA = "doc_id long, start_in_file long, n_tokens long, ids array<int>"


def write_ids(docs: DataFrame, path: str, end_id: int = END_ID, vocabulary: str | None = None) -> None:
    """Encode each whole text, append ``end_id``, write one ORC file per range of doc_id.

    Null text counts as empty; a null doc_id sorts first; rows with the same
    doc_id are ordered by a hash of the text and spread over files by it. ``start_in_file`` counts the ids before a row in its file.
    """
    ship(docs.sparkSession)
    end = np.array([end_id], dtype="<u4").tobytes()

    def run(batches):
        at = 0
        for b in batches:
            doc_ids = b.column(0).to_pylist()
            out, size = ([], [], []), 0
            for i, ids in enumerate(encode_each(b.column(1).to_pylist(), vocabulary)):
                ids += end
                for x, v in zip(out, (doc_ids[i], at, ids), strict=True):
                    x.append(v)
                at += len(ids) // 4
                size += len(ids)
                if size > 1 << 23:
                    yield rows(*out)
                    out, size = ([], [], []), 0
            if out[0]:
                yield rows(*out)

    def rows(doc_ids, starts, ids):
        n = np.array([len(x) // 4 for x in ids], dtype=np.int64)
        ends = np.concatenate([[0], np.cumsum(n)]).astype(np.int32)
        values = pa.array(np.frombuffer(b"".join(ids), dtype="<i4"))
        return pa.RecordBatch.from_arrays(
            [pa.array(doc_ids, pa.int64()), pa.array(starts, pa.int64()), pa.array(n),
             pa.ListArray.from_arrays(pa.array(ends), values)], ["doc_id", "start_in_file", "n_tokens", "ids"])

    x = docs.select(F.col("doc_id").cast("long").alias("doc_id"), raw_text().alias("raw"), F.xxhash64(raw_text()).alias("_h"))
    x.repartitionByRange("doc_id", "_h").sortWithinPartitions("doc_id", "_h", "raw").drop("_h").mapInArrow(tidy(run), SCHEMA) \
        .write.format("orc").option("compression", "zstd").option("orc.bloom.filter.columns", "doc_id") \
        .option("orc.create.index", "true").option("orc.row.index.stride", str(INDEX_ROWS)) \
        .option("orc.stripe.size", str(STRIPE_BYTES)).save(path)


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """The files' rows, with the number of the file that each comes from (files are in order of doc_id)."""
    return spark.read.schema(SCHEMA).orc(path).withColumn(
        "file", F.regexp_extract(F.col("_metadata.file_name"), r"part-(\d+)", 1).cast("long"))


def digests(rows: DataFrame) -> DataFrame:
    """doc_id, start (ids of all rows before), n_tokens and crc32 of the ids read. Only these digests are joined with the
    files' totals (a row per file); the ids stay where they are read."""
    ship(rows.sparkSession)

    def run(batches):
        for b in batches:
            ids = b.column("ids")
            ends, values = ids.offsets.to_numpy(), ids.values.to_numpy()
            crc = [zlib.crc32(values[s:e].astype("<u4")) for s, e in zip(ends[:-1], ends[1:], strict=True)]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("file"), b.column("start_in_file"), pa.array(np.diff(ends).astype(np.int64)),
                 pa.array(crc, pa.int64())], ["doc_id", "file", "start_in_file", "n_tokens", "ids_crc32"])

    files = rows.groupBy("file").agg(F.sum("n_tokens").alias("_n"))
    first = files.select("file", (F.sum("_n").over(W.orderBy("file")) - F.col("_n")).alias("_before"))
    each = rows.select("doc_id", "file", "start_in_file", "ids").mapInArrow(
        tidy(run), "doc_id long, file long, start_in_file long, n_tokens long, ids_crc32 long")
    return each.join(first, "file").select(
        "doc_id", (F.col("_before") + F.col("start_in_file")).alias("start"), "n_tokens", "ids_crc32")
