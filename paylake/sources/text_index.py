"""An inverted index of texts: postings (term, document, text, positions) by hash of the term.

Postings lie in buckets of the term's hash, sorted by term, so a search opens
the buckets of its own terms only and row groups of other terms are skipped.
Batches of documents add postings beside the old ones and are named by a
manifest; a batch that is written again changes nothing.
"""

from __future__ import annotations

import uuid
import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paylake.sources.manifest import Manifest

NOT_LETTERS = r"[^\p{L}]+"
KNOWN_BATCHES = 100  # a stream repeats its last batch only


def tokens(text: str = "text"):
    """Runs of letters, lower-cased, in order."""
    return F.filter(F.split(F.lower(F.col(text)), NOT_LETTERS), lambda t: t != "")


def places(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, text_hash, term, positions), a row for each term of each text. A text's words are sorted by term and
    place within its row, and a term's places are a stretch of them, so that no word is a row of its own."""
    words = docs.filter(F.col(text).isNotNull()).select(key, F.xxhash64(text).alias("text_hash"), F.col(text).alias("_text"))
    words = words.groupBy(key, "text_hash").agg(F.first("_text").alias("_text")).select(
        key, "text_hash", F.sort_array(F.transform(tokens("_text"), lambda t, i: F.struct(t.alias("term"), i.alias("at")))).alias("_w"))
    words = words.filter(F.size("_w") > 0).withColumn("_first", F.filter(
        F.sequence(F.lit(0), F.size("_w") - 1), lambda i: (i == 0) | (F.get("_w", i)["term"] != F.get("_w", i - 1)["term"])))
    upto = lambda j: F.coalesce(F.get("_first", j + 1), F.size("_w"))
    terms = F.transform("_first", lambda i, j: F.struct(
        F.get("_w", i)["term"].alias("term"), F.transform(F.slice("_w", i + 1, upto(j) - i), lambda w: w["at"]).alias("positions")))
    return words.select(key, "text_hash", F.inline(terms))


class TextIndex:
    def __init__(self, spark: SparkSession, root: str, key: str = "doc_id", buckets: int = 64):
        self.spark, self.root, self.key, self.buckets = spark, root.rstrip("/"), key, buckets
        self.manifest = Manifest(spark, root)

    def add(self, docs: DataFrame, batch_id, text: str = "text") -> None:
        """Index ``docs`` (key, text). A term's positions in one text are one row; different texts of
        one key (or of none) are told apart by a hash, equal ones count once. Null texts have none."""
        seen, state = self.manifest.read()
        state = state or {"parts": [], "batches": [], "buckets": self.buckets}
        if str(batch_id) in state["batches"]:
            return
        name = f"data/part={uuid.uuid4().hex}"
        postings = places(docs, self.key, text).select("term", self.key, "text_hash", "positions")
        bucket = F.pmod(F.crc32(F.col("term").cast("binary")), F.lit(state["buckets"])).cast("int")
        # a term in a third of all documents is spread over files by AQE
        postings.withColumn("bucket", bucket).hint("rebalance", "bucket").sortWithinPartitions("bucket", "term", self.key) \
            .write.partitionBy("bucket").option("compression", "zstd").parquet(f"{self.root}/{name}")
        state["parts"].append(name)
        state["batches"] = [*state["batches"], str(batch_id)][-KNOWN_BATCHES:]
        self.manifest.commit(seen, state)

    def postings(self, terms: list[str]) -> DataFrame:
        """The postings of the terms; only their buckets are listed and read."""
        _, state = self.manifest.read()
        terms = sorted({t.lower() for t in terms})
        held = sorted({zlib.crc32(t.encode()) % state["buckets"] for t in terms})
        df = self.spark.read.option("basePath", f"{self.root}/data").parquet(*[f"{self.root}/{p}" for p in state["parts"]])
        return df.filter(F.col("bucket").isin(held) & F.col("term").isin(terms)).drop("part", "bucket")

    def any_of(self, terms: list[str]) -> DataFrame:
        """Keys of the documents that hold one of the terms."""
        return self.postings(terms).select(self.key).distinct()

    def all_of(self, terms: list[str]) -> DataFrame:
        """Keys of the documents that hold every term: the postings intersected, one shuffle by key."""
        n = len({t.lower() for t in terms})
        return self.postings(terms).select(self.key, "term").distinct().groupBy(self.key) \
            .agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") == n).select(self.key)

    def phrase(self, words: list[str]) -> DataFrame:
        """(key, n_places): the documents that hold the words next to each other, in order."""
        words = [w.lower() for w in words]
        # a text's places of each word meet as arrays (equal for copies in several batches), not place by place
        held = {w: f"_p{i}" for i, w in enumerate(dict.fromkeys(words))}
        texts = self.postings(words).groupBy(self.key, "text_hash").agg(
            *[F.max(F.when(F.col("term") == w, F.col("positions"))).alias(c) for w, c in held.items()])
        starts = None
        for i, w in enumerate(words):
            mine = F.expr(f"transform({held[w]}, at -> at - {i})")
            starts = mine if starts is None else F.array_intersect(starts, mine)
        return texts.select(self.key, F.size(starts).cast("long").alias("_n")).filter(F.col("_n") > 0) \
            .groupBy(self.key).agg(F.sum("_n").alias("n_places"))

    def document_counts(self, terms: list[str]) -> DataFrame:
        """(term, n_docs, n_places)."""
        return self.postings(terms).groupBy("term").agg(F.countDistinct(self.key).alias("n_docs"), F.sum(F.size("positions")).alias("n_places"))
