"""A table with one row per key that grows batch by batch; the first row wins.

Rows lie in buckets of their key's hash. A batch adds one file to each bucket
that it touches; ``compact`` turns a bucket's files into one, sorted by key.
A batch much smaller than what its buckets hold reads the stored keys only of
files that may hold one of its own: each file gets a Bloom filter of its keys
(bitmaps built and probed with SQL functions) when the first such batch meets
it. A larger batch is joined with the stored keys, which costs less than to
build and probe filters. Files and batches are named in a manifest: a batch that is written
again after a failure finds itself there and changes nothing. A null key equals
no other: each batch stores one row with it.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paylake.sources.changes import first_per_key
from paylake.sources.manifest import Manifest

BITMAP = 32_768  # bits of one row of bitmap_construct_agg
BITS_PER_KEY, PROBES = 24, 5
FILTERS_PAY = 16  # keys stored in its buckets per row of a batch, from which on filters are asked first
KNOWN_BATCHES = 100  # a stream repeats its last batch only


class KeyedStore:
    def __init__(self, spark: SparkSession, root: str, key: str, buckets: int = 16, rows_per_bucket: int = 5_000_000):
        self.spark, self.root, self.key = spark, root.rstrip("/"), key
        self.manifest = Manifest(spark, root)
        self.buckets, self.rows_per_bucket = buckets, rows_per_bucket

    def state(self) -> tuple[int, dict]:
        seen, state = self.manifest.read()
        return seen, state or {"buckets": self.buckets, "files": [], "batches": [], "schema": None}

    def read(self) -> DataFrame | None:
        """All stored rows (None before the first batch)."""
        return self._rows(self.state()[1])

    def _rows(self, state: dict, files: list[dict] | None = None, columns: bool = True) -> DataFrame | None:
        if not state["schema"]:
            return None
        schema = T.StructType.fromJson(json.loads(state["schema"]))
        paths = [f"{self.root}/{f['path']}" for f in (state["files"] if files is None else files)]
        if not paths:
            return self.spark.createDataFrame([], schema)
        inner = T.StructType([*schema.fields, T.StructField("_hash", T.LongType())])
        df = self.spark.read.schema(inner).parquet(*paths)
        return df.select(*schema.names) if columns else df

    def insert(self, rows: DataFrame, batch_id) -> DataFrame:
        """Store the rows whose key is new, one per key; returns them, read back."""
        seen, state = self.state()
        batch = str(batch_id)
        if batch in state["batches"]:
            return self._rows(state, [f for f in state["files"] if f["batch"] == batch])
        if state["schema"] is None:
            state["schema"] = rows.schema.json()
        keyed = first_per_key(rows, self.key).withColumn("_hash", F.xxhash64(self.key)) \
            .withColumn("_bucket", F.pmod("_hash", F.lit(state["buckets"])).cast("int"))
        new = self._write(keyed, state["buckets"], batch)
        held = self._to_read(new, state)
        if held:  # rewrite the buckets whose keys may be stored already, without those that are
            again = {f["bucket"] for f in held}
            mine = [f for f in new if f["bucket"] in again]
            stored = self._rows(state, held, columns=False).select("_hash", self.key)
            fresh = self._bucketed(state, mine, state["buckets"]).join(stored, ["_hash", self.key], "left_anti")
            new = [f for f in new if f["bucket"] not in again] + self._write(fresh, state["buckets"], batch)
        state["files"] += new
        state["batches"] = [*state["batches"], batch][-KNOWN_BATCHES:]
        self.manifest.commit(seen, state)
        return self._rows(state, new)

    def _write(self, keyed: DataFrame, buckets: int, batch: str | None) -> list[dict]:
        """One file per bucket, sorted by key; a large one in pieces."""
        data = f"data/{uuid.uuid4().hex}"
        keyed.hint("rebalance", "_bucket").sortWithinPartitions("_bucket", self.key) \
            .write.partitionBy("_bucket").option("compression", "zstd").parquet(f"{self.root}/{data}")
        found = sorted(int(n.split("=")[1]) for n in self.manifest.folders(f"{self.root}/{data}") if n.startswith("_bucket="))
        if not found:
            return []
        count = dict(map(tuple, self.spark.read.parquet(f"{self.root}/{data}").groupBy("_bucket").count().collect()))  # a row per bucket
        return [{"bucket": b, "path": f"{data}/_bucket={b}", "bloom": None, "bits": 0, "rows": count[b], "batch": batch} for b in found]

    def _filter(self, files: list[dict]) -> None:
        """Write the Bloom filters of the files that have none yet."""
        todo = [f for f in files if not f["bloom"]]
        if not todo:
            return
        bloom, keys = f"bloom/{uuid.uuid4().hex}", None
        bits = max(BITMAP, 1 << (BITS_PER_KEY * max(f["rows"] for f in todo) - 1).bit_length())
        for data in sorted({f["path"].rsplit("/", 1)[0] for f in todo}):
            own = [f["bucket"] for f in todo if f["path"].rsplit("/", 1)[0] == data]
            part = self.spark.read.parquet(f"{self.root}/{data}").filter(F.col("_bucket").isin(own)) \
                .select(F.concat(F.lit(f"{data}/_bucket="), F.col("_bucket").cast("string")).alias("path"), "_hash")
            keys = part if keys is None else keys.unionAll(part)
        at = F.explode(F.array(*[_probe(i, F.lit(bits)) for i in range(PROBES)]))
        keys.select("path", at.alias("at")) \
            .groupBy("path", F.expr(f"at div {BITMAP}").alias("part")) \
            .agg(F.expr(f"bitmap_construct_agg(at % {BITMAP})").alias("bitmap")) \
            .hint("rebalance").write.parquet(f"{self.root}/{bloom}")
        for f in todo:
            f["bloom"], f["bits"] = bloom, bits

    def _to_read(self, new: list[dict], state: dict) -> list[dict]:
        """The stored files whose keys the batch is joined with."""
        mine = {f["bucket"] for f in new}
        files = [f for f in state["files"] if f["bucket"] in mine]
        if sum(f["rows"] for f in files) > FILTERS_PAY * sum(f["rows"] for f in new):
            return self._may_hold(new, state)
        return files

    def _may_hold(self, new: list[dict], state: dict) -> list[dict]:
        """Stored files whose Bloom filter holds one of the new keys."""
        mine = {f["bucket"]: f for f in new}
        files = [f for f in state["files"] if f["bucket"] in mine]
        if not files:
            return []
        self._filter(files)
        spark = self.spark
        listed = spark.createDataFrame([(i, f["bucket"], f["bits"]) for i, f in enumerate(files)], "file int, bucket int, bits long")
        maps = None
        for path in sorted({f["bloom"] for f in files}):
            own = spark.createDataFrame([(i, f["path"]) for i, f in enumerate(files) if f["bloom"] == path], "file int, path string")
            part = spark.read.parquet(f"{self.root}/{path}").filter(F.col("path").isin([f["path"] for f in files if f["bloom"] == path])) \
                .join(F.broadcast(own), "path").select("file", "part", "bitmap")  # a row per file of the manifest
            maps = part if maps is None else maps.unionAll(part)
        keys = self._rows(state, list(mine.values()), columns=False).select("_hash").withColumn(
            "bucket", F.pmod("_hash", F.lit(state["buckets"])).cast("int"))
        at = F.explode(F.array(*[_probe(i, F.col("bits")) for i in range(PROBES)]))
        probes = keys.join(F.broadcast(listed), "bucket").select("file", "_hash", at.alias("at")) \
            .withColumn("part", F.expr(f"at div {BITMAP}")).withColumn("bit", F.expr(f"cast(at % {BITMAP} as int)"))
        byte = F.expr("cast(conv(hex(substring(bitmap, bit div 8 + 1, 1)), 16, 10) as int)")
        hit = F.expr("getbit(byte, bit % 8)")
        held = probes.join(maps, ["file", "part"]).withColumn("byte", byte).filter(hit == 1) \
            .groupBy("file", "_hash").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") == PROBES).select("file").distinct().collect()
        return [files[r[0]] for r in held]

    def _bucketed(self, state: dict, files: list[dict], buckets: int) -> DataFrame:
        return self._rows(state, files, columns=False).withColumn("_bucket", F.pmod("_hash", F.lit(buckets)).cast("int"))

    def files_per_bucket(self) -> dict[int, int]:
        out: dict[int, int] = {}
        for f in self.state()[1]["files"]:
            out[f["bucket"]] = out.get(f["bucket"], 0) + 1
        return out

    def compact(self, most: int = 1) -> int:
        """Buckets with more than ``most`` files besides those of the last batch, which may be
        repeated yet, get one; where buckets hold too many rows on average, all are split in two,
        the last batch's too. Returns the files written."""
        seen, state = self.state()
        last = state["batches"][-1] if state["batches"] else None
        split = sum(f["rows"] for f in state["files"]) > state["buckets"] * self.rows_per_bucket
        older = [f for f in state["files"] if f["batch"] != last]
        count: dict[int, int] = {}
        for f in older:
            count[f["bucket"]] = count.get(f["bucket"], 0) + 1
        old = [f for f in older if split or count[f["bucket"]] > most]
        if not old:
            return 0
        buckets = state["buckets"] * (2 if split else 1)
        kept = [f for f in state["files"] if f not in old]
        new = self._write(self._bucketed(state, old, buckets), buckets, None)
        if split:
            kept = self._write(self._bucketed(state, kept, buckets), buckets, last) if kept else []
        state["files"], state["buckets"] = kept + new, buckets
        self.manifest.commit(seen, state)
        return len(new)

    def vacuum(self) -> None:
        """Drop folders that the current version does not name (when no reader uses an older one)."""
        _, state = self.state()
        live = {f["path"] for f in state["files"]} | {f["bloom"] for f in state["files"] if f["bloom"]}
        for kind in ("data", "bloom"):
            for name in self.manifest.folders(f"{self.root}/{kind}"):
                if not any(p == f"{kind}/{name}" or p.startswith(f"{kind}/{name}/") for p in live):
                    self.manifest.delete(f"{self.root}/{kind}/{name}")
                elif kind == "data":
                    for b in self.manifest.folders(f"{self.root}/data/{name}"):
                        if f"data/{name}/{b}" not in live:
                            self.manifest.delete(f"{self.root}/data/{name}/{b}")
        self.manifest.prune()


def _probe(i: int, bits):
    return F.pmod(F.xxhash64(F.col("_hash"), F.lit(i)), bits)
