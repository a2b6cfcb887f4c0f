"""Erasure of subjects file by file, with an index from subjects to files and a proof of each run.

A row's subject is known to an index (hash of the subject, file), kept in
buckets of the hash. A run looks its subjects up in their buckets, rewrites
only the files that hold one of them, commits, and then deletes the old files,
so that nothing of a subject stays on disk. Other files keep their names.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paylake.sources.manifest import Manifest


class SubjectTable:
    """Rows of many subjects (column ``key``) under ``root``; rows with a null subject belong to nobody."""

    def __init__(self, spark: SparkSession, root: str, key: str, buckets: int = 64):
        self.spark, self.root, self.key, self.buckets = spark, root.rstrip("/"), key, buckets
        self.manifest = Manifest(spark, root)

    def _state(self) -> tuple[int, dict]:
        seen, state = self.manifest.read()
        return seen, state or {"parts": [], "gone": [], "runs": [], "schema": None}

    def append(self, rows: DataFrame, cluster: bool = False) -> None:
        """Add rows; with ``cluster`` laid out by subject, so that a subject lies in few files."""
        seen, state = self._state()
        state["schema"] = state["schema"] or rows.schema.json()
        state["parts"].append(self._write(rows.repartitionByRange(self.key) if cluster else rows, rows.schema))
        self.manifest.commit(seen, state)

    def _write(self, rows: DataFrame, schema: T.StructType) -> str:
        part = uuid.uuid4().hex
        rows.write.option("compression", "zstd").parquet(f"{self.root}/data/{part}")
        written = self.spark.read.schema(schema).parquet(f"{self.root}/data/{part}")
        h = F.xxhash64(F.col(self.key).cast("string"))
        written.filter(F.col(self.key).isNotNull()).select(h.alias("hash"), F.col("_metadata.file_path").alias("file")).distinct() \
            .withColumn("bucket", F.pmod("hash", F.lit(self.buckets)).cast("int")) \
            .hint("rebalance", "bucket").write.partitionBy("bucket").parquet(f"{self.root}/index/part={part}")
        return part

    def _rows(self, state: dict) -> DataFrame:
        schema = T.StructType.fromJson(json.loads(state["schema"]))
        df = self.spark.read.schema(schema).parquet(*[f"{self.root}/data/{p}" for p in state["parts"]])
        # files replaced by a run that has not deleted them yet
        return df.filter(~F.col("_metadata.file_path").isin(state["gone"])) if state["gone"] else df

    def read(self) -> DataFrame:
        return self._rows(self._state()[1])

    def files_of(self, subjects: DataFrame) -> list[str]:
        """The files that may hold one of the subjects (column ``key``), from their buckets of the index."""
        _, state = self._state()
        wanted = subjects.select(F.xxhash64(F.col(self.key).cast("string")).alias("hash")).distinct()
        held = [r[0] for r in wanted.select(F.pmod("hash", F.lit(self.buckets)).cast("int").alias("b")).distinct().collect()]  # bucket numbers
        index = self.spark.read.option("basePath", f"{self.root}/index").parquet(*[f"{self.root}/index/part={p}" for p in state["parts"]]) \
            .filter(F.col("bucket").isin(held))
        found = index.join(wanted, "hash", "left_semi").select("file").distinct().collect()  # names of files to rewrite
        return sorted({r[0] for r in found} - set(state["gone"]))

    def erase(self, subjects: DataFrame, run_id: str) -> DataFrame:
        """Remove the rows of ``subjects`` and return the run's proof: subjects asked for and found,
        rows erased, files rewritten and left. A run that is repeated finishes what it began."""
        seen, state = self._state()
        done = {r["run_id"]: r for r in state["runs"]}
        if run_id not in done:
            wanted = subjects.select(self.key).filter(F.col(self.key).isNotNull()).distinct()
            files = self.files_of(wanted)
            proof = {"run_id": run_id, "subjects_asked": wanted.count(), "subjects_found": 0, "rows_erased": 0, "files_rewritten": 0}
            if files:
                schema = T.StructType.fromJson(json.loads(state["schema"]))
                old = self.spark.read.schema(schema).parquet(*files)
                hit = old.join(wanted, self.key, "left_semi").agg(F.count(F.lit(1)), F.countDistinct(self.key)).first()
                if hit[0]:  # else the index named files for other subjects of the same hash
                    proof |= {"rows_erased": hit[0], "subjects_found": hit[1], "files_rewritten": len(files)}
                    state["parts"].append(self._write(old.join(wanted, self.key, "left_anti").select(*schema.names), schema))
                    state["gone"] = state["gone"] + files
            state["runs"].append(proof)
            seen = self.manifest.commit(seen, state)
        if state["gone"]:
            for f in state["gone"]:
                self.manifest.delete(f)
            state["gone"] = []
            self.manifest.commit(seen, state)
        return self.proofs().filter(F.col("run_id") == run_id)

    def proofs(self) -> DataFrame:
        _, state = self._state()
        return self.spark.createDataFrame([(r["run_id"], r["subjects_asked"], r["subjects_found"], r["rows_erased"], r["files_rewritten"])
                                           for r in state["runs"]],
                                          "run_id string, subjects_asked long, subjects_found long, rows_erased long, files_rewritten long")
