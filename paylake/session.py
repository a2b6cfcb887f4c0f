"""Session construction and shared-storage helpers."""

from __future__ import annotations

import gc
import io
import os
import re
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

# Settings every job relies on. Shuffle partitions are sized by the caller:
# at 100 TB a 128 MB target partition means ~800k map tasks on the biggest
# scan, so production configs set shuffle partitions from data size (AQE
# coalesces small ones) rather than the local default used in tests.
BASE_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.files.maxPartitionBytes": str(128 * 1024 * 1024),
    # Dimension tables here are bounded by business cardinality (countries,
    # merchants, customers); facts are never broadcast. Explicit broadcast
    # hints in this library are only placed on sides whose size is bounded.
    "spark.sql.autoBroadcastJoinThreshold": str(64 * 1024 * 1024),
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # HotSpot does not JIT-compile methods above 8000 bytes of bytecode; wide
    # rule projections (data-quality checks over many fields) generate such
    # methods and then run interpreted, ~3x slower. At this limit Spark falls
    # back to per-operator code for just those stages.
    "spark.sql.codegen.hugeMethodLimit": "8000",
}


def build_session(master: str | None = None, shuffle_partitions: int | None = None,
                  app_name: str = "paylake", extra: dict | None = None) -> SparkSession:
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    conf = dict(BASE_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    for k, v in conf.items():
        try:
            spark.conf.set(k, v)
        except Exception:  # static confs of an existing session stay as they are
            pass
    return spark


def checkpoint_root(spark: SparkSession, fallback: str | None = None) -> str:
    """Shared folder for lineage cuts and intermediate tables.

    Reads ``spark.checkpoint.dir`` from the session (the cluster names a
    shared folder there). Where it is unset, a folder is chosen and
    registered: ``fallback``, else for a ``local`` master a temporary folder
    (driver and executors are one process), else - on a cluster - a folder
    beside the warehouse, which all executors share; never a machine-local one.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir() or fallback
    if not root:
        if re.match(r"local(\[|$)", spark.sparkContext.master):
            root = os.path.join(tempfile.gettempdir(), f"paylake-ckpt-{uuid.uuid4().hex[:8]}")
        else:
            root = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_paylake_scratch"
        spark.conf.set("spark.checkpoint.dir", root)
    spark.sparkContext.setCheckpointDir(root)
    return root


def ship(spark: SparkSession) -> None:
    """Make this package importable in the executors' Python workers (once a context)."""
    sc = spark.sparkContext
    if getattr(sc, "_paylake_shipped", False):
        return
    top = os.path.dirname(os.path.abspath(__file__))
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w") as z:
        for d, _, names in os.walk(top):
            for n in sorted(names):
                if n.endswith(".py"):
                    full = os.path.join(d, n)
                    z.write(full, os.path.relpath(full, os.path.dirname(top)))
    path = os.path.join(sc._temp_dir, "paylake_src.zip")
    with open(path, "wb") as f:
        f.write(buf.getvalue())
    sc.addPyFile(path)
    sc._paylake_shipped = True


def free_shuffles(spark: SparkSession) -> None:
    """Have the files of finished shuffles deleted: Spark does so once the driver's collector finds that nothing
    refers to them, which on a large heap may be after the job. For jobs that write step by step."""
    gc.collect()
    spark._jvm.System.gc()


# Set where the session has Spark's default: they change how long a job takes and what it spills, not its rows.
TUNED = {
    "spark.sql.codegen.hugeMethodLimit": ("65535", BASE_CONF["spark.sql.codegen.hugeMethodLimit"]),
    # a split of these tables holds seven million rows at the default, which a task sorts in memory
    "spark.sql.files.maxPartitionBytes": (str(128 * 1024 * 1024), str(32 * 1024 * 1024)),
}


def tune(spark: SparkSession) -> None:
    """Settings for a session that this library did not build."""
    for key, (default, ours) in TUNED.items():
        if spark.conf.get(key, default).lower() in (default, f"{default}b"):
            spark.conf.set(key, ours)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    tune(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
