"""Session construction and the shared folder used to cut lineage."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "curbflow", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the marts rely on; anything else is left to the cluster.

    No shuffle partition count is set here: adaptive execution coalesces from the cluster's own
    setting, and a fixed count would be wrong for either a laptop or a thousand executors.
    """
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        # The JVM never compiles methods above 8000 bytes; beyond that, split generated code
        # runs compiled while one fused method would run interpreted.
        .config("spark.sql.codegen.hugeMethodLimit", "8000")
        .config("spark.sql.parquet.compression.codec", "zstd")
        .config("spark.sql.parquet.mergeSchema", "false")
        .config("spark.sql.files.ignoreCorruptFiles", "false")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names for checkpoints; a local one only where none is named."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
    return os.path.join(tempfile.gettempdir(), "curbflow-checkpoints")


_SCRATCH: dict[str, list[str]] = {}


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder, remembered until ``clear_scratch``."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    _SCRATCH.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def clear_scratch(spark: SparkSession) -> int:
    """Delete what this session has put below the shared folder; frames that read it end with it."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    removed = 0
    for path in _SCRATCH.pop(spark.sparkContext.applicationId, []):
        target = hadoop(path)
        removed += target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
    return removed


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: the blocks live in the shared folder, so a lost executor loses none."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)
