"""Session construction and lineage-cutting helpers."""

from __future__ import annotations

import os
import tempfile
import uuid
from contextlib import contextmanager

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession

# Settings every job relies on: UTC wall clock (the ledger has naive
# timestamps), ANSI arithmetic, AQE for runtime re-planning and skew splits.
REQUIRED_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # HotSpot never compiles a method of more than 8,000 bytes: a wide projection fused into one
    # would run interpreted. Above that limit the operators are compiled one by one instead.
    "spark.sql.codegen.hugeMethodLimit": "8000",
}


def build_session(master: str | None = None, shuffle_partitions: int = 8,
                  app_name: str = "kontor") -> SparkSession:
    """Local/test session. On a cluster use the cluster's session and call
    :func:`configure` on it instead."""
    builder = (
        SparkSession.builder.master(master or "local[8]")
        .appName(app_name)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for k, v in REQUIRED_CONF.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    configure(spark)
    return spark


# Sizing for large clusters (opt-in, see README): start with many shuffle
# partitions and let AQE coalesce them to ~128 MB each; split parquet scans at
# 256 MB; a partition 5x the median and above 256 MB counts as skewed and is
# split by the skew-join rule.
SCALE_CONF = {
    "spark.sql.adaptive.coalescePartitions.initialPartitionNum": "20000",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(128 << 20),
    "spark.sql.files.maxPartitionBytes": str(256 << 20),
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "5",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": str(256 << 20),
    "spark.sql.autoBroadcastJoinThreshold": str(64 << 20),
}


def configure(spark: SparkSession, for_scale: bool = False) -> SparkSession:
    """Apply the settings the jobs rely on; ``for_scale`` adds :data:`SCALE_CONF`."""
    for k, v in REQUIRED_CONF.items():
        spark.conf.set(k, v)
    if for_scale:
        for k, v in SCALE_CONF.items():
            spark.conf.set(k, v)
    checkpoint_dir(spark)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    A cluster has to name it. Only a local master, where driver and executors are one
    process, gets a scratch folder of its own when it is unset, once per application."""
    sc = spark.sparkContext
    path = sc.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        path = sc.getCheckpointDir()
    if not path:
        if not (sc.master or "").startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="kontor-ckpt-")
        try:
            spark.conf.set("spark.checkpoint.dir", path)
        except Exception:  # noqa: BLE001 -- some deployments refuse core keys at runtime
            pass
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(path)
    return path


def materialize(df: DataFrame, name: str | None = None) -> DataFrame:
    """Cut lineage of a result that several reports reuse.

    Reliable checkpoint into the shared checkpoint folder, so a lost executor
    re-reads the written files instead of recomputing the whole upstream plan."""
    checkpoint_dir(df.sparkSession)
    # persisted first, so writing the checkpoint does not compute the plan a second time
    cached = df.persist(StorageLevel.MEMORY_AND_DISK)
    out = cached.checkpoint(eager=True)
    cached.unpersist()
    return out


#: what a job shuffled is deleted when the job ends (otherwise once the JVM collects the plan, hours later or never)
DROP_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

ROW_GROUP = 32 << 20


@contextmanager
def shuffles_dropped(spark: SparkSession):
    """For writes: what is written is read from its files, so the disk need not hold the shuffles behind it beside
    those of the next step. (A plan that is run again all the same recomputes them.)"""
    was = spark.conf.get(DROP_SHUFFLES, None)
    spark.conf.set(DROP_SHUFFLES, "true")
    try:
        yield
    finally:
        if was is None:
            spark.conf.unset(DROP_SHUFFLES)
        else:
            spark.conf.set(DROP_SHUFFLES, was)


def landed(df: DataFrame, name: str = "table") -> DataFrame:
    """Write a result to the shared folder and read it back: computed once, with a size that the planner knows,
    so that a small table is broadcast from the start and nothing is shuffled to meet it."""
    path = scratch_path(df.sparkSession, f"{name}-{uuid.uuid4().hex}")
    with shuffles_dropped(df.sparkSession):
        # a writer buffers a row group on the heap, outside of what Spark accounts for: a quarter of the usual 128 MB a task
        df.write.option("compression", "zstd").option("parquet.block.size", ROW_GROUP).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def scratch_path(spark: SparkSession, name: str) -> str:
    return os.path.join(checkpoint_dir(spark), name)
