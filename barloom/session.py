"""Session helpers shared by tests, bench and jobs."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"
LOCAL_CONF = "barloom.local.dir"
CLEANUP_CONF = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def local_session(cpus: int | str = 8, shuffle_partitions: int = 8) -> SparkSession:
    """Session for tests and bench; a cluster brings its own settings."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("barloom")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.extraJavaOptions", "-XX:+UseParallelGC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach: the cluster's checkpoint folder.

    Only where the session names none and runs on one machine (tests) a
    temporary folder is made and recorded in the session, so later calls find
    the same one; on a cluster it would be another folder on each machine.
    """
    base = spark.conf.get(CHECKPOINT_CONF, None)
    if not base:
        base = spark.conf.get(LOCAL_CONF, None)
    if not base:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError(f"{CHECKPOINT_CONF} must name a folder that all executors share")
        base = tempfile.mkdtemp(prefix="barloom-")
        spark.conf.set(LOCAL_CONF, base)
    return base


def ship_package(spark: SparkSession) -> None:
    """Give the executors this package, once per Spark application.

    Python workers import what a task names; on a cluster, or when the driver
    runs in another folder, the package is not on their path.
    """
    sc = spark.sparkContext
    name = f"barloom-{sc.applicationId}.zip"
    if any(f.endswith(name) for f in sc.listFiles):
        return
    root = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="barloom-ship-"), name)
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(root):
            for n in names:
                if n.endswith(".py"):
                    full = os.path.join(folder, n)
                    z.write(full, os.path.join("barloom", os.path.relpath(full, root)))
    sc.addPyFile(path)


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new, unused path below the shared folder."""
    return os.path.join(shared_dir(spark), f"{label}-{uuid.uuid4().hex}")


def cut_lineage(df, label: str = "stage"):
    """Write `df` once and read it back, so that branches share one computation.

    The written table outlives a lost executor, unlike cached blocks.
    """
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def without_old_shuffles(spark: SparkSession) -> Iterator[None]:
    """Tables written inside leave no shuffle files; else those stay until the driver happens to collect its garbage."""
    before = spark.conf.get(CLEANUP_CONF, None)
    spark.conf.set(CLEANUP_CONF, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(CLEANUP_CONF)
        else:
            spark.conf.set(CLEANUP_CONF, before)
