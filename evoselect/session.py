"""Spark session and scratch-location helpers.

Intermediate tables (binned dataset, generations, histories) are written
under the directory the cluster names in ``spark.checkpoint.dir``.  A
private directory is only chosen when that setting is absent, which is the
case for local tests.
"""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import SparkSession

_CHECKPOINT_KEY = "spark.checkpoint.dir"


def local_session(cores: int | str = "*", shuffle_partitions: int = 8,
                  app_name: str = "evoselect") -> SparkSession:
    """Session for tests and local benchmarks (UI off, AQE on, UTC)."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app_name)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_root(spark: SparkSession) -> str:
    """Shared scratch root: ``spark.checkpoint.dir`` if the cluster set it.

    Only when it is unset in local mode (tests) a private directory is created
    and registered, so ``DataFrame.checkpoint()`` works too.  On a cluster an
    unset folder is an error: each node would write to its own disk.
    """
    conf = spark.sparkContext.getConf()
    root = conf.get(_CHECKPOINT_KEY, None) or spark.conf.get(_CHECKPOINT_KEY, None)
    if not root:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError(f"set {_CHECKPOINT_KEY} to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="evoselect-ckpt-")
        atexit.register(shutil.rmtree, root, ignore_errors=True)
        spark.conf.set(_CHECKPOINT_KEY, root)
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(root)
    return root


def scratch_path(spark: SparkSession, *parts: str) -> str:
    """A fresh path below this application's folder in the shared root."""
    return os.path.join(_own_root(spark), uuid.uuid4().hex[:12], *parts)


def _own_root(spark: SparkSession) -> str:
    return os.path.join(checkpoint_root(spark), "evoselect", spark.sparkContext.applicationId)


def clear_scratch(spark: SparkSession) -> None:
    """Remove all that this application wrote to scratch.  For the end of a
    job: DataFrames that were built on it can't be read any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(_own_root(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def materialize(df, name: str = "stage"):
    """Write ``df`` as Parquet under the shared checkpoint root and read it
    back: cuts the lineage (a lost executor re-reads files instead of
    replaying the plan) and keeps later plans small."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
