"""Cutting lineage in the shared folder of the cluster."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


#: Called with every frame before it is written; tests look at the plans here.
WATCHERS: list[Callable[[DataFrame], None]] = []


def shared_dir(spark: SparkSession) -> str:
    """The checkpoint folder of the session, set from ``spark.checkpoint.dir``.

    Where it is unset, a local master (one process, as in tests) gets a temporary folder; any cluster, also
    one of local processes, must set it.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        configured = tempfile.mkdtemp(prefix="regionlens-")
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir()


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path below the shared folder, removed when the application ends."""
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(target.getParent())
    fs.deleteOnExit(target)
    return path


def written(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and continue from the files.

    Unlike a written RDD the files carry sizes and column statistics, so
    later joins are planned on real sizes and scans read only needed columns.
    A lost executor costs no recomputation.
    """
    for look in WATCHERS:
        look(df)
    spark = df.sparkSession
    path = scratch_path(spark, "step")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, key: str, buckets: int) -> DataFrame:
    """Write ``df`` to the shared folder in buckets of ``key`` and continue from the files.

    Joins and aggregates on ``key`` with as many partitions then leave these rows where they are and shuffle the other side
    only.  The rows are not shuffled to be written: each task adds to the buckets it has rows for.
    """
    for look in WATCHERS:
        look(df)
    spark = df.sparkSession
    name = f"bucketed_{uuid.uuid4().hex}"
    path = scratch_path(spark, "buckets")
    df.write.format("parquet").option("path", path).bucketBy(buckets, key).saveAsTable(name)
    # Spark knows buckets by its catalog only; what is read keeps them, and the files, when the name goes.
    out = spark.table(name)
    out.schema  # resolved now
    spark.sql(f"DROP TABLE {name}")
    return out
