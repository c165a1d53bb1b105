"""Intermediate tables in the shared folder the cluster names in ``spark.checkpoint.dir``.

A written table cuts the lineage, keeps column pruning and file statistics, and is
still there when an executor is lost.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def checkpoint_root(spark: SparkSession) -> str:
    """The shared scratch folder; a temporary one is made in local mode only."""
    context = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if root:
        if not context.getCheckpointDir():
            context.setCheckpointDir(root)
        return root
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="clientele-"))
    return context.getCheckpointDir()


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once as Parquet and return the table, free of its lineage."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path of its own below the shared scratch folder."""
    return f"{checkpoint_root(spark)}/{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"


def discard(table: DataFrame) -> None:
    """Delete the files of a materialised table that no later step reads."""
    spark = table.sparkSession
    root = checkpoint_root(spark)
    for name in {os.path.dirname(file) for file in table.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(name)
        if spark._jvm.org.apache.hadoop.fs.Path(root).toUri().getPath() in path.toUri().getPath():
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
