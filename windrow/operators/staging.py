"""Tables that several passes read: written once in the folder that all executors share, deleted after use."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """A new name in the folder of spark.checkpoint.dir; a local master without one takes a temporary folder, a cluster must name one."""
    context = spark.sparkContext
    shared = context.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if shared is None:
        if not context.master.startswith("local") or "cluster" in context.master:
            raise ValueError("spark.checkpoint.dir names no folder that the executors share")
        shared = tempfile.mkdtemp(prefix="windrow-")
        context.setCheckpointDir(shared)
    return f"{shared}/windrow-{uuid.uuid4().hex}"


def remove(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


@contextmanager
def staged(df: DataFrame, partition_by: list[str] | None = None) -> Iterator[DataFrame]:
    """df as Parquet, with a folder for each value of partition_by, as long as the block lasts."""
    spark, path = df.sparkSession, folder(df.sparkSession)
    writer = df.write.partitionBy(*partition_by) if partition_by else df.write
    try:
        writer.parquet(path)
        yield spark.read.schema(df.schema).parquet(path)
    finally:
        remove(spark, path)
