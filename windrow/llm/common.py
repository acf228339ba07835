"""What the operators of this subpackage share: reading, staging and ranking."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Words as the contracts state them: runs of anything but ASCII white space.
TOKEN = r"[^\x20\x09-\x0D]+"
#: Spark's setting to delete a query's shuffle files when it ends.
CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_scratch = threading.local()
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Where none is set: a temporary one of our own on a local master, the warehouse on a cluster."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        own = tempfile.mkdtemp(prefix="windrow-") if context.master.startswith("local") and "cluster" not in context.master else f"{spark.conf.get('spark.sql.warehouse.dir')}/windrow"
        context.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", None) or own)
    return context.getCheckpointDir()


def _remove(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables staged within are deleted when the block ends, but for those staged with keep, which belong to the block around it."""
    blocks = _scratch.__dict__.setdefault("blocks", [])
    blocks.append([])
    try:
        yield
    finally:
        for path in blocks.pop():
            _remove(spark, path)


def stage(df: DataFrame, name: str, keep: bool = False) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: cuts the lineage, survives lost executors.

    Shuffle files of the write go when it is done. keep: the table outlives the innermost scratch().
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/windrow-{uuid.uuid4().hex}/{name}"
    before = spark.conf.get(CLEAN_UP, "false")
    spark.conf.set(CLEAN_UP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(CLEAN_UP, before)
    blocks = _scratch.__dict__.get("blocks", [])
    if len(blocks) > keep:
        blocks[-1 - keep].append(path.rpartition("/")[0])
    return spark.read.schema(df.schema).parquet(path)


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and nothing else; lower() where the text is ASCII, as it is cheaper."""
    return F.when(text.rlike(r"[^\x00-\x7F]"), F.translate(text, UPPER, LOWER)).otherwise(F.lower(text))


def global_rank(df: DataFrame, *order: Column) -> DataFrame:
    """df with rank (0, 1, ...) by a total order, without one task that sees all rows.

    A range sort deals the rows out in order; a row's rank is its place in its
    partition plus the rows of the partitions before it (one row a partition).
    """
    placed = stage(df.orderBy(*order).withColumn("_at", F.monotonically_increasing_id()), "ranked")
    placed = placed.withColumn("_part", F.shiftright("_at", 33))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    row = F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    return placed.join(parts.drop("_n"), "_part").withColumn("rank", F.col("_before") + row).drop("_part", "_before", "_at")


def text_key(text: Column) -> Column:
    """Tells rows apart that share a doc_id."""
    return F.xxhash64(text)
