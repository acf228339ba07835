"""Blocks of time as a stream: windowed counts under a watermark, and files that are ingested once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def block_counts(events: DataFrame, at: str, block: str, keys: list[str], late: str = "1 hour") -> DataFrame:
    """(block_start, keys, n) of tumbling blocks; rows later than the watermark allows do not count. Works on streams and tables."""
    timed = events.withColumn("_at", F.col(at).cast("timestamp"))
    if timed.isStreaming:
        timed = timed.withWatermark("_at", late)
    grouped = timed.groupBy(F.window("_at", block).alias("_w"), *keys).agg(F.count(F.lit(1)).alias("n"))
    return grouped.select(F.col("_w.start").alias("block_start"), *keys, "n")


def ingest(spark: SparkSession, source: str, schema: str, target: str, checkpoint: str, *, files_at_once: int = 8, partition_by: list[str] | None = None) -> StreamingQuery:
    """Append the files at source that were not ingested yet, a bounded number at once, and stop when none is left.

    The checkpoint remembers files and the sink commits whole batches, so a run that is cut
    off and started again neither loses nor repeats rows.
    """
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_at_once).parquet(source)
    writer = stream.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    return writer.start()
