"""Views of the test tables that the queries share, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import micros

SECOND = 1_000_000
#: Length of a window, in microseconds.
DUR = 60 * SECOND


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def streamed(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table as a stream; streams read folders, so a table that is one file is picked from its own."""
    path = f"{sf_dir}/{name}.parquet"
    stream = spark.readStream.schema(spark.read.parquet(path).schema)
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    alone = where.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(where).isFile()
    return stream.option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir) if alone else stream.parquet(path)


def triggers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors as triggers: trigger_id, t, ifo, label, snr."""
    events = table(spark, sf_dir, "events").filter("event_type = 'error'")
    return events.select(F.col("event_id").alias("trigger_id"), micros(F.col("ts")).alias("t"), (F.col("user_id") % 2).alias("ifo"), F.concat(F.lit("c"), (F.col("user_id") % 5).cast("string")).alias("label"), F.col("value").alias("snr"))


def windows(spark: SparkSession, sf_dir: str, dur: int = DUR) -> DataFrame:
    """Clicks as windows: window_id, t0, dur, ifo, energy."""
    events = table(spark, sf_dir, "events").filter("event_type = 'click'")
    return events.select(F.col("event_id").alias("window_id"), micros(F.col("ts")).alias("t0"), F.lit(dur).cast("long").alias("dur"), (F.col("user_id") % 2).alias("ifo"), F.col("value").alias("energy"))


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with a quality label: doc_id, score, truth, lang, source."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("n_chars").cast("double").alias("score"), "lang", "source")
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("truth"))
    return docs.join(labels, "doc_id")


TRIG = """trig AS (SELECT event_id AS trigger_id, epoch_us(ts) AS t, user_id % 2 AS ifo, 'c' || (user_id % 5)::varchar AS label, value AS snr FROM events WHERE event_type = 'error')"""
WIN = f"""win AS (SELECT event_id AS window_id, epoch_us(ts) AS t0, {DUR}::bigint AS dur, user_id % 2 AS ifo, value AS energy FROM events WHERE event_type = 'click')"""
SCORED = """scored AS (SELECT d.doc_id, n_chars::double AS score, lang, source, quality AS truth FROM documents d JOIN labels l ON d.doc_id = l.doc_id)"""
#: The middle of the month that the events span, in microseconds.
MIDDLE = 1_705_276_800 * SECOND
