"""Splits by class, caps, seeded orders and draws."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import hash_order
from ..operators import ranking, splits
from .tables import scored, table

HASH = "({key} + {seed}) * 2654435761 % 4294967296"


def stratified_split_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = splits.stratified(table(spark, sf_dir, "documents").select("doc_id", "lang"), "lang", "doc_id", {"train": 0.8}, "test")
    return rows.groupBy("lang", "split").agg(F.count(F.lit(1)).alias("n"), F.sum("doc_id").alias("ids"))


def three_way_split_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = splits.three_way(table(spark, sf_dir, "documents").select("doc_id", "lang"), "lang", "doc_id")
    return rows.groupBy("lang", "split").agg(F.count(F.lit(1)).alias("n"), F.sum("doc_id").alias("ids"))


def class_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.capped(table(spark, sf_dir, "documents").select("doc_id", "source"), "source", "doc_id", 20)


def random_nominal_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """85/15 of the rows up to the 95th percentile, in seeded order; the rest is test."""
    rows = scored(spark, sf_dir)
    bound = ranking.quantiles(rows, [], "score", [0.95]).select(F.col("q")[0].alias("p"))
    rows = rows.join(F.broadcast(bound)).withColumn("h", hash_order(F.col("doc_id"), 7) / F.lit(4294967296.0))
    split = F.when(F.col("score") > F.col("p"), "test").when(F.col("h") < 0.85, "train").otherwise("val")
    return rows.groupBy(split.alias("split")).agg(F.count(F.lit(1)).alias("n"), F.sum("doc_id").alias("ids"))


def weighted_time_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    segments = table(spark, sf_dir, "supplier").select(((F.col("s_suppkey") * 10000).cast("double")).alias("seg_start"), (F.col("s_suppkey") * 10000 + F.abs("s_acctbal")).alias("seg_end"))
    unit = lambda seed: hash_order(F.col("draw_id"), seed) / F.lit(4294967296.0)
    draws = spark.range(1, 501).select(F.col("id").alias("draw_id")).select("draw_id", unit(1).alias("u"), unit(100003).alias("v"))
    return splits.weighted_times(segments, draws, 64.0, 8.0).select("draw_id", F.round("seg_start", 3).alias("seg_start"), F.round("t0", 3).alias("t0"))


def jittered_starts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A window of 4 around each event, shifted by up to a quarter of its length."""
    rows = table(spark, sf_dir, "events").select("event_id", "value")
    shift = (hash_order(F.col("event_id"), 3) / F.lit(4294967296.0) - 0.5) * 2
    return rows.select("event_id", F.round(F.col("value") - 2.0 + shift, 6).alias("t0"))


def seeded_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The place of each order in a seeded shuffle of all, without one task that sees all."""
    rows = table(spark, sf_dir, "orders").select("o_orderkey", hash_order(F.col("o_orderkey"), 11).alias("h"), F.lit(1).alias("one"))
    return ranking.running(rows, "h", {"place": "one"}).select("o_orderkey", "place")


QUERIES = {f.__name__: f for f in (stratified_split_counts, three_way_split_counts, class_cap, random_nominal_split, weighted_time_sample, jittered_starts, seeded_order)}

_STRATA = f"h AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY {HASH.format(key='doc_id', seed=42)}, doc_id) AS n, count(*) OVER (PARTITION BY lang) AS c FROM documents)"
ORACLES = {
    "stratified_split_counts": f"WITH {_STRATA} SELECT lang, CASE WHEN n <= greatest(1, floor(c * 0.8)) THEN 'train' ELSE 'test' END AS split, count(*) AS n, sum(doc_id)::bigint AS ids FROM h GROUP BY 1, 2",
    "three_way_split_counts": f"""WITH {_STRATA} SELECT lang, CASE WHEN n <= greatest(1, floor(c * 0.7)) THEN 'train' WHEN n <= greatest(1, floor(c * 0.7)) + greatest(1, floor(c * 0.15)) THEN 'val' ELSE 'test' END AS split,
       count(*) AS n, sum(doc_id)::bigint AS ids FROM h GROUP BY 1, 2""",
    "class_cap": f"SELECT doc_id, source FROM documents QUALIFY row_number() OVER (PARTITION BY source ORDER BY {HASH.format(key='doc_id', seed=1234)}, doc_id) <= 20",
    "random_nominal_split": f"""WITH s AS (SELECT d.doc_id, n_chars::double AS score, {HASH.format(key='d.doc_id', seed=7)} / 4294967296.0::double AS h FROM documents d JOIN labels l ON l.doc_id = d.doc_id), p AS (SELECT quantile_cont(score, 0.95) AS p FROM s)
SELECT CASE WHEN score > p THEN 'test' WHEN h < 0.85 THEN 'train' ELSE 'val' END AS split, count(*) AS n, sum(doc_id)::bigint AS ids FROM s, p GROUP BY 1""",
    "weighted_time_sample": f"""WITH g AS (SELECT (s_suppkey * 10000)::double AS a, s_suppkey * 10000 + abs(s_acctbal) AS b FROM supplier),
l AS (SELECT a, f, sum(f) OVER (ORDER BY a) AS upto, sum(f) OVER () AS total FROM (SELECT a, greatest(0, b - a - 80) AS f FROM g) WHERE f > 0),
d AS (SELECT i AS draw_id, {HASH.format(key='i', seed=1)} / 4294967296.0::double AS u, {HASH.format(key='i', seed=100003)} / 4294967296.0::double AS v FROM range(1, 501) r(i))
SELECT draw_id, round(a, 3) AS seg_start, round(a + 8 + v * f, 3) AS t0 FROM d JOIN l ON u * total > upto - f AND u * total <= upto""",
    "jittered_starts": f"SELECT event_id, round(value - 2.0 + ({HASH.format(key='event_id', seed=3)} / 4294967296.0::double - 0.5) * 2, 6) AS t0 FROM events",
    "seeded_order": f"SELECT o_orderkey, row_number() OVER (ORDER BY {HASH.format(key='o_orderkey', seed=11)}) AS place FROM orders",
}
