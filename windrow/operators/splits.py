"""Train, validation and test: by time, by class, at random; caps and seeded samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.scalar import hash_order
from .joins import at_levels, levelled
from .ranking import quantiles, running, same

#: Ranges of the hash in which the rows of a key are numbered, as a power of two.
HASH_RANGES = 12


def temporal(df: DataFrame, at: str, *, train: float = 0.7, val: float = 0.85, excluded: Column | None = None, to_test: Column | None = None, times: DataFrame | None = None) -> DataFrame:
    """df with split: train up to the first percentile of all rows' times, val up to the second, then test.

    excluded rows have a split of their own, though they count for the percentiles; to_test rows are test whenever they are.
    times: a table with the same times that is cheaper to read.
    """
    bounds = quantiles(df if times is None else times, [], at, [train, val]).withColumnRenamed("q", "_p")
    split = F.when(F.col(at) <= F.col("_p")[0], "train").when(F.col(at) <= F.col("_p")[1], "val").otherwise("test")
    if to_test is not None:
        split = F.when(to_test, "test").otherwise(split)
    if excluded is not None:
        split = F.when(excluded, "excluded").otherwise(split)
    return df.join(F.broadcast(bounds)).withColumn("split", split).drop("_p")  # one row of bounds


def leakage(df: DataFrame, at: str) -> DataFrame:
    """One row: last train time, first test time, and whether all of train is before all of test; null if either is empty."""
    out = df.agg(F.max(F.when(F.col("split") == "train", F.col(at))).alias("last_train"), F.min(F.when(F.col("split") == "test", F.col(at))).alias("first_test"))
    return out.withColumn("ok", F.col("last_train") < F.col("first_test"))


def numbered(df: DataFrame, keys: list[str], key: str, seed: int) -> DataFrame:
    """df with _n, from 1, in seeded order within keys, and _all, the number of rows of the keys.

    Rows are numbered within ranges of their hash, from the counts of the ranges before: no task orders a whole key.
    """
    rows = df.withColumn("_hash", hash_order(F.col(key), seed)).withColumn("_range", F.shiftright("_hash", 32 - HASH_RANGES))
    own = Window.partitionBy(*keys)
    before = own.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy(*keys, "_range").agg(F.count(F.lit(1)).alias("_c"))
    counts = counts.select(*keys, "_range", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_before"), F.sum("_c").over(own).alias("_all"))
    place = F.row_number().over(Window.partitionBy(*keys, "_range").orderBy("_hash", key))
    return same(rows, counts, [*keys, "_range"]).withColumn("_n", F.col("_before") + place).drop("_hash", "_range", "_before")


def stratified(df: DataFrame, label: str, key: str, shares: dict[str, float], rest: str, seed: int = 42) -> DataFrame:
    """df with split: of each class the given shares, at least one row each, in seeded order, and the rest."""
    rows = numbered(df, [label], key, seed)
    upto, split = F.lit(0), None
    for name, share in shares.items():
        upto = upto + F.greatest(F.lit(1), F.floor(F.col("_all") * share))
        split = (F if split is None else split).when(F.col("_n") <= upto, name)
    return rows.withColumn("split", split.otherwise(rest)).drop("_n", "_all")


def three_way(df: DataFrame, label: str, key: str, seed: int = 42, least: int = 6) -> DataFrame:
    """70/15/15 by class; at random over all rows where the smallest class has fewer than least rows."""
    smallest = df.groupBy(label).count().agg(F.min("count")).first()[0] or 0
    if smallest >= least:
        return stratified(df, label, key, {"train": 0.7, "val": 0.15}, "test", seed)
    place = hash_order(F.col(key), seed) / F.lit(4294967296.0)
    return df.withColumn("split", F.when(place < 0.7, "train").when(place < 0.85, "val").otherwise("test"))


def capped(df: DataFrame, label: str, key: str, cap: int, seed: int = 1234) -> DataFrame:
    """At most cap rows of each class, in seeded order."""
    return numbered(df, [label], key, seed).filter(F.col("_n") <= cap).drop("_n", "_all")


def first_by_block(df: DataFrame, at: str, width: int, limit: int, keys: list[str], *, densest: bool = False) -> DataFrame:
    """The first limit rows of each of keys when blocks are visited in order of time, or the densest first, and rows of a block in order of time.

    Blocks are counted first; only rows of those that the limit reaches are ordered, block by block.
    """
    rows = df.withColumn("block", F.floor(F.col(at) / width) * width)
    counts = rows.groupBy(*keys, "block").agg(F.count(F.lit(1)).alias("_size"))
    order = [F.desc("_size"), F.asc("block")] if densest else [F.asc("block")]
    before = F.sum("_size").over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    counts = counts.select(*keys, "block", F.coalesce(before, F.lit(0)).alias("_before")).filter(F.col("_before") < limit)
    place = F.col("_before") + F.row_number().over(Window.partitionBy(*keys, "block").orderBy(F.asc(at)))
    return same(rows, counts, [*keys, "block"]).withColumn("_n", place).filter(F.col("_n") <= limit).drop("_n", "_before")


def weighted_times(segments: DataFrame, draws: DataFrame, dur: float, pad: float) -> DataFrame:
    """draws(draw_id, u, v) with seg_start and t0: a segment by its free length (u), then a start in it (v); u and v lie in [0, 1).

    Cumulated lengths come from running sums in ranges; segments meet draws in buckets of the mean
    length, longer ones in those of a higher level. Segments differ in seg_start.
    """
    free = F.greatest(F.lit(0.0), F.col("seg_end") - F.col("seg_start") - (dur + 2 * pad))
    lengths = segments.withColumn("_free", free).filter("_free > 0")
    row = lengths.agg(F.sum("_free").alias("total"), F.count(F.lit(1)).alias("n")).first()
    if not row["n"]:
        return draws.select("draw_id", F.lit(0.0).alias("seg_start"), F.lit(0.0).alias("t0")).limit(0)
    total, width = float(row["total"]), float(row["total"]) / row["n"]
    lengths = running(lengths, "seg_start", {"_upto": "_free"})
    spread = levelled(lengths, F.col("_upto") - F.col("_free"), F.col("_upto"), width)
    met = at_levels(draws.withColumn("_reached", F.col("u") * total), F.col("_reached"), spread, width).join(spread, ["_level", "_bucket"])
    met = met.filter((F.col("_reached") > F.col("_upto") - F.col("_free")) & (F.col("_reached") <= F.col("_upto")))
    return met.select("draw_id", "seg_start", (F.col("seg_start") + pad + F.col("v") * F.col("_free")).alias("t0"))
