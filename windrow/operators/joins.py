"""Joins by time: interval, nearest, tolerance, containment; and joins against what is done."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec


#: A level's buckets are so many times as wide as those of the level below.
STEP = 4


def levelled(df: DataFrame, first: Column, last: Column, width: float) -> DataFrame:
    """df with _level and _bucket: an interval [first, last] lies in the level whose buckets are no shorter than it, and there in one bucket or two.

    Level 0 has buckets of the given width. So no interval is repeated more than twice, however long it is (it would take one of more than
    width * STEP^24 to be). Intervals with a null bound have no row.
    """
    level = F.greatest(F.lit(0), F.least(F.lit(24), F.ceil(F.log(F.greatest((last - first + 1) / F.lit(width), F.lit(1.0))) / math.log(STEP) - 1e-9))).cast("int")
    placed = df.withColumns({"_level": level, "_first": first, "_last": last}).withColumn("_size", _size(F.col("_level"), width))
    buckets = F.sequence(F.floor(F.col("_first") / F.col("_size")), F.floor(F.greatest(F.col("_last"), F.col("_first")) / F.col("_size")))
    return placed.withColumn("_bucket", F.explode(buckets)).drop("_first", "_last", "_size")


def _size(level: Column, width: float) -> Column:
    return F.lit(float(width)) * F.pow(F.lit(float(STEP)), level)


def at_levels(points: DataFrame, at: Column, intervals: DataFrame, width: float) -> DataFrame:
    """points with _level and _bucket, a row for each level that has intervals (from levelled()); the levels are a subquery of at most 25 numbers."""
    used = intervals.agg(F.collect_set("_level").alias("levels")).scalar()
    return points.withColumn("_level", F.explode(used)).withColumn("_bucket", F.floor(at / _size(F.col("_level"), width)))


def interval_join(windows: DataFrame, points: DataFrame, start: str, end: str, at: str, keys: list[str], width: int, *, how: str = "left") -> DataFrame:
    """Rows of windows with the points in [start, end): an equi-join on keys, level and time bucket; width: that of the shortest buckets.

    A window is in one level, and in a bucket or two of it, a point in one bucket of each level that has windows, so no match is made
    twice and a window of any length adds a row at most. Columns but the keys must differ. how: left keeps windows without points, once; inner does not.
    """
    bucketed = levelled(windows, F.col(start), F.col(end) - 1, width)
    right = at_levels(points, F.col(at), bucketed, width)
    met = bucketed.join(right, [*keys, "_level", "_bucket"]).filter((F.col(at) >= F.col(start)) & (F.col(at) < F.col(end))).drop("_level", "_bucket")
    if how == "inner":
        return met
    ids = [c for c in windows.columns if c not in keys]
    own = windows.withColumn("_w", F.struct(*windows.columns))
    none = own.join(met.select(F.struct(*windows.columns).alias("_w")).distinct(), "_w", "left_anti").select(*windows.columns)
    return met.select(*keys, *ids, *[c for c in points.columns if c not in keys]).unionByName(none, allowMissingColumns=True)


def match_windows(windows: DataFrame, triggers: DataFrame, keys: list[str], width: int) -> DataFrame:
    """windows(window_id, t0, dur, keys) with match_count and label of the earliest trigger(t, label, keys) in [t0, t0 + dur).

    Windows without a trigger stay, with 0 and null. Triggers without time or label do not count.
    """
    known = triggers.filter("t is not null and label is not null").select(*keys, F.col("t").alias("_t"), F.col("label").alias("_label"))
    slim = windows.select(*keys, "window_id", "t0", (F.col("t0") + F.col("dur")).alias("_end"))
    met = interval_join(slim, known, "t0", "_end", "_t", keys, width, how="inner")
    found = met.groupBy("window_id").agg(F.count(F.lit(1)).alias("match_count"), F.min(F.struct("_t", "_label")).alias("_first"))
    out = windows.join(found, "window_id", "left")
    return out.withColumns({"match_count": F.coalesce("match_count", F.lit(0)), "label": F.col("_first._label")}).drop("_first")


def nearest(left: DataFrame, right: DataFrame, at: str, of: str, tolerance: int, keys: list[str], *, closed: bool = True) -> DataFrame:
    """left with the struct match: the nearest row of right within the tolerance; of two as near, the earlier one, of two at one time the least.

    closed: whether a distance equal to the tolerance counts. Times of left and rows of right are put in order within buckets of
    twice the tolerance, where each time takes the last row up to it and the first after it: no pairs are made, and no side is ever ordered whole.
    """
    width = 2 * tolerance + 1
    bucket = lambda c: F.floor(c / width)
    times, rows = _times(left, at, keys), _rows(right, of, keys, F.struct(*right.columns))
    asked = times.select(*keys, "_at", F.explode(F.array_distinct(F.array(bucket(F.col("_at") - tolerance), bucket(F.col("_at") + tolerance)))).alias("_bucket"))
    both = rows.withColumn("_bucket", bucket(F.col("_at"))).unionByName(asked, allowMissingColumns=True)
    # of equal times rows come before those that ask, from either end
    last = F.max(F.when(F.col("_row").isNotNull(), F.struct("_at", "_row"))).over(_up_to(keys))
    first = F.min(F.when(F.col("_row").isNotNull(), F.struct("_at", "_row"))).over(_down_to(keys))
    seen = both.withColumns({"_last": last, "_first": first}).filter("_row is null")
    gap = lambda c: F.abs(F.col(f"{c}._at") - F.col("_at"))
    near = lambda c: F.when(gap(c) <= tolerance if closed else gap(c) < tolerance, F.struct(gap(c).alias("gap"), F.col(f"{c}._at").alias("of"), F.col(f"{c}._row").alias("row")))
    best = seen.groupBy(*keys, "_at").agg(F.min(F.least(near("_last"), near("_first")))["row"].alias("match"))
    return _matched(left, best, at, keys)


def exact_then_tolerance(left: DataFrame, right: DataFrame, at: str, of: str, tolerance: int, keys: list[str], file_order: str) -> DataFrame:
    """left with match: the row of right with the same time, else the first in file order that is nearer than the tolerance.

    A time that right repeats keeps its first place and its last row. Buckets are as long as the reach of a time, which so lies in the end
    of one and the beginning of the next: the first of these two are running minima, and no pairs are made.
    """
    bucket = F.floor(F.col("_at") / (2 * tolerance)) if tolerance > 0 else F.lit(0)
    row = F.struct(F.min(file_order).alias("_place"), F.max_by(F.struct(*right.columns), F.struct(file_order)).alias("_r"))
    rows = _rows(right.filter(F.lit(tolerance > 0)), of, keys, row, whole=True)
    rows = rows.withColumns({"_row": F.struct("_row._place", F.struct("_row._r.*", "_row._place").alias("match")), "_bucket": bucket})
    asked = _times(left, at, keys).withColumn("_asks", F.col("_at")).withColumn("_at", F.col("_asks") - tolerance).withColumn("_bucket", bucket)
    asked = asked.withColumn("_end", F.explode(F.array(F.lit(0), F.lit(1)))).withColumns({"_at": F.col("_at") + F.col("_end") * 2 * tolerance, "_bucket": F.col("_bucket") + F.col("_end")})
    both = rows.unionByName(asked, allowMissingColumns=True)
    # a row as far as the tolerance does not count: of equal times those that ask come before rows, from either end
    seen = both.withColumns({"_to": F.min("_row").over(_up_to(keys, False)), "_from": F.min("_row").over(_down_to(keys, False))}).filter("_asks is not null")
    found = seen.groupBy(*keys, F.col("_asks").alias("_at")).agg(F.min(F.when(F.col("_end") == 1, F.col("_to")).otherwise(F.col("_from")))["match"].alias("_near"))
    best = found.join(rows, [*keys, "_at"], "left").select(*keys, "_at", F.coalesce("_row.match", "_near").alias("match"))
    return _matched(left, best, at, keys)


def _times(left: DataFrame, at: str, keys: list[str]) -> DataFrame:
    return left.select(*keys, F.col(at).alias("_at")).dropna().distinct()


def _rows(right: DataFrame, of: str, keys: list[str], row: Column, *, whole: bool = False) -> DataFrame:
    """(keys, _at, _row): one row for each time; row is of a single row, whole: an aggregate."""
    known = right.filter(F.col(of).isNotNull()).dropna(subset=keys)
    return known.groupBy(*keys, F.col(of).alias("_at")).agg((row if whole else F.min(row)).alias("_row"))


def _up_to(keys: list[str], closed: bool = True) -> WindowSpec:
    """Rows of a bucket up to a time, with those of the time itself if closed."""
    return Window.partitionBy(*keys, "_bucket").orderBy("_at", F.col("_row").isNull() if closed else F.col("_row").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)


def _down_to(keys: list[str], closed: bool = True) -> WindowSpec:
    """Rows of a bucket from a time on, the last first."""
    return Window.partitionBy(*keys, "_bucket").orderBy(F.desc("_at"), F.col("_row").isNull() if closed else F.col("_row").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)


def _matched(left: DataFrame, best: DataFrame, at: str, keys: list[str]) -> DataFrame:
    """left with the match of its keys and time."""
    theirs = best.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_at").alias("_k"), "match")
    same = F.col(at) == F.col("_k")
    for i, k in enumerate(keys):
        same = same & (F.col(k) == F.col(f"_k{i}"))
    return left.join(theirs, same, "left").select(*left.columns, "match")


def rounded_member(left: DataFrame, right: DataFrame, at: Column, of: Column, places: int) -> DataFrame:
    """left with member: whether its time, rounded, is among right's."""
    keys = right.select(F.bround(of, places).alias("_key")).distinct().withColumn("_in", F.lit(True))
    own = left.withColumn("_key", F.bround(at, places))
    return own.join(keys, "_key", "left").withColumn("member", F.coalesce("_in", F.lit(False))).drop("_key", "_in")


def contained(windows: DataFrame, segments: DataFrame, start: str, end: str, pad: int, keys: list[str], width: int) -> DataFrame:
    """windows whose [start - pad, end + pad] lies within one of segments(seg_start, seg_end), which are dealt to the buckets of their level."""
    right = levelled(segments.select(*keys, "seg_start", "seg_end"), F.col("seg_start"), F.col("seg_end"), width)
    own = windows.withColumn("_w", F.struct(*windows.columns))
    left = own.select("_w", *keys, (F.col(start) - pad).alias("_a"), (F.col(end) + pad).alias("_b"))
    met = at_levels(left, F.col("_a"), right, width).join(right, [*keys, "_level", "_bucket"]).filter((F.col("seg_start") <= F.col("_a")) & (F.col("_b") <= F.col("seg_end")))
    return own.join(met.select("_w").distinct(), "_w", "left_semi").drop("_w")


def pending(jobs: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """jobs that are not done."""
    return jobs.join(done.select(*keys).distinct(), keys, "left_anti")


def looked_up(df: DataFrame, column: str, pairs: dict[str, object], out: str, default: object) -> DataFrame:
    """df with out: the value of a small fixed table, else default."""
    table = F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])
    return df.withColumn(out, F.coalesce(F.try_element_at(table, F.col(column)), F.lit(default)))


def keep_last(df: DataFrame, keys: list[Column], order: Column) -> DataFrame:
    """Of rows with equal keys the last."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(order.desc()))).filter("_n = 1").drop("_n")


def keep_first(df: DataFrame, keys: list[Column], order: Column) -> DataFrame:
    """Of rows with equal keys the first."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(order.asc()))).filter("_n = 1").drop("_n")
