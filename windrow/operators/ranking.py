"""Global order without one task that sees all rows: running sums, exact percentiles, histograms."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Distinct values of a range, on average, and the most ranges there are: their bounds and totals are all that one task or the driver gets.
ROWS, RANGES = 50_000, 4096
#: The most ranges of a key, where there are keys.
RANGES_OF_KEY = 1024


def place(bounds: Column, by: Column) -> Column:
    """How many of the rising bounds are at most by: those of every so manieth first, then those between, so that few of many are looked at."""
    step = F.greatest(F.lit(1), F.ceil(F.sqrt(F.size(bounds))).cast("int"))
    coarse = F.size(F.filter(F.sequence(F.lit(0), F.size(bounds) - 1, step), lambda i: F.get(bounds, i) <= by))
    low = (coarse - 1) * step
    fine = F.size(F.filter(F.slice(bounds, low + 1, step), lambda b: b <= by))
    return F.when(F.size(bounds) == 0, 0).when(coarse == 0, 0).otherwise(low + fine).cast("int")


def running(df: DataFrame, by: str, sums: dict[str, str], *, descending: bool = False, rows: int = ROWS) -> DataFrame:
    """df with running sums (new name -> column) up to and with each row, in order of the numeric column by.

    by must tell rows apart. Values are dealt to ranges of about so many rows, RANGES at most, by approximate quantiles; sums run
    within a range and start from the totals of the ranges before it.
    """
    steps = F.lit(np.arange(1, RANGES) / RANGES)
    row = df.agg(F.count(by).alias("n"), F.percentile_approx(by, steps, F.lit(4 * RANGES)).alias("fine")).first()
    ranges = max(1, min(RANGES, -(-row["n"] // rows)))
    bounds = sorted({float(row["fine"][k * RANGES // ranges - 1]) for k in range(1, ranges)})
    placed = df.withColumn("_range", place(F.lit(np.array(bounds)), F.col(by)) if bounds else F.lit(0))
    order = F.col(by).desc() if descending else F.col(by).asc()
    ranged = F.col("_range").desc() if descending else F.col("_range").asc()
    before = Window.orderBy(ranged).rowsBetween(Window.unboundedPreceding, -1)
    totals = placed.groupBy("_range").agg(*[F.sum(c).alias(f"_t_{n}") for n, c in sums.items()])
    totals = totals.select("_range", *[F.coalesce(F.sum(f"_t_{n}").over(before), F.lit(0)).alias(f"_b_{n}") for n in sums])
    within = Window.partitionBy("_range").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    out = placed.join(F.broadcast(totals), "_range")  # a row a range
    out = out.withColumns({n: F.col(f"_b_{n}") + F.sum(c).over(within) for n, c in sums.items()})
    return out.drop("_range", *[f"_b_{n}" for n in sums])


def percentiles(values: DataFrame, by: str, ps: list[float]) -> list[float | None]:
    """Exact percentiles of a numeric column, by linear interpolation, from counts of distinct values.

    Unlike an aggregate that buffers all values, no task holds more than a range of them. Nulls do not count.
    """
    counts = values.filter(F.col(by).isNotNull()).groupBy(F.col(by).alias("v")).agg(F.count(F.lit(1)).alias("n"))
    placed = running(counts, "v", {"upto": "n"})
    total = counts.agg(F.sum("n")).first()[0] or 0
    if not total:
        return [None for _ in ps]
    wanted = sorted({k for p in ps for k in (int((total - 1) * p), min(int((total - 1) * p) + 1, total - 1))})
    hit = [F.when((F.col("upto") - F.col("n") <= k) & (F.lit(k) < F.col("upto")), F.col("v")) for k in wanted]
    row = placed.agg(*[F.max(h).alias(f"k{k}") for h, k in zip(hit, wanted, strict=True)]).first()
    out = []
    for p in ps:
        k = int((total - 1) * p)
        low, high = float(row[f"k{k}"]), float(row[f"k{min(k + 1, total - 1)}"])
        out.append(low + (high - low) * ((total - 1) * p - k))
    return out


def same(a: DataFrame, b: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """a joined with b on equal keys, nulls equal nulls; the keys are a's."""
    right = b.withColumnsRenamed({k: f"_same_{k}" for k in keys})
    met = F.lit(True)
    for k in keys:
        met = met & F.col(k).eqNullSafe(F.col(f"_same_{k}"))
    joined = a.join(right, met, how)
    return joined if how in ("left_semi", "left_anti") else joined.drop(*[f"_same_{k}" for k in keys])


def running_by(df: DataFrame, keys: list[str], by: str, sums: dict[str, str], *, descending: bool = False, rows: int = ROWS) -> DataFrame:
    """df with running sums (new name -> column) within keys, in order of the numeric column by, and the keys' totals as name_of.

    by must tell the rows of a key apart. A key's values are dealt to ranges of about so many rows, RANGES_OF_KEY at most, by approximate
    quantiles, so that no task orders a whole large key, and small keys have one; sums start from the totals of the key's ranges before.
    """
    steps = F.lit(np.arange(1, RANGES_OF_KEY) / RANGES_OF_KEY)
    fine = df.groupBy(*keys).agg(F.count(by).alias("_rows"), F.percentile_approx(by, steps, F.lit(4 * RANGES_OF_KEY)).alias("_fine"))
    ranges = F.least(F.lit(RANGES_OF_KEY), F.ceil(F.col("_rows") / rows)).cast("int")
    chosen = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.col("_ranges") - 1)), lambda k: F.get("_fine", F.floor(k * RANGES_OF_KEY / F.col("_ranges")).cast("int") - 1))
    bounds = fine.withColumn("_ranges", ranges).select(*keys, F.when(F.col("_ranges") > 1, F.array_distinct(chosen)).otherwise(F.slice("_fine", 1, 0)).alias("_bounds"))
    placed = same(df, bounds, keys).withColumn("_range", F.coalesce(place(F.col("_bounds"), F.col(by)), F.lit(0))).drop("_bounds")
    ranged = F.col("_range").desc() if descending else F.col("_range").asc()
    own = Window.partitionBy(*keys)
    before = own.orderBy(ranged).rowsBetween(Window.unboundedPreceding, -1)
    totals = placed.groupBy(*keys, "_range").agg(*[F.sum(c).alias(f"_t_{n}") for n, c in sums.items()])
    totals = totals.select(*keys, "_range", *[F.coalesce(F.sum(f"_t_{n}").over(before), F.lit(0)).alias(f"_b_{n}") for n in sums], *[F.sum(f"_t_{n}").over(own).alias(f"{n}_of") for n in sums])
    within = Window.partitionBy(*keys, "_range").orderBy(F.col(by).desc() if descending else F.col(by).asc()).rowsBetween(Window.unboundedPreceding, 0)
    out = same(placed, totals, [*keys, "_range"])
    out = out.withColumns({n: F.col(f"_b_{n}") + F.sum(c).over(within) for n, c in sums.items()})
    return out.drop("_range", *[f"_b_{n}" for n in sums])


def counted(df: DataFrame, keys: list[str], by: str) -> DataFrame:
    """(keys, _v, _n): the distinct values of a numeric column and how often they occur. Nulls do not count."""
    return df.filter(F.col(by).isNotNull()).groupBy(*keys, F.col(by).cast("double").alias("_v")).agg(F.count(F.lit(1)).alias("_n"))


def quantiles(df: DataFrame, keys: list[str], by: str, ps: list[float]) -> DataFrame:
    """(keys, q: exact percentiles of by, by linear interpolation): one row without keys. Nulls do not count; a key without values has no row.

    From counts of distinct values in ranges: no task holds all values of a key.
    """
    return quantiles_of(counted(df, keys, by), keys, ps)


def quantiles_of(counts: DataFrame, keys: list[str], ps: list[float], *, rows: int = ROWS) -> DataFrame:
    """quantiles() from counted()."""
    placed = running_by(counts, keys, "_v", {"_upto": "_n"}, rows=rows)
    at = [(F.col("_upto_of") - 1) * F.lit(float(p)) for p in ps]
    hit = lambda k: F.max(F.when((F.col("_upto") - F.col("_n") <= k) & (k < F.col("_upto")), F.col("_v")))
    picked = [x for i, a in enumerate(at) for x in (hit(F.floor(a)).alias(f"_l{i}"), hit(F.ceil(a)).alias(f"_h{i}"))]
    out = placed.groupBy(*keys).agg(*picked, F.max("_upto_of").alias("_upto_of"))
    between = [F.col(f"_l{i}") + (F.col(f"_h{i}") - F.col(f"_l{i}")) * (a - F.floor(a)) for i, a in enumerate(at)]
    return out.select(*keys, F.array(*between).alias("q"))


def histogram(df: DataFrame, value: Column, keys: list[str], bins: int = 60) -> DataFrame:
    """(keys, bin, n, density): equal bins over each group's own range; the last bin is closed. A group of one value has it in bin 0."""
    rows = df.select(*keys, value.cast("double").alias("_v")).filter("_v is not null")
    spans = rows.groupBy(*keys).agg(F.min("_v").alias("_low"), F.max("_v").alias("_high"), F.count(F.lit(1)).alias("_all"))
    width = (F.col("_high") - F.col("_low")) / bins
    at = F.when(width > 0, F.least(F.floor((F.col("_v") - F.col("_low")) / F.nullif(width, F.lit(0.0))), F.lit(bins - 1))).otherwise(0).cast("int")
    joined = same(rows, spans, keys)
    counts = joined.groupBy(*keys, at.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.max(width).alias("_w"), F.max("_all").alias("_all"))
    return counts.select(*keys, "bin", "n", (F.col("n") / (F.col("_all") * F.nullif("_w", F.lit(0.0)))).alias("density"))
