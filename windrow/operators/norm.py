"""Normalisation by global and grouped percentiles, blends, and checks of arrays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import array_sum, array_variance, scaled
from .ranking import counted, quantiles, quantiles_of, same


def group_bounds(train: DataFrame, everything: DataFrame, group: list[str], features: list[str], low: float = 0.02, high: float = 0.98) -> DataFrame:
    """(group, feature_lo, feature_hi, ...): percentiles of the training rows of each group of everything; a group without any gets the global ones.

    All features are counted in one pass, and the counts of all groups are the sums of those of each.
    """
    values = F.array(*[F.struct(F.lit(k).alias("_f"), F.col(f).cast("double").alias("_x")) for k, f in enumerate(features)])
    long = train.select(*group, F.inline(values))
    counts = counted(long, [*group, "_f"], "_x")
    whole = quantiles_of(counts.groupBy("_f", "_v").agg(F.sum("_n").alias("_n")), ["_f"], [low, high])
    own = quantiles_of(counts, [*group, "_f"], [low, high])
    wide = lambda df, keys, name: df.groupBy(*keys).agg(*[F.max(F.when(F.col("_f") == k, F.col("q"))).alias(f"{name}{k}") for k in range(len(features))])
    out = same(everything.select(*group).distinct(), wide(own, group, "_g"), group, "left").join(F.broadcast(wide(whole, [], "_a")), how="left")  # one row of global bounds
    return out.select(*group, *[F.coalesce(f"_g{i}", f"_a{i}")[k].alias(f"{f}_{n}") for i, f in enumerate(features) for k, n in enumerate(("lo", "hi"))])


def normalised(df: DataFrame, bounds: DataFrame, group: list[str], features: list[str]) -> DataFrame:
    """df with its features scaled by the bounds of their group; the bounds are a row a group."""
    out = same(df, bounds, group)
    return out.withColumns({f: scaled(F.col(f), F.col(f"{f}_lo"), F.col(f"{f}_hi")) for f in features}).drop(*[f"{f}_{n}" for f in features for n in ("lo", "hi")])


def min_max(df: DataFrame, features: list[str]) -> DataFrame:
    """df with its features as (x - min) / (max - min); a span below 1e-12 counts as 1."""
    spans = df.agg(*[F.min(f).alias(f"_l_{f}") for f in features], *[F.max(f).alias(f"_h_{f}") for f in features])
    span = lambda f: F.col(f"_h_{f}") - F.col(f"_l_{f}")
    out = df.join(F.broadcast(spans))
    return out.withColumns({f: (F.col(f) - F.col(f"_l_{f}")) / F.when(span(f) < 1e-12, 1.0).otherwise(span(f)) for f in features}).drop(*spans.columns)


def blended(df: DataFrame, a: str, b: str, alpha: float = 0.7) -> DataFrame:
    """df with score: alpha of a and 1 - alpha of b, each scaled to the table's own range."""
    spans = df.agg(*[F.min(c).alias(f"_l_{c}") for c in (a, b)], *[F.max(c).alias(f"_h_{c}") for c in (a, b)])
    part = lambda c: (F.col(c) - F.col(f"_l_{c}")) / (F.col(f"_h_{c}") - F.col(f"_l_{c}") + F.lit(1e-8))
    return df.join(F.broadcast(spans)).withColumn("score", alpha * part(a) + (1 - alpha) * part(b)).drop(*spans.columns)


def up_to_percentile(df: DataFrame, value: str, p: float = 0.95, keys: list[str] | None = None) -> DataFrame:
    """Rows whose value is at most the percentile of all rows, or of those with the same keys."""
    bound = quantiles(df, keys or [], value, [p])
    out = same(df, bound, keys) if keys else df.join(F.broadcast(bound))
    return out.filter(F.col(value) <= F.col("q")[0]).drop("q")


def sanity(df: DataFrame, xs: Column, energy: Column, at: Column, low: float, high: float) -> DataFrame:
    """One row: NaN and infinite pixels, rows out of [-0.1, 1.1], null or NaN energies, times out of [low, high], flat rows, and the verdict."""
    bad = lambda test: F.sum(F.size(F.filter(xs, test)))
    inf = float("inf")
    out = df.agg(
        F.count(F.lit(1)).alias("n"),
        F.coalesce(bad(lambda x: F.isnan(x)), F.lit(0)).cast("long").alias("nan_pixels"),
        F.coalesce(bad(lambda x: F.abs(x) == inf), F.lit(0)).cast("long").alias("inf_pixels"),
        F.count_if(F.exists(xs, lambda x: (x < -0.1) | (x > 1.1))).alias("out_of_range"),
        F.count_if(energy.isNull() | F.isnan(energy)).alias("bad_energy"),
        F.count_if((at < low) | (at > high)).alias("bad_time"),
        F.count_if(array_variance(xs) < 1e-6).alias("flat"),
    )
    failed = (F.col("nan_pixels") > 0) | (F.col("inf_pixels") > 0) | (F.col("bad_energy") > 0)
    warned = (F.col("out_of_range") > 0) | (F.col("bad_time") > 0) | (F.col("flat") > 0.05 * F.col("n"))
    return out.withColumn("verdict", F.when(failed, "fail").when(warned, "warn").otherwise("ok"))


def clipped_share(xs: Column, low: float, high: float) -> Column:
    """Percentage of an array's numbers outside [low, high]."""
    return 100 * array_sum(F.transform(xs, lambda x: ((x < low) | (x > high)).cast("double"))) / F.nullif(F.size(xs), F.lit(0))
