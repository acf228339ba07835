"""Labels of windows, what they add up to, and how often chance would match."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .joins import match_windows

NOISE, AMBIGUOUS = "noise", "ambiguous"


def class_ids(triggers: DataFrame) -> DataFrame:
    """(label, label_id): distinct labels but the reserved two, numbered by name from 0. Labels are few; one task orders them."""
    names = triggers.select("label").filter(F.col("label").isNotNull() & ~F.col("label").isin(NOISE, AMBIGUOUS)).distinct()
    return names.withColumn("label_id", (F.row_number().over(Window.orderBy("label")) - 1).cast("int"))


def label_windows(windows: DataFrame, triggers: DataFrame, keys: list[str], width: int) -> DataFrame:
    """windows with match_count, label, label_id: no trigger is noise (-1), one its label, several ambiguous (-2)."""
    met = match_windows(windows, triggers, keys, width)
    n = F.col("match_count")
    met = met.withColumn("label", F.when(n == 0, NOISE).when(n == 1, F.col("label")).otherwise(AMBIGUOUS))
    out = met.join(class_ids(triggers), "label", "left")  # Spark broadcasts it where it is seen to be small
    return out.withColumn("label_id", F.when(n == 0, -1).when(n == 1, F.coalesce("label_id", F.lit(-1))).otherwise(-2).cast("int"))


def label_counts(labelled: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, total, noise, ambiguous, labelled), with subtotals: a key that is summed over is null and has its bit set in level."""
    n = F.count(F.lit(1))
    noise, ambiguous = F.count_if(F.col("label") == NOISE), F.count_if(F.col("label") == AMBIGUOUS)
    out = labelled.rollup(*keys).agg(F.grouping_id().alias("level"), n.alias("total"), noise.alias("noise"), ambiguous.alias("ambiguous"))
    return out.withColumn("labelled", F.col("total") - F.col("noise") - F.col("ambiguous"))


def match_rates(matched: DataFrame, triggers: DataFrame, keys: list[str], unit: float = 1e6) -> DataFrame:
    """(keys, n_windows, n_triggers, n0, n1, n2, n3, mean_matches, expected_pct, observed_pct, ratio).

    matched has t0, dur, match_count. Chance is Poisson: triggers in [least t0, greatest t0 + dur), spread
    evenly over that span. The ratio is null where nothing is expected.
    """
    count = F.col("match_count")
    spans = matched.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_windows"),
        *[F.count_if(count == k).alias(f"n{k}") for k in range(3)],
        F.count_if(count >= 3).alias("n3"),
        F.avg(count).alias("mean_matches"),
        F.min("t0").alias("_low"),
        (F.max("t0") + F.max("dur")).alias("_high"),
        F.max("dur").alias("_dur"),
    )
    inside = triggers.filter("t is not null").join(spans.select(*keys, "_low", "_high"), keys).filter((F.col("t") >= F.col("_low")) & (F.col("t") < F.col("_high")))
    out = spans.join(inside.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_triggers")), keys, "left").fillna(0, ["n_triggers"])
    span = (F.col("_high") - F.col("_low")) / unit
    rate = F.when(span > 0, F.col("n_triggers") * F.col("_dur") / unit / F.nullif(span, F.lit(0.0))).otherwise(0.0)
    expected, observed = 100 * (1 - F.exp(-rate)), 100 * (1 - F.col("n0") / F.col("n_windows"))
    return out.select(*keys, "n_windows", "n_triggers", "n0", "n1", "n2", "n3", F.bround("mean_matches", 4).alias("mean_matches"), F.bround(expected, 6).alias("expected_pct"), F.bround(observed, 4).alias("observed_pct"), F.bround(observed / F.nullif(expected, F.lit(0.0)), 4).alias("ratio"))


def epoch_of(t: Column, start: int, end: int) -> Column:
    """a inside the closed span, b everywhere else."""
    return F.when(t.between(start, end), "a").otherwise("b")
