"""Evaluation: ROC and precision curves, confusion, per-class figures, variance ratios, weights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import f_tail
from .ranking import quantiles, running, running_by, same


def by_score(df: DataFrame, score: str, label: str, keys: list[str] | None = None) -> DataFrame:
    """(keys, score, pos, neg): a row for each distinct score."""
    positive = F.count_if(F.col(label) == 1)
    return df.filter(F.col(score).isNotNull() & F.col(label).isNotNull()).groupBy(*(keys or []), F.col(score).cast("double").alias("score")).agg(positive.alias("pos"), (F.count(F.lit(1)) - positive).alias("neg"))


def curve(df: DataFrame, score: str, label: str, keys: list[str] | None = None) -> DataFrame:
    """by_score with tp, fp (rows at or above the score) and n_pos, n_neg, of all rows or of those with the same keys."""
    counts = by_score(df, score, label, keys)
    if keys:
        rows = running_by(counts, keys, "score", {"tp": "pos", "fp": "neg"}, descending=True)
        return rows.withColumnsRenamed({"tp_of": "n_pos", "fp_of": "n_neg"})
    totals = counts.agg(F.coalesce(F.sum("pos"), F.lit(0)).alias("n_pos"), F.coalesce(F.sum("neg"), F.lit(0)).alias("n_neg"))
    return running(counts, "score", {"tp": "pos", "fp": "neg"}, descending=True).join(F.broadcast(totals))


def auroc(df: DataFrame, score: str, label: str, keys: list[str] | None = None) -> DataFrame:
    """(keys, n_pos, n_neg, auroc): null where a class is empty. Ties count half."""
    points = curve(df, score, label, keys)
    area = F.sum(F.col("neg") * (F.col("tp") - F.col("pos") / 2))
    out = points.groupBy(*(keys or [])).agg(F.max("n_pos").alias("n_pos"), F.max("n_neg").alias("n_neg"), area.alias("_area"))
    return out.select(*(keys or []), "n_pos", "n_neg", F.try_divide("_area", F.col("n_pos") * F.col("n_neg")).alias("auroc"))


def average_precision(df: DataFrame, score: str, label: str) -> DataFrame:
    """One row: the sum over thresholds of the gain in recall times the precision."""
    gain = F.col("pos") / F.nullif("n_pos", F.lit(0)) * F.col("tp") / (F.col("tp") + F.col("fp"))
    return curve(df, score, label).agg(F.sum(gain).alias("average_precision"))


def roc(df: DataFrame, score: str, label: str) -> DataFrame:
    """(threshold, fpr, tpr) of every distinct score; the start (0, 0) has a null threshold."""
    points = curve(df, score, label).select(F.col("score").alias("threshold"), F.try_divide(F.col("fp"), F.col("n_neg")).alias("fpr"), F.try_divide(F.col("tp"), F.col("n_pos")).alias("tpr"))
    start = df.sparkSession.range(1).select(F.lit(None).cast("double").alias("threshold"), F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr"))
    return start.union(points)


def tpr_at_fpr(points: DataFrame, target: float = 0.01) -> DataFrame:
    """One row: tpr at the target, interpolated between the last point below it and the first at or above it."""
    below = F.max(F.when(F.col("fpr") < target, F.struct("fpr", "tpr")))
    above = F.min(F.when(F.col("fpr") >= target, F.struct("fpr", "tpr")))
    at = points.agg(below.alias("a"), above.alias("b"))
    slope = (F.col("b.tpr") - F.col("a.tpr")) * (F.lit(target) - F.col("a.fpr")) / (F.col("b.fpr") - F.col("a.fpr") + F.lit(1e-12))
    return at.select(F.when(F.col("a").isNull(), F.col("b.tpr")).when(F.col("b").isNull(), F.col("a.tpr")).otherwise(F.col("a.tpr") + slope).alias("tpr"))


def confusion(df: DataFrame, truth: str, predicted: str, classes: DataFrame) -> DataFrame:
    """(truth, predicted, n), dense: classes(c) are few, so all their pairs are kept."""
    counts = df.groupBy(F.col(truth).alias("truth"), F.col(predicted).alias("predicted")).agg(F.count(F.lit(1)).alias("n"))
    dense = classes.select(F.col("c").alias("truth")).join(F.broadcast(classes.select(F.col("c").alias("predicted"))))
    return dense.join(counts, ["truth", "predicted"], "left").select("truth", "predicted", F.coalesce("n", F.lit(0)).alias("n"))


def per_class(matrix: DataFrame) -> DataFrame:
    """(c, precision, recall, f1, support) from confusion()."""
    each = matrix.select(F.explode(F.array(F.struct(F.col("truth").alias("c"), "n", F.lit(0).cast("long").alias("of_pred"), (F.col("truth") == F.col("predicted")).alias("hit")), F.struct(F.col("predicted").alias("c"), F.lit(0).cast("long").alias("n"), F.col("n").alias("of_pred"), F.lit(False).alias("hit")))).alias("x")).select("x.*")
    out = each.groupBy("c").agg(F.sum(F.when(F.col("hit"), F.col("n")).otherwise(0)).alias("tp"), F.sum("n").alias("support"), F.sum("of_pred").alias("_pred"))
    p, r = F.col("tp") / F.greatest("_pred", F.lit(1)), F.col("tp") / F.greatest("support", F.lit(1))
    return out.select("c", p.alias("precision"), r.alias("recall"), (2 * p * r / F.greatest(p + r, F.lit(1e-9))).alias("f1"), "support")


def summary(classes: DataFrame) -> DataFrame:
    """One row from per_class(): accuracy, macro_f1 of classes with support, macro_f1_all of all."""
    hits = F.sum(F.col("recall") * F.col("support"))
    return classes.agg(F.try_divide(hits, F.sum("support")).alias("accuracy"), F.avg(F.when(F.col("support") > 0, F.col("f1"))).alias("macro_f1"), F.avg("f1").alias("macro_f1_all"))


def score_by_class(df: DataFrame, label: str, score: str, least: int = 1) -> DataFrame:
    """(label, n, mean, std) of the classes with least rows or more."""
    out = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"), F.avg(score).alias("mean"), F.stddev_pop(score).alias("std"))
    return out.filter(F.col("n") >= least)


def anova_f(df: DataFrame, label: str, features: list[str]) -> DataFrame:
    """(feature, f, between, within, p): variance between classes over variance within them, its degrees of freedom, and the probability of a greater ratio by chance."""
    long = df.select(label, F.explode(F.create_map(*[x for f in features for x in (F.lit(f), F.col(f).cast("double"))])).alias("feature", "x")).filter("x is not null")
    per = long.groupBy("feature", label).agg(F.count(F.lit(1)).alias("n"), F.avg("x").alias("m"), F.var_pop("x").alias("v"))
    whole = per.groupBy("feature").agg(F.sum("n").alias("_n"), F.count(F.lit(1)).alias("_k"), (F.sum(F.col("n") * F.col("m")) / F.sum("n")).alias("_m"))
    each = per.join(F.broadcast(whole), "feature")  # a row a feature
    out = each.groupBy("feature").agg(F.sum(F.col("n") * (F.col("m") - F.col("_m")) * (F.col("m") - F.col("_m"))).alias("b"), F.sum(F.col("n") * F.col("v")).alias("w"), F.max("_n").alias("_n"), F.max("_k").alias("_k"))
    out = out.select("feature", (F.try_divide(F.col("b"), F.col("_k") - 1) / (F.try_divide(F.col("w"), F.col("_n") - F.col("_k")) + F.lit(1e-12))).alias("f"), (F.col("_k") - 1).alias("between"), (F.col("_n") - F.col("_k")).alias("within"))
    return out.withColumn("p", f_tail(F.col("f"), F.col("between"), F.col("within")))


#: Bounds of what a score is worth, best first; below the last it is weak.
BANDS = {"strong": 0.85, "fair": 0.7}


def band(x: Column, bands: dict[str, float] = BANDS) -> Column:
    """The first band whose bound x exceeds, else weak; null for a null."""
    out = F.when(x.isNull(), F.lit(None).cast("string"))
    for name, bound in bands.items():
        out = out.when(x > bound, name)
    return out.otherwise("weak")


def verdict(df: DataFrame, scores: dict[str, str], label: str) -> DataFrame:
    """One row: the area under the curve of each score (new name -> column), the best of them and of the first's inverse, and its band."""
    out = None
    for name, column in scores.items():
        own = auroc(df, column, label).select(F.col("auroc").alias(name))
        out = own if out is None else out.join(F.broadcast(own))  # one row each
    first = F.col(next(iter(scores)))
    return out.withColumn("best", F.greatest(*[F.col(n) for n in scores], 1 - first)).withColumn("band", band(F.col("best")))


def weighted_mean(value: str, weight: str) -> Column:
    """Aggregate: the mean of value by weight; null where the weights add up to 0. Rows that lack either do not count."""
    both = F.col(value).isNotNull() & F.col(weight).isNotNull()
    total = F.sum(F.when(both, F.col(weight)))
    return F.when(total != 0, F.sum(F.when(both, F.col(value) * F.col(weight))) / total)


def hours(seconds: str) -> Column:
    """Aggregate: hours that add up."""
    return F.sum(seconds) / 3600


def positive_weight(positive: Column, negative: Column) -> Column:
    """Aggregate: negative rows for each positive one; null without positive ones."""
    return F.try_divide(F.count_if(negative), F.count_if(positive))


def entry_checks(df: DataFrame, label: str, expected: int | None = None) -> DataFrame:
    """One row: rows, rows with a null or blank label, classes, whether the rows are as many as expected, and the verdict; a fail names what is wrong first."""
    out = df.agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.coalesce(F.trim(label), F.lit("")) == "").alias("empty_labels"),
        F.count_distinct(F.when(F.trim(label) != "", F.col(label))).alias("classes"),
    )
    out = out.withColumn("as_expected", F.lit(True) if expected is None else F.col("n") == expected)
    return out.withColumn("verdict", F.when(~F.col("as_expected"), "length_mismatch").when(F.col("empty_labels") > 0, "empty_labels").otherwise("ok"))


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """(label, n, balanced, rescaled): N / (K n), and 1 / n scaled to add up to K."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    whole = counts.agg(F.sum("n").alias("_n"), F.count(F.lit(1)).alias("_k"), F.sum(1 / F.col("n")).alias("_w"))
    return counts.join(F.broadcast(whole)).select(label, "n", (F.col("_n") / (F.col("_k") * F.col("n"))).alias("balanced"), (F.col("_k") / F.col("n") / F.col("_w")).alias("rescaled"))


def box(df: DataFrame, label: str, value: str) -> DataFrame:
    """(label, q1, median, q3, low, high): whiskers reach to the last values within 1.5 times the quartiles' distance."""
    quart = quantiles(df, [label], value, [0.25, 0.5, 0.75]).withColumnRenamed("q", "_q")
    reach = 1.5 * (F.col("_q")[2] - F.col("_q")[0])
    inside = same(df, quart, [label]).filter(F.col(value).between(F.col("_q")[0] - reach, F.col("_q")[2] + reach))
    out = inside.groupBy(label).agg(F.first("_q").alias("_q"), F.min(value).alias("low"), F.max(value).alias("high"))
    return out.select(label, F.col("_q")[0].alias("q1"), F.col("_q")[1].alias("median"), F.col("_q")[2].alias("q3"), "low", "high")


def alert(value: Column, drop: Column | None = None, *, least: float = 0.7, most: float = 0.98, fall: float = 0.15) -> Column:
    """What a figure calls for: too low, too good, lost in transfer, or nothing."""
    said = F.when(value < least, "below").when(value > most, "suspicious")
    return (said if drop is None else said.when(drop > fall, "transfer")).otherwise("ok")
