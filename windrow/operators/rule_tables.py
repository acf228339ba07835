"""Fuzzy rules as a table: saved, read, explained, and scored from, however many there are.

A rule table has (rule_id int, a, b, c: array<double> by feature, consequent: array<array<double>> by
feature, last the constant, and class). Scoring broadcasts it in slices of SLICE rules, whose sums add up.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.scalar import argmax
from .fuzzy import Rule
from .ranking import quantiles

SCHEMA = "rule_id int, a array<double>, b array<double>, c array<double>, consequent array<array<double>>"
#: Rules that are broadcast at once, in one row of SLICE * (3 features + (features + 1) classes) numbers.
SLICE = 1024


def of_rules(spark: SparkSession, rules: list[Rule]) -> DataFrame:
    return spark.createDataFrame([(k, list(r.a), list(r.b), list(r.c), [list(t) for t in r.consequent]) for k, r in enumerate(rules)], SCHEMA)


def to_rules(table: DataFrame) -> list[Rule]:
    """The rules on the driver, in order: for fitting, whose rules are few."""
    rows = table.orderBy("rule_id").collect()
    return [Rule(tuple(r["a"]), tuple(r["b"]), tuple(r["c"]), tuple(tuple(t) for t in r["consequent"])) for r in rows]


def save(table: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """As Parquet, after a check that all rules have as many widths, slopes, centres and terms."""
    n = F.size("c")
    whole = F.coalesce((F.size("a") == n) & (F.size("b") == n) & (F.size("consequent") == n + 1), F.lit(False))
    checked = table.select(*[c.split()[0] for c in SCHEMA.split(", ")[:4]], "consequent").withColumn("rule_id", F.when(whole, F.col("rule_id")).otherwise(F.raise_error(F.concat(F.lit("rule of unequal lengths: "), F.coalesce(F.col("rule_id").cast("string"), F.lit("null"))))))
    checked.write.mode(mode).parquet(path)


def load(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCHEMA).parquet(path)


def from_groups(df: DataFrame, group: str, features: list[str], label: str, classes: int, *, a: float = 0.3, b: float = 2.0) -> DataFrame:
    """A rule for each group, in order of it: its bells stand at the features' means, its constants are the shares of the labels 0, 1, ..."""
    means = [F.avg(f).cast("double") for f in features]
    shares = [F.avg((F.col(label) == k).cast("double")) for k in range(classes)]
    rows = df.groupBy(group).agg(F.array(*means).alias("c"), F.array(*shares).alias("_shares"))
    zeros = F.array(*[F.lit(0.0)] * classes)
    same = lambda v: F.array(*[F.lit(float(v))] * len(features))
    return rows.select((F.row_number().over(Window.orderBy(group)) - 1).alias("rule_id"), same(a).alias("a"), same(b).alias("b"), "c", F.array(*[zeros] * len(features), F.col("_shares")).alias("consequent"))  # a row a rule


def _fired(x: Column, rule: Column, width: int) -> Column:
    bells = [1 / (1 + F.pow(F.abs((x[i] - rule["c"][i]) / rule["a"][i]), 2 * rule["b"][i])) for i in range(width)]
    return reduce(lambda p, q: p * q, bells)


def classes_of(table: DataFrame) -> int:
    row = table.select(F.size(F.col("consequent")[0]).alias("n")).first()
    return row["n"] if row else 0


def predict(df: DataFrame, features: list[str], table: DataFrame, *, floor: float | None = None) -> DataFrame:
    """df with y0, y1, ... and predicted, as fuzzy.predict, by the rules of a table, numbered from 0. floor: least divisor; without, 1e-8 is added.

    No rules: a ValueError. Null features give null outputs.
    """
    classes = classes_of(table)
    if not classes:
        raise ValueError("no rules")
    last = table.agg(F.max("rule_id")).first()[0]
    out = df.withColumn("_x", F.array(*[F.col(f"`{f}`").cast("double") for f in features]))
    sums = None
    for k in range(last // SLICE + 1):
        part = table.filter(F.floor(F.col("rule_id") / SLICE) == k)
        row = part.agg(F.sort_array(F.collect_list(F.struct("rule_id", "a", "b", "c", "consequent"))).alias(f"_rules{k}"))  # one row of at most SLICE rules
        out = out.join(F.broadcast(row))
        line = lambda r, j: reduce(lambda p, q: p + q, [F.col("_x")[i] * r["consequent"][i][j] for i in range(len(features))]) + r["consequent"][len(features)][j]
        each = F.transform(f"_rules{k}", lambda r: F.struct(_fired(F.col("_x"), r, len(features)).alias("w"), *[line(r, j).alias(f"y{j}") for j in range(classes)]))
        zero = F.struct(F.lit(0.0).alias("w"), *[F.lit(0.0).alias(f"y{j}") for j in range(classes)])
        added = F.aggregate(each, zero, lambda s, r: F.struct((s["w"] + r["w"]).alias("w"), *[(s[f"y{j}"] + r["w"] * r[f"y{j}"]).alias(f"y{j}") for j in range(classes)]))
        out = out.withColumn(f"_sums{k}", added).drop(f"_rules{k}")
        sums = (sums or []) + [f"_sums{k}"]
    total = lambda c: reduce(lambda p, q: p + q, [F.col(f"{s}.{c}") for s in sums])
    divisor = total("w") + F.lit(1e-8) if floor is None else F.greatest(total("w"), F.lit(floor))
    out = out.withColumns({f"y{j}": total(f"y{j}") / divisor for j in range(classes)}).drop("_x", *sums)
    return out.withColumn("predicted", argmax([F.col(f"y{j}") for j in range(classes)]))


def dominant(table: DataFrame, classes: int, how: str) -> DataFrame:
    """table with dominant: a rule's class by the whole table's output at its centre in [0, 1] (model), by its consequent at its centre
    (at_centre), or by the totals of its consequents (total); of equal ones the first."""
    if how not in ("model", "at_centre", "total"):
        raise ValueError(f"model, at_centre or total, not {how}")
    width = table.select(F.size("c").alias("n")).first()["n"]
    if how == "model":
        names = [f"_c{i}" for i in range(width)]
        at = table.withColumns({n: F.least(F.greatest(F.col("c")[i], F.lit(0.0)), F.lit(1.0)) for i, n in enumerate(names)})
        return predict(at, names, table, floor=1e-12).withColumnRenamed("predicted", "dominant").drop(*names, *[f"y{j}" for j in range(classes)])
    term = lambda i: F.col("consequent")[i]
    weight = lambda i: F.col("c")[i] if how == "at_centre" and i < width else F.lit(1.0)
    score = [reduce(lambda p, q: p + q, [weight(i) * term(i)[j] for i in range(width + 1)]) for j in range(classes)]
    return table.withColumn("dominant", argmax(score))


def explained(table: DataFrame, features: list[str], classes: list[str], how: str = "at_centre", levels: tuple[float, float] | None = (0.33, 0.67)) -> DataFrame:
    """(rule_id, conditions, output, text). levels: bounds of low and medium; None takes the 33rd and 67th percentiles of the rules' own centres."""
    rows = dominant(table, len(classes), how)
    low, high = "_low", "_high"
    if levels is None:
        centres = table.select(F.posexplode("c").alias("_f", "_v"))
        bounds = quantiles(centres, ["_f"], "_v", [0.33, 0.67]).agg(F.sort_array(F.collect_list(F.struct("_f", "q"))).alias("_q"))  # a row a feature
        rows = rows.join(F.broadcast(bounds)).withColumns({low: F.transform("_q", lambda q: q["q"][0]), high: F.transform("_q", lambda q: q["q"][1])})
        said = lambda i: F.when(F.col("c")[i] <= F.col(low)[i], "low").when(F.col("c")[i] <= F.col(high)[i], "medium").otherwise("high")
    else:
        said = lambda i: F.when(F.col("c")[i] < levels[0], "low").when(F.col("c")[i] < levels[1], "medium").otherwise("high")
    conditions = F.array_join(F.array(*[F.concat(F.lit(f"{f} IS "), said(i)) for i, f in enumerate(features)]), " AND ")
    named = F.array(*[F.lit(c) for c in classes])[F.col("dominant")]
    rows = rows.withColumns({"conditions": conditions, "output": named})
    return rows.select("rule_id", "conditions", "output", F.concat(F.lit("IF "), "conditions", F.lit(" THEN "), "output").alias("text"))


def grid(df: DataFrame, features: list[str], axes: tuple[str, str], steps: int) -> DataFrame:
    """steps x steps points of [0, 1] along two features, the others at their medians over df. The points are numbers taken apart, not a join."""
    places = df.sparkSession.range(steps * steps)
    axis = {axes[0]: F.col("id") % steps, axes[1]: F.floor(F.col("id") / steps)}
    out = places.select(*[(n / F.lit(float(steps - 1))).alias(f) for f, n in axis.items()])
    for f in features:
        if f not in axes:
            out = out.join(F.broadcast(quantiles(df, [], f, [0.5]).select(F.col("q")[0].alias(f))))  # one row
    return out.select(*features)


def curves(table: DataFrame, features: list[str], steps: int = 200) -> DataFrame:
    """(rule_id, feature, at, membership) of each bell at steps points of [0, 1]."""
    bells = table.select("rule_id", F.posexplode(F.arrays_zip("a", "b", "c")).alias("_f", "_bell"))
    rows = bells.withColumn("at", F.explode(F.transform(F.sequence(F.lit(0), F.lit(steps - 1)), lambda k: k / F.lit(float(steps - 1)))))
    name = F.array(*[F.lit(f) for f in features])[F.col("_f")]
    z = F.abs((F.col("at") - F.col("_bell.c")) / F.col("_bell.a"))
    return rows.select("rule_id", name.alias("feature"), "at", (1 / (1 + F.pow(z, 2 * F.col("_bell.b")))).alias("membership"))
