"""First-order fuzzy rules: firing, prediction, explanation, and the clustering that places them.

A rule has, for each feature, the width a, slope b and centre c of a bell, and for each class
one coefficient a feature and a constant. Rules are few and are written into the expressions.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce
from itertools import count, product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import argmax, bell, hash_order, softmax, squared_distance
from . import linalg

#: Features by which points are dealt to cells: each multiplies the cells that a point meets by three.
GRID = 3
#: Up to so many features, cells are summed by series, whose terms grow as a power of the features.
SERIES = 2
#: Points of a cell that one group takes, about; and most tasks that the groups are dealt to.
AT_ONCE, TASKS = 4096, 2000


@dataclass(frozen=True)
class Rule:
    a: tuple[float, ...]
    b: tuple[float, ...]
    c: tuple[float, ...]
    #: consequent[feature or last for the constant][class]
    consequent: tuple[tuple[float, ...], ...]


def _product(xs: list[Column]) -> Column:
    return reduce(lambda x, y: x * y, xs)


def _sum(xs: list[Column]) -> Column:
    return reduce(lambda x, y: x + y, xs)


def firing(features: list[str], rules: list[Rule]) -> list[Column]:
    """Strength of each rule: the product of its memberships."""
    return [_product([bell(F.col(f), r.a[i], r.b[i], r.c[i]) for i, f in enumerate(features)]) for r in rules]


def with_strengths(df: DataFrame, features: list[str], rules: list[Rule], *, floor: float | None = None, prefix: str = "w") -> DataFrame:
    """df with w0, w1, ...: strengths that add up to one. floor: least divisor; without, 1e-8 is added to the sum."""
    raw = [f"_{prefix}{k}" for k in range(len(rules))]
    df = df.withColumns(dict(zip(raw, firing(features, rules), strict=True)))
    total = _sum([F.col(c) for c in raw])
    total = total + F.lit(1e-8) if floor is None else F.greatest(total, F.lit(floor))
    return df.withColumns({f"{prefix}{k}": F.col(c) / total for k, c in enumerate(raw)}).drop(*raw)


def outputs(features: list[str], rules: list[Rule], prefix: str = "w") -> list[Column]:
    """Each class's output, given the strengths."""
    n = len(rules[0].consequent[0])
    line = lambda r, k: _sum([F.col(f) * r.consequent[i][k] for i, f in enumerate(features)]) + F.lit(float(r.consequent[-1][k]))
    return [_sum([F.col(f"{prefix}{j}") * line(r, k) for j, r in enumerate(rules)]) for k in range(n)]


def predict(df: DataFrame, features: list[str], rules: list[Rule], *, floor: float | None = None) -> DataFrame:
    """df with y0, y1, ... and predicted, the class of the greatest output."""
    fired = with_strengths(df, features, rules, floor=floor)
    ys = outputs(features, rules)
    out = fired.withColumns({f"y{k}": y for k, y in enumerate(ys)}).drop(*[f"w{k}" for k in range(len(rules))])
    return out.withColumn("predicted", argmax([F.col(f"y{k}") for k in range(len(ys))]))


def hierarchical(df: DataFrame, features: list[str], first: list[Rule], then: list[Rule], threshold: float = 0.5) -> DataFrame:
    """df with predicted: 0 where the first stage gives its class 1 more than the threshold, else 1 + the second stage's class."""
    one = predict(df, features, first)
    p = softmax([F.col("y0"), F.col("y1")])[1]
    one = one.withColumn("_p", p).drop("y0", "y1", "predicted")
    two = predict(one, features, then)
    return two.withColumn("predicted", F.when(F.col("_p") > threshold, 0).otherwise(F.col("predicted") + 1)).drop("_p", *[f"y{k}" for k in range(len(then[0].consequent[0]))])


def dominant(rule: Rule, how: str = "at_centre") -> int:
    """A rule's class: by its consequents at_centre or by their total."""
    theta = np.array(rule.consequent)
    at = np.append(np.clip(rule.c, 0, 1), 1.0) @ theta if how == "at_centre" else theta.sum(axis=0)
    return int(np.argmax(at))


def level(x: float, low: float = 0.33, high: float = 0.67) -> str:
    return "low" if x < low else "medium" if x < high else "high"


def explain(spark, features: list[str], rules: list[Rule], classes: list[str], how: str = "at_centre") -> DataFrame:
    """(rule_id, conditions, output, text), a row a rule."""
    rows = [(k, [f"{f} IS {level(r.c[i])}" for i, f in enumerate(features)], classes[dominant(r, how)]) for k, r in enumerate(rules)]
    df = spark.createDataFrame(rows, "rule_id int, parts array<string>, output string")
    conditions = F.array_join("parts", " AND ")
    return df.select("rule_id", conditions.alias("conditions"), "output", F.concat(F.lit("IF "), conditions, F.lit(" THEN "), F.col("output")).alias("text"))


def mean_strengths(df: DataFrame, features: list[str], rules: list[Rule]) -> DataFrame:
    """(rule_id, strength): mean over all rows, the strongest first."""
    fired = with_strengths(df, features, rules)
    means = fired.agg(*[F.avg(f"w{k}").alias(f"w{k}") for k in range(len(rules))])
    return means.select(F.posexplode(F.array(*[f"w{k}" for k in range(len(rules))])).alias("rule_id", "strength")).orderBy(F.desc("strength"), "rule_id")


def parameters(n_rules: int, n_features: int, n_classes: int) -> int:
    return 3 * n_rules * n_features + n_rules * (n_features + 1) * n_classes


def potentials(points: DataFrame, radius: float, *, error: float = 1e-12, grain: float | None = None) -> DataFrame:
    """points(id, x: array) with potential: the sum over all points of exp(-d^2 / (radius / 2)^2). A null x has none.

    With up to SERIES features the sums are those of _by_series(), whose work grows with the points; with more, of _by_pairs(), where a
    dense cell costs the square of its points. Equal points are met once, with their number. grain: points within a cube of grain * radius
    count as so many at their mean, so that dense cells cost their cubes; each is then moved by less than grain * radius *
    sqrt(features), and its share, whose slope is at most 1.72 / radius, is off by twice that slope times the move.
    """
    first = points.filter("x is not null").select(F.size("x").alias("n")).first()
    if first is None:
        return points.withColumn("potential", F.lit(None).cast("double"))
    width, scale = first["n"], radius / 2
    places = F.col("x") if grain is None else F.transform("x", lambda v: F.floor(v / F.lit(grain * radius)))
    own = points.withColumn("_at", places)
    means = F.array(*[F.avg(F.col("x")[i]) for i in range(width)]) if grain is not None else F.first("x")
    groups = own.filter("x is not null").groupBy("_at").agg(F.count(F.lit(1)).alias("_n"), means.alias("_x"))
    sums = (_by_series if 0 < width <= SERIES else _by_pairs)(groups, width, scale, error)
    return own.join(sums, "_at", "left").drop("_at")


def _by_pairs(groups: DataFrame, width: int, scale: float, error: float) -> DataFrame:
    """(_at, potential) of groups(_at, _x, _n).

    Points are met by cells of their first GRID features. A cell is as wide as the distance from which a point adds less than
    error, so a point meets those of its own and the neighbouring cells, and lacks less than error for each of the others.
    """
    reach = scale * math.sqrt(math.log(1 / error))
    cell = [F.floor(F.col("_x")[i] / F.lit(reach)) for i in range(min(width, GRID))]
    there = groups.select("_n", F.col("_x").alias("_y"), F.struct(*[c.alias(f"k{i}") for i, c in enumerate(cell)]).alias("_cell"))
    shifts = [F.struct(*[(c + F.lit(d)).alias(f"k{i}") for i, (c, d) in enumerate(zip(cell, by, strict=True))]) for by in product((-1, 0, 1), repeat=len(cell))]
    here = groups.select("_at", "_x", F.explode(F.array(*shifts)).alias("_cell"))
    apart = squared_distance(F.col("_x"), F.col("_y"))
    met = here.join(there, "_cell").withColumn("_d", apart).filter(F.col("_d") <= reach * reach)
    return met.groupBy("_at").agg(F.sum(F.col("_n") * F.exp(-F.col("_d") / F.lit(scale**2))).alias("potential"))


def _by_series(groups: DataFrame, width: int, scale: float, error: float) -> DataFrame:
    """(_at, potential) of groups(_at, _x, _n), with work in proportion to them: the fast Gauss transform.

    Cells are as wide as scale. With u and v a point's and another's distance from the middle of the other's cell, in scales,
    exp(-(u - v)^2) = exp(-u^2) exp(-v^2) sum over n of (2 u v)^n / n!, so a cell's points, however many, are known by the sums of
    exp(-v^2) (2 v)^n / n!; as |v| <= 1/2, terms from n on add at most about (n / 2e)^(n/2) / n!, wherever u is. Cells with fewer
    numbers in their points than in their sums are met point by point. Cells further off than points that add less than error are left out.
    """
    terms = next(n for n in count(3) if 2 * width * math.exp(n / 2 * math.log(n / 2 / math.e) - math.lgamma(n + 1)) < error)
    reach = math.sqrt(math.log(1 / error))
    most = math.floor(reach) + 1
    near = [by for by in product(range(-most, most + 1), repeat=width) if sum(max(abs(d) - 1, 0) ** 2 for d in by) <= reach * reach]
    names = [f"_k{i}" for i in range(width)]
    place = F.transform("_x", lambda v: v.cast("double") / F.lit(scale))
    finite = (F.size("_x") == width) & F.forall("_x", lambda v: F.coalesce(F.abs(v.cast("double")) < F.lit(math.inf), F.lit(False)))
    cells = groups.filter(finite).withColumns({"_u": place, "_n": F.col("_n").cast("double")}).withColumns({k: F.floor(F.col("_u")[i]) for i, k in enumerate(names)})
    sizes = cells.groupBy(*names).agg(F.ceil(F.count(F.lit(1)) / AT_ONCE).alias("_parts"))
    tasks = max(1, min(TASKS, sizes.agg(F.sum("_parts").alias("n")).first()["n"] or 0))  # one number
    dealt = cells.join(sizes, names).withColumn("_part", F.pmod(F.xxhash64("_at"), F.col("_parts"))).select("_at", "_u", "_n", "_parts", *names, "_part")
    keys = [*names, "_part"]
    dealt = dealt.repartition(tasks, *keys)

    def summed(key: tuple, table: pa.Table) -> pa.Table:
        at, n = _places(table, width), table.column("_n").to_numpy()
        if table.column("_parts")[0].as_py() == 1 and len(n) * (width + 1) <= terms**width:
            whole, numbers = True, np.column_stack([at, n]).ravel()
        else:
            v = at - np.array([k.as_py() + 0.5 for k in key[:width]])
            powers = [_powers(2 * v[:, i], terms) / np.array([math.factorial(j) for j in range(terms)]) for i in range(width)]
            weighted = powers[0] * (n * np.exp(-(v**2).sum(axis=1)))[:, None]
            whole, numbers = False, (weighted.T @ powers[1] if width == 2 else weighted.sum(axis=0)).ravel()
        return pa.table({**{f"_s{i}": [key[i].as_py()] for i in range(width)}, "_whole": [whole], "_numbers": [numbers.tolist()]})

    sources = ", ".join(f"_s{i} long" for i in range(width)) + ", _whole boolean, _numbers array<double>"
    parts = dealt.groupBy(*keys).applyInArrow(summed, sources).select(F.struct(*[f"_s{i}" for i in range(width)]).alias("_cell"), "_whole", F.posexplode("_numbers").alias("_i", "_v"))
    totals = parts.groupBy("_cell", "_whole", "_i").agg(F.sum("_v").alias("_v"))  # over the parts of a cell
    totals = totals.groupBy("_cell", "_whole").agg(F.transform(F.sort_array(F.collect_list(F.struct("_i", "_v"))), lambda x: x["_v"]).alias("_numbers"))  # at most terms^width
    around = F.array(*[F.struct(*[(F.col(k) + F.lit(d)).alias(f"_s{i}") for i, (k, d) in enumerate(zip(names, by, strict=True))]) for by in near])
    theirs = [f"_m{i}" for i in range(len(keys))]
    blocks = dealt.select(*keys).distinct().withColumn("_cell", F.explode(around)).select(*[F.col(k).alias(m) for k, m in zip(keys, theirs, strict=True)], "_cell")
    met = blocks.join(totals, "_cell").repartition(tasks, *theirs)

    def evaluated(own: pa.Table, others: pa.Table) -> pa.Table:
        at = _places(own, width)
        total = np.zeros(len(at))
        for cell, whole, numbers in zip(others.column("_cell").to_pylist(), others.column("_whole").to_pylist(), others.column("_numbers").combine_chunks(), strict=True):
            numbers = numbers.values.to_numpy()
            if whole:
                rows = numbers.reshape(-1, width + 1)
                total += np.exp(-sum((at[:, i, None] - rows[None, :, i]) ** 2 for i in range(width))) @ rows[:, width]
            else:
                u = at - np.array([cell[f"_s{i}"] + 0.5 for i in range(width)])
                inner = _powers(u[:, 0], terms) @ numbers.reshape(terms, -1)
                total += np.exp(-(u**2).sum(axis=1)) * (inner * _powers(u[:, 1], terms)).sum(axis=1) if width == 2 else np.exp(-(u[:, 0] ** 2)) * inner[:, 0]
        return pa.table({"_at": own.column("_at"), "potential": total})

    schema = f"_at {groups.schema['_at'].dataType.simpleString()}, potential double"
    return dealt.groupBy(*keys).cogroup(met.groupBy(*theirs)).applyInArrow(evaluated, schema)


def _places(table: pa.Table, width: int) -> np.ndarray:
    return table.column("_u").combine_chunks().flatten().to_numpy().reshape(-1, width)


def _powers(x: np.ndarray, terms: int) -> np.ndarray:
    """(points, terms): x^0, x^1, ..."""
    return np.cumprod(np.column_stack([np.ones(len(x)), np.repeat(x[:, None], terms - 1, axis=1)]), axis=1)


def subtractive(points: DataFrame, radius: float, *, full: bool = True, accept: float = 0.5, reject: float = 0.15, most: int = 25) -> list[tuple[int, list[float]]]:
    """(id, centre) of subtractive clustering; each round finds the point of the greatest potential and lowers those around it.

    Only the centres found reach the driver. full: potentials between the two bounds must be far from all
    centres; otherwise all above reject are taken, and potentials stay at 0 or above.
    """
    left = potentials(points, radius).withColumn("_out", F.lit(False)).cache()
    centres: list[tuple[int, list[float]]] = []
    top = None
    try:
        while len(centres) < most:
            now = left.filter(~F.col("_out") & (F.col("potential") > 0))
            if top is not None:
                now = now.filter(F.col("potential") >= reject * top)
                if full:
                    gap = F.least(*[_distance(c) for _, c in centres], F.lit(math.inf))
                    now = now.filter((F.col("potential") >= accept * top) | (gap / radius + F.col("potential") / top >= 1))
            best = now.orderBy(F.desc("potential"), "id").select("id", "x", "potential").first()
            if best is None:
                break
            peak = float(best["potential"])
            top = peak if top is None else top
            centres.append((best["id"], [float(v) for v in best["x"]]))
            # what stands before the best was too near the centres for its potential; it is out for good, as if met one by one
            ahead = (F.col("potential") > peak) | (F.col("potential") == peak) & (F.col("id") < best["id"])
            lowered = F.col("potential") - F.lit(peak) * F.exp(-(_distance(centres[-1][1]) ** 2) / F.lit((1.5 * radius / 2) ** 2))
            last, left = left, left.withColumns({"_out": F.col("_out") | ahead, "potential": lowered if full else F.greatest(lowered, F.lit(0.0))}).cache()
            left.count()
            last.unpersist()
    finally:
        left.unpersist()
    return centres


def _distance(centre: list[float]) -> Column:
    return F.sqrt(squared_distance(F.col("x"), F.array(*[F.lit(float(v)) for v in centre])))


def filled(points: DataFrame, centres: list[tuple[int, list[float]]], least: int = 5, most: int = 25, seed: int = 42) -> list[tuple[int, list[float]]]:
    """At most the first centres, and where there are fewer than least, other points in seeded order of id; fewer only where there are no more points."""
    if len(centres) >= least:
        return centres[:most]
    others = points.filter(F.col("x").isNotNull() & ~F.col("id").isin(*[i for i, _ in centres])) if centres else points.filter("x is not null")
    drawn = others.orderBy(hash_order(F.col("id"), seed), "id").limit(least - len(centres)).collect()  # of each partition the first few, no order of all
    return centres + [(r["id"], [float(v) for v in r["x"]]) for r in drawn]


def rules_at(centres: list[list[float]], n_classes: int, a: float = 0.3, b: float = 2.0) -> list[Rule]:
    """Rules with bells at the centres and no consequents yet."""
    return [Rule((a,) * len(c), (b,) * len(c), tuple(c), tuple((0.0,) * n_classes for _ in range(len(c) + 1))) for c in centres]


def fit_consequents(df: DataFrame, features: list[str], rules: list[Rule], label: str, n_classes: int) -> list[Rule]:
    """Least-squares consequents of least norm for one-hot labels 0, 1, ...; the sums of products are all that reaches the driver."""
    fired = with_strengths(df, features, rules)
    columns = [c for j in range(len(rules)) for c in ([F.col(f"w{j}") * F.col(f) for f in features] + [F.col(f"w{j}")])]
    targets = [(F.col(label) == k).cast("double") for k in range(n_classes)]
    gram, cross = linalg.normal_equations(fired, columns, targets)
    theta = (np.linalg.pinv(gram) @ cross).reshape(len(rules), len(features) + 1, n_classes)
    return [Rule(r.a, r.b, r.c, tuple(tuple(float(v) for v in row) for row in theta[j])) for j, r in enumerate(rules)]
