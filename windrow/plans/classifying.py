"""Fuzzy rules, clustering, least squares, components and reconstruction errors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import tercile
from ..operators import fuzzy, linalg
from ..operators.fuzzy import Rule
from .tables import table

FEATURES, CLASSES = ["x", "y"], ["Loud", "Burst", "Scatter"]
RULES = [
    Rule((0.3, 0.3), (2.0, 2.0), (0.1, 0.2), ((1.0, 0.0, -0.5), (0.5, 0.2, 0.0), (0.4, 0.1, 0.2))),
    Rule((0.25, 0.4), (1.5, 2.0), (0.5, 0.6), ((-0.4, 1.2, 0.3), (0.0, 0.6, 0.1), (0.2, 0.0, 0.4))),
    Rule((0.3, 0.2), (2.0, 1.0), (0.9, 0.8), ((0.1, -0.3, 1.1), (0.2, 0.1, 0.7), (0.0, 0.1, 0.1))),
]
FIRST = [Rule(r.a, r.b, r.c, tuple(row[:2] for row in r.consequent)) for r in RULES]
WIDTH = 64


def _points(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "lineitem")
    return items.select("l_returnflag", (F.col("l_quantity") / 50).alias("x"), (F.col("l_discount") / 0.1).alias("y"))


def fuzzy_firing(spark: SparkSession, sf_dir: str) -> DataFrame:
    fired = fuzzy.with_strengths(_points(spark, sf_dir), FEATURES, RULES)
    return fired.groupBy("l_returnflag").agg(*[F.round(F.avg(f"w{k}"), 6).alias(f"w{k}") for k in range(len(RULES))])


def fuzzy_predict(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fuzzy.predict(_points(spark, sf_dir), FEATURES, RULES, floor=1e-12)
    return out.groupBy("l_returnflag", "predicted").agg(F.count(F.lit(1)).alias("n"), *[F.round(F.avg(f"y{k}"), 6).alias(f"y{k}") for k in range(3)])


def hierarchical_predict(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fuzzy.hierarchical(_points(spark, sf_dir), FEATURES, FIRST, RULES)
    return out.groupBy("predicted").agg(F.count(F.lit(1)).alias("n"))


def rule_strengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fuzzy.mean_strengths(_points(spark, sf_dir), FEATURES, RULES).limit(2).select("rule_id", F.round("strength", 6).alias("strength"))


def cluster_potentials(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.array(F.col("s_acctbal") / 10000, (F.col("s_nationkey") / 25).cast("double")).alias("x"))
    return fuzzy.potentials(points, 0.3).select("id", F.round("potential", 6).alias("potential"))


def subtractive_centres(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.array(F.col("s_acctbal") / 10000, (F.col("s_nationkey") / 25).cast("double")).alias("x"))
    centres = fuzzy.subtractive(points, 0.5)
    return spark.createDataFrame([(k, i, *c) for k, (i, c) in enumerate(centres)], "place int, id long, x double, y double")


def consequents(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _points(spark, sf_dir).withColumn("label", F.when(F.col("l_returnflag") == "A", 0).when(F.col("l_returnflag") == "N", 1).otherwise(2))
    fitted = fuzzy.fit_consequents(rows, FEATURES, RULES, "label", 3)
    return spark.createDataFrame([(j, i, k, v) for j, r in enumerate(fitted) for i, row in enumerate(r.consequent) for k, v in enumerate(row)], "rule_id int, term int, class int, value double")


def pca_explained(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, _, shares = linalg.pca(table(spark, sf_dir, "embeddings"), "embedding", WIDTH)
    return spark.createDataFrame([(k, float(s), linalg.components_for(shares)) for k, s in enumerate(shares)], "component int, share double, wanted int")


def reconstruction_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    mean, components, _ = linalg.pca(rows, "embedding", WIDTH)
    return linalg.reconstruction_error(rows, "embedding", mean, components[:16]).select("vec_id", "label", "score")


def fixed_terciles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _points(spark, sf_dir).groupBy(tercile(F.col("x"), F.lit(0.33), F.lit(0.67)).alias("level")).agg(F.count(F.lit(1)).alias("n"))


QUERIES = {f.__name__: f for f in (fuzzy_firing, fuzzy_predict, hierarchical_predict, rule_strengths, cluster_potentials, subtractive_centres, consequents, pca_explained, reconstruction_scores, fixed_terciles)}


def _sql(rules: list[Rule], divisor: str) -> str:
    """Points with y0, y1, ... of the rules, as SQL."""
    ws = [" * ".join(f"(1 / (1 + pow(abs(({f} - {r.c[i]}::double) / {r.a[i]}::double), {2 * r.b[i]}::double)))" for i, f in enumerate(FEATURES)) for r in rules]
    n = len(rules[0].consequent[0])
    ys = [" + ".join(f"w{j} * (" + " + ".join(f"{f} * {r.consequent[i][k]}::double" for i, f in enumerate(FEATURES)) + f" + {r.consequent[-1][k]}::double)" for j, r in enumerate(rules)) for k in range(n)]
    total = " + ".join(f"v{j}" for j in range(len(rules)))
    inner = f"SELECT *, {', '.join(f'{w} AS v{j}' for j, w in enumerate(ws))} FROM (SELECT l_returnflag, l_quantity / 50 AS x, l_discount / 0.1::double AS y FROM lineitem)"
    mid = f"SELECT *, {', '.join(f'v{j} / {divisor.format(total=total)} AS w{j}' for j in range(len(rules)))} FROM ({inner})"
    return f"SELECT *, {', '.join(f'{y} AS y{k}' for k, y in enumerate(ys))} FROM ({mid})"


_ADD, _FLOOR = "({total} + 1e-8::double)", "greatest({total}, 1e-12::double)"
_ARGMAX = "CASE WHEN y0 >= y1 AND y0 >= y2 THEN 0 WHEN y1 >= y2 THEN 1 ELSE 2 END"
ORACLES = {
    "fuzzy_firing": f"SELECT l_returnflag, round(avg(w0), 6) AS w0, round(avg(w1), 6) AS w1, round(avg(w2), 6) AS w2 FROM ({_sql(RULES, _ADD)}) GROUP BY 1",
    "fuzzy_predict": f"SELECT l_returnflag, ({_ARGMAX})::int AS predicted, count(*) AS n, round(avg(y0), 6) AS y0, round(avg(y1), 6) AS y1, round(avg(y2), 6) AS y2 FROM ({_sql(RULES, _FLOOR)}) GROUP BY 1, 2",
    "hierarchical_predict": f"SELECT (CASE WHEN a.y1 > a.y0 THEN 0 ELSE 1 + b.p END)::int AS predicted, count(*) AS n FROM (SELECT x, y, any_value(y0) AS y0, any_value(y1) AS y1, count(*) AS c FROM ({_sql(FIRST, _ADD)}) GROUP BY 1, 2) a JOIN (SELECT x, y, {_ARGMAX} AS p FROM ({_sql(RULES, _ADD)})) b ON a.x = b.x AND a.y = b.y GROUP BY 1",
    "rule_strengths": f"WITH m AS (SELECT avg(w0) AS a, avg(w1) AS b, avg(w2) AS c FROM ({_sql(RULES, _ADD)})) SELECT rule_id::int AS rule_id, round(s, 6) AS strength FROM (SELECT 0 AS rule_id, a AS s FROM m UNION ALL SELECT 1, b FROM m UNION ALL SELECT 2, c FROM m) ORDER BY s DESC, rule_id LIMIT 2",
    "cluster_potentials": "WITH p AS (SELECT s_suppkey AS id, s_acctbal / 10000 AS x, s_nationkey / 25.0::double AS y FROM supplier) SELECT a.id, round(sum(exp(-((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) / (0.15::double * 0.15::double))), 6) AS potential FROM p a, p b GROUP BY 1",
    "fixed_terciles": "SELECT CASE WHEN l_quantity / 50 <= 0.33::double THEN 'low' WHEN l_quantity / 50 <= 0.67::double THEN 'medium' ELSE 'high' END AS level, count(*) AS n FROM lineitem GROUP BY 1",
}
