"""Curves, confusion, per-class figures and alerts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import metrics, ranking
from .tables import SCORED, scored, table


def auroc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.auroc(scored(spark, sf_dir), "score", "truth").select("n_pos", "n_neg", F.round("auroc", 8).alias("auroc"))


def auroc_inverted(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scored(spark, sf_dir).withColumn("score", -F.col("score"))
    return metrics.auroc(rows, "score", "truth").select(F.round("auroc", 8).alias("auroc"))


def auroc_by_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With mean and deviation, and what the figure calls for: the transfer table."""
    rows = scored(spark, sf_dir)
    areas = metrics.auroc(rows, "score", "truth", ["lang"])
    out = areas.join(metrics.score_by_class(rows, "lang", "score"), "lang")
    return out.select("lang", "n_pos", "n_neg", F.round("auroc", 8).alias("auroc"), F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"), metrics.alert(F.col("auroc")).alias("alert"))


def average_precision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.average_precision(scored(spark, sf_dir), "score", "truth").select(F.round("average_precision", 8).alias("average_precision"))


def roc_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.roc(scored(spark, sf_dir), "score", "truth").select("threshold", F.round("fpr", 9).alias("fpr"), F.round("tpr", 9).alias("tpr"))


def tpr_at_fpr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.tpr_at_fpr(metrics.roc(scored(spark, sf_dir), "score", "truth"), 0.01).select(F.round("tpr", 8).alias("tpr"))


def inferred_label_auroc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Truth inferred as one score above its 95th percentile, tested with another."""
    rows = table(spark, sf_dir, "part").select("p_partkey", "p_retailprice", F.col("p_size").cast("double").alias("score"))
    bound = ranking.quantiles(rows, [], "p_retailprice", [0.95]).select(F.col("q")[0].alias("p"))
    rows = rows.join(F.broadcast(bound)).withColumn("truth", (F.col("p_retailprice") > F.col("p")).cast("int"))
    return metrics.auroc(rows, "score", "truth").select("n_pos", "n_neg", F.round("auroc", 8).alias("auroc"))


def proxy_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each language's truths; where fewer than 5 are nominal, scores above the 10th percentile stand for them."""
    rows = scored(spark, sf_dir)
    facts = rows.groupBy("lang").agg(F.count_if(F.col("truth") == 0).alias("n_nominal"))
    facts = ranking.same(facts, ranking.quantiles(rows, ["lang"], "score", [0.1]).select("lang", F.col("q")[0].alias("p10")), ["lang"])
    rows = ranking.same(rows, facts, ["lang"]).withColumn("proxy", F.when(F.col("n_nominal") < 5, (F.col("score") > F.col("p10")).cast("int")).otherwise(F.col("truth")))
    return rows.groupBy("lang").agg(F.sum("proxy").cast("long").alias("n_pos"), F.count(F.lit(1)).alias("n"))


def _predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    truth = F.substring("o_orderpriority", 1, 1).cast("int") - 1
    guess = F.when(F.col("o_orderkey") % 3 == 0, truth).otherwise((F.col("o_custkey") % 5).cast("int"))
    return orders.select(truth.alias("y"), guess.alias("p"))


def _matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.confusion(_predictions(spark, sf_dir), "y", "p", spark.range(6).select(F.col("id").cast("int").alias("c")))


def confusion_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _matrix(spark, sf_dir)


def per_class_prf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.per_class(_matrix(spark, sf_dir)).select("c", *[F.round(x, 8).alias(x) for x in ("precision", "recall", "f1")], "support")


def macro_f1_both(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.summary(metrics.per_class(_matrix(spark, sf_dir))).select(*[F.round(x, 8).alias(x) for x in ("accuracy", "macro_f1", "macro_f1_all")])


def class_score_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = metrics.score_by_class(scored(spark, sf_dir), "source", "score", 5)
    return rows.orderBy(F.desc("mean"), "source").select("source", "n", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"))


def top_bottom_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three classes of the greatest mean score and the three of the least; classes are few."""
    rows = metrics.score_by_class(scored(spark, sf_dir), "source", "score", 5)
    top = rows.orderBy(F.desc("mean"), "source").limit(3).withColumn("side", F.lit("top"))
    bottom = rows.orderBy(F.asc("mean"), F.desc("source")).limit(3).withColumn("side", F.lit("bottom"))
    return top.union(bottom).select("side", "source", F.round("mean", 6).alias("mean"))


def argmax_per_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(spark, sf_dir).groupBy("lang").agg(F.max_by("doc_id", F.struct("score", -F.col("doc_id"))).alias("doc_id"), F.max("score").alias("score"))


def anova_f(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = metrics.anova_f(table(spark, sf_dir, "lineitem"), "l_returnflag", ["l_quantity", "l_extendedprice", "l_discount"])
    return rows.select("feature", F.round("f", 6).alias("f"))


def anova_p(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ratios of anova_f with their degrees of freedom and how likely chance is to exceed them."""
    rows = metrics.anova_f(table(spark, sf_dir, "lineitem"), "l_returnflag", ["l_quantity", "l_extendedprice", "l_discount"])
    return rows.select("feature", "between", "within", F.round("p", 9).alias("p"))


def entry_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows without a class among the events' types, and whether there are as many as ids."""
    rows = table(spark, sf_dir, "events")
    return metrics.entry_checks(rows, "event_type", rows.select("event_id").distinct().count())


def class_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = metrics.class_weights(table(spark, sf_dir, "lineitem"), "l_returnflag")
    return rows.select("l_returnflag", "n", F.round("balanced", 8).alias("balanced"), F.round("rescaled", 8).alias("rescaled"))


def version_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean scores of two halves of each source's documents, side by side with their difference."""
    rows = scored(spark, sf_dir)
    half = lambda k, name: rows.filter(F.col("doc_id") % 2 == k).groupBy("source").agg(F.avg("score").alias(name))
    both = half(0, "a").join(half(1, "b"), "source", "full")
    return both.select("source", F.round("a", 6).alias("a"), F.round("b", 6).alias("b"), F.round(F.col("b") - F.col("a"), 6).alias("delta"))


QUERIES = {f.__name__: f for f in (auroc, auroc_inverted, auroc_by_group, average_precision, roc_curve, tpr_at_fpr, inferred_label_auroc, proxy_labels, confusion_matrix, per_class_prf, macro_f1_both, class_score_stats, top_bottom_classes, argmax_per_class, anova_f, anova_p, entry_checks, class_weights, version_comparison)}

_CURVE = f"""{SCORED}, c AS (SELECT score, count(*) FILTER (truth = 1) AS pos, count(*) FILTER (truth <> 1) AS neg FROM scored WHERE score IS NOT NULL AND truth IS NOT NULL GROUP BY 1),
k AS (SELECT *, sum(pos) OVER (ORDER BY score DESC) AS tp, sum(neg) OVER (ORDER BY score DESC) AS fp, sum(pos) OVER () AS np, sum(neg) OVER () AS nn FROM c),
roc AS (SELECT NULL::double AS threshold, 0.0::double AS fpr, 0.0::double AS tpr UNION ALL SELECT score, fp / nn, tp / np FROM k)"""
_MATRIX = """pr AS (SELECT left(o_orderpriority, 1)::int - 1 AS y, CASE WHEN o_orderkey % 3 = 0 THEN left(o_orderpriority, 1)::int - 1 ELSE (o_custkey % 5)::int END AS p FROM orders),
m AS (SELECT t.i::int AS truth, q.i::int AS predicted, (SELECT count(*) FROM pr WHERE y = t.i AND p = q.i) AS n FROM range(6) t(i), range(6) q(i)),
s AS (SELECT k.i::int AS c, (SELECT sum(n) FROM m WHERE truth = k.i AND predicted = k.i)::double AS tp, (SELECT sum(n) FROM m WHERE truth = k.i)::bigint AS support, (SELECT sum(n) FROM m WHERE predicted = k.i)::double AS pred FROM range(6) k(i)),
f AS (SELECT *, tp / greatest(pred, 1) AS precision, tp / greatest(support, 1) AS recall FROM s), g AS (SELECT *, 2 * precision * recall / greatest(precision + recall, 1e-9) AS f1 FROM f)"""
ORACLES = {
    "auroc": f"WITH {_CURVE} SELECT max(np)::bigint AS n_pos, max(nn)::bigint AS n_neg, round(sum(neg * (tp - pos / 2.0::double)) / (max(np) * max(nn)), 8) AS auroc FROM k",
    "auroc_inverted": f"WITH {_CURVE} SELECT round(1 - sum(neg * (tp - pos / 2.0::double)) / (max(np) * max(nn)), 8) AS auroc FROM k",
    "auroc_by_group": f"""WITH {SCORED}, r AS (SELECT lang, score, truth, rank() OVER (PARTITION BY lang ORDER BY score) + (count(*) OVER (PARTITION BY lang, score) - 1) / 2.0::double AS rk FROM scored),
a AS (SELECT lang, count(*) FILTER (truth = 1) AS n_pos, count(*) FILTER (truth = 0) AS n_neg, sum(rk) FILTER (truth = 1) AS s, avg(score) AS mean, stddev_pop(score) AS std FROM r GROUP BY 1),
b AS (SELECT *, CASE WHEN n_pos * n_neg > 0 THEN (s - n_pos * (n_pos + 1) / 2) / (n_pos * n_neg) END AS auroc FROM a WHERE lang IS NOT NULL)
SELECT lang, n_pos, n_neg, round(auroc, 8) AS auroc, round(mean, 6) AS mean, round(std, 6) AS std, CASE WHEN auroc < 0.7 THEN 'below' WHEN auroc > 0.98 THEN 'suspicious' ELSE 'ok' END AS alert FROM b""",
    "average_precision": f"WITH {_CURVE} SELECT round(sum(pos / np * tp / (tp + fp)), 8) AS average_precision FROM k",
    "roc_curve": f"WITH {_CURVE} SELECT threshold, round(fpr, 9) AS fpr, round(tpr, 9) AS tpr FROM roc",
    "tpr_at_fpr": f"""WITH {_CURVE}, a AS (SELECT fpr AS x0, max(tpr) AS y0 FROM roc WHERE fpr < 0.01 GROUP BY fpr ORDER BY fpr DESC LIMIT 1), b AS (SELECT fpr AS x1, min(tpr) AS y1 FROM roc WHERE fpr >= 0.01 GROUP BY fpr ORDER BY fpr LIMIT 1)
SELECT round(y0 + (y1 - y0) * (0.01::double - x0) / (x1 - x0 + 1e-12::double), 8) AS tpr FROM a, b""",
    "inferred_label_auroc": """WITH p AS (SELECT quantile_cont(p_retailprice, 0.95) AS q FROM part), s AS (SELECT p_size AS score, (p_retailprice > q)::int AS truth FROM part, p),
r AS (SELECT truth, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0::double AS rk FROM s),
a AS (SELECT count(*) FILTER (truth = 1) AS n_pos, count(*) FILTER (truth = 0) AS n_neg, sum(rk) FILTER (truth = 1) AS s FROM r)
SELECT n_pos, n_neg, round((s - n_pos * (n_pos + 1) / 2) / (n_pos * n_neg), 8) AS auroc FROM a""",
    "proxy_labels": f"""WITH {SCORED}, f AS (SELECT lang, count(*) FILTER (truth = 0) AS n0, quantile_cont(score, 0.1) AS p FROM scored GROUP BY 1)
SELECT s.lang, sum(CASE WHEN n0 < 5 THEN (score > p)::int ELSE truth END)::bigint AS n_pos, count(*) AS n FROM scored s JOIN f ON f.lang = s.lang GROUP BY 1""",
    "confusion_matrix": f"WITH {_MATRIX} SELECT * FROM m",
    "per_class_prf": f"WITH {_MATRIX} SELECT c, round(precision, 8) AS precision, round(recall, 8) AS recall, round(f1, 8) AS f1, support FROM g",
    "macro_f1_both": f"WITH {_MATRIX} SELECT round(sum(tp) / sum(support), 8) AS accuracy, round(avg(f1) FILTER (support > 0), 8) AS macro_f1, round(avg(f1), 8) AS macro_f1_all FROM g",
    "class_score_stats": f"WITH {SCORED} SELECT source, count(*) AS n, round(avg(score), 6) AS mean, round(stddev_pop(score), 6) AS std FROM scored GROUP BY 1 HAVING count(*) >= 5",
    "top_bottom_classes": f"""WITH {SCORED}, c AS (SELECT source, avg(score) AS mean FROM scored GROUP BY 1 HAVING count(*) >= 5)
SELECT 'top' AS side, source, round(mean, 6) AS mean FROM (SELECT * FROM c ORDER BY mean DESC, source LIMIT 3) UNION ALL SELECT 'bottom', source, round(mean, 6) FROM (SELECT * FROM c ORDER BY mean, source DESC LIMIT 3)""",
    "argmax_per_class": f"WITH {SCORED} SELECT lang, doc_id, score FROM scored QUALIFY row_number() OVER (PARTITION BY lang ORDER BY score DESC, doc_id) = 1",
    "anova_p": "WITH " + ", ".join(f"c{k} AS (SELECT l_returnflag AS c, count({x}) AS n, avg({x}) AS m, var_pop({x}) AS v FROM lineitem GROUP BY 1), a{k} AS (SELECT avg({x}) AS mu FROM lineitem), f{k} AS (SELECT '{x}' AS feature, count(*) - 1 AS between, (sum(n) - count(*))::bigint AS within, (sum(n * (m - mu) * (m - mu)) / (count(*) - 1)) / (sum(n * v) / (sum(n) - count(*)) + 1e-12::double) AS f FROM c{k}, a{k})" for k, x in enumerate(("l_quantity", "l_extendedprice", "l_discount")))
    + " SELECT feature, between, within, round(exp(within / 2.0::double * ln(within / (within + between * f))), 9) AS p FROM (" + " UNION ALL ".join(f"SELECT * FROM f{k}" for k in range(3)) + ")",  # exact for three classes
    "entry_checks": "SELECT count(*) AS n, count(*) FILTER (coalesce(trim(event_type), '') = '') AS empty_labels, count(DISTINCT event_type) FILTER (trim(event_type) <> '') AS classes, count(*) = count(DISTINCT event_id) AS as_expected, CASE WHEN count(*) <> count(DISTINCT event_id) THEN 'length_mismatch' WHEN count(*) FILTER (coalesce(trim(event_type), '') = '') > 0 THEN 'empty_labels' ELSE 'ok' END AS verdict FROM events",
    "anova_f": "WITH " + ", ".join(f"c{k} AS (SELECT l_returnflag AS c, count({x}) AS n, avg({x}) AS m, var_pop({x}) AS v FROM lineitem GROUP BY 1), a{k} AS (SELECT avg({x}) AS mu FROM lineitem)" for k, x in enumerate(("l_quantity", "l_extendedprice", "l_discount")))
    + " ".join(f" {'UNION ALL ' if k else ''}SELECT '{x}' AS feature, round(sum(n * (m - mu) * (m - mu)) / (count(*) - 1) / (sum(n * v) / (sum(n) - count(*)) + 1e-12), 6) AS f FROM c{k}, a{k}" for k, x in enumerate(("l_quantity", "l_extendedprice", "l_discount"))),
    "class_weights": """WITH c AS (SELECT l_returnflag, count(*) AS n FROM lineitem GROUP BY 1), w AS (SELECT sum(n) AS t, count(*) AS k, sum(1 / n) AS s FROM c)
SELECT l_returnflag, n, round((t / (k * n))::double, 8) AS balanced, round((k / n / s)::double, 8) AS rescaled FROM c, w""",
    "version_comparison": f"""WITH {SCORED}, a AS (SELECT source, avg(score) AS a FROM scored WHERE doc_id % 2 = 0 GROUP BY 1), b AS (SELECT source, avg(score) AS b FROM scored WHERE doc_id % 2 = 1 GROUP BY 1)
SELECT source, round(a, 6) AS a, round(b, 6) AS b, round(b - a, 6) AS delta FROM a FULL JOIN b USING (source)""",
}
