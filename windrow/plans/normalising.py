"""Percentiles, normalisation, array checks and histograms."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import array_percentile, array_variance, finite, sanitise, tercile
from ..operators import metrics, norm, ranking, staging
from ..sources import archives
from .tables import scored, table

FEATURES = ["l_quantity", "l_extendedprice"]


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", "event_type", "value")


def nominal_filter_p95(spark: SparkSession, sf_dir: str) -> DataFrame:
    return norm.up_to_percentile(_events(spark, sf_dir), "value")


def nominal_filter_by_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return norm.up_to_percentile(_events(spark, sf_dir), "value", keys=["event_type"]).select("event_id", "event_type", "value")


def multi_percentile(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _events(spark, sf_dir)
    p = ranking.quantiles(rows, ["event_type"], "value", [0.1, 0.5, 0.9, 0.99])
    rows = ranking.same(rows.groupBy("event_type").agg(F.min("value").alias("low"), F.max("value").alias("high"), F.avg("value").alias("mean"), F.stddev_pop("value").alias("std")), p, ["event_type"])
    return rows.select("event_type", *[F.round(F.col("q")[k], 6).alias(f"p{n}") for k, n in enumerate((10, 50, 90, 99))], "low", "high", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"))


def pixel_p1_p99(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Over all numbers of all arrays, from counts of distinct values, so that no task buffers them all."""
    pixels = table(spark, sf_dir, "embeddings").select(F.explode(F.col("embedding").cast("array<double>")).alias("v"))
    low, high = ranking.percentiles(pixels, "v", [0.01, 0.99])
    return spark.range(1).select(F.round(F.lit(low), 6).alias("p1"), F.round(F.lit(high), 6).alias("p99"))


def array_p90_energy(spark: SparkSession, sf_dir: str) -> DataFrame:
    energy = F.log1p(sanitise(array_percentile(F.col("embedding"), 0.9)))
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(energy, 6).alias("log_energy"))


def flat_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return rows.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.count_if(array_variance(F.col("embedding")) < 0.0155).alias("flat"))


def sanity_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return norm.sanity(rows, F.col("embedding"), F.col("label").cast("double"), F.col("vec_id"), 1, 400)


def clipped_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("label", norm.clipped_share(F.col("embedding"), -0.2, 0.2).alias("pct"))
    return rows.groupBy("label").agg(F.round(F.avg("pct"), 6).alias("clipped_pct"))


def finite_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items whose price a unit of discount is a finite number."""
    rows = table(spark, sf_dir, "lineitem").withColumn("x", F.when(F.col("l_discount") == 0, float("nan")).otherwise(F.col("l_extendedprice") / F.nullif("l_discount", F.lit(0.0))))
    return rows.filter(finite(F.col("x"))).groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"))


def group_norm_p2_p98(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bounds from the training rows (before 1999); groups without any take the global ones."""
    rows = table(spark, sf_dir, "lineitem").select("l_returnflag", "l_linestatus", "l_shipdate", *FEATURES)
    group = ["l_returnflag", "l_linestatus"]
    bounds = norm.group_bounds(rows.filter("l_shipdate < timestamp_ntz'1999-01-01'"), rows, group, FEATURES)
    return norm.normalised(rows, bounds, group, FEATURES).groupBy(*group).agg(*[F.round(F.avg(f), 6).alias(f"{f}_mean") for f in FEATURES], F.count_if(F.col("l_quantity") >= 1).alias("n_one"), F.count(F.lit(1)).alias("n"))


def global_minmax_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = norm.min_max(table(spark, sf_dir, "lineitem").select("l_returnflag", *FEATURES), FEATURES)
    return rows.groupBy("l_returnflag").agg(*[F.round(F.avg(f), 6).alias(f"{f}_mean") for f in FEATURES])


def combined_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = norm.blended(table(spark, sf_dir, "part").select("p_partkey", "p_retailprice", F.col("p_size").cast("double").alias("p_size")), "p_retailprice", "p_size")
    return rows.select("p_partkey", F.round("score", 6).alias("score"))


def score_histogram60(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ranking.histogram(scored(spark, sf_dir), F.col("score"), ["truth"])
    return rows.select("truth", "bin", "n", F.round("density", 9).alias("density"))


def class_boxplot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.box(scored(spark, sf_dir).select("lang", "score"), "lang", "score")


def tercile_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").select("p_brand", "p_retailprice")
    cuts = ranking.quantiles(rows, [], "p_retailprice", [0.33, 0.67])
    rows = rows.join(F.broadcast(cuts)).withColumn("bin", tercile(F.col("p_retailprice"), F.col("q")[0], F.col("q")[1]))
    return rows.groupBy("p_brand", "bin").agg(F.count(F.lit(1)).alias("n"))


def archived_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings written as archives of arrays, and their totals as read back from them."""
    archives.register(spark)
    path = staging.folder(spark)
    rows = table(spark, sf_dir, "embeddings")
    rows.select(F.col("embedding").alias("x"), F.col("vec_id").cast("double").alias("t0"), F.col("label").cast("float").alias("log_energy")).write.format("windows").mode("append").save(path)
    back = spark.read.format("windows").schema("t0 double, log_energy float, x array<float>").option("rowsPerPartition", 512).load(path)
    total = F.aggregate("x", F.lit(0.0), lambda a, v: a + v)
    return back.select(F.col("t0").cast("long").alias("vec_id"), F.col("log_energy").cast("int").alias("label"), F.size("x").alias("n"), F.round(total, 5).alias("total"))


QUERIES = {f.__name__: f for f in (nominal_filter_p95, nominal_filter_by_partition, multi_percentile, pixel_p1_p99, array_p90_energy, flat_images, sanity_report, clipped_pixels, finite_rows, group_norm_p2_p98, global_minmax_norm, combined_score, score_histogram60, class_boxplot, tercile_bins, archived_windows)}

_PIX = "px AS (SELECT vec_id, label, unnest(embedding)::double AS x FROM embeddings)"
ORACLES = {
    "nominal_filter_p95": "SELECT event_id, event_type, value FROM events WHERE value <= (SELECT quantile_cont(value, 0.95) FROM events)",
    "nominal_filter_by_partition": "SELECT event_id, event_type, value FROM events JOIN (SELECT event_type, quantile_cont(value, 0.95) AS p FROM events GROUP BY 1) USING (event_type) WHERE value <= p",
    "multi_percentile": "SELECT event_type, " + ", ".join(f"round(quantile_cont(value, {n / 100}), 6) AS p{n}" for n in (10, 50, 90, 99)) + ", min(value) AS low, max(value) AS high, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std FROM events GROUP BY 1",
    "pixel_p1_p99": f"WITH {_PIX} SELECT round(quantile_cont(x, 0.01), 6) AS p1, round(quantile_cont(x, 0.99), 6) AS p99 FROM px",
    "array_p90_energy": f"WITH {_PIX} SELECT vec_id, round(ln(1 + greatest(quantile_cont(x, 0.9), 0)), 6) AS log_energy FROM px GROUP BY vec_id",
    "flat_images": f"WITH {_PIX}, v AS (SELECT vec_id, label, var_pop(x) AS v FROM px GROUP BY 1, 2) SELECT label, count(*) AS n, count(*) FILTER (v < 0.0155) AS flat FROM v GROUP BY label",
    "sanity_report": f"""WITH {_PIX}, r AS (SELECT vec_id, label, count(*) FILTER (isnan(x)) AS nans, count(*) FILTER (isinf(x)) AS infs, bool_or(x < -0.1 OR x > 1.1) AS far, var_pop(x) AS v FROM px GROUP BY 1, 2),
s AS (SELECT count(*) AS n, sum(nans)::bigint AS nan_pixels, sum(infs)::bigint AS inf_pixels, count(*) FILTER (far) AS out_of_range, count(*) FILTER (label IS NULL) AS bad_energy, count(*) FILTER (vec_id < 1 OR vec_id > 400) AS bad_time, count(*) FILTER (v < 1e-6) AS flat FROM r)
SELECT *, CASE WHEN nan_pixels > 0 OR inf_pixels > 0 OR bad_energy > 0 THEN 'fail' WHEN out_of_range > 0 OR bad_time > 0 OR flat > 0.05 * n THEN 'warn' ELSE 'ok' END AS verdict FROM s""",
    "clipped_pixels": f"WITH {_PIX}, r AS (SELECT vec_id, label, 100.0::double * count(*) FILTER (x < -0.2::double OR x > 0.2::double) / count(*) AS p FROM px GROUP BY 1, 2) SELECT label, round(avg(p), 6) AS clipped_pct FROM r GROUP BY label",
    "finite_rows": "SELECT l_returnflag, count(*) AS n FROM lineitem WHERE l_discount <> 0 GROUP BY 1",
    "group_norm_p2_p98": """WITH t AS (SELECT * FROM lineitem WHERE l_shipdate < TIMESTAMP '1999-01-01'), a AS (SELECT quantile_cont(l_quantity, 0.02) AS ql, quantile_cont(l_quantity, 0.98) AS qh, quantile_cont(l_extendedprice, 0.02) AS pl, quantile_cont(l_extendedprice, 0.98) AS ph FROM t),
g AS (SELECT l_returnflag AS f, l_linestatus AS s, quantile_cont(l_quantity, 0.02) AS ql, quantile_cont(l_quantity, 0.98) AS qh, quantile_cont(l_extendedprice, 0.02) AS pl, quantile_cont(l_extendedprice, 0.98) AS ph FROM t GROUP BY 1, 2),
b AS (SELECT l.l_returnflag, l.l_linestatus, least(greatest((l_quantity - coalesce(g.ql, a.ql)) / (coalesce(g.qh, a.qh) - coalesce(g.ql, a.ql) + 1e-8), 0), 1) AS q, least(greatest((l_extendedprice - coalesce(g.pl, a.pl)) / (coalesce(g.ph, a.ph) - coalesce(g.pl, a.pl) + 1e-8), 0), 1) AS p
      FROM lineitem l CROSS JOIN a LEFT JOIN g ON g.f = l.l_returnflag AND g.s = l.l_linestatus)
SELECT l_returnflag, l_linestatus, round(avg(q), 6) AS l_quantity_mean, round(avg(p), 6) AS l_extendedprice_mean, count(*) FILTER (q >= 1) AS n_one, count(*) AS n FROM b GROUP BY 1, 2""",
    "global_minmax_norm": """WITH m AS (SELECT min(l_quantity) AS a, max(l_quantity) AS b, min(l_extendedprice) AS c, max(l_extendedprice) AS d FROM lineitem)
SELECT l_returnflag, round(avg((l_quantity - a) / (b - a)), 6) AS l_quantity_mean, round(avg((l_extendedprice - c) / (d - c)), 6) AS l_extendedprice_mean FROM lineitem, m GROUP BY 1""",
    "combined_score": """WITH m AS (SELECT min(p_retailprice) AS a, max(p_retailprice) AS b, min(p_size) AS c, max(p_size) AS d FROM part)
SELECT p_partkey, round(0.7::double * ((p_retailprice - a) / (b - a + 1e-8::double)) + 0.3::double * ((p_size - c) / (d - c + 1e-8::double)), 6) AS score FROM part, m""",
    "score_histogram60": """WITH s AS (SELECT quality AS truth, n_chars::double AS v FROM documents d JOIN labels l ON l.doc_id = d.doc_id), r AS (SELECT truth, min(v) AS lo, max(v) AS hi, count(*) AS c FROM s GROUP BY 1),
b AS (SELECT s.truth, least(floor((v - lo) / ((hi - lo) / 60)), 59)::int AS bin, count(*) AS n, max((hi - lo) / 60) AS w, max(c) AS c FROM s JOIN r ON r.truth = s.truth GROUP BY 1, 2) SELECT truth, bin, n, round(n / (c * w), 9) AS density FROM b""",
    "class_boxplot": """WITH s AS (SELECT lang, n_chars::double AS v FROM documents d JOIN labels l ON l.doc_id = d.doc_id), q AS (SELECT lang, quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.5) AS median, quantile_cont(v, 0.75) AS q3 FROM s GROUP BY 1)
SELECT q.lang, q1, median, q3, min(v) AS low, max(v) AS high FROM q JOIN s ON s.lang IS NOT DISTINCT FROM q.lang AND v BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) GROUP BY 1, 2, 3, 4""",
    "tercile_bins": """WITH q AS (SELECT quantile_cont(p_retailprice, 0.33) AS a, quantile_cont(p_retailprice, 0.67) AS b FROM part)
SELECT p_brand, CASE WHEN p_retailprice <= a THEN 'low' WHEN p_retailprice <= b THEN 'medium' ELSE 'high' END AS bin, count(*) AS n FROM part, q GROUP BY 1, 2""",
    "archived_windows": "SELECT vec_id, label, len(embedding)::int AS n, round(list_sum(list_transform(embedding, lambda x: x::double)), 5) AS total FROM embeddings",
}
