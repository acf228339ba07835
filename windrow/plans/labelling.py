"""Windows labelled by triggers, split by time, and counted."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import labels, norm, ranking, splits, staging
from ..streaming import intervals
from .tables import DUR, MIDDLE, TRIG, WIN, streamed, triggers, windows


def _labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labels.label_windows(windows(spark, sf_dir), triggers(spark, sf_dir), ["ifo"], DUR)


def interval_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _labelled(spark, sf_dir).select("window_id", "match_count", "label", "label_id")


def interval_label_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _labelled(spark, sf_dir).groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.sum("match_count").alias("matches"))


def consolidated_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _labelled(spark, sf_dir).withColumn("epoch", labels.epoch_of(F.col("t0"), 0, MIDDLE))
    return labels.label_counts(rows, ["ifo", "epoch"]).withColumn("level", F.col("level").cast("long"))


def overlap_poisson(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = triggers(spark, sf_dir)
    return labels.match_rates(labels.match_windows(windows(spark, sf_dir), t, ["ifo"], DUR), t, ["ifo"])


def _split(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _labelled(spark, sf_dir)
    return splits.temporal(rows, "t0", excluded=F.col("label") == labels.AMBIGUOUS, times=windows(spark, sf_dir))


def temporal_split_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _split(spark, sf_dir).groupBy("split", "label").agg(F.count(F.lit(1)).alias("n"), F.min("t0").alias("first_t0"), F.max("t0").alias("last_t0"))


def temporal_split_nominal(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = windows(spark, sf_dir)
    bound = ranking.quantiles(rows, [], "energy", [0.95]).select(F.col("q")[0].alias("p95"))
    rows = splits.temporal(rows.join(F.broadcast(bound)), "t0", to_test=F.col("energy") > F.col("p95"))
    return rows.groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("energy") > F.col("p95")).alias("candidates"))


def leakage_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.leakage(_split(spark, sf_dir), "t0")


def temporal_p80(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nominal windows, up to the 95th percentile of energy, split at the 80th percentile of their times."""
    nominal = norm.up_to_percentile(windows(spark, sf_dir), "energy", 0.95)
    rows = splits.temporal(nominal, "t0", train=0.8, val=1.0)
    return rows.groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.min("t0").alias("first_t0"), F.max("t0").alias("last_t0"))


def stream_interval_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clicks and the errors in the minute after each, both read as streams until all there is has been joined."""
    events = streamed(spark, sf_dir, "events")
    at = F.col("ts").cast("timestamp")
    clicks = events.filter("event_type = 'click'").select(F.col("event_id").alias("window_id"), (F.col("user_id") % 2).alias("ifo"), at.alias("start"), (at + F.expr("interval 1 minute")).alias("end"))
    errors = events.filter("event_type = 'error'").select(F.col("event_id").alias("trigger_id"), (F.col("user_id") % 2).alias("ifo"), at.alias("at"))
    joined = intervals.interval_join(clicks, errors, "start", "end", "at", ["ifo"], longest="1 minute")
    out = staging.folder(spark)
    query = joined.select("window_id", "trigger_id").writeStream.format("parquet").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema("window_id long, trigger_id long").parquet(f"{out}/rows")


QUERIES = {f.__name__: f for f in (interval_label, interval_label_stats, consolidated_rollup, overlap_poisson, temporal_split_counts, temporal_split_nominal, leakage_check, temporal_p80, stream_interval_join)}

_MET = f"""{TRIG}, {WIN},
ids AS (SELECT label, row_number() OVER (ORDER BY label) - 1 AS id FROM (SELECT DISTINCT label FROM trig)),
met AS (SELECT w.window_id, count(t.t) AS match_count, arg_min(t.label, t.t) AS first_label FROM win w LEFT JOIN trig t ON t.ifo = w.ifo AND t.t >= w.t0 AND t.t < w.t0 + w.dur GROUP BY w.window_id),
lab AS (SELECT w.*, m.match_count, CASE WHEN match_count = 0 THEN 'noise' WHEN match_count = 1 THEN first_label ELSE 'ambiguous' END AS label,
               CASE WHEN match_count = 0 THEN -1 WHEN match_count = 1 THEN coalesce(ids.id, -1) ELSE -2 END::int AS label_id
        FROM win w JOIN met m USING (window_id) LEFT JOIN ids ON ids.label = m.first_label)"""
_SPLIT = f"""{_MET}, p AS (SELECT quantile_cont(t0::double, 0.7) AS a, quantile_cont(t0::double, 0.85) AS b FROM lab),
spl AS (SELECT lab.*, CASE WHEN label = 'ambiguous' THEN 'excluded' WHEN t0 <= a THEN 'train' WHEN t0 <= b THEN 'val' ELSE 'test' END AS split FROM lab, p)"""
ORACLES = {
    "interval_label": f"WITH {_MET} SELECT window_id, match_count, label, label_id FROM lab",
    "interval_label_stats": f"WITH {_MET} SELECT label, count(*) AS n, sum(match_count)::bigint AS matches FROM lab GROUP BY label",
    "consolidated_rollup": f"""WITH {_MET}, e AS (SELECT *, CASE WHEN t0 BETWEEN 0 AND {MIDDLE} THEN 'a' ELSE 'b' END AS epoch FROM lab)
SELECT ifo, epoch, grouping_id(ifo, epoch)::bigint AS level, count(*) AS total, count(*) FILTER (label = 'noise') AS noise, count(*) FILTER (label = 'ambiguous') AS ambiguous,
       count(*) FILTER (label NOT IN ('noise', 'ambiguous')) AS labelled FROM e GROUP BY ROLLUP (ifo, epoch)""",
    "overlap_poisson": f"""WITH {_MET},
s AS (SELECT ifo, count(*) AS n_windows, count(*) FILTER (match_count = 0) AS n0, count(*) FILTER (match_count = 1) AS n1, count(*) FILTER (match_count = 2) AS n2,
             count(*) FILTER (match_count >= 3) AS n3, avg(match_count) AS m, min(t0) AS lo, max(t0) + max(dur) AS hi, max(dur) AS dur FROM lab GROUP BY ifo),
n AS (SELECT s.*, (SELECT count(*) FROM trig t WHERE t.ifo = s.ifo AND t.t >= s.lo AND t.t < s.hi) AS n_triggers FROM s),
r AS (SELECT *, 100 * (1 - exp(-(n_triggers * dur / 1e6 / ((hi - lo) / 1e6)))) AS e, 100 * (1 - n0 / n_windows) AS o FROM n)
SELECT ifo, n_windows, n_triggers, n0, n1, n2, n3, round_even(m, 4) AS mean_matches, round_even(e, 6) AS expected_pct, round_even(o, 4) AS observed_pct, round_even(o / e, 4) AS ratio FROM r""",
    "temporal_split_counts": f"WITH {_SPLIT} SELECT split, label, count(*) AS n, min(t0) AS first_t0, max(t0) AS last_t0 FROM spl GROUP BY split, label",
    "temporal_split_nominal": f"""WITH {WIN}, p AS (SELECT quantile_cont(t0::double, 0.7) AS a, quantile_cont(t0::double, 0.85) AS b, quantile_cont(energy, 0.95) AS p95 FROM win)
SELECT CASE WHEN energy > p95 THEN 'test' WHEN t0 <= a THEN 'train' WHEN t0 <= b THEN 'val' ELSE 'test' END AS split, count(*) AS n, count(*) FILTER (energy > p95) AS candidates FROM win, p GROUP BY 1""",
    "leakage_check": f"WITH {_SPLIT}, x AS (SELECT max(t0) FILTER (split = 'train') AS last_train, min(t0) FILTER (split = 'test') AS first_test FROM spl) SELECT *, last_train < first_test AS ok FROM x",
    "temporal_p80": f"""WITH {WIN}, n AS (SELECT * FROM win WHERE energy <= (SELECT quantile_cont(energy, 0.95) FROM win)), p AS (SELECT quantile_cont(t0, 0.8) AS a FROM n)
SELECT CASE WHEN t0 <= a THEN 'train' ELSE 'val' END AS split, count(*) AS n, min(t0) AS first_t0, max(t0) AS last_t0 FROM n, p GROUP BY 1""",
    "stream_interval_join": f"WITH {TRIG}, {WIN} SELECT w.window_id, t.trigger_id FROM win w JOIN trig t ON t.ifo = w.ifo AND t.t >= w.t0 AND t.t < w.t0 + w.dur",
}
