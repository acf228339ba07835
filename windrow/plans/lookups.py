"""Nearest, tolerant and exact lookups; membership; dedup; blocks and grids."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.scalar import json_number, micros
from ..operators import joins, ranking, splits
from .tables import DUR, SECOND, TRIG, WIN, table, triggers, windows

#: How far a trigger may lie from a window, in microseconds.
TOLERANCE = 120 * SECOND
#: Priorities and what they stand for, in place of fine and coarse classes.
MACRO = {"1-URGENT": "Loud", "2-HIGH": "Loud", "3-MEDIUM": "Burst", "4-NOT SPECIFIED": "Line"}
MACRO_IDS = {"Loud": 0, "Burst": 1, "Scatter": 2, "Line": 3, "Other": 3}
BLOCK = 4096 * SECOND


def nearest_trigger(spark: SparkSession, sf_dir: str) -> DataFrame:
    met = joins.nearest(windows(spark, sf_dir).select("window_id", "t0", "ifo", "energy"), triggers(spark, sf_dir), "t0", "t", TOLERANCE, ["ifo"])
    return met.select("window_id", F.col("match.trigger_id").alias("trigger_id"), F.coalesce("match.snr", "energy").alias("snr"))


def exact_then_tolerance_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    met = joins.exact_then_tolerance(windows(spark, sf_dir).select("window_id", "t0", "ifo"), triggers(spark, sf_dir), "t0", "t", TOLERANCE, ["ifo"], "trigger_id")
    return met.filter("match is not null").select("window_id", F.col("match.trigger_id").alias("trigger_id"), F.col("match.snr").alias("snr"))


def rounded_key_membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = joins.rounded_member(windows(spark, sf_dir), triggers(spark, sf_dir), F.col("t0"), F.col("t"), -8)
    return out.groupBy(F.when(F.col("member"), "H1").otherwise("L1").alias("site")).agg(F.count(F.lit(1)).alias("n"), F.sum("window_id").alias("ids"))


def _segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return triggers(spark, sf_dir).select("ifo", F.col("t").alias("seg_start"), (F.col("t") + 20 * DUR).alias("seg_end"))


def segment_feasible(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = windows(spark, sf_dir).withColumn("t1", F.col("t0") + F.col("dur"))
    return joins.contained(own, _segments(spark, sf_dir), "t0", "t1", 4 * SECOND, ["ifo"], 20 * DUR).select("window_id", "t0")


def resume_antijoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    jobs, done = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), table(spark, sf_dir, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return joins.pending(jobs, done, ["o_orderkey"])


def macro_class_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = joins.looked_up(table(spark, sf_dir, "orders"), "o_orderpriority", MACRO, "macro", "Other")
    rows = joins.looked_up(rows, "macro", MACRO_IDS, "macro_id", -1)
    return rows.groupBy("macro", "macro_id").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "macro")


def dedup_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = joins.keep_last(table(spark, sf_dir, "events"), [F.col("user_id"), F.col("event_type")], F.col("event_id"))
    return rows.select("user_id", "event_type", "event_id", "value")


def dedup_first_rounded(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = joins.keep_first(table(spark, sf_dir, "events"), [F.bround(micros(F.col("ts")), -9)], F.col("event_id"))
    return rows.select("event_id", "value")


def json_meta_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").withColumn("k", json_number(F.col("props"), "dur", "k", default=1.0))
    return rows.groupBy("event_type").agg(F.count("k").alias("n"), F.sum("k").alias("k_sum"), F.max("k").alias("k_max"))


def prediction_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_orderkey") % 5).alias("a"))
    b = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_custkey") % 5).alias("b"))
    both = a.join(b, "o_orderkey")
    out = both.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("a") == F.col("b")).alias("agreed"))
    return out.withColumn("verdict", F.when(F.col("agreed") == F.col("n"), "PASS").otherwise("MISMATCH"))


def block_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = triggers(spark, sf_dir).withColumn("block", F.floor(F.col("t") / BLOCK) * BLOCK)
    return rows.groupBy("ifo", "block").agg(F.count(F.lit(1)).alias("n"), F.max("snr").alias("snr_max"))


def first_n_by_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.first_by_block(triggers(spark, sf_dir), "t", BLOCK, 300, ["ifo"]).select("ifo", "block", "trigger_id")


def densest_blocks_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.first_by_block(triggers(spark, sf_dir), "t", 86400 * SECOND, 150, ["ifo"], densest=True).select("ifo", "block", "trigger_id")


def grid_centers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Centres of three levels a feature over the spans of the data: levels to the power of features, as numbers taken apart."""
    features, levels = ("l_quantity", "l_discount", "l_tax"), 3
    spans = table(spark, sf_dir, "lineitem").agg(*[f(c).alias(f"{n}_{c}") for c in features for n, f in (("low", F.min), ("high", F.max))])
    places = spark.range(levels ** len(features)).join(F.broadcast(spans))  # one row of spans
    level = lambda k: F.floor(F.col("id") / levels**k) % levels / (levels - 1.0)
    return places.select(*[F.round(F.col(f"low_{c}") + level(k) * (F.col(f"high_{c}") - F.col(f"low_{c}")), 9).alias(f"c{k}") for k, c in enumerate(features)])


def decision_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    middle = table(spark, sf_dir, "lineitem").select("l_quantity")
    middle = ranking.quantiles(middle, [], "l_quantity", [0.5]).select(F.col("q")[0].alias("l_quantity"))
    axis = lambda c: spark.range(20).select((F.col("id") / 19.0).alias(c))
    return axis("x").join(axis("y")).join(F.broadcast(middle))


def partition_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every (return flag, line status), with its count or none."""
    items = table(spark, sf_dir, "lineitem")
    dims = items.select("l_returnflag").distinct().join(items.select("l_linestatus").distinct())  # a few rows each
    counts = items.groupBy("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"))
    return dims.join(counts, ["l_returnflag", "l_linestatus"], "left").select("l_returnflag", "l_linestatus", F.coalesce(F.col("n").cast("string"), F.lit("--")).alias("n"))


def class_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of one event type in each user's events: where they begin, their middle and length."""
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type")
    w = Window.partitionBy("user_id").orderBy("event_id")
    rows = rows.withColumns({"rn": F.row_number().over(w).cast("long"), "new": F.coalesce((F.lag("event_type").over(w) != F.col("event_type")).cast("int"), F.lit(1))})
    rows = rows.withColumn("run", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy("user_id", "run", "event_type").agg(F.min("rn").alias("first"), ((F.min("rn") + F.max("rn")) / 2.0).alias("middle"), F.count(F.lit(1)).alias("n"))


QUERIES = {f.__name__: f for f in (nearest_trigger, exact_then_tolerance_lookup, rounded_key_membership, segment_feasible, resume_antijoin, macro_class_counts, dedup_last, dedup_first_rounded, json_meta_extract, prediction_agreement, block_buckets, first_n_by_block, densest_blocks_first, grid_centers, decision_grid, partition_grid, class_runs)}

ORACLES = {
    "nearest_trigger": f"""WITH {TRIG}, {WIN}, c AS (SELECT w.window_id, t.trigger_id, t.snr, row_number() OVER (PARTITION BY w.window_id ORDER BY abs(t.t - w.t0), t.t) AS n FROM win w JOIN trig t ON t.ifo = w.ifo AND abs(t.t - w.t0) <= {TOLERANCE})
SELECT w.window_id, c.trigger_id, coalesce(c.snr, w.energy) AS snr FROM win w LEFT JOIN c ON c.window_id = w.window_id AND c.n = 1""",
    "exact_then_tolerance_lookup": f"""WITH {TRIG}, {WIN}, c AS (SELECT w.window_id, t.trigger_id, t.snr, row_number() OVER (PARTITION BY w.window_id ORDER BY (t.t <> w.t0)::int, t.trigger_id) AS n FROM win w JOIN trig t ON t.ifo = w.ifo AND abs(t.t - w.t0) < {TOLERANCE})
SELECT window_id, trigger_id, snr FROM c WHERE n = 1""",
    "rounded_key_membership": f"""WITH {TRIG}, {WIN}, k AS (SELECT DISTINCT round_even(t::decimal(18,0) / 100000000, 0) AS k FROM trig)
SELECT CASE WHEN round_even(t0::decimal(18,0) / 100000000, 0) IN (SELECT k FROM k) THEN 'H1' ELSE 'L1' END AS site, count(*) AS n, sum(window_id)::bigint AS ids FROM win GROUP BY 1""",
    "segment_feasible": f"""WITH {TRIG}, {WIN} SELECT window_id, t0 FROM win w WHERE EXISTS (SELECT 1 FROM trig t WHERE t.ifo = w.ifo AND t.t <= w.t0 - {4 * SECOND} AND w.t0 + w.dur + {4 * SECOND} <= t.t + {20 * DUR})""",
    "resume_antijoin": "SELECT o_orderkey, o_custkey FROM orders o WHERE NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey AND l_returnflag = 'R')",
    "macro_class_counts": """WITH m AS (SELECT CASE o_orderpriority WHEN '1-URGENT' THEN 'Loud' WHEN '2-HIGH' THEN 'Loud' WHEN '3-MEDIUM' THEN 'Burst' WHEN '4-NOT SPECIFIED' THEN 'Line' ELSE 'Other' END AS macro FROM orders)
SELECT macro, CASE macro WHEN 'Loud' THEN 0 WHEN 'Burst' THEN 1 ELSE 3 END AS macro_id, count(*) AS n FROM m GROUP BY 1, 2""",
    "dedup_last": "SELECT user_id, event_type, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) = 1",
    "dedup_first_rounded": "SELECT event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY round_even(epoch_us(ts)::decimal(18,0) / 1000000000, 0) ORDER BY event_id) = 1",
    "json_meta_extract": """WITH x AS (SELECT event_type, coalesce(try_cast(json_extract_string(props, '$.dur') AS double), try_cast(json_extract_string(props, '$.k') AS double), 1.0::double) AS k FROM events)
SELECT event_type, count(k) AS n, sum(k) AS k_sum, max(k) AS k_max FROM x GROUP BY event_type""",
    "prediction_agreement": "WITH x AS (SELECT count(*) AS n, count(*) FILTER (o_orderkey % 5 = o_custkey % 5) AS agreed FROM orders) SELECT *, CASE WHEN n = agreed THEN 'PASS' ELSE 'MISMATCH' END AS verdict FROM x",
    "block_buckets": f"WITH {TRIG} SELECT ifo, t // {BLOCK} * {BLOCK} AS block, count(*) AS n, max(snr) AS snr_max FROM trig GROUP BY 1, 2",
    "first_n_by_block": f"WITH {TRIG} SELECT ifo, t // {BLOCK} * {BLOCK} AS block, trigger_id FROM trig QUALIFY row_number() OVER (PARTITION BY ifo ORDER BY t) <= 300",
    "densest_blocks_first": f"""WITH {TRIG}, b AS (SELECT *, t // {86400 * SECOND} * {86400 * SECOND} AS block FROM trig), s AS (SELECT *, count(*) OVER (PARTITION BY ifo, block) AS size FROM b)
SELECT ifo, block, trigger_id FROM s QUALIFY row_number() OVER (PARTITION BY ifo ORDER BY size DESC, block, t) <= 150""",
    "grid_centers": """WITH s AS (SELECT min(l_quantity) AS ql, max(l_quantity) AS qh, min(l_discount) AS dl, max(l_discount) AS dh, min(l_tax) AS tl, max(l_tax) AS th FROM lineitem)
SELECT round(ql + a.i / 2.0::double * (qh - ql), 9) AS c0, round(dl + b.i / 2.0::double * (dh - dl), 9) AS c1, round(tl + c.i / 2.0::double * (th - tl), 9) AS c2 FROM s, range(3) a(i), range(3) b(i), range(3) c(i)""",
    "decision_grid": "SELECT a.i / 19.0::double AS x, b.i / 19.0::double AS y, (SELECT median(l_quantity) FROM lineitem) AS l_quantity FROM range(20) a(i), range(20) b(i)",
    "partition_grid": """SELECT f.l_returnflag, s.l_linestatus, coalesce(n::varchar, '--') AS n FROM (SELECT DISTINCT l_returnflag FROM lineitem) f CROSS JOIN (SELECT DISTINCT l_linestatus FROM lineitem) s
LEFT JOIN (SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY 1, 2) c ON c.l_returnflag = f.l_returnflag AND c.l_linestatus = s.l_linestatus""",
    "class_runs": """WITH r AS (SELECT user_id, event_id, event_type, row_number() OVER w AS rn, coalesce((lag(event_type) OVER w <> event_type)::int, 1) AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
g AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY event_id)::bigint AS run FROM r)
SELECT user_id, run, event_type, min(rn) AS first, (min(rn) + max(rn)) / 2.0::double AS middle, count(*) AS n FROM g GROUP BY 1, 2, 3""",
}
