"""What is kept in files: catalogues as CSV, windows by folder, jobs and runs in ledgers, streamed blocks; written from the tables, read again by the sources."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import micros, slug
from ..operators import ledger, metrics, staging
from ..sources import catalogue
from ..streaming import blocks
from .tables import MIDDLE, SCORED, SECOND, scored, streamed, table

#: The files that events are dealt to, by detector and half of the month; the last is never written.
PARTITIONS = [("H1", "a"), ("H1", "b"), ("L1", "a"), ("L1", "b")]
#: What a trigger must have, and the span of time, in seconds.
CONFIDENCE, SNR, SPAN, EXCLUDED = 0.5, 7.5, (1_704_240_000, 1_706_400_000), "c3"
#: Blocks of the stream and how late a row may be, in microseconds.
BLOCK, LATE = 6 * 3600 * SECOND, 3600 * SECOND


def _catalogues(spark: SparkSession, sf_dir: str) -> str:
    """A folder with events as trigger catalogues: three headers, two names of the detector, times, confidences and ratios that are missing or no numbers."""
    e, us = F.col("event_id"), micros(F.col("ts"))
    second = lambda x: (x.cast("decimal(20,0)") / F.lit(SECOND).cast("decimal(20,0)")).cast("decimal(20,6)").cast("string")
    some = lambda every, rest, text, off=0: F.when(e % every == off, text).otherwise(rest.cast("string"))
    none = F.lit(None).cast("string")
    detector = F.when(F.col("user_id") % 2 == 0, "H1").otherwise("L1")
    fields = {
        "gravityspy_id": e.cast("string"),
        "ifo": some(23, detector, none),
        "peak_time": some(17, F.when(e % 17 == 1, none).otherwise(F.floor(us / SECOND).cast("string")), "n/a"),
        "peak_time_ns": some(17, us % SECOND * 1000, "x", 2),
        "event_time": F.when(e % 17 == 1, second(us)),
        "ml_label": some(11, F.concat(F.lit("c"), (F.col("user_id") % 5).cast("string")), none),
        "ml_confidence": some(19, e % 100 / 100, "high"),
        "snr": some(13, F.col("value"), "?"),
    }
    heads: dict[str, dict[str, Column]] = {
        "H1_a": fields,
        "H1_b": {"snr": fields["snr"], "label": fields["ml_label"], "event_time": some(17, second(us), "n/a"), "ml_confidence": fields["ml_confidence"], "gravityspy_id": fields["gravityspy_id"], "ifo": fields["ifo"]},
        "L1_a": {"detector": fields["ifo"]} | {n: fields[n] for n in ("peak_time", "peak_time_ns", "ml_label", "ml_confidence", "snr", "gravityspy_id")},
    }
    half = F.when(us < MIDDLE, "a").otherwise("b")
    events, root = table(spark, sf_dir, "events").withColumn("_file", F.concat_ws("_", detector, half)), staging.folder(spark)
    for name, columns in heads.items():
        events.filter(F.col("_file") == name).select(*[c.alias(n) for n, c in columns.items()]).write.option("header", True).csv(f"{root}/{name}.csv")
    return root


def _read(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalogue.read_catalogue(spark, f"{_catalogues(spark, sf_dir)}/*.csv")


def skipped_triggers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row: of all triggers how many each test turns away first, and how many are kept."""
    tests = catalogue.filters(ifo="H1", confidence=CONFIDENCE, snr=SNR, span=SPAN, excluded=(EXCLUDED,))
    return catalogue.skipped(_read(spark, sf_dir), tests)


def selected_triggers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Triggers of any detector with a label, a time, and confidence and ratio enough."""
    kept = catalogue.selected(_read(spark, sf_dir), catalogue.filters(confidence=CONFIDENCE, snr=SNR))
    return kept.select("gravityspy_id", "label", "snr", F.round(F.col("t") * SECOND).cast("long").alias("t_us"))


def detector_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By catalogue: its rows, those of detector H1 or of none that have a time, and the first and last of these times."""
    root = f"{_catalogues(spark, sf_dir)}/*.csv"
    name = F.regexp_extract("file", r"(\w+)\.csv", 1).alias("catalogue")
    sizes = catalogue.counted(spark, root, "H1").groupBy(name).agg(F.sum("rows").alias("n_rows"), F.sum("kept").alias("kept"))
    us = F.round(F.col("t") * SECOND).cast("long")
    times = catalogue.peak_times(spark, root, "H1").groupBy(name).agg(F.min(us).alias("first_us"), F.max(us).alias("last_us"))
    return sizes.join(times, "catalogue", "left")


def catalogue_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By detector and half: rows, labels and sum of the ratios; a file that is not there has none and is named absent."""
    rows, absent = catalogue.read_files(spark, _catalogues(spark, sf_dir), PARTITIONS)
    found = rows.groupBy("ifo", "epoch").agg(F.count(F.lit(1)).alias("n"), F.count("label").alias("n_labelled"), F.round(F.sum("snr"), 4).alias("snr"), F.lit(False).alias("absent"))
    lacking = spark.createDataFrame([(*n.removesuffix(".csv").split("_"), 0, 0, 0.0, True) for n in absent], "ifo string, epoch string, n long, n_labelled long, snr double, absent boolean")  # a row a file
    return found.union(lacking)


def partitioned_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings written as windows in folders by detector, epoch and length, of which some are read; what exists is left as it is."""
    i, root = F.col("vec_id"), staging.folder(spark)
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("x"), F.when(i % 2 == 0, "H1").otherwise("L1").alias("ifo"), F.element_at(F.array(*map(F.lit, "abc")), (i % 3 + 1).cast("int")).alias("epoch"), F.when(i % 5 < 3, 1.0).otherwise(0.5).alias("dur"), (i * 2.5).alias("t0"))
    catalogue.write_windows(rows, root)
    catalogue.write_windows(rows.limit(1), root, "ignore")
    read = catalogue.read_windows(spark, root, ifos=["H1"], epochs=["a", "c"], durations=[0.5, 1.0])
    name = F.concat_ws("_", "ifo", "epoch", slug(F.format_string("%.1f", F.col("dur").cast("double"))))
    return read.groupBy(name.alias("key")).agg(F.count(F.lit(1)).alias("n"), F.sum("t0").alias("t0"), F.sum("log_energy").alias("log_energy"), F.round(F.avg(F.col("x")[0].cast("double")), 6).alias("x0"))


def _tried(fails: Column) -> Callable[[DataFrame], DataFrame]:
    return lambda left: left.withColumns({"ok": ~fails, "err": F.when(fails, "no strain")})


def resumed_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jobs tried twice: what is done is not tried again; the states, and the numbers of results, of errors that were noted and of jobs that are left."""
    jobs, root, e = table(spark, sf_dir, "events").select("event_id", "value"), staging.folder(spark), F.col("event_id")
    states = [ledger.run_pending(jobs, "event_id", _tried(fails), root) for fails in (e % 7 == 0, e % 49 == 0)]
    results, errors = spark.read.parquet(f"{root}/results"), spark.read.parquet(f"{root}/errors")
    out = results.agg(F.count(F.lit(1)).alias("n_results"), F.round(F.sum("value"), 4).alias("value"))
    out = out.join(errors.agg(F.count(F.lit(1)).alias("n_errors"), F.countDistinct("event_id").alias("failed_once")))  # one row each
    left = jobs.join(results.select("event_id"), "event_id", "left_anti").agg(F.count(F.lit(1)).alias("n_left"))
    return out.join(left).withColumn("states", F.lit(",".join(states)))


def run_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of a quarter of the users each, taken as far as they go: one is done, one has failing jobs, one fails its check, one has no triggers."""
    root, e = staging.folder(spark), F.col("event_id")
    events = table(spark, sf_dir, "events").select("event_id", "user_id")
    never, always = F.lit(False), F.lit(True)
    for k, (fails, has, sane) in enumerate([(never, always, True), (e % 5 == 0, always, True), (never, always, False), (never, never, True)]):
        jobs, folder = events.filter(F.col("user_id") % 4 == k), f"{root}/packed-{k}"
        pack = lambda rows, folder=folder: rows.select("event_id").write.parquet(folder)
        ledger.advance(f"run{k}", root, "event_id", segments=events, triggers=jobs.filter(has), jobs=jobs, work=_tried(fails), target=jobs.count(), pack=pack, sane=lambda rows, sane=sane: sane)
    return ledger.run_states(spark, root).select("run", "state", "done", "target")


def guarded_auroc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Areas by group, of which one has a single class: it has none."""
    group = F.col("doc_id") % 4
    rows = scored(spark, sf_dir).withColumn("part", group).filter((group != 3) | (F.col("truth") == 1))
    return metrics.auroc(rows, "score", "truth", ["part"]).select("part", "n_pos", "n_neg", F.round("auroc", 8).alias("auroc"))


def stream_block_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events read as a stream and counted by block and kind; blocks that the watermark has not passed are still open and not given."""
    events, out = streamed(spark, sf_dir, "events"), staging.folder(spark)
    counts = blocks.block_counts(events, "ts", f"{BLOCK // SECOND} seconds", ["event_type"], late=f"{LATE // SECOND} seconds")
    counts = counts.select(micros(F.col("block_start")).alias("block_us"), "event_type", "n")
    counts.writeStream.format("parquet").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/state").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema("block_us long, event_type string, n long").parquet(f"{out}/rows")


QUERIES = {f.__name__: f for f in (skipped_triggers, selected_triggers, detector_times, catalogue_partitions, partitioned_windows, resumed_jobs, run_states, guarded_auroc, stream_block_counts)}

_CAT = f"""ev AS (SELECT event_id AS e, epoch_us(ts) AS us, user_id % 2 AS d, CASE WHEN user_id % 2 = 0 THEN 'H1' ELSE 'L1' END AS det, CASE WHEN epoch_us(ts) < {MIDDLE} THEN 'a' ELSE 'b' END AS epoch,
 CASE WHEN event_id % 11 <> 0 THEN 'c' || (user_id % 5)::varchar END AS label, CASE WHEN event_id % 19 <> 0 THEN event_id % 100 / 100::double END AS confidence, CASE WHEN event_id % 13 = 0 THEN 0 ELSE value END AS snr FROM events),
cat AS (SELECT *, det || '_' || epoch AS catalogue, CASE WHEN e % 23 <> 0 THEN det END AS named,
 CASE WHEN e % 17 = 0 THEN NULL WHEN det = 'H1' AND epoch = 'b' THEN us WHEN e % 17 = 1 AND det = 'L1' THEN NULL WHEN e % 17 = 2 THEN us // {SECOND} * {SECOND} ELSE us END AS t_us FROM ev WHERE det = 'H1' OR epoch = 'a')"""
_FAILED = f"""CASE WHEN named IS DISTINCT FROM 'H1' THEN 'ifo' WHEN confidence IS NULL OR confidence < {CONFIDENCE}::double THEN 'confidence' WHEN label IS NULL THEN 'label' WHEN label = '{EXCLUDED}' THEN 'excluded'
 WHEN t_us IS NULL OR t_us NOT BETWEEN {SPAN[0] * SECOND} AND {SPAN[1] * SECOND} THEN 'time' WHEN snr < {SNR}::double THEN 'snr' ELSE 'none' END"""
ORACLES = {
    "skipped_triggers": f"WITH {_CAT}, m AS (SELECT {_FAILED} AS failed FROM cat) SELECT {', '.join(f"count(*) FILTER (failed = '{n}') AS skipped_{n}" for n in ('ifo', 'confidence', 'label', 'excluded', 'time', 'snr'))}, count(*) FILTER (failed = 'none') AS kept FROM m",
    "selected_triggers": f"WITH {_CAT} SELECT e::varchar AS gravityspy_id, label, snr, t_us FROM cat WHERE confidence >= {CONFIDENCE}::double AND label IS NOT NULL AND t_us IS NOT NULL AND snr >= {SNR}::double",
    "detector_times": f"WITH {_CAT}, k AS (SELECT *, coalesce(named, 'H1') = 'H1' AND t_us IS NOT NULL AS own FROM cat) SELECT catalogue, count(*) AS n_rows, count(*) FILTER (own) AS kept, min(t_us) FILTER (own) AS first_us, max(t_us) FILTER (own) AS last_us FROM k GROUP BY 1",
    "catalogue_partitions": f"WITH {_CAT} SELECT det AS ifo, epoch, count(*) AS n, count(label) AS n_labelled, round(sum(snr), 4) AS snr, false AS absent FROM cat GROUP BY 1, 2 UNION ALL SELECT 'L1', 'b', 0::bigint, 0::bigint, 0::double, true",
    "partitioned_windows": """WITH w AS (SELECT 'H1_' || CASE WHEN vec_id % 3 = 0 THEN 'a' ELSE 'c' END || CASE WHEN vec_id % 5 < 3 THEN '_1p0' ELSE '_0p5' END AS key, vec_id * 2.5::double AS t0, embedding[1]::double AS x FROM embeddings WHERE vec_id % 2 = 0 AND vec_id % 3 <> 1)
SELECT key, count(*) AS n, sum(t0) AS t0, 0::double AS log_energy, round(avg(x), 6) AS x0 FROM w GROUP BY 1""",
    "resumed_jobs": """SELECT count(*) FILTER (event_id % 49 <> 0) AS n_results, round(sum(value) FILTER (event_id % 49 <> 0), 4) AS value, count(*) FILTER (event_id % 7 = 0) + count(*) FILTER (event_id % 49 = 0) AS n_errors,
count(DISTINCT event_id) FILTER (event_id % 7 = 0) AS failed_once, count(*) FILTER (event_id % 49 = 0) AS n_left, 'partial,partial' AS states FROM events""",
    "run_states": """SELECT 'run' || k AS run, ['done', 'partial', 'sanity_failed', 'no_triggers'][k + 1] AS state, CASE k WHEN 3 THEN 0 WHEN 1 THEN good ELSE n END::bigint AS done, n AS target
FROM (SELECT user_id % 4 AS k, count(*) AS n, count(*) FILTER (event_id % 5 <> 0) AS good FROM events GROUP BY 1)""",
    "guarded_auroc": f"""WITH {SCORED}, r AS (SELECT doc_id % 4 AS part, truth, rank() OVER (PARTITION BY doc_id % 4 ORDER BY score) + (count(*) OVER (PARTITION BY doc_id % 4, score) - 1) / 2.0::double AS rk FROM scored WHERE doc_id % 4 <> 3 OR truth = 1),
a AS (SELECT part, count(*) FILTER (truth = 1) AS n_pos, count(*) FILTER (truth <> 1) AS n_neg, sum(rk) FILTER (truth = 1) AS s FROM r GROUP BY 1)
SELECT part, n_pos, n_neg, round(CASE WHEN n_pos * n_neg > 0 THEN (s - n_pos * (n_pos + 1) / 2) / (n_pos * n_neg) END, 8) AS auroc FROM a""",
    "stream_block_counts": f"""WITH x AS (SELECT epoch_us(ts) // {BLOCK} * {BLOCK} AS block_us, event_type, count(*) AS n FROM events GROUP BY 1, 2)
SELECT * FROM x WHERE block_us + {BLOCK} <= (SELECT max(epoch_us(ts)) // 1000 * 1000 - {LATE} FROM events)""",
}
