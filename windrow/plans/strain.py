"""Strain, images, fallbacks and single figures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import array_percentile, clipped_first, reshaped, resized, resized_image, sigmoid, softplus, spaced, tiled
from ..operators import joins, metrics, signal
from .lookups import TOLERANCE
from .tables import SCORED, TRIG, WIN, scored, table, triggers, windows

#: Fine classes of the published trigger catalogues and the coarse classes they belong to, fixed values.
LOUD = ("Extremely_Loud", "Chirp", "Koi_Fish")
BURST = ("Blip", "Blip_Low_Frequency", "Repeating_Blips", "Low_Frequency_Burst", "Fast_Scattering", "Scratchy")
SCATTER = ("Scattered_Light", "Wandering_Line")
LINE = ("Low_Frequency_Lines", "60Hz_Line", "Whistle", "Violin_Mode", "Violin_Mode_Harmonic", "Power_Line")
OTHER = ("No_Glitch", "Air_Compressor", "Helix", "Light_Modulation", "Paired_Doves", "Tomte")
#: The narrower table, by coarse class; all else is Other.
NARROW = {"Loud": ("Extremely_Loud", "Koi_Fish", "Chirp"), "Burst": ("Low_Frequency_Burst", "Blip", "Blip_Low_Frequency"), "Scatter": ("Scattered_Light", "Fast_Scattering")}
#: A third table, in which lines stand alone.
BY_LINE = {"Loud": ("Extremely_Loud", "Koi_Fish"), "Burst": ("Low_Frequency_Burst", "Blip", "Blip_Low_Frequency"), "Scatter": ("Scattered_Light", "Fast_Scattering"), "Line": ("Low_Frequency_Lines", "Power_Line", "Violin_Mode", "Wandering_Line")}
WIDE = {"Loud": LOUD, "Burst": BURST, "Scatter": SCATTER, "Line": LINE}
FINE = (*LOUD, *BURST, *SCATTER, *LINE, *OTHER, "Unheard_Of")


def coarse(fine: Column, table_: dict[str, tuple[str, ...]] = WIDE) -> Column:
    """The coarse class of a fine one, by a table that the caller may replace; Other where it is not in it."""
    out = F
    for name, members in table_.items():
        out = out.when(fine.isin(*members), name)
    return out.otherwise("Other")


def fine_to_coarse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two tables of classes over the events, whose ids stand for fine classes."""
    fine = F.element_at(F.array(*map(F.lit, FINE)), (F.col("event_id") % len(FINE)).cast("int") + 1)
    rows = table(spark, sf_dir, "events").select(coarse(fine).alias("wide"), coarse(fine, NARROW).alias("narrow"))
    return rows.groupBy("wide", "narrow").agg(F.count(F.lit(1)).alias("n"))


def nearest_with_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a window without a trigger in reach gets: its own snr, frequency from its log energy, unit duration, no bandwidth."""
    own = windows(spark, sf_dir).select("window_id", "t0", "ifo", "energy", F.log1p("energy").alias("log_energy"))
    near = triggers(spark, sf_dir).withColumns({"peak_frequency": F.col("snr") * 2, "duration": F.col("snr") / 10, "bandwidth": F.col("snr") + 1})
    met = joins.nearest(own, near, "t0", "t", TOLERANCE, ["ifo"], closed=True)
    other = {"snr": F.col("energy"), "peak_frequency": F.expm1("log_energy"), "duration": F.lit(1.0), "bandwidth": F.lit(0.0)}
    return met.select("window_id", *[F.round(F.when(F.col("match").isNotNull(), F.col(f"match.{c}")).otherwise(v), 6).alias(c) for c, v in other.items()])


def cropped_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of 16 samples out of blocks of 64, one read of a block for all its spans; the third leaves its block."""
    rows = table(spark, sf_dir, "embeddings")
    blocks = rows.select(F.col("vec_id").alias("block"), F.lit(0.0).alias("block_start"), F.col("embedding").alias("samples"))
    starts = F.explode(F.array(F.lit(0.25), F.lit(0.5), F.lit(0.9))).alias("start")
    out = signal.spans(rows.select(F.col("vec_id").alias("block"), starts).withColumn("seconds", F.lit(0.25)), blocks, 64)
    return out.select("block", "start", F.size("samples").alias("n"), F.round(F.aggregate("samples", F.lit(0.0), lambda a, x: a + x), 5).alias("total"))


def window_normalised(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Energies over their 99th percentile, clipped to [0, 1], with the 90th percentile of their logarithms."""
    z = F.transform(F.col("embedding"), lambda x: F.log1p(F.greatest(x.cast("double"), F.lit(0.0))))
    rows = table(spark, sf_dir, "embeddings").select("vec_id", z.alias("z"))
    scaled = F.transform("z", lambda x: F.least(F.lit(1.0), x / F.col("p99")))
    rows = rows.withColumn("p99", array_percentile(F.col("z"), 0.99) + 1e-6)
    return rows.select("vec_id", F.round(array_percentile(F.col("z"), 0.9), 6).alias("log_energy"), F.round(F.aggregate(scaled, F.lit(0.0), lambda a, x: a + x), 5).alias("total"))


def resized_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Arrays of 64 stretched to 127, ends on ends: every second number is a mean of its neighbours."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", resized(F.col("embedding"), 64, 127).alias("wide"))
    return rows.select("vec_id", F.size("wide").alias("n"), F.round(F.aggregate("wide", F.lit(0.0), lambda a, x: a + x), 5).alias("total"))


def reshaped_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Arrays of 64 as images of 8 by 8, enlarged to 15 by 15, with the row in the middle of two and a tile of the first row."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", reshaped(F.col("embedding"), 8).alias("image"))
    rows = rows.withColumn("large", resized_image(F.col("image"), (8, 8), (15, 15)))
    total = lambda xs: F.round(F.aggregate(xs, F.lit(0.0), lambda a, x: a + x), 5)
    return rows.select("vec_id", F.size("large").alias("n"), total(F.flatten("large")).alias("total"), total(F.col("large")[1]).alias("second"), F.size(tiled(F.col("image")[0], 3)).alias("tile"))


def strain_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole chain on every array, as 64 samples a second: conditioned, then an image of 8 by 8 with its log energy. Tested against NumPy."""
    work = lambda x: (lambda z, e: [*z.ravel(), e])(*signal.image(signal.conditioned(x, 64.0, 64.0, 2.0, 24.0, (10.0, 20.0)), 64.0, (0.1, 0.9), (4.0, 24.0), (4.0, 8.0), (8, 8)))
    rows = signal.mapped(table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("x")), "x", work, "made")
    return rows.select("vec_id", "ok", F.slice("made", 1, 64).alias("image"), F.element_at("made", 65).alias("log_energy"))


def scaled_clip_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clipped to the bounds first, then scaled, and the activations of it."""
    rows = table(spark, sf_dir, "part").select("p_partkey", clipped_first(F.col("p_retailprice"), 1000.0, 1500.0).alias("x"))
    return rows.select("p_partkey", F.round("x", 6).alias("x"), F.round(softplus(F.col("x")), 6).alias("softplus"), F.round(sigmoid(F.col("x")), 6).alias("sigmoid"))


def verdict_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bands of the best of a score, its inverse and a stand-in; weighted losses, hours and the weight of positives, by return flag."""
    per = table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(
        F.avg((F.col("l_discount") > 0.05).cast("int")).alias("a"),
        F.avg((F.col("l_tax") > 0.01).cast("int")).alias("b"),
        metrics.weighted_mean("l_discount", "l_quantity").alias("loss"),
        metrics.hours("l_quantity").alias("hours"),
        metrics.positive_weight(F.col("l_linestatus") == "O", F.col("l_linestatus") == "F").alias("pos_weight"),
    )
    best = F.greatest("a", 1 - F.col("a"), "b")
    return per.select("l_returnflag", F.round(best, 6).alias("best"), metrics.band(best).alias("band"), F.round("loss", 6).alias("loss"), F.round("hours", 4).alias("hours"), F.round("pos_weight", 6).alias("pos_weight"))


def score_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Areas under the curves of two scores of documents, the best of them, and its band."""
    rows = scored(spark, sf_dir).withColumn("other", F.length("source").cast("double"))
    out = metrics.verdict(rows, {"a": "score", "b": "other"}, "truth")
    return out.select(*[F.round(c, 8).alias(c) for c in ("a", "b", "best")], "band")


def fine_to_coarse_by_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The third table of classes, with lines as a class of their own, and names as they are printed."""
    fine = F.element_at(F.array(*map(F.lit, FINE)), (F.col("event_id") % len(FINE)).cast("int") + 1)
    rows = table(spark, sf_dir, "events").select(coarse(fine, BY_LINE).alias("coarse"), spaced(fine).alias("fine"))
    return rows.groupBy("coarse").agg(F.count(F.lit(1)).alias("n"), F.min("fine").alias("first"))


QUERIES = {f.__name__: f for f in (fine_to_coarse, nearest_with_fallback, cropped_spans, window_normalised, resized_rows, reshaped_images, strain_images, scaled_clip_first, verdict_bands, score_verdict, fine_to_coarse_by_line)}


def _sql_case(table_: dict[str, tuple[str, ...]]) -> str:
    return "CASE " + " ".join(f"WHEN f IN ({', '.join(repr(x) for x in members)}) THEN '{name}'" for name, members in table_.items()) + " ELSE 'Other' END"


ORACLES = {
    "fine_to_coarse": f"WITH f AS (SELECT [{', '.join(repr(x) for x in FINE)}][event_id % {len(FINE)} + 1] AS f FROM events) SELECT {_sql_case(WIDE)} AS wide, {_sql_case(NARROW)} AS narrow, count(*) AS n FROM f GROUP BY 1, 2",
    "nearest_with_fallback": f"""WITH {TRIG}, {WIN}, c AS (SELECT w.window_id, t.snr, row_number() OVER (PARTITION BY w.window_id ORDER BY abs(t.t - w.t0), t.t) AS n FROM win w JOIN trig t ON t.ifo = w.ifo AND abs(t.t - w.t0) <= {TOLERANCE})
SELECT w.window_id, round(coalesce(c.snr, energy), 6) AS snr, round(coalesce(c.snr * 2, exp(ln(1 + energy)) - 1), 6) AS peak_frequency, round(coalesce(c.snr / 10, 1), 6) AS duration, round(coalesce(c.snr + 1, 0), 6) AS bandwidth
FROM win w LEFT JOIN c ON c.window_id = w.window_id AND c.n = 1""",
    "cropped_spans": """WITH s AS (SELECT vec_id AS block, s::double AS start, (s * 64 + 0.5)::int AS i, embedding AS e FROM embeddings, (VALUES (0.25), (0.5), (0.9)) v(s))
SELECT block, start, CASE WHEN start < 0.8 THEN 16 END AS n, CASE WHEN start < 0.8 THEN round(list_sum(list_transform(e[(start * 64)::int + 1:(start * 64)::int + 16], lambda x: x::double)), 5) END AS total FROM s""",
    "window_normalised": """WITH p AS (SELECT vec_id, ln(1 + greatest(unnest(embedding)::double, 0)) AS z FROM embeddings), q AS (SELECT vec_id, quantile_cont(z, 0.99) + 1e-6::double AS p99, quantile_cont(z, 0.9) AS p90 FROM p GROUP BY 1)
SELECT p.vec_id, round(max(p90), 6) AS log_energy, round(sum(least(1, z / p99)), 5) AS total FROM p JOIN q ON p.vec_id = q.vec_id GROUP BY 1""",
    "resized_rows": """SELECT vec_id, 127 AS n, round(list_sum(list_transform(range(0, 127), lambda k: (embedding[(k // 2) + 1]::double + embedding[((k + 1) // 2) + 1]::double) / 2)), 5) AS total FROM embeddings""",
    "reshaped_images": """WITH p AS (SELECT vec_id, embedding AS e, r.i AS i, c.j AS j FROM embeddings, range(15) r(i), range(15) c(j)),
v AS (SELECT vec_id, i, j, (e[(i // 2) * 8 + j // 2 + 1]::double + e[(i // 2) * 8 + (j + 1) // 2 + 1] + e[((i + 1) // 2) * 8 + j // 2 + 1] + e[((i + 1) // 2) * 8 + (j + 1) // 2 + 1]) / 4 AS v FROM p)
SELECT vec_id, 15 AS n, round(sum(v), 5) AS total, round(sum(v) FILTER (i = 1), 5) AS second, 24 AS tile FROM v GROUP BY 1""",
    "scaled_clip_first": "WITH c AS (SELECT p_partkey, (least(greatest(p_retailprice, 1000.0::double), 1500.0::double) - 1000.0::double) / 500.0::double AS x FROM part) SELECT p_partkey, round(x, 6) AS x, round(ln(1 + exp(x)), 6) AS softplus, round(1 / (1 + exp(-x)), 6) AS sigmoid FROM c",
    "verdict_bands": """WITH p AS (SELECT l_returnflag, avg((l_discount > 0.05::double)::int) AS a, avg((l_tax > 0.01::double)::int) AS b, sum(l_discount * l_quantity) / sum(l_quantity) AS loss, sum(l_quantity) / 3600 AS hours,
count(*) FILTER (l_linestatus = 'F')::double / nullif(count(*) FILTER (l_linestatus = 'O'), 0) AS w FROM lineitem GROUP BY 1)
SELECT l_returnflag, round(greatest(a, 1 - a, b), 6) AS best, CASE WHEN greatest(a, 1 - a, b) > 0.85 THEN 'strong' WHEN greatest(a, 1 - a, b) > 0.7 THEN 'fair' ELSE 'weak' END AS band, round(loss, 6) AS loss, round(hours, 4) AS hours, round(w, 6) AS pos_weight FROM p""",
    "score_verdict": f"""WITH {SCORED}, x AS (SELECT 'a' AS k, score AS s, truth FROM scored WHERE score IS NOT NULL UNION ALL SELECT 'b', length(source), truth FROM scored WHERE source IS NOT NULL),
r AS (SELECT *, rank() OVER (PARTITION BY k ORDER BY s) + (count(*) OVER (PARTITION BY k, s) - 1) / 2.0::double AS rk FROM x),
u AS (SELECT k, (sum(rk) FILTER (truth = 1) - count(*) FILTER (truth = 1) * (count(*) FILTER (truth = 1) + 1) / 2) / (count(*) FILTER (truth = 1) * count(*) FILTER (truth <> 1)) AS u FROM r GROUP BY 1),
v AS (SELECT max(u) FILTER (k = 'a') AS a, max(u) FILTER (k = 'b') AS b FROM u), w AS (SELECT *, greatest(a, b, 1 - a) AS best FROM v)
SELECT round(a, 8) AS a, round(b, 8) AS b, round(best, 8) AS best, CASE WHEN best > 0.85 THEN 'strong' WHEN best > 0.7 THEN 'fair' ELSE 'weak' END AS band FROM w""",
    "fine_to_coarse_by_line": f"WITH f AS (SELECT [{', '.join(repr(x) for x in FINE)}][event_id % {len(FINE)} + 1] AS f FROM events) SELECT {_sql_case(BY_LINE)} AS coarse, count(*) AS n, min(replace(f, '_', ' ')) AS first FROM f GROUP BY 1",
}
