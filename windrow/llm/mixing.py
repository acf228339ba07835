"""Mixing sources to target weights by capped water-filling.

Sources whose share would exceed their maximum epochs are clamped and the excess
goes to the others in proportion to their weights, round by round, until none is
above. A source then repeats whole and, in seeded order, in part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common

SEED = 17
#: Hex digits of the order key that number a source's histogram bins.
BIN_DIGITS = 3


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(common.TOKEN)), F.lit(0)).cast("long")


def water_fill(sources: DataFrame, budget: float, max_epochs: float) -> DataFrame:
    """sources(source_size, weight) with target double.

    Each round is one aggregate over the sources; only its two sums reach the
    driver. The clamped set only grows, so the rounds end. Sources of size 0
    get 0; if all are clamped, the targets add up to less than the budget.
    """
    cap = F.col("source_size") * F.lit(float(max_epochs))
    level, clamped = None, -1
    while True:
        above = F.lit(False) if level is None else F.col("weight") * F.lit(level[0]) / F.lit(level[1]) > cap
        row = sources.agg(
            F.sum(F.when(above, cap)).alias("full"),
            F.sum(F.when(~above, F.col("weight"))).alias("open"),
            F.count_if(above).alias("n"),
        ).first()
        if row["n"] == clamped or not row["open"]:
            break
        level, clamped = (float(budget - (row["full"] or 0.0)), float(row["open"])), row["n"]
    if level is None or not row["open"]:
        return sources.withColumn("target", cap)
    share = F.lit(level[0]) * F.col("weight") / F.lit(level[1])
    return sources.withColumn("target", F.when(F.col("weight") * F.lit(level[0]) / F.lit(level[1]) > cap, cap).otherwise(share))


def cyclic_weights(sources: DataFrame, weights: tuple[float, ...]) -> DataFrame:
    """Weights dealt in turn to the sources by code point, null last."""
    ranked = common.global_rank(sources, F.col("source").asc_nulls_last())
    return ranked.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights)).cast("int") + 1)).drop("rank")


def mix(docs: DataFrame, *, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, max_epochs: float = 2.0, seed: int = SEED) -> DataFrame:
    """docs with size, source_size, target and taken (words of the document that the mix takes).

    A source takes each of its documents floor(target / source_size) times; the
    words that are still missing come from its documents in seeded order (MD5 of
    doc_id and seed), the last of them in part, so a source meets its target to
    the word and no document exceeds max_epochs times its size.

    The place where a source's words run out is found in a histogram of at most
    16^BIN_DIGITS bins a source, so that only one bin's documents are ordered.
    Null source: a source of its own. Null or empty text: size 0, taken 0. Rows that
    repeat are separate documents. No rows: no rows. Other columns pass through.
    """
    own = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c not in ("size", "source_size", "target", "taken")])
    key = F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.lit(f":{seed}")))
    sized = own.withColumns({"size": words(F.col("text")), "_key": key}).withColumn("_bin", F.conv(F.substring("_key", 1, BIN_DIGITS), 16, 10).cast("int"))

    with common.scratch(own.sparkSession):
        bins = common.stage(sized.groupBy("source", "_bin").agg(F.sum("size").alias("bin_size")), "bins")
        sources = common.stage(cyclic_weights(bins.groupBy("source").agg(F.sum("bin_size").alias("source_size")), weights), "sources")
        total = sources.agg(F.sum("source_size")).first()[0] or 0
        filled = water_fill(sources, total * share, max_epochs)
        whole = F.when(F.col("source_size") > 0, F.floor(F.round("target") / F.greatest("source_size", F.lit(1)))).otherwise(0).cast("long")
        filled = filled.withColumn("_whole", whole).withColumn("_rest", F.round("target").cast("long") - F.col("_whole") * F.col("source_size"))

        upto = Window.partitionBy("source").orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
        bins = bins.withColumn("_before", F.coalesce(F.sum("bin_size").over(upto), F.lit(0)))
        edge = bins.join(filled.withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source"))).filter((F.col("_before") <= F.col("_rest")) & (F.col("_rest") < F.col("_before") + F.col("bin_size")))
        edge = edge.select(F.col("source").alias("_source"), F.col("_bin").alias("_edge"), F.col("_before").alias("_edge_before"))
        plan = filled.withColumnRenamed("source", "_source").drop("weight")
        plan = plan.join(edge.withColumnRenamed("_source", "_s"), F.col("_source").eqNullSafe(F.col("_s")), "left").drop("_s")
        plan = common.stage(plan.withColumn("_edge", F.coalesce("_edge", F.lit(16**BIN_DIGITS))), "mix", keep=True)

    dealt = sized.join(plan, F.col("source").eqNullSafe(F.col("_source")))
    away = dealt.filter("_bin <> _edge").withColumn("_more", F.when(F.col("_bin") < F.col("_edge"), F.col("size")).otherwise(0))
    ordered = Window.partitionBy("_source").orderBy("_key", "doc_id", "size", common.text_key(F.col("text"))).rowsBetween(Window.unboundedPreceding, -1)
    left = F.col("_rest") - F.col("_edge_before") - F.coalesce(F.sum("size").over(ordered), F.lit(0))
    at_edge = dealt.filter("_bin = _edge").withColumn("_more", F.least(F.col("size"), F.greatest(F.lit(0), left)))
    out = away.unionByName(at_edge).withColumn("taken", F.col("_whole") * F.col("size") + F.col("_more"))
    return out.select(*own.columns, "size", "source_size", "target", "taken")


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken")


ORACLE = """
WITH s AS (SELECT doc_id, source, text, md5(coalesce(doc_id::varchar, 'null') || ':17') AS k,
                  coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::bigint AS size FROM documents),
src AS (SELECT source, sum(size)::bigint AS source_size FROM s GROUP BY source),
ranked AS (SELECT *, [3, 1, 2][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1]::double AS w, source_size * 2.0::double AS cap FROM src),
total AS (SELECT sum(source_size) * 1.5::double AS t FROM src),
steps AS (SELECT *, row_number() OVER o AS i, t - coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
                 sum(w) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open
          FROM ranked, total WINDOW o AS (ORDER BY cap / w, source NULLS LAST)),
lvl AS (SELECT * FROM steps WHERE w * rest / open <= cap ORDER BY i LIMIT 1),
tgt AS (SELECT s.source, s.source_size, CASE WHEN lvl.i IS NULL OR s.i < lvl.i THEN s.cap ELSE lvl.rest * s.w / lvl.open END AS target FROM steps s LEFT JOIN lvl ON true),
whole AS (SELECT *, CASE WHEN source_size > 0 THEN floor(round(target) / greatest(source_size, 1)) ELSE 0 END::bigint AS whole FROM tgt),
cum AS (SELECT s.*, w.source_size, w.target, w.whole, round(w.target)::bigint - w.whole * w.source_size AS rest,
               coalesce(sum(s.size) OVER (PARTITION BY s.source ORDER BY s.k, s.doc_id, s.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
        FROM s JOIN whole w ON s.source IS NOT DISTINCT FROM w.source)
SELECT doc_id, size, source_size, target, (whole * size + least(size, greatest(0, rest - before)))::bigint AS taken FROM cum
"""
