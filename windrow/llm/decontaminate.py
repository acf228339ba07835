"""Benchmark decontamination by winnowing.

Of every WINDOW consecutive k-grams of words the one with the least hash is kept,
on both sides alike, so that any shared run of K + WINDOW - 1 words has a kept
k-gram in common. Documents meet the tests on kept k-grams, and each meeting is
extended to the runs of SPAN words around it, which are compared word for word.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common

SPAN, K = 10, 5
#: Test windows up to this many are broadcast; beyond, both joins shuffle.
BROADCAST_WINDOWS = 500_000
#: Documents with hits up to this many are broadcast to all documents; beyond, they are joined by shuffle.
BROADCAST_HITS = 200_000
#: Bits of a packed fingerprint that hold its place in the text.
PLACE_BITS = 26
#: [^\x00-\x2F\x3A-\x60\x7B-\x7F]+, spelled character by character: Java looks those up in one table.
WORD = "[^" + "".join(rf"\x{c:02X}" for c in range(0x80) if not chr(c).isdigit() and not chr(c).islower()) + "]+"
#: Stands for no k-gram: each document meets the tests on it once, with its number of words.
COUNTER = -1


def words(text: Column) -> Column:
    return F.regexp_extract_all(common.ascii_lower(F.coalesce(text, F.lit(""))), F.lit(WORD), 0)


def winnow(words: Column, span: int, k: int) -> Column:
    """Kept k-grams as longs: the hash's lower bits above, the place of the k-gram's first word (from 0) below."""
    last = F.size(words) - k
    grams = F.transform(F.sequence(F.lit(0), last), lambda i: F.shiftleft(F.xxhash64(F.slice(words, i + 1, k)), PLACE_BITS).bitwiseOR(i.cast("long")))
    width = span - k + 1
    kept = lambda g: F.array_distinct(F.transform(F.sequence(F.lit(1), F.size(words) - span + 1), lambda i: F.array_min(F.slice(g, i, width))))
    kept = F.element_at(F.transform(F.array(grams), kept), 1)
    return F.when(F.size(words) >= span, kept).otherwise(F.array().cast("array<bigint>"))


def gram(kept: Column) -> Column:
    return F.shiftrightunsigned(kept, PLACE_BITS)


def place(kept: Column) -> Column:
    return kept.bitwiseAND(F.lit((1 << PLACE_BITS) - 1)).cast("int")


def span_text(words: Column, start: Column, span: int) -> Column:
    return F.array_join(F.slice(words, start + 1, span), " ")


def runs_of(near: Column, first: Column, span: int) -> Column:
    """All runs of span words in near, whose first word is word number first of its text."""
    return F.transform(F.sequence(F.lit(0), F.size(near) - span), lambda i: F.struct((first + i).alias("start"), span_text(near, i, span).alias("window")))


def test_windows(tests: DataFrame, span: int) -> DataFrame:
    """(window, span, item_id), distinct: runs of span words of each item; a shorter item is one run."""
    items = tests.select("item_id", words(F.col("text")).alias("words")).filter(F.size("words") > 0)
    n = F.least(F.size("words"), F.lit(span))
    starts = F.sequence(F.lit(0), F.size("words") - n)
    return items.select("item_id", n.alias("span"), F.explode(F.transform(starts, lambda i: F.array_join(F.slice("words", i + 1, n), " "))).alias("window")).distinct()


def hits(docs: DataFrame, tests: DataFrame, span: int = SPAN, k: int = K) -> tuple[DataFrame, DataFrame, DataFrame]:
    """((doc_id, _key, start, span, window), distinct; the test windows; (doc_id, _key, n_words), a row a document).

    Each document is read once for the test windows of span words, and once
    more for each shorter length that items have.
    """
    windows = common.stage(test_windows(tests, span), "windows")
    spans = {row["span"]: row["n"] for row in windows.groupBy("span").agg(F.count(F.lit(1)).alias("n")).collect()}  # span rows at most
    broad = sum(spans.values()) <= BROADCAST_WINDOWS
    small = F.broadcast if broad else (lambda df: df)
    read = docs.select("doc_id", common.text_key(F.col("text")).alias("_key"), words(F.col("text")).alias("words"))
    counts, found = None, []
    for n in sorted({span, *spans}, reverse=True):
        size = min(k, n)
        texts = windows.filter(F.col("span") == n)
        grams = texts.select(F.explode(winnow(F.split("window", " "), n, size)).alias("kept")).select(gram(F.col("kept")).alias("gram"))
        kept = winnow(F.col("words"), n, size)
        if counts is None:
            grams = grams.union(docs.sparkSession.range(1).select(F.lit(COUNTER).cast("long")))
            kept = F.array_append(kept, F.lit(COUNTER).cast("long"))
        kept = read.select("doc_id", "_key", "words", F.explode(kept).alias("kept"))
        kept = kept.withColumns({"gram": F.when(F.col("kept") == COUNTER, F.col("kept")).otherwise(gram(F.col("kept"))), "at": place(F.col("kept"))})
        # the words around a kept k-gram that the runs which hold it can reach
        first = F.greatest(F.col("at") - (n - size), F.lit(0))
        near = F.when(F.col("kept") != COUNTER, F.slice("words", first + 1, F.col("at") - first + n))
        around = {"first": first, "near": near, "n_words": F.size("words")}
        if broad:
            met = kept.join(small(grams.distinct()), "gram", "left_semi").withColumns(around)
        else:
            met = kept.withColumns(around).drop("words").join(grams.distinct(), "gram", "left_semi")
        met = common.stage(met.select("doc_id", "_key", "first", "near", "n_words"), "met")
        if counts is None:
            counts = met.filter("near is null").select("doc_id", "_key", "n_words")
        runs = met.filter("near is not null").select("doc_id", "_key", F.explode(runs_of(F.col("near"), F.col("first"), n)).alias("run"))
        runs = runs.select("doc_id", "_key", "run.start", F.lit(n).alias("span"), "run.window")
        found.append(runs.join(small(texts.select("window").distinct()), "window", "left_semi").distinct().select("doc_id", "_key", "start", "span", "window"))
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return common.stage(out, "hits"), windows, counts


def contaminated(found: DataFrame, windows: DataFrame) -> DataFrame:
    """(doc_id, _key, n_hit, n_items, items_sha256) of the documents that hold test windows."""
    in_order = Window.partitionBy("doc_id", "_key").orderBy("start", "span")
    ends = F.max(F.col("start") + F.col("span")).over(in_order.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.greatest(F.lit(0), F.col("start") + F.col("span") - F.greatest(F.col("start"), F.coalesce(ends, F.lit(0))))
    counts = found.select("doc_id", "_key", "start", "span").distinct().withColumn("fresh", fresh).groupBy("doc_id", "_key").agg(F.sum("fresh").cast("long").alias("n_hit"))
    items = found.select("doc_id", "_key", "window", "span").distinct().join(windows, ["window", "span"]).select("doc_id", "_key", "item_id").distinct()
    ids = F.sort_array(F.collect_list(F.col("item_id").cast("string")))
    items = items.groupBy("doc_id", "_key").agg(F.count(F.lit(1)).alias("n_items"), F.sha2(F.array_join(ids, ",").cast("binary"), 256).alias("items_sha256"))
    right = items.select(F.col("doc_id").alias("_d"), F.col("_key").alias("_k"), "n_items", "items_sha256")
    return counts.join(right, F.col("doc_id").eqNullSafe(F.col("_d")) & F.col("_key").eqNullSafe(F.col("_k"))).drop("_d", "_k")


def measure(docs: DataFrame, tests: DataFrame, span: int = SPAN, k: int = K) -> DataFrame:
    """Per row of docs: doc_id, n_words, n_hit, n_items, items_sha256, contaminated.

    Null and empty texts have no words. Rows that repeat get the same result
    each; rows that share only their doc_id are told apart by their texts. Items with
    a null text or without words match nothing; items that share an id are one item.
    """
    with common.scratch(docs.sparkSession):
        found, windows, counts = hits(docs, tests, span, k)
        counts = common.stage(counts.withColumn("n_words", F.col("n_words").cast("long")), "counts", keep=True)
        found = common.stage(contaminated(found, windows).withColumnsRenamed({"doc_id": "_d", "_key": "_k"}), "contaminated", keep=True)
    out = counts.join(found, F.col("doc_id").eqNullSafe(F.col("_d")) & F.col("_key").eqNullSafe(F.col("_k")), "left")
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    return out.select("doc_id", "n_words", n_hit.alias("n_hit"), F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"), F.coalesce("items_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


def decontaminate(docs: DataFrame, tests: DataFrame, span: int = SPAN, k: int = K) -> DataFrame:
    """docs without those that hold a test window."""
    with common.scratch(docs.sparkSession):
        found = hits(docs, tests, span, k)[0].select(F.col("doc_id").alias("_d"), F.col("_key").alias("_k")).distinct()
        found = common.stage(found, "found", keep=True)
    found = F.broadcast(found) if found.count() <= BROADCAST_HITS else found
    return docs.join(found, F.col("doc_id").eqNullSafe(F.col("_d")) & common.text_key(F.col("text")).eqNullSafe(F.col("_k")), "left_anti")


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measure(common.table(spark, sf_dir, "documents").select("doc_id", "text"), common.table(spark, sf_dir, "benchmark"))


ORACLE = r"""
WITH dw AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
iw AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS t FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS i FROM (SELECT *, least(len(w), 10) AS n FROM iw WHERE len(w) > 0))),
spans AS (SELECT DISTINCT n FROM win),
runs AS (SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS t FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS i FROM dw, spans WHERE len(w) >= n)),
hit AS (SELECT doc_id, i, r.n, item_id FROM runs r JOIN win USING (n, t)),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT doc_id, i, n FROM hit)) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, sha256(string_agg(s, ',' ORDER BY s)) AS h FROM (SELECT DISTINCT doc_id, item_id::varchar AS s FROM hit) GROUP BY doc_id)
SELECT doc_id, len(w)::bigint AS n_words, coalesce(n_hit, 0)::bigint AS n_hit, coalesce(n_items, 0)::bigint AS n_items,
       coalesce(h, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN pos USING (doc_id) LEFT JOIN its USING (doc_id)
"""
