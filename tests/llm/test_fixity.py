"""Replicas whose indexes differ: every moved, swapped, longer, lost and added record is named, and no other."""

from __future__ import annotations

from pyspark.sql import functions as F

from windrow.llm import common, fixity

INDEX = "file long, page_id long, offset long, length long, digest string"


def laid(order):
    """Records (page_id, length, digest) of one file, one after another."""
    out, at = [], 0
    for page, length, digest in order:
        out.append((page, at, length, digest))
        at += length
    return out


def index(spark, files):
    return spark.createDataFrame([(f, p, o, n, d) for f, order in files.items() for p, o, n, d in laid(order)], INDEX).withColumns({"leaf": F.lit("x"), "state": F.lit(1)})


def states(df):
    return {(r["file"], r["page_id"]): r["state"] for r in df.collect()}


def test_every_difference_is_named(spark):
    base = {f: [(p, 3_000, f"d{f}-{p}") for p in range(400)] for f in range(6)}
    other = {f: list(rows) for f, rows in base.items()}
    other[1][10], other[1][300] = other[1][300], other[1][10]  # swapped
    other[2][390] = (390, 3_100, "longer")
    del other[3][395]
    other[4].append((1_000, 50, "new"))
    other[5][7] = (7, 3_000, "flipped")
    got = states(fixity.differences(index(spark, base), index(spark, other)))
    assert got == {
        (1, 10): "moved", (1, 300): "moved", (2, 390): "changed", (3, 395): "lost", (4, 1_000): "extra", (5, 7): "changed",
        **{(2, p): "shifted" for p in range(391, 400)}, **{(3, p): "shifted" for p in range(396, 400)},
    }
    assert states(fixity.differences(index(spark, base), index(spark, base))) == {}


def test_only_ranges_that_differ_are_opened(spark):
    base = {f: [(p, 3_000, f"d{f}-{p}") for p in range(400)] for f in range(6)}
    other = {f: list(rows) for f, rows in base.items()}
    other[5][7] = (7, 3_000, "flipped")
    trees = [fixity.tree(common.stage(fixity.placed(index(spark, x)), "placed"), levels=2) for x in (base, other)]
    bad, compared = fixity.audit(*trees, levels=2)
    assert compared[0] == 6 and max(compared[1:]) <= 16 and [(r["file"], r["leaf"]) for r in bad.collect()] == [(5, 0)]


def test_equal_records_nulls_and_empty_indexes(spark):
    same = [(1, 100, "a")] * 5 + [(None, 100, None)] * 2 + [(2, 100, "b")]
    fewer = [(1, 100, "a")] * 3 + [(None, 100, None)] * 2 + [(2, 100, "b")]
    out = fixity.differences(index(spark, {0: same}), index(spark, {0: fewer})).collect()
    assert sorted((r["page_id"] or 0, r["offset"], r["state"]) for r in out) == [(0, 500, "shifted"), (0, 600, "shifted"), (1, 300, "lost"), (1, 400, "lost"), (2, 700, "shifted")]
    assert states(fixity.differences(index(spark, {0: same}).limit(0), index(spark, {0: [(4, 9, "z")]}))) == {(0, 4): "extra"}
    assert fixity.differences(index(spark, {0: same}).limit(0), index(spark, {0: same}).limit(0)).count() == 0


def test_ids_that_are_no_numbers(spark):
    pages = spark.createDataFrame([(f"page-{i}", f"u{i}", f"<p>{i}</p>") for i in range(300)] + [(None, "u", "x")], "page_id string, url string, html string")
    replica = pages.withColumn("html", F.when(F.col("page_id") == "page-7", F.lit("?")).otherwise(F.col("html")))
    out = fixity.check_replica(pages, replica)
    assert out.count() == 301 and [r["page_id"] for r in out.filter("corrupt").collect()] == ["page-7"]
