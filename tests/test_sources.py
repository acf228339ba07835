"""Catalogues of several headers, files that are absent, versions of a ledger."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from windrow.functions.scalar import hash_order
from windrow.operators import ledger, ranking, splits
from windrow.sources import catalogue


def test_each_file_is_read_by_its_own_header(spark, tmp_path):
    (tmp_path / "H1_O3a.csv").write_text("ifo,peak_time,ml_label,snr\nH1,10,Blip,8\nH1,11,Tomte,x\n")
    (tmp_path / "L1_O3a.csv").write_text("snr,ml_label,ifo,event_time\n9,Whistle,L1,12.5\n")
    got = [(r["ifo"], r["t"], r["label"], r["snr"]) for r in catalogue.read_catalogue(spark, str(tmp_path)).orderBy("file_order").collect()]
    assert got == [("H1", 10.0, "Blip", 8.0), ("H1", 11.0, "Tomte", 0.0), ("L1", 12.5, "Whistle", 9.0)]
    out, absent = catalogue.read_files(spark, str(tmp_path), [("H1", "O3a"), ("L1", "O3b")])
    assert out.count() == 2 and {r["epoch"] for r in out.collect()} == {"O3a"} and absent == ["L1_O3b.csv"]
    spark.range(3).write.parquet(str(tmp_path / "w"))
    assert catalogue.first_match(spark, str(tmp_path / "w"), ("*.none", "*.parquet")).count() == 3
    assert catalogue.first_match(spark, str(tmp_path / "w"), ("*.none",)) is None


def test_manifest_may_be_empty_and_ledger_overwrites_by_key(spark, tmp_path):
    for _ in range(2):
        assert ledger.manifest(spark, str(tmp_path / "m"), "id long", lambda: spark.range(0)).count() == 0
    path, schema = str(tmp_path / "runs"), "run string, state string"
    assert ledger.latest(spark, path, schema).count() == 0
    for rows in ([("a", "running"), ("b", "running")], [("b", "done"), ("c", "partial")]):
        ledger.put(spark.createDataFrame(rows, schema), path, ["run"])
    assert {tuple(r) for r in ledger.latest(spark, path, schema).collect()} == {("a", "running"), ("b", "done"), ("c", "partial")}
    said = [ledger.state(segments=0), ledger.state(triggers=0), ledger.state(valid=0), ledger.state(), ledger.state(done=1, target=2), ledger.state(done=2, target=2), ledger.state(done=2, target=2, packed=True), ledger.state(done=2, target=2, packed=True, sane=False)]
    assert set(said) == set(ledger.STATES) and len(said) == len(ledger.STATES)


def test_grouped_percentiles_and_numbers_are_exact(spark):
    df = spark.range(0, 5000).select(F.col("id"), F.when(F.col("id") % 3 > 0, F.col("id") % 3).alias("k"), (hash_order(F.col("id"), 5) % 900 / 7).alias("x"))
    whole = {r["k"]: r["p"] for r in df.groupBy("k").agg(F.percentile("x", F.array(F.lit(0.02), F.lit(0.5), F.lit(0.98))).alias("p")).collect()}
    got = {r["k"]: r["q"] for r in ranking.quantiles(df, ["k"], "x", [0.02, 0.5, 0.98]).collect()}
    assert got.keys() == whole.keys() and all(got[k] == pytest.approx(whole[k]) for k in whole)
    rows = splits.numbered(df, ["k"], "id", 3).collect()
    for k in whole:
        own = sorted(r["_n"] for r in rows if r["k"] == k)
        assert own == list(range(1, len(own) + 1)) and {r["_all"] for r in rows if r["k"] == k} == {len(own)}
    large = spark.createDataFrame([(4_000_000_000,), (2**62,), (None,)], "id long").select(hash_order(F.col("id"), 1).alias("h")).collect()
    assert [r["h"] is None or 0 <= r["h"] < 2**32 for r in large] == [True] * 3
    assert ranking.quantiles(df.limit(0), [], "x", [0.5]).collect()[0]["q"] == [None]
