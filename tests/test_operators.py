"""Operators against brute force and NumPy, on edges that tables lack."""

from __future__ import annotations

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from windrow.functions import scalar
from windrow.operators import fuzzy, joins, labels, ledger, linalg, metrics, ranking, splits
from windrow.sources import catalogue
from windrow.streaming import blocks


def test_interval_edges_and_empty(spark):
    windows = spark.createDataFrame([(1, 0, 10, 0), (2, 10, 10, 0), (3, 50, 10, 0), (4, 0, 10, 1)], "window_id long, t0 long, dur long, ifo long")
    triggers = spark.createDataFrame([(0, "b", 0), (10, "a", 0), (19, "a", 0), (None, "a", 0), (55, None, 0)], "t long, label string, ifo long")
    got = {r["window_id"]: (r["match_count"], r["label"], r["label_id"]) for r in labels.label_windows(windows, triggers, ["ifo"], 7).collect()}
    assert got == {1: (1, "b", 1), 2: (2, "ambiguous", -2), 3: (0, "noise", -1), 4: (0, "noise", -1)}
    none = labels.label_windows(windows, triggers.limit(0), ["ifo"], 7)
    assert {r["label"] for r in none.collect()} == {"noise"}


def test_interval_join_left_keeps_all(spark):
    rng = np.random.default_rng(1)
    w = [(int(i), int(t), int(t) + int(d)) for i, (t, d) in enumerate(zip(rng.integers(0, 500, 60), rng.integers(1, 90, 60), strict=True))]
    p = [(int(i), int(t)) for i, t in enumerate(rng.integers(0, 600, 80))]
    ws = spark.createDataFrame(w, "w long, a long, b long").withColumn("k", F.lit(1))
    ps = spark.createDataFrame(p, "p long, t long").withColumn("k", F.lit(1))
    got = sorted((r["w"], -1 if r["p"] is None else r["p"]) for r in joins.interval_join(ws, ps, "a", "b", "t", ["k"], 40).collect())
    want = []
    for i, a, b in w:
        met = [j for j, t in p if a <= t < b]
        want += [(i, j) for j in met] or [(i, -1)]
    assert got == sorted(want)


def test_nearest_ties_go_to_the_earlier(spark):
    left = spark.createDataFrame([(1, 100), (2, 131), (3, 500)], "id long, t long").withColumn("k", F.lit(0))
    right = spark.createDataFrame([(10, 90), (11, 110), (12, 121)], "rid long, u long").withColumn("k", F.lit(0))
    got = {r["id"]: r["match"] and r["match"]["rid"] for r in joins.nearest(left, right, "t", "u", 10, ["k"]).collect()}
    assert got == {1: 10, 2: 12, 3: None}


def test_exact_wins_then_file_order(spark):
    left = spark.createDataFrame([(1, 100), (2, 104)], "id long, t long").withColumn("k", F.lit(0))
    right = spark.createDataFrame([(0, 103, 1.0), (1, 100, 2.0), (2, 100, 3.0), (3, 105, 4.0)], "o long, u long, snr double").withColumn("k", F.lit(0))
    got = {r["id"]: r["match"]["snr"] for r in joins.exact_then_tolerance(left, right, "t", "u", 10, ["k"], "o").collect()}
    assert got == {1: 3.0, 2: 1.0}


@pytest.mark.parametrize("p", [0.0, 0.1, 0.5, 0.9, 1.0])
def test_percentiles_are_numpys(spark, p):
    xs = [float(v) for v in np.random.default_rng(3).normal(size=101)] + [0.5, 0.5, None]
    df = spark.createDataFrame([(x,) for x in xs], "v double")
    known = [x for x in xs if x is not None]
    assert ranking.percentiles(df, "v", [p])[0] == pytest.approx(np.percentile(known, 100 * p))
    row = spark.createDataFrame([(known,)], "xs array<double>").select(scalar.array_percentile(F.col("xs"), p)).first()
    assert row[0] == pytest.approx(np.percentile(known, 100 * p))


def test_percentiles_of_nothing(spark):
    assert ranking.percentiles(spark.createDataFrame([], "v double"), "v", [0.5]) == [None]


def test_auroc_edges(spark):
    rows = [(1.0, 1), (0.5, 0), (0.5, 1), (0.2, 0), (None, 1)]
    df = spark.createDataFrame(rows, "s double, y int")
    assert metrics.auroc(df, "s", "y").first()["auroc"] == pytest.approx(0.875)
    assert metrics.auroc(df.filter("y = 1"), "s", "y").first()["auroc"] is None
    both = [metrics.auroc(df.withColumn("s", F.col("s") * k), "s", "y").first()["auroc"] for k in (1, -1)]
    assert sum(both) == pytest.approx(1)


def test_tpr_edges(spark):
    points = spark.createDataFrame([(0.0, 0.0), (0.0, 0.4), (0.02, 0.6), (1.0, 1.0)], "fpr double, tpr double")
    assert metrics.tpr_at_fpr(points, 0.01).first()[0] == pytest.approx(0.5)
    assert metrics.tpr_at_fpr(points, 0.0).first()[0] == pytest.approx(0.0)
    assert metrics.tpr_at_fpr(points, 2.0).first()[0] == pytest.approx(1.0)


def test_splits_cover(spark):
    df = spark.createDataFrame([(i, "a" if i < 50 else "b") for i in range(60)], "id long, c string")
    out = splits.three_way(df, "c", "id")
    assert out.count() == 60 and {r["split"] for r in out.collect()} == {"train", "val", "test"}
    few = splits.three_way(df.filter("id < 53"), "c", "id")
    assert few.count() == 53
    assert splits.capped(df, "c", "id", 7).groupBy("c").count().filter("count = 7").count() == 2


def test_pca_and_least_squares_are_numpys(spark):
    x = np.random.default_rng(5).normal(size=(80, 4)) @ np.diag([3, 2, 1, 0.1])
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id long, x array<double>")
    mean, components, shares = linalg.pca(df, "x", 4)
    s = np.linalg.svd(x - x.mean(axis=0), compute_uv=False) ** 2
    assert shares == pytest.approx(s / s.sum())
    rebuilt = (x - mean) @ components[:2].T @ components[:2]
    want = (((x - mean) - rebuilt) ** 2).mean(axis=1)
    got = [r["score"] for r in linalg.reconstruction_error(df, "x", mean, components[:2]).orderBy("id").collect()]
    assert got == pytest.approx(want, abs=1e-9)


def test_fuzzy_is_numpys(spark):
    rng = np.random.default_rng(6)
    x, y = rng.random((50, 2)), rng.integers(0, 3, 50)
    df = spark.createDataFrame([(int(i), float(a), float(b), int(k)) for i, ((a, b), k) in enumerate(zip(x, y, strict=True))], "id long, p double, q double, y int")
    rules = fuzzy.rules_at([[0.2, 0.3], [0.8, 0.6]], 3)
    w = np.stack([np.prod(1 / (1 + np.abs((x - np.array(r.c)) / 0.3) ** 4), axis=1) for r in rules], axis=1)
    w = w / (w.sum(axis=1, keepdims=True) + 1e-8)
    phi = np.hstack([np.hstack([w[:, [j]] * x, w[:, [j]]]) for j in range(2)])
    theta = np.linalg.lstsq(phi, np.eye(3)[y], rcond=None)[0]
    fitted = fuzzy.fit_consequents(df, ["p", "q"], rules, "y", 3)
    assert np.array([r.consequent for r in fitted]).reshape(6, 3) == pytest.approx(theta, abs=1e-6)
    got = [r["predicted"] for r in fuzzy.predict(df, ["p", "q"], fitted).orderBy("id").collect()]
    assert got == (phi @ theta).argmax(axis=1).tolist()


@pytest.mark.parametrize("full", [True, False])
def test_clusters_are_brute_force(spark, full):
    x = np.random.default_rng(7).random((40, 2))
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id long, x array<double>")
    p = np.exp(-((x[:, None] - x[None]) ** 2).sum(-1) / 0.2**2).sum(1)
    top, want = p.max(), []
    while len(want) < 25:
        i = int(p.argmax())
        if p[i] < 0.15 * top or p[i] <= 0:
            break
        if full and p[i] < 0.5 * top and min(np.linalg.norm(x[i] - x[j]) for j in want) / 0.4 + p[i] / top < 1:
            p[i] = 0
            continue
        want.append(i)
        p = p - p[i] * np.exp(-((x - x[i]) ** 2).sum(-1) / 0.3**2)
        p = p if full else np.maximum(p, 0)
    assert [i for i, _ in fuzzy.subtractive(df, 0.4, full=full)] == want


def test_catalogue_reads_malformed(spark, tmp_path):
    (tmp_path / "H1_O3a.csv").write_text("ifo,peak_time,peak_time_ns,ml_label,ml_confidence,snr,duration\nH1,100,500000000,Blip,0.95,8.0,x\nH1,oops,,Blip,0.99,9,1\nL1,5,,Tomte,0.99,9,1\nH1,101,,,0.99,9,1\nH1,102,,Blip,0.5,9,1\nH1,103,,Blip,0.95,7.0,1\n")
    got = catalogue.read_catalogue(spark, str(tmp_path))
    tests = catalogue.filters(ifo="H1")
    kept = catalogue.selected(got, tests).collect()
    assert [(r["t"], r["duration"]) for r in kept] == [(100.5, 0.0)]
    counts = catalogue.skipped(got, tests).first().asDict()
    assert counts == {"skipped_ifo": 1, "skipped_confidence": 1, "skipped_label": 1, "skipped_time": 1, "skipped_snr": 1, "kept": 1}


def test_archives_and_windows(spark, tmp_path):
    x = np.arange(2 * 3 * 3, dtype=np.float32).reshape(2, 3, 3)
    np.savez_compressed(tmp_path / "a.npz", X=x, t0=np.array([5.0, 6.0]), meta_json=json.dumps({"window_dur": 4}))
    got = catalogue.read_npz(spark, str(tmp_path)).withColumn("dur", catalogue.duration(F.col("meta_json"))).orderBy("row").collect()
    assert [(r["t0"], r["dur"], r["shape"], list(r["x"])) for r in got] == [(5.0, 4.0, [3, 3], list(range(9))), (6.0, 4.0, [3, 3], list(range(9, 18)))]
    df = spark.createDataFrame([("H1", "a", 1.0, [0.5]), ("L1", "a", 4.0, [0.7])], "ifo string, epoch string, dur double, x array<float>")
    catalogue.write_windows(df, str(tmp_path / "w"))
    back = catalogue.read_windows(spark, str(tmp_path / "w"), ifos=["H1"])
    assert [(r["ifo"], r["log_energy"]) for r in back.collect()] == [("H1", 0.0)]


def test_ledger_resumes(spark, tmp_path):
    jobs = spark.range(6).select(F.col("id").alias("job"))
    root = str(tmp_path)
    first = lambda left: left.select("job", (F.col("job") < 4).alias("ok"), F.lit("late").alias("err"))
    assert ledger.run_pending(jobs, "job", first, root) == "partial"
    seen = []

    def second(left):
        seen.extend(r["job"] for r in left.collect())
        return left.select("job", F.lit(True).alias("ok"), F.lit(None).cast("string").alias("err"))

    assert ledger.run_pending(jobs, "job", second, root) == "done"
    assert sorted(seen) == [4, 5]
    assert spark.read.parquet(f"{root}/errors").count() == 2
    assert ledger.run_pending(jobs, "job", second, root) == "done" and sorted(seen) == [4, 5]
    draw = lambda: spark.range(3)
    assert ledger.manifest(spark, f"{root}/m", "id long", draw).count() == 3
    assert ledger.manifest(spark, f"{root}/m", "id long", lambda: spark.range(9)).count() == 3


def test_stream_ingests_once(spark, tmp_path):
    rows = spark.range(10).select("id", F.timestamp_seconds(F.col("id") * 1000).alias("ts"))
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    run = lambda: blocks.ingest(spark, str(tmp_path / "in"), "id long, ts timestamp", str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    run()
    rows.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    run()
    run()
    got = spark.read.schema("id long, ts timestamp").parquet(str(tmp_path / "out"))
    assert got.count() == 20
    assert blocks.block_counts(got, "ts", "4096 seconds", []).filter("n = 10").count() == 1


def test_rounding_is_half_even(spark):
    row = spark.range(1).select(scalar.half_even(F.lit(2.5), 0), scalar.sanitise(F.lit(float("nan"))), scalar.slug(F.lit(" 0.25 ")), scalar.json_number(F.lit("{bad"), "dur", default=1.0)).first()
    assert tuple(row) == (2.0, 0.0, "0p25", 1.0)
