"""Intervals of any length, contained windows, potentials by cells, and the join of two streams."""

from __future__ import annotations

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from windrow.operators import fuzzy, joins, splits
from windrow.streaming import intervals


def some(spark, rng, n, longest):
    starts = rng.integers(0, 100_000, n)
    lengths = (longest ** rng.random(n)).astype(int)
    rows = [(k, int(k % 2), int(a), int(a + b)) for k, (a, b) in enumerate(zip(starts, lengths, strict=True))]
    return rows, spark.createDataFrame(rows, "window_id long, ifo long, start long, end long")


def test_long_intervals_add_few_rows(spark):
    rng = np.random.default_rng(0)
    rows, df = some(spark, rng, 200, 50_000)
    everything = spark.createDataFrame([(999, 0, -(10**12), 10**12), (998, 1, None, 5), (997, 1, 7, 7)], df.schema)
    points = [(k, int(k % 2), int(t)) for k, t in enumerate(rng.integers(-500, 160_000, 300))]
    right = spark.createDataFrame(points, "point_id long, ifo long, at long")
    own = df.unionByName(everything)
    spread = joins.levelled(own, F.col("start"), F.col("end") - 1, 10)
    assert spread.count() <= 2 * own.count() and spread.filter("window_id = 999").count() <= 2
    out = joins.interval_join(own, right, "start", "end", "at", ["ifo"], 10).collect()
    want = {(w, p) for w, i, a, b in [*rows, (999, 0, -(10**12), 10**12)] for p, j, t in points if i == j and a <= t < b}
    assert {(r["window_id"], r["point_id"]) for r in out if r["point_id"] is not None} == want
    assert len(out) == len(want) + len({w for w, *_ in rows} | {997, 998, 999}) - len({w for w, _ in want})


def test_contained_in_segments_of_any_length(spark):
    rng = np.random.default_rng(1)
    rows, df = some(spark, rng, 150, 300)
    segments = [(int(k % 2), int(a), int(a + b)) for k, (a, b) in enumerate(zip(rng.integers(0, 100_000, 40), (20_000 ** rng.random(40)).astype(int), strict=True))] + [(0, 0, 50_000)] * 2
    right = spark.createDataFrame(segments, "ifo long, seg_start long, seg_end long")
    got = sorted(r["window_id"] for r in joins.contained(df.unionByName(df), right, "start", "end", 4, ["ifo"], 64).collect())
    want = sorted(2 * [w for w, i, a, b in rows if any(i == j and s <= a - 4 and b + 4 <= e for j, s, e in segments)])
    assert got == want and len(set(got)) > 30


def test_draws_over_one_long_segment(spark):
    segments = spark.createDataFrame([(0.0, 1e6), (2e6, 2e6 + 30), (3e6, 3e6 + 20)], "seg_start double, seg_end double")
    draws = spark.createDataFrame([(k, k / 200, 0.5) for k in range(200)], "draw_id long, u double, v double")
    out = splits.weighted_times(segments, draws, 5.0, 1.0).collect()
    assert len(out) == 199 and {r["seg_start"] for r in out} == {0.0}


def test_potentials_by_cells(spark):
    rng = np.random.default_rng(2)
    x = np.vstack([rng.random((150, 4)), np.tile(rng.random((1, 4)), (60, 1)), rng.random((5, 4)) * 50])
    df = spark.createDataFrame([(k, [float(v) for v in r]) for k, r in enumerate(x)] + [(900, None)], "id long, x array<double>")
    want = np.exp(-((x[:, None] - x[None]) ** 2).sum(axis=2) / 0.15**2).sum(axis=1)
    made = fuzzy.potentials(df, 0.3)
    got = {r["id"]: r["potential"] for r in made.collect()}
    assert got.pop(900) is None and np.allclose([got[k] for k in range(len(x))], want, rtol=1e-9, atol=1e-9)
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
    near = {r["id"]: r["potential"] for r in fuzzy.potentials(df, 0.3, grain=0.01).collect()}
    assert all(abs(near[k] - want[k]) <= len(x) * 2 * 1.72 * 0.01 * 2 for k in range(len(x)))
    assert fuzzy.potentials(df.filter("id = 900"), 0.3).collect()[0]["potential"] is None


def test_centres_are_filled_up(spark):
    df = spark.createDataFrame([(k, [0.5 + k * 1e-4, 0.5]) for k in range(20)], "id long, x array<double>")
    found = fuzzy.subtractive(df, 0.5)
    assert len(found) == 1
    more = fuzzy.filled(df, found)
    assert more[:1] == found and len(more) == 5 and len({i for i, _ in more}) == 5 and more == fuzzy.filled(df, found)
    assert len(fuzzy.filled(df.filter("id < 3"), fuzzy.subtractive(df.filter("id < 3"), 0.5))) == 3
    assert fuzzy.filled(df, more * 6, most=25) == (more * 6)[:25]


def clock(minutes):
    return dt.datetime(2024, 1, 1) + dt.timedelta(minutes=float(minutes))


@pytest.mark.parametrize("how", ["inner", "left"])
def test_streams_equal_tables_and_forget(spark, tmp_path, how):
    rng = np.random.default_rng(3)
    windows = [(k, int(k % 3), clock(k * 3), clock(k * 3 + int(rng.integers(1, 10)))) for k in range(120)]
    points = [(k, int(rng.integers(0, 3)), clock(m)) for k, m in enumerate(rng.uniform(-5, 380, 250))]
    wschema, pschema = "window_id long, ifo long, start timestamp, end timestamp", "point_id long, ifo long, at timestamp"
    for step in range(12):  # a file a half hour or so, with rows up to the end of it
        spark.createDataFrame([w for w in windows if 30 * step <= w[0] * 3 < 30 * step + 30], wschema).coalesce(1).write.parquet(f"{tmp_path}/w/{step:02d}")
        spark.createDataFrame([p for p in points if clock(30 * step if step else -9) <= p[2] < clock(30 * step + 30)], pschema).coalesce(1).write.parquet(f"{tmp_path}/p/{step:02d}")
    stale = [(700, 0, clock(1), clock(8))]
    spark.createDataFrame(stale, wschema).coalesce(1).write.parquet(f"{tmp_path}/w/99")  # far behind the watermark
    read = lambda part, schema: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{tmp_path}/{part}")
    joined = intervals.interval_join(read("w", wschema), read("p", pschema), "start", "end", "at", ["ifo"], longest="10 minutes", late="30 minutes", how=how)
    query = joined.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    query.awaitTermination()
    kept = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
    pairs = lambda df: sorted((r["window_id"], -1 if r["point_id"] is None else r["point_id"]) for r in df.collect())
    batch = intervals.interval_join(spark.createDataFrame(windows, wschema), spark.createDataFrame(points, pschema), "start", "end", "at", ["ifo"], longest="10 minutes", how=how)
    got = pairs(spark.read.parquet(f"{tmp_path}/out"))
    assert [g for g in got if g[1] >= 0] == [b for b in pairs(batch) if b[1] >= 0] and len(got) > 50
    if how == "left":
        missing = {b for b in pairs(batch) if b[1] < 0} - {g for g in got if g[1] < 0}
        assert all(w * 3 > 300 for w, _ in missing)  # of windows that the watermark has not passed yet, none is given up
    assert max(kept) < 370 * 0.6 and kept[-1] < 150  # not all of 120 windows and 250 points
    with pytest.raises(ValueError, match="inner or left"):
        intervals.interval_join(batch, batch, "start", "end", "at", ["ifo"], longest="1 minute", how="right")


def test_running_sums_and_percentiles_over_many_ranges(spark):
    rng = np.random.default_rng(8)
    values = np.unique(np.round(rng.normal(size=3000), 3))
    from windrow.operators import ranking

    df = spark.createDataFrame([(float(v), int(k % 5 + 1)) for k, v in enumerate(values)], "v double, n long")
    for descending in (False, True):
        got = {r["v"]: r["s"] for r in ranking.running(df, "v", {"s": "n"}, descending=descending, rows=7).collect()}
        order = values[::-1] if descending else values
        n = {float(v): k % 5 + 1 for k, v in enumerate(values)}
        want, total = {}, 0
        for v in order.tolist():
            total += n[v]
            want[v] = total
        assert got == want
    keyed = spark.createDataFrame([(k, float(v)) for k, size in ((None, 900), (1, 1), (2, 400)) for v in rng.integers(0, 500, size)], "k long, x double")
    want = {r["k"]: r["p"] for r in keyed.groupBy("k").agg(F.percentile("x", F.array(F.lit(0.1), F.lit(0.5), F.lit(0.9))).alias("p")).collect()}
    got = {r["k"]: r["q"] for r in ranking.quantiles_of(ranking.counted(keyed, ["k"], "x"), ["k"], [0.1, 0.5, 0.9], rows=9).collect()}
    assert got.keys() == want.keys() and all(np.allclose(got[k], want[k], rtol=1e-12) for k in want)
    bounds = [1.0, 2.0, 2.5, 7.0, 8.0, 9.0, 11.0]
    rows = spark.range(-2, 30).select((F.col("id") / 2).alias("x"))
    assert all(r["p"] == sum(b <= r["x"] for b in bounds) for r in rows.withColumn("p", ranking.place(F.lit(np.array(bounds)), F.col("x"))).collect())


def test_stream_join_by_buckets_of_time(spark, tmp_path):
    rng = np.random.default_rng(4)
    windows = [(k, 0, clock(m), clock(m + float(rng.choice([0, 0.5, 1])))) for k, m in enumerate(np.round(rng.uniform(0, 300, 400), 1))]
    points = [(k, 0, clock(m)) for k, m in enumerate(np.round(rng.uniform(-5, 310, 600), 1))]
    wschema, pschema = "window_id long, ifo long, start timestamp, end timestamp", "point_id long, ifo long, at timestamp"
    spark.createDataFrame(windows, wschema).write.parquet(f"{tmp_path}/w")
    spark.createDataFrame(points, pschema).write.parquet(f"{tmp_path}/p")
    read = lambda part, schema: spark.readStream.schema(schema).parquet(f"{tmp_path}/{part}")
    joined = intervals.interval_join(read("w", wschema), read("p", pschema), "start", "end", "at", ["ifo"], longest="1 minute")
    query = joined.writeStream.format("memory").queryName("bucketed").trigger(availableNow=True).start()
    query.awaitTermination()
    got = sorted((r["window_id"], r["point_id"]) for r in spark.table("bucketed").collect())
    assert got == sorted((w, p) for w, _, a, b in windows for p, _, t in points if a <= t < b) and len(got) > 100
    plan = query._jsq.explainInternal(False)
    line = next(x for x in plan.splitlines() if "StreamingSymmetricHashJoin" in x)
    assert "_mine" in line.split("]")[0]  # a key of the state, with ifo: no row is held against all of its ifo
