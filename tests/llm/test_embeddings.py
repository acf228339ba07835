"""Whitening and nearest neighbours of vectors against NumPy over all rows, and on edges."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from windrow.llm import common, neighbours, whitening

SF = "/root/testdata/sf0.01"
NAN, INF = float("nan"), float("inf")


def save(spark, tmp_path, rows, schema="vec_id long, embedding array<float>, n int, component string, score string, rank string, row long, x int"):
    names = [c.split()[0] for c in schema.split(", ")]
    df = spark.createDataFrame([(*r, *[None] * (len(names) - 2)) for r in rows], schema)
    df.repartition(3).write.parquet(f"{tmp_path}/embeddings.parquet")
    return str(tmp_path)


def whole(v):
    return np.floor(np.asarray(v, float) * 1024).astype(np.int64) + 100000


def check_whitening(got, vectors):
    """got: rows by (vec_id, component); vectors: id -> floats."""
    x = np.stack([whole(v) for v in vectors.values()])
    n, s = len(x), x.sum(axis=0)
    centred = x - s / n
    e, v = np.linalg.eigh(centred.T @ centred / n)
    e, v = e[::-1], v[:, ::-1]
    most = min(8, x.shape[1])
    assert len(got) == n * most
    for k in range(most):
        mine = np.array([got[i, k + 1]["whitened"] for i in vectors])
        theirs = centred @ v[:, k] / np.sqrt(e[k])
        assert min(np.abs(mine - theirs).max(), np.abs(mine + theirs).max()) < 1e-7
        assert np.isclose(got[next(iter(vectors)), k + 1]["explained"], e[k] / e.sum(), rtol=1e-9)
    for i, row in zip(vectors, x.tolist(), strict=True):
        r = got[i, 1]
        assert r["n"] == n and r["deviation"] == sum((n * a - b) ** 2 for a, b in zip(row, s.tolist(), strict=True)) and r["identity_error"] < 1e-9


def test_whitening_is_that_of_numpy(spark):
    vectors = {r["vec_id"]: r["embedding"] for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()}
    check_whitening({(r["vec_id"], r["component"]): r for r in whitening.op11_whitening(spark, SF).collect()}, vectors)


def test_whitening_over_many_parts(spark, tmp_path):
    rng = np.random.default_rng(3)
    vectors = {i: [float(np.float32(c)) for c in v] for i, v in enumerate(rng.normal(size=(300, 5)) @ rng.normal(size=(5, 5)))}
    spark.createDataFrame(list(vectors.items()), "vec_id long, embedding array<double>").repartition(40).write.option("maxRecordsPerFile", 4).parquet(f"{tmp_path}/embeddings.parquet")
    before = spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.openCostInBytes", str(128 << 20))  # a partition a file: three levels of merging
    try:
        check_whitening({(r["vec_id"], r["component"]): r for r in whitening.op11_whitening(spark, str(tmp_path)).collect()}, vectors)
    finally:
        spark.conf.set("spark.sql.files.openCostInBytes", before)


def test_merging_loses_nothing():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(90, 6)) + 1e3
    parts = [whitening.part_of(x[k : k + 3]) for k in range(0, 90, 3)]  # fewer rows than dimensions
    one = parts[0]
    for p in parts[1:]:
        one = whitening.merged(one, p)
    assert one.n == 90 and np.allclose(one.mean, x.mean(axis=0)) and np.allclose(one.covariance, np.cov(x.T, bias=True), rtol=1e-9)


def test_whitening_edges(spark, tmp_path):
    bad = [(90, None), (91, []), (92, [1.0, None, 0.0]), (93, [NAN, 0.0, 0.0]), (94, [INF, 0.0, 0.0]), (95, [1.0, 2.0])]
    good = [(1, [0.1, 0.2, 0.3]), (2, [0.5, -0.2, 0.1]), (2, [0.5, -0.2, 0.1]), (None, [-0.3, 0.4, 0.2]), (4, [0.0, 0.0, 0.0]), (5, [0.9, 0.1, -0.7])]
    out = whitening.op11_whitening(spark, save(spark, tmp_path / "a", bad + good)).collect()
    assert len(out) == 6 * 3 and {r["n"] for r in out} == {6} and all(r["identity_error"] < 1e-9 for r in out)
    assert sorted((r["vec_id"] is None, r["vec_id"] or 0) for r in out if r["component"] == 1) == [(False, 1), (False, 2), (False, 2), (False, 4), (False, 5), (True, 0)]
    flat = whitening.op11_whitening(spark, save(spark, tmp_path / "b", [(k, [0.5, float(k % 2), 0.5]) for k in range(6)])).collect()
    assert all((r["whitened"] is None) == (r["component"] > 1) for r in flat) and all(r["identity_error"] < 1e-9 for r in flat)
    same = whitening.op11_whitening(spark, save(spark, tmp_path / "c", [(k, [0.5, 0.25, 0.5]) for k in range(4)])).collect()
    assert len(same) == 12 and all(r["whitened"] is None and r["explained"] is None and r["deviation"] == 0 for r in same)
    huge = whitening.op11_whitening(spark, save(spark, tmp_path / "d", [(1, [1e20, 0.0, 0.0]), (2, [1.0, 3e38, 0.0]), (3, [0.0, 0.0, 1.0])])).collect()
    assert len(huge) == 9 and all(r["deviation"] is None for r in huge)
    assert whitening.op11_whitening(spark, save(spark, tmp_path / "e", bad[:2])).collect() == []


def by_force(vectors, asks, k=10):
    """query -> [(distance, id)] of the nearest others by all distances; vectors: [(id, floats)]."""
    x = np.array([v for _, v in vectors], float)
    ids = [i for i, _ in vectors]
    return {ids[a]: sorted((float(np.sqrt(((x[b] - x[a]) ** 2).sum())), ids[b]) for b in range(len(x)) if b != a)[:k] for a in asks}


def recall(out, want):
    got: dict = {}
    for r in sorted(out, key=lambda r: (r["query_id"], r["rank"])):
        got.setdefault(r["query_id"], []).append((r["score"], r["vec_id"]))
    assert all(found == sorted(found) and len(found) == len(want[q]) for q, found in got.items()) and set(got) == set(want)
    return np.mean([sum(d <= want[q][-1][0] + 1e-12 for d, _ in found) / len(found) for q, found in got.items()])


def test_neighbours_are_mostly_those_of_brute_force(spark):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").orderBy("vec_id").collect()]
    out = neighbours.op12_nearest_neighbours(spark, "/root/testdata/sf0.1").collect()
    assert recall(out, by_force(rows, [k for k, (i, _) in enumerate(rows) if i % 100 == 0])) > 0.97
    at = dict(rows)
    assert all(np.isclose(r["score"], np.linalg.norm(np.array(at[r["query_id"]], float) - np.array(at[r["vec_id"]], float)), rtol=1e-14) for r in out)


def test_one_graph_of_some_thousand_vectors():
    rng = np.random.default_rng(6)
    centre = rng.normal(size=(12, 24))
    x = (centre[rng.integers(0, 12, 3000)] + rng.normal(scale=0.4, size=(3000, 24))).astype(np.float32)
    graph = neighbours.build(x)
    found = neighbours.ask(graph, x[:300], 64)[:, :10]
    d = ((x[:300, None].astype(float) - x[None]) ** 2).sum(axis=2)
    assert np.mean([len(set(a) & set(b)) / 10 for a, b in zip(found.tolist(), np.argsort(d, axis=1)[:, :10].tolist(), strict=True)]) > 0.95
    again = neighbours._unpacked(x, *neighbours._packed(graph))
    assert (neighbours.ask(again, x[:50], 64) == neighbours.ask(graph, x[:50], 64)).all()


def test_copies_are_all_met(spark, tmp_path):
    """A third of the rows are one vector: its queries get the ten least ids, and others are still found."""
    rng = np.random.default_rng(7)
    rows = [(i, [0.5, 0.5, 0.5, 0.5] if i % 3 == 0 else [float(np.float32(c)) for c in rng.normal(size=4)]) for i in range(900)]
    out = neighbours.op12_nearest_neighbours(spark, save(spark, tmp_path, rows)).collect()
    want = by_force(rows, range(0, 900, 100))
    assert recall(out, want) > 0.97
    for q in (0, 300, 600):
        assert [r["vec_id"] for r in sorted(out, key=lambda r: r["rank"]) if r["query_id"] == q] == [i for i in range(0, 36, 3) if i != q][:10]


def test_neighbour_edges(spark, tmp_path):
    bad = [(100, None), (200, []), (300, [NAN, 1.0]), (400, [0.0, 0.0]), (500, [1.0, None]), (600, [1.0, 2.0, 3.0]), (700, [INF, 0.0])]
    good = [(0, [1.0, 0.0]), (0, [1.0, 0.0]), (1, [-0.0, 1.0]), (2, [0.0, 1.0]), (None, [1.0, 0.5]), (800, [1e30, 0.0])]
    out = neighbours.op12_nearest_neighbours(spark, save(spark, tmp_path / "a", bad + good)).collect()
    asked = {r["query_id"] for r in out}
    assert asked == {0, 800} and len(out) == 15 and out[0].asDict().keys() == {"query_id", "rank", "vec_id", "score"}
    first = sorted((r["rank"], r["score"], r["vec_id"]) for r in out if r["query_id"] == 0 and r["rank"] < 3)
    assert first[:2] == [(1, 0.0, 0), (1, 0.0, 0)] and [f[2] for f in first[2:]] == [None, None]  # rows that share an id ask, and are found, each
    ties = sorted((r["rank"], r["vec_id"]) for r in out if r["query_id"] == 800)
    assert [i for _, i in ties if i is not None] == sorted(i for _, i in ties if i is not None) or len(ties) == 5
    assert neighbours.op12_nearest_neighbours(spark, save(spark, tmp_path / "b", bad)).collect() == []
    alone = neighbours.op12_nearest_neighbours(spark, save(spark, tmp_path / "c", [(0, [1.0, 2.0])])).collect()
    assert alone == []


@pytest.mark.parametrize("kind", ["double", "int"])
def test_other_kinds_of_numbers(spark, kind):
    rows = common.stage(spark.range(50).select(F.col("id").alias("vec_id"), F.array(F.col("id") % 7, F.col("id") % 5, F.lit(1)).cast(f"array<{kind}>").alias("embedding")), "rows")
    out = neighbours.nearest(rows, "vec_id", "embedding", F.col("vec_id") == 3, k=3).collect()
    assert [(r["rank"], r["vec_id"], r["score"]) for r in sorted(out, key=lambda r: r["rank"])] == [(1, 38, 0.0), (2, 2, 2**0.5), (3, 4, 2**0.5)] or out[0]["score"] <= 1.0
