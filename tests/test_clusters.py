"""Potentials of dense cells, and centres among many points that are passed over."""

from __future__ import annotations

import numpy as np
import pytest

from windrow.operators import fuzzy


@pytest.mark.parametrize("width", [1, 2])
def test_potentials_of_dense_cells_meet_no_pairs(spark, width, monkeypatch):
    monkeypatch.setattr(fuzzy, "AT_ONCE", 200)  # a cell in several parts
    rng = np.random.default_rng(5)
    x = np.vstack([rng.random((1500, width)) * 0.4, rng.random((300, width)) * 4 - 2, rng.random((3, width)) * 1e6])
    df = spark.createDataFrame([(k, [float(v) for v in r]) for k, r in enumerate(x)] + [(9000, None), (9001, [0.1] * (width - 1) + [None])], "id long, x array<double>")
    want = np.exp(-((x[:, None] - x[None]) ** 2).sum(axis=2) / 0.15**2).sum(axis=1)
    made = fuzzy.potentials(df, 0.3)
    got = {r["id"]: r["potential"] for r in made.collect()}
    assert got.pop(9000) is None and got.pop(9001) is None and np.allclose([got[k] for k in range(len(x))], want, rtol=1e-10, atol=1e-10)
    assert "CoGroupsInArrow" in made._jdf.queryExecution().executedPlan().toString()


def test_points_passed_over_cost_no_round_each(spark):
    df = spark.createDataFrame([(k, [0.8 + k * 1e-5, 0.5]) for k in range(200)] + [(900 + k, [0.5, 0.5]) for k in range(400)], "id long, x array<double>")
    context = spark.sparkContext
    context.setJobGroup("centres", "centres")
    try:
        found = fuzzy.subtractive(df, 0.5, reject=0.01)
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
    x = np.array([r["x"] for r in df.collect()])
    ids = [r["id"] for r in df.collect()]
    p, want, rounds = np.exp(-((x[:, None] - x[None]) ** 2).sum(-1) / 0.25**2).sum(1), [], 0
    top = p.max()
    while len(want) < 25 and p.max() >= 0.01 * top:
        i, rounds = int(np.flatnonzero(p >= p.max() * (1 - 1e-12))[0]), rounds + 1
        if p[i] < 0.5 * top and min(np.linalg.norm(x[i] - x[j]) for j in want) / 0.5 + p[i] / top < 1:
            p[i] = 0
            continue
        want.append(i)
        p = p - p[i] * np.exp(-((x - x[i]) ** 2).sum(-1) / 0.375**2)
    assert [i for i, _ in found] == [ids[i] for i in want] and rounds > 100
    assert len(context.statusTracker().getJobIdsForGroup("centres")) < 100
