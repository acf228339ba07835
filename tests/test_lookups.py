"""Nearest and tolerant lookups without pairs, against all pairs."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from windrow.operators import joins


def tables(spark, seed, whole):
    rng = np.random.default_rng(seed)
    made = lambda n: [float(t) if not whole else int(t) for t in (rng.integers(-300, 900, n) if whole else np.round(rng.uniform(-300, 900, n), 2))]
    kind = "long" if whole else "double"
    left = [(i, t, i % 2) for i, t in enumerate(made(250))] + [(900, None, 0), (901, made(1)[0], None)]
    right = [(i, t, int(k)) for i, (t, k) in enumerate(zip(made(120), rng.integers(0, 2, 120), strict=True))] + [(500, None, 1), (501, made(1)[0], None)]
    return left, right, spark.createDataFrame(left, f"id long, t {kind}, k long"), spark.createDataFrame(right, f"o long, u {kind}, k long")


def joined_rows(df):
    """Rows that the joins of a plan put out at most, as run."""
    out, todo = [], [df._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        name = node.nodeName()
        if "Adaptive" in name:
            todo.append(node.executedPlan())
        elif "QueryStage" in name:
            todo.append(node.plan())
        else:
            if "Join" in name:
                out.append(node.metrics().apply("numOutputRows").value())
            children = node.children()
            todo += [children.apply(i) for i in range(children.size())]
    return max(out)


@pytest.mark.parametrize("whole", [True, False])
@pytest.mark.parametrize("closed", [True, False])
def test_nearest_is_brute_force(spark, whole, closed):
    left, right, a, b = tables(spark, 1, whole)
    got = {r["id"]: r["match"] and r["match"]["o"] for r in joins.nearest(a, b, "t", "u", 7, ["k"], closed=closed).collect()}
    for i, t, k in left:
        near = [(abs(u - t), u, o) for o, u, j in right if None not in (t, u, k, j) and j == k and (abs(u - t) <= 7 if closed else abs(u - t) < 7)]
        assert got[i] == (min(near)[2] if near else None)
    assert sum(o is not None for o in got.values()) > 50


@pytest.mark.parametrize("whole", [True, False])
@pytest.mark.parametrize("tolerance", [0, 1, 8])
def test_exact_then_tolerance_is_brute_force(spark, whole, tolerance):
    left, right, a, b = tables(spark, 2, whole)
    got = {r["id"]: r["match"] and r["match"]["o"] for r in joins.exact_then_tolerance(a, b, "t", "u", tolerance, ["k"], "o").collect()}
    for i, t, k in left:
        met = [(u != t, min(p for p, v, m in right if (v, m) == (u, j)), max(p for p, v, m in right if (v, m) == (u, j))) for _, u, j in right if None not in (t, u, k, j) and j == k and abs(u - t) < tolerance]
        assert got[i] == (min(met)[2] if met else None)


@pytest.mark.parametrize("how", ["nearest", "exact"])
def test_crowded_times_make_no_pairs(spark, how):
    a = spark.range(600).select("id", (F.col("id") * 2).alias("t"), F.lit(0).alias("k"))
    b = spark.range(700).select(F.col("id").alias("o"), (F.col("id") * 2 + 1).alias("u"), F.lit(0).alias("k"))
    out = joins.nearest(a, b, "t", "u", 5000, ["k"]) if how == "nearest" else joins.exact_then_tolerance(a, b, "t", "u", 5000, ["k"], "o")
    assert {r["match"]["o"] for r in out.collect()} == ({0} if how == "exact" else set(range(599)))
    assert joined_rows(out) <= 1300
