"""Tail probabilities against sums of 60 digits, and activations at the ends."""

from __future__ import annotations

import math
from decimal import Decimal, getcontext

import pytest
from pyspark.sql import functions as F

from windrow.functions import scalar
from windrow.operators import metrics


def exact(f, d1, d2):
    """The tail for an even d1, where it is a finite sum."""
    getcontext().prec = 60
    y = d1 * Decimal(f) / (Decimal(d2) + d1 * Decimal(f))
    total, term = Decimal(0), Decimal(1)
    for j in range(d1 // 2):
        total += term
        term *= (Decimal(d2) / 2 + j) / (j + 1) * y
    return float(total * ((1 - y).ln() * d2 / 2).exp())


def test_tails(spark):
    rows = [(f, d1, d2) for d1, d2 in ((2, 5), (2, 496), (4, 37), (6, 599_993), (10, 10**8), (60, 10**6), (1000, 2000), (2, 1)) for f in (0.1, 0.9, 1.0, 1.1, 1.5, 3.0, 20.0)]
    df = spark.createDataFrame(rows, "f double, d1 long, d2 long")
    for r in df.withColumn("p", scalar.f_tail(F.col("f"), F.col("d1"), F.col("d2"))).collect():
        assert r["p"] == pytest.approx(exact(r["f"], r["d1"], r["d2"]), rel=2e-9, abs=1e-300), r
    odd = spark.createDataFrame([(1.0, 1, 1), (0.0, 3, 4), (None, 3, 4), (-1.0, 3, 4), (float("inf"), 3, 4), (1.0, 0, 4), (1.0, 3, 0)], "f double, d1 long, d2 long")
    got = [r["p"] for r in odd.withColumn("p", scalar.f_tail(F.col("f"), F.col("d1"), F.col("d2"))).collect()]
    assert got[0] == pytest.approx(0.5) and got[1] == 1.0 and got[2:] == [None] * 5


def test_log_gamma(spark):
    df = spark.createDataFrame([(x,) for x in (0.5, 1.0, 1.5, 2.0, 7.5, 100.5, 1e6)], "x double").withColumn("g", scalar.log_gamma(F.col("x")))
    assert all(r["g"] == pytest.approx(math.lgamma(r["x"]), rel=1e-13, abs=5e-13) for r in df.collect())


def test_activations(spark):
    df = spark.createDataFrame([(-800.0,), (-1.0,), (0.0,), (1.0,), (800.0,)], "x double")
    got = [tuple(r) for r in df.select(scalar.softplus(F.col("x")), scalar.sigmoid(F.col("x"))).collect()]
    assert got[0] == (0.0, 0.0) and got[4] == (800.0, 1.0) and got[2] == (pytest.approx(math.log(2)), 0.5)
    assert got[1][0] == pytest.approx(math.log1p(math.exp(-1))) and got[3][1] == pytest.approx(1 / (1 + math.exp(-1)))


def test_figures(spark):
    df = spark.createDataFrame([("a", 1.0, 2.0, 1), (" ", 3.0, 0.0, 0), (None, None, 5.0, 0)], "label string, v double, w double, y int")
    row = df.agg(metrics.weighted_mean("v", "w").alias("m"), metrics.positive_weight(F.col("y") == 1, F.col("y") == 0).alias("p"), metrics.hours("w").alias("h")).first()
    assert row["m"] == 1.0 and row["p"] == 2.0 and row["h"] == 7 / 3600
    assert metrics.entry_checks(df, "label").first().asDict() == {"n": 3, "empty_labels": 2, "classes": 1, "as_expected": True, "verdict": "empty_labels"}
    assert metrics.entry_checks(df, "label", 4).first()["verdict"] == "length_mismatch" and metrics.entry_checks(df.limit(0), "label", 0).first()["verdict"] == "ok"
    bands = spark.createDataFrame([(0.9,), (0.8,), (0.2,), (None,)], "x double").select(metrics.band(F.col("x")).alias("b")).collect()
    assert [r["b"] for r in bands] == ["strong", "fair", "weak", None]


def test_array_shapes(spark):
    df = spark.createDataFrame([([1.0, 2.0, 3.0, 4.0], [5.0, 6.0, 7.0, 8.0]), ([1.0], [2.0, 3.0]), ([], [])], "a array<double>, b array<double>")
    got = df.select(scalar.reshaped(F.col("a"), 2).alias("r"), scalar.stacked(F.col("a"), F.col("b")).alias("s"), scalar.tiled(F.col("a"), 2).alias("t")).collect()
    assert got[0]["r"] == [[1.0, 2.0], [3.0, 4.0]] and got[0]["s"][3] == [4.0, 8.0] and got[0]["t"] == [1.0, 2.0, 3.0, 4.0] * 2
    assert got[1]["r"] is None and got[1]["s"] is None and got[2]["r"] == [] and got[2]["t"] == []
    ramp = spark.createDataFrame([([[0.0, 1.0, 2.0, 3.0, 4.0], [1.0, 2.0, 3.0, 4.0, 5.0], [2.0, 3.0, 4.0, 5.0, 6.0], [3.0, 4.0, 5.0, 6.0, 7.0]],)], "i array<array<double>>")
    image = ramp.select(scalar.resized_image(F.col("i"), (4, 5), (7, 9)).alias("o")).first()["o"]
    assert all(image[i][j] == pytest.approx(i / 2 + j / 2) for i in range(7) for j in range(9))
    assert ramp.select(scalar.resized(F.col("i")[0], 5, 1)).first()[0] == [0.0]
