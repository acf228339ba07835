"""Filters and images against what they must do to known signals."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from windrow.operators import signal

RATE = 512.0
T = np.arange(int(8 * RATE)) / RATE


def amplitude(x, f):
    return 2 * abs(np.mean(x * np.exp(-2j * np.pi * f * T[: len(x)])))


def test_filters_keep_and_remove():
    x = sum(np.sin(2 * np.pi * f * T) for f in (5, 60, 100, 240))
    passed = signal.band_pass(x, RATE, 20, 150)
    assert amplitude(passed, 5) < 1e-6 and amplitude(passed, 240) < 1e-6 and amplitude(passed, 100) == pytest.approx(1, abs=1e-6)
    cut = signal.notch(x, RATE, (60.0, 300.0))
    assert amplitude(cut, 60) < 1e-6 and amplitude(cut, 100) == pytest.approx(1, abs=0.01)
    half = signal.resample(np.sin(2 * np.pi * 100 * T), RATE, RATE / 2)
    assert len(half) == len(T) // 2 and half == pytest.approx(np.sin(2 * np.pi * 100 * T[::2]), abs=1e-6)
    assert signal.resample(x, RATE, RATE) is x


def test_whitening_levels_the_spectrum():
    noise = np.random.default_rng(1).normal(size=len(T))
    coloured = np.fft.irfft(np.fft.rfft(noise) * np.linspace(0.1, 10, len(T) // 2 + 1), len(T))
    white = signal.whiten(coloured, RATE)
    _, power = signal.density(white, RATE)
    assert np.std(white[512:-512]) == pytest.approx(1, rel=0.25) and np.median(power[50:500]) / np.median(power[-500:-50]) == pytest.approx(1, rel=0.3)


def test_image_shows_the_burst_where_it_is():
    x = np.random.default_rng(2).normal(size=len(T)) * 0.1 + np.sin(2 * np.pi * 80 * T) * np.exp(-(((T - 4.0) / 0.05) ** 2))
    z, energy = signal.image(x, RATE, (3.0, 5.0), (20.0, 200.0), (4.0, 16.0), (32, 64))
    row, column = np.unravel_index(np.argmax(z), z.shape)
    assert z.shape == (32, 64) and 0 <= z.min() and z.max() == 1 and energy > 0
    assert 3 + 2 * column / 64 == pytest.approx(4.0, abs=0.1) and np.geomspace(20, 200, 32)[row] == pytest.approx(80, rel=0.25)
    raw, _ = signal.image(x, RATE, (3.0, 5.0), (20.0, 200.0), (4.0, 16.0), (32, 64), raw=True)
    assert raw.max() > 10
    ramp = np.add.outer(np.arange(4.0), np.arange(5.0))
    assert signal.resize(ramp, 7, 9) == pytest.approx(np.add.outer(np.linspace(0, 3, 7), np.linspace(0, 4, 9)))
    assert signal.edge(1.0) == pytest.approx(0.2) and signal.edge(0.0) == 0 and signal.edge(10.0) == 0.5


def test_a_failing_row_spoils_no_other(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0]), (2, None), (3, [float("nan")]), (4, [])], "id int, x array<double>").withColumn("ok", F.lit("x"))
    out = {r["id"]: r for r in signal.mapped(df, "x", lambda x: x[:1] * 2 if len(x) else x[0], "y").collect()}
    assert out[1]["y"] == [2.0] and [out[k]["ok"] for k in (1, 2, 3, 4)] == [True, False, False, False] and out[2]["err"] == "no samples"
    assert signal.mapped(df.limit(0), "x", lambda x: x, "y").count() == 0


def test_chain_is_numpys(spark):
    from windrow.plans import strain

    got = {r["vec_id"]: r for r in strain.strain_images(spark, "/root/testdata/sf0.001").filter("vec_id < 20").collect()}
    rows = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").filter("vec_id < 20").collect()
    for r in rows:
        x = np.array(r["embedding"], float)
        z, energy = signal.image(signal.notch(signal.whiten(signal.band_pass(x, 64.0, 2.0, 24.0), 64.0), 64.0, (10.0, 20.0)), 64.0, (0.1, 0.9), (4.0, 24.0), (4.0, 8.0), (8, 8))
        assert got[r["vec_id"]]["ok"] and got[r["vec_id"]]["image"] == pytest.approx(z.ravel().tolist(), abs=1e-6) and got[r["vec_id"]]["log_energy"] == pytest.approx(energy)
