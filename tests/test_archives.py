"""The archive source: partitions by rows, fewer columns, what archives lack; the writer's commit and abort."""

from __future__ import annotations

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from windrow.sources import archives


@pytest.fixture(scope="module")
def format_known(spark):
    archives.register(spark)


def save(path, n, *, packed=True, **more):
    x = np.arange(n * 6, dtype=np.float32).reshape(n, 2, 3)
    (np.savez_compressed if packed else np.savez)(path, X=x, **more)
    return x


def test_reading_in_stretches(spark, tmp_path, format_known):
    os.makedirs(tmp_path / "a" / "deep")
    save(tmp_path / "a" / "one.npz", 700, t0=np.arange(700) / 2.0, log_energy=np.arange(700, dtype=np.float32), meta_json=np.array('{"dur": 2}'))
    save(tmp_path / "a" / "deep" / "two.npz", 5, packed=False, meta_json=np.array([f'{{"k": {k}}}' for k in range(5)]))
    df = spark.read.format("windows").option("rowsPerPartition", 300).load(str(tmp_path / "a"))
    assert df.rdd.getNumPartitions() == 4
    rows = {(os.path.basename(r["file"]), r["row"]): r for r in df.collect()}
    assert len(rows) == 705
    r = rows["one.npz", 650]
    assert r["t0"] == 325.0 and r["log_energy"] == 650.0 and r["meta_json"] == '{"dur": 2}' and r["shape"] == [2, 3] and r["x"] == [float(v) for v in range(3900, 3906)]
    r = rows["two.npz", 3]
    assert r["t0"] == 3.0 and r["log_energy"] == 0.0 and r["meta_json"] == '{"k": 3}'
    few = spark.read.format("windows").schema("row long, t0 double").load(f"file://{tmp_path}/a/one.npz")
    assert few.columns == ["row", "t0"] and few.agg(F.sum("t0")).first()[0] == sum(range(700)) / 2


def test_odd_archives(spark, tmp_path, format_known):
    os.makedirs(tmp_path / "none")
    assert spark.read.format("windows").load(str(tmp_path / "none")).count() == 0
    save(tmp_path / "empty.npz", 0)
    assert spark.read.format("windows").load(str(tmp_path / "empty.npz")).count() == 0
    np.savez(tmp_path / "other.npz", Y=np.zeros(3))
    with pytest.raises(Exception, match="holds no X"):
        spark.read.format("windows").load(str(tmp_path / "other.npz")).count()
    with pytest.raises(Exception, match="archives have no pixels"):
        spark.read.format("windows").schema("pixels int").load(str(tmp_path / "empty.npz")).count()
    with pytest.raises(Exception, match="missing"):
        spark.read.format("windows").load(str(tmp_path / "missing")).count()


def test_round_trip_and_commit(spark, tmp_path, format_known):
    path = str(tmp_path / "out")
    df = spark.range(500).select((F.col("id") / 2).alias("t0"), F.col("id").cast("float").alias("log_energy"), F.array(F.col("id").cast("float"), F.lit(1.5).cast("float")).alias("x"), F.format_string('{"dur": %d}', F.col("id")).alias("meta_json")).repartition(3)
    df.write.format("windows").option("rowsPerFile", 100).mode("append").save(path)
    names = sorted(os.listdir(path))
    assert "_SUCCESS" in names and len(names) > 5 and not [n for n in names if n.startswith("_job")]
    back = spark.read.format("windows").load(path)
    want = sorted((r["t0"], r["log_energy"], r["meta_json"], tuple(r["x"])) for r in df.collect())
    assert sorted((r["t0"], r["log_energy"], r["meta_json"], tuple(r["x"])) for r in back.collect()) == want
    with np.load(f"{path}/{[n for n in names if n.endswith('.npz')][0]}") as z:
        assert z["X"].shape[1:] == (2,) and len(z["t0"]) == len(z["X"])  # NumPy reads them too
    df.limit(10).write.format("windows").mode("append").save(path)
    assert spark.read.format("windows").load(path).count() == 510
    df.limit(7).write.format("windows").mode("overwrite").save(path)
    assert spark.read.format("windows").load(path).count() == 7
    bad = df.withColumn("x", F.when(F.col("t0") < 240, F.col("x")))
    with pytest.raises(Exception, match="x is null"):
        bad.write.format("windows").mode("append").save(path)
    assert spark.read.format("windows").load(path).count() == 7 and not [n for n in os.listdir(path) if n.startswith("_job")]
    with pytest.raises(Exception, match="archives need x"):
        df.drop("x").write.format("windows").mode("append").save(path)
    shaped = df.withColumn("shape", F.array(F.lit(1), F.lit(2)))
    shaped.write.format("windows").mode("append").save(str(tmp_path / "shaped"))
    assert spark.read.format("windows").load(str(tmp_path / "shaped")).first()["shape"] == [1, 2]
