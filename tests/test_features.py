"""The fitted feature model: what it learns, that it is saved whole, and rows that lack something."""

from __future__ import annotations

import numpy as np
import pytest

from windrow.operators import features

NAN, INF = float("nan"), float("inf")


def windows(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(80, 3)) @ rng.normal(size=(3, 6)) + rng.normal(scale=0.05, size=(80, 6))
    rows = [(k, [float(v) for v in x[k]], float(k % 7), float(k)) for k in range(80)]
    return x, spark.createDataFrame(rows, "window_id long, x array<double>, snr double, duration double")


def test_fit_is_that_of_numpy_and_survives_saving(spark, tmp_path):
    x, df = windows(spark)
    model = features.FeatureAssembler(features=["snr", "ae_score", "duration"], components=2).fit(df)
    low, high = np.percentile(x, [1, 99])
    scaled = np.clip((x - low) / (high - low + 1e-8), 0, 1)
    centred = scaled - scaled.mean(axis=0)
    _, s, v = np.linalg.svd(centred)
    score = ((centred - centred @ v[:2].T @ v[:2]) ** 2).mean(axis=1)
    out = {r["window_id"]: r for r in model.transform(df).collect()}
    assert np.allclose([out[k]["ae_score"] for k in range(80)], score, atol=1e-12)
    assert np.allclose([out[k]["features"][1] for k in range(80)], (score - score.min()) / (score.max() - score.min() + 1e-8), atol=1e-9)
    assert out[3]["features_raw"][0] == 3.0 and np.isclose(out[79]["features"][2], 1)
    model.write().save(f"{tmp_path}/model")
    again = features.FeatureModel.load(f"{tmp_path}/model")
    assert [tuple(r) for r in again.transform(df).orderBy("window_id").collect()] == [tuple(out[k]) for k in range(80)]
    assert again.uid == model.uid and again.getOrDefault("components") == 2
    with pytest.raises(Exception, match="exist"):
        model.write().save(f"{tmp_path}/model")
    model.write().overwrite().save(f"{tmp_path}/model")
    estimator = features.FeatureAssembler(features=["snr"], components=1)
    estimator.write().save(f"{tmp_path}/estimator")
    assert features.FeatureAssembler.load(f"{tmp_path}/estimator").getOrDefault("features") == ["snr"]
    latents = np.array([r["latent"] for r in again.latents(df).orderBy("window_id").collect()])
    assert np.allclose(np.abs(latents), np.abs(centred @ v[:2].T), atol=1e-9)


def test_rows_that_lack_something_go(spark):
    x, df = windows(spark)
    odd = spark.createDataFrame([(90, None, 1.0, 1.0), (91, [1.0], 1.0, 1.0), (92, [NAN] * 6, 1.0, 1.0), (93, [0.0] * 6, NAN, 1.0), (94, [0.0] * 6, None, 1.0), (95, [0.0] * 6, INF, 1.0), (96, [0.0] * 5 + [None], 1.0, 1.0), (97, [0.0] * 6, 99.0, 1.0)], df.schema)
    model = features.FeatureAssembler(features=["snr", "ae_score"], share=0.9).fit(df)
    out = model.transform(odd).collect()
    assert [r["window_id"] for r in out] == [97] and out[0]["features"][0] == 1.0
    assert len(features.FeatureAssembler(features=["snr", "ae_score"]).fit(df.unionByName(odd)).basis) >= 1
    with pytest.raises(ValueError, match="no pixels"):
        features.FeatureAssembler(features=["snr"]).fit(df.limit(0))


def test_matching(spark):
    own = spark.createDataFrame([(1, 1000, "a"), (2, 1001, "a"), (3, 5000, "a"), (4, 9000, "b")], "window_id long, t0 long, ifo string")
    trig = spark.createDataFrame([(1, 1003, "a", 5.0), (2, 1000, "a", 6.0), (3, 5009, "a", 7.0), (4, 9000, "a", 8.0)], "trigger_id long, t long, ifo string, snr double")
    out = {r["window_id"]: r["snr"] for r in features.matched(own, trig, "t0", "t", 10, ["ifo"], ["snr"], places=-1).collect()}
    assert out[1] == 6.0 and 2 not in out and out[3] == 7.0 and np.isnan(out[4])
