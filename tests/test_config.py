"""Parameters and reports, and catalogues whose detector column has other names."""

from __future__ import annotations

import json

import pytest

from windrow import config
from windrow.sources import catalogue


def test_parameters_are_checked(spark, tmp_path):
    assert config.parameters() == config.Parameters() and config.parameters().split.temporal.val_end_percentile == 85
    got = config.parameters({"split": {"train_ratio": 1, "temporal": {"train_end_percentile": 60}}, "generator": {"scales_sec": [4.0]}})
    assert got.split.train_ratio == 1.0 and got.split.temporal.train_end_percentile == 60 and got.generator.scales_sec == (4.0,)
    for bad, said in (
        ({"generator": {"scales_sec": [2.0]}}, "scales_sec must be one of 0.25, 1.0, 4.0, not 2.0"),
        ({"generator": {"ifos": ["V1"]}}, "ifos must be one of"),
        ({"generator": {"qrange": [64, 4]}}, "qrange must rise"),
        ({"split": {"train_ratio": 1.5}}, "train_ratio must lie in"),
        ({"split": {"temporal": {"train_end_percentile": 90}}}, "train_end_percentile must lie in"),
        ({"split": {"speed": 1}}, "split has no speed"),
        ({"evaluation": {"alpha": "much"}}, "evaluation.alpha must be a number"),
        ({"other": {}}, "parameters has no other"),
    ):
        with pytest.raises(ValueError, match=said):
            config.parameters(bad)
    config.write_object(spark, got, f"{tmp_path}/p")
    assert config.read_parameters(spark, f"{tmp_path}/p") == got and config.read_parameters(spark, f"{tmp_path}/none") == config.Parameters()


def test_reports(spark, tmp_path):
    config.write_report(spark.createDataFrame([("auroc", 0.7)], "name string, value double"), f"{tmp_path}/r")
    files = list((tmp_path / "r").glob("*.json"))
    assert len(files) == 1 and json.loads(files[0].read_text()) == {"name": "auroc", "value": 0.7}
    assert config.read_report(spark, f"{tmp_path}/r") == {"name": "auroc", "value": 0.7} and config.read_report(spark, f"{tmp_path}/absent") == {}
    (tmp_path / "bad.json").write_text("{")
    with pytest.raises(ValueError):
        config.read_report(spark, f"{tmp_path}/bad.json")
    (tmp_path / "empty.json").write_text("")
    assert config.read_report(spark, f"{tmp_path}/empty.json") == {}


def test_detectors_and_times(spark, tmp_path):
    (tmp_path / "a.csv").write_text("IFO,peak_time,peak_time_ns,event_time\nH1,10,500000000,3\nL1,11,,\n,12,,12.25\nH1,13,x,\nH1,,,\nH1,14,,y\n")
    (tmp_path / "b.csv").write_text("detector,peak_time\nH1,20\nL1,21\n")
    (tmp_path / "c.csv").write_text("peak_time,snr\n30,9\n")
    got = [r["t"] for r in catalogue.peak_times(spark, str(tmp_path), "H1").orderBy("file_order").collect()]
    assert got == [10.5, 12.25, 13.0, 14.0, 20.0, 30.0]
    counts = {r["file"].rsplit("/", 1)[1]: (r["rows"], r["kept"]) for r in catalogue.counted(spark, str(tmp_path), "H1").collect()}
    assert counts == {"a.csv": (6, 4), "b.csv": (2, 1), "c.csv": (1, 1)}
