"""Parameters that runs share, checked when they are made, and reports of runs as JSON."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field, fields, is_dataclass
from typing import Any

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

#: Detectors, epochs and durations in seconds that windows may have, fixed values.
IFOS, EPOCHS, SCALES = ("H1", "L1"), ("O3a", "O3b"), (0.25, 1.0, 4.0)


def one_of(name: str, value: Any, allowed: tuple) -> Any:
    """value, if it is among the allowed ones; else a ValueError that names them."""
    if value not in allowed:
        raise ValueError(f"{name} must be one of {', '.join(map(str, allowed))}, not {value}")
    return value


def _between(name: str, value: float, low: float, high: float) -> None:
    if not low <= value <= high:
        raise ValueError(f"{name} must lie in [{low:g}, {high:g}], not {value:g}")


@dataclass(frozen=True)
class Windows:
    ifos: tuple[str, ...] = IFOS
    epochs: tuple[str, ...] = EPOCHS
    scales_sec: tuple[float, ...] = SCALES
    image_size: int = 128
    qrange: tuple[float, float] = (4, 64)
    frange: tuple[float, float] = (10, 2048)
    normalization: str = "p99"
    log_energy_percentile: float = 90

    def __post_init__(self) -> None:
        for name, values, allowed in (("ifos", self.ifos, IFOS), ("epochs", self.epochs, EPOCHS), ("scales_sec", self.scales_sec, SCALES)):
            for v in values:
                one_of(name, v, allowed)
        one_of("normalization", self.normalization, ("p99",))
        _between("log_energy_percentile", self.log_energy_percentile, 0, 100)
        for name, (low, high) in (("qrange", self.qrange), ("frange", self.frange)):
            if not 0 < low < high:
                raise ValueError(f"{name} must rise from above 0, not {low:g} to {high:g}")


@dataclass(frozen=True)
class Temporal:
    train_end_percentile: float = 70
    val_end_percentile: float = 85

    def __post_init__(self) -> None:
        _between("val_end_percentile", self.val_end_percentile, 0, 100)
        _between("train_end_percentile", self.train_end_percentile, 0, self.val_end_percentile)


@dataclass(frozen=True)
class Split:
    energy_threshold_percentile: float = 95
    train_ratio: float = 0.85
    temporal: Temporal = field(default_factory=Temporal)

    def __post_init__(self) -> None:
        _between("energy_threshold_percentile", self.energy_threshold_percentile, 0, 100)
        _between("train_ratio", self.train_ratio, 0, 1)


@dataclass(frozen=True)
class Evaluation:
    alpha: float = 0.7
    target_fpr: float = 0.01
    auroc_min: float = 0.70
    auroc_max: float = 0.98
    auroc_transfer_drop_max: float = 0.15

    def __post_init__(self) -> None:
        for f in fields(self):
            _between(f.name, getattr(self, f.name), 0, 1)
        _between("auroc_min", self.auroc_min, 0, self.auroc_max)


@dataclass(frozen=True)
class Parameters:
    generator: Windows = field(default_factory=Windows)
    split: Split = field(default_factory=Split)
    evaluation: Evaluation = field(default_factory=Evaluation)


def _made(kind: type, given: dict[str, Any], where: str) -> Any:
    known = {f.name: f for f in fields(kind)}
    if unknown := sorted(set(given) - set(known)):
        raise ValueError(f"{where or 'parameters'} has no {', '.join(unknown)}")
    default, out = kind(), {}
    for name, value in given.items():
        before = getattr(default, name)
        if is_dataclass(before):
            out[name] = _made(type(before), value or {}, f"{where}.{name}".lstrip("."))
        elif isinstance(before, tuple):
            out[name] = tuple(value)
        elif isinstance(before, str) != isinstance(value, str) or isinstance(value, bool):
            raise ValueError(f"{where}.{name} must be {'a text' if isinstance(before, str) else 'a number'}, not {value!r}")
        else:
            out[name] = type(before)(value)
    return kind(**out)


def parameters(given: dict[str, Any] | None = None) -> Parameters:
    """The defaults with what is given by section and name; unknown names and values out of range raise a ValueError."""
    return _made(Parameters, given or {}, "")


def read_parameters(spark: SparkSession, path: str) -> Parameters:
    """parameters() of a JSON file; defaults where there is none."""
    return parameters(read_report(spark, path))


def write_report(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """A few rows of figures, a JSON object a line, in one file: for summaries, not for tables."""
    df.coalesce(1).write.mode(mode).json(path)


def write_object(spark: SparkSession, content: dict[str, Any] | Parameters, path: str, mode: str = "overwrite") -> None:
    """One JSON object as a file of one line."""
    plain = asdict(content) if is_dataclass(content) else content
    spark.createDataFrame([(json.dumps(plain, sort_keys=True),)], "value string").coalesce(1).write.mode(mode).text(path)


def read_report(spark: SparkSession, path: str) -> dict[str, Any]:
    """The JSON object at path; {} where there is no file, or an empty one. Malformed text raises a ValueError."""
    try:
        rows = spark.read.option("wholetext", True).text(path).limit(2).collect()
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return {}
    texts = [r["value"] for r in rows if r["value"] and r["value"].strip()]
    return json.loads(texts[0]) if texts else {}
