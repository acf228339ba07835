"""Trigger catalogues as CSV, window tables as Parquet, and archives of arrays."""

from __future__ import annotations

import io
import warnings
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Columns of a catalogue, all read as text so that malformed fields can be told from missing ones.
FIELDS = ("ifo", "peak_time", "peak_time_ns", "event_time", "ml_label", "label", "ml_confidence", "snr", "peak_frequency", "duration", "bandwidth", "q_value", "gravityspy_id")
NUMBERS = ("snr", "peak_frequency", "duration", "bandwidth", "q_value")


def require(df: DataFrame, columns: list[str]) -> DataFrame:
    """df, if it has the columns; names all that it lacks otherwise."""
    if lacking := [c for c in columns if c not in df.columns]:
        raise ValueError(f"missing columns: {', '.join(lacking)}")
    return df


def number(name: str) -> Column:
    return F.trim(F.col(name)).try_cast("double")


#: Names under which files have the detector, in the order in which they are looked for, fixed values.
IFO_NAMES = ("ifo", "IFO", "detector", "channel")


def _by_header(spark: SparkSession, path: str | list[str], ifo_names: tuple[str, ...] = ("ifo",)) -> DataFrame:
    """FIELDS as text, with file and file_order. Files that share a header are read together, each kind by its own; ifo is the first of ifo_names that a header has."""
    files = spark.read.option("wholetext", False).text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at"))
    heads = files.filter("at = 0").groupBy("file").agg(F.first("value").alias("header"))
    kinds = {r["header"]: r["files"] for r in heads.groupBy("header").agg(F.sort_array(F.collect_list("file")).alias("files")).orderBy(F.col("files")[0]).collect()}  # a row a header, with the names of its files
    parts = []
    for names in kinds.values():
        raw = spark.read.option("header", True).csv(names).select("*", F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("_place"))
        named = {f: f for f in FIELDS if f in raw.columns} | {"ifo": n for n in reversed(ifo_names) if n in raw.columns}
        lacking = [F.lit(None).cast("string").alias(f) for f in FIELDS if f not in named]
        parts.append(raw.select(*[F.col(f"`{n}`").cast("string").alias(f) for f, n in named.items()], *lacking, "file", "_place").select(*FIELDS, "file", "_place"))
    if not parts:
        return spark.createDataFrame([], ", ".join(f"{f} string" for f in FIELDS) + ", file string, file_order struct<file: string, place: long>")
    return reduce(DataFrame.unionByName, parts).withColumn("file_order", F.struct("file", F.col("_place").alias("place"))).drop("_place")


def read_files(spark: SparkSession, folder: str, partitions: list[tuple[str, str]], pattern: str = "{ifo}_{epoch}.csv", *, label: str = "ml_label") -> tuple[DataFrame, list[str]]:
    """(triggers of one file for each (ifo, epoch), with epoch; the names of files that are absent, which count as empty)."""
    parts, absent = [], []
    for ifo, epoch in partitions:
        name = pattern.format(ifo=ifo, epoch=epoch)
        try:
            parts.append(read_catalogue(spark, f"{folder}/{name}", label=label).withColumns({"ifo": F.coalesce("ifo", F.lit(ifo)), "epoch": F.lit(epoch)}))
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            absent.append(name)
    none = read_none(spark)
    return reduce(DataFrame.unionByName, parts, none), absent


def read_none(spark: SparkSession) -> DataFrame:
    """A catalogue without rows."""
    numbers = ", ".join(f"{c} double" for c in NUMBERS)
    return spark.createDataFrame([], f"ifo string, t double, label string, ml_confidence double, {numbers}, gravityspy_id string, file string, file_order struct<file: string, place: long>, epoch string")


def first_match(spark: SparkSession, folder: str, patterns: tuple[str, ...]) -> DataFrame | None:
    """The Parquet files of the first pattern that matches any in folder, with a warning where it is not the first of all; None where none does."""
    for pattern in patterns:
        try:
            found = spark.read.option("pathGlobFilter", pattern).parquet(folder)
            if pattern != patterns[0]:
                warnings.warn(f"{folder} has no {patterns[0]}; {pattern} is read", stacklevel=2)
            return found
        except AnalysisException as error:
            if error.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
                raise
    return None


def read_catalogue(spark: SparkSession, path: str | list[str], *, label: str = "ml_label") -> DataFrame:
    """Typed triggers: t (seconds), label, ml_confidence, the numeric fields, with file and its order of rows.

    Time is peak_time and its nanoseconds, else event_time; a peak_time whose nanoseconds are malformed
    counts as whole seconds. Malformed times and confidences are null, malformed numbers 0. Each file is read
    by its own header, whatever its order of columns; a column that it lacks is null. file_order follows
    the names of files and the rows in them.
    """
    raw = _by_header(spark, path)
    t = F.coalesce(number("peak_time") + F.coalesce(number("peak_time_ns"), F.lit(0.0)) * 1e-9, number("event_time"))
    return raw.select(
        F.trim("ifo").alias("ifo"),
        t.alias("t"),
        F.nullif(F.trim(F.coalesce(label, "label")), F.lit("")).alias("label"),
        number("ml_confidence").alias("ml_confidence"),
        *[F.coalesce(number(c), F.lit(0.0)).alias(c) for c in NUMBERS],
        F.col("gravityspy_id"),
        "file",
        "file_order",
    )


def peak_times(spark: SparkSession, path: str | list[str], ifo: str) -> DataFrame:
    """(t, file, file_order) of the triggers of a detector, and of those that name none, whatever of IFO_NAMES the column is called; files without one count whole.

    Time is peak_time with its nanoseconds where both are numbers, else event_time, else peak_time in whole seconds; rows without any of them go.
    """
    raw = _by_header(spark, path, IFO_NAMES)
    own = F.coalesce(F.trim("ifo"), F.lit(""))
    t = F.coalesce(number("peak_time") + number("peak_time_ns") * 1e-9, number("event_time"), number("peak_time"))
    return raw.filter((own == "") | (own == ifo)).select(t.alias("t"), "file", "file_order").filter("t is not null")


def counted(spark: SparkSession, path: str | list[str], ifo: str) -> DataFrame:
    """(file, rows, kept): of each file its rows and those that peak_times() gives."""
    rows = _by_header(spark, path, IFO_NAMES).groupBy("file").agg(F.count(F.lit(1)).alias("rows"))
    kept = peak_times(spark, path, ifo).groupBy("file").agg(F.count(F.lit(1)).alias("kept"))
    return rows.join(kept, "file", "left").select("file", "rows", F.coalesce("kept", F.lit(0)).alias("kept"))


def filters(*, ifo: str | None = None, confidence: float | None = 0.9, snr: float | None = 7.5, span: tuple[float, float] | None = None, excluded: tuple[str, ...] = ()) -> dict[str, Column]:
    """Named tests in the order in which they are applied; a row is counted against the first that it fails."""
    tests = {} if ifo is None else {"ifo": F.col("ifo") == ifo}
    if confidence is not None:
        tests["confidence"] = F.col("ml_confidence") >= confidence
    tests["label"] = F.col("label").isNotNull()
    if excluded:
        tests["excluded"] = ~F.col("label").isin(*excluded)
    tests["time"] = F.col("t").isNotNull() if span is None else F.col("t").between(*span)
    if snr is not None:
        tests["snr"] = F.col("snr") >= snr
    return tests


def selected(triggers: DataFrame, tests: dict[str, Column]) -> DataFrame:
    out = triggers
    for test in tests.values():
        out = out.filter(test)
    return out


def skipped(triggers: DataFrame, tests: dict[str, Column]) -> DataFrame:
    """One row: how many rows fail each test first, and how many pass all."""
    first = None
    for name, test in tests.items():
        failed = ~F.coalesce(test, F.lit(False))
        first = F.when(failed, name) if first is None else first.when(failed, name)
    marked = triggers.withColumn("_failed", first)
    return marked.agg(*[F.count_if(F.col("_failed") == name).alias(f"skipped_{name}") for name in tests], F.count_if(F.col("_failed").isNull()).alias("kept"))


def read_windows(spark: SparkSession, path: str | list[str], *, ifos: list[str] | None = None, epochs: list[str] | None = None, durations: list[float] | None = None) -> DataFrame:
    """Windows partitioned by ifo, epoch and dur: the filters prune folders. Missing t0 and log_energy get their place and 0."""
    df = require(spark.read.option("recursiveFileLookup", False).parquet(*([path] if isinstance(path, str) else path)), ["x"])
    for column, wanted in (("ifo", ifos), ("epoch", epochs), ("dur", durations)):
        if wanted is not None:
            df = df.filter(F.col(column).isin(*wanted))
    if "t0" not in df.columns:
        df = df.withColumn("t0", F.col("_metadata.row_index").cast("double"))  # its place in its file
    return df if "log_energy" in df.columns else df.withColumn("log_energy", F.lit(0.0).cast("float"))


def write_windows(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """As Parquet in a folder for each ifo, epoch and dur; ignore leaves what exists."""
    df.write.mode(mode).partitionBy("ifo", "epoch", "dur").parquet(path)


def duration(meta: Column) -> Column:
    """A window's length from its JSON: dur, else window_dur, else duration, else 1."""
    return F.coalesce(*[F.get_json_object(meta, f"$.{k}").try_cast("double") for k in ("dur", "window_dur", "duration")], F.lit(1.0))


def read_npz(spark: SparkSession, path: str) -> DataFrame:
    """(file, row, t0, log_energy, meta_json, shape, x) of archives of arrays with keys X, t0, log_energy, meta_json; a file is unpacked in one task."""

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                with np.load(io.BytesIO(content.as_py()), allow_pickle=False) as z:
                    x = z["X"].astype(np.float32)
                    n = len(x)
                    t0 = z["t0"].astype(float) if "t0" in z else np.arange(n, dtype=float)
                    energy = z["log_energy"].astype(np.float32) if "log_energy" in z else np.zeros(n, np.float32)
                    meta = str(z["meta_json"]) if "meta_json" in z else "{}"
                    for low in range(0, n, 256):
                        part = x[low : low + 256].reshape(len(x[low : low + 256]), -1)
                        k = len(part)
                        lists = pa.ListArray.from_arrays(np.arange(k + 1, dtype=np.int32) * part.shape[1], pa.array(part.ravel()))
                        shape = pa.array([list(x.shape[1:])] * k, pa.list_(pa.int32()))
                        yield pa.RecordBatch.from_arrays([pa.array([name] * k), pa.array(np.arange(low, low + k)), pa.array(t0[low : low + k]), pa.array(energy[low : low + k]), pa.array([meta] * k), shape, lists], ["file", "row", "t0", "log_energy", "meta_json", "shape", "x"])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.npz").load(path)
    return files.select("path", "content").mapInArrow(unpack, "file string, row long, t0 double, log_energy float, meta_json string, shape array<int>, x array<float>")
