"""Whitening of embeddings by singular value decompositions that are merged up a tree.

A part of the rows keeps its number, mean, all singular values and right vectors. Two parts merge by
decomposing both parts' scaled vectors with one more row for the distance of their means, so nothing is
lost: the last part has the decomposition of all rows, whatever their order.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from . import common

#: Parts that one task merges; the levels of the tree are the logarithm of the partitions to this base.
FAN = 16
#: Rows that are decomposed at once.
ROWS = 8192
#: Singular values below this share of the greatest are rounding: there is no variance along their vectors.
NOTHING = 1e-12
PARTS = "node long, n long, mean array<double>, s array<double>, v array<double>"


@dataclass(frozen=True)
class Part:
    n: int
    mean: np.ndarray
    #: Singular values of the centred rows, falling, and their right vectors as rows.
    s: np.ndarray
    v: np.ndarray

    @property
    def variances(self) -> np.ndarray:
        return self.s**2 / self.n

    @property
    def covariance(self) -> np.ndarray:
        """With divisor n."""
        return (self.v.T * self.variances) @ self.v


def part_of(x: np.ndarray) -> Part:
    mean = x.mean(axis=0)
    _, s, v = np.linalg.svd(x - mean, full_matrices=False)
    return Part(len(x), mean, s, v)


def merged(a: Part, b: Part) -> Part:
    """Of the rows of both."""
    n = a.n + b.n
    apart = math.sqrt(a.n / n * b.n) * (a.mean - b.mean)
    _, s, v = np.linalg.svd(np.vstack([a.s[:, None] * a.v, b.s[:, None] * b.v, apart]), full_matrices=False)
    width = len(a.mean)
    return Part(n, a.mean + (b.mean - a.mean) * (b.n / n), s[:width], v[:width])


def _row(node: int, part: Part) -> pa.RecordBatch:
    lists = [pa.array([x.ravel()], pa.list_(pa.float64())) for x in (part.mean, part.s, part.v)]
    return pa.RecordBatch.from_arrays([pa.array([node]), pa.array([part.n]), *lists], ["node", "n", "mean", "s", "v"])


def _parts(table: pa.Table | pa.RecordBatch) -> Iterator[Part]:
    for row in table.to_pylist():
        mean = np.array(row["mean"])
        yield Part(row["n"], mean, np.array(row["s"]), np.array(row["v"]).reshape(-1, len(mean)))


def _matrix(column: pa.Array, width: int, kind: type) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(-1, width)


def fit(rows: DataFrame, column: str, width: int, origin: list[float] | None = None) -> Part | None:
    """The decomposition of an array column without nulls, of the given width; None without rows.

    origin is taken from each row first and given back in the mean: near the mean, it spares digits where
    that is large against the spread. Each partition folds its batches into one part of width^2 numbers, the
    parts meet in groups of FAN, and the driver gets the last one; so no task holds more than
    FAN parts, whatever the number of rows.
    """
    zero = np.zeros(width) if origin is None else np.array(origin, dtype=float)

    def leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = None
        for batch in batches:
            x = _matrix(batch.column(0), width, float) - zero
            for low in range(0, len(x), ROWS):
                new = part_of(x[low : low + ROWS])
                part = new if part is None else merged(part, new)
        if part is not None:
            yield _row(TaskContext.get().partitionId(), part)

    def inner(table: pa.Table) -> pa.Table:
        node = table.column("node")[0].as_py() // FAN
        return pa.Table.from_batches([_row(node, reduce(merged, _parts(table.sort_by("node"))))])

    parts = common.stage(rows.select(column).mapInArrow(leaves, PARTS), "parts")
    last = parts.agg(F.max("node")).first()[0]
    if last is None:
        return None
    while last > 0:
        parts = parts.groupBy(F.floor(F.col("node") / FAN)).applyInArrow(inner, PARTS)
        last //= FAN
    whole = next(_parts(parts.toArrow()))
    return Part(whole.n, whole.mean + zero, whole.s, whole.v)


def column_sums(rows: DataFrame, column: str, width: int) -> list[int]:
    """Exact sums by dimension of an array column of longs; each partition sends one row a dimension."""

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        high, low = [0] * width, [0] * width
        for batch in batches:
            x = _matrix(batch.column(0), width, np.int64)
            high = [a + b for a, b in zip(high, (x >> 32).sum(axis=0).tolist(), strict=True)]  # in halves: no sum of a batch overflows
            low = [a + b for a, b in zip(low, (x & 0xFFFFFFFF).sum(axis=0).tolist(), strict=True)]
        totals = [str((a << 32) + b) for a, b in zip(high, low, strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(width)), pa.array(totals)], ["at", "total"])

    sums = rows.select(column).mapInArrow(summed, "at long, total string").groupBy("at").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"))
    return [int(r["total"]) for r in sums.orderBy("at").collect()]  # width rows


def kept(components: int, part: Part) -> int:
    """Of the leading components, those along which there is variance."""
    return int((part.s[:components] > NOTHING * part.s[0]).sum()) if part.s[0] > 0 else 0


def _deviations(x: np.ndarray, n: int, sums: list[int]) -> tuple[np.ndarray, list[int | None]]:
    """((n x - S) / n, the squares of n x - S summed over dimensions; None beyond long)."""
    spread = max(abs(int(x.max(initial=0))), abs(int(x.min(initial=0)))) * n + max(map(abs, sums), default=0)
    whole = x * np.int64(n) - np.array(sums, np.int64) if spread < 1 << 62 else x.astype(object) * n - np.array(sums, object)
    centred = whole.astype(float) / n
    if whole.dtype != object and float((whole.astype(float) ** 2).sum(axis=1).max(initial=0)) < 2**62:
        return centred, (whole**2).sum(axis=1).tolist()
    squares = [sum(int(v) ** 2 for v in row) for row in whole.tolist()]
    return centred, [s if s < 1 << 63 else None for s in squares]


def commonest_width(rows: DataFrame, column: str) -> int:
    """Of the lengths of an array column the most frequent, of those the least; 0 without rows."""
    widths = rows.groupBy(F.size(column).alias("width")).count().orderBy(F.desc("count"), "width").first()
    return widths["width"] if widths else 0


def usable(embedding: str) -> Column:
    """Whether a vector is neither null nor empty and all its entries are finite."""
    x = F.col(f"`{embedding}`")
    return F.coalesce((F.size(x) > 0) & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))), F.lit(False))


def whiten(rows: DataFrame, key: str, column: str, components: int) -> DataFrame:
    """(key, component, n, deviation, whitened, explained, identity_error) of array<long> vectors of one width, a row for each vector and leading component.

    whitened has covariance one: coordinates from the mean along the components, over the root of the variance.
    identity_error measures that over all rows by a second decomposition. Where there is no variance along a component (fewer
    distinct vectors than dimensions) whitened is null, and such components count for no error; a deviation beyond long is null.
    Rows must be staged: they are read four times.
    """
    width = commonest_width(rows, column)
    kind = StructType([StructField("key", rows.schema[key].dataType)]).simpleString()[len("struct<") : -1].replace(":", " ", 1)
    schema = f"{kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if not width:
        return rows.sparkSession.createDataFrame([], schema).withColumnRenamed("key", key)
    sums, n = column_sums(rows, column, width), rows.count()
    part = fit(rows, column, width, [float(round(s / n)) for s in sums])
    most = min(components, width)
    some, total = kept(most, part), float(part.variances.sum())
    scales = part.v[:some].T / np.sqrt(part.variances[:some])
    explained = [float(part.variances[k]) / total if some and k < len(part.s) else (0.0 if some else None) for k in range(most)]

    def projected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            centred, _ = _deviations(_matrix(batch.column(0), width, np.int64), n, sums)
            y = np.ascontiguousarray(centred @ scales)
            yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array(np.arange(len(y) + 1, dtype=np.int32) * some), pa.array(y.ravel()))], ["y"])

    error = None
    if some:
        error = float(np.abs(fit(rows.select(column).mapInArrow(projected, "y array<double>"), "y", some).covariance - np.eye(some)).max())

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            centred, deviations = _deviations(_matrix(batch.column(1), width, np.int64), n, sums)
            size = len(centred)
            y = np.full((size, most), np.nan)
            y[:, :some] = centred @ scales
            each = np.repeat(np.arange(size), most)
            columns = [
                batch.column(0).take(pa.array(each)),
                pa.array(np.tile(np.arange(1, most + 1, dtype=np.int32), size)),
                pa.array(np.full(size * most, n)),
                pa.array(deviations, pa.int64()).take(pa.array(each)),
                pa.array(y.ravel(), pa.float64(), from_pandas=True),
                pa.array(explained * size, pa.float64()),
                pa.array([error] * (size * most), pa.float64()),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["key", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.select(F.col(key).alias("key"), column).mapInArrow(scored, schema).withColumnRenamed("key", key)


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight whitened components of all embeddings, as longs floor(1024 c) + 100000.

    Vectors that are null or empty, or hold null or non-finite entries, are left out, and so are those of another length than
    the commonest, with which they share no covariance. Entries beyond long / 4 count as its bounds. Rows that repeat, or share an id,
    count each. No vectors: no rows.
    """
    rows = common.table(spark, sf_dir, "embeddings")
    bound = float(1 << 61)
    whole = F.transform(F.col("embedding"), lambda c: F.floor(F.least(F.greatest(c.cast("double") * 1024, F.lit(-bound)), F.lit(bound))).cast("long") + 100000)
    rows = rows.filter(usable("embedding")).select("vec_id", whole.alias("x"))
    with common.scratch(spark):
        rows = common.stage(rows, "vectors", keep=True)
        width = commonest_width(rows, "x")
        return whiten(rows.filter(F.size("x") == width), "vec_id", "x", 8)
