"""Sums of products over all rows, and what small solvers make of them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import array_sum


def normal_equations(df: DataFrame, columns: list[Column], targets: list[Column]) -> tuple[np.ndarray, np.ndarray]:
    """(X'X, X'Y) of expressions, by one aggregate."""
    n = len(columns)
    pairs = [(i, j) for i in range(n) for j in range(i, n)]
    named = df.select(*[c.cast("double").alias(f"x{i}") for i, c in enumerate(columns)], *[t.cast("double").alias(f"y{k}") for k, t in enumerate(targets)])
    row = named.agg(*[F.sum(F.col(f"x{i}") * F.col(f"x{j}")).alias(f"g{i}_{j}") for i, j in pairs], *[F.sum(F.col(f"x{i}") * F.col(f"y{k}")).alias(f"c{i}_{k}") for i in range(n) for k in range(len(targets))]).first()
    gram = np.zeros((n, n))
    for i, j in pairs:
        gram[i, j] = gram[j, i] = row[f"g{i}_{j}"] or 0.0
    cross = np.array([[row[f"c{i}_{k}"] or 0.0 for k in range(len(targets))] for i in range(n)])
    return gram, cross


def moments(df: DataFrame, xs: str, width: int) -> tuple[int, np.ndarray, np.ndarray]:
    """(n, mean, covariance with n - 1) of an array column, of rows of the given width; each batch sends one matrix, summed by place."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width + 1, width + 1))
        for batch in batches:
            x = batch.column(0).drop_null()
            x = x.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, width)
            x = np.hstack([x, np.ones((len(x), 1))])
            total += x.T @ x
        at = np.arange(total.size)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total.ravel())], ["at", "v"])

    summed = df.select(xs).filter(F.size(xs) == width).mapInArrow(partial, "at long, v double").groupBy("at").agg(F.sum("v").alias("v")).collect()  # (width + 1)^2 rows
    total = np.zeros((width + 1) ** 2)
    for row in summed:
        total[row["at"]] = row["v"]
    total = total.reshape(width + 1, width + 1)
    n = int(round(total[-1, -1]))
    mean = total[-1, :-1] / max(n, 1)
    return n, mean, (total[:-1, :-1] - n * np.outer(mean, mean)) / max(n - 1, 1)


def pca(df: DataFrame, xs: str, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(mean, components as rows by falling variance, shares of the variance)."""
    _, mean, covariance = moments(df, xs, width)
    values, vectors = np.linalg.eigh(covariance)
    order = np.argsort(-values, kind="stable")
    values = np.maximum(values[order], 0)
    return mean, vectors[:, order].T, values / max(values.sum(), 1e-300)


def components_for(shares: np.ndarray, wanted: float = 0.95) -> int:
    """The fewest components whose shares reach the wanted one."""
    return min(int((np.cumsum(shares) < wanted).sum()) + 1, len(shares))


def _vector(v: np.ndarray) -> Column:
    return F.lit(np.asarray(v, float))


def projected(xs: Column, mean: np.ndarray, components: np.ndarray) -> Column:
    """Centred coordinates of an array along the components."""
    centred = F.zip_with(xs, _vector(mean), lambda x, m: x - m)
    return F.array(*[array_sum(F.zip_with(centred, _vector(c), lambda x, y: x * y)) for c in components])


def reconstruction_error(df: DataFrame, xs: str, mean: np.ndarray, components: np.ndarray, out: str = "score") -> DataFrame:
    """df with the mean squared error of rebuilding an array from its components.

    As components are orthonormal, the squared error is the centred length less the coordinates' one.
    """
    centred = F.zip_with(F.col(xs), _vector(mean), lambda x, m: x - m)
    length = array_sum(F.transform(centred, lambda x: x * x))
    coordinates = array_sum(F.transform(projected(F.col(xs), mean, components), lambda x: x * x)) if len(components) else F.lit(0.0)
    return df.withColumn(out, F.greatest(length - coordinates, F.lit(0.0)) / F.size(xs))
