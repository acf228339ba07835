"""Fitting the bells and consequents of fuzzy rules: hybrid, and by gradients alone.

Every step is one pass in which each partition sends the sums of a loss and its gradients, of as many
numbers as the rules have parameters; rows never reach the driver. Widths and slopes are fitted as
softplus(raw) + 1e-6, so they stay positive whatever the step.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import hash_order
from . import staging
from .fuzzy import Rule

#: What widths and slopes have besides the softplus of their raw numbers, a fixed value.
TINY = 1e-6
#: Decay of the two moments of a gradient, and what keeps their quotient finite: fixed values of the method.
BETA1, BETA2, EPSILON = 0.9, 0.999, 1e-8
#: Rows that a task looks at together.
ROWS = 4096


@dataclass(frozen=True)
class Parameters:
    """a, b and c: rule x feature; theta: rule x (feature, last the constant) x class."""

    a: np.ndarray
    b: np.ndarray
    c: np.ndarray
    theta: np.ndarray

    @staticmethod
    def of(rules: list[Rule]) -> Parameters:
        return Parameters(*(np.array([getattr(r, k) for r in rules], float) for k in ("a", "b", "c")), np.array([r.consequent for r in rules], float))

    def rules(self) -> list[Rule]:
        plain = lambda x: tuple(map(float, x))
        return [Rule(plain(a), plain(b), plain(c), tuple(plain(t) for t in theta)) for a, b, c, theta in zip(self.a, self.b, self.c, self.theta, strict=True)]

    def flat(self) -> np.ndarray:
        return np.concatenate([x.ravel() for x in (self.a, self.b, self.c, self.theta)])

    def like(self, flat: np.ndarray) -> Parameters:
        parts, at = [], 0
        for x in (self.a, self.b, self.c, self.theta):
            parts.append(flat[at : at + x.size].reshape(x.shape))
            at += x.size
        return Parameters(*parts)

    def raw(self) -> np.ndarray:
        """As flat(), with the numbers of which widths and slopes are the softplus."""
        inverse = lambda x: (y := np.maximum(x - TINY, TINY)) + np.log(-np.expm1(-y))
        return replace(self, a=inverse(self.a), b=inverse(self.b)).flat()

    def of_raw(self, raw: np.ndarray) -> Parameters:
        p = self.like(raw)
        softplus = lambda x: np.maximum(x, 0) + np.log1p(np.exp(-np.abs(x))) + TINY
        return replace(p, a=softplus(p.a), b=softplus(p.b))

    def by_raw(self, gradient: np.ndarray) -> np.ndarray:
        """A gradient by flat() as one by raw()."""
        g = self.like(gradient)
        slope = lambda x: -np.expm1(-(x - TINY))
        return replace(g, a=g.a * slope(self.a), b=g.b * slope(self.b)).flat()


@dataclass(frozen=True)
class Fitted:
    rules: list[Rule]
    #: A row a pass: the loss of the training rows and that of the rows held out, before the step that the pass makes.
    train_loss: list[float] = field(default_factory=list)
    held_loss: list[float] = field(default_factory=list)
    #: The pass whose rules are kept.
    best: int = 0


def _memberships(p: Parameters, x: np.ndarray) -> tuple[np.ndarray, ...]:
    """(distances over width, their log, memberships) as row x rule x feature; log is 0 at the centre, where nothing depends on it."""
    z = np.abs(x[:, None, :] - p.c[None]) / p.a[None]
    log = np.log(np.where(z > 0, z, 1.0))
    with np.errstate(over="ignore"):
        return z, log, 1 / (1 + np.power(z, 2 * p.b[None]))


def outputs(p: Parameters, x: np.ndarray, floor: float = 1e-12) -> tuple[np.ndarray, ...]:
    """(class outputs, each rule's outputs, strengths, their divisor, memberships, distances, logs) of rows."""
    z, log, m = _memberships(p, x)
    fired = m.prod(axis=2)
    total = np.maximum(fired.sum(axis=1, keepdims=True), floor)
    strengths = fired / total
    own = np.einsum("nf,rfc->nrc", np.hstack([x, np.ones((len(x), 1))]), p.theta)
    return np.einsum("nr,nrc->nc", strengths, own), own, strengths, total, m, z, log


def cross_entropy(y: np.ndarray, label: np.ndarray, weights: np.ndarray) -> tuple[float, float, np.ndarray]:
    """(sum of weighted losses, sum of weights, its gradient by the outputs) of class labels over softmax outputs."""
    shifted = y - y.max(axis=1, keepdims=True)
    total = np.exp(shifted).sum(axis=1, keepdims=True)
    w = weights[label]
    rows = np.arange(len(label))
    grad = np.exp(shifted) / total * w[:, None]
    grad[rows, label] -= w
    return float((w * (np.log(total[:, 0]) - shifted[rows, label])).sum()), float(w.sum()), grad


def binary_entropy(y: np.ndarray, label: np.ndarray, weights: np.ndarray) -> tuple[float, float, np.ndarray]:
    """The same of one output and labels 0 and 1: weights[1] counts positive rows, and the mean is over rows, not weights."""
    x = y[:, 0]
    softplus = np.maximum(-x, 0) + np.log1p(np.exp(-np.abs(x)))  # of -x
    positive = label == 1
    loss = np.where(positive, weights[1] * softplus, softplus + x)
    half = np.exp(-np.abs(x))
    sigmoid = np.where(x >= 0, 1, half) / (1 + half)
    grad = np.where(positive, weights[1] * (sigmoid - 1), sigmoid)
    return float(loss.sum()), float(len(label)), grad[:, None]


def gradient(p: Parameters, x: np.ndarray, label: np.ndarray, weights: np.ndarray, loss: Callable, floor: float = 1e-12) -> tuple[float, float, Parameters]:
    """(sum of losses, what it is divided by, sums of its gradients by all parameters) of some rows."""
    y, own, strengths, total, m, z, log = outputs(p, x, floor)
    value, count, by_y = loss(y, label, weights)
    by_theta = np.einsum("nr,nf,nc->rfc", strengths, np.hstack([x, np.ones((len(x), 1))]), by_y, optimize=True)
    by_strength = np.einsum("nrc,nc->nr", own, by_y)
    fired = strengths * total
    held = (fired.sum(axis=1, keepdims=True) > floor).astype(float)  # below the floor the divisor is constant
    by_fired = (by_strength - held * (by_strength * strengths).sum(axis=1, keepdims=True)) / total
    by_log = (by_fired * fired)[:, :, None] * (1 - m)  # a membership's logarithm falls by (1 - m) times that of its power
    near = z > 0
    by_a = np.where(near, by_log * 2 * p.b[None] / p.a[None], 0.0).sum(axis=0)
    by_b = np.where(near, -by_log * 2 * log, 0.0).sum(axis=0)
    apart = x[:, None, :] - p.c[None]
    by_c = np.where(near, by_log * 2 * p.b[None] / np.where(near, apart, 1.0), 0.0).sum(axis=0)
    return value, count, Parameters(by_a, by_b, by_c, by_theta)


def _arrays(batch: pa.RecordBatch, n: int) -> tuple[np.ndarray, np.ndarray]:
    x = np.column_stack([batch.column(k).to_numpy(zero_copy_only=False).astype(float) for k in range(n)])
    return x, batch.column(n).to_numpy(zero_copy_only=False).astype(np.int64)


def sums(rows: DataFrame, features: list[str], label: str, p: Parameters, weights: np.ndarray, loss: Callable, *, gradients: bool = True) -> np.ndarray:
    """[sum of losses, divisor, gradients...] over all rows: each partition sends one row a number, which Spark sums by place."""
    size = len(p.flat()) if gradients else 0

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(2 + size)
        for batch in batches:
            x, y = _arrays(batch, len(features))
            for low in range(0, len(x), ROWS):
                some, own = x[low : low + ROWS], y[low : low + ROWS]
                if gradients:
                    value, count, by = gradient(p, some, own, weights, loss)
                    total[2:] += by.flat()
                else:
                    value, count, _ = loss(outputs(p, some)[0], own, weights)
                total[:2] += value, count
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], ["at", "v"])

    out = np.zeros(2 + size)
    added = rows.select(*[F.col(f).cast("double") for f in features], F.col(label).cast("long")).mapInArrow(part, "at long, v double").groupBy("at").agg(F.sum("v").alias("v"))
    for r in added.collect():  # a row a parameter
        out[r["at"]] = r["v"]
    return out


def normal_sums(rows: DataFrame, features: list[str], label: str, p: Parameters, floor: float = 1e-12) -> tuple[np.ndarray, np.ndarray]:
    """(X'X, X'Y) of the products of strengths and features against one-hot labels: the least squares of the consequents, over all rows."""
    n_rules, terms, classes = p.theta.shape
    width = n_rules * terms

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width + classes))
        for batch in batches:
            x, y = _arrays(batch, len(features))
            for low in range(0, len(x), ROWS):
                some = x[low : low + ROWS]
                strengths = outputs(p, some, floor)[2]
                phi = (strengths[:, :, None] * np.hstack([some, np.ones((len(some), 1))])[:, None, :]).reshape(len(some), width)
                total += phi.T @ np.hstack([phi, np.eye(classes)[y[low : low + ROWS]]])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size)), pa.array(total.ravel())], ["at", "v"])

    total = np.zeros(width * (width + classes))
    added = rows.select(*[F.col(f).cast("double") for f in features], F.col(label).cast("long")).mapInArrow(part, "at long, v double").groupBy("at").agg(F.sum("v").alias("v"))
    for r in added.collect():  # the square of the rules' terms
        total[r["at"]] = r["v"]
    total = total.reshape(width, width + classes)
    return total[:, :width], total[:, width:]


def class_weights(rows: DataFrame, label: str, classes: int) -> np.ndarray:
    """n / (classes * rows of the class), the rows of a class counting as one at least."""
    counts = dict(rows.groupBy(F.col(label).cast("int")).count().collect())  # a row a class
    return np.array([sum(counts.values()) / (classes * max(counts.get(k, 0), 1)) for k in range(classes)])


def positive_weight(rows: DataFrame, label: str) -> np.ndarray:
    """[1, negative rows / positive rows], for binary_entropy."""
    counts = dict(rows.groupBy(F.col(label).cast("int")).count().collect())
    return np.array([1.0, counts.get(0, 0) / max(counts.get(1, 0), 1)])


class Adam:
    """Steps by a gradient's running moments, carried between passes; decay draws the parameters to 0."""

    def __init__(self, size: int, rate: float, decay: float = 0.0) -> None:
        self.rate, self.decay, self.steps = rate, decay, 0
        self.first, self.second = np.zeros(size), np.zeros(size)

    def step(self, at: np.ndarray, gradient: np.ndarray) -> np.ndarray:
        gradient = gradient + self.decay * at
        self.steps += 1
        self.first = BETA1 * self.first + (1 - BETA1) * gradient
        self.second = BETA2 * self.second + (1 - BETA2) * gradient**2
        first, second = self.first / (1 - BETA1**self.steps), self.second / (1 - BETA2**self.steps)
        return at - self.rate * first / (np.sqrt(second) + EPSILON)


def in_batches(rows: DataFrame, key: str, steps: int, seed: int) -> DataFrame:
    """rows with _batch below steps, by ranges of a seeded hash of key: the batches stay from pass to pass, their order changes."""
    return rows.withColumn("_batch", F.floor(hash_order(F.col(key), seed) * F.lit(steps) / F.lit(1 << 32)).cast("int"))


def _passes(rows: DataFrame, held: DataFrame, features: list[str], label: str, start: Parameters, weights: np.ndarray, loss: Callable, *, adam: Adam, solve: bool, steps: int, seed: int, passes: int, patience: int, least: float) -> Fitted:
    """Passes until the held-out loss has not fallen by least for some of them; the rules of the best pass stay. solve: least squares come first in each."""
    rng = np.random.default_rng(seed)
    p, raw = start, start.raw()
    size = len(adam.first)
    best, kept, at, waited = np.inf, start, 0, 0
    train, seen = [], []
    for number in range(1, passes + 1):
        if solve:
            gram, cross = normal_sums(rows, features, label, p)
            p = replace(p, theta=(np.linalg.pinv(gram) @ cross).reshape(p.theta.shape))
            raw[size:] = p.theta.ravel()
        losses = []
        for k in rng.permutation(steps).tolist():
            total = sums(rows if steps == 1 else rows.filter(F.col("_batch") == k), features, label, p, weights, loss)
            if total[1] > 0:  # a batch may be empty
                raw[:size] = adam.step(raw[:size], p.by_raw(total[2:] / total[1])[:size])
                p = p.of_raw(raw)
                losses.append(total[0] / total[1])
        value, count = sums(held, features, label, p, weights, loss, gradients=False)
        train.append(float(np.mean(losses)) if losses else 0.0)
        seen.append(float(value / count) if count else 0.0)
        if seen[-1] < best - least:
            best, kept, at, waited = seen[-1], p, number, 0
        else:
            waited += 1
            if waited >= patience:
                break
    return Fitted(kept.rules(), train, seen, at)


def _fit(rows: DataFrame, features: list[str], label: str, key: str | None, steps: int, seed: int, run: Callable) -> Fitted:
    """run over rows as stored, a folder a batch, so that a step reads its own rows and columns only."""
    own = rows.select(*features, label, *([key] if steps > 1 and key not in (*features, label) else []))
    with staging.staged(in_batches(own, key, steps, seed) if steps > 1 else own, ["_batch"] if steps > 1 else []) as stored:
        return run(stored)


def hybrid(
    rows: DataFrame, held: DataFrame, features: list[str], label: str, rules: list[Rule], classes: int, *, rate: float = 0.01, decay: float = 0.0, passes: int = 200, patience: int = 20, least: float = 1e-5, steps: int = 1, key: str | None = None, seed: int = 42
) -> Fitted:
    """Rules fitted by turns: in each pass consequents by least squares over all rows, then bells by gradients of the class-weighted cross-entropy.

    steps: of a pass, each over the rows of one range of the key's seeded hash; one step takes all rows and needs no key.
    held: rows whose loss tells when to stop. Labels are 0, 1, ...; features and labels are not null. No rows: the rules as
    they came, with consequents of 0. Reruns agree up to the order in which Spark adds sums.
    """
    bells = 3 * len(rules) * len(features)
    start = replace(Parameters.of(rules), theta=np.zeros((len(rules), len(features) + 1, classes)))

    def run(stored: DataFrame) -> Fitted:
        weights = class_weights(stored, label, classes)
        return _passes(stored, held, features, label, start, weights, cross_entropy, adam=Adam(bells, rate, decay), solve=True, steps=steps, seed=seed, passes=passes, patience=patience, least=least)

    return _fit(rows, features, label, key, steps, seed, run)


def by_gradients(
    rows: DataFrame, held: DataFrame, features: list[str], label: str, rules: list[Rule], classes: int, *, key: str, rate: float = 1e-3, decay: float = 1e-4, passes: int = 200, patience: int = 20, least: float = 1e-5, steps: int = 16, seed: int = 42
) -> Fitted:
    """Rules whose bells and consequents are all fitted by gradients, in steps over ranges of the key's seeded hash, taken in seeded order.

    classes 1: one output and labels 0 and 1, with the binary entropy, in which positive rows weigh the other ones' number over
    theirs; more: the cross-entropy weighted by class. Otherwise as hybrid().
    """

    def run(stored: DataFrame) -> Fitted:
        weights, loss = (positive_weight(stored, label), binary_entropy) if classes == 1 else (class_weights(stored, label, classes), cross_entropy)
        start = Parameters.of(rules)
        return _passes(stored, held, features, label, start, weights, loss, adam=Adam(len(start.flat()), rate, decay), solve=False, steps=steps, seed=seed, passes=passes, patience=patience, least=least)

    return _fit(rows, features, label, key, steps, seed, run)
