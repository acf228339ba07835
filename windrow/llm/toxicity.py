"""Toxicity by cumulative-link ordinal regression.

P(grade > j) = sigmoid(w . x - cut_j): one weight for each word, shared by all
thresholds, and cuts in rising order. Features are the distinct words of a text.
Where labels only say toxic or not, toxic texts are graded by how many words
that mark toxic texts they hold: up to the median 1, above it 2.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, words

#: The labelled rows that the regression is fitted on: about so many, dealt evenly to the grades.
SAMPLE = 18_000
#: A word is a feature if so many sampled texts hold it; the most frequent are kept.
LEAST_TEXTS, FEATURES = 4, 1 << 16
#: Weight of the L1 penalty, and rounds of the proximal gradient.
PENALTY, ROUNDS = 1e-3, 150
GRADES = 3
#: A word marks toxic texts if so many times the share of them hold it as of the others.
MARKED = 20.0


@dataclass
class Model:
    vocabulary: np.ndarray
    weights: np.ndarray
    cuts: np.ndarray


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = list(words.each_set(*words.hashed(batch.column(1), words.MARKS)))
        flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
        ends = np.cumsum([0, *map(len, sets)]).astype(np.int32)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.ListArray.from_arrays(ends, pa.array(flat.view(np.int64)))], ["doc_id", "grade", "features"])


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def fit(features: list[np.ndarray], grades: np.ndarray, n_grades: int, *, least: int = LEAST_TEXTS, most: int = FEATURES, penalty: float = PENALTY, rounds: int = ROUNDS) -> Model:
    """Accelerated proximal gradient on the mean log loss of the thresholds; words that do not help get weight 0."""
    flat = np.concatenate(features) if features else np.zeros(0, np.int64)
    found, texts = np.unique(flat, return_counts=True)
    found, texts = found[texts >= least], texts[texts >= least]
    vocabulary = np.sort(found[np.lexsort((found, -texts))[:most]])
    lengths = np.array([len(f) for f in features], dtype=np.int64)
    row = np.repeat(np.arange(len(features)), lengths)
    at = np.minimum(np.searchsorted(vocabulary, flat), max(len(vocabulary) - 1, 0))
    known = vocabulary[at] == flat if len(vocabulary) else np.zeros(len(flat), bool)
    row, at = row[known], at[known]
    above = (grades[:, None] > np.arange(n_grades - 1)).astype(float)
    # each threshold weighs its two sides alike, so that rare grades count
    side = np.clip(above.mean(axis=0), 1e-6, 1 - 1e-6)
    weight = (above / side + (1 - above) / (1 - side)) / 2 / max(len(grades), 1)
    w, cuts = np.zeros(len(vocabulary)), np.arange(n_grades - 1, dtype=float)
    # diagonal steps: the curvature of a feature is at most a quarter of its weighted texts times the number of features a text holds
    held = np.maximum(np.bincount(row, minlength=len(grades)), 1.0)
    curve = np.bincount(at, weights=(weight.sum(axis=1) * held)[row], minlength=len(vocabulary)) / 4 + 1e-9
    step_w, step_c = 1 / np.sqrt(curve.mean() * curve) if len(curve) else curve, 1.0
    v, u, t = w.copy(), cuts.copy(), 1.0
    for _ in range(rounds):
        logit = np.bincount(row, weights=v[at], minlength=len(grades))[:, None] - u
        slope = (_sigmoid(logit) - above) * weight
        gradient = np.bincount(at, weights=slope.sum(axis=1)[row], minlength=len(vocabulary))
        new_w = v - step_w * gradient
        new_w = np.sign(new_w) * np.maximum(np.abs(new_w) - step_w * penalty, 0)
        new_c = np.maximum.accumulate(u + step_c * slope.sum(axis=0))
        t_next = (1 + np.sqrt(1 + 4 * t * t)) / 2
        if gradient @ (new_w - w) > 0:  # momentum points uphill: start it anew
            t_next = 1.0
        ahead = (t - 1) / t_next if t_next > 1 else 0.0
        v, u, t = new_w + ahead * (new_w - w), np.maximum.accumulate(new_c + ahead * (new_c - cuts)), t_next
        w, cuts = new_w, new_c
    kept = w != 0
    return Model(vocabulary[kept], w[kept], cuts)


def severities(features: list[np.ndarray], toxic: np.ndarray, least: int = LEAST_TEXTS) -> np.ndarray:
    """Grades 0, 1, 2 from labels 0, 1."""
    flat = np.concatenate(features) if features else np.zeros(0, np.int64)
    row = np.repeat(np.arange(len(features)), [len(f) for f in features])
    found, place = np.unique(flat, return_inverse=True)
    bad = np.bincount(place, weights=toxic[row] > 0, minlength=len(found))
    good = np.bincount(place, minlength=len(found)) - bad
    share = lambda n, of: (n + 0.5) / (of + 1)
    marks = (bad >= least) & (share(bad, (toxic > 0).sum()) > MARKED * share(good, (toxic == 0).sum()))
    held = np.bincount(row, weights=marks[place], minlength=len(features))
    middle = np.median(held[toxic > 0]) if (toxic > 0).any() else 0
    return np.where(toxic > 0, 1 + (held > middle), 0)


def train(labelled: DataFrame, *, n_grades: int = GRADES, sample: int = SAMPLE, refine: bool = True, seed: int = 6) -> Model:
    """Fit on labelled(doc_id, text, grade): a bounded, seeded sample, dealt evenly to the grades, in one task.

    refine: grade is 0 or 1, and severities() makes three grades of it.

    Rows with a null text or grade teach nothing; without rows no word has a weight.
    """
    labelled = labelled.select("doc_id", "text", F.col("grade").cast("int").alias("grade")).filter("text is not null and grade is not null")
    sizes = {r["grade"]: r["n"] for r in labelled.groupBy("grade").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row a grade
    rate = F.coalesce(*[F.when(F.col("grade") == g, F.lit(sample / len(sizes) / n)) for g, n in sorted(sizes.items())], F.lit(0.0)) if sizes else F.lit(0.0)
    spread = F.pmod(F.xxhash64(F.lit(seed), "doc_id", "text"), F.lit(1_000_000_007)) / F.lit(1_000_000_007.0)
    rows = labelled.filter(spread < rate).mapInArrow(_features, f"doc_id {labelled.schema['doc_id'].dataType.simpleString()}, grade int, features array<long>")

    def one(frame):
        import pandas as pd

        frame = frame.sort_values("doc_id")
        features, grades = [np.asarray(f, dtype=np.int64) for f in frame["features"]], frame["grade"].to_numpy()
        model = fit(features, severities(features, grades) if refine else grades, n_grades)
        return pd.DataFrame({"vocabulary": [model.vocabulary.astype(np.int64).tobytes()], "weights": [model.weights.astype(float).tobytes()], "cuts": [model.cuts.astype(float).tobytes()]})

    fitted = rows.groupBy(F.lit(0).alias("all")).applyInPandas(one, "vocabulary binary, weights binary, cuts binary").collect()  # one row, of FEATURES weights at most
    if not fitted:
        return Model(np.zeros(0, np.int64), np.zeros(0), np.arange(n_grades - 1) + 1.0)
    return Model(np.frombuffer(fitted[0]["vocabulary"], np.int64), np.frombuffer(fitted[0]["weights"]), np.frombuffer(fitted[0]["cuts"]))


def grade(docs: DataFrame, model: Model) -> DataFrame:
    """docs with severity (expected grade, double), grade (int, how many thresholds are likelier passed than not) and toxic (grade over 0).

    Null and empty texts are scored on no words. Repeated rows are scored alike;
    other columns pass through; columns named as results are replaced.
    """
    own = docs.drop("severity", "grade", "toxic")
    sent = docs.sparkSession.sparkContext.broadcast(model)
    at = own.columns.index("text")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for batch in batches:
            h, bounds = words.hashed(batch.column(at), words.MARKS)
            h = h.view(np.int64)
            logit = np.zeros(batch.num_rows)
            if len(model.vocabulary) and len(h):
                k = np.minimum(np.searchsorted(model.vocabulary, h), len(model.vocabulary) - 1)
                hit = np.flatnonzero(model.vocabulary[k] == h)
                text = np.searchsorted(bounds, hit, side="right") - 1
                pairs = np.unique(text * len(model.vocabulary) + k[hit])  # a word counts once in a text
                logit = np.bincount(pairs // len(model.vocabulary), weights=model.weights[pairs % len(model.vocabulary)], minlength=batch.num_rows)
            passed = _sigmoid(logit[:, None] - model.cuts)
            level = (passed > 0.5).sum(axis=1)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(passed.sum(axis=1)), pa.array(level.astype(np.int32)), pa.array(level > 0)],
                [*batch.schema.names, "severity", "grade", "toxic"],
            )

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in own.schema)
    return own.mapInArrow(score, f"{fields}, severity double, grade int, toxic boolean")


def labelled_texts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs(doc_id, text) that have labels, with grade 0 or 1: of several labels of a document the worst."""
    worst = labels.filter("toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("grade")).withColumnRenamed("doc_id", "_labelled")
    return docs.select("doc_id", "text").join(F.broadcast(worst), F.col("doc_id") == F.col("_labelled")).drop("_labelled")


def sampled_labels(labels: DataFrame, sample: int = SAMPLE, seed: int = 5) -> DataFrame:
    """About 4 * sample labelled ids at most, so that they can be broadcast to the documents; toxic ones first, as they are rare."""
    n = {r["toxic"]: r["n"] for r in labels.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect() if r["toxic"] is not None}  # two rows
    spread = F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(1_000_000_007)) / F.lit(1_000_000_007.0)
    rate = F.coalesce(*[F.when(F.col("toxic") == k, F.lit(2 * sample / m)) for k, m in sorted(n.items())], F.lit(0.0)) if n else F.lit(0.0)
    return labels.filter(spread < rate)


def severity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Train on the labels and grade all docs."""
    return grade(docs, train(labelled_texts(docs, sampled_labels(labels.select("doc_id", "toxic")))))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    return severity(docs, common.table(spark, sf_dir, "labels")).select("doc_id", "severity", "grade", "toxic")
