"""Language identification by nearest centroid over TF-IDF character n-grams.

Every language has several centroids, found by spherical k-means over a bounded
sample of its labelled texts; a text gets the language of the centroid with the
greatest cosine. Texts farther from that centroid than nearly all its own members
are marked as rejected.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Bins of the hashed n-grams of 1 to 3 characters.
BINS = 8192
#: Centroids of a language, and the share of its sample that its distance bound leaves outside.
CENTROIDS, OUTSIDE = 4, 0.01
#: The sample that centroids are fitted on: about so many texts of a language, and of all languages. Document frequencies come from all training texts.
SAMPLE_OF_LANGUAGE, SAMPLE = 600, 12_000
#: Characters of a text that are counted at once.
PART = 1_000_000


@dataclass
class Model:
    languages: list[str]
    idf: np.ndarray
    centroids: np.ndarray
    bounds: np.ndarray


@cache
def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() if not 0xD800 <= c < 0xE000 else False for c in range(0x110000)), dtype=bool, count=0x110000)


def profile(text: str | None) -> np.ndarray | None:
    """Counts of hashed n-grams; all that are not letters count as one space. None without letters."""
    counts, any_letter, tail = np.zeros(BINS, np.float32), False, np.zeros(0, np.uint64)
    lowered = (text or "").lower()
    for low in range(0, len(lowered), PART):
        codes = np.frombuffer(lowered[low : low + PART].encode("utf-32-le", "replace"), dtype=np.uint32).astype(np.uint64)
        letter = _letters()[codes]
        any_letter = any_letter or bool(letter.any())
        codes = np.where(letter, codes, np.uint64(32))
        codes = codes[np.append(True, (codes[1:] != 32) | (codes[:-1] != 32))]
        codes = np.concatenate([tail if low else np.full(1, 32, np.uint64), codes])
        two = codes[:-1] * np.uint64(0x1000003) + codes[1:]
        three = two[:-1] * np.uint64(0x1000003) + codes[2:]
        for k, grams in enumerate((codes, two, three)):
            spread = (grams + np.uint64(k)) * np.uint64(0x9E3779B97F4A7C15)
            counts += np.bincount((spread >> np.uint64(64 - 13)).astype(np.int64), minlength=BINS)
        tail = codes[-2:]
    return counts if any_letter else None


def _unit(rows: np.ndarray) -> np.ndarray:
    norms = np.linalg.norm(rows, axis=1, keepdims=True)
    return rows / np.where(norms > 0, norms, 1)


def _vectors(profiles: list[np.ndarray], idf: np.ndarray) -> np.ndarray:
    return _unit(np.sqrt(np.stack(profiles)) * idf)


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    df, n = np.zeros(BINS, np.int64), 0
    for batch in batches:
        for text in batch.column(0):
            if (counts := profile(text.as_py())) is not None:
                df += counts > 0
                n += 1
    bins = np.append(np.flatnonzero(df), -1)
    yield pa.RecordBatch.from_arrays([pa.array(bins), pa.array(np.append(df[df > 0], n))], ["bin", "n"])


def _cluster(idf: np.ndarray, centroids: int, outside: float):
    def fit(frame):
        import pandas as pd

        frame = frame.sort_values(["order", "text"])
        profiles = [p for p in map(profile, frame["text"]) if p is not None]
        if not profiles:
            return pd.DataFrame({"lang": [], "centroid": [], "bound": []})
        rows = _vectors(profiles, idf)
        centres = rows.mean(axis=0, keepdims=True)
        while len(centres) < min(centroids, len(rows)):  # the text farthest from all centres so far
            centres = np.vstack([centres, rows[np.argmin((rows @ _unit(centres).T).max(axis=1))]])
        for _ in range(10):
            centres = _unit(centres)
            nearest = (rows @ centres.T).argmax(axis=1)
            centres = np.stack([rows[nearest == k].mean(axis=0) if (nearest == k).any() else centres[k] for k in range(len(centres))])
        centres = _unit(centres)
        near = rows @ centres.T
        bounds = [np.quantile(near[nearest == k, k], outside) if (nearest == k).any() else 0.0 for k in range(len(centres))]
        return pd.DataFrame({"lang": frame["lang"].iloc[0], "centroid": [c.astype(np.float32).tobytes() for c in centres], "bound": np.array(bounds, float)})

    return fit


def train(labelled: DataFrame, *, per_language: int = SAMPLE_OF_LANGUAGE, total: int = SAMPLE, centroids: int = CENTROIDS, seed: int = 9) -> Model:
    """Fit on labelled(doc_id, text, lang); rows without text or lang teach nothing. No rows: a model that knows no language."""
    labelled = labelled.select("doc_id", "text", "lang").filter("text is not null and lang is not null")
    found = labelled.select("text").mapInArrow(_frequencies, "bin long, n long").groupBy("bin").agg(F.sum("n").alias("n")).collect()  # BINS + 1 rows at most
    df, n = np.zeros(BINS), 0
    for row in found:
        if row["bin"] < 0:
            n = row["n"]
        else:
            df[row["bin"]] = row["n"]
    idf = (np.log((1 + n) / (1 + df)) + 1).astype(np.float32)

    sizes = common.stage(labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("_n")), "sizes")  # a row a language
    languages = max(sizes.count(), 1)
    bound = min(per_language, max(total // languages, 1))
    order = F.pmod(F.xxhash64(F.lit(seed), "doc_id", "text"), F.lit(1_000_000_007))
    sample = labelled.withColumn("order", order).join(F.broadcast(sizes), "lang").filter(F.col("order") < F.lit(1_000_000_007.0) * bound / F.col("_n"))
    rows = sample.select("lang", "text", "order").groupBy("lang").applyInPandas(_cluster(idf, centroids, OUTSIDE), "lang string, centroid binary, bound double").collect()  # a few rows a language
    rows.sort(key=lambda r: (r["lang"].encode(), r["centroid"]))
    matrix = np.stack([np.frombuffer(r["centroid"], np.float32) for r in rows]) if rows else np.zeros((0, BINS), np.float32)
    return Model([r["lang"] for r in rows], idf, matrix, np.array([r["bound"] for r in rows]))


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """docs with lang_pred, score (cosine, 0 to 1) and rejected (nearer to no centroid than its members are).

    A null text, or one without letters, is und with score 0. Repeated rows are
    scored alike; other columns pass through; columns named as results are replaced.
    """
    own = docs.drop("lang_pred", "score", "rejected")
    sent = docs.sparkSession.sparkContext.broadcast(model)
    at = own.columns.index("text")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for batch in batches:
            langs, scores, out = ["und"] * batch.num_rows, np.zeros(batch.num_rows), np.zeros(batch.num_rows, bool)
            texts = batch.column(at)
            for low in range(0, batch.num_rows, 256):
                part = [(i, p) for i in range(low, min(low + 256, batch.num_rows)) if (p := profile(texts[i].as_py())) is not None]
                if not part or not model.languages:
                    continue
                near = _vectors([p for _, p in part], model.idf) @ model.centroids.T
                best = near.argmax(axis=1)
                for (i, _), k, row in zip(part, best.tolist(), near, strict=True):
                    langs[i], scores[i], out[i] = model.languages[k], min(max(float(row[k]), 0.0), 1.0), row[k] < model.bounds[k]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(langs), pa.array(scores), pa.array(out)], [*batch.schema.names, "lang_pred", "score", "rejected"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in own.schema)
    return own.mapInArrow(score, f"{fields}, lang_pred string, score double, rejected boolean")


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    docs = docs.withColumn("held_out", held_out)
    model = train(docs.filter("not held_out"))
    return identify(docs.select("doc_id", "held_out", "text"), model).select("doc_id", "held_out", "lang_pred", "score", "rejected")
