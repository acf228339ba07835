"""Periodic runs against all periods tried in turn, and on edges."""

from __future__ import annotations

import hashlib
from zlib import crc32

import numpy as np
from pyspark.sql import functions as F

from windrow.llm import runs

SF = "/root/testdata/sf0.001"


def by_force(w):
    """(start, length, smallest period) of all runs, each period tried at each place."""
    n, found = len(w), {}
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            if j > i and j - i + q >= max(6, 4 * q):
                found[i, j - i + q] = min(q, found.get((i, j - i + q), q))
            i = max(j, i + 1)
    return sorted((s, length, q) for (s, length), q in found.items())


def edited(i, text):
    w = (text or "").encode().split()
    h = crc32(str(i).encode())
    g, n = h // 10, len(w)
    if i is not None and h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[k] if k < a else w[a + (k - a) % p] for k in range(n)]
    return w


def row(i, text):
    w = edited(i, text)
    found = by_force(w)
    gone = {k for s, length, q in found for k in range(s + q, s + length)}
    best = (None,) * 4
    for s, length, q in found:
        if best[0] is None or length * best[2] > best[1] * q:
            best = (s, length, q, 1000 * length // q)
    sha = lambda b: hashlib.sha256(b).hexdigest()
    return (i, len(found), *best, sha("".join(f"{s},{length},{q}\n" for s, length, q in found).encode()), sha(b" ".join(x for k, x in enumerate(w) if k not in gone)))


def test_all_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    got = sorted(tuple(r) for r in runs.op13_periodic_runs(spark, SF).collect())
    assert got == sorted(row(r["doc_id"], r["text"]) for r in docs) and sum(r[1] for r in got) > 5


def test_random_words():
    rng = np.random.default_rng(0)
    for _ in range(400):
        texts = []
        for _ in range(rng.integers(1, 5)):
            n, p = int(rng.integers(0, 70)), int(rng.integers(1, 9))
            w = rng.integers(0, rng.integers(1, 5), n).tolist()
            a = int(rng.integers(0, n + 1))
            texts.append([w[k] if k < a else w[min(a + (k - a) % p, n - 1)] for k in range(n)])
        _, found, _ = runs._found([" ".join(map(str, w)).encode() for w in texts])
        assert found == [by_force(w) for w in texts]


def test_edges(spark, tmp_path):
    long = "a b " * 60_000
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "x x x x x"), (5, "x x " * 6), (5, "x x x x x x"), (None, "la " * 8), (7, long), (8, "é é é é é é e"), (9, "\x1c \x1c \x1c \x1c \x1c \x1c")]
    spark.createDataFrame([(i, t, 1, "k") for i, t in rows], "doc_id long, text string, n_runs int, key string").write.parquet(f"{tmp_path}/documents.parquet")
    got = runs.op13_periodic_runs(spark, str(tmp_path)).collect()
    want = [row(i, t) for i, t in rows if i != 7]
    assert sorted((tuple(r) for r in got if r["doc_id"] != 7), key=str) == sorted(want, key=str)
    (big,) = [r for r in got if r["doc_id"] == 7]
    assert (big["n_runs"], big["start"], big["length"], big["period"]) == (1, 0, 120_000, 2)


def test_general_interface(spark):
    df = spark.createDataFrame([("k1", "go go go go go go on"), (None, None)], "name string, runs string").withColumn("n_words", F.lit("clash"))
    out = {r["name"]: r for r in runs.periodic_runs(df, "name", "runs").collect()}
    assert out["k1"]["collapsed"] == "go on" and [tuple(r) for r in out["k1"]["runs"]] == [(0, 6, 1)] and out["k1"]["n_words"] == 7
    assert out[None]["runs"] == [] and out[None]["collapsed"] == ""
    assert runs.periodic_runs(df.limit(0), "name", "runs").collect() == []
