"""Keys of the Jaccard join: few for a long set, and one in common for every linked pair."""

from __future__ import annotations

import numpy as np
import pytest

from windrow.llm import jaccard


def keys_of(tokens, df, percent):
    tokens = np.array(sorted(tokens), np.uint64)
    order = np.lexsort((tokens, df(tokens)))
    return dict(zip(*(x.tolist() for x in jaccard._keys(len(tokens), percent, df(tokens)[order], tokens[order]))))


@pytest.mark.parametrize("percent", [80, 85])
@pytest.mark.parametrize("n", [20, 500, 2_000, 20_000, 100_000])
def test_keys_of_a_long_set_are_few(n, percent):
    tokens = np.random.default_rng(n).integers(0, 1 << 62, n)
    made = keys_of(tokens, lambda t: np.full(len(t), 100), percent)
    assert len(made) <= 3 * n


@pytest.mark.parametrize("percent", [50, 80, 85])
def test_linked_sets_share_a_key_that_leaves_their_overlap(percent):
    rng, tried = np.random.default_rng(percent), 0
    for _ in range(600):
        n = int(2 ** rng.uniform(2, 12.5))
        a = set(rng.integers(0, 1 << 62, n).tolist())
        gone = int(rng.integers(0, n * (100 - percent) // 100 + 1))
        added = int(rng.integers(0, n * (100 - percent) // 100 + 1))
        b = set(sorted(a)[gone:] if rng.random() < 0.5 else rng.permutation(sorted(a))[gone:].tolist()) | set(rng.integers(0, 1 << 62, added).tolist())
        both = len(a & b)
        if 100 * both < percent * len(a | b):
            continue
        tried += 1
        often = float(rng.random())
        df = lambda t: np.where((t % np.uint64(1000)) < 1000 * often, 100 + (t % np.uint64(7)).astype(int), 2)  # noqa: E731, B023
        x, y = keys_of(a, df, percent), keys_of(b, df, percent)
        assert max((min(x[k], y[k]) for k in x.keys() & y.keys()), default=0) >= both
    assert tried > 200


def test_near_copies_of_a_long_text(spark):
    rng = np.random.default_rng(5)
    words = [f"w{i}" for i in rng.integers(0, 5_000, 20_000)]
    rows = []
    for k in range(70):
        mine = list(words)
        for at in rng.integers(0, len(mine), 100):
            mine[at] = f"x{k}"
        rows.append((k, " ".join(mine)))
    rows += [(100 + k, " ".join(f"v{i}" for i in rng.integers(0, 5_000, 20_000))) for k in range(5)]
    got = {r["doc_id"]: r["component_id"] for r in jaccard.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {k: 0 if k < 70 else k for k, _ in rows}
