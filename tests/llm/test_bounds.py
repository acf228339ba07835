"""Results beyond every bound of what is broadcast are those within."""

from __future__ import annotations

import pytest

from windrow.llm import decontaminate, digest, jaccard, linking, queries

SF = "/root/testdata/sf0.001"
BOUNDS = [(decontaminate, "BROADCAST_WINDOWS"), (decontaminate, "BROADCAST_HITS"), (digest, "BROADCAST_BUCKETS"), (jaccard, "BROADCAST_IDS"), (linking, "ONE_PARTITION"), (linking, "BROADCAST_LABELS")]


@pytest.mark.parametrize("name", ["op2_decontamination", "op4_canonical_digest", "op5_ngram_jaccard"])
def test_without_broadcasts(spark, monkeypatch, name):
    run = lambda: sorted(map(str, queries.queries()[name](spark, SF).collect()))
    want = run()
    for module, bound in BOUNDS:
        monkeypatch.setattr(module, bound, 0)
    assert run() == want and want
