"""Runs of a text: stretches of words that repeat with a period.

A suffix automaton of the words has a state for each set of end positions. The sets are merged
from long states to short ones, the smaller into the larger; two positions that become neighbours
in a state no shorter than their distance end two copies of one word sequence that touch, a
square, whose distance is a period. Each such seed is extended to both sides.

The automaton is built where a run can be at all: in a run of period q each word after the
first q ones has its equal at most q words before it, so only stretches of words with near equals
need one. What is left out holds no run, so the result is that of the whole text.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from . import common

#: A run has at least so many words, and so many periods.
LEAST, PERIODS = 6, 4
#: Words of texts that are looked at together.
TOGETHER = 100_000
RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def stretches(ids: np.ndarray, first: np.ndarray) -> list[tuple[int, int]]:
    """[begin, end) of the parts of texts that hold all their runs; ids: words of texts in a row, first: where the word's text begins.

    A run of period q in (2^(k-1), 2^k] has 3 q words or more, 5 at least, whose equal before is at most 2^k away.
    """
    n = len(ids)
    order = np.argsort(ids, kind="stable")
    before = np.full(n, -1, np.int64)
    again = ids[order[1:]] == ids[order[:-1]]
    before[order[1:][again]] = order[:-1][again]
    gap = np.where(before >= first, np.arange(n) - before, n + 1)
    marks = np.zeros(n + 1, np.int64)
    longest = int(np.bincount(first).max()) if n else 0
    for k in range(max(longest, 1).bit_length()):
        near = np.concatenate([[False], gap <= 1 << k, [False]])  # a text's first word has no equal before it, so no stretch spans two texts
        turns = np.flatnonzero(near[1:] != near[:-1])
        begin, end = turns[::2], turns[1::2]
        most = 1 << k
        enough = end - begin >= max(LEAST - most, (PERIODS - 1) * (most // 2 + 1))
        np.add.at(marks, np.maximum(begin[enough] - most, first[begin[enough]]), 1)
        np.add.at(marks, end[enough], -1)
    inside = np.concatenate([[False], np.cumsum(marks)[:-1] > 0, [False]])
    turns = np.flatnonzero(inside[1:] != inside[:-1])
    out = []
    for begin, end in zip(turns[::2].tolist(), turns[1::2].tolist(), strict=True):  # a part may hold ends of several texts
        cuts = [begin, *(np.flatnonzero(np.diff(first[begin:end])) + begin + 1).tolist(), end]
        out += zip(cuts[:-1], cuts[1:], strict=True)
    return out


def automaton(words: list[int]) -> tuple[list[int], list[int], list[int]]:
    """(suffix link, length, end position or -1 for states that were split off) of each state; state 0 is the start."""
    following: list[dict[int, int]] = [{}]
    link, length, end = [-1], [0], [-1]
    last = 0
    for i, word in enumerate(words):
        state, at = len(following), last
        following.append({})
        length.append(i + 1)
        end.append(i)
        while at >= 0 and word not in following[at]:
            following[at][word] = state
            at = link[at]
        if at < 0:
            link.append(0)
        else:
            met = following[at][word]
            if length[met] == length[at] + 1:
                link.append(met)
            else:
                split = len(following)
                following.append(following[met].copy())
                link += [split, link[met]]
                length.append(length[at] + 1)
                end.append(-1)
                while at >= 0 and following[at].get(word) == met:
                    following[at][word] = split
                    at = link[at]
                link[met] = split
        last = state
    return link, length, end


def seeds(words: list[int]) -> list[tuple[int, int]]:
    """(period, end) of squares, by merging end positions along suffix links; every run of LEAST words and PERIODS periods has one at its end.

    A run's last word and the one a period before become neighbours in the state of the run less a period,
    so states of fewer than LEAST - 1 words need no set, and distances above a third of the state's length no seed.
    """
    link, length, end = automaton(words)
    # positions are kept negated: as states get shorter, new positions mostly come first, and adding at the end of a list is cheap
    sets: list[list[int] | None] = [None if e < 0 else [-e] for e in end]
    found = set()
    for state in np.argsort(-np.array(length), kind="stable").tolist():
        to = link[state]
        if to < 0 or length[to] < LEAST - 1:
            continue
        own, other, size = sets[state], sets[to], length[to]
        sets[state] = None
        if other is None or len(own) > len(other):
            own, other = other or [], own
        sets[to] = other
        for x in own:
            at = bisect_left(other, x)
            if at:
                near = x - other[at - 1]
                if near * (PERIODS - 1) <= size and near + size >= LEAST:
                    found.add((near, -other[at - 1]))
            if at < len(other):
                near = other[at] - x
                if near * (PERIODS - 1) <= size and near + size >= LEAST:
                    found.add((near, -x))
            other.insert(at, x)
    return sorted(found)


def runs_of(words: list[int], begin: int = 0, end: int | None = None) -> list[tuple[int, int, int]]:
    """(start, length, smallest period) of the runs whose seeds lie in words[begin:end], extended over all words, in order of start and period."""
    best: dict[tuple[int, int], int] = {}
    period, done = 0, -1
    n = len(words)
    for q, at in seeds(words[begin:end]):
        at += begin
        if q != period:
            period, done = q, -1
        if at <= done:
            continue  # within the run of this period that was extended last
        low, high = at - q, at + 1
        while low > 0 and words[low - 1] == words[low - 1 + q]:
            low -= 1
        while high < n and words[high] == words[high - q]:
            high += 1
        done = high - 1
        if high - low >= max(LEAST, PERIODS * q):
            best[low, high] = min(q, best.get((low, high), q))  # a multiple of the period spans the same words
    return sorted((low, high - low, q) for (low, high), q in best.items())


def _found(texts: list[bytes | None]) -> tuple[list[int], list[list[tuple[int, int, int]]], list[bytes]]:
    """(numbers of words, runs, texts without what repeats) of some texts."""
    split = [(t or b"").split() for t in texts]  # bytes part at the six ASCII blanks
    sizes = np.array([len(w) for w in split], np.int64)
    starts = np.cumsum(sizes) - sizes
    known: dict[bytes, int] = {}
    ids = np.fromiter(map(known.setdefault, (w for words in split for w in words), count()), np.int64, int(sizes.sum()))
    first = np.repeat(starts, sizes)
    runs: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    parts: dict[int, list[tuple[int, int]]] = {}
    for begin, end in stretches(ids, first):
        text = int(np.searchsorted(starts, begin, "right")) - 1  # of texts without words that start there too, the last is the one with words
        parts.setdefault(text, []).append((begin - int(starts[text]), end - int(starts[text])))
    for text, spans in parts.items():
        words = ids[starts[text] : starts[text] + sizes[text]].tolist()
        runs[text] = sorted({r for begin, end in spans for r in runs_of(words, begin, end)})
    kept = []
    for words, own in zip(split, runs, strict=True):
        if own:
            drop = np.zeros(len(words) + 1, np.int64)
            for start, length, period in own:
                drop[start + period] += 1
                drop[start + length] -= 1
            words = [w for w, d in zip(words, np.cumsum(drop).tolist(), strict=False) if not d]
        kept.append(b" ".join(words))
    return sizes.tolist(), runs, kept


def _batch(keys: pa.Array, texts: list[bytes | None]) -> pa.RecordBatch:
    sizes, runs, kept = _found(texts)
    flat = [r for own in runs for r in own]
    columns = [pa.array([r[k] for r in flat], pa.int64()) for k in range(3)]
    offsets = np.cumsum([0, *map(len, runs)]).astype(np.int32)
    listed = pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays(columns, fields=list(RUN)))
    return pa.RecordBatch.from_arrays([keys, pa.array(sizes, pa.int64()), listed, pa.array(kept, pa.binary())], ["key", "n_words", "runs", "collapsed"])


def _search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys, column = batch.columns
        low, texts, held = 0, [], 0
        for at in range(len(column)):
            texts.append(column[at].as_py())
            held += len(texts[-1] or b"")
            if held >= 6 * TOGETHER:
                yield _batch(keys.slice(low, at + 1 - low), texts)
                low, texts, held = at + 1, [], 0
        if texts:
            yield _batch(keys.slice(low), texts)


def periodic_runs(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_words, runs: array of (start, length, period) by start and period, collapsed: the text without what repeats).

    Words are runs of anything but ASCII white space. A run is a stretch of at least 6 words and 4 times its smallest
    period that cannot go on; of its words the first period stays. Texts without a run give all their words, joined by
    one space. Null and empty texts have no words: no runs, an empty text. Rows that repeat, or share a key, are texts
    of their own; the key may be of any type and null. No rows: no rows. Other columns are not looked at.
    A text is searched in one task, whose memory grows with the stretches of the text that near-repeat, about 500 bytes a word.
    """
    kind = docs.schema[key].dataType
    schema = StructType([StructField("key", kind)]).simpleString()[len("struct<") : -1].replace(":", " ", 1)
    rows = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").cast("binary").alias("text"))
    found = rows.mapInArrow(_search, f"{schema}, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed binary")
    return found.select(F.col("key").alias(key), "n_words", "runs", F.col("collapsed").cast("string").alias("collapsed"))


def _edited(docs: DataFrame) -> DataFrame:
    """(doc_id, text) with every tenth document, by CRC-32 of its id, made to repeat from some word on, as the contract of op13 says."""
    h = F.crc32(F.col("doc_id").cast("string"))
    own = docs.select("doc_id", "text", h.alias("_h"), F.floor(h / 10).alias("_g"))
    own = own.withColumn("_words", F.when(F.col("_h") % 10 == 0, F.regexp_extract_all("text", F.lit(common.TOKEN), F.lit(0))))
    own = own.withColumn("_n", F.size("_words")).withColumn("_a", F.when(F.col("_n") > 0, F.col("_g") % F.col("_n")))
    own = own.withColumn("_p", 1 + F.floor((F.col("_n") - F.col("_a")) / (3 + F.col("_g") % 8)))
    whole = lambda c: c.cast("int")
    a, p, rest = F.col("_a"), F.col("_p"), F.col("_n") - F.col("_a")
    cycle = F.slice("_words", whole(a + 1), whole(p))
    tail = F.slice(F.flatten(F.array_repeat(cycle, whole(F.ceil(rest / p)))), F.lit(1), whole(rest))
    again = F.array_join(F.concat(F.slice("_words", F.lit(1), whole(a)), tail), " ")
    return own.select("doc_id", F.when(F.col("_n") > 0, again).otherwise(F.col("text")).alias("text"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of every document, with the most repetitive one, and digests of all runs and of the text without repeats.

    A null doc_id changes no text.
    """
    found = periodic_runs(_edited(common.table(spark, sf_dir, "documents")))
    none = F.lit(None).cast("struct<start:bigint,length:bigint,period:bigint>")
    best = F.aggregate("runs", none, lambda a, r: F.when(a.isNull() | (r["length"] * a["period"] > a["length"] * r["period"]), r).otherwise(a))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n"))), "")
    found = found.withColumn("_best", best)
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        *[F.col(f"_best.{c}").alias(c) for c in ("start", "length", "period")],
        F.expr("1000 * _best.length div _best.period").alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
