"""Language-model scoring with a hierarchical Pitman-Yor model.

Every word is a context with a restaurant of its own, whose customers are the words that
follow it. All context restaurants share a parent, whose customers are their tables and
whose base is uniform over the known words and one unknown. Tables are
sampled by Gibbs (see seating): the cells of a restaurant (the customers of one word in one context) move in
turn, given the tables of the others and the parent's predictive probabilities; cells of one customer
have one table. Predictive probabilities are averaged over the sweeps after the burn-in.

Tokens are dealt to buckets by context (frequent contexts by context and word, in shards), as packed
arrays: once to count the cells, once to score each token in the bucket of its cell. The
HEAD most frequent words are numbers in these arrays, and are what the driver holds; all
other words are their hashes, and take part as contexts and as customers alike. Only in the parent
are they not told apart by their tables: there each has customers in proportion to its
count, and where it is seated in a context the mean probability of such words.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common, seating, words

#: Words that are numbers, known to the driver and to every task; the counts of rarer words are joined by shuffle.
HEAD = 1 << 18
SWEEPS, BURN_IN, STRENGTH = 6, 3, 1.0
#: Tokens of a bucket, about; a slice of texts that is packed at once has so many bytes.
BUCKET_TOKENS, SLICE_BYTES = 2_000_000, 4_000_000
#: Buckets of a small corpus, so that it is dealt to many tasks as well.
LEAST_BUCKETS = 32
#: A context with more than this part of all tokens is dealt to several buckets.
SHARDS = 4096
#: The end of a text, as a word; no hash of a word is 0 but by chance of 2^-64.
END = 0
#: Marks the hashes of words outside the head among the numbers of those in it.
TAIL = np.uint64(1 << 63)


@dataclass
class Head:
    """Hashes (rising) and counts of the most frequent words, shards of each as a context, and the number of buckets."""

    hashes: np.ndarray
    counts: np.ndarray
    shards: np.ndarray
    buckets: int

    def codes(self, h: np.ndarray) -> np.ndarray:
        """Numbers of head words, negative hashes of others."""
        at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        return np.where(self.hashes[at] == h, at, (h | TAIL).view(np.int64))

    def bucket(self, u: np.ndarray, w: np.ndarray) -> np.ndarray:
        shards = np.where(u >= 0, self.shards[np.maximum(u, 0)], 1).astype(np.uint64)
        shard = words.mix(w.view(np.uint64)) % shards
        return (words.mix(u.view(np.uint64) * words.GRAM[0] + shard * words.GRAM[1]) % np.uint64(self.buckets)).astype(np.int64)


@dataclass
class Model:
    """seats: contexts whose tables were sampled, with mean tables a cell and the context's in each sample. parents[s]: the parent's
    probabilities of head words; tail[s]: (customers of the parent outside the head, customers, mass of a new table) in sample s."""

    head: Head
    seats: DataFrame
    counts: DataFrame
    texts: DataFrame
    parents: np.ndarray
    tail: np.ndarray
    discount: float
    root_discount: float
    tokens: int
    types: int
    tail_tokens: int
    tail_types: int

    def tail_mean(self, sample: int) -> float:
        """The parent's mean probability of a known word outside the head."""
        inside, customers, new = self.tail[sample]
        return max((inside - self.root_discount * self.tail_types) / (STRENGTH + customers) / max(self.tail_types, 1), 0.0) + new / (self.types + 1)


def _tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes with END after each text, and where each text starts."""
    h, bounds = words.hashed(texts)
    return np.insert(h, bounds[1:], np.uint64(END)), bounds + np.arange(len(bounds))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in _slices(batch, 0):
            found, n = np.unique(_tokens(part.column(0))[0], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(n)], ["word", "n"])


def _slices(batch: pa.RecordBatch, at: int) -> Iterator[pa.RecordBatch]:
    """Rows whose texts have about SLICE_BYTES together; a longer text is alone."""
    sizes = pc.fill_null(pc.binary_length(batch.column(at)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    part = np.cumsum(sizes) // SLICE_BYTES
    edges = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
    for low, high in zip(edges[:-1], edges[1:], strict=True):
        if high > low:
            yield batch.slice(low, high - low)


def _pairs(head: Head, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(context, word, where each text starts); before a text stands an end."""
    h, bounds = _tokens(texts)
    w = head.codes(h)
    u = np.empty_like(w)
    u[1:] = w[:-1]
    u[bounds[:-1]] = head.codes(np.array([END], np.uint64))[0]
    return u, w, bounds


def _lists(values: np.ndarray, ends: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.append(0, ends).astype(np.int32)), pa.array(values, kind))


PACKED = "bucket int, kind int, u array<long>, size array<int>, w array<long>, n array<int>, docs array<long>, flags array<int>, t array<double>"


def _packed(bucket: np.ndarray, u: np.ndarray, w: np.ndarray, n: np.ndarray, docs: np.ndarray, flags: np.ndarray) -> pa.RecordBatch:
    """A row a bucket; u, w and n are in order of bucket and context."""
    ends = np.append(np.flatnonzero(np.diff(bucket)) + 1, len(bucket))
    fresh = np.append(True, (u[1:] != u[:-1]) | (bucket[1:] != bucket[:-1]))
    first = np.flatnonzero(fresh)
    of_u = np.searchsorted(first, ends)
    k = len(ends)
    none = pa.ListArray.from_arrays(pa.array(np.zeros(k + 1, np.int32)), pa.array([], pa.float64()))
    return pa.RecordBatch.from_arrays(
        [
            pa.array(bucket[ends - 1].astype(np.int32)), pa.array(np.zeros(k, np.int32)), _lists(u[first], of_u, pa.int64()), _lists(np.diff(np.append(first, len(u))).astype(np.int32), of_u, pa.int32()), _lists(w, ends, pa.int64()), _lists(n.astype(np.int32), ends, pa.int32()),
            _lists(np.tile(docs, k), np.arange(1, k + 1) * len(docs), pa.int64()), _lists(np.tile(flags, k).astype(np.int32), np.arange(1, k + 1) * len(flags), pa.int32()), none,
        ],
        ["bucket", "kind", "u", "size", "w", "n", "docs", "flags", "t"],
    )


def _order(bucket: np.ndarray, u: np.ndarray, w: np.ndarray) -> np.ndarray:
    """By bucket, context and word, the latter two by parts of their hashes."""
    hu, hw = words.mix(u.view(np.uint64)), words.mix(w.view(np.uint64))
    return np.argsort((bucket.astype(np.uint64) << np.uint64(48)) ^ ((hu >> np.uint64(40)) << np.uint64(24)) ^ (hw >> np.uint64(40)))


def _cells(sent):
    """Texts to packed cells with their counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head = sent.value
        for batch in batches:
            for part in _slices(batch, 0):
                u, w, _ = _pairs(head, part.column(0))
                bucket = head.bucket(u, w)
                by = _order(bucket, u, w)
                u, w, bucket = u[by], w[by], bucket[by]
                first = np.flatnonzero(np.append(True, (u[1:] != u[:-1]) | (w[1:] != w[:-1])))
                n = np.diff(np.append(first, len(u)))
                yield _packed(bucket[first], u[first], w[first], n, np.zeros(0, np.int64), np.zeros(0, np.int64))

    return run


def _unpacked(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(context, word, n) of all rows of a bucket."""
    flat = lambda c: np.concatenate([np.zeros(0, np.int64), *(x.flatten().to_numpy() for x in table.column(c).chunks)])
    return np.repeat(flat("u"), flat("size")).astype(np.int64), flat("w").astype(np.int64), flat("n").astype(np.int64)


def _groups(u: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order by context and word, where cells start in it, where contexts start among the cells)."""
    by = np.lexsort((w, u))
    u, w = u[by], w[by]
    new_u = np.append(True, u[1:] != u[:-1])
    cell = np.flatnonzero(new_u | np.append(True, w[1:] != w[:-1]))
    return by, cell, np.flatnonzero(new_u[cell])


COUNTED = "bucket int, kind int, u long, fixed long, w array<long>, c array<long>"


def _counted(sent):
    """A bucket's cells: of every context with cells of several customers these (kind 0); cells of one customer by head word (kind 1); totals (kind 2)."""

    def run(table: pa.Table) -> pa.Table:
        head = sent.value
        bucket = table.column("bucket")[0].as_py()
        u, w, n = _unpacked(table)
        by, cell, context = _groups(u, w)
        c = np.add.reduceat(n[by], cell)
        u, w = u[by][cell], w[by][cell]
        once = c == 1
        fixed = np.add.reduceat(once.astype(np.int64), context)
        of = np.repeat(np.arange(len(context)), np.diff(np.append(context, len(c))))
        several = np.bincount(of[~once], minlength=len(context))
        own = u[context]
        kept = np.flatnonzero((several > 0) | ((own >= 0) & (head.shards[np.maximum(own, 0)] > 1)))
        ends = np.cumsum(several[kept])
        tables = np.bincount(w[once & (w >= 0)], minlength=1)
        found = np.flatnonzero(tables)
        totals = np.array([(c == 1).sum(), (c == 2).sum(), (once & (w < 0)).sum()], np.int64)
        k = len(kept)
        return pa.table(
            {
                "bucket": pa.array(np.full(k + 2, bucket), pa.int32()), "kind": pa.array([0] * k + [1, 2], pa.int32()), "u": pa.array(np.append(own[kept], [0, 0])), "fixed": pa.array(np.append(fixed[kept], [0, 0])),
                "w": _lists(np.concatenate([w[~once], found]), np.append(ends, [(ends[-1] if k else 0) + len(found)] * 2), pa.int64()),
                "c": _lists(np.concatenate([c[~once], tables[found], totals]), np.append(ends, [(ends[-1] if k else 0) + len(found), (ends[-1] if k else 0) + len(found) + len(totals)]), pa.int64()),
            }
        )

    return run


SEATS = "bucket int, u long, fixed long, w array<long>, c array<long>, t array<long>, mean array<double>, totals array<double>"


def _sweep(sent, discount: float, seed: int, kept: int):
    """Move the cells of every context once. kept: samples kept so far, this one included, or 0: this one is not kept."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parent, tail, shared = sent.value
        for number, batch in enumerate(batches):
            lists = {name: batch.column(name) for name in ("w", "c", "t", "mean", "totals")}
            sizes = np.diff(lists["w"].offsets.to_numpy())
            w, c, t, mean = (lists[name].flatten().to_numpy() for name in ("w", "c", "t", "mean"))
            first = np.append(0, np.cumsum(sizes))
            fixed, u = batch.column("fixed").to_numpy().astype(float), batch.column("u").to_numpy()
            own = np.bincount(np.repeat(np.arange(len(sizes)), sizes), weights=t, minlength=len(sizes))
            elsewhere = np.zeros(len(u))
            split = np.flatnonzero(np.isin(u, list(shared)))
            elsewhere[split] = np.array([shared[x] for x in u[split].tolist()]) - fixed[split] - own[split] if len(split) else 0.0
            p = np.where(w >= 0, parent[np.maximum(w, 0)], tail)
            rng = np.random.default_rng([seed, int(batch.column("bucket")[0].as_py()) if batch.num_rows else 0, number])
            t = seating.sweep(first, c, t, fixed + elsewhere, p, STRENGTH, discount, rng) if len(c) else t
            mean = mean + (t - mean) / kept if kept else mean
            total = fixed + np.bincount(np.repeat(np.arange(len(sizes)), sizes), weights=t, minlength=len(sizes))
            before = lists["totals"].flatten().to_numpy().reshape(len(sizes), -1) if len(sizes) else np.zeros((0, max(kept - 1, 0)))
            totals = np.column_stack([before, total]) if kept else before
            width = totals.shape[1]
            ends = np.cumsum(sizes)
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], _lists(t, ends, pa.int64()), _lists(mean, ends, pa.float64()), _lists(totals.ravel(), np.arange(1, len(sizes) + 1) * width, pa.float64())], ["bucket", "u", "fixed", "w", "c", "t", "mean", "totals"])

    return run


def _discount(ones: float, twos: float) -> float:
    """The usual estimate from cells of one and of two customers, kept off the ends."""
    return min(max(ones / (ones + 2 * twos), 0.05), 0.95) if ones + twos else 0.5


def _head(counts: DataFrame, by_count: DataFrame, head: int, tokens: int, bucket_tokens: int, shards: int) -> Head:
    down = Window.orderBy(F.desc("n")).rowsBetween(Window.unboundedPreceding, 0)
    least = by_count.withColumn("upto", F.sum("types").over(down)).filter(F.col("upto") <= head).agg(F.min("n")).first()[0]
    top = counts.filter((F.col("n") >= (least if least is not None else 1 << 62)) | (F.col("word") == END)).toArrow()  # head + 1 rows at most
    hashes, n = top.column("word").to_numpy().view(np.uint64), top.column("n").to_numpy()
    if not len(hashes):
        hashes, n = np.array([END], np.uint64), np.zeros(1, np.int64)
    by = np.argsort(hashes)
    part = max(tokens / shards, 1000)
    return Head(hashes[by], n[by], np.ceil(np.maximum(n[by], 1) / part).astype(np.int64), max(LEAST_BUCKETS, -(-tokens // bucket_tokens)))


def train(texts: DataFrame, *, head: int = HEAD, sweeps: int = SWEEPS, burn_in: int = BURN_IN, seed: int = 1, bucket_tokens: int = BUCKET_TOKENS, shards: int = SHARDS) -> Model:
    """Seat the words of texts(text); null texts are empty, and their end is seated.

    The driver gets the head's counts and tables, and the tables of contexts
    in shards, all of fixed size.
    """
    spark, read = texts.sparkSession, texts.select("text")
    with common.scratch(spark):
        counts = common.stage(read.mapInArrow(_count, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")), "counts", keep=True)
        by_count = common.stage(counts.groupBy("n").agg(F.count(F.lit(1)).alias("types")), "by_count")
        total = by_count.agg(F.sum(F.col("n") * F.col("types")), F.sum("types"), F.sum(F.when(F.col("n") == 1, F.col("types"))), F.sum(F.when(F.col("n") == 2, F.col("types")))).first()
        tokens, types, ones, twos = (x or 0 for x in total)
        top = _head(counts, by_count, head, tokens, bucket_tokens, shards)
        tail_tokens, tail_types = tokens - int(top.counts.sum()), types - int((top.counts > 0).sum())
        sent = spark.sparkContext.broadcast(top)
        cells = read.mapInArrow(_cells(sent), PACKED).groupBy("bucket").applyInArrow(_counted(sent), COUNTED)
        cells = common.stage(cells, "cells")

        once, width = np.zeros(len(top.hashes)), len(top.hashes)
        rows = cells.filter("kind = 1").select(F.explode(F.arrays_zip("w", "c")).alias("x")).groupBy("x.w").agg(F.sum("x.c").alias("n")).toArrow()  # head rows at most
        once[rows.column("w").to_numpy()] = rows.column("n").to_numpy()
        sums = cells.filter("kind = 2").select(*[F.sum(F.col("c")[k]) for k in range(3)]).first()
        discount, root_discount = _discount(sums[0] or 0, sums[1] or 0), _discount(ones, twos)
        ones_of_tail = float(sums[2] or 0)
        seats = cells.filter("kind = 0").select("bucket", "u", "fixed", "w", "c", F.transform("c", lambda _: F.lit(1).cast("long")).alias("t"), F.transform("c", lambda _: F.lit(0.0)).alias("mean"), F.array().cast("array<double>").alias("totals"))
        seats = common.stage(seats, "seats")
        split = np.flatnonzero(top.shards > 1).tolist()  # SHARDS contexts at most

        def shared(seats: DataFrame) -> dict[int, float]:
            own = seats.filter(F.col("u").isin(split)) if len(split) < 1000 else seats.join(F.broadcast(spark.createDataFrame([(x,) for x in split], "u long")), "u", "left_semi")
            tables = F.col("fixed") + F.aggregate("t", F.lit(0).cast("long"), lambda a, x: a + x)
            return {r["u"]: float(r["t"]) for r in own.groupBy("u").agg(F.sum(tables).alias("t")).collect()} if split else {}

        parent, tail, of_split = np.full(width, 1 / (types + 1)), 1 / (types + 1), shared(seats)
        rng = np.random.default_rng(seed)
        root = np.ones(width, np.int64)
        parents, tails, kept, sample_shared = [], [], 0, []
        for turn in range(sweeps):
            kept += turn >= burn_in
            state = spark.sparkContext.broadcast((parent, tail, of_split))
            seats = common.stage(seats.mapInArrow(_sweep(state, discount, seed * 1000 + turn, kept), SEATS), "seats", keep=turn == sweeps - 1)
            opened = seats.select(F.explode(F.arrays_zip("w", "t")).alias("x")).groupBy(F.greatest(F.col("x.w"), F.lit(-1).cast("long")).alias("w")).agg(F.sum("x.t").alias("t")).toArrow()  # head + 1 rows at most
            customers, inside = once.copy(), ones_of_tail
            at, n = opened.column("w").to_numpy(), opened.column("t").to_numpy()
            customers[at[at >= 0]] += n[at >= 0]
            inside += float(n[at < 0].sum())
            of_split = shared(seats)
            there = np.flatnonzero(customers)
            root[there] = seating.sweep(np.array([0, len(there)]), customers[there].astype(np.int64), np.minimum(root[there], customers[there].astype(np.int64)), np.array([float(tail_types)]), np.full(len(there), 1 / (types + 1)), STRENGTH, root_discount, rng) if len(there) else root[there]
            total = customers.sum() + inside
            new = (STRENGTH + root_discount * (root[there].sum() + tail_types)) / (STRENGTH + total)
            parent = np.maximum(customers - root_discount * np.where(customers > 0, root, 0), 0) / (STRENGTH + total) + new / (types + 1)
            tail = max((inside - root_discount * tail_types) / (STRENGTH + total) / max(tail_types, 1), 0.0) + new / (types + 1)
            if turn >= burn_in:
                parents.append(parent)
                tails.append((inside, total, new))
                sample_shared.append(of_split)
        if split:  # all shards of a context know its tables as a whole
            rows = spark.createDataFrame([(u, [s[u] for s in sample_shared]) for u in split if all(u in s for s in sample_shared)], "u long, whole array<double>")
            seats = common.stage(seats.join(F.broadcast(rows), "u", "left").withColumn("totals", F.coalesce("whole", "totals")).drop("whole").select("bucket", "u", "fixed", "w", "c", "t", "mean", "totals"), "seats", keep=True)
    return Model(top, seats, counts, texts, np.stack(parents), np.array(tails), discount, root_discount, tokens, types, tail_tokens, tail_types)


def _scored_tokens(sent):
    """(text, _doc, learnt, scored) to packed tokens: n is the place of a text in docs, flags say whether it is learnt (1) and scored (2)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head = sent.value
        for batch in batches:
            for part in _slices(batch, 0):
                u, w, bounds = _pairs(head, part.column(0))
                doc = np.repeat(np.arange(part.num_rows), np.diff(bounds))
                bucket = head.bucket(u, w)
                by = _order(bucket, u, w)
                yield _packed(bucket[by], u[by], w[by], doc[by], part.column(1).to_numpy(), part.column(2).to_numpy())

    return run


PARTS = "_doc long, score double, open array<long>"


def _bucket_scores(sent):
    """log10 probabilities of a bucket's tokens, summed by text. Words outside the head that are new in their context stay open: the parent's probability of them is looked up."""

    def run(table: pa.Table) -> pa.Table:
        head, parents, tails, discount = sent.value
        kind = table.column("kind").to_numpy()
        tokens, seats = table.filter(pa.array(kind == 0)), table.filter(pa.array(kind == 1))
        if not tokens.num_rows:
            return pa.table({"_doc": pa.array([], pa.int64()), "score": pa.array([], pa.float64()), "open": pa.array([], pa.list_(pa.int64()))})
        lengths = np.concatenate([np.diff(x.offsets.to_numpy()) for x in tokens.column("docs").chunks])
        of_row = np.concatenate([np.diff(x.offsets.to_numpy()) for x in tokens.column("w").chunks])
        flat = lambda t, c: np.concatenate([x.flatten().to_numpy() for x in t.column(c).chunks]) if t.num_rows else np.zeros(0)
        docs, flags = flat(tokens, "docs").astype(np.int64), flat(tokens, "flags").astype(np.int64)
        u, w, doc = _unpacked(tokens)
        doc = doc + np.repeat(np.cumsum(lengths) - lengths, of_row)
        by, cell, context = _groups(u, w)
        u, w, doc = u[by], w[by], doc[by]
        sizes = np.diff(np.append(cell, len(u)))
        c = np.add.reduceat(flags[doc] & 1, cell)
        own, cw = u[cell][context], w[cell]
        of = np.repeat(np.arange(len(context)), np.diff(np.append(context, len(cell))))
        customers = np.bincount(of, weights=c, minlength=len(context))
        customers = np.where(own >= 0, head.counts[np.maximum(own, 0)], customers)
        samples = len(parents)
        tables = np.repeat(np.bincount(of, weights=c == 1, minlength=len(context))[None], samples, axis=0)
        t = (c > 0).astype(float)
        if seats.num_rows:
            su = flat(seats, "u").astype(np.int64)
            totals = flat(seats, "t").reshape(-1, samples) if samples else np.zeros((len(su), 0))
            n = np.concatenate([np.diff(x.offsets.to_numpy()) for x in seats.column("w").chunks])
            at = np.searchsorted(own, su)
            there = np.minimum(at, len(own) - 1)
            tables[:, there[own[there] == su]] = totals[own[there] == su].T
            sw, mean = flat(seats, "w").astype(np.int64), flat(seats, "n").astype(np.float64) / 1000
            in_order = np.lexsort((sw, np.repeat(su, n)))
            t[c > 1] = mean[in_order]
        seated = (c - discount * t) / (STRENGTH + customers[of])
        new = (STRENGTH + discount * tables) / (STRENGTH + customers)
        p = np.zeros(len(cell))
        for s in range(samples):
            q = np.where(cw >= 0, parents[s][np.maximum(cw, 0)], np.where(c > 0, tails[s], 1.0))
            p += (seated + new[s][of] * q) / samples
        logs = np.repeat(np.log10(np.maximum(p, 1e-300)), sizes)
        scored = (flags[doc] & 2) > 0
        sums = np.bincount(doc[scored], weights=logs[scored], minlength=len(docs))
        is_open = np.repeat((cw < 0) & (c == 0), sizes) & scored
        order = np.argsort(doc[is_open], kind="stable")
        opened, of_doc = w[is_open][order], doc[is_open][order]
        met = np.unique(doc[scored])
        return pa.table({"_doc": pa.array(docs[met]), "score": pa.array(sums[met]), "open": _lists(opened, np.searchsorted(of_doc, met, side="right"), pa.int64())})

    return run


def context_scores(docs: DataFrame, model: Model, learnt: str | None) -> DataFrame:
    """(_doc, score): log10 probabilities of docs(_doc, text, ...), staged; texts with the same _doc add up."""
    spark = docs.sparkSession
    flag = lambda one: (F.when(F.col(learnt), 1).otherwise(0) + 2 if learnt else F.lit(2)) if one else F.lit(1)
    read = docs.select("text", "_doc", flag(True).cast("int").alias("flags"))
    if not learnt:
        read = read.union(model.texts.select("text", F.lit(0).cast("long"), flag(False).cast("int")))
    sent = spark.sparkContext.broadcast(model.head)
    tails = [model.tail_mean(s) for s in range(len(model.parents))]
    with common.scratch(spark):
        packed = read.mapInArrow(_scored_tokens(sent), PACKED)
        none = F.array().cast("array<long>")
        # a context with its cells; means of tables in thousandths, tables in each sample
        seats = model.seats.select("bucket", F.lit(1).alias("kind"), F.array("u").alias("u"), F.array(F.size("w")).alias("size"), "w", F.transform("mean", lambda m: F.round(m * 1000).cast("int")).alias("n"), none.alias("docs"), F.array().cast("array<int>").alias("flags"), F.col("totals").alias("t"))
        scoring = spark.sparkContext.broadcast((model.head, model.parents, tails, model.discount))
        parts = packed.union(seats).groupBy("bucket").applyInArrow(_bucket_scores(scoring), PARTS)
        parts = common.stage(parts, "parts")
        sums = parts.groupBy("_doc").agg(F.sum("score").alias("score"))
        opened = parts.select("_doc", F.explode("open").alias("word")).groupBy("_doc", "word").agg(F.count(F.lit(1)).alias("times"))
        code = F.col("word").bitwiseOR(F.lit(-(1 << 63)).cast("long"))
        counts = model.counts.select(code.alias("word"), "n")
        n, samples = F.col("n"), len(model.tail)
        share = lambda s: F.greatest(n * float(model.tail[s][0] / max(model.tail_tokens, 1)) - model.root_discount, F.lit(1e-9)) / float(STRENGTH + model.tail[s][1])
        p = sum((F.when(n.isNotNull(), share(s)).otherwise(0.0) + float(model.tail[s][2] / (model.types + 1)) for s in range(samples)), F.lit(0.0)) / samples
        opened = opened.join(counts, "word", "left").groupBy("_doc").agg(F.sum(F.col("times") * F.log10(p)).alias("more"))
        return common.stage(sums.join(opened, "_doc", "left").select("_doc", (F.col("score") + F.coalesce("more", F.lit(0.0))).alias("score")), "context_scores", keep=True)


def base_scores(docs: DataFrame, model: Model) -> DataFrame:
    """docs(_doc, text, ...) without text, with n_tokens, n_known and base_score, staged.

    Words of the head are counted where they are read. For the others a text keeps their hashes, and
    only those meet the counts of all words in a join.
    """
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(model.head)
    at_text, kept = docs.columns.index("text"), [f for f in docs.schema if f.name != "text"]
    spread = model.tokens + model.types + 1

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head = sent.value
        for batch in batches:
            for part in _slices(batch, at_text):
                h, bounds = _tokens(part.column(at_text))
                at = np.minimum(np.searchsorted(head.hashes, h), len(head.hashes) - 1)
                known = head.hashes[at] == h
                c = np.where(known, head.counts[at], 0)
                base = np.where(known, np.log10((c + 1) / spread), 0)
                sums = [np.add.reduceat(x, bounds[:-1]) for x in (base, (c > 0).astype(np.int64))]
                other = np.flatnonzero(~known)
                columns = [x for k, x in enumerate(part.columns) if k != at_text]
                yield pa.RecordBatch.from_arrays(
                    [*columns, pa.array(np.diff(bounds)), pa.array(sums[1].astype(np.int64)), pa.array(sums[0]), _lists(h[other].view(np.int64), np.searchsorted(other, bounds)[1:], pa.int64())],
                    [*(f.name for f in kept), "n_tokens", "n_known", "base_score", "_rare"],
                )

    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in kept)
    with common.scratch(spark):
        scored = docs.mapInArrow(local, f"{fields}n_tokens long, n_known long, base_score double, _rare array<long>")
        scored = common.stage(scored.withColumn("_row", F.monotonically_increasing_id()), "scored")
        rare = scored.select("_row", F.explode("_rare").alias("word")).groupBy("_row", "word").agg(F.count(F.lit(1)).alias("times"))
        rare = rare.join(model.counts, "word", "left")
        n = F.coalesce("n", F.lit(0))
        rare = rare.groupBy("_row").agg(F.sum(F.when(n > 0, F.col("times")).otherwise(0)).alias("_n"), F.sum(F.col("times") * F.log10((n + 1) / F.lit(float(spread)))).alias("_base"))
        out = scored.drop("_rare").join(rare, "_row", "left")
        out = out.withColumns({"n_known": F.col("n_known") + F.coalesce("_n", F.lit(0)), "base_score": F.col("base_score") + F.coalesce("_base", F.lit(0.0))})
        return common.stage(out.drop("_row", "_n", "_base"), "base", keep=True)


def score(docs: DataFrame, model: Model, learnt: str | None = None) -> DataFrame:
    """docs(doc_id, text, ...) with n_tokens, n_known, train_tokens (long), base_score and score (double, log10), perplexity.

    learnt: a boolean column, true for exactly the rows that the model was trained on, so that their
    texts need not be read again; without it the model's own texts are. Null
    texts are empty: their end is scored. Rows that repeat are scored alike; other
    columns pass through but for the text; columns named as results are replaced.
    """
    made = ["n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity"]
    own = docs.drop(*made, "_doc")
    names = [c for c in own.columns if c != "text"]
    with common.scratch(docs.sparkSession):
        keyed = own.withColumn("_doc", F.xxhash64("doc_id", "text"))
        sums = context_scores(keyed, model, learnt)
        rows = base_scores(keyed, model)
        times = rows.groupBy("_doc").agg(F.count(F.lit(1)).alias("_times"))
        sums = common.stage(sums.join(times, "_doc").select("_doc", (F.col("score") / F.col("_times")).alias("score")), "sums")
        out = rows.join(sums, "_doc", "left").withColumn("train_tokens", F.lit(model.tokens).cast("long"))
        out = out.withColumn("perplexity", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")))
        return common.stage(out.select(*[f"`{c}`" for c in names], *made), "scores", keep=True)


def op1_pitman_yor(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    docs = docs.withColumn("held_out", F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2, F.lit(False)))
    docs = docs.withColumn("learnt", ~F.col("held_out"))
    with common.scratch(spark):
        model = train(docs.filter("learnt"))
        return common.stage(score(docs, model, "learnt").drop("learnt"), "op1", keep=True)
