"""Approximate nearest neighbours by hierarchical navigable small-world graphs, one a shard.

Rows are dealt to shards at random. A shard's graph is a row of flat arrays: vectors, and for each layer the nodes
in it and their neighbours. Queries visit every shard and the shards' answers are merged by distance. Within a
task many searches advance together, a step of each at once, so that NumPy does the work of a step.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, FloatType
from pyspark.sql.window import Window

from . import common
from .whitening import commonest_width, usable

#: Rows of a shard at most, on average, and the least number of shards, so that small tables are searched in parallel too.
SHARD_ROWS, LEAST_SHARDS = 1 << 16, 8
#: Neighbours of a node in the upper layers, twice as many in the lowest.
LINKS = 16
#: Nodes that a search keeps at hand: while the graph is made, and when it is asked.
BUILD_WIDTH, SEARCH_WIDTH = 96, 128
#: Nodes that are added, and queries that are asked, at once.
TOGETHER = 256
INDEX = "shard int, width int, vectors binary, nodes array<binary>, neighbours array<binary>, firsts binary, ids binary, nulls binary, rows binary"


@dataclass
class Graph:
    x: np.ndarray
    #: For each layer from 0: neighbours as node x place, -1 where there is none.
    layers: list[np.ndarray]
    #: The highest layer of each node.
    height: np.ndarray

    @property
    def entry(self) -> int:
        return int(np.argmax(self.height))


def _distances(x: np.ndarray, at: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Squared distances of the rows x[at[i, j]] from q[i]."""
    apart = x[at] - q[:, None, :]
    return np.einsum("ijk,ijk->ij", apart, apart)


def _beam(x: np.ndarray, near: np.ndarray, q: np.ndarray, start: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, squared distances), nearest first and -1 for none: of each query q[i] the nodes at hand when no nearer one is left to follow.

    start: nodes where each search begins. Every step follows, in all searches that go on, the nearest node not followed yet.
    """
    n, size = len(q), start.shape[1]
    nodes = np.full((n, width), -1, np.int64)
    d = np.full((n, width), np.inf, x.dtype)
    open_ = np.zeros((n, width), bool)
    seen = np.zeros((n, len(x) + 1), bool)  # the last column stands for none
    take = min(size, width)
    first = np.where(start >= 0, _distances(x, start, q), np.inf)
    order = np.argsort(first, axis=1, kind="stable")[:, :take]
    nodes[:, :take] = np.take_along_axis(start, order, 1)
    d[:, :take] = np.take_along_axis(first, order, 1)
    open_[:, :take] = nodes[:, :take] >= 0
    seen[np.arange(n)[:, None], start] = True
    seen[:, -1] = True
    going = np.flatnonzero(open_.any(axis=1))
    while len(going):
        best = np.argmin(np.where(open_[going], d[going], np.inf), axis=1)
        at = nodes[going, best]
        open_[going, best] = False
        found = near[at]
        fresh = ~seen[going[:, None], found]
        seen[going[:, None], found] = True
        seen[:, -1] = True
        apart = np.where(fresh, _distances(x, found, q[going]), np.inf)
        all_d = np.concatenate([d[going], apart], axis=1)
        pick = np.argpartition(all_d, width - 1, axis=1)[:, :width]
        d[going] = np.take_along_axis(all_d, pick, 1)
        nodes[going] = np.take_along_axis(np.concatenate([nodes[going], np.where(fresh, found, -1)], axis=1), pick, 1)
        open_[going] = np.take_along_axis(np.concatenate([open_[going], fresh], axis=1), pick, 1)
        going = going[open_[going].any(axis=1)]
    order = np.argsort(d, axis=1, kind="stable")
    return np.take_along_axis(nodes, order, 1), np.take_along_axis(d, order, 1)


def _chosen(x: np.ndarray, of: np.ndarray, nodes: np.ndarray, d: np.ndarray, most: int) -> np.ndarray:
    """Of candidates nodes[i] (nearest first, -1 for none) of the rows of[i] at most so many, -1 for none: each nearer to of[i] than to those
    chosen before it, so that links lead to all sides; places that stay free get the nearest of the others."""
    n, size = nodes.shape
    here = x[nodes]
    norms = np.einsum("ijk,ijk->ij", here, here)
    between = norms[:, :, None] + norms[:, None, :] - 2 * np.matmul(here, here.transpose(0, 2, 1))
    shut = nodes < 0
    passed = np.zeros((n, size), bool)
    out = np.full((n, most), -1, np.int64)
    counts = np.zeros(n, np.int64)
    for j in range(size):  # a candidate at a time, in all rows at once
        good = ~shut[:, j] & (counts < most)
        rows = np.flatnonzero(good)
        out[rows, counts[rows]] = nodes[rows, j]
        counts[rows] += 1
        passed[rows, j] = True
        shut[rows] |= between[rows, j] < d[rows]
    rest = np.where(~passed & (nodes >= 0), np.arange(size), size)
    rest.sort(axis=1)
    for j in range(min(size, most)):
        rows = np.flatnonzero((counts < most) & (rest[:, j] < size))
        out[rows, counts[rows]] = nodes[rows, rest[rows, j]]
        counts[rows] += 1
    return out


def _linked_back(x: np.ndarray, near: np.ndarray, new: np.ndarray, out: np.ndarray) -> None:
    """Add the nodes new[i] to the neighbours of out[i, :]; where these grow beyond their places, they are chosen anew."""
    target, source = out[out >= 0], np.repeat(new, (out >= 0).sum(axis=1))
    order = np.argsort(target, kind="stable")
    target, source = target[order], source[order]
    nodes, starts, sizes = np.unique(target, return_index=True, return_counts=True)
    most = near.shape[1]
    for low in range(0, len(nodes), TOGETHER):
        part, size = nodes[low : low + TOGETHER], sizes[low : low + TOGETHER]
        at = np.arange(starts[low], starts[low] + size.sum())
        wide = np.full((len(part), most + int(size.max())), -1, np.int64)
        wide[:, :most] = near[part]
        row = np.repeat(np.arange(len(part)), size)
        wide[row, most + at - starts[low + row]] = source[at]
        d = np.where(wide >= 0, _distances(x, wide, x[part]), np.inf)
        order = np.argsort(d, axis=1, kind="stable")
        wide, d = np.take_along_axis(wide, order, 1), np.take_along_axis(d, order, 1)
        full = (wide >= 0).sum(axis=1) > most
        near[part[~full]] = wide[~full, :most]
        if full.any():
            near[part[full]] = _chosen(x, part[full], wide[full], d[full], most)


def build(x: np.ndarray, seed: int = 0) -> Graph:
    """The graph of some distinct vectors. Nodes are added TOGETHER at most and no more than are there already; those of a group see each other too."""
    n = len(x)
    draws = np.random.default_rng(seed).random(n)
    height = np.minimum((-np.log(1 - draws) / math.log(LINKS)).astype(np.int64), 30)
    top = int(height.max(initial=0))
    layers = [np.full((n, LINKS * (1 if k else 2)), -1, np.int64) for k in range(top + 1)]
    if n:
        height[0] = top  # the entry of all searches
    low = 1
    while low < n:
        high = min(n, low + min(low, TOGETHER))
        new = np.arange(low, high)
        start = np.zeros((len(new), 1), np.int64)
        inner = x[new]
        norms = np.einsum("ij,ij->i", inner, inner)
        among = norms[:, None] + norms[None, :] - 2 * inner @ inner.T
        for k in range(top, -1, -1):
            joins = height[new] >= k
            passes = np.flatnonzero(~joins)
            if len(passes):
                start[passes, :1], _ = _beam(x, layers[k], inner[passes], start[passes, :1], 1)
            own = np.flatnonzero(joins)
            if not len(own):
                continue
            nodes, d = _beam(x, layers[k], inner[own], start[own], BUILD_WIDTH)
            earlier = np.where(own[None, :] < own[:, None], np.maximum(among[np.ix_(own, own)], 0), np.inf)
            all_d = np.concatenate([d, earlier], axis=1)
            all_nodes = np.concatenate([nodes, np.broadcast_to(new[own], earlier.shape)], axis=1)
            order = np.argsort(all_d, axis=1, kind="stable")[:, :BUILD_WIDTH]
            d = np.take_along_axis(all_d, order, 1)
            nodes = np.where(np.isfinite(d), np.take_along_axis(all_nodes, order, 1), -1)
            out = _chosen(x, new[own], nodes, d, LINKS)
            layers[k][new[own], :LINKS] = out
            _linked_back(x, layers[k], new[own], out)
            if k:  # nodes found may start the search one layer below
                wide = np.full((len(new), max(start.shape[1], LINKS)), -1, np.int64)
                wide[:, : start.shape[1]] = start
                wide[own, :LINKS] = np.where(nodes[:, :LINKS] < low, nodes[:, :LINKS], -1)
                wide[own, 0] = np.where(wide[own, :LINKS].max(axis=1) < 0, 0, wide[own, 0])
                start = wide
        low = high
    return Graph(x, layers, height)


def ask(graph: Graph, q: np.ndarray, width: int) -> np.ndarray:
    """The nodes nearest to each row of q, at most width, nearest first, -1 for none."""
    out = np.full((len(q), width), -1, np.int64)
    if not len(graph.x):
        return out
    for low in range(0, len(q), TOGETHER):
        part = q[low : low + TOGETHER]
        start = np.full((len(part), 1), graph.entry, np.int64)
        for layer in graph.layers[:0:-1]:
            start, _ = _beam(graph.x, layer, part, start, 1)
        out[low : low + TOGETHER], _ = _beam(graph.x, graph.layers[0], part, start, width)
    return out


def _packed(graph: Graph) -> tuple[list[bytes], list[bytes]]:
    """(nodes, neighbours) of each layer as bytes of 32-bit numbers, of those nodes only that are in it."""
    inside = [np.flatnonzero(graph.height >= k) for k in range(len(graph.layers))]
    return [i.astype(np.int32).tobytes() for i in inside], [layer[i].astype(np.int32).tobytes() for layer, i in zip(graph.layers, inside, strict=True)]


def _unpacked(x: np.ndarray, nodes: list[bytes], neighbours: list[bytes]) -> Graph:
    height, layers = np.zeros(len(x), np.int64), []
    for k, (own, near) in enumerate(zip(nodes, neighbours, strict=True)):
        at = np.frombuffer(own, np.int32)
        height[at] = k
        layer = np.full((len(x), LINKS * (1 if k else 2)), -1, np.int32)
        layer[at] = np.frombuffer(near, np.int32).reshape(len(at), -1)
        layers.append(layer)
    return Graph(x, layers, height)


def _vectors(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def with_shards(rows: DataFrame, count: int) -> DataFrame:
    """rows(row, ...) with shard, dealt by a hash of row, and the number of shards in use."""
    return rows.withColumn("shard", F.pmod(F.xxhash64("row"), F.lit(max(LEAST_SHARDS, -(-count // SHARD_ROWS)))).cast("int"))


def index(rows: DataFrame, shards: int, keep: int) -> DataFrame:
    """INDEX of rows(row, shard, id, x), a row a shard: the graph of its distinct vectors as flat arrays, with the rows of each.

    Rows of equal vectors share a node, which remembers the keep rows of least id (then row): no answer of fewer than keep rows needs another.
    A shard is built in one task, which holds its vectors and graph, some 400 bytes a row beside the vectors.
    """

    def built(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        table = pa.Table.from_batches(held).combine_chunks().sort_by("row")  # whatever order the shuffle brings, the same graph
        x = _vectors(table.column("x").chunk(0)) + 0.0  # -0 is 0
        _, first, node = np.unique(np.ascontiguousarray(x).view([("", x.dtype)] * x.shape[1]).ravel(), return_index=True, return_inverse=True)
        shuffled = np.random.default_rng(len(first)).permutation(len(first))  # nodes of like vectors are not added in a row
        places = np.empty_like(shuffled)
        places[shuffled] = np.arange(len(first))
        x, node = x[first[shuffled]], places[node.ravel()]
        ids, row = table.column("id").to_numpy(zero_copy_only=False) if not table.column("id").null_count else table.column("id").fill_null(0).to_numpy(), table.column("row").to_numpy()
        null = table.column("id").is_null().to_numpy().astype(np.int8)
        order = np.lexsort([row, ids, null, node])
        node = node[order]
        starts = np.searchsorted(node, np.arange(len(x)))
        order = order[np.arange(len(node)) - starts[node] < keep]
        node = np.sort(node)[np.arange(len(node)) - starts[node] < keep]
        firsts = np.searchsorted(node, np.arange(len(x) + 1)).astype(np.int64)
        nodes, neighbours = _packed(build(x.astype(np.float32) if np.abs(x).max() < 1e15 else x))
        made = [[table.column("shard")[0].as_py()], [x.shape[1]], [x.tobytes()], [nodes], [neighbours], [firsts.tobytes()], [ids[order].astype(np.int64).tobytes()], [null[order].tobytes()], [row[order].tobytes()]]
        kinds = [pa.int32(), pa.int32(), pa.binary(), pa.list_(pa.binary()), pa.list_(pa.binary()), *[pa.binary()] * 4]
        yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(made, kinds, strict=True)], [c.split()[0] for c in INDEX.split(", ")])

    return rows.select("shard", "row", "id", "x").repartitionById(shards, F.col("shard")).mapInArrow(built, INDEX)


def search(indexed: DataFrame, shards: int, queries: DataFrame, k: int) -> DataFrame:
    """(query, query_id, rank, id, score) of queries(row, id, x): the k nearest rows of all shards but the query's own, nearest first, ties to the smaller id.

    Queries are sent to every shard, whose task reads the graph first and then answers queries as they stream in, so it holds a graph and a
    batch. score: Euclidean distance in double precision.
    """
    sent = queries.select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), F.col("row").alias("query"), F.col("id").alias("query_id"), "x")
    both = indexed.withColumn("asks", F.lit(False)).unionByName(sent.withColumn("asks", F.lit(True)), allowMissingColumns=True)
    dealt = both.repartitionById(shards, F.col("shard")).sortWithinPartitions("asks", "query")
    columns = [f.name for f in dealt.schema.fields]

    def answered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        graph = None
        for batch in (b for b in batches if b.num_rows):
            named = dict(zip(columns, batch.columns, strict=True))
            asks = named["asks"].to_numpy(zero_copy_only=False)
            at = 0
            if graph is None and not asks[0]:
                x = np.frombuffer(named["vectors"][0].as_py()).reshape(-1, named["width"][0].as_py())
                graph = _unpacked(x.astype(np.float32) if np.abs(x).max() < 1e15 else x, named["nodes"][0].as_py(), named["neighbours"][0].as_py())
                firsts, ids, row = (np.frombuffer(named[c][0].as_py(), np.int64) for c in ("firsts", "ids", "rows"))
                null = np.frombuffer(named["nulls"][0].as_py(), np.int8)
                at = 1
            if graph is None or at == len(asks):
                continue  # a shard without rows
            q, own, own_id = _vectors(named["x"].slice(at)), named["query"].slice(at).to_numpy(), named["query_id"].slice(at)
            nodes = ask(graph, q.astype(graph.x.dtype), max(SEARCH_WIDTH, k + 1))
            i, j = np.nonzero(nodes >= 0)
            node = nodes[i, j]
            d = np.sqrt(((x[node] - q[i]) ** 2).sum(axis=1))
            sizes = firsts[node + 1] - firsts[node]
            each = np.repeat(np.arange(len(node)), sizes)
            member = np.arange(len(each)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + firsts[node[each]]
            i, d = i[each], d[each]
            other = row[member] != own[i]
            i, d, member = i[other], d[other], member[other]
            order = np.lexsort([row[member], ids[member], null[member], d, i])
            i, d, member = i[order], d[order], member[order]
            best = np.arange(len(i)) - np.searchsorted(i, i) < k
            i, d, member = i[best], d[best], member[best]
            found = pa.array(ids[member], mask=null[member] > 0)
            yield pa.RecordBatch.from_arrays([pa.array(own[i]), own_id.take(pa.array(i)), found, pa.array(row[member]), pa.array(d)], ["query", "query_id", "id", "row", "score"])

    met = dealt.mapInArrow(answered, "query long, query_id long, id long, row long, score double")
    nearest = Window.partitionBy("query").orderBy("score", F.col("id").asc_nulls_last(), "row")
    return met.withColumn("rank", F.row_number().over(nearest)).filter(F.col("rank") <= k).select("query", "query_id", "rank", "id", "score")


def nearest(rows: DataFrame, key: str, embedding: str, asks: Column, k: int = 10) -> DataFrame:
    """(query_id, rank, key, score): of the rows where asks holds the k nearest other rows by Euclidean distance, as far as the graphs find them.

    key is a whole number, and may repeat or be null. Vectors that are null, empty or zero, hold null or non-finite entries, or are of another
    length than the commonest take no part. Fewer than k other rows: all of them. Equal vectors are all found, whatever their number.
    """
    kind = rows.schema[embedding].dataType
    if not isinstance(kind, ArrayType) or not isinstance(kind.elementType, FloatType | DoubleType):
        rows = rows.withColumn(embedding, F.col(f"`{embedding}`").cast("array<double>"))
    own = rows.filter(usable(embedding)).filter(F.exists(f"`{embedding}`", lambda c: c != 0))
    own = own.select(F.monotonically_increasing_id().alias("row"), F.col(f"`{key}`").cast("long").alias("id"), F.col(f"`{embedding}`").alias("x"), F.coalesce(asks, F.lit(False)).alias("asks"))
    with common.scratch(rows.sparkSession):
        own = common.stage(own, "vectors")
        width = commonest_width(own, "x")
        own = own.filter(F.size("x") == width)
        count = own.count()
        shards = max(LEAST_SHARDS, -(-count // SHARD_ROWS))
        graphs = common.stage(index(with_shards(own, count), shards, k + 1), "index")
        found = common.stage(search(graphs, shards, own.filter("asks"), k), "nearest", keep=True)
    return found.select("query_id", "rank", F.col("id").alias(key), "score")


def op12_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest embeddings of each whose vec_id is divisible by 100. A null vec_id asks nothing, but is found."""
    rows = common.table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return nearest(rows, "vec_id", "embedding", F.col("vec_id") % 100 == 0)
