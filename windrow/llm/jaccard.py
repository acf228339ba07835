"""Exact n-gram Jaccard join by token-combination prefixes.

A document's set are the hashes of its distinct word n-grams. Two passes narrow
it down, both exact. First, on prefixes of the sets in hash order, extended so that
a linked pair must share many prefix tokens, not one: documents that share fewer
with all others have no link. Then, for those left, tokens are ordered by
frequency, rare first, and prefixes extended by one token for each class of
frequent tokens, of which longer sets have more: rare prefix tokens are keys by themselves,
of frequent ones the pairs within a class. A key bounds what two sets can share: what is left of them from
its place on. Pairs that share a key that leaves enough are verified on their whole sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, linking, words

WORDS, PERCENT = 4, 85
#: Extension of the first prefix, in percent of the least overlap.
EXTENSION = 15
#: Tokens of more sets than this are frequent; their pairs are keys, within classes: CLASSES at least, and one for so many tokens of the larger set.
FREQUENT, CLASSES, TOKENS_OF_CLASS = 64, 8, 32
#: Keys that a task holds before it hands them on.
KEYS_AT_ONCE = 1 << 20
#: Ids up to this many are broadcast to the documents; beyond, they are joined by shuffle.
BROADCAST_IDS = 200_000


def _overlap(n, percent: int):
    """Least intersection of a set of n with any set it links with."""
    return (percent * n + 99) // 100


def _shared(n, percent: int):
    """Prefix tokens beyond the first that a set of n and the smallest set it can link with have in common."""
    return (EXTENSION * _overlap(n, percent) + 99) // 100


def _sets(batch: pa.RecordBatch, at: int, n_words: int) -> list[np.ndarray]:
    return list(words.each_set(*words.grams(*words.hashed(batch.column(at)), n_words)))


def _lists(rows: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, rows)]).astype(np.int32)
    return pa.ListArray.from_arrays(ends, pa.array((np.concatenate(rows) if rows else np.zeros(0, np.uint64)).view(np.int64)))


def _prefixes(n_words: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = _sets(batch, 1, n_words)
            cut = [s[: len(s) - _overlap(len(s), percent) + _shared(len(s), percent)] for s in sets]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(s) for s in sets], pa.int64()), _lists(cut)], ["doc_id", "n", "prefix"])

    return run


def _whole(n_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = _sets(batch, 1, n_words)
            marks = [pa.array([int(np.bitwise_xor.reduce(words.mix(s + np.uint64(k))).view(np.int64)) if len(s) else 0 for s in sets], pa.int64()) for k in (1, 2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(s) for s in sets], pa.int64()), *marks, _lists(sets)], ["doc_id", "n", "h1", "h2", "tokens"])

    return run


def _spaces(n: int, percent: int) -> list[int]:
    """Numbers of classes of the sizes that a set of n links with: one for each power of two, so two at most where percent is over 71."""
    sizes = range(_overlap(n, percent).bit_length() - 1, (100 * n // percent).bit_length())
    return sorted({max(CLASSES, (1 << b) // TOKENS_OF_CLASS) for b in sizes})


def _keys(n: int, percent: int, df: np.ndarray, token: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys of a set of n whose shared tokens are given, rare first, and how much of it is left to share at each."""
    least, lone = _overlap(n, percent), n - len(token)  # tokens of this set alone come first
    made, more = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for spaces in _spaces(n, percent):
        take = min(n, n - least + 1 + spaces) - lone
        if take <= 0:
            continue
        tokens, alone = token[:take], df[:take] <= FREQUENT
        left = len(token) - np.arange(len(tokens))
        single = np.ones(len(tokens), bool) if least <= spaces else alone
        made.append(tokens[single])
        more.append(left[single])
        often = np.flatnonzero(~alone)
        of = tokens[often] % np.uint64(spaces)
        fresh = np.zeros(len(tokens), np.int64)
        fresh[often[np.unique(of, return_index=True)[1]]] = 1
        before = np.cumsum(fresh) - fresh
        by_class = np.argsort(of, kind="stable")
        for at in np.split(often[by_class], np.flatnonzero(np.diff(of[by_class])) + 1):
            i, j = (at[x] for x in np.triu_indices(len(at), 1))
            made.append(words.mix(np.minimum(tokens[i], tokens[j]) * words.GRAM[0] + np.maximum(tokens[i], tokens[j]) * words.GRAM[1] + np.uint64(spaces)))
            more.append(left[j] + before[j])
    made, more = np.concatenate(made), np.concatenate(more)
    by_key = np.lexsort((-more, made))
    made, more = made[by_key], more[by_key]
    first = np.append(True, made[1:] != made[:-1])[: len(made)]
    return made[first], more[first]


def _signatures(percent: int):
    """Keys of each set from its shared tokens with their frequencies, and how much the set can share with one that has the same key.

    The first token that two linked sets have in common is a key of both, or the first two of a class
    are; before the latter's second they share one token at most of each class that came before it.
    Classes grow in number with the larger set, so a set's keys are fewer than three times its tokens, however long it is.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, rest, items, n_keys = [], [], [], 0
            for k, n in enumerate(batch.column(1).to_pylist()):
                pairs = batch.column(2)[k].values
                df, token = pairs.field("df").to_numpy(), pairs.field("token").to_numpy().view(np.uint64)
                order = np.lexsort((token, df))
                made, more = _keys(n, percent, df[order], token[order])
                keys.append(made)
                rest.append(more)
                items.append(np.full(len(made), k))
                n_keys += len(made)
                if n_keys >= KEYS_AT_ONCE or k + 1 == batch.num_rows:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), batch.column(0).take(pa.array(np.concatenate(items))), pa.array(np.concatenate(rest))], ["key", "item", "rest"])
                    keys, rest, items, n_keys = [], [], [], 0

    return run


def _with_ids(docs: DataFrame, ids: DataFrame) -> DataFrame:
    small = ids.count() <= BROADCAST_IDS
    return docs.join(F.broadcast(ids) if small else ids, "doc_id", "left_semi")


def classes(docs: DataFrame, n_words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id) of docs(doc_id, text), a row for each row.

    component_id is the least doc_id reachable by links, the document's own included.
    Texts without words, and null texts, have empty sets and no links. Rows that
    share a doc_id count as linked. Rows without a doc_id have no links and a null
    component. Other columns are left out.
    """
    spark, texts, kind = docs.sparkSession, docs.select("doc_id", "text"), docs.schema["doc_id"].dataType.simpleString()
    with common.scratch(spark):
        with common.scratch(spark):
            first = common.stage(texts.mapInArrow(_prefixes(n_words, percent), f"doc_id {kind}, n long, prefix array<long>"), "prefixes")
            sizes = common.stage(first.select("doc_id", F.col("n").alias("n_shingles")), "sizes", keep=True)
            posts = first.filter("doc_id is not null").select("doc_id", "n", F.explode("prefix").alias("token"))
            several = posts.groupBy("token").agg(F.count(F.lit(1)).alias("sets")).filter("sets > 1").select("token")
            least = lambda n: F.floor((F.lit(percent) * n + 99) / 100)
            needed = F.floor((F.lit(EXTENSION) * least(least(F.col("n"))) + 99) / 100)
            near = posts.join(several, "token", "left_semi").groupBy("doc_id", "n").agg(F.count(F.lit(1)).alias("shared")).filter(F.col("shared") >= needed)
            near = common.stage(near.select("doc_id").distinct(), "near", keep=True)

        with common.scratch(spark):
            sets = common.stage(_with_ids(texts, near).mapInArrow(_whole(n_words), f"doc_id {kind}, n long, h1 long, h2 long, tokens array<long>"), "sets")
            same = sets.filter("n > 0").groupBy("h1", "h2", "n").agg(F.min("doc_id").alias("item"))
            member = common.stage(sets.filter("n > 0").select("doc_id", "h1", "h2", "n").join(same, ["h1", "h2", "n"]).select("doc_id", "item", "n").distinct(), "classes", keep=True)
            # by id, not by class: the token arrays of all copies of a text would meet in one task
            first_of = same.withColumnRenamed("item", "doc_id")
            whole = sets.join(F.broadcast(first_of) if first_of.count() <= BROADCAST_IDS else first_of, ["doc_id", "n", "h1", "h2"], "left_semi")
            whole = common.stage(whole.select(F.col("doc_id").alias("item"), "n", "tokens").dropDuplicates(["item", "n"]), "whole", keep=True)

        tokens = whole.select("item", "n", F.explode("tokens").alias("token"))
        often = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("df")).filter("df > 1")
        shared = tokens.join(often, "token").groupBy("item", "n").agg(F.collect_list(F.struct("df", "token")).alias("shared"))  # a document's tokens
        shared = common.stage(shared.filter(F.size("shared") >= least(F.col("n"))), "shared")
        keys = shared.select("item", "n", "shared").mapInArrow(_signatures(percent), f"key long, item {kind}, rest long")
        # what bounds a pair's overlap: the size, and the tokens that any other set has
        about = shared.select("item", (F.col("n") - F.size("shared")).alias("alone"), "n", F.size("shared").alias("shared"))
        members = keys.join(about, "item").select("key", "item", F.struct("alone", "n", "shared", "rest").alias("about"))

        def able(a: Column, b: Column) -> Column:
            most = F.least(a["shared"], b["shared"], a["rest"], b["rest"])
            return 100 * most >= percent * (a["n"] + b["n"] - most)

        def verify(pairs: DataFrame) -> DataFrame:
            left = whole.select(F.col("item").alias("a"), F.col("n").alias("n_a"), F.col("tokens").alias("of_a"))
            right = whole.select(F.col("item").alias("b"), F.col("n").alias("n_b"), F.col("tokens").alias("of_b"))
            both = F.size(F.array_intersect("of_a", "of_b"))
            return pairs.join(left, "a").join(right, "b").filter(100 * both >= percent * (F.col("n_a") + F.col("n_b") - both))

        linked = linking.link(common.stage(members, "members"), verify, able)
        # rows that share an id, and copies, belong together even where their sets have no other link
        ties = member.filter("doc_id <> item").select(F.col("doc_id").alias("a"), F.col("item").alias("b"))
        ties = ties.union(linked.filter("item <> component").select("item", "component"))
        groups = linking.components(ties)
        out = sizes.join(groups.select(F.col("item").alias("doc_id"), "component"), "doc_id", "left")
        return common.stage(out.select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id")), "classes", keep=True)


def keep_one(docs: DataFrame, n_words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """docs without those that belong to a group whose least doc_id is another's; rows that repeat an id stay with it."""
    with common.scratch(docs.sparkSession):
        gone = common.stage(classes(docs.select("doc_id", "text"), n_words, percent).filter("component_id < doc_id").select("doc_id").distinct(), "gone", keep=True)
    return docs.join(F.broadcast(gone) if gone.count() <= BROADCAST_IDS else gone, "doc_id", "left_anti")


def op5_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(common.table(spark, sf_dir, "documents").select("doc_id", "text"))


ORACLE = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sh AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 3], ' ') AS s FROM (SELECT *, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
i AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM i JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 85 * (x.n + y.n - i)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT a AS doc_id, a AS node FROM e UNION SELECT r.doc_id, e.b FROM r JOIN e ON e.a = r.node)
SELECT w.doc_id, coalesce(n.n, 0)::bigint AS n_shingles, coalesce(c.c, w.doc_id) AS component_id
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT doc_id, min(node) AS c FROM r GROUP BY doc_id) c USING (doc_id)
"""
