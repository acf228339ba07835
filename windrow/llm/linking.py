"""Connected groups from shared keys, without all pairs of a key's members.

Members that share a key are candidates. Keys with the same members count once. In
each round every key whose members are not yet in one component tests its open
members against one pivot, another in each round; verified pairs join components,
which from then on count as one. What stays open after the rounds is dealt to finer
keys, where the caller has such, and tested across components only, so no link between
different components is lost.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

ROUNDS = 2
#: Keys with more open members than this are dealt to finer keys before their members meet: below, looking at
#: all pairs of a key costs less than the rows of its finer keys, a few for each member.
REFINED = 1024
#: Edges up to this many are joined in one partition, without exchanges; beyond, they are dealt out.
ONE_PARTITION = 200_000
#: Labels up to this many are broadcast to the members.
BROADCAST_LABELS = 200_000


def components(edges: DataFrame) -> DataFrame:
    """(item, component: least item reachable) of edges(a, b), by least labels that spread and jump."""
    spark = edges.sparkSession
    with common.scratch(spark):
        edges = common.stage(edges.select("a", "b").filter("a <> b").distinct(), "edges")
        few = edges.count() <= ONE_PARTITION
        one = (lambda df: df.coalesce(1)) if few else (lambda df: df)
        both = one(edges).union(one(edges).select("b", "a"))
        both = one(common.stage(one(both), "both"))
        labels = one(common.stage(both.groupBy(F.col("a").alias("item")).agg(F.least(F.min("b"), F.first("a")).alias("component")), "labels"))
        while True:
            near = both.join(labels.withColumnRenamed("item", "b"), "b").groupBy(F.col("a").alias("item")).agg(F.min("component").alias("near"))
            spread = labels.join(near, "item").select("item", F.col("component").alias("before"), F.least("component", "near").alias("component"))
            jump = labels.select(F.col("item").alias("component"), F.col("component").alias("further"))
            spread = one(common.stage(spread.join(jump, "component").select("item", "before", F.least("component", "further").alias("component")), "labels"))
            labels = spread.drop("before")
            if spread.filter("before <> component").isEmpty():
                return common.stage(labels, "components", keep=True)


def _small(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_LABELS else df


def merged(labels: DataFrame | None, links: DataFrame) -> DataFrame:
    """labels(item, component) with links(a, b) taken in: only the components that the links touch are joined anew."""
    if labels is None:
        return components(links)
    spark = labels.sparkSession
    with common.scratch(spark):
        n = labels.count()
        of = lambda x: _small(labels.select(F.col("item").alias(x), F.col("component").alias(f"c{x}")), n)
        ends = links.join(of("a"), "a", "left").join(of("b"), "b", "left")
        ends = common.stage(ends.select("a", "b", F.coalesce("ca", "a").alias("ca"), F.coalesce("cb", "b").alias("cb")), "ends")
        roots = components(ends.select(F.col("ca").alias("a"), F.col("cb").alias("b")))
        roots = _small(roots.select(F.col("item").alias("component"), F.col("component").alias("root")), roots.count())
        fresh = ends.select(F.explode(F.array(F.struct("a", "ca"), F.struct(F.col("b").alias("a"), F.col("cb").alias("ca")))).alias("x")).filter("x.a = x.ca").select(F.col("x.a").alias("item")).distinct()
        fresh = fresh.join(labels.select("item"), "item", "left_anti").withColumn("component", F.col("item"))
        out = labels.union(fresh).join(roots, "component", "left").select("item", F.coalesce("root", "component").alias("component"))
        return common.stage(out, "merged", keep=True)


def distinct_groups(members: DataFrame) -> DataFrame:
    """members of keys with several of them; of keys with the same members and abouts, told by their number and 128 bits of hashes, one."""
    part = lambda seed: F.bit_xor(F.xxhash64(F.lit(seed), "item", "about"))
    sets = members.groupBy("key").agg(F.count(F.lit(1)).alias("n"), part(1).alias("x"), part(2).alias("y")).filter("n > 1")
    return members.join(sets.groupBy("n", "x", "y").agg(F.min("key").alias("key")).select("key"), "key", "left_semi")


def link(
    members: DataFrame,
    verify: Callable[[DataFrame], DataFrame],
    able: Callable[[Column, Column], Column] | None = None,
    links: DataFrame | None = None,
    refine: Callable[[Column, Column], Column] | None = None,
    once: Callable[[Column, Column, Column, Column], Column] | None = None,
) -> DataFrame:
    """(item, component) of the items that have links; members(key, item, about), a staged table.

    verify takes pairs(a, b) and returns those that hold; able says from two
    abouts whether a pair can hold at all. Pivots are the first members by
    about, then the last. links(a, b): links that are known from the start. refine gives finer keys (key, part) of a
    member from its key and about, such that members that can hold share one; with it goes once, which says from a key, its part
    (null if not refined) and two abouts whether the pair is met here, of all keys that it shares. Where keys with the same members are one, the least stands for them.
    """
    spark = members.sparkSession
    able = able or (lambda _a, _b: F.lit(True))
    with common.scratch(spark):
        labels = None if links is None or links.isEmpty() else components(links)
        members = common.stage(distinct_groups(members), "members")
        for turn in range(ROUNDS + 1):
            own = members if labels is None else members.join(_small(labels, labels.count()), "item", "left")
            own = own.select("key", "item", "about", (F.col("item") if labels is None else F.coalesce("component", "item")).alias("component"))
            open_keys = lambda own: own.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low < high").select("key")
            if turn < ROUNDS:
                pick = (F.max if turn == 1 else F.min)(F.struct("about", "item", "component"))
                keys = own.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high"), pick.alias("pivot")).filter("low < high").select("key", "pivot")
                pairs = own.join(keys, "key").filter((F.col("component") != F.col("pivot.component")) & able(F.col("about"), F.col("pivot.about")))
                pairs = pairs.select(F.least("item", "pivot.item").alias("a"), F.greatest("item", "pivot.item").alias("b")).distinct()
            else:
                left = common.stage(own.join(open_keys(own), "key", "left_semi"), "open")
                if left.isEmpty():
                    break
                met_here = F.lit(True)
                left = left.withColumns({"base": F.col("key"), "part": F.lit(None).cast("int")})
                if refine:
                    large = common.stage(left.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > REFINED).select("key"), "large")
                    if n := large.count():
                        large = _small(large, n)
                        finer = left.join(large, "key", "left_semi").drop("part").withColumn("finer", F.explode(refine(F.col("key"), F.col("about"))))
                        finer = common.stage(finer.select(F.col("finer.key").alias("key"), "item", "about", "component", "base", F.col("finer.part").alias("part")), "finer")
                        left = left.join(large, "key", "left_anti").unionByName(finer.join(open_keys(finer), "key", "left_semi"))
                    met_here = once(F.col("base"), F.col("part"), F.col("about"), F.col("_about"))
                right = left.select(F.col("key").alias("_key"), *(F.col(c).alias(f"_{c}") for c in ("item", "about", "component")))
                able_here = F.when((F.col("item") < F.col("_item")) & (F.col("component") != F.col("_component")), F.when(able(F.col("about"), F.col("_about")), met_here))
                pairs = left.join(right, (F.col("key") == F.col("_key")) & able_here).select(F.col("item").alias("a"), F.col("_item").alias("b"))
                pairs = pairs if refine else pairs.distinct()
            found = common.stage(verify(pairs).select("a", "b"), "found")
            if not found.isEmpty():
                labels = merged(labels, found)
        if labels is None:
            labels = members.select("item", F.col("item").alias("component")).limit(0)
        return common.stage(labels, "labels", keep=True)
