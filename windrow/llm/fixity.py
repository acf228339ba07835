"""WARC fixity audit by Merkle trees.

Records of a file, in order of their offsets, fall into leaves by page and a part of their digest, so that a
record that is lost or has another length moves no other's leaf. Within a leaf, records are hashed in
order, with their offsets and lengths, a range of BLOCK bytes at once. FANOUT neighbours make
a node that covers their range of bytes; all trees are of one depth. Two replicas compare the roots of their
files and then, level by level, only the children of nodes that differ; of
leaves that differ the records are compared. Where indexes say at which offset each replica holds its records,
differences() takes ranges of offsets as leaves, and tells what is moved from what is changed, lost or added.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType
from pyspark.sql.window import Window

from . import common

FANOUT = 16
#: Bytes of a range whose records are hashed together, in order. A record has over 80.
BLOCK = 1 << 16
#: Ids of pages that share a file.
PAGES_IN_FILE = 100
#: Files that pages without an id are dealt to, by digest, and pages whose ids are no whole numbers, by id, and parts of a page's records, by digest: no task orders more than a part.
NULL_FILES, PARTS = 1024, 256
#: Levels over the leaves: FANOUT to this power is over PAGES_IN_FILE * PARTS.
LEVELS = 4


def record(url: Column, body: Column) -> Column:
    """A resource record: header lines, an empty line, the body, two line ends."""
    body = F.coalesce(body, F.lit(""))
    head = F.concat(F.lit("WARC/1.0\r\nWARC-Type: resource\r\nWARC-Target-URI: "), F.coalesce(url, F.lit("")), F.lit("\r\nContent-Length: "), F.octet_length(body).cast("string"))
    return F.concat(head, F.lit("\r\n\r\n"), body, F.lit("\r\n\r\n"))


def archive(pages: DataFrame) -> DataFrame:
    """(file, leaf, page_id, offset, within, number, length, digest, copies) of pages(page_id, url, html): a row for equal records of a page, which lie one after another.

    In order of page_id, then content; number, offset and within (from the leaf's first byte) are those of the first copy. Null urls and bodies are
    empty. Pages without an id are dealt to files of their own by content; ids that are no whole numbers are dealt to files by hash. Other columns are left out.
    """
    text = record(F.col("url"), F.col("html"))
    rows = pages.select("page_id", F.octet_length(text).cast("long").alias("length"), F.sha2(text.cast("binary"), 256).alias("digest"))
    spread = lambda n, seed: F.pmod(F.xxhash64(F.lit(seed), "digest"), F.lit(n))
    of_id = lambda n, seed: F.when(F.col("page_id").isNotNull(), F.pmod(F.xxhash64(F.lit(seed), "page_id"), F.lit(n)))
    whole = isinstance(pages.schema["page_id"].dataType, IntegralType)
    file = F.coalesce(F.floor(F.col("page_id") / PAGES_IN_FILE) if whole else of_id(NULL_FILES, 3), -1 - spread(NULL_FILES, 1)).cast("long")
    slot = F.coalesce(F.pmod("page_id", F.lit(PAGES_IN_FILE)) if whole else of_id(PAGES_IN_FILE, 4), spread(PAGES_IN_FILE, 2)).cast("long")
    part = F.conv(F.substring("digest", 1, 2), 16, 10).cast("long")
    rows = rows.groupBy("page_id", "length", "digest").agg(F.count(F.lit(1)).alias("copies"))
    rows = rows.select(file.alias("file"), (slot * PARTS + part).alias("leaf"), "page_id", "length", "digest", "copies")
    totals = rows.groupBy("file", "leaf").agg(F.sum(F.col("length") * F.col("copies")).alias("_bytes"), F.sum("copies").alias("_n"))
    before = Window.partitionBy("file").orderBy("leaf").rowsBetween(Window.unboundedPreceding, -1)  # PAGES_IN_FILE * PARTS rows at most
    totals = totals.select(F.col("file").alias("_f"), F.col("leaf").alias("_l"), *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(c) for c in ("_bytes", "_n")])
    upto = Window.partitionBy("file", "leaf").orderBy("page_id", "digest", "length").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.join(totals, (F.col("file") == F.col("_f")) & (F.col("leaf") == F.col("_l")))
    own = lambda c: F.coalesce(F.sum(c).over(upto), F.lit(0))
    within = own(F.col("length") * F.col("copies")).cast("long")
    return rows.select("file", "leaf", "page_id", (F.col("_bytes") + within).cast("long").alias("offset"), within.alias("within"), (F.col("_n") + own(F.col("copies"))).cast("long").alias("number"), "length", "digest", "copies")


def tree(records: DataFrame, fanout: int = FANOUT, levels: int = LEVELS) -> DataFrame:
    """(file, level, number, first, last, hash) of archive() or placed() records; level 0 are the leaves, the top level has one node a file.

    A leaf's hash covers, in order, its records' places from its first byte, lengths, copies, digests and page_ids; a node's the numbers and hashes of its children in order.
    """
    one = F.concat_ws(":", "within", "length", "copies", "digest", F.coalesce(F.col("page_id").cast("string"), F.lit("")))
    in_order = lambda at, of: F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(at, of.alias("of")))), lambda x: x["of"]), ",")
    first, last = F.min("offset").alias("first"), F.max(F.col("offset") + F.col("length") * F.col("copies")).alias("last")
    blocks = records.groupBy("file", F.col("leaf").alias("number"), F.floor(F.col("within") / BLOCK).alias("block")).agg(first, last, F.sha2(in_order("within", one), 256).alias("hash"))  # BLOCK / 80 records
    leaves = blocks.groupBy("file", "number").agg(F.min("first").alias("first"), F.max("last").alias("last"), F.sha2(in_order("block", F.col("hash")), 256).alias("hash"))
    level = common.stage(leaves.select("file", F.lit(0).alias("level"), "number", "first", "last", "hash"), "leaves", keep=True)
    nodes = level
    for depth in range(1, levels + 1):
        children = F.transform(F.sort_array(F.collect_list(F.struct("number", "hash"))), lambda c: F.concat_ws(":", c["number"].cast("string"), c["hash"]))  # fanout at most
        up = level.groupBy("file", F.floor(F.col("number") / fanout).alias("number")).agg(F.min("first").alias("first"), F.max("last").alias("last"), F.sha2(F.array_join(children, ","), 256).alias("hash"))
        level = common.stage(up.select("file", F.lit(depth).alias("level"), "number", "first", "last", "hash"), f"level{depth}", keep=True)
        nodes = nodes.unionByName(level)
    return nodes


def audit(ours: DataFrame, theirs: DataFrame, fanout: int = FANOUT, levels: int = LEVELS) -> tuple[DataFrame, list[int]]:
    """((file, leaf, first, last) of leaves that differ or exist on one side, staged; nodes compared at each level from the roots down)."""
    compared, open_nodes = [], None
    for level in range(levels, -1, -1):
        sides = []
        for nodes, side in ((ours, "a"), (theirs, "b")):
            part = nodes.filter(F.col("level") == level)
            if open_nodes is not None:
                part = part.withColumn("parent", F.floor(F.col("number") / fanout)).join(open_nodes, ["file", "parent"], "left_semi")
            sides.append(part.select("file", "number", F.col("first").alias(f"first_{side}"), F.col("last").alias(f"last_{side}"), F.col("hash").alias(side)))
        met = common.stage(sides[0].join(sides[1], ["file", "number"], "full"), f"met{level}", keep=not level)
        compared.append(met.count())
        bad = met.filter(~F.col("a").eqNullSafe(F.col("b")))
        open_nodes = bad.select("file", F.col("number").alias("parent"))
    return bad.select("file", F.col("number").alias("leaf"), F.coalesce("first_a", "first_b").alias("first"), F.coalesce("last_a", "last_b").alias("last")), compared


def check_replica(pages: DataFrame, replica: DataFrame, fanout: int = FANOUT) -> DataFrame:
    """(page_id, file, number, offset, length, digest, corrupt): the records of pages, corrupt where the replica lacks them; of copies that it lacks some of, the last.

    Records of pages that only the replica has follow, corrupt, with their place there. Pages without an id are told
    apart by content alone: a changed one is corrupt here and follows from there.
    """
    spark = pages.sparkSession
    with common.scratch(spark):
        ours, theirs = (common.stage(archive(p), n) for p, n in ((pages, "ours"), (replica, "theirs")))
        bad, _ = audit(tree(ours, fanout), tree(theirs, fanout), fanout)
        content = ["file", "leaf", "page_id", "length", "digest"]
        in_bad = lambda records, n, *more: records.join(bad.select("file", "leaf"), ["file", "leaf"], "left_semi").select(*[F.col(c).alias(f"{n}_{c}") for c in (*content, "copies", *more)])
        equal = lambda a, b: reduce(lambda x, y: x & y, [F.col(f"{a}{c}").eqNullSafe(F.col(f"{b}{c}")) for c in content])
        a, b = in_bad(ours, "a"), in_bad(theirs, "b", "offset", "number")
        lacking = a.join(b, equal("a_", "b_"), "left").filter(F.coalesce("b_copies", F.lit(0)) < F.col("a_copies")).select(*[c for c in a.columns if c != "a_copies"], F.coalesce("b_copies", F.lit(0)).alias("_there"))
        lacking = common.stage(lacking, "lacking")
        known = ours.join(lacking, equal("", "a_"), "left").withColumn("_copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)))
        place = lambda n: [(F.col(f"{n}number") + F.col("_copy")).alias("number"), (F.col(f"{n}offset") + F.col("_copy") * F.col(f"{n}length")).alias("offset")]
        out = known.select("page_id", "file", *place(""), "length", "digest", (F.col("_copy") >= F.coalesce("_there", F.col("copies"))).alias("corrupt"))
        extra = b.join(a, equal("a_", "b_"), "left_anti").join(ours.select(F.col("page_id").alias("_p")).distinct(), F.col("b_page_id") == F.col("_p"), "left_anti")
        extra = extra.withColumn("_copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("b_copies") - 1)))
        extra = extra.select(F.col("b_page_id").alias("page_id"), F.col("b_file").alias("file"), *place("b_"), F.col("b_length").alias("length"), F.col("b_digest").alias("digest"), F.lit(True).alias("corrupt"))
        return common.stage(out.union(extra), "audited", keep=True)


def placed(records: DataFrame) -> DataFrame:
    """An index of records(file, page_id, offset, length, digest) as tree() takes it: a leaf for each BLOCK bytes of a file, with the records that start there."""
    leaf = F.floor(F.col("offset") / BLOCK).cast("long")
    return records.select("file", leaf.alias("leaf"), "page_id", F.col("offset").cast("long").alias("offset"), (F.col("offset") - leaf * BLOCK).cast("long").alias("within"), F.col("length").cast("long").alias("length"), "digest", F.lit(1).cast("long").alias("copies"))


def differences(ours: DataFrame, theirs: DataFrame, fanout: int = FANOUT) -> DataFrame:
    """(file, page_id, offset, length, digest, state): records of two indexes(file, page_id, offset, length, digest) that differ; those in their places are left out.

    state is lost (no record of that page and file is left over in theirs), changed (one of another digest or length is),
    extra (only theirs has it; its own place there), shifted (same record, other offset, in order) or moved (same record, at another turn among
    the records that both have in the leaves that differ). Of equal records the first in ours goes with the first in theirs.
    Rows without an offset or file take no part. Other columns are left out.
    """
    spark, content = ours.sparkSession, ["file", "page_id", "length", "digest"]
    equal = lambda x, y, names: reduce(lambda p, q: p & q, [F.col(f"{x}{c}").eqNullSafe(F.col(f"{y}{c}")) for c in names])
    named = lambda rows, n: rows.select(*[F.col(c).alias(f"{n}{c}") for c in rows.columns])
    with common.scratch(spark):
        sides = [common.stage(placed(r.filter("file is not null and offset is not null")), n) for r, n in ((ours, "ours"), (theirs, "theirs"))]
        deepest = sides[0].select("leaf").union(sides[1].select("leaf")).agg(F.max("leaf")).first()[0] or 0
        levels = next(k for k in range(64) if fanout**k > deepest)
        bad, _ = audit(*(tree(r, fanout, levels) for r in sides), fanout, levels)
        a, b = (r.join(bad.select("file", "leaf"), ["file", "leaf"], "left_semi").select(*content, "offset") for r in sides)

        def turns(rows: DataFrame, name: str) -> DataFrame:  # which of its equals each is, by offset, without a task for all equals
            ranked = common.stage(common.global_rank(rows, *map(F.col, content), F.col("offset")), name)
            start = named(ranked.groupBy(*content).agg(F.min("rank").alias("start")), "s_")
            return ranked.join(start, equal("", "s_", content)).select(*content, "offset", (F.col("rank") - F.col("s_start")).alias("turn"))

        a, b = named(turns(a, "a"), "a_"), named(turns(b, "b"), "b_")
        met = common.stage(a.join(b, equal("a_", "b_", [*content, "turn"]), "full"), "met")
        both = met.filter("a_offset is not null and b_offset is not null")
        order = common.global_rank(common.global_rank(both, F.col("a_file"), F.col("a_offset")).withColumnRenamed("rank", "_ours"), F.col("a_file"), F.col("b_offset"))
        own = [F.col(f"a_{c}").alias(c) for c in ("file", "page_id", "offset", "length", "digest")]
        out = order.filter("a_offset <> b_offset").select(*own, F.when(F.col("rank") == F.col("_ours"), "shifted").otherwise("moved").alias("state"))
        lone_a, lone_b = met.filter("b_offset is null"), met.filter("a_offset is null")
        ids = lambda rows, n, to: rows.select(F.col(f"{n}_file").alias(f"{to}file"), F.col(f"{n}_page_id").alias(f"{to}page_id")).distinct().withColumn(f"{to}there", F.lit(True))
        gone = lone_a.join(ids(lone_b, "b", "t_"), equal("a_", "t_", ["file", "page_id"]), "left").select(*own, F.when(F.col("t_there"), "changed").otherwise("lost").alias("state"))
        more = lone_b.join(ids(lone_a, "a", "t_"), equal("b_", "t_", ["file", "page_id"]), "left_anti").select(*[F.col(f"b_{c}").alias(c) for c in ("file", "page_id", "offset", "length", "digest")], F.lit("extra").alias("state"))
        return common.stage(out.union(gone).union(more), "differences", keep=True)


def op3_warc_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Audit the archive of all pages against a replica in which every page whose id is 5 mod 97 has its first byte changed."""
    pages = common.table(spark, sf_dir, "pages").select("page_id", "url", "html")
    harmed = F.concat(F.lit("#"), F.substring("html", F.lit(2), F.length("html")))
    replica = pages.withColumn("html", F.when(F.col("page_id") % 97 == 5, harmed).otherwise(F.col("html")))
    return check_replica(pages, replica)


ORACLE = r"""
WITH r AS (SELECT page_id, html, page_id // 100 AS file,
                  'WARC/1.0' || chr(13) || chr(10) || 'WARC-Type: resource' || chr(13) || chr(10) || 'WARC-Target-URI: ' || coalesce(url, '') || chr(13) || chr(10)
                  || 'Content-Length: ' || strlen(coalesce(html, ''))::varchar || chr(13) || chr(10) || chr(13) || chr(10) || coalesce(html, '') || chr(13) || chr(10) || chr(13) || chr(10) AS t FROM pages),
d AS (SELECT *, strlen(t)::bigint AS length, sha256(t) AS digest FROM r)
SELECT page_id, file, row_number() OVER o - 1 AS number,
       coalesce(sum(length) OVER (PARTITION BY file ORDER BY page_id, digest ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::bigint AS "offset",
       length, digest, coalesce(page_id % 97 = 5 AND left(html, 1) <> '#', false) AS corrupt
FROM d WINDOW o AS (PARTITION BY file ORDER BY page_id, digest)
"""
