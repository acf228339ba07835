"""Canonical exact digests: normalise, fold, hash wide, compare bytes inside equal buckets."""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Callable
from functools import cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Buckets with several members whose keys are broadcast; beyond it they are joined by shuffle.
BROADCAST_BUCKETS = 1_000_000
#: White space that compatibility decomposition does not already turn into a plain space.
SPACES = r"[\s\x1C-\x1F\x85   ]+"
HANGUL = 0xAC00
#: Cherokee, whose folds are its capital letters.
UPWARD = r"[\x{13A0}-\x{13FF}\x{AB70}-\x{ABBF}]"
#: Maps to which the characters of a table are dealt.
BUCKETS = 256
#: The mark whose case fold is a letter; it is folded after marks are put in order.
IOTA_BELOW, IOTA = "\u0345", "\u03B9"


@cache
def _folds() -> tuple[list[str], list[str]]:
    """Characters that folding changes and what they become: NFKD(casefold(NFKD(c))), by Unicode's own tables.

    ASCII is left to lower(), Hangul syllables to arithmetic.
    """
    fold = lambda text: "".join(c if c == IOTA_BELOW else c.casefold() for c in unicodedata.normalize("NFKD", text))
    keys, values = [], []
    for code in range(0x80, 0x110000):
        if HANGUL <= code < HANGUL + 11172 or 0xD800 <= code < 0xE000:
            continue
        char = chr(code)
        folded = unicodedata.normalize("NFKD", fold(char))
        if folded != char:
            keys.append(char)
            values.append(folded)
    return keys, values


def _char_class(chars: list[str]) -> str:
    """A Java character class of sorted characters, as ranges."""
    ranges: list[list[int]] = []
    for code in map(ord, chars):
        if ranges and code == ranges[-1][1] + 1:
            ranges[-1][1] = code
        else:
            ranges.append([code, code])
    return "".join(f"\\x{{{a:X}}}" + (f"-\\x{{{b:X}}}" if b > a else "") for a, b in ranges)


@cache
def _marks() -> tuple[str, list[str], list[int]]:
    """Combining marks: their character class, they themselves and their combining classes."""
    chars = [chr(c) for c in range(0x300, 0x110000) if unicodedata.combining(chr(c))]
    return _char_class(chars), chars, [unicodedata.combining(c) for c in chars]


def _looked_up(keys: list[str], values: list) -> Callable[[Column], Column]:
    """Look-up of a character, null where it is not among the keys. One literal, so that the plan does not grow with the table: maps by code point modulo BUCKETS, as a map is searched from its first key to its last."""
    kind = "string" if isinstance(values[0], str) else "int"
    maps: list[dict] = [{} for _ in range(BUCKETS)]
    for key, value in zip(keys, values, strict=True):
        maps[ord(key) % BUCKETS][key] = value
    table = F.from_json(F.lit(json.dumps(maps)), f"array<map<string,{kind}>>")
    return lambda c: F.try_element_at(F.get(table, F.pmod(F.ascii(c), F.lit(BUCKETS))), c)


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), value computed once."""
    return F.element_at(F.transform(F.array(value), then), 1)


def _syllable(char: Column) -> Column:
    """A Hangul syllable's letters, by the standard's arithmetic."""
    place = F.ascii(char) - HANGUL
    part = lambda base, n, i: F.element_at(F.array(*[F.lit(chr(base + k) if base + k != 0x11A7 else "") for k in range(n)]), i.cast("int") + 1)
    return F.concat(part(0x1100, 19, F.floor(place / 588)), part(0x1161, 21, F.floor(place % 588 / 28)), part(0x11A7, 28, place % 28))


def canonical(text: Column) -> Column:
    """NFKD with full case folding and white space runs as one space, trimmed; null as empty.

    Each distinct character that folding changes is replaced once in the whole text;
    runs of combining marks are then put in canonical order.
    """
    keys, values = _folds()
    mark_class, marks, classes = _marks()
    fold, order = _looked_up(keys, values), _looked_up(marks, classes)
    becomes = lambda c: F.when(F.ascii(c).between(HANGUL, HANGUL + 11171), _syllable(c)).otherwise(fold(c))
    others = F.transform(F.array_distinct(F.regexp_extract_all(text, F.lit(r"[^\x00-\x7F]"), 0)), lambda c: F.struct(c.alias("c"), becomes(c).alias("to")))
    folded = F.aggregate(others, text, lambda acc, x: F.when(x["to"].isNull(), acc).otherwise(F.replace(acc, x["c"], x["to"])))
    sort_run = lambda run: F.array_join(F.transform(F.array_sort(F.transform(F.split(run, ""), lambda c, i: F.struct(F.coalesce(order(c), F.lit(0)).alias("k"), i.alias("i"), c.alias("c")))), lambda x: x["c"]), "")

    def ordered(folded: Column) -> Column:
        runs = F.array_distinct(F.regexp_extract_all(folded, F.lit(rf"[[^\x00-\x7F]&&[{mark_class}]]{{2,}}"), 0))
        runs = F.reverse(F.array_sort(F.transform(runs, lambda r: F.struct(F.length(r).alias("n"), r.alias("run")))))
        put = F.aggregate(runs, folded, lambda acc, r: F.replace(acc, r["run"], sort_run(r["run"])))
        return F.when(folded.rlike(r"[^\x00-\x{2FF}]{2}"), put).otherwise(folded)  # marks lie beyond U+02FF; most texts have no two in a row

    full = F.when(text.rlike(r"[^\x00-\x7F]"), F.replace(_let(folded, ordered), F.lit(IOTA_BELOW), F.lit(IOTA))).otherwise(text)
    lower = lambda x: F.when(x.rlike(UPWARD), common.ascii_lower(x)).otherwise(F.lower(x))  # all other letters are folded, so A-Z alone are left
    return F.trim(F.regexp_replace(_let(full, lower), SPACES, " "))


def wide_hash(canon: Column) -> Column:
    """128 bits in hex: xxhash64 under two seeds, which are the hashes of a leading number."""
    return F.concat(*[F.lpad(F.lower(F.hex(F.xxhash64(F.lit(seed), canon))), 16, "0") for seed in (1, 2)])


def digest(text: Column) -> Column:
    return wide_hash(canonical(F.coalesce(text, F.lit(""))))


def unequal_buckets(hashed: DataFrame) -> DataFrame:
    """(digest, canon, place) of hashed(text, digest): the texts of buckets whose members' bytes differ; place counts from 0 by bytes.

    Only texts in buckets with several members are compared, through the least
    and greatest text of each bucket, so no bucket is ever gathered.
    """
    several = hashed.groupBy("digest").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("digest")
    several = common.stage(several, "several")
    if several.count() <= BROADCAST_BUCKETS:
        several = F.broadcast(several)
    members = hashed.join(several, "digest", "left_semi").select("digest", canonical(F.col("text")).alias("canon"))
    differ = members.groupBy("digest").agg(F.min("canon").alias("least"), F.max("canon").alias("most")).filter("least <> most").select("digest")
    differ = common.stage(differ, "differ")
    if differ.isEmpty():
        return differ.select("digest", F.lit("").alias("canon"), F.lit(0).alias("place"))
    texts = members.join(differ, "digest").distinct()
    other = texts.select("digest", F.col("canon").alias("less"))
    return texts.join(other, "digest").groupBy("digest", "canon").agg(F.count_if(F.col("less") < F.col("canon")).cast("int").alias("place"))


def _told_apart(rows: DataFrame, places: DataFrame, text: str, digest_: str, out: str) -> DataFrame:
    """rows with out: the digest, and for texts that share one with other bytes their place in it; those that no row of the buckets has come next."""
    if places.isEmpty():
        return rows.withColumn(out, F.col(digest_))
    of = places.withColumnsRenamed({"digest": "_windrow_digest", "canon": "_windrow_canon", "place": "_windrow_place"})
    met = (F.col(digest_) == F.col("_windrow_digest")) & (canonical(F.coalesce(text, F.lit(""))) == F.col("_windrow_canon"))
    counts = places.groupBy(F.col("digest").alias("_windrow_of")).agg(F.count(F.lit(1)).alias("_windrow_n"))
    joined = rows.join(of, met, "left").join(counts, F.col(digest_) == F.col("_windrow_of"), "left")
    place = F.coalesce("_windrow_place", "_windrow_n", F.lit(0))
    return joined.withColumn(out, F.when(place > 0, F.concat_ws("-", digest_, place)).otherwise(F.col(digest_))).drop("_windrow_digest", "_windrow_canon", "_windrow_place", "_windrow_of", "_windrow_n")


def hashed_texts(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(docs with digest, staged, null texts as empty ones; its unequal_buckets()): the canonical form of each text is made once, and again for members of buckets only."""
    hashed = docs.drop("fingerprint").withColumn("digest", digest(F.col("text")))
    hashed = common.stage(hashed, "hashed", keep=True)
    return hashed, common.stage(unequal_buckets(hashed.select(F.coalesce("text", F.lit("")).alias("text"), "digest")), "places", keep=True)


def fingerprints(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text, ...) with digest, and with fingerprint, which tells equal digests of different bytes apart.

    Two rows have the same fingerprint exactly if their canonical texts are the
    same bytes. Null text counts as empty; repeated rows and null ids are kept;
    other columns pass through, but columns named digest or fingerprint are replaced; an empty table gives none.
    """
    with common.scratch(docs.sparkSession):
        hashed, places = hashed_texts(docs)
    return _told_apart(hashed, places, "text", "digest", "fingerprint")


def successors(docs: DataFrame) -> DataFrame:
    """(doc_id, before, need): doc_id follows before in descending order, the first after the last; need = floor(n_chars of before / 3)."""
    ids = docs.groupBy("doc_id").agg(F.max(F.length(F.coalesce("text", F.lit("")))).cast("long").alias("n"))
    ranked = common.stage(common.global_rank(ids, F.col("doc_id").desc_nulls_last()), "order")
    n = ranked.count()
    nexts = ranked.select(F.col("doc_id"), F.col("rank"))
    return nexts.join(ranked.select(F.col("doc_id").alias("before"), F.floor(F.col("n") / 3).alias("need"), ((F.col("rank") + 1) % max(n, 1)).alias("rank")), "rank").drop("rank")


def op4_canonical_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited(common.table(spark, sf_dir, "documents").select("doc_id", "text"))


def edited(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and of the text with its last third taken from the next document.

    Rows that share a doc_id keep their own texts; as the next document, such
    an id stands for the least of its texts. An edited text that has the digest of
    other bytes is told apart from them like a document's.
    """
    docs = docs.withColumn("text", F.coalesce("text", F.lit("")))
    with common.scratch(docs.sparkSession):
        links = common.stage(successors(docs), "links", keep=True).withColumnRenamed("doc_id", "_id")
        hashed, places = hashed_texts(docs)
    prints = _told_apart(hashed, places, "text", "digest", "fingerprint")
    tails = prints.join(links, F.col("doc_id").eqNullSafe(F.col("_id")), "left")
    tails = tails.select(F.col("before").alias("_id"), F.struct(F.substring("text", F.lit(1), F.col("need").cast("int")).alias("tail"), F.col("fingerprint").alias("next")).alias("t"))
    tails = tails.groupBy("_id").agg(F.min("t").alias("t"))
    out = prints.join(tails, F.col("doc_id").eqNullSafe(F.col("_id")), "left")
    n = F.length("text").cast("long")
    third = F.floor(n / 3).cast("int")
    out = out.withColumns({"n_chars": n, "edited": F.concat(F.substring("text", F.lit(1), (n - third).cast("int")), F.substring("t.tail", F.lit(1), third))})
    out = _told_apart(out.withColumn("edited_digest", digest(F.col("edited"))), places, "edited", "edited_digest", "edited_fingerprint")
    like = lambda other: F.when(F.col("fingerprint") == other, 1.0).otherwise(0.0)
    return out.select("doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint", like(F.col("edited_fingerprint")).alias("near_edited"), like(F.col("t.next")).alias("near_next"))
