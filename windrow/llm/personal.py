"""Personal data: high-recall candidates, boosted trees on format and context, calibrated thresholds.

Four kinds have a fixed format; their valid matches always count. More
generators propose spans that may overlap. Where their own checks (IBAN modulus,
number ranges, cue words) decide, those count; gradient-boosted trees, taught by
what is decided of all kinds, score the others, and those over the threshold of their
kind are added where they overlap nothing of higher standing. A failing match of the
four that lies on another generator's span teaches nothing.
"""

from __future__ import annotations

from functools import reduce

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common

TREES, DEPTH = 12, 3
#: A threshold is the least score, in steps of 0.05, over which this share of the held-out candidates is valid.
PRECISION = 0.95
#: What the held-out candidates of all kinds together weigh, in candidates, beside a kind's own.
PRIOR = 20
#: What a decided candidate of a rare kind weighs at most; of a common one 1 or less.
HEAVIEST = 20.0
#: Characters of context kept on each side of a candidate.
CONTEXT = 24
#: Kinds in order, with their generators. A class that may start a match only where its run starts, or where the last match ended, keeps long runs linear; possessive groups are matched without recursion.
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
MORE = {
    "iban": r"\b[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?\b",
    "local_phone": r"\(?\b[0-9]{2,4}\)?[\x20./-][0-9]{3,4}[\x20./-][0-9]{3,4}\b",
    "masked_email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++\x20?[\[(]\x20?at\x20?[\])]\x20?[A-Za-z0-9-]++(?:(?:\.|\x20?[\[(]\x20?dot\x20?[\])]\x20?)[A-Za-z0-9-]++)++",
    "national_id": r"\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b",
}
KINDS = [*BASE, *MORE]
#: Words that speak of personal data, as a parameter of the context features.
CUES = ("mail", "phone", "tel", "call", "fax", "card", "visa", "iban", "account", "ssn", "social", "ip", "host", "contact")
#: Words that speak of other numbers.
OTHER_CUES = ("version", "isbn", "section", "license", "issue", "page", "release")
#: National ids that can have been given out.
IN_RANGE = r"^(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}$"
#: What names a kind in the context, for its own check.
NAMED = {"local_phone": r"phone|\btel\b|\bcall\b|\bfax\b|mobile", "national_id": r"\bssn\b|social security|national id"}


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    doubled = F.transform(F.split(F.reverse(digits), ""), lambda c, i: c.try_cast("int") * (1 + i % 2))
    return F.aggregate(F.transform(doubled, lambda v: v - F.when(v > 9, 9).otherwise(0)), F.lit(0), lambda a, v: a + v) % 10 == 0


def _octets(text: Column) -> Column:
    """Whether all parts are at most 255; leading zeros do not count."""
    return F.forall(F.split(text, r"\."), lambda p: F.length(F.ltrim(p, F.lit("0"))) <= F.when(F.ltrim(p, F.lit("0")).rlike("^(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])?$"), 3).otherwise(-1))


def valid(kind: Column, match: Column) -> Column:
    n = F.length(_digits(match))
    return (
        F.when(kind == "email", True)
        .when(kind == "ip", _octets(match))
        .when(kind == "card", n.between(13, 19) & luhn(_digits(match)))
        .when(kind == "phone", n.between(9, 15))
        .otherwise(False)
    )


def _mod_97(match: Column) -> Column:
    plain = F.replace(match, F.lit(" "))
    turned = F.split(F.concat(F.substr(plain, F.lit(5)), F.substr(plain, F.lit(1), F.lit(4))), "")
    value = lambda c: F.conv(c, 36, 10).cast("int")
    return F.length(plain).between(15, 34) & (F.aggregate(turned, F.lit(0), lambda a, c: (a * F.when(value(c) > 9, 100).otherwise(10) + value(c)) % 97) == 1)


def decided(kind: Column, match: Column, near: Column) -> Column:
    """What the own check of a generator beyond the four says of a match: true, false, or null where it cannot tell."""
    n, other = F.length(_digits(match)), reduce(lambda x, y: x | y, [F.contains(near, F.lit(w)) for w in OTHER_CUES])
    named = {k: near.rlike(p) for k, p in NAMED.items()}
    return (
        F.when(kind == "iban", _mod_97(match))
        .when(kind == "masked_email", F.when(match.rlike(r"[A-Za-z]{2,}$"), True))
        .when((kind == "national_id") & ~match.rlike(IN_RANGE), False)
        .when((kind == "local_phone") & ~n.between(9, 15), F.when(n < 7, False))
        .when((kind == "national_id") & named["national_id"] | (kind == "local_phone") & named["local_phone"], True)
        .when(kind.isin("national_id", "local_phone") & other, False)
    )


def _same(o: str) -> Column:
    """Whether a span overlaps one of the same text, as _other() names it."""
    return F.col("doc_id").eqNullSafe(F.col(f"{o}_d")) & F.col("_key").eqNullSafe(F.col(f"{o}_k")) & (F.col("start") < F.col(f"{o}_end")) & (F.col(f"{o}_start") < F.col("end"))


def _other(spans: DataFrame, o: str, *more: Column) -> DataFrame:
    return spans.select(*(F.col(c).alias(f"{o}_{n}") for c, n in (("doc_id", "d"), ("_key", "k"), ("start", "start"), ("end", "end"))), *more)


def candidates(docs: DataFrame) -> DataFrame:
    """(doc_id, _key, kind, match, start, end, before, after): every match of every generator; places in code points, end exclusive.

    Places are running sums of the lengths of matches and of what lies between them.
    """
    text = F.col("text")
    has_digit, has_at = text.rlike("[0-9]"), F.contains(text, F.lit("@"))
    guard = {"email": has_at, "masked_email": text.rlike(r"[\[(]\x20?at\x20?[\])]")}
    parts = []
    for kind, pattern in (BASE | MORE).items():
        found = F.regexp_extract_all(text, F.lit(pattern), 0)
        gaps = F.transform(F.split(text, pattern, -1), lambda g: F.struct(F.length(g).alias("n"), F.substring(g, -CONTEXT, CONTEXT).alias("right"), F.substring(g, 1, CONTEXT).alias("left")))
        parts.append(F.when(guard.get(kind, has_digit) & text.rlike(pattern), F.struct(F.lit(kind).alias("kind"), found.alias("found"), gaps.alias("gaps"))))
    per_kind = F.filter(F.array(*parts), lambda p: p.isNotNull())
    read = docs.select("doc_id", "text").filter(has_digit | guard["email"] | guard["masked_email"]).select("doc_id", common.text_key(text).alias("_key"), F.explode(per_kind).alias("p"))
    read = read.select("doc_id", "_key", "p.kind", "p.found", "p.gaps").dropDuplicates(["doc_id", "_key", "kind"])
    steps = F.transform("found", lambda m, i: F.struct(m.alias("match"), F.element_at("gaps", i + 1).alias("gap"), F.element_at("gaps", i + 2)["left"].alias("after")))
    each = read.select("doc_id", "_key", "kind", F.posexplode(steps).alias("at", "x"))
    size = F.length("x.match")
    upto = Window.partitionBy("doc_id", "_key", "kind").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    each = each.withColumn("end", F.sum(F.col("x.gap.n") + size).over(upto).cast("long"))
    return each.select("doc_id", "_key", "kind", F.col("x.match").alias("match"), (F.col("end") - size).cast("long").alias("start"), "end", F.col("x.gap.right").alias("before"), F.col("x.after").alias("after"))


def _features(rows: DataFrame) -> tuple[DataFrame, list[str]]:
    match, digits = F.col("match"), _digits(F.col("match"))
    near = F.lower(F.concat_ws(" ", "before", "after"))
    count = lambda pattern: F.regexp_count(match, F.lit(pattern))
    has = lambda words: F.size(F.filter(F.array(*map(F.lit, words)), lambda w: F.contains(near, w)))
    made = {
        "length": F.length(match),
        "digits": F.length(digits),
        "letters": count("[A-Za-z]"),
        "dots": count(r"\."),
        "dashes": count("-"),
        "spaces": count(" "),
        "plus": F.startswith(match, F.lit("+")),
        "paren": F.contains(match, F.lit("(")),
        "at": F.contains(match, F.lit("@")) | F.lower(match).rlike(r"[\[(] ?at"),
        "groups": count("[0-9]+"),
        "longest": F.coalesce(F.array_max(F.transform(F.regexp_extract_all(match, F.lit("[0-9]+"), 0), lambda x: F.length(x))), F.lit(0)),
        "kinds_of_digit": F.size(F.array_distinct(F.split(digits, ""))),
        "sums_up": F.length(digits).between(12, 19) & F.coalesce(luhn(digits), F.lit(False)),
        "small_parts": (F.size(F.split(match, r"\.")) == 4) & _octets(match),
        "glued": F.col("before").rlike(r"[A-Za-z0-9_]$") | F.col("after").rlike(r"^[A-Za-z0-9_]"),
        # the words that name a kind make its labels 1 and are no feature of it: what is left to score lacks them
        "cues": F.when(F.col("kind").isin(*NAMED), 0).otherwise(has(CUES)),
        "other_cues": has(OTHER_CUES),
        "in_range": match.rlike(IN_RANGE),
        **{f"is_{k}": F.col("kind") == k for k in KINDS},
    }
    return rows.withColumns({f"f_{k}": v.cast("double") for k, v in made.items()}), [f"f_{k}" for k in made]


def _decided(found: DataFrame) -> DataFrame:
    """found with label (double): 1 or 0 where a check decides, null elsewhere.

    Parts of a valid phone number are phone numbers, parts of a valid match of
    another of the four are not. Failing matches of the four that overlap a span of
    another generator that may hold have no label.
    """
    near = F.lower(F.concat_ws(" ", "before", "after"))
    base = F.col("kind").isin(*BASE)
    rows = common.stage(found.withColumn("own", F.when(base, F.col("valid")).otherwise(decided(F.col("kind"), F.col("match"), near))), "checked")
    spans = ["doc_id", "_key", "start", "end", "kind"]
    hold = _other(rows.filter(base & F.col("own")), "b", F.col("kind").alias("b_kind"))
    inside = rows.filter(~base).join(hold, _same("b")).groupBy(*spans).agg(F.max(F.col("b_kind") == "phone").alias("told"), F.lit(False).alias("unsure"))
    may = _other(rows.filter(~base & F.coalesce("own", F.lit(True))), "m")
    unsure = rows.filter(base & ~F.col("own")).select(*spans).join(may, _same("m"), "left_semi").select(*spans, F.lit(None).cast("boolean").alias("told"), F.lit(True).alias("unsure"))
    seen = inside.union(unsure).withColumnsRenamed({c: f"s_{c}" for c in spans})
    rows = rows.join(seen, reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(f"s_{c}")) for c in spans]), "left")
    label = F.when(F.col("unsure"), None).when((F.col("kind") == "local_phone") & F.col("told").isNotNull(), F.col("told")).otherwise(F.col("own"))
    return rows.withColumn("label", label.cast("double")).drop("own", "told", "unsure", *[f"s_{c}" for c in spans])


def _thresholds(bins: list) -> dict[str, float]:
    """By kind, from bins (kind, bin, good, n): the least score over which a kind's own candidates, with PRIOR more as all kinds' are, hold the precision; 1 where nothing is held out."""
    out, total = {}, sum(r["n"] for r in bins)
    for kind in MORE:
        threshold, good, n = 1.0, 0.0, 0.0
        for k in sorted({r["bin"] for r in bins}, reverse=True):
            for r in bins:
                if r["bin"] == k:
                    weight = (r["kind"] == kind) + PRIOR / total
                    good, n = good + weight * r["good"], n + weight * r["n"]
            if good < PRECISION * n:
                break
            threshold = max(k / 20, 0.5)
        out[kind] = threshold
    return out


def _selected(found: DataFrame, seed: int = 8) -> DataFrame:
    """The candidates of the other generators that hold by their own checks, with score 1, and those that the trees select, with theirs.

    Trees are fitted on all decided candidates of three texts in four, thresholds are counted on all of the fourth.
    """
    rows, names = _features(common.stage(_decided(found), "decided"))
    rows = VectorAssembler(inputCols=names, outputCol="features").transform(rows.fillna(0.0, names))
    more, spans = rows.filter(~F.col("kind").isin(*BASE)), ["doc_id", "_key", "kind", "start", "end"]
    sure = more.filter("label = 1").select(*spans, F.lit(1.0).alias("score"))
    known = rows.filter("label is not null")
    counts = {(r["kind"], r["label"]): r["n"] for r in known.groupBy("kind", "label").agg(F.count(F.lit(1)).alias("n")).collect()}  # two rows a kind
    of = lambda label: [n for (_, k), n in counts.items() if k == label]
    if not of(0.0) or not of(1.0) or more.filter("label is null").isEmpty():  # nothing to learn from, or nothing to score
        return sure
    even = {label: sum(counts.values()) / 2 / len(of(label)) for label in (0.0, 1.0)}  # each kind weighs the same share of a label's half
    most = {label: max(min(n, even[label]) for n in of(label)) for label in (0.0, 1.0)}
    weight = reduce(lambda w, c: w.when((F.col("kind") == c[0]) & (F.col("label") == c[1]), F.lit(float(min(most[c[1]] / counts[c], HEAVIEST)))), counts, F.when(F.lit(False), 0.0))
    known = common.stage(known.withColumn("weight", weight).select("doc_id", "kind", "label", "weight", "features"), "known")
    held_out = F.coalesce(F.pmod(F.xxhash64("doc_id"), F.lit(4)) == 0, F.lit(False))
    fitted = known.filter(~held_out)
    if fitted.select("label").distinct().count() < 2:
        return sure
    model = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, seed=seed, stepSize=0.3, weightCol="weight").fit(fitted)
    score = vector_to_array("probability")[1]
    thresholds = _thresholds(model.transform(known.filter(held_out)).groupBy("kind", F.floor(score * 20).alias("bin")).agg(F.sum("label").alias("good"), F.count(F.lit(1)).alias("n")).collect())  # 21 rows a kind at most
    least = reduce(lambda w, k: w.when(F.col("kind") == k, F.lit(thresholds[k])), MORE, F.when(F.lit(False), 1.0))
    open_ = model.transform(more.filter("label is null")).withColumn("score", score).filter(F.col("score") >= least)
    return sure.union(open_.select(*spans, "score"))


def chosen(found: DataFrame) -> DataFrame:
    """(doc_id, _key, kind, start, end) of found(doc_id, _key, kind, start, end, score): the best scored of those that overlap, then the longer, then the first, and those that overlap none that is chosen.

    Stretches of a text whose spans form a chain are told apart first; each chain is gone through once, best first.
    """
    before = Window.partitionBy("doc_id", "_key").orderBy("start", "end")
    reach = F.max("end").over(before.rowsBetween(Window.unboundedPreceding, -1))
    chain = found.withColumn("_new", F.when(F.col("start") < reach, 0).otherwise(1)).withColumn("_chain", F.sum("_new").over(before.rowsBetween(Window.unboundedPreceding, 0)))
    rank = F.struct((-F.col("score")).alias("s"), (F.col("start") - F.col("end")).alias("n"), "start", "kind", "end")
    overlap = lambda x, y: (x["start"] < y["end"]) & (y["start"] < x["end"])
    kind = "array<struct<s:double,n:bigint,start:bigint,kind:string,end:bigint>>"
    greedy = lambda xs: F.aggregate(xs, F.array().cast(kind), lambda kept, x: F.when(F.exists(kept, lambda y: overlap(x, y)), kept).otherwise(F.concat(kept, F.array(x))))
    ranked = chain.groupBy("doc_id", "_key", "_chain").agg(F.sort_array(F.collect_list(rank)).cast(kind).alias("_ranked"))  # spans of one stretch of a text
    return ranked.select("doc_id", "_key", F.explode(greedy(F.col("_ranked"))).alias("x")).select("doc_id", "_key", "x.kind", "x.start", "x.end")


def spans(docs: DataFrame) -> DataFrame:
    """(doc_id, _key, kind, start, end, base): the valid matches of the four kinds, and what checks and trees add.

    Added spans overlap no base span; of added spans that overlap each other, chosen() says which stay.
    """
    found = common.stage(candidates(docs).withColumn("valid", valid(F.col("kind"), F.col("match"))), "candidates")
    base = found.filter("valid").select("doc_id", "_key", "kind", "start", "end", F.lit(True).alias("base"))
    left = _selected(found).join(_other(base, "b"), _same("b"), "left_anti")
    return base.union(chosen(left).withColumn("base", F.lit(False)))


def report(docs: DataFrame) -> DataFrame:
    """Per row of docs: doc_id, counts of the four kinds, digest of their spans, all spans as kind:start:end by kind and start.

    Null texts are empty. Repeated rows get the same result each; rows that
    share only their doc_id are told apart by their texts.
    """
    with common.scratch(docs.sparkSession):
        found = spans(docs)
        rank = reduce(lambda w, k: w.when(F.col("kind") == k[1], k[0]), list(enumerate(KINDS)), F.when(F.lit(False), 0))
        written = lambda xs: F.array_join(F.transform(F.sort_array(xs), lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
        one = F.struct(rank.alias("rank"), "start", "end", "kind")
        # a document's spans
        per = found.groupBy("doc_id", "_key").agg(
            *[F.count_if((F.col("kind") == k) & F.col("base")).alias(f"n_{k}") for k in BASE],
            F.sha2(written(F.collect_list(F.when(F.col("base"), one))).cast("binary"), 256).alias("base_sha256"),
            written(F.collect_list(one)).alias("spans"),
        )
        per = per.withColumnsRenamed({"doc_id": "_d", "_key": "_k"})
        key = docs.select("doc_id", common.text_key(F.col("text")).alias("_key"))
        out = key.join(per, F.col("doc_id").eqNullSafe(F.col("_d")) & F.col("_key").eqNullSafe(F.col("_k")), "left")
        out = out.select("doc_id", *[F.coalesce(f"n_{k}", F.lit(0)).cast("long").alias(f"n_{k}") for k in BASE], F.coalesce("base_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("base_sha256"), F.coalesce("spans", F.lit("")).alias("spans"))
        return common.stage(out, "report", keep=True)


def op8_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(common.table(spark, sf_dir, "documents").select("doc_id", "text"))
