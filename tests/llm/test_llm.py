"""Training-data operators against brute force, on real texts and on edges."""

from __future__ import annotations

import hashlib
import math
from collections import Counter
from zlib import crc32

import brute
import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from windrow.llm import common, decontaminate, digest, fixity, jaccard, language, lines, mixing, personal, pitman_yor, queries, seating, toxicity, words

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, source string, n_chars long"


@pytest.fixture(scope="module")
def documents(spark):
    return common.stage(spark.read.parquet(f"{SF}/documents.parquet").coalesce(2), "documents")


@pytest.fixture(scope="module")
def texts(documents):
    return [(r["doc_id"], r["text"]) for r in documents.collect()]


@pytest.fixture(scope="module")
def benchmark(spark):
    return [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]


def odd(spark):
    """Null, empty, blank, repeated and long rows, a null id, and columns named as results."""
    long = " ".join(f"w{i % 977}" for i in range(20_000))
    rows = [(1, None), (2, ""), (3, " \n\t "), (4, "one two three four five six"), (4, "one two three four five six"), (5, "ONE two three four five six"), (6, long), (7, long + " tail"), (None, "stray words here"), (8, "x@y.zz +49 170 1234567 4111 1111 1111 1111 10.0.0.256 10.0.0.25")]
    return spark.createDataFrame([(i, t, "s", 0) for i, t in rows], DOCS).withColumns({"key": F.lit(1), "score": F.lit("x"), "size": F.lit("y"), "rank": F.lit(0), "n_lines": F.lit(-1)})


def nothing(spark):
    return odd(spark).limit(0)


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_matches_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    df = queries.queries()[name](spark, SF)
    got = sorted((tuple(r[c] for c in sorted(df.columns)) for r in df.collect()), key=str)
    asked = con.execute(queries.oracle_sql()[name])
    names = [d[0] for d in asked.description]
    want = sorted((tuple(r[names.index(c)] for c in sorted(names)) for r in asked.fetchall()), key=str)
    assert sorted(df.columns) == sorted(names) and got == want


def test_word_hashes_follow_the_pattern():
    rows = ["A b c  D", None, "", "x" * 50, "a\x0bb \x1cc"]
    h, bounds = words.hashed(pa.array(rows))
    assert np.diff(bounds).tolist() == [len(brute.tokens(t)) for t in rows]
    assert h[0] == words.hashed(pa.array(["a"]))[0][0]


def bigrams(rows):
    """{context: {word: count}} with None as the end, before a text and after it."""
    out = {}
    for _, t in rows:
        w = [None, *brute.tokens(t), None]
        for u, x in zip(w, w[1:], strict=False):
            out.setdefault(u, Counter())[x] += 1
    return out


def code(model, word):
    h = np.uint64(0) if word is None else words.hashed(pa.array([word]))[0][0]
    return int(model.head.codes(np.array([h], np.uint64))[0])


def test_op1_is_brute_force(spark, documents, texts):
    held = lambda i: crc32(str(i).encode()) % 7 == 2
    docs = documents.select("doc_id", "text").withColumn("learnt", (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7) != 2)
    model = pitman_yor.train(docs.filter("learnt"), head=500, bucket_tokens=20_000, shards=16)
    got = {r["doc_id"]: r for r in pitman_yor.score(docs, model, "learnt").collect()}
    again = {r["doc_id"]: r["score"] for r in pitman_yor.score(docs, model).collect()}
    learnt = [(i, t) for i, t in texts if not held(i)]
    c = Counter(w for i, t in learnt for w in [*brute.tokens(t), None])
    n, v = sum(c.values()), len(c)
    cells = bigrams(learnt)
    codes = {w: code(model, w) for w in [*c, *(w for _, t in texts for w in brute.tokens(t))]}
    seats, totals = {}, {}
    for r in model.seats.collect():
        totals[r["u"]] = np.array(r["totals"])
        seats |= {(r["u"], w): m for w, m in zip(r["w"], r["mean"], strict=True)}
    s, d, d0 = len(model.parents), model.discount, model.root_discount

    def parent(w, k):
        inside, customers, new = model.tail[k]
        if codes[w] >= 0:
            return model.parents[k][codes[w]]
        known = max(c[w] * inside / model.tail_tokens - d0, 1e-9) / (1 + customers) if c[w] else 0.0
        return known + new / (v + 1)

    def probability(u, w):
        own = cells.get(u, Counter())
        size, x = sum(own.values()), own[w]
        t = seats[codes[u], codes[w]] if x > 1 else float(x)
        mass = totals.get(codes[u], np.full(s, sum(k == 1 for k in own.values())))
        of_parent = lambda k: model.tail_mean(k) if x and codes[w] < 0 else parent(w, k)
        return np.mean([(x - d * t) / (1 + size) + (1 + d * mass[k]) / (1 + size) * of_parent(k) for k in range(s)])

    for i, t in texts:
        w = [None, *brute.tokens(t), None]
        r = got[i]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(w) - 1, sum(c[x] > 0 for x in w[1:]), n)
        assert math.isclose(r["base_score"], sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w[1:]), rel_tol=1e-9)
        want = sum(math.log10(probability(u, x)) for u, x in zip(w, w[1:], strict=False))
        assert math.isclose(r["score"], want, rel_tol=1e-3, abs_tol=1e-6) and math.isclose(r["score"], again[i], rel_tol=1e-9)
    total = lambda k, ids: sum(got[i][k] for i in ids)
    unseen = [i for i, _ in texts if held(i)]
    assert total("score", unseen) > 0.9 * total("base_score", unseen)
    # the parent's probabilities add up to one over the known words and the unknown, and a context's do
    everything = [sum(parent(w, k) for w in c) + model.tail[k][2] / (v + 1) for k in range(s)]
    assert everything == pytest.approx([1] * s, abs=1e-6)
    for u in [None, *[w for w, _ in c.most_common(3) if w is not None]]:
        unknown = np.mean([(1 + d * totals[codes[u]][k]) / (1 + sum(cells[u].values())) * model.tail[k][2] / (v + 1) for k in range(s)])
        assert sum(probability(u, w) for w in c) + unknown == pytest.approx(1, abs=0.02)  # rare words that are seated take the mean of rare words from the parent


def test_op1_tables_follow_their_posterior():
    rng = np.random.default_rng(0)

    def mean_tables(c, d, others, p):
        logs = np.full((c + 1, c + 2), -np.inf)
        logs[1, 1] = 0
        for k in range(1, c):
            t = np.arange(1, c + 2)
            with np.errstate(divide="ignore", invalid="ignore"):
                logs[k + 1, 1:] = np.logaddexp(logs[k, :-1], np.where(k - d * t > 0, logs[k, 1:] + np.log(np.maximum(k - d * t, 1e-300)), -np.inf))
        w = logs[c, 1 : c + 1] + np.cumsum([math.log(1 + d * (others + k)) + math.log(p) for k in range(c)])
        w = np.exp(w - w.max())
        return float((w * np.arange(1, c + 1)).sum() / w.sum())

    for c, d, others, p in ((2, 0.5, 0, 0.3), (20, 0.5, 0, 0.3), (100, 0.7, 2, 0.3), (100, 0.7, 50, 0.01), (200, 0.8, 5, 0.1), (700, 0.6, 30, 0.2), (700, 0.6, 3000, 0.02)):
        drawn = seating.draw(np.full(20_000, c), np.full(20_000, float(others)), np.full(20_000, p), 1.0, d, rng)
        assert drawn.mean() == pytest.approx(mean_tables(c, d, others, p), rel=0.02)
    assert seating._row(4000, 0.6)[:20] == pytest.approx(_further(0.6), rel=1e-3)


def _further(d):
    """Ratios of Stirling numbers for 4,000 customers, carried on from the last exact row."""
    row, t = seating._row(seating.EXACT, d).copy(), np.arange(1, seating.TABLES + 1)
    for c in range(seating.EXACT, 4000):
        row = row * (c - d * t) / (c - d) + np.append(0, row[:-1]) / (c - d)
    return row[:20]


def test_op1_edges(spark):
    model = pitman_yor.train(nothing(spark), head=10)
    out = pitman_yor.score(odd(spark), model).collect()
    assert len(out) == 10 and all(math.isfinite(r["score"]) for r in out)
    trained = pitman_yor.score(odd(spark).withColumn("learnt", F.lit(True)), pitman_yor.train(odd(spark), head=10), "learnt")
    rows = trained.collect()
    assert len(rows) == 10 and "learnt" in trained.columns and len({r["score"] for r in rows if r["doc_id"] == 4}) == 1
    assert pitman_yor.score(nothing(spark), model).count() == 0


def test_op2_edges(spark):
    tests = spark.createDataFrame([(1, None), (2, ""), (3, "two three four"), (3, "stray words"), (4, " ".join(f"w{i}" for i in range(12)))], "item_id long, text string")
    items = [(r["item_id"], r["text"]) for r in tests.collect()]
    out = decontaminate.measure(odd(spark), tests).collect()
    assert len(out) == 10
    by = {(r["doc_id"], r["text"]): brute.contaminated(r["text"], items) for r in odd(spark).collect()}
    want = sorted(((i or 0, n, h, d) for (i, _), (n, h, _, d) in [*by.items(), *[x for x in by.items() if x[0][0] == 4]]))
    assert sorted((r["doc_id"] or 0, r["n_words"], r["n_hit"], r["items_sha256"]) for r in out) == want
    assert decontaminate.measure(nothing(spark), tests).count() == 0
    assert decontaminate.decontaminate(odd(spark), tests).columns == odd(spark).columns


def test_op3_finds_the_harmed_and_the_missing(spark):
    pages = spark.createDataFrame([(i, f"u{i}", f"<p>{i}</p>") for i in range(250)] + [(None, None, None), (7, "u7", "<p>7</p>"), (7, "u7", "<p>7</p>"), (9, "u9", "x" * 300_000)], "page_id long, url string, html string").withColumn("file", F.lit("x"))
    replica = pages.withColumn("html", F.when(F.col("page_id") == 3, F.lit("?")).when(F.col("page_id") == 140, F.concat("html", F.lit("longer"))).otherwise(F.col("html"))).filter("coalesce(page_id, -1) <> 200")
    replica = replica.union(spark.createDataFrame([(900, "u", "new", "x")], replica.schema))
    out = fixity.check_replica(pages, replica)
    assert {r["page_id"] for r in out.filter("corrupt").collect()} == {3, 140, 200, 900} and out.count() == 255
    fewer = fixity.check_replica(pages, pages.dropDuplicates(["page_id", "html"]))
    assert [(r["page_id"], r["corrupt"]) for r in fewer.filter("page_id = 7").orderBy("number").collect()] == [(7, False), (7, True), (7, True)] and fewer.filter("corrupt").count() == 2
    same = fixity.check_replica(pages, pages)
    assert same.count() == 254 and same.filter("corrupt").isEmpty()
    for r in same.groupBy("file").agg(F.sum("length").alias("n"), F.max(F.col("offset") + F.col("length")).alias("end"), F.countDistinct("number").alias("k"), F.count(F.lit(1)).alias("c")).collect():
        assert r["n"] == r["end"] and r["k"] == r["c"]
    assert fixity.check_replica(pages.limit(0), pages.limit(0)).count() == 0
    a, b = (fixity.tree(common.stage(fixity.archive(p), "archive")) for p in (pages, replica))
    bad, compared = fixity.audit(a, b)
    assert compared[0] <= 6 and max(compared[1:]) <= 60 < a.filter("level = 0").count() and bad.count() == 6


def test_op4_is_unicodes(spark):
    samples = ["Straße   X", "ﬁn Ångström Å", "가나 가", "ẹ́ ẹ́", "İI ͅΙ", "", "  ", "ẛ̣ ① ℌ"]
    df = spark.createDataFrame(list(enumerate(samples)), "doc_id long, text string")
    got = [r["c"] for r in df.select("doc_id", digest.canonical(F.col("text")).alias("c")).orderBy("doc_id").collect()]
    assert got == [brute.canonical(t) for t in samples]


def test_op4_edits(spark, documents, texts):
    out = {r["doc_id"]: r for r in digest.edited(documents.select("doc_id", "text")).collect()}
    order = sorted(texts, reverse=True)
    for k, (i, t) in enumerate(order):
        n, t, after = len(t or ""), t or "", order[(k + 1) % len(order)][1] or ""
        edited = t[: n - n // 3] + after[: n // 3]
        assert out[i]["n_chars"] == n and out[i]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert out[i]["near_edited"] == float(brute.canonical(t) == brute.canonical(edited))
    alike = {}
    for i, t in texts:
        assert alike.setdefault(brute.canonical(t), out[i]["fingerprint"]) == out[i]["fingerprint"]
    assert len(set(alike.values())) == len(alike)


def test_op4_edges(spark):
    clashing = odd(spark).withColumns({"digest": F.lit("mine"), "canon": F.lit(1), "place": F.lit(2), "fingerprint": F.lit(3)})
    out = digest.fingerprints(clashing).collect()
    by = {}
    for r in out:
        by.setdefault(brute.canonical(r["text"]), set()).add(r["fingerprint"])
    assert len(out) == 10 and all(len(x) == 1 for x in by.values()) and len(set.union(*by.values())) == len(by)
    assert {(r["canon"], r["place"]) for r in out} == {(1, 2)} and "mine" not in {r["digest"] for r in out}
    assert digest.edited(odd(spark).select("doc_id", "text")).count() == 10
    assert digest.edited(nothing(spark).select("doc_id", "text")).count() == 0


def test_op4_compares_bytes_in_equal_buckets(spark, monkeypatch):
    monkeypatch.setattr(digest, "wide_hash", lambda canon: F.lpad((F.length(canon) % 2).cast("string"), 32, "0"))
    rows = [(1, "a"), (2, "A"), (3, "bbb"), (4, "bb"), (5, "c")]
    got = {r["doc_id"]: r["fingerprint"] for r in digest.fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1] == got[2] and len(set(got.values())) == 4


def test_ids_of_any_type(spark):
    df = odd(spark).withColumn("doc_id", F.concat(F.lit("d"), F.col("doc_id").cast("string")))
    got = {r["doc_id"]: r["component_id"] for r in jaccard.classes(df).collect()}
    assert got["d5"] == got["d4"] == "d4" and got["d7"] == "d6"
    labels = spark.createDataFrame([("d4", 1), ("d6", 0)], "doc_id string, toxic int")
    assert toxicity.severity(df, labels).count() == 10
    small = spark.createDataFrame([(1, "one two three four five"), (2, "one two three four five")], "doc_id int, text string")
    assert {r["component_id"] for r in jaccard.classes(small).collect()} == {1}


def test_op5_edges(spark):
    got = sorted((r["doc_id"] or 0, r["n_shingles"], r["component_id"] or 0) for r in jaccard.classes(odd(spark)).collect())
    rows = [(r["doc_id"], r["text"]) for r in odd(spark).collect()]
    sets, root = brute.near([(i, t) for i, t in rows if i is not None], 4, 85)
    want = sorted([(i, len(s), root[i]) for i, s in sets] + [(0, len(brute.shingles("stray words here", 4)), 0)])
    assert got == want
    assert jaccard.classes(nothing(spark)).count() == 0


def test_op6_learns_toxicity(spark):
    rng = np.random.default_rng(2)
    rows = []
    for i in range(600):
        bad = i % 6 == 0
        rows.append((i, " ".join(rng.choice(["calm", "tree", "river", "stone", "walk", "talk"], 12)) + (" vile" * (1 + i % 3) + " foul" if bad else ""), int(bad)))
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    out = toxicity.severity(df.select("doc_id", "text"), df.filter("doc_id < 400").select("doc_id", "toxic")).collect()
    assert all(r["toxic"] == (r["doc_id"] % 6 == 0) for r in out)
    none = toxicity.severity(odd(spark), df.limit(0).select("doc_id", "toxic"))
    assert none.count() == 10 and none.filter("toxic").isEmpty()


def test_op6_held_out(spark):
    """Against the 0/1 labels, on labelled documents that were not learnt from."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet").select("doc_id", "toxic").filter("doc_id < 4000")
    docs = docs.join(labels.select("doc_id"), "doc_id", "left_semi")
    graded = toxicity.severity(docs, labels.filter("doc_id % 4 <> 0")).filter("doc_id % 4 = 0")
    rows = graded.select("doc_id", F.col("toxic").alias("said"), "severity").join(labels, "doc_id").collect()
    bad, good = ([r for r in rows if r["toxic"] == k] for k in (1, 0))
    caught, blamed = (float(np.mean([r["said"] for r in x])) for x in (bad, good))
    assert len(bad) > 20 and caught > 0.75 and blamed < 0.05, (caught, blamed)
    assert np.mean([r["severity"] for r in bad]) > 3 * np.mean([r["severity"] for r in good])
    print("held out:", caught, blamed, float(np.mean([r["severity"] for r in bad])), float(np.mean([r["severity"] for r in good])))


def test_op7_edges(spark):
    rows = odd(spark).withColumn("source", F.when(F.col("doc_id") > 5, "b").when(F.col("doc_id") > 2, "a"))
    out = mixing.mix(rows)
    assert out.columns[-4:] == ["size", "source_size", "target", "taken"] and out.count() == 10
    for r in out.groupBy("source").agg(F.sum("taken").alias("t"), F.max("target").alias("g"), F.max("source_size").alias("s"), F.max(F.col("taken") - 2 * F.col("size")).alias("over")).collect():
        assert abs(r["t"] - r["g"]) <= 1 and r["g"] <= 2 * r["s"] and r["over"] <= 0
    assert sorted(map(str, out.collect())) == sorted(map(str, mixing.mix(rows.repartition(5)).collect()))
    assert mixing.mix(nothing(spark)).count() == 0


def test_op8_base_spans(spark, documents, texts):
    more = [(r["doc_id"], r["text"]) for r in odd(spark).collect() if r["doc_id"] is not None]
    for df, rows in ((documents, texts), (odd(spark).filter("doc_id is not null"), more)):
        got = {(r["doc_id"]): r for r in personal.report(df).collect()}
        for i, t in rows:
            want = brute.personal(t)
            assert got[i]["base_sha256"] == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in want).encode()).hexdigest()
            assert [got[i][f"n_{k}"] for k in personal.BASE] == [sum(x == k for x, _, _ in want) for k in personal.BASE]
            assert {f"{k}:{a}:{b}" for k, a, b in want} <= set(got[i]["spans"].split(","))
    assert personal.report(nothing(spark)).count() == 0


def test_op9_held_out(spark):
    out = language.op9_language(spark, "/root/testdata/sf0.01")
    truth = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang")
    tested = out.filter("held_out and lang_pred <> 'und'").join(truth, "doc_id").select(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    assert tested > 0.9


def test_op9_edges(spark):
    labelled = odd(spark).withColumn("lang", F.lit("en"))
    out = {r["doc_id"]: r for r in language.identify(odd(spark), language.train(labelled)).collect()}
    assert out[1]["lang_pred"] == out[2]["lang_pred"] == out[3]["lang_pred"] == "und" and out[6]["lang_pred"] == "en"
    assert {r["lang_pred"] for r in language.identify(odd(spark), language.train(labelled.limit(0))).collect()} == {"und"}


def test_op10_is_brute_force(spark):
    rng = np.random.default_rng(4)
    base = [" ".join(f"w{x}" for x in rng.integers(0, 400, 40)) for _ in range(12)]
    rows = []
    for i in range(30):
        picked = []
        for j in rng.integers(0, 12, 5):
            line = base[j].split(" ")
            if rng.random() < 0.5:
                line[int(rng.integers(40))] += "x"
            picked.append(" ".join(line).upper() if rng.random() < 0.3 else " ".join(line) + "!")
        rows.append((i, "\n".join([*picked, "", "--"])))
    rows += [(30, None), (31, ""), (32, base[0] + "\n" + base[0])]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("key", F.lit(0))
    got = {r["doc_id"]: r["text"] for r in lines.dedup(df).collect()}
    assert got == brute.line_dedup(rows)
    assert lines.dedup(df.limit(0)).count() == 0


def test_pipeline_edges(spark):
    """Null, empty and long texts, repeated rows, a null id, other columns and no rows go through every stage but the last as they came, those that a stage drops aside."""
    docs = odd(spark).withColumn("lang", F.lit(None).cast("string"))
    for stage_docs in (docs, docs.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, stage_docs, SF)
            assert name == "mixing" or out.columns == docs.columns
            n = out.count()
            assert n == 0 if stage_docs is not docs else n >= 6
            if stage_docs is docs:
                assert out.filter("doc_id = 1 and text is null").count() == 1 and out.filter("doc_id is null").count() == 1


def test_pipeline_stages(spark, documents, texts, benchmark):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line dedup", "n-gram Jaccard join", "benchmark decontamination", "mixing"]
    docs, kept = documents, None
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        before = [(r["doc_id"], r["text"]) for r in docs.collect()]
        docs = common.stage(stage(spark, docs, SF), f"test{k}")
        after = {r["doc_id"]: r["text"] for r in docs.collect()}
        if k < 4:
            assert docs.columns == documents.columns
        if k == 1:
            assert after == brute.line_dedup(before)
        if k == 2:
            _, root = brute.near(before, 5, 80)
            assert set(after) == {i for i, r in root.items() if i == r}
        if k == 3:
            assert set(after) == {i for i, t in before if not brute.contaminated(t, benchmark)[1]}
    assert docs.filter("taken > 2 * size").isEmpty()
