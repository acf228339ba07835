"""Rules that are fitted, kept as tables, explained and tabulated."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import json_number, micros
from ..operators import features, fuzzy, rule_tables, staging, training
from .classifying import _FLOOR, CLASSES, FEATURES, ORACLES as CLASSIFYING, RULES, _sql
from .tables import SECOND, table, triggers

#: Share of orders, by hash, whose lines tell when fitting stops.
HELD = 5


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines with x and y in [0, 1], the place of their return flag as label, and their order."""
    label = F.when(F.col("l_returnflag") == "A", 0).when(F.col("l_returnflag") == "N", 1).otherwise(2)
    return table(spark, sf_dir, "lineitem").select("l_returnflag", "l_linenumber", F.col("l_orderkey").alias("id"), (F.col("l_quantity") / 50).alias("x"), (F.col("l_discount") / 0.1).alias("y"), label.alias("label"))


def _fitting(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Lines to fit, and lines held out by order, since lines of an order are alike."""
    rows = _lines(spark, sf_dir)
    held = F.pmod(F.hash("id"), F.lit(HELD)) == 0
    return rows.filter(~held), rows.filter(held)


def _losses(spark: SparkSession, fitted: training.Fitted) -> DataFrame:
    rows = [(k, t, h, k == fitted.best) for k, (t, h) in enumerate(zip(fitted.train_loss, fitted.held_loss, strict=True), 1)]
    return spark.createDataFrame(rows, "pass int, train_loss double, held_loss double, kept boolean")


def hybrid_training(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Losses of four passes of least squares and gradients over all lines."""
    rows, held = _fitting(spark, sf_dir)
    return _losses(spark, training.hybrid(rows, held, FEATURES, "label", RULES, 3, rate=0.02, passes=4))


def gradient_training(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Losses of two passes of eight steps by gradients, whether a line was returned."""
    rows, held = (df.withColumn("label", (F.col("l_returnflag") == "R").cast("int")) for df in _fitting(spark, sf_dir))
    rules = [fuzzy.Rule(r.a, r.b, r.c, tuple(t[:1] for t in r.consequent)) for r in RULES]
    return _losses(spark, training.by_gradients(rows, held, FEATURES, "label", rules, 1, key="id", rate=0.01, passes=2, steps=8))


def rule_gradients(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean weighted cross-entropy of the rules over all lines, and its gradients by the consequents and centres."""
    rows, p = _lines(spark, sf_dir), training.Parameters.of(RULES)
    total = training.sums(rows, FEATURES, "label", p, training.class_weights(rows, "label", 3), training.cross_entropy)
    g = p.like(total[2:] / total[1])
    out = [("loss", 0, 0, 0, total[0] / total[1])]
    out += [("theta", j, i, k, v) for j, rule in enumerate(g.theta) for i, row in enumerate(rule) for k, v in enumerate(row)]
    out += [("c", j, i, 0, v) for j, rule in enumerate(g.c) for i, v in enumerate(rule)]
    return spark.createDataFrame([(n, j, i, k, round(float(v), 7)) for n, j, i, k, v in out], "parameter string, rule_id int, term int, class int, value double")


def fuzzy_predict_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """fuzzy_predict by rules that were saved and read again."""
    path = staging.folder(spark)
    rule_tables.save(rule_tables.of_rules(spark, RULES), path)
    out = rule_tables.predict(_lines(spark, sf_dir), FEATURES, rule_tables.load(spark, path), floor=1e-12)
    return out.groupBy("l_returnflag", "predicted").agg(F.count(F.lit(1)).alias("n"), *[F.round(F.avg(f"y{k}"), 6).alias(f"y{k}") for k in range(3)])


def _groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A rule for each line number, at its lines' means."""
    return rule_tables.from_groups(_lines(spark, sf_dir), "l_linenumber", FEATURES, "label", 3)


def grouped_rules_predict(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = rule_tables.predict(_lines(spark, sf_dir), FEATURES, _groups(spark, sf_dir))
    return rows.groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"), *[F.round(F.avg(f"y{k}"), 6).alias(f"y{k}") for k in range(3)])


def rule_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rule_tables.explained(_groups(spark, sf_dir), FEATURES, CLASSES).drop("conditions")


def rule_text_by_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rule_tables.explained(_groups(spark, sf_dir), FEATURES, CLASSES, "total", None).select("rule_id", "conditions", "output")


def dominant_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The class of each rule by its three definitions."""
    rules = _groups(spark, sf_dir)
    for how in ("model", "at_centre", "total"):
        rules = rule_tables.dominant(rules, 3, how).withColumnRenamed("dominant", how)
    return rules.select("rule_id", "model", "at_centre", "total")


def decision_surface(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the rules of the groups give on a grid of 120 x 120 points, as numbers of points."""
    points = rule_tables.grid(_lines(spark, sf_dir), FEATURES, ("x", "y"), 120)
    out = rule_tables.predict(points, FEATURES, _groups(spark, sf_dir), floor=1e-12)
    return out.groupBy((F.floor(F.col("x") * 10)).alias("x_tenth")).agg(F.count(F.lit(1)).alias("n"), *[F.round(F.avg(f"y{k}"), 6).alias(f"y{k}") for k in range(3)])


def membership_curves(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rule_tables.curves(_groups(spark, sf_dir), FEATURES, 50).select("rule_id", "feature", F.round("at", 9).alias("at"), F.round("membership", 6).alias("membership"))


#: Features of a window, and how far its trigger may lie, in microseconds.
WINDOW_FEATURES, NEAR = ["snr", features.SCORE, "log_energy", "k"], 600 * SECOND


def _matched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as windows at the times of the events of the same number, with the trigger near them."""
    events = table(spark, sf_dir, "events")
    times = events.select(F.col("event_id").alias("window_id"), micros(F.col("ts")).alias("t0"), (F.col("user_id") % 2).alias("ifo"), F.col("value").alias("log_energy"), json_number(F.col("props"), "k").alias("k"))
    windows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("window_id"), F.col("embedding").alias("x")).join(times, "window_id")
    return features.matched(windows, triggers(spark, sf_dir), "t0", "t", NEAR, ["ifo"], ["snr"], places=-8)


def _saved_features(spark: SparkSession, sf_dir: str, components: int) -> DataFrame:
    """Fitted, saved, read again and applied."""
    rows, path = _matched(spark, sf_dir), staging.folder(spark)
    features.FeatureAssembler(features=WINDOW_FEATURES, components=components).fit(rows).write().save(path)
    return features.FeatureModel.load(path).transform(rows)


def assembled_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features without components, whose score is the variance about the mean image."""
    rows = _saved_features(spark, sf_dir, 0)
    return rows.select("window_id", *[F.round(F.col("features")[k], 6).alias(f"f{k}") for k in range(4)])


def component_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features with the components that explain 95 % of the variance."""
    return _saved_features(spark, sf_dir, -1).select("window_id", *[F.col("features")[k].alias(f) for k, f in enumerate(WINDOW_FEATURES)])


QUERIES = {f.__name__: f for f in (hybrid_training, gradient_training, rule_gradients, fuzzy_predict_table, grouped_rules_predict, rule_text, rule_text_by_percentiles, dominant_classes, decision_surface, membership_curves, assembled_features, component_features)}

_LABELLED = "SELECT *, CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS label"
_GROUPS = """pt AS (SELECT row_number() OVER () AS id, l_returnflag, l_linenumber, l_quantity / 50 AS x, l_discount / 0.1::double AS y FROM lineitem),
rt AS (SELECT (row_number() OVER (ORDER BY l_linenumber) - 1)::int AS rule_id, avg(x) AS cx, avg(y) AS cy, avg((l_returnflag = 'A')::int) AS s0, avg((l_returnflag = 'N')::int) AS s1, avg((l_returnflag NOT IN ('A', 'N'))::int) AS s2 FROM pt GROUP BY l_linenumber)"""
_FIRED = "(1 / (1 + pow(abs(({x} - cx) / 0.3::double), 4.0::double))) * (1 / (1 + pow(abs(({y} - cy) / 0.3::double), 4.0::double)))"
_TOP = "CASE WHEN {0} >= {1} AND {0} >= {2} THEN 0 WHEN {1} >= {2} THEN 1 ELSE 2 END::int"


def _summed(points: str, keys: str, x: str, y: str, divisor: str) -> str:
    """keys and y0, y1, y2 of points by the rules of rt."""
    ys = ", ".join(f"sum(w * s{k}) / {divisor} AS y{k}" for k in range(3))
    return f"SELECT {keys}, {ys} FROM (SELECT p.*, s0, s1, s2, {_FIRED.format(x=x, y=y)} AS w FROM {points} p, rt) GROUP BY {keys}"


_LEVEL = "CASE WHEN {0} {op} {1} THEN 'low' WHEN {0} {op} {2} THEN 'medium' ELSE 'high' END"
_NAME = "CASE {0} WHEN 0 THEN 'Loud' WHEN 1 THEN 'Burst' ELSE 'Scatter' END"
_LINE_LEVELS = ", ".join(f"quantile_cont(c{a}, {p}) AS {a}{n}" for a in "xy" for n, p in (("l", 0.33), ("h", 0.67)))


def _gradients() -> str:
    """The sums of rule_gradients, from the chain rule written out for these rules."""
    scores = ", ".join(f"exp(y{k} - greatest(y0, y1, y2)) AS e{k}" for k in range(3))
    shares = ", ".join(f"cw * (e{k} / (e0 + e1 + e2) - (label = {k})::int) AS g{k}" for k in range(3))
    line = lambda r, k: " + ".join(f"{f} * {r.consequent[i][k]}::double" for i, f in enumerate(FEATURES)) + f" + {r.consequent[-1][k]}::double"
    own = ", ".join(f"{' + '.join(f'g{k} * ({line(r, k)})' for k in range(3))} AS s{j}" for j, r in enumerate(RULES))
    mean = "w0 * s0 + w1 * s1 + w2 * s2"
    parts = ["SELECT 'loss' AS parameter, 0 AS rule_id, 0 AS term, 0 AS class, sum(cw * (ln(e0 + e1 + e2) - ln(CASE label WHEN 0 THEN e0 WHEN 1 THEN e1 ELSE e2 END))) / sum(cw) AS value FROM s"]
    for j, r in enumerate(RULES):
        for i, f in enumerate([*FEATURES, "1.0::double"]):
            parts += [f"SELECT 'theta', {j}, {i}, {k}, sum(w{j} * {f} * g{k}) / sum(cw) FROM s" for k in range(3)]
        for i, f in enumerate(FEATURES):
            power = f"pow(abs(({f} - {r.c[i]}::double) / {r.a[i]}::double), {2 * r.b[i]}::double)"
            parts.append(f"SELECT 'c', {j}, {i}, 0, sum(CASE WHEN {f} = {r.c[i]}::double THEN 0 ELSE w{j} * (s{j} - m) * ({power} / (1 + {power})) * {2 * r.b[i]}::double / ({f} - {r.c[i]}::double) END) / sum(cw) FROM s")
    union = " UNION ALL ".join(parts)
    weighted = f"SELECT *, (SELECT count(*) FROM lineitem) / (3.0::double * count(*) OVER (PARTITION BY label)) AS cw FROM ({_LABELLED} FROM ({_sql(RULES, _FLOOR)}))"
    return f"WITH g AS (SELECT *, {shares} FROM (SELECT *, {scores} FROM ({weighted}))), s AS (SELECT *, {mean} AS m FROM (SELECT *, {own} FROM g)) SELECT parameter, rule_id::int AS rule_id, term::int AS term, class::int AS class, round(value, 7) AS value FROM ({union})"


ORACLES = {
    "rule_gradients": _gradients(),
    "fuzzy_predict_table": CLASSIFYING["fuzzy_predict"],
    "grouped_rules_predict": f"WITH {_GROUPS} SELECT l_returnflag, count(*) AS n, round(avg(y0), 6) AS y0, round(avg(y1), 6) AS y1, round(avg(y2), 6) AS y2 FROM ({_summed('pt', 'id, l_returnflag', 'x', 'y', '(sum(w) + 1e-8::double)')}) GROUP BY 1",
    "rule_text": f"WITH {_GROUPS} SELECT rule_id, {_NAME.format(_TOP.format('s0', 's1', 's2'))} AS output, 'IF x IS ' || {_LEVEL.format('cx', '0.33::double', '0.67::double', op='<')} || ' AND y IS ' || {_LEVEL.format('cy', '0.33::double', '0.67::double', op='<')} || ' THEN ' || {_NAME.format(_TOP.format('s0', 's1', 's2'))} AS text FROM rt",
    "rule_text_by_percentiles": f"WITH {_GROUPS}, q AS (SELECT {_LINE_LEVELS} FROM rt) SELECT rule_id, 'x IS ' || {_LEVEL.format('cx', 'xl', 'xh', op='<=')} || ' AND y IS ' || {_LEVEL.format('cy', 'yl', 'yh', op='<=')} AS conditions, {_NAME.format(_TOP.format('s0', 's1', 's2'))} AS output FROM rt, q",
    "dominant_classes": f"WITH {_GROUPS}, own AS (SELECT rule_id, least(greatest(cx, 0), 1) AS x, least(greatest(cy, 0), 1) AS y FROM rt) SELECT m.rule_id, {_TOP.format('y0', 'y1', 'y2')} AS model, {_TOP.format('s0', 's1', 's2')} AS at_centre, {_TOP.format('s0', 's1', 's2')} AS total FROM ({_summed('own', 'p.rule_id', 'x', 'y', 'greatest(sum(w), 1e-12::double)').replace('SELECT p.rule_id', 'SELECT rule_id').replace('GROUP BY p.rule_id', 'GROUP BY rule_id')}) m JOIN rt ON rt.rule_id = m.rule_id",
    "decision_surface": f"WITH {_GROUPS}, grid AS (SELECT a.i / 119.0::double AS x, b.i / 119.0::double AS y FROM range(120) a(i), range(120) b(i)) SELECT floor(x * 10)::bigint AS x_tenth, count(*) AS n, round(avg(y0), 6) AS y0, round(avg(y1), 6) AS y1, round(avg(y2), 6) AS y2 FROM ({_summed('grid', 'x, y', 'x', 'y', 'greatest(sum(w), 1e-12::double)')}) GROUP BY 1",
    "membership_curves": f"WITH {_GROUPS}, f AS (SELECT rule_id, 'x' AS feature, cx AS c FROM rt UNION ALL SELECT rule_id, 'y', cy FROM rt) SELECT rule_id, feature, round(i / 49.0::double, 9) AS at, round(1 / (1 + pow(abs((i / 49.0::double - c) / 0.3::double), 4.0::double)), 6) AS membership FROM f, range(50) r(i)",
    "assembled_features": f"""WITH trig AS (SELECT event_id AS trigger_id, epoch_us(ts) AS t, user_id % 2 AS ifo, value AS snr FROM events WHERE event_type = 'error'),
px AS (SELECT vec_id, unnest(embedding)::double AS v, generate_subscripts(embedding, 1) AS d FROM embeddings),
w AS (SELECT event_id AS window_id, epoch_us(ts) AS t0, user_id % 2 AS ifo, value AS log_energy, json_extract_string(props, '$.k')::double AS k FROM events WHERE event_id IN (SELECT vec_id FROM embeddings)
 QUALIFY row_number() OVER (PARTITION BY user_id % 2, round_even(epoch_us(ts)::decimal(18,0) / 100000000, 0) ORDER BY event_id) = 1),
c AS (SELECT w.window_id, t.snr, row_number() OVER (PARTITION BY w.window_id ORDER BY (t.t <> w.t0)::int, t.trigger_id) AS n FROM w JOIN trig t ON t.ifo = w.ifo AND abs(t.t - w.t0) < {NEAR}),
own AS (SELECT px.* FROM px JOIN w ON w.window_id = px.vec_id),
b AS (SELECT quantile_cont(v, 0.01) AS lo, quantile_cont(v, 0.99) AS hi FROM own),
nx AS (SELECT vec_id, d, least(greatest((v - lo) / (hi - lo + 1e-8::double), 0), 1) AS v FROM own, b),
ae AS (SELECT vec_id, avg((v - mu) * (v - mu)) AS ae FROM nx JOIN (SELECT d, avg(v) AS mu FROM nx GROUP BY d) m ON m.d = nx.d GROUP BY 1),
r AS (SELECT w.window_id, c.snr, ae.ae, w.log_energy, w.k FROM w JOIN c ON c.window_id = w.window_id AND c.n = 1 JOIN ae ON ae.vec_id = w.window_id)
SELECT window_id, round((snr - min(snr) OVER ()) / (max(snr) OVER () - min(snr) OVER () + 1e-8::double), 6) AS f0, round((ae - min(ae) OVER ()) / (max(ae) OVER () - min(ae) OVER () + 1e-8::double), 6) AS f1,
round((log_energy - min(log_energy) OVER ()) / (max(log_energy) OVER () - min(log_energy) OVER () + 1e-8::double), 6) AS f2, round((k - min(k) OVER ()) / (max(k) OVER () - min(k) OVER () + 1e-8::double), 6) AS f3 FROM r""",
}
