"""The engine's queries over whole tables, each with the SQL that gives the same rows where SQL can express it."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import vectors as V
from .operators import scores, statistics, transforms, tree_plan
from .operators.spec import LearnerSpec, PipelineSpec, PreprocessorSpec, ProtocolSpec
from .plans import fold, protocols
from .sources import tables
from .sources.tables import LINE_ORDER, lineitem_points, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
KEY = "l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate"
X = "l_quantity / 50 AS x1, l_discount * 10 AS x2, l_tax * 12.5::DOUBLE AS x3"
W, B = [0.5, -0.3, 0.2], -0.1
#: Three centres of as many dimensions as the embeddings have.
DIMS = 64
CENTERS = [[((i * 7 + k * 13) % 11 - 5) / 50 for i in range(DIMS)] for k in range(3)]


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def r6(c: Column | str) -> Column:
    """Rounded, and never a negative zero."""
    return F.round(F.col(c) if isinstance(c, str) else c, 6) + F.lit(0.0)


def rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: r6(n) for n in names})


def fixed(x: Column) -> Column:
    return V.dot(x, V.literal(W)) + F.lit(B)


MARGIN = "x1 * 0.5::DOUBLE + x2 * -0.3::DOUBLE + x3 * 0.2::DOUBLE + -0.1::DOUBLE"
LINES = f"(SELECT {KEY}, {X}, CASE WHEN l_returnflag = 'R' THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END AS y, l_extendedprice / 105000 AS price FROM lineitem)"
EMB = "(SELECT vec_id, CAST(label AS DOUBLE) AS label, list_transform(embedding, lambda v: v::DOUBLE) AS x FROM embeddings)"

# ---- ridge regression ------------------------------------------------------------------------------------------------


def _ridge(spark, d):
    return statistics.ridge_sums(lineitem_points(spark, d, "price"), [F.col("numeric")[0]], F.col("label"))


@query("orr_sufficient_stats", f"SELECT round(sum(x1 * x1), 6) AS a00, round(sum(x1), 6) AS a01, count(*)::DOUBLE AS a11, round(sum(price * x1), 6) AS b0, round(sum(price), 6) AS b1, count(*) AS n FROM {LINES}")
def _(spark, d):
    return rounded(_ridge(spark, d), "a00", "a01", "a11", "b0", "b1")


@query("orr_fit_weights", f"SELECT 0 AS pos, round(regr_slope(price, x1), 6) + 0.0 AS weight FROM {LINES} UNION ALL SELECT 1, round(regr_intercept(price, x1), 6) + 0.0 FROM {LINES}")
def _(spark, d):
    weights = statistics.ridge_weights(_ridge(spark, d))
    return rounded(spark.createDataFrame(list(enumerate(weights)), "pos int, weight double"), "weight")


@query("orr_predict_rmse", f"WITH m AS (SELECT regr_slope(price, x1) AS s, regr_intercept(price, x1) AS i FROM {LINES}) SELECT round(sqrt(avg((price - (s * x1 + i)) ** 2)), 6) AS rmse FROM {LINES}, m")
def _(spark, d):
    weights = statistics.ridge_weights(_ridge(spark, d))
    rows = lineitem_points(spark, d, "price").select("label", (F.col("numeric")[0] * weights[0] + weights[1]).alias("p"))
    return rounded(scores.rmse(rows, "label", "p"), "rmse")


# ---- preprocessors ---------------------------------------------------------------------------------------------------


def _raw(spark, d):
    return table(spark, d, "lineitem").select(*LINE_ORDER, F.array("l_quantity", "l_discount", "l_tax").alias("numeric"))


def _spread(df: DataFrame, x: Column, n: int, prefix: str = "f") -> DataFrame:
    return df.withColumn("__x", x).select(*LINE_ORDER, *[r6(F.col("__x")[k]).alias(f"{prefix}{k}") for k in range(n)])


@query("minmax_scale", f"SELECT {KEY}, round(l_quantity / 255, 6) + 0.0 AS f0, round(l_discount / 255, 6) + 0.0 AS f1, round(l_tax / 255, 6) + 0.0 AS f2 FROM lineitem")
def _(spark, d):
    return _spread(_raw(spark, d), transforms.min_max(F.col("numeric")), 3)


@query("minmax_scale_per_feature", f"SELECT {KEY}, round((l_quantity - 1) / 49, 6) + 0.0 AS f0, round(l_discount / 0.1::DOUBLE, 6) + 0.0 AS f1, round(l_tax / 0.08::DOUBLE, 6) + 0.0 AS f2 FROM lineitem")
def _(spark, d):
    return _spread(_raw(spark, d), transforms.min_max(F.col("numeric"), [1.0, 0.0, 0.0], [50.0, 0.1, 0.08]), 3)


@query("standard_scaler_state", "SELECT count(value) AS count, round(avg(value), 6) AS mean, round(var_pop(value), 6) AS variance FROM events")
def _(spark, d):
    state = transforms.scaler_state(table(spark, d, "events"), "value")
    return state.select("count", r6("mean").alias("mean"), r6(F.col("d") / F.col("count")).alias("variance"))


@query("standard_scaler_merge", "SELECT count(value)::BIGINT AS count, round(avg(value), 4) AS mean, round(var_pop(value), 4) AS variance FROM events")
def _(spark, d):
    parts = table(spark, d, "events").groupBy("event_type").agg(F.count("value").alias("count"), F.avg("value").alias("mean"), (F.var_pop("value") * F.count("value")).alias("d"))
    return transforms.merge_states(parts).select("count", F.round("mean", 4).alias("mean"), F.round(F.col("d") / F.col("count"), 4).alias("variance"))


@query("standard_scale_batch", "SELECT event_id, round((value - (SELECT avg(value) FROM events)) / (SELECT stddev_pop(value) FROM events), 6) + 0.0 AS scaled FROM events")
def _(spark, d):
    return transforms.scale_batch(table(spark, d, "events").select("event_id", "value"), "value").select("event_id", r6("scaled").alias("scaled"))


@query("standard_scale_prequential", "WITH s AS (SELECT event_id, value, count(*) OVER w AS n, avg(value) OVER w AS m, stddev_pop(value) OVER w AS sd FROM events WINDOW w AS (ORDER BY event_id)) SELECT event_id, n, round(CASE WHEN n <= 1 THEN value WHEN sd > 0 THEN (value - m) / sd END, 6) + 0.0 AS scaled FROM s")
def _(spark, d):
    return transforms.scale_prequential(table(spark, d, "events").select("event_id", "value"), "value", "event_id").select("event_id", "n", r6("scaled").alias("scaled"))


@query("standard_scale_frozen", "WITH r AS (SELECT event_id, value, row_number() OVER (ORDER BY event_id) - 1 AS rn FROM events), m AS (SELECT avg(value) AS m, stddev_pop(value) AS sd FROM r WHERE rn < 300) SELECT event_id, round((value - m) / sd, 6) + 0.0 AS scaled FROM r, m")
def _(spark, d):
    """Statistics learned from the first 300 events and then frozen."""
    rows = tables.numbered(table(spark, d, "events").select("event_id", "value"), ["event_id"])
    state = transforms.scaler_state(rows.where("rn < 300"), "value")
    return transforms.scale_batch(rows, "value", state).select("event_id", r6("scaled").alias("scaled"))


@query("standard_scale_vectors", "WITH c AS (SELECT vec_id, i - 1 AS pos, embedding[i]::DOUBLE AS v FROM embeddings, range(1, 65) t(i)), m AS (SELECT pos, avg(v) AS m, stddev_pop(v) AS sd FROM c GROUP BY 1) SELECT vec_id, CAST(pos AS INTEGER) AS pos, round((v - m) / sd, 6) + 0.0 AS scaled FROM c JOIN m USING (pos)")
def _(spark, d):
    rows = transforms.scale_vectors(tables.embedding_points(spark, d), "numeric", 64)
    return rows.select("vec_id", F.posexplode("scaled").alias("pos", "v")).select("vec_id", "pos", r6("v").alias("scaled"))


@query("running_mean", "SELECT event_id, count(*) OVER w AS n, round(avg(value) OVER w + 1.234e-7, 6) + 0.0 AS mean FROM events WINDOW w AS (ORDER BY event_id)")
def _(spark, d):
    return transforms.running(table(spark, d, "events").select("event_id", "value"), "value", "event_id").select("event_id", "n", r6(F.col("mean") + 1.234e-7).alias("mean"))  # off the ties of means of cents


def _two(spark, d):
    return table(spark, d, "lineitem").select(*LINE_ORDER, F.array(F.col("l_quantity") / 50, F.col("l_discount") * 10).alias("numeric"))


@query("polynomial_degree2", f"SELECT {KEY}, round(a, 6) + 0.0 AS p0, round(b, 6) + 0.0 AS p1, round(a * a, 6) + 0.0 AS p2, round(a * b, 6) + 0.0 AS p3, round(b * a, 6) + 0.0 AS p4, round(b * b, 6) + 0.0 AS p5 FROM (SELECT *, l_quantity / 50 AS a, l_discount * 10 AS b FROM lineitem)")
def _(spark, d):
    return _spread(_two(spark, d), V.polynomial(F.col("numeric"), 2), 6, "p")


@query("polynomial_degree3", f"WITH t AS (SELECT *, [l_quantity / 50, l_discount * 10] AS f FROM lineitem), u AS (SELECT *, list_concat(f, flatten(list_transform(f, lambda a: list_transform(f, lambda b: a * b)))) AS g FROM t), v AS (SELECT *, list_concat(g, flatten(list_transform(g, lambda a: list_transform(f, lambda b: a * b)))) AS h FROM u) SELECT {KEY}, len(h) AS n, round(list_sum(h), 4) + 0.0 AS total, round(h[18], 6) + 0.0 AS last FROM v")
def _(spark, d):
    rows = _two(spark, d).withColumn("p", V.polynomial(F.col("numeric"), 3))
    return rows.select(*LINE_ORDER, F.size("p").cast("long").alias("n"), (F.round(V.total(F.col("p")), 4) + F.lit(0.0)).alias("total"), r6(F.col("p")[17]).alias("last"))


@query("feature_filter", f"SELECT {KEY}, round(l_quantity, 6) + 0.0 AS f0, round(l_tax, 6) + 0.0 AS f1 FROM lineitem")
def _(spark, d):
    return _spread(_raw(spark, d), V.without(F.col("numeric"), [1]), 2)


@query("feature_filter_record", "SELECT event_id, round(value / 2, 6) + 0.0 AS n0, CAST(user_id % 5 AS DOUBLE) AS d0, event_type AS c0 FROM events")
def _(spark, d):
    """Positions dropped from the numeric, the discrete and the categorical vector of a point."""
    rows = tables.points(table(spark, d, "events"), [F.col("value"), F.col("value") / 2], discrete=[F.pmod("user_id", F.lit(3)), F.pmod("user_id", F.lit(5))], categorical=[F.col("props"), F.col("event_type"), F.col("props")], keep=["event_id"])
    rows = tables.without_features(rows, numeric=[0], discrete=[0], categorical=[0, 2])
    return rows.select("event_id", r6(F.col("numeric")[0]).alias("n0"), F.col("discrete")[0].alias("d0"), F.col("categorical")[0].alias("c0"))


@query("pipeline_transform", f"SELECT {KEY}, round((l_quantity - 1) / 49 * ((l_quantity - 1) / 49), 6) + 0.0 AS p2, round((l_quantity - 1) / 49 * (l_tax / 0.08::DOUBLE), 6) + 0.0 AS p3 FROM lineitem")
def _(spark, d):
    spec = PipelineSpec(LearnerSpec("PA"), (PreprocessorSpec("MinMaxScaler", {"min": [1.0, 0.0, 0.0], "max": [50.0, 0.1, 0.08]}), PreprocessorSpec("FeatureFilter", {"numeric": [1]}), PreprocessorSpec("PolynomialFeatures", {"degree": 2})))
    rows = _raw(spark, d).withColumn("x", spec.transform(F.col("numeric")))
    return rows.select(*LINE_ORDER, r6(F.col("x")[2]).alias("p2"), r6(F.col("x")[3]).alias("p3"))


# ---- predicates, labels, predictions, scores ------------------------------------------------------------------------
@query("point_validity", "SELECT l_quantity = floor(l_quantity) AND l_linenumber = floor(l_linenumber) AS valid, l_discount = floor(l_discount) AS discount_valid, count(*) AS n FROM lineitem GROUP BY ALL")
def _(spark, d):
    rows = table(spark, d, "lineitem").select(V.integral(F.array(F.col("l_quantity"), F.col("l_linenumber").cast("double"))).alias("valid"), V.integral(F.array("l_discount")).alias("discount_valid"))
    return rows.groupBy("valid", "discount_valid").agg(F.count(F.lit(1)).alias("n"))


@query("label_map_pa", "SELECT CASE WHEN l_linenumber <> 1 THEN -1.0::DOUBLE ELSE 1.0::DOUBLE END AS label, count(*) AS n FROM lineitem GROUP BY 1")
def _(spark, d):
    return table(spark, d, "lineitem").select(F.when(F.col("l_linenumber") != 1, -1.0).otherwise(1.0).alias("label")).groupBy("label").agg(F.count(F.lit(1)).alias("n"))


@query("label_map_svm", "SELECT CASE WHEN l_returnflag = 'R' THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END AS label, count(*) AS n FROM lineitem GROUP BY 1")
def _(spark, d):
    rows = lineitem_points(spark, d, "zero").select(F.when(F.col("label") == 0, -1.0).otherwise(F.col("label")).alias("label"))
    return rows.groupBy("label").agg(F.count(F.lit(1)).alias("n"))


def _predicted(spark, d):
    return lineitem_points(spark, d).select(*LINE_ORDER, "label", fixed(F.col("numeric")).alias("margin")).withColumn("predicted", F.when(F.col("margin") >= 0, 1.0).otherwise(-1.0))


@query("linear_predict", f"SELECT {KEY}, round({MARGIN}, 6) + 0.0 AS margin, CASE WHEN {MARGIN} >= 0 THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END AS predicted FROM {LINES}")
def _(spark, d):
    return _predicted(spark, d).select(*LINE_ORDER, r6("margin").alias("margin"), "predicted")


PRED = f"(SELECT y, CASE WHEN {MARGIN} >= 0 THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END AS p FROM {LINES})"


@query("score_accuracy", f"SELECT round(avg((y = p)::INTEGER), 6) AS accuracy FROM {PRED}")
def _(spark, d):
    return rounded(scores.accuracy(_predicted(spark, d), "label", "predicted"), "accuracy")


@query("score_f1_binary", f"SELECT round(2 * count(*) FILTER (y = 1 AND p = 1) / (2 * count(*) FILTER (y = 1 AND p = 1) + count(*) FILTER (y <> p))::DOUBLE, 6) AS f1 FROM {PRED}")
def _(spark, d):
    return rounded(scores.f1(_predicted(spark, d), "label", "predicted"), "f1")


@query("score_rmse", f"SELECT round(sqrt(avg((y - ({MARGIN})) ** 2)), 6) AS rmse FROM {LINES}")
def _(spark, d):
    return rounded(scores.rmse(_predicted(spark, d), "label", "margin"), "rmse")


def _classed(spark, d):
    """Embeddings scored by ten fixed linear models: class k's weights are the k-th to k+2nd of the coordinates."""
    rows = tables.embedding_points(spark, d)
    s = F.array(*[F.col("numeric")[k] - F.col("numeric")[k + 1] + F.col("numeric")[k + 2] * 0.5 for k in range(10)])
    return rows.select("vec_id", "label", s.alias("s")).select("vec_id", "label", (F.array_position("s", F.array_max("s")) - 1).cast("double").alias("predicted"), F.array_max("s").alias("score"))


CLASSED = f"(SELECT vec_id, label, CAST(list_position(s, list_max(s)) - 1 AS DOUBLE) AS p, list_max(s) AS score FROM (SELECT vec_id, label, list_transform(range(1, 11), lambda k: x[k] - x[k + 1] + x[k + 2] * 0.5::DOUBLE) AS s FROM {EMB}))"


@query("multiclass_predict", f"SELECT vec_id, p AS predicted, round(score, 6) + 0.0 AS score FROM {CLASSED}")
def _(spark, d):
    return _classed(spark, d).select("vec_id", "predicted", r6("score").alias("score"))


@query("score_f1_weighted", f"WITH c AS (SELECT label, p FROM {CLASSED}), l AS (SELECT label, count(*) AS own, count(*) FILTER (label = p) AS hit FROM c GROUP BY 1), s AS (SELECT p, count(*) AS said FROM c GROUP BY 1) SELECT round(sum(own * 2.0::DOUBLE * hit / (own + coalesce(said, 0))) / sum(own), 6) AS f1 FROM l LEFT JOIN s ON l.label = s.p")
def _(spark, d):
    return rounded(scores.f1_weighted(_classed(spark, d), "label", "predicted"), "f1")


# ---- k-means ---------------------------------------------------------------------------------------------------------
CENTERS_SQL = "[" + ", ".join(f"list_transform(range(64), lambda i: ((i * 7 + {13 * k}) % 11 - 5) / 50e0)" for k in range(3)) + "]"
D2 = f"list_transform({CENTERS_SQL}, lambda c: list_sum(list_transform(range(1, 65), lambda i: (x[i] - c[i]) ** 2)))"


@query("kmeans_assign", f"SELECT vec_id, CAST(list_position(d, list_min(d)) - 1 AS INTEGER) AS cluster, round(sqrt(list_min(d)), 6) AS distance FROM (SELECT vec_id, {D2} AS d FROM {EMB})")
def _(spark, d):
    rows = tables.embedding_points(spark, d)
    return rows.select("vec_id", V.nearest(F.col("numeric"), CENTERS).alias("cluster"), r6(F.array_min(V.distances(F.col("numeric"), CENTERS))).alias("distance"))


@query("score_inertia", f"SELECT round(sum(list_min(d)), 6) AS inertia FROM (SELECT {D2} AS d FROM {EMB})")
def _(spark, d):
    rows = tables.embedding_points(spark, d).select(F.array_min(V.distances(F.col("numeric"), CENTERS)).alias("m"))
    return rounded(scores.inertia(rows, F.col("m") * F.col("m")), "inertia")


def _kmeans(spark, d, method):
    rows = tables.embedding_points(spark, d).withColumn("label", F.lit(0.0))
    spec = LearnerSpec("K-means", {"nClusters": 2, "method": method, "centroids": CENTERS[:2]})
    return fold.train(rows, spec, ["vec_id"]).select("pos", r6("value").alias("value"), "fitted", r6("loss").alias("loss"))


def _kmeans_sql(rate: str) -> str:
    """rate: of the gap, given n, the points that the centroid had before."""
    d2 = "list_sum(list_transform(range(1, 65), lambda i: (r.x[i] - {c}[i]) * (r.x[i] - {c}[i])))"
    moved = "CASE WHEN {near} THEN list_transform(range(1, 65), lambda i: {c}[i] + (r.x[i] - {c}[i]) * {rate}) ELSE {c} END"
    one = moved.format(near="e[1] <= e[2]", c="a.c1", rate=rate.format(n="a.n1"))
    two = moved.format(near="e[1] > e[2]", c="a.c2", rate=rate.format(n="a.n2"))
    zero = f"c1: ({CENTERS_SQL})[1], c2: ({CENTERS_SQL})[2], n1: 0e0, n2: 0e0, loss: 0e0"
    step = f"list_transform([[{d2.format(c='a.c1')}, {d2.format(c='a.c2')}]], lambda e: {{x: r.x, c1: {one}, c2: {two}, n1: a.n1 + (e[1] <= e[2])::INTEGER, n2: a.n2 + (e[1] > e[2])::INTEGER, loss: a.loss + least(e[1], e[2])}})[1]"
    return f"WITH l AS (SELECT list({{x: x, {zero}}} ORDER BY vec_id) AS xs FROM {EMB}), m AS (SELECT list_reduce(xs, lambda a, r: {step}, {{x: [0e0], {zero}}}) AS m, len(xs) AS fitted FROM l) SELECT CAST(i - 1 AS INTEGER) AS pos, round(list_concat(m.c1, m.c2)[i], 6) + 0.0 AS value, fitted, round(m.loss, 6) AS loss FROM m, range(1, 129) t(i)"


@query("kmeans_sequential", _kmeans_sql("(1e0 / ({n} + 1))"))
def _(spark, d):
    return _kmeans(spark, d, "sequential")


@query("kmeans_forgetful", _kmeans_sql("0.01::DOUBLE"))
def _(spark, d):
    return _kmeans(spark, d, "forgetful")


@query("kmeans_init_random")
def _(spark, d):
    rows = tables.embedding_points(spark, d).withColumn("label", F.lit(0.0))
    return fold.train(rows, LearnerSpec("K-means", {"nClusters": 3, "initMethod": "random", "seed": 7}), ["vec_id"])


@query("kmeans_init_plus_plus")
def _(spark, d):
    rows = tables.embedding_points(spark, d).withColumn("label", F.lit(0.0))
    return fold.train(rows, LearnerSpec("K-means", {"nClusters": 3, "initMethod": "kmeans++", "seed": 7}), ["vec_id"])


# ---- ordered folds of linear learners --------------------------------------------------------------------------------
M = "(r.x1 * a.w1 + r.x2 * a.w2 + r.x3 * a.w3 + a.b)"


def fold_sql(loss: str, factor: str, svm: bool = False, source: str = LINES, curve: int = 0, limit: str = "") -> str:
    """A left fold over all lines in order: what one learner's class does, in SQL."""
    zero = "w1: 0e0, w2: 0e0, w3: 0e0, b: 0e0, n: 0e0, loss: 0e0, last: 0e0, c: []::DOUBLE[]"
    if svm:
        s = f"(CASE WHEN r.y * {M} < 1e0 THEN 1e0 ELSE 0e0 END)"
        w = ", ".join(f"w{k}: a.w{k} - (a.w{k} - 0.01::DOUBLE * r.y * {s} * r.x{k}) / (a.n + 1)" for k in (1, 2, 3))
        w += f", b: a.b - (-r.y * {s}) / (a.n + 1)"
    else:
        w = ", ".join(f"w{k}: a.w{k} + {factor} * r.x{k}" for k in (1, 2, 3)) + f", b: a.b + {factor}"
    every = f"(a.n + 1) % {curve} = 0" if curve else "false"
    total = f"(a.loss + {loss})"
    keep = f"last: CASE WHEN {every} THEN {total} ELSE a.last END, c: CASE WHEN {every} THEN list_append(a.c, ({total} - a.last) / {max(1, curve)}) ELSE a.c END"
    body = f"WITH l AS (SELECT list({{x1: x1, x2: x2, x3: x3, y: y, q: x1 * x1 + x2 * x2 + x3 * x3 + 1e0, {zero}}} ORDER BY {KEY}) AS xs FROM {source}{limit}), m AS (SELECT list_reduce(xs, lambda a, r: {{x1: r.x1, x2: r.x2, x3: r.x3, y: r.y, q: r.q, {w}, n: a.n + 1, loss: {total}, {keep}}}, {{x1: 0e0, x2: 0e0, x3: 0e0, y: 0e0, q: 0e0, {zero}}}) AS m FROM l)"
    if curve:
        return f"{body} SELECT CAST(i - 1 AS INTEGER) AS bucket, round(m.c[i], 6) AS mean_loss, CAST(i * {curve} AS BIGINT) AS fitted FROM (SELECT m, unnest(range(1, len(m.c) + 1)) AS i FROM m)"
    return f"{body} SELECT CAST(i - 1 AS INTEGER) AS pos, round([m.w1, m.w2, m.w3, m.b][i], 6) + 0.0 AS value, CAST(m.n AS BIGINT) AS fitted, round(m.loss, 4) AS loss FROM m, range(1, 5) t(i)"


HINGE = f"greatest(0e0, 1e0 - r.y * {M})"
TAU = {"STANDARD": f"{HINGE} / (1e0 + r.q)", "PA-I": f"least(0.01::DOUBLE, {HINGE} / r.q)", "PA-II": f"{HINGE} / (r.q + 1e0 / (2e0 * 0.01::DOUBLE))"}


def _trained(spark, d, name, hyper=None, label="returned"):
    out = fold.train(lineitem_points(spark, d, label), LearnerSpec(name, hyper or {}), LINE_ORDER)
    return out.select("pos", r6("value").alias("value"), "fitted", F.round("loss", 4).alias("loss"))


for _name, _kind in (("pa_standard", "STANDARD"), ("pa_i", "PA-I"), ("pa_ii", "PA-II")):
    query(_name, fold_sql(HINGE, f"({TAU[_kind]}) * r.y"))(lambda spark, d, kind=_kind: _trained(spark, d, "PA", {"updateType": kind}))


@query("svm_train", fold_sql(HINGE, "", svm=True))
def _(spark, d):
    return _trained(spark, d, "SVM", label="zero")


MISS = f"(r.y - {M})"


@query("pa_regressor_train", fold_sql(f"abs({MISS})", f"(abs({MISS}) / (r.q + 1e0 / (2e0 * 0.01::DOUBLE)) * (CASE WHEN {MISS} >= 0 THEN 1e0 ELSE -1e0 END))", source=LINES.replace(" AS y, l_extendedprice / 105000 AS price", " AS z, l_extendedprice / 105000 AS y")))
def _(spark, d):
    rows = table(spark, d, "lineitem")
    rows = tables.points(rows, tables.lineitem_features(), F.col("l_extendedprice") / 105000, keep=LINE_ORDER)
    out = fold.train(rows, LearnerSpec("RegressorPA"), LINE_ORDER)
    return out.select("pos", r6("value").alias("value"), "fitted", F.round("loss", 4).alias("loss"))


_Z = lambda k: f"CASE WHEN count(*) OVER w <= 1 THEN x{k} WHEN stddev_pop(x{k}) OVER w > 1e-9 THEN (x{k} - avg(x{k}) OVER w) / stddev_pop(x{k}) OVER w ELSE 0e0 END AS x{k}"
SCALED = f"(SELECT {KEY}, y, {', '.join(map(_Z, (1, 2, 3)))} FROM {LINES} WINDOW w AS (ORDER BY {KEY} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))"


@query("pipeline_standard_prequential", fold_sql(HINGE, f"({TAU['PA-II']}) * r.y", source=SCALED).replace("[i], 6) + 0.0 AS value", "[i], 4) + 0.0 AS value").replace("round(m.loss, 4)", "round(m.loss, 1)"))
def _(spark, d):
    """A scaler that learns from each point before the learner does, within one pipeline."""
    spec = PipelineSpec(LearnerSpec("PA"), (PreprocessorSpec("StandardScaler", {"learn": True, "flat": 0.0}),))
    out = fold.train(lineitem_points(spark, d), spec, LINE_ORDER)
    return out.select("pos", (F.round("value", 4) + F.lit(0.0)).alias("value"), "fitted", F.round("loss", 1).alias("loss"))


@query("learning_curve", fold_sql(HINGE, f"({TAU['PA-II']}) * r.y", curve=256))
def _(spark, d):
    return rounded(fold.learning_curve(lineitem_points(spark, d), LearnerSpec("PA"), LINE_ORDER), "mean_loss")


@query("pa_prequential_loss", fold_sql(HINGE, f"({TAU['PA-I']}) * r.y", curve=1000))
def _(spark, d):
    return rounded(fold.learning_curve(lineitem_points(spark, d), LearnerSpec("PA", {"updateType": "PA-I"}), LINE_ORDER, 1000), "mean_loss")


@query("round_loss", fold_sql(HINGE, "", svm=True, curve=512))
def _(spark, d):
    return rounded(fold.learning_curve(lineitem_points(spark, d, "zero"), LearnerSpec("SVM"), LINE_ORDER, 512), "mean_loss")


_SC = "list_transform(range(1, 11), lambda k: list_sum(list_transform(range(1, 65), lambda i: r.x[i] * a.w[k][i])) + a.w[k][65])"
_NOUGHT = "list_transform(range(10), lambda k: list_transform(range(65), lambda i: 0e0))"
_TAU = "(0.5::DOUBLE * (1e0 - (s[r.y] - list_max(s))) / (r.q + 1e0 / (2e0 * 0.01::DOUBLE)))"
MULTI = f"""WITH l AS (SELECT list({{x: x, y: CAST(label AS INTEGER) + 1, q: list_sum(list_transform(x, lambda v: v * v)) + 1e0, w: {_NOUGHT}, loss: 0e0}} ORDER BY vec_id) AS xs FROM {EMB}),
m AS (SELECT list_reduce(xs, lambda a, r: list_transform([{_SC}], lambda s: {{x: r.x, y: r.y, q: r.q, w: list_transform(range(1, 11), lambda k: CASE WHEN k = r.y THEN list_transform(range(1, 66), lambda i: a.w[k][i] + {_TAU} * CASE WHEN i < 65 THEN r.x[i] ELSE 1e0 END) WHEN k = list_position(s, list_max(s)) THEN list_transform(range(1, 66), lambda i: a.w[k][i] - {_TAU} * CASE WHEN i < 65 THEN r.x[i] ELSE 1e0 END) ELSE a.w[k] END), loss: a.loss + (1e0 - (s[r.y] - list_max(s)))}})[1], {{x: [0e0], y: 1, q: 0e0, w: {_NOUGHT}, loss: 0e0}}) AS m, len(xs) AS fitted FROM l)
SELECT CAST(i - 1 AS INTEGER) AS pos, round(flatten(m.w)[i], 6) + 0.0 AS value, fitted, round(m.loss, 4) AS loss FROM m, range(1, 651) t(i)"""


@query("multiclass_pa_train", MULTI)
def _(spark, d):
    out = fold.train(tables.embedding_points(spark, d), LearnerSpec("MulticlassPA", {"nClasses": 10}), ["vec_id"])
    return out.select("pos", r6("value").alias("value"), "fitted", F.round("loss", 4).alias("loss"))


@query("nn_train")
def _(spark, d):
    rows = tables.embedding_points(spark, d)
    return rounded(fold.learning_curve(rows, LearnerSpec("NN", {"layers": [32], "learningRate": 0.01}), ["vec_id"], 64), "mean_loss")


# ---- buffers and splits ----------------------------------------------------------------------------------------------
@query("buffer_keep_newest", "SELECT event_id, value FROM events ORDER BY event_id DESC LIMIT 500")
def _(spark, d):
    return tables.Buffer(500).keep_newest(table(spark, d, "events").select("event_id", "value"), "event_id")


@query("buffer_evicted", "SELECT event_id, value FROM events WHERE event_id NOT IN (SELECT event_id FROM events ORDER BY event_id DESC LIMIT 500)")
def _(spark, d):
    return tables.Buffer(500).evicted(table(spark, d, "events").select("event_id", "value"), "event_id")


@query("buffer_random_remove", "SELECT event_id, value FROM events ORDER BY md5('1|' || event_id), event_id LIMIT 500")
def _(spark, d):
    return tables.Buffer(500).keep_random(table(spark, d, "events").select("event_id", "value"), "event_id")


@query("buffer_complete_merge", "SELECT event_id, row_number() OVER (ORDER BY md5('3|' || event_id), event_id) > 700 AS evicted FROM events")
def _(spark, d):
    """Two buffers merged beyond the bound: what stays and what goes."""
    rows = table(spark, d, "events").select("event_id", "value")
    merged = tables.merge_buffers(rows.where("value >= 50"), rows.where("value < 50"), "event_id", 2)
    kept, gone = tables.Buffer(700).complete_merge(merged.select("event_id"), "event_id", 3)
    return kept.withColumn("evicted", F.lit(False)).unionByName(gone.withColumn("evicted", F.lit(True)))


@query("buffer_merge", "WITH a AS (SELECT event_id, row_number() OVER (ORDER BY event_id) - 1 AS rn, count(*) OVER () AS n FROM events WHERE value >= 50), b AS (SELECT event_id, row_number() OVER (ORDER BY event_id) - 1 AS rn FROM events WHERE value < 50) SELECT event_id, CAST(rn + rn // 2 AS BIGINT) AS place FROM a UNION ALL SELECT event_id, CAST(CASE WHEN rn < (SELECT count(*) // 2 FROM a) THEN (rn + 1) * 2 + rn ELSE (SELECT count(*) FROM a) + rn END AS BIGINT) FROM b")
def _(spark, d):
    rows = table(spark, d, "events").select("event_id", "value")
    return tables.merge_buffers(rows.where("value >= 50"), rows.where("value < 50"), "event_id", 2).select("event_id", F.col("place").cast("long").alias("place"))


@query("holdout_split", "WITH r AS (SELECT event_id, row_number() OVER (ORDER BY event_id) - 1 AS rn FROM events), h AS (SELECT event_id, row_number() OVER (ORDER BY rn DESC) AS newest FROM r WHERE rn % 10 >= 8) SELECT event_id, CASE WHEN newest IS NULL THEN 'train' WHEN newest <= 256 THEN 'test' ELSE 'evicted' END AS split FROM r LEFT JOIN h USING (event_id)")
def _(spark, d):
    return tables.holdout(table(spark, d, "events").select("event_id"), ["event_id"]).select("event_id", "split")


@query("json_instance_decode", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def _(spark, d):
    return table(spark, d, "events").select("event_id", tables.decode(F.col("props"), "k bigint")["k"].alias("k"))


@query("point_record", "SELECT event_id, round(value, 6) + 0.0 AS numeric, event_type AS categorical, 8 + 8 * length(event_type) + 8 * length(props) AS bytes FROM events")
def _(spark, d):
    rows = tables.points(table(spark, d, "events"), [F.col("value")], categorical=[F.col("event_type")], raw=F.col("props"), keep=["event_id"])
    size = 8 * F.size("numeric") + F.aggregate("categorical", F.lit(0), lambda a, c: a + 8 * F.length(c)) + 8 * F.length("raw")
    return rows.select("event_id", r6(F.col("numeric")[0]).alias("numeric"), F.col("categorical")[0].alias("categorical"), size.cast("long").alias("bytes"))


# ---- tree statistics and naive Bayes ---------------------------------------------------------------------------------
CLASS = "CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END"


def _classes(spark, d):
    return table(spark, d, "lineitem").withColumn("class", F.when(F.col("l_returnflag") == "A", 0).when(F.col("l_returnflag") == "N", 1).otherwise(2))


def _attributes():
    return {"discount": F.col("l_discount") * 100, "price": F.col("l_extendedprice") / 1000, "quantity": F.col("l_quantity"), "tax": F.col("l_tax") * 100}


CELLS = f"(SELECT {KEY}, l_linestatus, {CLASS} AS class, unnest(['discount', 'price', 'quantity', 'tax']) AS attr, unnest([l_discount * 100, l_extendedprice / 1000, l_quantity, l_tax * 100]) AS value FROM lineitem)"


@query("nb_class_distribution", f"SELECT {CLASS} AS class, count(*) AS n, round(count(*) / (SELECT count(*) FROM lineitem)::DOUBLE, 6) AS fraction FROM lineitem GROUP BY 1")
def _(spark, d):
    return rounded(statistics.class_distribution(_classes(spark, d), "class"), "fraction")


@query("nb_entropy", "SELECT round(-sum(p * log2(p)), 6) AS entropy FROM (SELECT count(*) / (SELECT count(*) FROM lineitem)::DOUBLE AS p FROM lineitem GROUP BY l_returnflag)")
def _(spark, d):
    return rounded(statistics.entropy(statistics.class_distribution(_classes(spark, d), "class")), "entropy")


@query("nb_majority", f"SELECT class, round(n / (SELECT count(*) FROM lineitem)::DOUBLE, 6) AS fraction FROM (SELECT {CLASS} AS class, count(*) AS n FROM lineitem GROUP BY 1) ORDER BY n DESC, class LIMIT 1")
def _(spark, d):
    return rounded(statistics.majority(statistics.class_distribution(_classes(spark, d), "class")), "fraction")


@query("nb_gaussian_stats", f"SELECT attr, class, count(*) AS n, round(avg(value), 6) AS mean, round(var_samp(value), 6) AS variance, round(min(value), 6) + 0.0 AS lo, round(max(value), 6) + 0.0 AS hi FROM {CELLS} GROUP BY 1, 2")
def _(spark, d):
    stats = statistics.gaussians(statistics.long_form(_classes(spark, d), _attributes(), "class"))
    return rounded(stats.drop("d"), "mean", "variance", "lo", "hi")


@query("nb_gaussian_merge", f"SELECT attr, class, CAST(count(*) AS BIGINT) AS n, round(avg(value), 6) AS mean, round(var_samp(value), 6) AS variance FROM {CELLS} GROUP BY 1, 2")
def _(spark, d):
    parts = statistics.gaussians(statistics.long_form(_classes(spark, d), _attributes(), "class", ["l_linestatus"]), "l_linestatus")
    return rounded(statistics.merge_gaussians(parts), "mean", "variance")


@query("attr_range", f"SELECT attr, round(min(value), 6) + 0.0 AS lo, round(max(value), 6) + 0.0 AS hi FROM {CELLS} GROUP BY 1")
def _(spark, d):
    cells = statistics.long_form(_classes(spark, d), _attributes(), "class")
    return rounded(cells.groupBy("attr").agg(F.min("value").alias("lo"), F.max("value").alias("hi")), "lo", "hi")


@query("split_candidates", f"SELECT attr, CAST(i AS INTEGER) AS i, round(lo + i / 11::DOUBLE * (hi - lo), 6) + 0.0 AS at_value FROM (SELECT attr, min(value) AS lo, max(value) AS hi FROM {CELLS} GROUP BY 1), range(1, 11) t(i)")
def _(spark, d):
    stats = statistics.gaussians(statistics.long_form(_classes(spark, d), _attributes(), "class"))
    return statistics.candidates(stats).select("attr", "i", r6("at").alias("at_value"))


def _cdf(z: str) -> str:
    t = f"(1e0 / (1e0 + 0.3275911::DOUBLE * abs({z}) / sqrt(2e0)))"
    tail = "0e0"
    for c in tree_plan.ERF[::-1]:
        tail = f"(({tail} + {c}::DOUBLE) * {t})"
    tail = f"({tail} * exp(-({z}) * ({z}) / 2) / 2)"
    return f"(CASE WHEN {z} >= 0 THEN 1 - {tail} ELSE {tail} END)"


@query("normal_cdf", f"SELECT event_id, round({_cdf('((value - 50) / 20)')}, 6) + 0.0 AS p FROM events")
def _(spark, d):
    return table(spark, d, "events").select("event_id", r6(tree_plan.normal_cdf((F.col("value") - 50) / 20)).alias("p"))


_STATS = f"SELECT attr, class, count(*)::DOUBLE AS n, avg(value) AS mean, var_samp(value) AS v FROM {CELLS} GROUP BY 1, 2"
_CANDIDATES = f"SELECT attr, CAST(i AS INTEGER) AS i, lo + i / 11::DOUBLE * (hi - lo) AS cut FROM (SELECT attr, min(value) AS lo, max(value) AS hi FROM {CELLS} GROUP BY 1), range(1, 11) t(i)"
_SIDES = f"s AS ({_STATS}), c AS ({_CANDIDATES}), e AS (SELECT attr, i, cut, class, n, exp(-((cut - mean) ** 2) / (2 * v)) / (sqrt(v) * sqrt(2 * pi())) * n AS same, {_cdf('((cut - mean) / sqrt(v))')} * n AS upto FROM c JOIN s USING (attr))"


def _gaussian_splits(spark, d):
    stats = statistics.gaussians(statistics.long_form(_classes(spark, d), _attributes(), "class"))
    return stats, statistics.candidates(stats)


@query("split_weights", f"WITH {_SIDES} SELECT attr, i, class, round(upto - same, 2) + 0.0 AS below, round(same, 2) + 0.0 AS same, round(greatest(0, n - upto), 2) + 0.0 AS above FROM e")
def _(spark, d):
    stats, thresholds = _gaussian_splits(spark, d)
    rows = thresholds.join(stats, "attr")
    parts = tree_plan.weights(F.col("at"), F.col("n"), F.col("mean"), F.col("variance"))
    return rows.select("attr", "i", "class", *[(F.round(c, 2) + F.lit(0.0)).alias(n) for n, c in zip(("below", "same", "above"), parts)])


@query("numeric_gain", f"WITH {_SIDES}, g AS (SELECT attr, i, cut, sum(n) AS n, sum(upto) AS l, sum(greatest(0, n - upto)) AS r FROM e GROUP BY 1, 2, 3), h AS (SELECT e.attr, e.i, sum(-e.n / g.n * log2(e.n / g.n)) AS hn, sum(CASE WHEN upto > 0 THEN -upto / l * log2(upto / l) ELSE 0 END) AS hl, sum(CASE WHEN e.n - upto > 0 THEN -(e.n - upto) / r * log2((e.n - upto) / r) ELSE 0 END) AS hr FROM e JOIN g ON e.attr = g.attr AND e.i = g.i GROUP BY 1, 2) SELECT attr, i, round(cut, 6) + 0.0 AS at_value, round(hn - (l * hl + r * hr) / (l + r), 6) + 0.0 AS gain FROM g JOIN h USING (attr, i) WHERE least(l, r) / (l + r) >= 0.01::DOUBLE")
def _(spark, d):
    return tree_plan.numeric_gains(*_gaussian_splits(spark, d)).select("attr", "i", r6("at").alias("at_value"), r6("gain").alias("gain"))


@query("tree_route", f"SELECT CAST(CASE WHEN l_quantity <= 25 THEN CASE WHEN l_tax * 100 <= 4.5::DOUBLE THEN 0 ELSE 1 END ELSE CASE WHEN l_extendedprice / 1000 <= 50 THEN 2 ELSE CASE WHEN l_discount * 100 <= 5.5::DOUBLE THEN 3 ELSE 4 END END END AS INTEGER) AS leaf, {CLASS} AS class, count(*) AS n FROM lineitem GROUP BY 1, 2")
def _(spark, d):
    """A given tree (attributes in the order discount, price, quantity, tax) as conditions on the rows."""
    tree, leaf = tree_plan.HT(classes=3), lambda: tree_plan.Leaf(4, False)
    tree.root = [2, 25.0, [3, 4.5, leaf(), leaf(), 1], [1, 50.0, leaf(), [0, 5.5, leaf(), leaf(), 2], 1], 0]
    rows = _tree_points(spark, d).select(tree_plan.route(tree, F.col("numeric")).alias("leaf"), F.col("label").cast("int").alias("class"))
    return rows.groupBy("leaf", "class").agg(F.count(F.lit(1)).alias("n"))


_NB = " + ".join(f"(-(({x} - max(m) FILTER (attr = '{a}')) ** 2) / (2 * max(v) FILTER (attr = '{a}')) - ln(sqrt(max(v) FILTER (attr = '{a}') * 2 * pi())))" for a, x in (("discount", "l_discount * 100"), ("price", "l_extendedprice / 1000"), ("quantity", "l_quantity"), ("tax", "l_tax * 100")))


@query("nb_predict", f"WITH s AS (SELECT attr, class, avg(value) AS m, var_samp(value) AS v FROM {CELLS} GROUP BY 1, 2), p AS (SELECT {CLASS} AS class, count(*) / (SELECT count(*) FROM lineitem)::DOUBLE AS prior FROM lineitem GROUP BY 1), j AS (SELECT row_number() OVER () AS r, l_discount, l_extendedprice, l_quantity, l_tax FROM lineitem), q AS (SELECT r, s.class, ln(prior) + {_NB} AS score FROM j, s JOIN p ON p.class = s.class GROUP BY r, l_discount, l_extendedprice, l_quantity, l_tax, s.class, prior), z AS (SELECT class AS predicted, row_number() OVER (PARTITION BY r ORDER BY score DESC, class) AS k FROM q) SELECT predicted, count(*) AS n FROM z WHERE k = 1 GROUP BY 1")
def _(spark, d):
    rows = _classes(spark, d)
    stats = statistics.gaussians(statistics.long_form(rows, _attributes(), "class"))
    predicted = statistics.naive_bayes(_attributes(), stats, statistics.class_distribution(rows, "class"))
    return rows.select(predicted.alias("predicted")).groupBy("predicted").agg(F.count(F.lit(1)).alias("n"))


DISC = f"(SELECT {CLASS} AS class, unnest(['linenumber', 'quantity']) AS attr, unnest([l_linenumber::DOUBLE, l_quantity]) AS value FROM lineitem)"


def _discrete(spark, d):
    return statistics.long_form(_classes(spark, d), {"linenumber": F.col("l_linenumber"), "quantity": F.col("l_quantity")}, "class")


@query("discrete_counts", f"WITH c AS (SELECT attr, value, class, count(*) AS n FROM {DISC} GROUP BY 1, 2, 3) SELECT attr, value, class, coalesce(n, 0) AS n FROM (SELECT DISTINCT attr, value FROM c) CROSS JOIN (SELECT DISTINCT class FROM c) LEFT JOIN c USING (attr, value, class)")
def _(spark, d):
    return statistics.discrete_counts(_discrete(spark, d))


@query("discrete_splits", f"WITH v AS (SELECT DISTINCT attr, value AS at_value FROM {DISC}), s AS (SELECT v.attr, at_value, c.value <= at_value AS lft, class, count(*)::DOUBLE AS n FROM v JOIN {DISC} c ON c.attr = v.attr GROUP BY 1, 2, 3, 4), t AS (SELECT attr, at_value, lft, sum(n) AS m, -sum(n / tot * log2(n / tot)) AS h FROM (SELECT *, sum(n) OVER (PARTITION BY attr, at_value, lft) AS tot FROM s) GROUP BY 1, 2, 3) SELECT attr, at_value, round(sum(m * h) / sum(m), 6) AS weighted FROM t GROUP BY 1, 2 HAVING count(*) = 2")
def _(spark, d):
    return statistics.discrete_splits(statistics.discrete_counts(_discrete(spark, d))).select("attr", F.col("at").alias("at_value"), r6("weighted").alias("weighted"))


@query("discrete_nb_predict", f"WITH j AS (SELECT l_linenumber::DOUBLE AS a, l_quantity AS b, {CLASS} AS class FROM lineitem), t AS (SELECT class, count(*)::DOUBLE AS n FROM j GROUP BY 1), x AS (SELECT class, a, count(*) AS na FROM j GROUP BY 1, 2), y AS (SELECT class, b, count(*) AS nb FROM j GROUP BY 1, 2), p AS (SELECT DISTINCT a, b FROM j), s AS (SELECT p.a, p.b, t.class, coalesce(na, 0) / t.n * coalesce(nb, 0) AS score FROM p CROSS JOIN t LEFT JOIN x ON x.class = t.class AND x.a = p.a LEFT JOIN y ON y.class = t.class AND y.b = p.b) SELECT a AS linenumber, b AS quantity, class AS predicted FROM s QUALIFY row_number() OVER (PARTITION BY a, b ORDER BY score DESC, class) = 1")
def _(spark, d):
    rows = _classes(spark, d).select(F.col("l_linenumber").cast("double").alias("a"), F.col("l_quantity").alias("b"), "class")
    t = rows.groupBy("class").agg(F.count(F.lit(1)).cast("double").alias("n"))
    x, y = (rows.groupBy("class", c).agg(F.count(F.lit(1)).alias(f"n{c}")) for c in ("a", "b"))
    s = rows.select("a", "b").distinct().join(F.broadcast(t)).join(x, ["class", "a"], "left").join(y, ["class", "b"], "left")
    s = s.withColumn("score", F.coalesce("na", F.lit(0)) / F.col("n") * F.coalesce("nb", F.lit(0)))
    return s.groupBy(F.col("a").alias("linenumber"), F.col("b").alias("quantity")).agg(F.max_by("class", F.struct("score", -F.col("class"))).alias("predicted"))


@query("hoeffding_bound", f"SELECT {CLASS} AS class, count(*) AS n, round(sqrt(log2(3) ** 2 * ln(1 / 1e-7) / (2 * count(*))), 6) AS epsilon FROM lineitem GROUP BY 1")
def _(spark, d):
    rows = _classes(spark, d).groupBy("class").agg(F.count(F.lit(1)).alias("n"))
    return rows.select("class", "n", r6(statistics.hoeffding(F.col("n"), 3)).alias("epsilon"))


NODES = "node_id int, parent_id int, is_left boolean, attribute int, value double, height int, is_leaf boolean, n bigint, errors bigint, active boolean, majority double"


def _tree_points(spark, d):
    rows = _classes(spark, d)
    return rows.select(*LINE_ORDER, F.col("class").cast("double").alias("label"), F.array(*[c.cast("double") for c in _attributes().values()]).alias("numeric"))


def _tree(spark, d):
    return tree_plan.grow(_tree_points(spark, d), LINE_ORDER, tree_plan.HT(classes=3))


@query("hoeffding_tree_train")
def _(spark, d):
    return spark.createDataFrame(_tree(spark, d).nodes(), NODES)


@query("hoeffding_tree_predict")
def _(spark, d):
    """Routing by the tree's tests, naive Bayes at the leaves by a join with their statistics."""
    out = tree_plan.predict(_tree_points(spark, d), _tree(spark, d), keep=["label"])
    return out.groupBy("label", "predicted").agg(F.count(F.lit(1)).alias("n"))


# ---- protocols -------------------------------------------------------------------------------------------------------
def _workers(spark, d, label="returned", n=4):
    return tables.with_worker(lineitem_points(spark, d, label), "l_orderkey", n)


def _protocol(name, n=4, learner="PA", label="returned", hyper=None, **more):
    def run(spark, d):
        out = protocols.train(_workers(spark, d, label, n), LearnerSpec(learner, hyper or {}), ProtocolSpec(name, workers=n, **more), LINE_ORDER)
        return out.withColumns({"value": r6("value"), "loss": F.round("loss", 4)})

    return run


ROW = "{x1: x1, x2: x2, x3: x3, y: y, q: x1 * x1 + x2 * x2 + x3 * x3 + 1e0, w1: 0e0, w2: 0e0, w3: 0e0, b: 0e0, loss: 0e0}"
BLOCKS = f"SELECT w, rd, list({ROW} ORDER BY rn) AS rows FROM (SELECT *, rn // 256 + (w > 0)::INTEGER AS rd FROM (SELECT *, l_orderkey % 4 AS w, row_number() OVER (PARTITION BY l_orderkey % 4 ORDER BY {KEY}) - 1 AS rn FROM {LINES})) GROUP BY 1, 2"
_M = "(r.x1 * a.w1 + r.x2 * a.w2 + r.x3 * a.w3 + a.b)"
_H = f"greatest(0e0, 1e0 - r.y * {_M})"
_T = f"({_H} / (r.q + 1e0 / (2e0 * 0.01::DOUBLE)) * r.y)"
_BLANK = "{w1: 0e0, w2: 0e0, w3: 0e0, b: 0e0, loss: 0e0}"


def _learned(rows: str, model: str) -> str:
    """The model after a block of rows: a left fold, whose loss begins at 0."""
    start = f"{{x1: 0e0, x2: 0e0, x3: 0e0, y: 0e0, q: 0e0, w1: {model}.w1, w2: {model}.w2, w3: {model}.w3, b: {model}.b, loss: 0e0}}"
    step = "{x1: r.x1, x2: r.x2, x3: r.x3, y: r.y, q: r.q, " + ", ".join(f"w{k}: a.w{k} + {_T} * r.x{k}" for k in (1, 2, 3)) + f", b: a.b + {_T}, loss: a.loss + {_H}}}"
    return f"list_transform([list_reduce({rows}, lambda a, r: {step}, {start})], lambda z: {{w1: z.w1, w2: z.w2, w3: z.w3, b: z.b, loss: z.loss}})[1]"


def _each(form: str) -> str:
    return "{" + ", ".join(f"{c}: {form.format(c=c)}" for c in ("w1", "w2", "w3", "b")) + ", loss: 0e0}"


def _final_sql(models: str) -> str:
    stats = f"(SELECT CAST(sum(n) AS BIGINT) AS fitted, CAST(sum(n // 256) AS BIGINT) AS pushes, CAST(min(n // 256 - (w = 0)::INTEGER) AS BIGINT) AS full_rounds FROM (SELECT l_orderkey % 4 AS w, count(*) AS n FROM lineitem GROUP BY 1))"
    return f"SELECT CAST(i - 1 AS INTEGER) AS pos, round([m.g.w1, m.g.w2, m.g.w3, m.g.b][i], 6) + 0.0 AS value, fitted, round(m.loss, 4) AS loss, {models} AS models_shipped, ({models}) * 64 AS bytes_shipped, {models} AS blocks, {{rounds}} AS rounds, CAST(0 AS BIGINT) AS subrounds FROM m, {stats}, range(1, 5) t(i)"


def rounds_sql(when: str, models: str, shipped_rounds: str) -> str:
    """Protocols that look at all workers' models at the end of a round. when: whether they are averaged."""
    mean = _each("(s[1].{c} + s[2].{c} + s[3].{c} + s[4].{c}) / 4")
    step = f"""list_transform([list_transform([1, 2, 3, 4], lambda k: {_learned("e.blocks[k]", "c.models[k]")})], lambda s: list_transform([CASE WHEN e.rd = 0 THEN s[1] WHEN {when} THEN {mean} END], lambda g: {{rd: e.rd, blocks: e.blocks[1:0], models: CASE WHEN g IS NULL THEN s ELSE [g, g, g, g] END, g: coalesce(g, c.g), loss: c.loss + s[1].loss + s[2].loss + s[3].loss + s[4].loss, averaged: c.averaged + (e.rd > 0 AND g IS NOT NULL)::BIGINT}})[1])[1]"""
    zero = f"models: [{_BLANK}, {_BLANK}, {_BLANK}, {_BLANK}], g: {_BLANK}, loss: 0e0, averaged: 0::BIGINT"
    return f"""WITH b AS ({BLOCKS}),
r AS (SELECT rd, [coalesce(any_value(rows) FILTER (w = 0), []), coalesce(any_value(rows) FILTER (w = 1), []), coalesce(any_value(rows) FILTER (w = 2), []), coalesce(any_value(rows) FILTER (w = 3), [])] AS blocks FROM b GROUP BY 1),
l AS (SELECT list({{rd: rd, blocks: blocks, {zero}}} ORDER BY rd) AS es FROM r),
m AS (SELECT list_reduce(es, lambda c, e: {step}, {{rd: -1::BIGINT, blocks: es[1].blocks[1:0], {zero}}}) AS m FROM l)
{_final_sql(models).format(rounds=shipped_rounds)}"""


def pushes_sql(installed: str, base: str, models: str) -> str:
    """Protocols that take one worker's model at a time. installed, base: what the worker goes on with and counts its
    next difference from, of new model s, new hub g and clocks k."""
    hub = _each("c.g.{c} + (s.{c} - c.bases[e.w].{c}) / 4")
    clocks = "list_transform([1, 2, 3, 4], lambda j: c.clocks[j] + (j = e.w)::BIGINT)"
    turn = lambda what, old: f"CASE WHEN c.g IS NULL THEN [s, s, s, s] ELSE list_transform([1, 2, 3, 4], lambda j: CASE WHEN j = e.w THEN {what} ELSE {old}[j] END) END"
    step = f"""list_transform([{_learned("e.rows", "c.models[e.w]")}], lambda s: CASE WHEN len(e.rows) < 256
THEN {{w: e.w, rows: e.rows[1:0], models: list_transform([1, 2, 3, 4], lambda j: CASE WHEN j = e.w THEN s ELSE c.models[j] END), bases: c.bases, clocks: c.clocks, g: c.g, loss: c.loss + s.loss, sent: c.sent}}
ELSE list_transform([{clocks}], lambda k: list_transform([CASE WHEN c.g IS NULL THEN s ELSE {hub} END], lambda g: {{w: e.w, rows: e.rows[1:0], models: {turn(installed, "c.models")}, bases: {turn(base, "c.bases")}, clocks: k, g: g, loss: c.loss + s.loss, sent: c.sent + CASE WHEN c.g IS NULL THEN 4 ELSE {models} END}})[1])[1] END)[1]"""
    zero = f"models: [{_BLANK}, {_BLANK}, {_BLANK}, {_BLANK}], bases: [{_BLANK}, {_BLANK}, {_BLANK}, {_BLANK}], clocks: [0::BIGINT, 0::BIGINT, 0::BIGINT, 0::BIGINT], g: CASE WHEN true THEN NULL ELSE {_BLANK} END, loss: 0e0, sent: 0::BIGINT"
    return f"""WITH b AS ({BLOCKS}), l AS (SELECT list({{w: w + 1, rows: rows, {zero}}} ORDER BY rd, w) AS es FROM b),
m AS (SELECT list_reduce(es, lambda c, e: {step}, {{w: 1::BIGINT, rows: es[1].rows[1:0], {zero}}}) AS m FROM l)
{_final_sql("m.sent").format(rounds="CAST(0 AS BIGINT)")}"""


_FULL = "len(e.blocks[1]) = 256 AND len(e.blocks[2]) = 256 AND len(e.blocks[3]) = 256 AND len(e.blocks[4]) = 256"
_FAR = " OR ".join(f"(len(e.blocks[{k}]) = 256 AND (s[{k}].w1 - c.g.w1) ** 2 + (s[{k}].w2 - c.g.w2) ** 2 + (s[{k}].w3 - c.g.w3) ** 2 + (s[{k}].b - c.g.b) ** 2 > 0.0008::DOUBLE)" for k in (1, 2, 3, 4))
_LATE = "k[e.w] - list_min(k) > 3"
query("sync_train", rounds_sql(_FULL, "4 + 8 * full_rounds", "full_rounds"))(_protocol("Synchronous"))
query("async_train", pushes_sql("g", "g", "2"))(_protocol("Asynchronous"))
query("ssp_train", pushes_sql(f"CASE WHEN {_LATE} THEN g ELSE s END", f"CASE WHEN {_LATE} THEN g ELSE s END", f"CASE WHEN {_LATE} THEN 2 ELSE 1 END"))(_protocol("SSP"))
query("gm_train", rounds_sql(_FAR, "4 + 8 * m.averaged", "m.averaged"))(_protocol("GM"))
query("fgm_train")(_protocol("FGM"))
query("single_train", fold_sql(HINGE, f"({TAU['PA-II']}) * r.y", source=f"(SELECT * FROM {LINES} ORDER BY {KEY} LIMIT (SELECT count(*) // 256 * 256 FROM lineitem))").replace(", CAST(m.n AS BIGINT) AS fitted, round(m.loss, 4) AS loss", ""))(lambda spark, d: _protocol("CentralizedTraining", 1)(spark, d).select("pos", "value"))


@query("easgd_train")
def _(spark, d):
    rows = tables.with_worker(tables.embedding_points(spark, d), "vec_id", 2)
    out = protocols.train(rows, LearnerSpec("NN", {"layers": [8], "batchSize": 16}), ProtocolSpec("EASGD", workers=2, mini_batches=32), ["vec_id"])
    return rounded(out, "value", "loss")


@query("centralized_train", fold_sql(HINGE, f"({TAU['PA-II']}) * r.y", source=f"(SELECT * FROM (SELECT *, row_number() OVER (ORDER BY {KEY}) - 1 AS rn FROM {LINES}) WHERE rn % 10 < 8 OR rn IN (SELECT rn FROM (SELECT row_number() OVER (ORDER BY {KEY}) - 1 AS rn FROM lineitem) WHERE rn % 10 >= 8 ORDER BY rn DESC OFFSET 256))"))
def _(spark, d):
    """The hub trains on what isn't held out; what its test buffer evicts is trained at its own place."""
    rows = tables.holdout(lineitem_points(spark, d), LINE_ORDER).where("split <> 'test'")
    out = fold.train(rows, LearnerSpec("PA"), LINE_ORDER)
    return out.select("pos", r6("value").alias("value"), "fitted", F.round("loss", 4).alias("loss"))


@query("sync_curve")
def _(spark, d):
    return rounded(protocols.curve(_workers(spark, d), LearnerSpec("PA"), ProtocolSpec("Synchronous", workers=4), LINE_ORDER), "mean_loss")


@query("sync_average_orr", f"""WITH r AS (SELECT x1, price, l_orderkey % 4 AS w, (row_number() OVER (PARTITION BY l_orderkey % 4 ORDER BY {KEY}) - 1) // 256 + CASE WHEN l_orderkey % 4 = 0 THEN 0 ELSE 1 END AS rd FROM {LINES}),
f AS (SELECT min(n) AS last FROM (SELECT w, count(*) // 256 + CASE WHEN w = 0 THEN -1 ELSE 0 END AS n FROM r GROUP BY 1)),
s AS (SELECT sum(CASE WHEN rd = 0 THEN x1 * x1 ELSE x1 * x1 / 4 END) AS a, sum(CASE WHEN rd = 0 THEN x1 ELSE x1 / 4 END) AS b, sum(CASE WHEN rd = 0 THEN 1e0 ELSE 0.25::DOUBLE END) AS c, sum(CASE WHEN rd = 0 THEN price * x1 ELSE price * x1 / 4 END) AS e, sum(CASE WHEN rd = 0 THEN price ELSE price / 4 END) AS g FROM r, f WHERE rd <= last)
SELECT CAST(i - 1 AS INTEGER) AS pos, round([a, b, b, c, e, g][i], 6) AS value FROM s, range(1, 7) t(i)""")
def _(spark, d):
    out = protocols.train(_workers(spark, d, "price"), LearnerSpec("ORR"), ProtocolSpec("Synchronous", workers=4), LINE_ORDER, losses=False)
    return out.select("pos", r6("value").alias("value"))


def _statistics(spark, d, names):
    out, every = None, protocols.trains(_workers(spark, d), LearnerSpec("PA"), [ProtocolSpec(name, workers=4) for name in names], LINE_ORDER)
    for name, one in zip(names, every):
        one = one.where("pos = 0").select(F.lit(protocols.LABELS[name]).alias("protocol"), "fitted", "models_shipped", "bytes_shipped", "blocks", "rounds", "subrounds")
        out = one if out is None else out.unionByName(one)
    return out


@query("protocol_statistics", "WITH w AS (SELECT l_orderkey % 4 AS w, count(*) AS n FROM lineitem GROUP BY 1), s AS (SELECT sum(n) AS fitted, sum(n // 256) AS pushes, min(n // 256 - (w = 0)::INTEGER) AS full_rounds FROM w), p AS (SELECT 'SingleLearner' AS protocol, fitted, pushes AS models, 0 AS rounds FROM s UNION ALL SELECT 'AsynchronousAveraging', fitted, 4 + 2 * (pushes - 1), 0 FROM s UNION ALL SELECT 'SynchronousAveraging', fitted, 4 + 8 * full_rounds, full_rounds FROM s) SELECT protocol, CAST(fitted AS BIGINT) AS fitted, CAST(models AS BIGINT) AS models_shipped, CAST(models * 64 AS BIGINT) AS bytes_shipped, CAST(models AS BIGINT) AS blocks, CAST(rounds AS BIGINT) AS rounds, CAST(0 AS BIGINT) AS subrounds FROM p")
def _(spark, d):
    """What goes over the wire where that follows from the workers' numbers of points alone."""
    return _statistics(spark, d, ("CentralizedTraining", "Asynchronous", "Synchronous"))


@query("protocol_statistics_monitored")
def _(spark, d):
    """Where it depends on the models too."""
    return _statistics(spark, d, ("SSP", "GM", "FGM"))


PAIR = f"(SELECT vec_id, list_transform(x[1:32], lambda v: v / 50) AS w, list_transform(x[33:64], lambda v: v / 50) AS g FROM {EMB})"
DIST2 = "list_sum(list_transform(range(1, 33), lambda i: (w[i] - g[i]) * (w[i] - g[i])))"


def _pairs(spark, d):
    rows = tables.embedding_points(spark, d)
    half = lambda a: F.transform(F.slice("numeric", a, 32), lambda v: v / 50)
    rows = rows.select("vec_id", half(1).alias("w"), half(33).alias("g"))
    diff = V.subtract(F.col("w"), F.col("g"))
    return rows.withColumn("d2", V.dot(diff, diff))


@query("gm_violation", f"SELECT vec_id, round({DIST2}, 6) AS d2, {DIST2} > 0.0008::DOUBLE AS violated FROM {PAIR}")
def _(spark, d):
    return _pairs(spark, d).select("vec_id", r6("d2").alias("d2"), (F.col("d2") > 0.0008).alias("violated"))


@query("safe_zone", f"SELECT vec_id, round(sqrt(0.0008::DOUBLE) - sqrt({DIST2}), 6) + 0.0 AS zeta FROM {PAIR}")
def _(spark, d):
    return _pairs(spark, d).select("vec_id", r6(F.sqrt(F.lit(0.0008)) - F.sqrt("d2")).alias("zeta"))


@query("fgm_increment", f"SELECT vec_id, CAST(greatest(0, floor(sqrt({DIST2}) / (sqrt(0.0008::DOUBLE) / 2))) AS BIGINT) AS increment FROM {PAIR}")
def _(spark, d):
    return _pairs(spark, d).select("vec_id", F.greatest(F.lit(0), F.floor(F.sqrt("d2") / (F.sqrt(F.lit(0.0008)) / 2))).cast("long").alias("increment"))


@query("fgm_subround", f"WITH z AS (SELECT vec_id // 4 AS grp, sqrt(0.0008::DOUBLE) - sqrt({DIST2}) AS zeta FROM {PAIR}) SELECT grp, round(sum(zeta), 6) + 0.0 AS psi, sum(zeta) > 0.01::DOUBLE * count(*) * sqrt(0.0008::DOUBLE) AS goes_on, round(sum(zeta) / (2 * count(*)), 6) + 0.0 AS quantum FROM z GROUP BY 1")
def _(spark, d):
    z = _pairs(spark, d).select(F.expr("vec_id div 4").alias("grp"), (F.sqrt(F.lit(0.0008)) - F.sqrt("d2")).alias("zeta"))
    g = z.groupBy("grp").agg(F.sum("zeta").alias("psi"), F.count(F.lit(1)).alias("k"))
    return g.select("grp", r6("psi").alias("psi"), (F.col("psi") > 0.01 * F.col("k") * F.sqrt(F.lit(0.0008))).alias("goes_on"), r6(F.col("psi") / (2 * F.col("k"))).alias("quantum"))


@query("easgd_step", f"SELECT vec_id, CAST(i - 1 AS INTEGER) AS pos, round(w[i] - 0.1::DOUBLE * (w[i] - g[i]), 6) + 0.0 AS worker, round(g[i] + 0.1::DOUBLE * (w[i] - g[i]), 6) + 0.0 AS hub FROM {PAIR}, range(1, 33) t(i)")
def _(spark, d):
    gap = V.subtract(F.col("w"), F.col("g"))
    rows = _pairs(spark, d).select("vec_id", F.arrays_zip(V.axpy(-0.1, gap, F.col("w")).alias("w"), V.axpy(0.1, gap, F.col("g")).alias("g")).alias("z"))
    return rows.select("vec_id", F.posexplode("z").alias("pos", "z")).select("vec_id", "pos", r6("z.w").alias("worker"), r6("z.g").alias("hub"))


# ---- vectors and messages --------------------------------------------------------------------------------------------
@query("vector_dot", f"SELECT vec_id, round(list_sum(list_transform(range(1, 33), lambda i: x[i] * x[i + 32])), 6) + 0.0 AS dot, round(sqrt(list_sum(list_transform(x, lambda v: v * v))), 6) AS norm FROM {EMB}")
def _(spark, d):
    rows = tables.embedding_points(spark, d)
    return rows.select("vec_id", r6(V.dot(F.slice("numeric", 1, 32), F.slice("numeric", 33, 32))).alias("dot"), r6(V.norm(F.col("numeric"))).alias("norm"))


@query("vector_outer", f"SELECT vec_id, CAST(i - 1 AS INTEGER) AS i, round(list_sum(list_transform(x, lambda v: x[i] * v)), 5) + 0.0 AS total, round(x[i] * x[1], 6) + 0.0 AS first, round(x[i] * x[64], 6) + 0.0 AS last FROM {EMB}, range(1, 65) t(i)")
def _(spark, d):
    """The outer product of each vector with itself, told by its rows."""
    rows = tables.embedding_points(spark, d).select("vec_id", F.posexplode(V.outer(F.col("numeric"), F.col("numeric"))).alias("i", "row"))
    return rows.select("vec_id", "i", (F.round(V.total(F.col("row")), 5) + F.lit(0.0)).alias("total"), r6(F.col("row")[0]).alias("first"), r6(F.col("row")[63]).alias("last"))


@query("vector_axpy", f"SELECT vec_id, CAST(i - 1 AS INTEGER) AS pos, round(2 * x[i] + x[i + 32], 6) + 0.0 AS a, round(x[i] + x[i + 32], 6) + 0.0 AS s, round(x[i] - x[i + 32], 6) + 0.0 AS m, round(3 * x[i], 6) + 0.0 AS k FROM {EMB}, range(1, 33) t(i)")
def _(spark, d):
    rows = tables.embedding_points(spark, d).select("vec_id", F.slice("numeric", 1, 32).alias("u"), F.slice("numeric", 33, 32).alias("v"))
    parts = F.arrays_zip(V.axpy(2.0, F.col("u"), F.col("v")).alias("a"), V.add(F.col("u"), F.col("v")).alias("s"), V.subtract(F.col("u"), F.col("v")).alias("m"), V.scale(3.0, F.col("u")).alias("k"))
    return rows.select("vec_id", F.posexplode(parts).alias("pos", "z")).select("vec_id", "pos", *[r6(f"z.{n}").alias(n) for n in "asmk"])


@query("sparse_encode", f"SELECT vec_id, CAST(i - 1 AS INTEGER) AS idx, round(x[i], 6) AS value FROM (SELECT vec_id, list_transform(x, lambda v: CASE WHEN v > 0.1::DOUBLE THEN v ELSE 0e0 END) AS x FROM {EMB}), range(1, 65) t(i) WHERE x[i] <> 0")
def _(spark, d):
    rows = tables.embedding_points(spark, d).select("vec_id", V.sparse(F.transform("numeric", lambda v: F.when(v > 0.1, v).otherwise(0.0))).alias("s"))
    return rows.select("vec_id", F.explode(F.arrays_zip(F.col("s.indices").alias("idx"), F.col("s.values").alias("value"))).alias("p")).select("vec_id", "p.idx", r6("p.value").alias("value"))


@query("sparse_dot", f"SELECT vec_id, round(list_sum(list_transform(range(1, 33), lambda i: CASE WHEN x[i] > 0.1::DOUBLE AND x[i + 32] > 0.1::DOUBLE THEN x[i] * x[i + 32] ELSE 0e0 END)), 6) + 0.0 AS dot FROM {EMB}")
def _(spark, d):
    big = lambda a: V.sparse(F.transform(F.slice("numeric", a, 32), lambda v: F.when(v > 0.1, v).otherwise(0.0)))
    return tables.embedding_points(spark, d).select("vec_id", r6(V.sparse_dot(big(1), big(33))).alias("dot"))


@query("coo_build", f"SELECT vec_id, CAST((i - 1) % 8 AS INTEGER) AS idx, round(sum(x[i]), 6) + 0.0 AS value FROM {EMB}, range(1, 65) t(i) GROUP BY 1, 2")
def _(spark, d):
    at = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: (i % 8).cast("int"))
    rows = tables.embedding_points(spark, d).select("vec_id", V.coo(F.lit(8), at, F.col("numeric")).alias("s"))
    return rows.select("vec_id", F.explode(F.arrays_zip(F.col("s.indices").alias("idx"), F.col("s.values").alias("value"))).alias("p")).select("vec_id", "p.idx", r6("p.value").alias("value"))


def buckets(df: DataFrame, size: str, hubs: int = 3, most: int = 10_000) -> DataFrame:
    """protocols.buckets for a column of sizes: hub, first, last."""
    rows = df.withColumn("hub", F.explode(F.sequence(F.lit(0), F.lit(hubs - 1))))
    rows = rows.withColumn("len", F.expr(f"{size} div {hubs}") + (F.col("hub") < F.pmod(F.col(size), F.lit(hubs))).cast("int"))
    rows = rows.withColumn("from", F.col("hub") * F.expr(f"{size} div {hubs}") + F.least(F.col("hub"), F.pmod(F.col(size), F.lit(hubs)))).where("len > 0")
    rows = rows.withColumn("first", F.explode(F.expr(f"sequence(`from`, `from` + len - 1, {most}L)")))
    return rows.withColumn("last", F.least(F.col("first") + most, F.col("from") + F.col("len")) - 1).drop("from", "len")


BUCKETS = "(SELECT o_orderkey, hub, first, least(first + 10000, frm + len) - 1 AS last FROM (SELECT *, unnest(range(frm, frm + len, 10000)) AS first FROM (SELECT o_orderkey, hub, sz // 3 + (hub < sz % 3)::INTEGER AS len, hub * (sz // 3) + least(hub, sz % 3) AS frm FROM (SELECT o_orderkey, CAST(floor(o_totalprice) AS BIGINT) AS sz FROM orders), range(3) h(hub))))"


@query("bucket_partition", f"SELECT o_orderkey, CAST(hub AS INTEGER) AS hub, CAST(first AS BIGINT) AS first, CAST(last AS BIGINT) AS last FROM {BUCKETS}")
def _(spark, d):
    rows = table(spark, d, "orders").select("o_orderkey", F.floor("o_totalprice").cast("bigint").alias("sz"))
    return buckets(rows, "sz").select("o_orderkey", "hub", F.col("first").cast("bigint").alias("first"), F.col("last").cast("bigint").alias("last"))


@query("message_bytes", f"SELECT o_orderkey, count(*) AS messages, CAST(sum(8 * (last - first + 1) + 32) AS BIGINT) AS bytes FROM {BUCKETS} GROUP BY 1")
def _(spark, d):
    rows = table(spark, d, "orders").select("o_orderkey", F.floor("o_totalprice").cast("bigint").alias("sz"))
    return buckets(rows, "sz").groupBy("o_orderkey").agg(F.count(F.lit(1)).alias("messages"), F.sum(8 * (F.col("last") - F.col("first") + 1) + 32).cast("bigint").alias("bytes"))


_BIG = f"(SELECT vec_id, list_transform(x, lambda v: CASE WHEN v > 0.1::DOUBLE THEN v ELSE 0e0 END) AS x FROM {EMB})"


def _messages(spark, d, sparse):
    rows = tables.embedding_points(spark, d).select("vec_id", F.transform("numeric", lambda v: F.when(v > 0.1, v).otherwise(0.0)).alias("v"))
    return tables.slices(rows, "v", 3, 10, 64, sparse)


@query("message_reassembly", f"SELECT vec_id, CAST(i - 1 AS INTEGER) AS pos, round(x[i], 6) + 0.0 AS value FROM {_BIG}, range(1, 65) t(i)")
def _(spark, d):
    """Vectors cut into sparse messages of ten parameters over three hubs, and put together again."""
    whole = tables.reassemble(_messages(spark, d, True), "vec_id", 64, True)
    return whole.select("vec_id", F.posexplode("vector").alias("pos", "v")).select("vec_id", "pos", r6("v").alias("value"))


@query("message_bytes_sparse", f"WITH h AS (SELECT vec_id, hub, 64 // 3 + (hub < 64 % 3)::INTEGER AS len, hub * (64 // 3) + least(hub, 64 % 3) AS frm, x FROM {_BIG}, range(3) t(hub)), m AS (SELECT vec_id, x[first + 1:least(first + 10, frm + len)] AS part FROM (SELECT *, unnest(range(frm, frm + len, 10)) AS first FROM h)) SELECT vec_id, count(*) AS messages, CAST(sum(12 * len(list_filter(part, lambda v: v <> 0)) + 36) AS BIGINT) AS bytes, CAST(sum(8 * len(part) + 32) AS BIGINT) AS dense_bytes FROM m GROUP BY 1")
def _(spark, d):
    full, kept = F.col("last") - F.col("first") + 1, F.size("part.values")
    size = 12 * kept + F.lit(protocols.sparse_message_bytes(0, 0))
    return _messages(spark, d, True).groupBy("vec_id").agg(F.count(F.lit(1)).alias("messages"), F.sum(size).cast("bigint").alias("bytes"), F.sum(8 * full + F.lit(protocols.message_bytes(0))).cast("bigint").alias("dense_bytes"))


# ---- streams ---------------------------------------------------------------------------------------------------------
EVENTS = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"
STREAMED = LearnerSpec("PA")


def _shared(spark) -> str:
    return f"{tables.shared_dir(spark)}/stream-{uuid.uuid4().hex}"


def _event_points(df: DataFrame) -> DataFrame:
    x = F.array(F.col("value") / 100, F.pmod("user_id", F.lit(7)) / 7)
    return df.select("event_id", F.pmod("event_id", F.lit(10)).alias("turn"), x.alias("numeric"), F.when(F.col("event_type") == "click", 1.0).otherwise(-1.0).alias("label"), F.lit(0).alias("worker"))


def _stream(spark, d, learner=STREAMED):
    from .streaming import online

    where = _shared(spark)
    spec = PipelineSpec(learner, protocol=ProtocolSpec("CentralizedTraining"))
    models = online.ModelTable(spark, f"{where}/models")
    rows = spark.readStream.schema(EVENTS).option("pathGlobFilter", "events.parquet").parquet(d)
    training = _event_points(rows).where("turn < 8")
    run = training.writeStream.foreachBatch(online.train_batch(spec, models, ["event_id"])).option("checkpointLocation", f"{where}/checkpoint").trigger(availableNow=True).start()
    run.awaitTermination()
    return spec, models


STREAM_ROWS = "(SELECT event_id AS l_orderkey, 0 AS l_linenumber, 0 AS l_partkey, 0 AS l_suppkey, 0 AS l_extendedprice, 0 AS l_shipdate, value / 100 AS x1, (user_id % 7) / 7 AS x2, 0e0 AS x3, CASE WHEN event_type = 'click' THEN 1e0 ELSE -1e0 END AS y FROM events WHERE event_id % 10 < 8)"
STREAM_MODEL = fold_sql(HINGE, f"({TAU['PA-II']}) * r.y", source=STREAM_ROWS).rpartition(" SELECT CAST(i - 1")[0]


@query("forecast_stream", f"{STREAM_MODEL} SELECT event_id, round((value / 100) * m.w1 + ((user_id % 7) / 7) * m.w2 + m.b, 4) + 0.0 AS margin FROM events, m WHERE event_id % 10 >= 8")
def _(spark, d):
    """Trains on a stream of events, then forecasts those whose turn it is with the last model."""
    spec, models = _stream(spark, d)
    rows = _event_points(table(spark, d, "events")).where("turn >= 8")
    params = next(list(r["params"]) for r in models.latest() if r["worker"] == -1)
    margin = V.dot(F.col("numeric"), V.literal(params[:-1])) + F.lit(params[-1])
    return rows.select("event_id", (F.round(margin, 4) + F.lit(0.0)).alias("margin"))


SVM_ROWS = "(SELECT l_orderkey + 0 AS l_orderkey, * EXCLUDE (l_orderkey) FROM " + STREAM_ROWS + ")"
SVM_MODEL = fold_sql(HINGE, "", svm=True, source=SVM_ROWS).rpartition(" SELECT CAST(i - 1")[0]


@query("svm_stream", f"{SVM_MODEL} SELECT CAST(i - 1 AS INTEGER) AS pos, round([m.w1, m.w2, m.b][i], 4) + 0.0 AS value, CAST(m.n AS BIGINT) AS fitted FROM m, range(1, 4) t(i)")
def _(spark, d):
    """A learner whose steps shrink with the points it has seen, over micro-batches: their count goes on with the model."""
    from .streaming import online

    spec, models = _stream(spark, d, LearnerSpec("SVM"))
    trained = online.model(spec, models)
    fitted = next(r["fitted"] for r in models.latest() if r["worker"] == -1)
    return spark.createDataFrame([(k, v, fitted) for k, v in enumerate(trained.get())], "pos int, value double, fitted bigint").select("pos", (F.round("value", 4) + F.lit(0.0)).alias("value"), "fitted")


@query("predict_function", f"{STREAM_MODEL} SELECT event_id, CASE WHEN (value / 100) * m.w1 + ((user_id % 7) / 7) * m.w2 + m.b >= 0 THEN 1e0 ELSE -1e0 END AS predicted FROM events, m")
def _(spark, d):
    """The trained pipeline as a function of SQL."""
    from .streaming import online

    spec, models = _stream(spark, d)
    name = online.register(spec, models, "clicks")
    view = f"points_{uuid.uuid4().hex}"
    _event_points(table(spark, d, "events")).createOrReplaceTempView(view)
    return spark.sql(f"SELECT event_id, {name}(numeric) AS predicted FROM {view}")


@query("model_query", f"{STREAM_MODEL}, s AS (SELECT avg((y = CASE WHEN x1 * m.w1 + x2 * m.w2 + m.b >= 0 THEN 1e0 ELSE -1e0 END)::INTEGER) AS score FROM {STREAM_ROWS.replace('< 8', '>= 8')}, m) SELECT CAST(7 AS BIGINT) AS query_id, 'PA' AS learner, 'CentralizedTraining' AS protocol, CAST(m.n AS BIGINT) AS fitted, round(m.loss, 4) AS cumulative_loss, round(score, 6) AS score FROM m, s")
def _(spark, d):
    from .streaming import online

    spec, models = _stream(spark, d)
    params = next(list(r["params"]) for r in models.latest() if r["worker"] == -1)
    held = online.predict(_event_points(table(spark, d, "events")).where("turn >= 8"), spec, params)
    score = scores.accuracy(held, "label", "prediction").first()[0]
    out = online.answer(models, spec, 7, score)
    return out.select("query_id", "learner", "protocol", "fitted", F.round("cumulative_loss", 4).alias("cumulative_loss"), F.round("score", 6).alias("score"))
