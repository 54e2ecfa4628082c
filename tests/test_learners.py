from __future__ import annotations

import json
import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from driftwell.functions import vectors as V
from driftwell.operators import learners as L
from driftwell.operators import scores, statistics, transforms
from driftwell.operators.spec import LearnerSpec, PipelineSpec, PreprocessorSpec, ProtocolSpec
from driftwell.operators.tree import HT, Gaussian, bound, entropy
from driftwell.plans import fold, protocols
from driftwell.plans.protocols import buckets
from driftwell.sources import tables


def points(n=400, d=3, seed=5):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, d))
    y = np.where(x @ np.arange(1, d + 1) + 0.1 > 0, 1.0, -1.0)
    return x.tolist(), y.tolist()


@pytest.mark.parametrize("kind", ["STANDARD", "PA-I", "PA-II"])
def test_pa_learns(kind):
    model, (xs, ys) = L.PA(updateType=kind, C=1.0), points()
    assert model.predict(xs[0]) == L.UNFITTED
    for x, y in zip(xs, ys):
        model.fit(x, y)
    assert sum(model.predict(x) == y for x, y in zip(xs, ys)) > 340
    with pytest.raises(ValueError):
        model.fit([1.0], 1.0)


def test_pa_standard_step():
    model = L.PA(updateType="STANDARD")
    model.fit([1.0, 2.0], 1.0)
    assert model.get() == [1 / 7, 2 / 7, 1 / 7]  # 1 / (1 + (5 + 1))


def test_svm_counts_and_maps_zero():
    model = L.SVM(C=0.5)
    assert model.fit([2.0], 0.0) == 1.0
    assert model.get() == [-1.0, -1.0]


def test_multiclass_updates_when_right():
    model = L.MulticlassPA(nClasses=3)
    assert model.fit([1.0, 0.0], 0.0) == 1.0  # scores tie, label 0 is said and right
    assert model.get()[0] > 0 and model.get()[3:] == [0.0] * 6
    model.fit([0.0, 1.0], 2.0)
    assert model.predict([0.0, 1.0]) in (0.0, 2.0)


def test_orr_is_least_squares():
    rng = np.random.default_rng(1)
    x, y = rng.normal(size=(50, 2)), rng.normal(size=50)
    model = L.ORR()
    assert model.predict([0.0, 0.0]) == 0.0
    for a, b in zip(x.tolist(), y.tolist()):
        model.fit(a, b)
    want = np.linalg.lstsq(np.hstack([x, np.ones((50, 1))]), y, rcond=None)[0]
    assert np.allclose(model.weights(), want)
    again = L.ORR()
    again.set(model.get())
    assert np.allclose(again.weights(), want)


def test_kmeans_ties_and_init():
    model = L.KMeans(nClusters=2, centroids=[[0.0], [2.0]])
    assert model.predict([1.0]) == 0.0
    model.fit([1.0])
    assert model.c == [[1.0], [2.0]]
    for init in ("random", "kmeans++"):
        a, b = (L.KMeans(nClusters=2, initMethod=init, graceInit=5, seed=3) for _ in range(2))
        for m in (a, b):
            for k in range(40):
                m.fit([float(k % 2 * 10) + k / 100])
        assert a.get() == b.get() and abs(a.c[0][0] - a.c[1][0]) > 5
    with pytest.raises(ValueError):
        L.KMeans(method="other")


def test_nn_learns_and_round_trips():
    rng = np.random.default_rng(0)
    model = L.NN(nClasses=2, layers="[8]", learningRate=0.01, batchSize=16, label_offset=1)
    data = [([float(v), 1.0 - v], 1.0 + (v > 0.5)) for v in rng.random(3000)]
    losses = [x for p, y in data if (x := model.fit(p, y))]
    assert len(losses) == 187 and losses[-1] < losses[0]
    assert sum(model.predict(p) == y for p, y in data) > 2700
    before = model.get()
    model.set(before)
    assert model.get() == before


def test_tree_splits_and_round_trips():
    rng = np.random.default_rng(2)
    tree = HT(n_min=50)
    data = [([float(a), float(b)], float(a > 0.5)) for a, b in rng.random((3000, 2))]
    for x, y in data:
        tree.fit(x, y)
    assert sum(tree.predict(x) == y for x, y in data) > 2700
    assert any(not n[6] for n in tree.nodes())
    again = HT.load(tree.dump())
    assert [again.predict(x) for x, _ in data[:200]] == [tree.predict(x) for x, _ in data[:200]]
    assert again.dump() == tree.dump()


def test_tree_edges():
    assert math.isnan(HT().predict([1.0]))
    one = HT(n_min=10)  # a single attribute, a single class
    for k in range(100):
        one.fit([float(k)], 1.0)
    assert one.predict([3.0]) == 1.0 and len(one.nodes()) == 1
    words = HT(n_min=20, discrete=True)
    for k in range(400):
        words.fit([float(k % 3), 0.0], float(k % 3 == 1))
    assert words.predict([1.0, 0.0]) == 1.0 and words.predict([2.0, 0.0]) == 0.0
    small = HT(n_min=20, maxByteSize=1, mem_period=50)
    for k in range(200):
        small.fit([float(k % 7), float(k % 5)], float(k % 2))
    assert not any(leaf.active for leaf in small.leaves())


@given(st.lists(st.floats(-50, 50), min_size=1, max_size=20), st.lists(st.floats(-50, 50), max_size=20))
@settings(max_examples=50, deadline=None)
def test_gaussian_merge(a, b):
    one, two, both = Gaussian(), Gaussian(), Gaussian()
    for x in a:
        one.add(x), both.add(x)
    for x in b:
        two.add(x), both.add(x)
    m = one.merge(two)
    assert m.n == both.n and math.isclose(m.mean, both.mean, abs_tol=1e-9) and math.isclose(m.d, both.d, abs_tol=1e-6)
    assert Gaussian().merge(Gaussian()).n == 0


def test_bound_and_entropy():
    assert bound(1, 1e-7, 3223) > 0.05 > bound(1, 1e-7, 3224)
    assert entropy([]) == 0 and entropy([5]) == 0 and entropy([1, 1]) == 1


@given(st.integers(0, 300), st.integers(1, 7), st.integers(1, 50))
@settings(max_examples=100, deadline=None)
def test_buckets_cover(size, hubs, most):
    got = buckets(size, hubs, most)
    assert [k for _, a, b in got for k in range(a, b + 1)] == list(range(size))
    assert all(0 < b - a + 1 <= most for _, a, b in got)


def test_specs():
    spec = PipelineSpec.parse({"learner": {"name": "regressorPA", "hyper": {"C": 1}}, "preprocessors": [{"name": "MinMaxScaler"}], "training": {"protocol": "GM", "miniBatches": 2.0, "workers": 3, "radius": 0}})
    assert spec.protocol.block == 2 and spec.protocol.radius == 0.0 and spec.learner.make().C == 1.0
    assert spec.without_preprocessor("MinMaxScaler").with_preprocessor(PreprocessorSpec("PolynomialFeatures"), 0).describe()["preprocessors"][0]["name"] == "PolynomialFeatures"
    for bad in ({"learner": {"name": "X"}}, {"learner": {"name": "HT"}}, {"learner": {"name": "PA"}, "preprocessors": [{"name": "X"}]}, {"learner": {"name": "PA"}, "training": {"protocol": "EASGD"}}, {"learner": {"name": "PA"}, "training": {"protocol": "X"}}):
        with pytest.raises(ValueError):
            PipelineSpec.parse(bad)
    with pytest.raises(ValueError):
        LearnerSpec("PA", {"other": 1}).make()


def frame(spark, n=240, workers=1):
    xs, ys = points(n)
    return spark.createDataFrame([(k, k % workers, x, y) for k, (x, y) in enumerate(zip(xs, ys))], "k long, worker int, numeric array<double>, label double")


def values(df):
    return [r["value"] for r in df.orderBy("pos").collect()]


def test_one_worker_is_single(spark):
    df = frame(spark)
    single = values(protocols.train(df, LearnerSpec("PA"), ProtocolSpec("CentralizedTraining", mini_batches=40), ["k"]))
    for name in ("Synchronous", "Asynchronous", "SSP"):
        got = values(protocols.train(df, LearnerSpec("PA"), ProtocolSpec(name, workers=1, mini_batches=40), ["k"]))
        assert np.allclose(got, single), name
    assert single == values(fold.train(df, LearnerSpec("PA"), ["k"]))


def brute_sync(rows, workers, block):
    by = [[r for r in rows if r[1] == w] for w in range(workers)]
    start = L.PA()
    for _, _, x, y in by[0][:block]:
        start.fit(x, y)
    center, at = start.get(), [block] + [0] * (workers - 1)
    while all(len(by[w]) >= at[w] + block for w in range(workers)):
        models = []
        for w in range(workers):
            m = L.PA()
            m.set(center)
            for _, _, x, y in by[w][at[w] : at[w] + block]:
                m.fit(x, y)
            at[w] += block
            models.append(m.get())
        center = [sum(v) / workers for v in zip(*models)]
    return center


def test_synchronous_by_brute_force(spark):
    df = frame(spark, 400, 3)
    got = values(protocols.train(df, LearnerSpec("PA"), ProtocolSpec("Synchronous", workers=3, mini_batches=20), ["k"]))
    assert np.allclose(got, brute_sync([tuple(r) for r in df.orderBy("k").collect()], 3, 20))


def test_geometric_monitoring_limits(spark):
    # Worker 0 has one block more, which starts the others, so that all blocks are full.
    df = frame(spark, 380, 3).withColumn("worker", F.when(F.col("k") < 20, 0).otherwise(F.col("k") % 3).cast("int"))
    run = lambda name, **more: protocols.train(df, LearnerSpec("PA"), ProtocolSpec(name, workers=3, mini_batches=20, **more), ["k"])
    assert np.allclose(values(run("GM", radius=-1.0)), values(run("Synchronous")))
    assert run("GM", radius=1e9).first()["rounds"] == 0
    assert run("FGM", threshold=1e9).first()["rounds"] == 0
    assert run("FGM", threshold=1e-9).first()["rounds"] > 0
    stats = run("Asynchronous").first()
    assert stats["bytes_shipped"] == stats["models_shipped"] * protocols.message_bytes(4)


def test_ssp_and_easgd(spark):
    df = frame(spark, 400, 2).withColumn("label", F.when(F.col("label") > 0, 1.0).otherwise(0.0))
    out = protocols.train(df, LearnerSpec("NN", {"nClasses": 2, "layers": [4], "batchSize": 5}), ProtocolSpec("EASGD", workers=2, mini_batches=10), ["k"])
    assert out.count() == 3 * 4 + 4 + 4 * 2 + 2
    uneven = frame(spark, 400, 2).where("worker = 0 or k < 40")
    got = protocols.train(uneven, LearnerSpec("PA"), ProtocolSpec("SSP", workers=2, mini_batches=10, staleness=2), ["k"]).first()
    assert got["models_shipped"] > 20


def test_scores_on_nothing(spark):
    none = spark.createDataFrame([], "y double, p double")
    assert scores.accuracy(none, "y", "p").first()[0] == 0.0
    assert scores.rmse(none, "y", "p").first()[0] == scores.WORST
    assert scores.f1(none, "y", "p").first()[0] == 0.0 and scores.f1_weighted(none, "y", "p").first()[0] == 0.0
    assert scores.inertia(none, F.col("y")).first()[0] == scores.WORST
    gap = spark.createDataFrame([(1.0, None), (1.0, 1.0)], "y double, p double")
    assert scores.rmse(gap, "y", "p").first()[0] > 1e100


def test_scaler_edges(spark):
    one = spark.createDataFrame([(1, 5.0)], "k long, v double")
    assert transforms.scale_batch(one, "v").first()["scaled"] == 5.0
    flat = spark.createDataFrame([(1, 5.0), (2, 5.0)], "k long, v double")
    assert [r["scaled"] for r in transforms.scale_prequential(flat, "v", "k").orderBy("k").collect()] == [5.0, None]
    parts = spark.createDataFrame([(2, 1.0, 0.5), (0, 0.0, 0.0)], "count long, mean double, d double")
    assert tuple(transforms.merge_states(parts).first()) == (2, 1.0, 0.5)


def test_vectors(spark):
    df = spark.createDataFrame([([2.0, 3.0], [0.0, 5.0])], "a array<double>, b array<double>")
    a, b = F.col("a"), F.col("b")
    row = df.select(V.polynomial(a, 2), V.without(a, [1]), V.dense(V.sparse(b)), V.symmetric_update(2.0, a, V.outer(a, a)), V.all_equal(a, a), V.integral(F.array(F.lit(1.5))), V.with_element(a, 0, F.lit(9.0))).first()
    assert list(row) == [[2, 3, 4, 6, 6, 9], [2], [0, 5], [[12, 18], [18, 27]], True, False, [9, 3]]
    with pytest.raises(Exception, match="more features dropped"):
        df.select(V.without(a, [0, 1])).collect()


def test_buffers(spark):
    df = spark.createDataFrame([(k,) for k in range(7)], "k long")
    one = tables.Buffer(1)
    assert [r.k for r in one.keep_newest(df, "k").collect()] == [6] and one.evicted(df, "k").count() == 6
    assert one.clear().max_size == 500_000
    first, second = df.where("k < 3"), df.where("k >= 3")
    merged = tables.merge_buffers(first, second, "k", 1).orderBy("place").collect()
    assert [r.k for r in merged] == [0, 3, 1, 4, 2, 5, 6] and [r.place for r in merged] == list(range(7))
    arrays = df.select(F.array(F.lit(1), F.lit(2)).alias("x")).select(tables.insert(F.col("x"), 1, F.lit(9)), tables.remove(F.col("x"), 0), tables.element(F.col("x"), 1)).first()
    assert list(arrays) == [[1, 9, 2], [2], 2]


def test_points(spark):
    df = spark.createDataFrame([(1.5, 2.0, "a"), (1.0, 2.5, "b")], "x double, d double, c string")
    p = tables.points(df, [F.col("x")], discrete=[F.col("d")], categorical=[F.col("c")])
    assert tables.valid(p).count() == 1 and tables.with_role(p, F.col("numeric")[0] > 1).where("op = 'forecast'").count() == 1
    assert tables.points(df, []).first()["discrete"] == []
    bad = spark.createDataFrame([("no json",)], "raw string").select(tables.decode(F.col("raw"), "k int")["k"]).first()
    assert bad[0] is None


def test_statistics_edges(spark):
    cells = spark.createDataFrame([("a", 0, 1.0)], "attr string, class int, value double")
    got = statistics.gaussians(cells).first()
    assert got["variance"] == 0.0 and got["n"] == 1
    sums = statistics.ridge_sums(spark.createDataFrame([], "x double, y double"), [F.col("x")], F.col("y"))
    assert statistics.ridge_weights(sums) == [0.0, 0.0]


STREAMED = {
    "PA": {}, "RegressorPA": {}, "SVM": {}, "ORR": {}, "MulticlassPA": {"nClasses": 3}, "K-means": {"nClusters": 2, "graceInit": 20},
    "NN": {"nClasses": 3, "layers": [4], "batchSize": 7}, "HT": {"n_min": 20, "classes": 3, "tau": 0.5},
}


@pytest.mark.parametrize("files", [1, 3, 10])
@pytest.mark.parametrize("name", STREAMED)
def test_stream_is_batch(spark, tmp_path, name, files):
    """All that a learner knows goes on from one micro-batch to the next: counts, moments, held points, trees."""
    from driftwell.streaming import online

    df = frame(spark, 120, 2).withColumn("worker", F.lit(0))
    if name in ("MulticlassPA", "NN", "HT"):
        df = df.withColumn("label", (F.col("k") % 3).cast("double")).withColumn("numeric", F.transform("numeric", lambda v: v + F.col("label")))
    learner = LearnerSpec(name, STREAMED[name])
    spec = PipelineSpec(learner, (PreprocessorSpec("StandardScaler", {"flat": 0.0}),) if name in ("SVM", "HT") else (), ProtocolSpec("CentralizedTraining"))
    table = online.ModelTable(spark, f"{tmp_path}/models")
    assert table.latest() == [] and online.model(spec, table) is None
    step = online.train_batch(spec, table, ["k"])
    size = 120 // files
    for k in range(files):
        batch = df.where(F.expr(f"k div {size} = {k}")).coalesce(1)
        step(batch, k)
        if k == 0:
            step(batch, k)  # a batch that is run again changes nothing
    hub = next(r for r in table.latest() if r["worker"] == -1)
    want = spec.make()
    loss = sum(want.fit(list(r["numeric"]), r["label"]) for r in df.orderBy("k").collect())
    assert hub["fitted"] == 120 and np.isclose(hub["loss"], loss)
    got = online.model(spec, table)
    assert got.get() == want.get() == hub["params"] and got.state() == want.state()
    assert name == "HT" or len(want.get()) > 1
    assert online.answer(table, spec, -1, 0.5).first()["learner"] is None


def test_function_and_rescale(spark, tmp_path):
    from driftwell.streaming import online

    spec = PipelineSpec(LearnerSpec("SVM"), (PreprocessorSpec("StandardScaler"),), ProtocolSpec("Asynchronous", workers=2))
    table = online.ModelTable(spark, f"{tmp_path}/models")
    df = frame(spark, 60, 2)
    name = online.register(spec, table, "early")
    df.createOrReplaceTempView("rescaled")
    assert {r[0] for r in spark.sql(f"SELECT {name}(numeric) FROM rescaled").collect()} == {None}
    online.train_batch(spec, table, ["k"])(df, 0)
    more = PipelineSpec(spec.learner, spec.preprocessors, ProtocolSpec("Asynchronous", workers=3))
    online.rescale(more, table, 1)
    rows = {r["worker"]: r for r in table.latest()}
    assert set(rows) == {-1, 0, 1, 2} and rows[2]["state"] == rows[1]["state"] != rows[0]["state"]
    online.train_batch(more, table, ["k"])(df.withColumn("worker", F.lit(2)), 2)
    last = {r["worker"]: r for r in table.latest()}
    assert last[0]["state"] == rows[0]["state"] and last[2]["state"] != rows[2]["state"] and last[-1]["fitted"] == 120
    name, trained = online.register(more, table, "late"), online.model(more, table)
    got = spark.sql(f"SELECT numeric, {name}(numeric) AS p FROM rescaled UNION ALL SELECT NULL, {name}(NULL)").collect()
    assert all(r["p"] == (None if r["numeric"] is None else trained.predict(list(r["numeric"]))) for r in got)


@pytest.mark.parametrize("name", ["Synchronous", "Asynchronous", "SSP", "GM", "FGM", "CentralizedTraining"])
def test_parallel_is_simulated(spark, name):
    """Workers in tasks of their own give what one task simulates: parameters, counts, curves."""
    df = frame(spark, 130, 3).where("worker < 2 or k > 40")
    for learner, block in (("PA", 4), ("SVM", 7)):
        p = ProtocolSpec(name, workers=3, mini_batches=block, staleness=1)
        one, many = (protocols.train(df, LearnerSpec(learner), p, ["k"], parallel=x).toPandas() for x in (False, True))
        assert len(one) == 4 and np.allclose(one, many, rtol=1e-12, atol=1e-12)
    one, many = (protocols.curve(df, LearnerSpec("PA"), p, ["k"], parallel=x).toPandas().sort_values(["round", "worker"]) for x in (False, True))
    assert len(one) and np.allclose(one, many)


def test_lost_worker_ends_the_wait(spark):
    """A point that a learner can't take fails its worker; the others don't wait for ever."""
    df = frame(spark, 40, 2).withColumn("numeric", F.when(F.col("k") == 33, F.array(F.lit(1.0))).otherwise(F.col("numeric")))
    with pytest.raises(Exception, match="weights|barrier|worker is gone"):
        protocols.train(df, LearnerSpec("PA"), ProtocolSpec("Synchronous", workers=2, mini_batches=4), ["k"], parallel=True)


def test_scaler_learns_and_freezes():
    from driftwell.operators.transforms import Scaler

    rng = np.random.default_rng(3)
    xs = rng.normal(size=(30, 2)).tolist()
    s = Scaler()
    out = [s.train([*x, 5.0]) for x in xs]
    assert out[0] == [*xs[0], 5.0] and math.isnan(out[1][2]) and Scaler(flat=0.0).transform([1.0]) == [1.0]
    z = (np.array(xs[:9])[-1] - np.mean(xs[:9], 0)) / np.std(xs[:9], 0)
    assert np.allclose(out[8][:2], z)
    s.freeze()
    before = s.state()
    assert s.train([0.0, 0.0, 6.0])[2] == math.inf and s.train([0.0, 0.0, 4.0])[2] == -math.inf and s.state() == before
    s.thaw()
    s.train([0.0, 0.0, 6.0])
    assert s.count == 31
    a, b, whole = Scaler(), Scaler(), Scaler()
    for k, x in enumerate(xs):
        (a if k < 11 else b).fit(x)
        whole.fit(x)
    both = a.merge([b, Scaler()])
    assert both.count == 30 and np.allclose(both.mean, whole.mean) and np.allclose(both.d, whole.d)
    again = Scaler(mean=whole.mean, variance=[d / 30 for d in whole.d], count=30)
    assert np.allclose(again.transform(xs[4]), whole.transform(xs[4]))
    with pytest.raises(ValueError):
        Scaler(variance=[1.0])


def test_pipeline_rows_are_columns(spark):
    """Preprocessors give the same in a fold as in an expression."""
    steps = (PreprocessorSpec("MinMaxScaler", {"min": [0.0, 1.0, 2.0], "max": [2.0, 4.0, 9.0]}), PreprocessorSpec("FeatureFilter", {"numeric": [1]}), PreprocessorSpec("PolynomialFeatures", {"degree": 3}), PreprocessorSpec("StandardScaler", {"mean": [0.1] * 18, "variance": [4.0] * 18}))
    spec = PipelineSpec(LearnerSpec("PA"), steps)
    rows = [[0.5, 2.0, 3.0], [1.5, -2.0, 7.0]]
    got = spark.createDataFrame([(x,) for x in rows], "numeric array<double>").select(spec.transform(F.col("numeric"))).collect()
    assert np.allclose([r[0] for r in got], [spec.make().through(x, False) for x in rows])
    learning = PipelineSpec(LearnerSpec("PA"), (PreprocessorSpec("StandardScaler"),))
    with pytest.raises(ValueError):
        learning.transform(F.col("numeric"))
    with pytest.raises(ValueError):
        PreprocessorSpec("StandardScaler", {"learn": False})
    one, other = learning.make(), learning.make()
    other.fit([1.0, 2.0], 1.0)
    other.fit([2.0, 2.5], -1.0)
    assert one.merge(other).state() == other.state()


NET = [{"type": "conv", "filters": 3, "kernel": 3}, {"type": "norm"}, {"type": "pool", "kernel": 2}, {"type": "conv", "filters": 2, "kernel": 2, "stride": 1}, {"type": "pool", "kernel": 2, "stride": 1}, {"type": "dense", "size": 5}, {"type": "norm"}, {"type": "dropout", "rate": 0.25}]


def test_network_gradients():
    """Of every kind of layer, against differences of the loss."""
    net = L.NN(nClasses=3, layers=NET, inputShape=[8, 9, 2], l2=0.0, seed=5)
    rng = np.random.default_rng(1)
    xs, ys = rng.normal(size=(6, 144)), rng.integers(0, 3, 6)
    net.grow(xs[0].tolist())

    def loss():
        said, kept = net.forward(xs, True)
        return -np.log(said[np.arange(6), ys]).mean(), said, kept

    _, said, kept = loss()
    delta = said.copy()
    delta[np.arange(6), ys] -= 1
    for q, g in zip(net.p, net.gradients(delta / 6, kept)):
        for at in rng.integers(0, q.size, 3):
            i, step = np.unravel_index(at, q.shape), 1e-6
            q[i] += step
            up = loss()[0]
            q[i] -= 2 * step
            down = loss()[0]
            q[i] += step
            assert abs((up - down) / (2 * step) - g[i]) < 1e-4


def test_network_learns_and_is_configured():
    rng = np.random.default_rng(2)
    net = L.NN(nClasses=2, layers=json.dumps({"layers": NET[:3]}), inputShape=[6, 6, 1], batchSize=20, learningRate=0.01)
    points = []
    for k in range(600):
        x = rng.normal(0, 0.3, (6, 6))
        x[2 * (k % 2) + 1] += 1.0 if k % 2 else -1.0
        points.append((x.ravel().tolist(), float(k % 2)))
    for x, y in points:
        net.fit(x, y)
    assert np.mean([net.predict(x) == y for x, y in points[-200:]]) > 0.95
    twin = L.NN(nClasses=2, layers=NET[:3], inputShape=[6, 6, 1], batchSize=20, learningRate=0.01)
    twin.grow(points[0][0])
    twin.restore(net.state())
    assert twin.get() == net.get() and twin.predict(points[3][0]) == net.predict(points[3][0])
    for wrong in ("{", [{"type": "wing"}]):
        with pytest.raises(ValueError):
            L.configured(wrong)
    with pytest.raises(ValueError):
        L.NN(layers=NET[:1]).grow([1.0] * 9)


def test_tree_as_plan(spark):
    """Routing and prediction by expressions are those of the tree, with dropped attributes and inactive leaves too."""
    from driftwell.operators import tree_plan
    from driftwell.operators.tree import HT

    rng = np.random.default_rng(7)
    tree = HT(n_min=30, classes=3, tau=0.4)
    xs = rng.normal(size=(600, 3))
    ys = (xs[:, 0] > 0).astype(float) + (xs[:, 1] > 0.5)
    for x, y in zip(xs.tolist(), ys.tolist()):
        tree.fit(x, y)
    leaves = tree.leaves()
    assert len(leaves) > 2
    leaves[0].drop(2)
    leaves[1].deactivate()
    tree.fit(xs[0].tolist(), float(ys[0]))
    df = spark.createDataFrame([(x,) for x in xs.tolist()], "numeric array<double>")
    got = tree_plan.predict(df, tree).withColumn("leaf", tree_plan.route(tree, F.col("numeric"))).collect()
    number = {id(leaf): k for k, leaf in enumerate(tree.leaves())}
    assert all(r["leaf"] == number[id(tree.route(list(r["numeric"]))[0])] for r in got)
    assert np.mean([r["predicted"] == tree.predict(list(r["numeric"])) for r in got]) > 0.998
    again = HT.load(tree.dump())
    assert again.dump() == tree.dump() and [f.dropped for f in again.leaves()] == [f.dropped for f in tree.leaves()]
    leaves[1].activate()
    assert leaves[1].active and leaves[1].low == [math.inf] * 3
    assert tree_plan.predict(df.limit(2), HT()).where("not isnan(predicted)").count() == 0


def test_slices_come_in_any_order(spark):
    from driftwell.sources import tables

    rows = [(k, [float(j) if (j + k) % 3 else 0.0 for j in range(11)]) for k in range(4)]
    df = spark.createDataFrame(rows, "id int, v array<double>")
    for sparse in (False, True):
        m = tables.slices(df, "v", 2, 4, 11, sparse)
        assert m.count() == 4 * 4
        m = m.unionByName(m.where("id = 1")).where("id <> 2 or first <> 4").orderBy(F.rand(3))
        got = {r["id"]: r["vector"] for r in tables.reassemble(m, "id", 11, sparse).collect()}
        assert got == {0: rows[0][1], 1: rows[1][1], 2: None, 3: rows[3][1]}
    assert protocols.sparse_message_bytes(10, 4) == 12 * 6 + 36


@pytest.mark.parametrize("name", ["Synchronous", "Asynchronous", "GM", "FGM", "SSP"])
def test_stream_protocols_run(spark, tmp_path, name):
    from driftwell.streaming import online

    spec = PipelineSpec(LearnerSpec("PA"), protocol=ProtocolSpec(name, workers=2))
    table = online.ModelTable(spark, f"{tmp_path}/models")
    step = online.train_batch(spec, table, ["k"])
    df = frame(spark, 120, 2)
    for k in range(2):
        step(df.where(F.expr(f"k div 60 = {k}")), k)
    assert len(next(r for r in table.latest() if r["worker"] == -1)["params"]) == 4


@pytest.mark.parametrize("name,hyper", [("PA", {"updateType": "STANDARD"}), ("PA", {"updateType": "PA-I"}), ("PA", {}), ("RegressorPA", {}), ("RegressorPA", {"updateType": "PA-I", "epsilon": 0.1}), ("SVM", {}), ("MulticlassPA", {"nClasses": 2}), ("scaled", {})])
def test_stretches_are_single_points(name, hyper):
    """Learning from columns gives the digits of learning point by point; nulls and infinities go point by point too."""
    import pyarrow as pa

    xs, ys = points(300)
    ys = [max(0.0, y) for y in ys] if name in ("SVM", "MulticlassPA") else ys
    spec = PipelineSpec(LearnerSpec("PA"), (PreprocessorSpec("StandardScaler", {"flat": 0.0}),)) if name == "scaled" else LearnerSpec(name, hyper)
    one, many = spec.make(), spec.make()
    held = L.Held(many, pa.array(xs), pa.array(ys))
    assert bool(held.columns) == (name != "MulticlassPA")
    want = got = 0.0
    for x, y in zip(xs, ys):
        want += one.fit(x, y)
    for start, stop in ((0, 1), (1, 2), (2, 150), (150, 300)):
        got = held.learn(many, start, stop, got)
    assert got == want and one.get() == many.get() and one.state() == many.state()
    for odd in (pa.array([*xs[:3], None]), pa.array([*xs[:3], [math.inf] * len(xs[0])]), pa.array([*xs[:3], [1.0]])):
        assert L.Held(many, odd, pa.array(ys[:4])).columns is None


def test_long_folds_are_chains(spark):
    """Ranges of a long table folded by a task each give what one task gives, rows on the way and state alike."""
    from pyspark import TaskContext

    df = frame(spark, 700).repartition(5)
    for spec in (LearnerSpec("PA"), LearnerSpec("MulticlassPA", {"nClasses": 2}), PipelineSpec(LearnerSpec("SVM"), (PreprocessorSpec("StandardScaler", {"flat": 0.0}),))):
        rows = df.withColumn("label", F.greatest("label", F.lit(0.0)))
        one, chained = (fold.fold(rows, ["k"], ["numeric", "label"], lambda spec=spec: fold.Train(spec), "pos int, value double, fitted bigint, loss double", piece=p).orderBy("pos").collect() for p in (700, 90))
        assert one == chained and len(one) > 1
    one, chained = (fold.fold(df, ["k"], ["numeric", "label"], lambda: fold.Curve(LearnerSpec("PA"), 64), "bucket int, mean_loss double, fitted bigint", piece=p).orderBy("bucket").collect() for p in (700, 90))
    assert one == chained and len(one) == 10

    class Most:
        """The most rows that a task of the fold saw."""

        def __init__(self):
            self.rows, self.task = {}, None

        def row(self, k):
            task = TaskContext.get().taskAttemptId()
            self.rows[task] = self.rows.get(task, 0) + 1

        def end(self):
            return [(max(self.rows.values()), sum(self.rows.values()))]

    most, every = fold.fold(df, ["k"], ["k"], Most, "most bigint, every bigint", piece=90).first()
    assert every == 700 and most < 250


@pytest.mark.parametrize("name", ["Synchronous", "Asynchronous", "SSP", "GM", "FGM", "CentralizedTraining"])
def test_long_simulations_are_chains(spark, name):
    df = frame(spark, 330, 3).where("worker < 2 or k > 40").withColumn("k", F.col("k") - 100)
    p = ProtocolSpec(name, workers=3, mini_batches=4, staleness=1)
    one, chained = (protocols.train(df, LearnerSpec("PA"), p, ["k"], parallel=False, piece=n).orderBy("pos").collect() for n in (400, 30))
    assert one == chained and len(one) == 4
    one, chained = (protocols.curve(df, LearnerSpec("PA"), p, ["k"], parallel=False, piece=n).orderBy("round", "worker").collect() for n in (400, 30))
    assert one == chained and len(one) > 20
    together = protocols.trains(df, LearnerSpec("PA"), [p, ProtocolSpec("Asynchronous", workers=3, mini_batches=4)], ["k"], piece=30)
    assert together[0].orderBy("pos").collect() == protocols.train(df, LearnerSpec("PA"), p, ["k"]).orderBy("pos").collect()


def test_sums_without_losses(spark):
    """Ridge regression's sums don't depend on losses, which cost it a matrix inversion a point."""
    df = frame(spark, 200, 2)
    p = ProtocolSpec("Synchronous", workers=2, mini_batches=16)
    one, without = (protocols.train(df, LearnerSpec("ORR"), p, ["k"], parallel=False, losses=x).orderBy("pos").collect() for x in (True, False))
    assert [r["value"] for r in one] == [r["value"] for r in without] and one[0]["rounds"] == without[0]["rounds"] > 0
    assert one[0]["loss"] > 0 and without[0]["loss"] is None


@pytest.mark.parametrize("more", [{}, {"maxByteSize": 3000, "mem_period": 250}, {"maxByteSize": 6000, "mem_period": 400}])
def test_trees_grow_by_leaf(spark, more):
    """A tree whose leaves grow in tasks of their own is the tree that learns point by point, byte budget included."""
    from driftwell.operators import tree_plan
    from driftwell.operators.tree import HT

    rng = np.random.default_rng(11)
    xs = np.round(rng.normal(size=(3000, 3)), 2)
    ys = (xs[:, 0] > 0).astype(float) + (xs[:, 1] > 0.5) + (rng.random(3000) < 0.1)
    new = lambda: HT(n_min=30, classes=4, tau=0.8, **more)
    want, whole = new(), new()
    for x, y in zip(xs.tolist(), ys.tolist()):
        want.fit(x, y)
    for start, stop in ((0, 1), (1, 700), (700, 3000)):
        whole.absorb(xs[start:stop], ys[start:stop])
    assert whole.dump() == want.dump() and len(want.leaves()) > 10
    df = spark.createDataFrame([(None if k == 0 else k, x, y) for k, (x, y) in enumerate(zip(xs.tolist(), ys.tolist()))], "k long, numeric array<double>, label double").repartition(3)
    apart = []
    real = tree_plan.grow_apart
    tree_plan.grow_apart = lambda *a: apart.append(real(*a)) or apart[-1]
    try:
        got = tree_plan.grow(df, ["k"], new(), first=200, times=2)
    finally:
        tree_plan.grow_apart = real
    assert got.dump() == want.dump() and len(apart) == 3 and all(apart) != bool(more)


def test_trees_grow_from_stored_batches(spark):
    """However many rounds a tree grows in, the table is read to count, to part and to sort it, and not anew for each."""
    from driftwell.operators import tree_plan
    from driftwell.operators.tree import HT

    rng = np.random.default_rng(5)
    xs = np.round(rng.normal(size=(2000, 2)), 2)
    ys = (xs[:, 0] > 0).astype(float) + (xs[:, 1] > 0.5)
    want, read = HT(n_min=30, classes=3, tau=0.8), spark.sparkContext.accumulator(0)
    want.absorb(xs, ys)

    def count(batches):
        for b in batches:
            read.add(b.num_rows)
            yield b

    df = spark.createDataFrame([(k, x, y) for k, (x, y) in enumerate(zip(xs.tolist(), ys.tolist()))], "k long, numeric array<double>, label double")
    got = tree_plan.grow(df.mapInArrow(count, df.schema), ["k"], HT(n_min=30, classes=3, tau=0.8), first=100, times=1)
    assert got.dump() == want.dump() and 2000 <= read.value <= 3 * 2000


def test_branches_hold_all_leaves():
    from driftwell.operators import tree_plan
    from driftwell.operators.tree import HT

    rng = np.random.default_rng(5)
    tree, xs = HT(n_min=30, tau=0.9), rng.normal(size=(4000, 2))
    tree.absorb(xs, (xs[:, 0] > 0).astype(float))
    leaves = tree.leaves()
    for many in (1, 2, 7, 10_000):
        parted = tree_plan.branches(tree, many)
        assert len(parted) == min(many, len(leaves))
        below = []
        for node, parent, side in parted:
            assert (tree.root if parent is None else parent[side]) is node
            sub = HT()
            sub.root = node
            below += sub.leaves()
        assert [id(f) for f in below] == [id(f) for f in leaves]


def test_large_trees_route_by_arrays(spark, monkeypatch):
    from driftwell.operators import tree_plan
    from driftwell.operators.tree import HT

    tree, leaf = HT(classes=2), lambda: tree_plan.Leaf(2, False)
    tree.root = [0, 0.0, [1, -1.0, leaf(), [0, -2.0, leaf(), leaf(), 2], 1], leaf(), 0]
    xs = [[a, b] for a in (-3.0, -2.0, 0.0, 0.5, math.nan) for b in (-1.0, 0.0, None)] + [None]
    df = spark.createDataFrame([(k, x) for k, x in enumerate(xs)], "k int, numeric array<double>")
    by_conditions = tree_plan.with_leaf(df, tree, "numeric").orderBy("k").collect()
    monkeypatch.setattr(tree_plan, "CONDITIONS", 1)
    routed = tree_plan.with_leaf(df, tree, "numeric")
    assert "CASE" not in routed._jdf.queryExecution().toString()
    assert [r["__leaf"] for r in routed.orderBy("k").collect()] == [r["__leaf"] for r in by_conditions]


def test_large_trees_predict_by_arrays(spark, monkeypatch):
    """The same as the expressions, with dropped attributes, inactive leaves, missing values and no values."""
    from driftwell.operators import tree_plan
    from driftwell.operators.tree import HT

    rng = np.random.default_rng(7)
    tree = HT(n_min=30, classes=3, tau=0.6)
    xs = rng.normal(size=(900, 3))
    tree.absorb(xs, (xs[:, 0] > 0).astype(float) + (xs[:, 1] > 0.5))
    leaves = tree.leaves()
    assert len(leaves) > 5
    leaves[0].drop(2)
    leaves[1].deactivate()
    odd = [[math.nan, 1.0, 0.0], [None, 1.0, 0.0], [-2.0, -2.0, None], [-9.0, -9.0, None], None]
    df = spark.createDataFrame([(k, x) for k, x in enumerate([*xs.tolist(), *odd])], "k int, numeric array<double>")
    want = [str(r["predicted"]) for r in tree_plan.predict(df, tree).orderBy("k").collect()]
    monkeypatch.setattr(tree_plan, "CONDITIONS", 1)
    assert [str(r["predicted"]) for r in tree_plan.predict(df, tree).orderBy("k").collect()] == want
    few = tree_plan.predict(df, tree, keep=["k"])
    assert few.columns == ["k", "predicted"] and [str(r["predicted"]) for r in few.orderBy("k").collect()] == want


def test_long_trees_have_no_deep_conditions(spark):
    """Nested conditions for thousands of leaves don't compile."""
    from driftwell.operators import tree_plan
    from driftwell.operators.tree import HT

    tree, leaf = HT(classes=2), tree_plan.Leaf(1, False)
    leaf.add([0.0], 1.0)
    tree.root = leaf
    for k in range(400):
        tree.root = [0, float(k), tree.root, tree_plan.Leaf(1, False, 0, 0.0, 1.0), 0]
    df = spark.createDataFrame([([float(k % 500)],) for k in range(1000)], "numeric array<double>")
    assert {r[0]: r[1] for r in tree_plan.predict(df, tree).groupBy("predicted").count().collect()} == {1.0: 2, 0.0: 998}


def test_numbered_by_key_in_small_tasks(spark):
    """Places within each worker's rows, where more ranges than shuffle partitions have tasks of their own."""
    from driftwell.sources import tables

    df = frame(spark, 400, 3).repartition(4)
    rows = tables.numbered(df.select("k", "worker"), ["k"], parts=16, by="worker").withColumn("task", F.spark_partition_id()).collect()
    assert sorted((r["k"], r["rn"]) for r in rows) == [(k, k // 3) for k in range(400)]
    assert max(sum(r["task"] == t for r in rows) for t in {r["task"] for r in rows}) < 100
