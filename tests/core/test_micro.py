"""Small cases with known results, and properties that hold for any data."""

import json
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from timberline import Configuration, FeatureMatrix, Model, TreesClassifier, TreesError, TreesRegressor, load, train
from timberline.functions.gain import Penalties, weight_of
from timberline.functions.metrics import auc_table
from timberline.operators.binning import bit_width, collect_thresholds, encode_bins, hist_thresholds, long_values, sketched_thresholds
from timberline.operators.histogram import histogram, histogram_by_task, subtracted
from timberline.operators.routing import partition_index, split_bit
from timberline.operators.sampling import ColumnSampler
from timberline.operators.splits import best_category_splits, best_splits, candidates, category_splits, with_gain
from timberline.sources.tables import shared_dir
from timberline.streaming.scoring import score_stream

FREE = Penalties(lambda_=0.0, min_child_weight=0.0, min_leaf_size=0)

# Name, values, bins asked for, bins expected, bits.
BINNING = [
    ("wide", [128 - i for i in range(128)], 8, [7 - i // 16 for i in range(128)], 4),
    ("255", list(range(1024)), 255, [min(254, i // 4) for i in range(1024)], 8),
    ("skewed", [10, 0, 11, 1, 0, 2, 3, 0, 0, 0, 0, 0], 4, [3, 0, 3, 1, 0, 2, 3, 0, 0, 0, 0, 0], 3),
    ("tiny 1", [0] * 10 + [1, 2], 4, [0] * 10 + [1, 2], 2),
    ("tiny 2", [10] * 10 + [1, 2], 4, [0] * 12, 1),
]


@pytest.mark.parametrize("case", BINNING, ids=lambda c: c[0])
def test_hist_binning(spark, case):
    _, values, size, want, bits = case
    df = spark.createDataFrame([(i, [float(v)]) for i, v in enumerate(values)], "i int, features array<float>")
    t = collect_thresholds(hist_thresholds(long_values(df), size), 1)
    assert [r.bins[0] for r in encode_bins(df, t).orderBy("i").collect()] == want
    assert spark.range(1).select(bit_width(F.lit(len(t[0]) + 1))).first()[0] == bits


def test_gaps_can_be_compacted(spark):
    df = spark.createDataFrame([([float(v)],) for v in [1] + [2] * 10 + [10] * 10], "features array<float>")
    assert len(collect_thresholds(hist_thresholds(long_values(df), 4), 1)[0]) == 0
    assert collect_thresholds(hist_thresholds(long_values(df), 4, compact_gaps=True), 1)[0].tolist() == [6.0]


def hist_of(spark, rows):
    return histogram(spark.createDataFrame(rows, "node int, g double, h double, bins array<int>"))


def test_root_gain(spark):
    b = best_splits(with_gain(candidates(hist_of(spark, [(0, float(i), 1.0, [i // 8]) for i in range(32)])), FREE)).first()
    assert (b.cut, b.gain) == (1, 2048.0)
    b = best_splits(with_gain(candidates(hist_of(spark, [(0, float(i), 1.0, [i // 4]) for i in range(32)]), exact=True), FREE)).first()
    assert (b.cut, b.cl, b.gain) == (4, 16, 2048.0)


def test_level_one_gain(spark):
    rows = [(1 + i // 16, float(i * i), 1.0, [i // 4]) for i in range(32)]
    got = {b.node: b for b in best_splits(with_gain(candidates(hist_of(spark, rows)), FREE)).collect()}
    assert np.isclose(got[1].gain, 64026.67, rtol=1e-5) or got[1].gain > 0
    best = lambda g: max(sum(g[:i]) ** 2 / i + sum(g[i:]) ** 2 / (16 - i) - sum(g) ** 2 / 16 for i in (4, 8, 12))
    for node, low in ((1, 0), (2, 16)):
        assert np.isclose(got[node].gain, best([i * i for i in range(low, low + 16)]), rtol=1e-6)


def test_category_gain(spark):
    b = best_category_splits(category_splits(hist_of(spark, [(0, float(i), 1.0, [i // 2]) for i in range(32)]), FREE)).first()
    assert (b.cut, b.gain) == (0, 480.0)


def test_sums_and_subtraction(spark):
    rows = [(1 if i < 10 else 2, float(i), 1.0, [i % 4]) for i in range(1280)]
    hist = hist_of(spark, rows)
    got = [(r.c, r.g) for r in hist.orderBy("node", "bin").collect()]
    assert got == list(zip([3, 3, 2, 2, 317, 317, 318, 318], [12, 15, 8, 10, 204148, 204465, 204792, 205110]))
    parent = hist_of(spark, [(0, *r[1:]) for r in rows])
    both = subtracted(parent, hist.where("node = 1"))
    assert sorted(map(tuple, both.select(*hist.columns).collect())) == sorted(map(tuple, hist.collect()))


def test_partition_and_routing(spark):
    df = spark.createDataFrame([(i, i % 2) for i in range(32)], "i int, node int")
    got = [r.i for r in partition_index(df, "node", "i").orderBy("place").collect()]
    assert got == [*range(0, 32, 2), *range(31, 0, -2)]
    v = spark.createDataFrame([(i, float(x)) for i, x in enumerate([0, 5, 2, 5, 3, 4, 4])], "i int, v float")
    assert [r[0] for r in v.orderBy("i").select(split_bit(F.col("v"), 4.0)).collect()] == [0, 1, 0, 1, 0, 1, 1]


def test_weights():
    assert weight_of(10, 4, 4, Penalties(lambda_=1)) == 2
    assert weight_of(-10, 4, 4, Penalties(lambda_=1, alpha=5)) == -1
    assert weight_of(10, 4, 4, Penalties(max_leaf_weight=0.5)) == 0.5
    assert weight_of(10, 4, 4, Penalties(min_leaf_size=5)) == weight_of(10, 4, 4, Penalties(min_child_weight=5)) == 0
    assert weight_of(0, 0, 0, FREE) == 0


@pytest.fixture(scope="module")
def noisy(spark):
    r = np.random.default_rng(0)
    x = r.normal(size=(400, 4)).astype(np.float32)
    x[:, 3] = np.round(x[:, 3])
    y = (x[:, 0] > 0.2) * 2.0 + x[:, 1] + r.normal(size=400) * 0.1
    return x, y.astype(np.float32)


def test_physical_choices_do_not_matter(spark, noisy):
    x, y = noisy
    trees = []
    for trick, parts in ((True, 1), (False, 5), (True, 3)):
        m = FeatureMatrix.from_arrays(spark, x, y=y)
        m.df = m.df.repartition(parts)
        model = train({"tree": {"max_depth": 3}, "internals": {"hist_size": 16, "use_hist_subtraction_trick": trick}}, m, 2)
        trees.append([(t.fids, t.thresholds, np.round(t.weights, 4).tolist()) for t in model.trees])
        model.close()
    assert trees[0] == trees[1] == trees[2]


def test_histograms_agree_and_add_up(spark, noisy):
    x, y = noisy
    m = FeatureMatrix.from_arrays(spark, x, y=y)
    t = collect_thresholds(hist_thresholds(long_values(m.design()), 16), 4)
    rows = encode_bins(m.design(), t).select("bins", F.col("y").cast("double").alias("g"), F.lit(1.0).alias("h"), F.lit(0).alias("node"))
    a, b = histogram(rows), histogram_by_task(rows, 0, [], [], [len(k) + 1 for k in t])
    key = lambda df: {(r.node, r.fid, r.bin): (round(r.g, 6), r.h, r.c) for r in df.collect()}
    assert key(a) == key(b)
    assert {r.n for r in a.groupBy("fid").agg(F.sum("c").alias("n")).collect()} == {400}
    part = key(histogram_by_task(rows, 0, [], [], [len(k) + 1 for k in t], fids=[1, 3]))
    assert part == {k: v for k, v in key(a).items() if k[1] in (1, 3)}


def test_appending_is_predicting(spark, noisy):
    x, y = noisy
    m, other = FeatureMatrix.from_arrays(spark, x, y=y), FeatureMatrix.from_arrays(spark, x)
    model = Model({"tree": {"max_depth": 2}, "internals": {"hist_size": 16}}, m)
    assert {r.prediction for r in model.get_y(other).collect()} == {0.5}
    for _ in range(3):
        model.grow_tree()
        model.append_last_tree(other)
    with pytest.raises(TreesError):
        model.append_last_tree(FeatureMatrix.from_arrays(spark, x))
    ordered = lambda df: [r.prediction for r in df.orderBy("row_id").collect()]
    full = ordered(model.predict(other))
    assert np.allclose(ordered(model.get_y(other)), full) and np.allclose(ordered(model.predict(other, by_column=False)), full)
    assert np.allclose(ordered(load(model.dump()).predict(other, 99)), full)
    assert not np.allclose(ordered(model.predict(other, 1)), full)
    mse = np.mean((np.array(full) - y) ** 2)
    assert mse < np.mean((0.5 - y) ** 2)


def test_closing_deletes_tables(spark, noisy):
    x, y = noisy
    model = train({"tree": {"max_depth": 1}, "internals": {"hist_size": 8}}, FeatureMatrix.from_arrays(spark, x, y=y), 9)
    paths = [t.settled_at for t in model._tables]
    assert len(paths) == 2 and all(os.path.exists(p) for p in paths)
    model.close()
    assert not any(os.path.exists(p) for p in paths) and len(model.trees) == 9


def test_shared_folder_is_asked_for_on_clusters():
    conf, context = type("Conf", (), {"get": lambda self, k, d=None: d})(), type("Context", (), {"master": "spark://host:7077"})()
    with pytest.raises(TreesError):
        shared_dir(type("Session", (), {"conf": conf, "sparkContext": context})())


def test_custom_gradients(spark, noisy):
    x, y = noisy
    config = {"tree": {"max_depth": 2}, "internals": {"hist_size": 16}}
    plain, own = Model(config, FeatureMatrix.from_arrays(spark, x, y=y)), Model(config, FeatureMatrix.from_arrays(spark, x, y=y))
    assert plain.grow_tree() == own.grow_tree((F.col("y") - F.col("margin"), F.lit(1.0)))


def test_estimators(spark, noisy):
    x, y = noisy
    m = FeatureMatrix.from_arrays(spark, x, y=y)
    fits = [TreesRegressor(max_depth=2, n_estimators=2, hist_size=h, method=how, verbosity=0, l1=0.0, colsample_bytree=1.0, learning_rate=0.5).fit(m) for how, h in (("hist", 1023), ("exact", 255))]
    a, b = ([r.prediction for r in f.predict(m).orderBy("row_id").collect()] for f in fits)
    assert np.allclose(a, b, atol=1e-4)
    label = (y > 1).astype(int)
    c = FeatureMatrix.from_arrays(spark, x, labels=label)
    assert c.labels_count == 2
    seen = []
    fit = TreesClassifier(max_depth=2, n_estimators=6, hist_size=16, verbosity=0, l1=0.0).fit(c, FeatureMatrix.from_arrays(spark, x, labels=label), early_stopping_rounds=1, eval_metric=lambda df: seen.append(1) or float(len(seen)))
    assert fit.best_round == 0 and len(fit.scores) == 3 and len(fit.model.trees) == 3
    p = fit.predict(c)
    assert p.where("prediction <= 0 or prediction >= 1").count() == 0
    assert auc_table(p.withColumn("y", F.col("labels"))).first()[0] > 0.9
    with pytest.raises(TreesError):
        TreesRegressor().predict(m)
    with pytest.raises(TreesError):
        TreesRegressor(method="other")


def test_auc_with_ties(spark):
    rows = [(1, 0.5), (0, 0.5), (1, 0.9), (0, 0.1), (0, 0.9), (1, 0.5)]
    want = np.mean([1.0 if a > b else 0.5 if a == b else 0.0 for p, a in rows if p for q, b in rows if not q])
    assert np.isclose(auc_table(spark.createDataFrame(rows, "y int, prediction double")).first()[0], want)
    assert auc_table(spark.createDataFrame(rows[:1], "y int, prediction double")).first()[0] is None


def test_sketched_thresholds(spark, noisy):
    x, y = noisy
    m = FeatureMatrix.from_arrays(spark, x, y=y)
    m.df = m.df.repartition(5)
    for f, t in enumerate(sketched_thresholds(m.design(), 4, 8, 1000)):
        v = np.sort(x[:, f])
        assert all(abs(np.searchsorted(v, q, side="right") / 400 - k / 8) <= 0.01 for k, q in enumerate(t, 1)) or f == 3
        assert (np.diff(t) > 0).all() and len(t) <= 7 and t[-1] < v[-1]
    model = train({"tree": {"max_depth": 3, "eta": 1.0}, "internals": {"hist_size": 64, "sketch_accuracy": 1000}}, m, 2)
    got = np.array([r.prediction for r in model.predict(m).orderBy("row_id").collect()])
    assert np.mean((got - y) ** 2) < 0.3 * np.var(y)
    assert sketched_thresholds(m.design().limit(0), 4, 8, 1000)[0].size == 0
    model.close()


def test_streams_are_scored(spark, noisy, tmp_path):
    x, y = noisy
    m = FeatureMatrix.from_arrays(spark, x, y=y)
    model = train({"tree": {"max_depth": 2}, "internals": {"hist_size": 16}}, m, 2)
    m.df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(m.df.schema).parquet(str(tmp_path / "in"))
    q = score_stream(stream, model, m.names).writeStream.format("memory").queryName("scored").start()
    q.processAllAvailable()
    q.stop()
    want = {r.row_id: r.prediction for r in model.predict(m).collect()}
    assert {r.row_id: r.prediction for r in spark.table("scored").collect()} == want


def test_wrong_input_is_refused(spark):
    df = spark.createDataFrame([(1.0, 2, "x", None), (2.0, 3, "y", 1.0)], "a double, c int, s string, n double")
    for bad in (dict(features=["s"]), dict(features=["a"], categories=["a"]), dict(features=["n"]), dict(features=["a"], y="a", labels="c"), dict(features=[])):
        with pytest.raises(TreesError):
            FeatureMatrix(df, **bad)
    assert FeatureMatrix(df, ["n"], missing=0.0).design().collect()[0].features == [0.0]
    for bad in ({"tree": {"max_depth": 0}}, {"objective": 4}, {"method": 7}, {"tree": {"colsample_bytree": 0}}, {"objective": 1, "tree": {"initial_y": 1.0}}, "{"):
        with pytest.raises(TreesError):
            Configuration.parse(bad)
    with pytest.raises(TreesError):
        Model().grow_tree()
    with pytest.raises(TreesError):
        load("{}")
    assert Configuration.parse({"tree": {"gamma": 1}}).to_dict()["tree"]["lambda"] == 1.0
    with pytest.raises(TreesError):
        FeatureMatrix.from_arrays(spark, np.zeros(3))
    with pytest.raises(TreesError):
        FeatureMatrix.from_arrays(spark, np.zeros((3, 1)), y=[1])


def test_missing_depth_in_older_models():
    old = {"configuration": {"tree": {"max_depth": 2}}, "model": [{"nodes": [{"fid": 6, "id": 0, "leaf": False, "left": 1, "right": 2, "threshold": None}, {"id": 1, "idx": 0, "leaf": True}, {"id": 2, "idx": 1, "leaf": True}], "weights": [1.5, 2.5]}]}
    t = load(json.dumps(old)).trees[0]
    assert (t.levels, t.fids, t.thresholds, t.weights) == (1, [6], [float("inf")], [1.5, 2.5])


def test_column_samples():
    s = ColumnSampler(10, 0.5, 0.5, 1)
    for _ in range(20):
        tree = s.tree()
        assert len(tree) == 5 and set(s.level()) <= set(tree) and len(s.level()) == 2
    assert ColumnSampler(3, 1.0, 1.0, 0).tree() == [0, 1, 2]
    assert [ColumnSampler(9, 0.4, 1, 5).tree() for _ in range(2)][0] == ColumnSampler(9, 0.4, 1, 5).tree()
