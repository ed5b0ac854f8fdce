"""Binary and multiclass objectives, and category features, against known models, brute force and properties."""

import json
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.core.housing import rows as housing
from tests.core.iris import LOGISTIC_MODELS, SOFTMAX_PREDICTIONS, rows
from timberline import Configuration, FeatureMatrix, Model, TreesClassifier, TreesError, TreesRegressor, load, train
from timberline.plans.model import nodes_table, trees_of

KIND = np.repeat([0, 1, 2], 50)


@pytest.fixture(scope="module")
def iris(spark):
    return np.array(rows(), np.float32)


def predictions(df):
    return [r.prediction for r in df.orderBy("row_id").collect()]


@pytest.mark.parametrize("case", range(len(LOGISTIC_MODELS)))
def test_logistic_models(spark, iris, case):
    method, depth, want = LOGISTIC_MODELS[case]
    m = FeatureMatrix.from_arrays(spark, iris, y=KIND != 2)
    config = {"method": int(method == "hist"), "objective": 1, "tree": {"eta": 0.2, "max_depth": depth, "lambda": 0.0, "alpha": 0.0, "min_child_weight": 2.0, "min_leaf_size": 0}, "internals": {"hist_size": 255}}
    model = train(config, m, len(want))
    margin = np.zeros(150)
    for tree, (fids, thresholds, weights) in zip(model.trees, want, strict=True):
        assert tree.fids == fids and np.allclose(tree.thresholds, thresholds, rtol=1e-6) and np.allclose(tree.weights, weights, rtol=1e-4, atol=1e-6)
        node = np.zeros(150, int)
        for _ in range(depth):
            node = 2 * node + np.where(iris[np.arange(150), np.array(fids)[node]] < np.float32(thresholds)[node], 1, 2)
        margin += np.array(weights)[node - len(fids)]
    assert np.allclose(predictions(model.predict(m)), 1 / (1 + np.exp(-margin)), atol=1e-6)
    if case == 0:
        assert {round(p, 6) for p in predictions(model.predict(m))} == {0.589413, 0.405498}
    model.close()


@pytest.mark.parametrize("method", ["hist", "exact"])
def test_classifier_on_known_rows(spark, iris, method):
    m = FeatureMatrix.from_arrays(spark, iris, y=KIND != 2)
    fit = TreesClassifier(max_depth=2, learning_rate=0.2, n_estimators=1, verbosity=0, min_child_weight=2.0, min_leaf_size=0, colsample_bytree=1.0, l1=0.0, l2=0.0, method=method, hist_size=255).fit(m)
    assert Counter(round(p, 5) for p in predictions(fit.predict(m))).keys() == {0.59668, 0.5, 0.42556, 0.40131}


@pytest.mark.parametrize("method", ["hist", "exact"])
@pytest.mark.parametrize("size", [12, 255])
def test_regressor_on_known_rows(spark, method, size):
    data = np.array(housing(), np.float32)
    m = FeatureMatrix.from_arrays(spark, data[:, :-1], y=data[:, -1])
    fit = TreesRegressor(max_depth=1, learning_rate=0.99999, n_estimators=1, verbosity=0, min_leaf_size=1, colsample_bytree=1.0, l1=0.0, l2=0.0, method=method, hist_size=size).fit(m)
    assert np.allclose(predictions(fit.predict(m)), np.where([0, 0, 1, 1, 1, 1, 0, 0, 0, 0], 33.25, 21.833334))


@pytest.mark.parametrize("case", range(len(SOFTMAX_PREDICTIONS)))
@pytest.mark.parametrize("objective", [3, 4])
def test_softmax_predictions(spark, iris, case, objective):
    depth, rounds, want = SOFTMAX_PREDICTIONS[case]
    m = FeatureMatrix.from_arrays(spark, iris, labels=KIND)
    config = {"method": 0, "objective": objective, "tree": {"labels_count": 3, "eta": 0.2, "max_depth": depth, "min_child_weight": 2.0, "min_leaf_size": 0, "lambda": 0.0, "alpha": 0.0, "initial_y": 0.0}}
    model = train(config, m, rounds)
    assert len(model.trees) == 3 * rounds
    got = Counter(tuple(round(x, 5) for x in p) for p in predictions(model.predict(m)))
    assert got == Counter({tuple(round(x, 5) for x in w[:3]): w[3] for w in want})
    model.close()


def test_softmax_by_hand(spark, iris):
    """Rounds and ways to score agree; the margins are those of a plain loop."""
    m, other = FeatureMatrix.from_arrays(spark, iris, labels=KIND), FeatureMatrix.from_arrays(spark, iris)
    model = Model({"objective": 3, "tree": {"labels_count": 3, "max_depth": 2, "initial_y": 0.0}, "internals": {"hist_size": 16}}, m)
    margin = np.zeros((150, 3))
    for turn in range(3):
        p = np.exp(margin) / np.exp(margin).sum(axis=1, keepdims=True)
        model.grow_tree()
        model.append_last_tree(other)
        for k, tree in enumerate(model.trees[-3:]):
            node = np.zeros(150, int)
            for _ in range(2):
                node = 2 * node + np.where(iris[np.arange(150), np.array(tree.fids)[node]] < np.float32(tree.thresholds)[node], 1, 2)
            g, h = (KIND == k) - p[:, k], 2 * p[:, k] * (1 - p[:, k])
            for leaf in range(3, 7):
                own = node == leaf
                want = 0.3 * g[own].sum() / (h[own].sum() + 1) if own.any() and h[own].sum() >= 1 else 0.0
                assert np.isclose(tree.weights[leaf - 3], want, rtol=1e-5, atol=1e-7)
            margin[:, k] += np.array(tree.weights)[node - 3]
    want = np.exp(margin) / np.exp(margin).sum(axis=1, keepdims=True)
    for got in (model.predict(other), model.predict(other, by_column=False), model.predict(other, by_column=True), model.get_y(other), load(model.dump()).predict(other)):
        assert np.allclose(predictions(got), want)
    first = predictions(model.predict(other, 1))
    assert not np.allclose(first, want) and np.allclose(np.sum(first, axis=1), 1)
    assert (want.argmax(axis=1) == KIND).mean() > 0.75
    assert [r.margin for r in model.training_rows().collect()][0].__len__() == 3
    model.close()


def test_classifier_of_three_classes(spark, iris):
    m = FeatureMatrix.from_arrays(spark, iris, labels=KIND)
    fit = TreesClassifier(labels_count=3, max_depth=2, n_estimators=3, learning_rate=0.5, verbosity=0, min_leaf_size=1, colsample_bytree=1.0, l1=0.0, method="exact").fit(m, FeatureMatrix.from_arrays(spark, iris, labels=KIND))
    p = np.array(predictions(fit.predict(m)))
    assert p.shape == (150, 3) and np.allclose(p.sum(axis=1), 1) and (p.argmax(axis=1) == KIND).mean() > 0.9
    assert len(fit.model.trees) == 9 and fit.best_round == 2 and np.isclose(fit.scores[-1], -np.log(p[np.arange(150), KIND]).mean())
    fit.model.close()


def test_softmax_needs_labels(spark, iris):
    config = {"objective": 3, "tree": {"labels_count": 2, "max_depth": 1}}
    with pytest.raises(TreesError):
        train(config, FeatureMatrix.from_arrays(spark, iris, labels=KIND), 1)
    with pytest.raises(TreesError):
        train(config, FeatureMatrix.from_arrays(spark, iris, y=KIND), 1)
    for bad in ({"objective": 3}, {"objective": 0, "tree": {"labels_count": 2}}, {"objective": 2}):
        with pytest.raises(TreesError):
            Configuration.parse(bad)


@pytest.fixture(scope="module")
def mixed():
    r = np.random.default_rng(3)
    x = r.normal(size=(500, 2)).astype(np.float32)
    c = np.stack([r.integers(0, 6, 500), r.integers(0, 300, 500) * 7], axis=1)
    y = (c[:, 0] == 4) * 3.0 + (c[:, 1] % 5 == 0) + (x[:, 0] > 0.5) * 1.0 + r.normal(size=500) * 0.1
    return x, c, y.astype(np.float32)


@pytest.mark.parametrize("method", [0, 1])
def test_one_category_tree_by_brute_force(spark, mixed, method):
    x, c, y = mixed
    m = FeatureMatrix.from_arrays(spark, x, c, y=y)
    model = train({"method": method, "tree": {"max_depth": 1, "eta": 1.0, "initial_y": 0.0, "lambda": 0.0}, "internals": {"hist_size": 1000}}, m, 1)
    (tree,) = model.trees
    worth = lambda own: y[own].astype(float).sum() ** 2 / own.sum() if own.any() else 0.0
    best = max(((worth(own) + worth(~own), f, v) for f in (0, 1) for v in np.unique(c[:, f]) for own in [c[:, f] == v]), key=lambda t: t[0])
    assert (tree.fids, tree.categories, tree.thresholds) == ([best[1] + 2], [best[2]], [float("inf")]) == ([2], [4], [float("inf")])
    own = c[:, 0] == 4
    assert np.allclose(tree.weights, [y[own].mean(), y[~own].mean()], rtol=1e-4)
    model.close()


@pytest.mark.parametrize("method", [0, 1])
def test_category_trees_score_alike(spark, mixed, method):
    x, c, y = mixed
    m, other = FeatureMatrix.from_arrays(spark, x, c, y=y), FeatureMatrix.from_arrays(spark, x, c)
    model = Model({"method": method, "tree": {"max_depth": 3}, "internals": {"hist_size": 16}}, m)
    for _ in range(3):
        model.grow_tree()
        model.append_last_tree(other)
    assert any(t.categories for t in model.trees)
    margin = np.full(len(y), 0.5)
    codes = np.concatenate([x.astype(float), c], axis=1)
    for t in model.trees:
        node = np.zeros(len(y), int)
        for _ in range(3):
            equal = np.array([-1 if k is None else k for k in t.categories or [None] * 7])[node]
            value = codes[np.arange(len(y)), np.array(t.fids)[node]]
            node = 2 * node + np.where(np.where(equal >= 0, value == equal, value < np.array(t.thresholds)[node]), 1, 2)
        margin += np.array(t.weights)[node - 7]
    back = load(model.dump())
    assert json.loads(back.dump()) == json.loads(model.dump()) and [t.categories for t in back.trees] == [t.categories for t in model.trees]
    assert trees_of(nodes_table(spark, model.trees)) == model.trees
    for got in (model.predict(other), model.predict(other, by_column=False), model.predict(other, by_column=True), model.get_y(other), back.predict(other)):
        assert np.allclose(predictions(got), margin, atol=1e-6)
    assert np.allclose(sorted(r.margin for r in model.training_rows().collect()), sorted(margin), atol=1e-6)
    with pytest.raises(TreesError):
        model.predict(FeatureMatrix.from_arrays(spark, x))
    model.close()


def test_two_categories_split_like_a_number(spark):
    """With two values, one category against the rest is a threshold between them."""
    data = np.array(housing(), np.float32)
    code = (data[:, 6] >= 65).astype(np.int64)
    trees = []
    for depth in (1, 2, 3):
        config = {"method": 0, "tree": {"eta": 0.5, "max_depth": depth, "min_leaf_size": 1, "lambda": 0.0}}
        a, b = FeatureMatrix.from_arrays(spark, data[:, 4:5], code[:, None], y=data[:, -1]), FeatureMatrix.from_arrays(spark, np.column_stack([data[:, 4], code]), y=data[:, -1])
        pa, pb = (predictions(train(config, m, 2).predict(m)) for m in (a, b))
        assert np.allclose(pa, pb)
        trees.append(pa)
    assert not np.allclose(trees[0], trees[1])


def test_blocks_of_features_and_exploding_agree(spark, mixed, monkeypatch):
    from timberline.plans import grower

    x, c, y = mixed
    seen = []
    for cells, passes in ((1 << 22, 16), (2200, 16), (2200, 0)):
        monkeypatch.setattr(grower, "TASK_CELLS", cells)
        monkeypatch.setattr(grower, "PASSES", passes)
        for trick in (True, False):
            model = train({"tree": {"max_depth": 3}, "internals": {"hist_size": 16, "use_hist_subtraction_trick": trick}}, FeatureMatrix.from_arrays(spark, x, c[:, :1], y=y), 1)
            seen.append([(t.fids, t.thresholds, t.categories, np.round(t.weights, 5).tolist()) for t in model.trees])
            model.close()
    assert all(s == seen[0] for s in seen)
    assert grower.feature_blocks([3, 4, 5, 6], [0, 1, 2, 3], 2, 16) == [[0, 1], [2], [3]] and grower.feature_blocks([9], [0], 2, 16) is None


def test_negative_categories_are_refused(spark):
    df = spark.createDataFrame([(1.0, -1, 1.0)], "a double, c int, y double")
    with pytest.raises(TreesError):
        FeatureMatrix(df, ["a"], y="y", categories=["c"])
    assert FeatureMatrix(df.select("a", F.abs("c").alias("c"), "y"), ["a"], y="y", categories=["c"]).category_sizes() == [2]
