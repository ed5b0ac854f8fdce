import json
import math

import numpy as np
import pytest

from timberline import FeatureMatrix, load, train
from tests.core.housing import MODELS, rows


@pytest.fixture(scope="module")
def matrix(spark):
    data = np.array(rows(), np.float32)
    return FeatureMatrix.from_arrays(spark, data[:, :-1], y=data[:, -1])


@pytest.mark.parametrize("case", range(len(MODELS)))
def test_model(spark, matrix, case):
    method, depth, trees = MODELS[case]
    config = {"method": 0 if method == "exact" else 1, "objective": 0, "tree": {"eta": 0.99999, "max_depth": depth, "lambda": 0.0, "alpha": 0.0, "min_child_weight": 2, "min_leaf_size": 2}, "internals": {"hist_size": 12, "use_hist_subtraction_trick": case % 2 == 0}}
    model = train(config, matrix, len(trees))
    for tree, want in zip(model.trees, trees, strict=True):
        fids, cuts, weights = want
        assert tree.fids == fids
        assert [np.float32(x) for x in tree.thresholds] == [np.float32(x) for x in cuts]
        assert np.allclose(tree.weights, weights, rtol=1e-4, atol=1e-6)
    got = [r.prediction for r in model.predict(matrix).orderBy("row_id").collect()]
    base = np.full(10, 0.5)
    x = np.array(rows(), np.float32)[:, :-1]
    for tree in model.trees:
        for i in range(10):
            n = 0
            for _ in range(tree.levels):
                n = 2 * n + (1 if x[i, tree.fids[n]] < np.float32(tree.thresholds[n]) else 2)
            base[i] += tree.weights[n - len(tree.fids)]
    assert np.allclose(got, base)
    if case == 0:
        assert np.allclose(got, [21.833334, 21.833334, 33.25, 33.25, 33.25, 33.25, 21.833334, 21.833334, 21.833334, 21.833334])
    back = load(model.dump())
    assert json.loads(back.dump()) == json.loads(model.dump())
    assert np.allclose([r.prediction for r in back.predict(matrix, by_column=False).orderBy("row_id").collect()], got)
    assert all(math.isinf(t) or t == np.float32(t) for tree in back.trees for t in tree.thresholds)
    model.close()
