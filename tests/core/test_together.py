"""Softmax written out for the compiler, and the trees of several classes grown in common passes."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from timberline.config import Configuration
from timberline.functions.objective import softmax, softmax_gradients
from timberline.operators.sampling import ColumnSampler
from timberline.plans import grower
from timberline.plans.trainer import train
from timberline.sources.matrix import FeatureMatrix


@pytest.fixture(scope="module")
def three():
    r = np.random.default_rng(5)
    x = r.normal(size=(400, 4)).astype(np.float32)
    return x, ((x[:, 0] > 0.3).astype(int) + (x[:, 1] > 0)).astype(np.int32)


def test_softmax_is_compiled(spark, three):
    """Nothing of training rows' gradients or of predictions is left to functions over arrays, which are interpreted for every row."""
    x, kind = three
    m = FeatureMatrix.from_arrays(spark, x, labels=kind)
    model = train({"objective": 3, "tree": {"labels_count": 3, "max_depth": 2, "initial_y": 0.0}}, m, 1)
    rows = model.training_rows()
    g, h = softmax_gradients(F.col("y").cast("int"), F.col("margin"), labels=3)
    for df in (model.predict(m).select("prediction"), rows.select(g, h)):
        assert "lambda" not in df._jdf.queryExecution().optimizedPlan().toString()
    p = rows.select(softmax(F.col("margin")).alias("a"), softmax(F.col("margin"), 3).alias("b"))
    assert p.where("a != b").count() == 0
    model.close()


@pytest.mark.parametrize("cells", [grower.TASK_CELLS, 60, 8])
def test_trees_grown_together(spark, three, monkeypatch, cells):
    """They are those grown one by one, whether in one pass, in blocks of features or by the hash aggregate; columns drawn for each."""
    x, kind = three
    monkeypatch.setattr(grower, "TASK_CELLS", cells)
    bins = np.clip(np.round(x * 4), -7, 8).astype(int) + 7
    cuts = [np.arange(15, dtype=np.float32)] * 4
    rows = [(list(map(int, b)), *(float(v) for j in range(3) for v in ((k == j) - 0.25, 0.5))) for b, k in zip(bins, kind)]
    df = spark.createDataFrame(rows, "bins array<int>, " + ", ".join(f"g{j} double, h{j} double" for j in range(3))).repartition(3)
    c = Configuration.parse({"method": 1, "objective": 3, "tree": {"labels_count": 3, "max_depth": 3, "colsample_bytree": 0.75, "colsample_bylevel": 0.7}, "internals": {"hist_size": 16}})
    draw = lambda: ColumnSampler(4, 0.75, 0.7, 1)
    together = grower.grow_together(df, [(f"g{j}", f"h{j}") for j in range(3)], c, 4, cuts, draw())
    one = draw()
    for j, t in enumerate(together):
        alone = grower.grow(df.select("bins", F.col(f"g{j}").alias("g"), F.col(f"h{j}").alias("h")), c, 4, cuts, one)
        assert (t.tree.fids, t.cuts) == (alone.tree.fids, alone.cuts) and np.allclose(t.tree.weights, alone.tree.weights, rtol=1e-5)
        assert len(set(t.cuts)) > 2


def test_one_pass_a_level(spark, three, monkeypatch):
    x, kind = three
    passes = []
    count = grower.histograms_by_task
    monkeypatch.setattr(grower, "histograms_by_task", lambda *a: passes.append(a[1]) or count(*a))
    train({"objective": 3, "tree": {"labels_count": 3, "max_depth": 2, "initial_y": 0.0}, "internals": {"hist_size": 8}}, FeatureMatrix.from_arrays(spark, x, labels=kind), 1).close()
    assert passes == [0, 1]
