"""Rows of exact bins are counted without the table's values in the driver."""

from collections import Counter

import numpy as np

from timberline.operators.binning import exact_counts, long_values
from timberline.plans.catalogue import QUERIES


def test_counts_of_exact_bins(spark):
    r = np.random.default_rng(2)
    x = np.stack([r.integers(0, 9, 500) / 4, r.normal(size=500).round(1), np.ones(500)], axis=1).astype(np.float32)
    got = exact_counts(long_values(spark.createDataFrame([([float(v) for v in row],) for row in x], "features array<float>").repartition(3))).collect()
    want = Counter((f, int(b)) for f in range(3) for b in np.unique(x[:, f], return_inverse=True)[1])
    assert {(g["fid"], g["bin"]): g["n"] for g in got} == want and len(got) == len(want)


def test_values_are_not_broadcast(spark):
    """Of the table nothing but stored counts of distinct values is left in the plan, and of its joins only totals of ranges are sent."""
    plan = QUERIES["exact_bins"](spark, "/root/testdata/sf0.001")._jdf.queryExecution()
    assert "lineitem" not in plan.executedPlan().toString() and "Generate" not in plan.optimizedPlan().toString()
    assert "rightHint=(strategy=broadcast)" in plan.optimizedPlan().toString()
