"""Routing rows to nodes: heap places, where the children of i are 2 i + 1 (left) and 2 i + 2."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def child(node: Column, goes_left: Column) -> Column:
    return 2 * node + F.when(goes_left, 1).otherwise(2)


def split_bit(value: Column, threshold: Column | float) -> Column:
    """0 where a value is under the threshold (left), else 1; NaN goes right."""
    return (F.when(value < threshold, 0).otherwise(1)).cast("int")


def literal_array(values: Sequence, kind: str) -> Column:
    """A constant array from one parsed text, however long."""
    return F.split(F.lit(",".join("NaN" if v != v else "Infinity" if v == float("inf") else "-Infinity" if v == float("-inf") else repr(v) for v in (x.item() if isinstance(x, np.generic) else x for x in values))), ",").cast(f"array<{kind}>")


def node_of(codes: Column, fids: Sequence[int], cuts: Sequence, depth: int, kind: str, first_category: int | None = None) -> Column:
    """The heap place after `depth` splits, from codes by feature. For bins a code up to the cut goes left; for values (kind float or double) one under it; for features
    from `first_category` on, the cut itself."""
    if depth == 0:
        return F.lit(0)
    f, t = literal_array(fids, "int"), literal_array(cuts, kind)

    def step(n: Column, _: Column) -> Column:
        value, cut = F.get(codes, F.get(f, n)), F.get(t, n)
        left = value <= cut if kind == "int" else value < cut
        return child(n, left if first_category is None else F.when(F.get(f, n) >= first_category, value == cut).otherwise(left)).cast("int")

    return F.aggregate(F.sequence(F.lit(1), F.lit(depth)), F.lit(0), step)


#: Splits up to which trees are written out as nested conditions, which Spark compiles (a method of the JVM has bounded size); folds over arrays it interprets for every row.
WRITTEN_OUT = 32


def leaf_written_out(codes: Column, fids: Sequence[int], cuts: Sequence, weights: Sequence[float], kind: str, first_category: int | None = None, equal: Sequence[int | None] = ()) -> Column:
    """The weight of the leaf that node_of leads to, as nested conditions. `equal` has the categories of the places that ask for equality, where these are not told by `first_category`."""
    inner = len(fids)

    def below(n: int) -> Column:
        if n >= inner:
            return F.lit(float(weights[n - inner]))
        value, cut = F.get(codes, F.lit(int(fids[n]))), cuts[n].item() if isinstance(cuts[n], np.generic) else cuts[n]
        if equal and equal[n] is not None:
            left = value == F.lit(int(equal[n]))
        else:
            cut = F.lit(cut).cast(kind)
            left = value == cut if first_category is not None and fids[n] >= first_category else value <= cut if kind == "int" else value < cut
        return F.when(left, below(2 * n + 1)).otherwise(below(2 * n + 2))

    return below(0)


def node_of_array(x: np.ndarray, fids: np.ndarray, cuts: np.ndarray, depth: int, category: np.ndarray | None = None) -> np.ndarray:
    """node_of over a matrix; bins and values alike. `category` says which nodes ask for equality."""
    node, rows = np.zeros(len(x), np.int64), np.arange(len(x))
    for _ in range(depth):
        value, cut = x[rows, fids[node]], cuts[node]
        left = value < cut if x.dtype.kind == "f" else value <= cut
        node = 2 * node + np.where(left if category is None else np.where(category[node], value == cut, left), 1, 2)
    return node


def partition_index(df: DataFrame, node: str, order: str) -> DataFrame:
    """Places of a partition of each parent's rows (node // 2): left rows first in order, right rows behind in reverse order."""
    parent = F.floor(F.col(node) / 2)
    left = W.partitionBy(parent, F.col(node)).orderBy(F.col(order))
    right = W.partitionBy(parent, F.col(node)).orderBy(F.col(order).desc())
    n_left = F.sum(F.when(F.col(node) % 2 == 0, 1).otherwise(0)).over(W.partitionBy(parent))
    place = F.when(F.col(node) % 2 == 0, F.row_number().over(left) - 1).otherwise(n_left + F.row_number().over(right) - 1)
    return df.withColumn("place", place.cast("long"))
