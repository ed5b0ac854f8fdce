"""Trees, ensembles, their JSON and scoring."""

from __future__ import annotations

import json
import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from timberline.config import Configuration
from timberline.errors import TreesError
from timberline.functions.objective import from_margin, into_margin
from timberline.operators.binning import flat_lists
from timberline.operators.routing import WRITTEN_OUT, leaf_written_out, literal_array, node_of_array


@dataclass
class Tree:
    """A complete tree of `levels` splits on each way: places in heap order, a missing split is feature 0 at infinity; leaf weights from left to right, already times eta.

    `categories`, if any, has for each place the category that goes left, or None where the threshold decides."""

    levels: int
    fids: list[int]
    thresholds: list[float]
    weights: list[float]
    categories: list[int | None] = field(default_factory=list)

    def to_dict(self) -> dict:
        inner = len(self.fids)
        nodes: list[dict] = [{"id": i, "leaf": False, "left": 2 * i + 1, "right": 2 * i + 2, "threshold": None if math.isinf(t) else t, "fid": f} for i, (f, t) in enumerate(zip(self.fids, self.thresholds))]
        for node, c in zip(nodes, self.categories):
            if c is not None:
                node["category"] = c
        nodes += [{"id": inner + i, "leaf": True, "idx": i} for i in range(len(self.weights))]
        return {"depth": self.levels + 1, "nodes": nodes, "weights": self.weights}

    @staticmethod
    def from_dict(d: dict) -> Tree:
        weights = [float(np.float32(w)) for w in d["weights"]]
        levels = len(weights).bit_length() - 1
        if len(weights) != 2**levels or d.get("depth", levels + 1) != levels + 1:
            raise TreesError("a tree's weights don't fit its depth")
        fids, thresholds, categories = [0] * (len(weights) - 1), [math.inf] * (len(weights) - 1), [None] * (len(weights) - 1)
        for n in d["nodes"]:
            if not n.get("leaf", False) and n["id"] < len(fids):
                fids[n["id"]] = int(n.get("fid", 0))
                thresholds[n["id"]] = math.inf if n.get("threshold") is None else float(np.float32(n["threshold"]))
                categories[n["id"]] = n.get("category")
        return Tree(levels, fids, thresholds, weights, categories if any(c is not None for c in categories) else [])


def dump_json(config: Configuration, trees: list[Tree]) -> str:
    return json.dumps({"configuration": config.to_dict(), "model": [t.to_dict() for t in trees]})


def load_json(text: str) -> tuple[Configuration, list[Tree]]:
    try:
        raw = json.loads(text)
        return Configuration.parse(raw["configuration"]), [Tree.from_dict(t) for t in raw["model"]]
    except (KeyError, TypeError, json.JSONDecodeError) as e:
        raise TreesError(f"not a model: {e!r}") from None


def nodes_table(spark: SparkSession, trees: list[Tree]) -> DataFrame:
    """A row per node: tree, id, leaf, fid, threshold (null at infinity), category (null where the threshold decides), weight."""
    rows = []
    for k, t in enumerate(trees):
        rows += [(k, i, False, f, None if math.isinf(x) else float(x), c, None) for i, (f, x, c) in enumerate(zip(t.fids, t.thresholds, t.categories or [None] * len(t.fids)))]
        rows += [(k, len(t.fids) + i, True, None, None, None, float(w)) for i, w in enumerate(t.weights)]
    return spark.createDataFrame(rows, "tree int, id int, leaf boolean, fid int, threshold float, category int, weight double")


def trees_of(nodes: DataFrame) -> list[Tree]:
    """Trees from a nodes table (as many rows as nodes)."""
    by: dict[int, list] = {}
    for r in nodes.orderBy("tree", "id").collect():
        by.setdefault(r["tree"], []).append(r)
    out = []
    for _, rows in sorted(by.items()):
        inner, leaves = [r for r in rows if not r["leaf"]], [r for r in rows if r["leaf"]]
        categories = [r["category"] for r in inner]
        out.append(Tree(len(leaves).bit_length() - 1, [r["fid"] for r in inner], [math.inf if r["threshold"] is None else r["threshold"] for r in inner], [r["weight"] for r in leaves], categories if any(c is not None for c in categories) else []))
    return out


def margin_column(trees: list[Tree], features: Column, base: Column | float, written_out: bool | None = None) -> Column:
    """base plus each tree's leaf weight, as one expression: few nodes as nested conditions, else a fold over trees around a fold over levels, its size growing with the nodes only as constants."""
    out = base if isinstance(base, Column) else F.lit(float(base))
    if written_out if written_out is not None else sum(len(t.fids) for t in trees) <= WRITTEN_OUT:
        for t in sorted(trees, key=lambda t: t.levels):
            out = out + leaf_written_out(features, t.fids, t.thresholds, t.weights, "float", equal=t.categories)
        return out
    for levels in sorted({t.levels for t in trees}):
        out = _fold([t for t in trees if t.levels == levels], features, out)
    return out


def _fold(own: list[Tree], features: Column, start: Column) -> Column:
    levels, inner = own[0].levels, len(own[0].fids)
    fids = literal_array([f for t in own for f in t.fids], "int")
    cuts = literal_array([x for t in own for x in t.thresholds], "float")
    weights = literal_array([w for t in own for w in t.weights], "double")
    # categories are never negative, so -1 marks places where the threshold decides
    equal = literal_array([-1 if c is None else c for t in own for c in t.categories or [None] * inner], "int") if any(t.categories for t in own) else None

    def leaf(k: Column) -> Column:
        def step(n: Column, _: Column) -> Column:
            at = k * inner + n
            value = F.get(features, F.get(fids, at))
            left = value < F.get(cuts, at)
            if equal is not None:
                left = F.when(F.get(equal, at) >= 0, value == F.get(equal, at)).otherwise(left)
            return (2 * n + F.when(left, 1).otherwise(2)).cast("int")

        return F.aggregate(F.sequence(F.lit(1), F.lit(levels)), F.lit(0), step) - inner

    return F.aggregate(F.sequence(F.lit(0), F.lit(len(own) - 1)), start, lambda m, k: m + F.get(weights, k * (inner + 1) + leaf(k)))


#: Tree levels in all, over which scoring goes by Arrow batches.
COLUMN_LEVELS = 24


def add_margin(df: DataFrame, trees: list[Tree], features: Column, base: float, out: str = "margin", by_column: bool | None = None, labels: int = 1) -> DataFrame:
    """Adds the margin: by one expression for small ensembles, else by Arrow batches, a level of all rows at a time. No shuffle either way, and both work on streams.

    With several labels, trees belong to them in turn, and the margin is an array."""
    if by_column if by_column is not None else sum(t.levels for t in trees) <= COLUMN_LEVELS:
        few = sum(len(t.fids) for t in trees) <= WRITTEN_OUT
        parts = [margin_column(trees[k::labels], features, base, few) for k in range(labels)]
        return df.withColumn(out, parts[0] if labels == 1 else F.array(*parts))
    # compared in double precision, which holds both 32-bit values and categories; -1 marks places where the threshold decides
    arrays = [(np.array(t.fids, np.int64), np.array([x if c is None else c for x, c in zip(t.thresholds, t.categories or [None] * len(t.fids))]), np.array(t.weights), t.levels, np.array([c is not None for c in t.categories]) if t.categories else None) for t in trees]
    kept = [c for c in df.columns if c != out]
    kind = T.DoubleType() if labels == 1 else T.ArrayType(T.DoubleType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, n = flat_lists(batch.column("_x"))
            m = np.full((n, labels), float(base))
            for k, (fids, cuts, weights, levels, category) in enumerate(arrays if n else ()):
                m[:, k % labels] += weights[node_of_array(x, fids, cuts, levels, category) - len(fids)]
            made = pa.array(m[:, 0]) if labels == 1 else pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * labels), pa.array(m.reshape(-1)))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), made], names=[*kept, out])

    return df.select(*kept, features.alias("_x")).mapInArrow(run, T.StructType([*df.select(*kept).schema.fields, T.StructField(out, kind)]))


def base_margin(config: Configuration) -> float:
    return into_margin(config.objective, config.tree.initial_y)


def start_margin(config: Configuration) -> Column:
    """The margin before any tree: a number, or an array of them by label."""
    base, labels = F.lit(float(base_margin(config))), config.tree.labels_count
    return base if labels == 1 else F.array(*[base] * labels)


def prediction(config: Configuration, margin: Column) -> Column:
    return from_margin(config.objective, margin, config.tree.labels_count)
