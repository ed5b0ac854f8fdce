"""Split candidates, their gains, and the best of each node."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from timberline.functions.gain import Penalties, gain_steps
from timberline.operators.histogram import prefixed


def candidates(hist: DataFrame, exact: bool = False) -> DataFrame:
    """(node, fid, cut, gl, hl, cl, g, h, c). Bins: left is bin <= cut, where cut is the last bin before the next one with rows (an empty bin routes like it, and the largest of
    equal gains counts). Exact: left is value < cut, for each value but the node's first."""
    node = W.partitionBy("node", "fid")
    p = prefixed(hist, inclusive=not exact)
    totals = {x: F.sum(x).over(node) for x in "ghc"}
    if exact:
        rows = p.withColumns(totals).withColumn("cut", F.col("bin")).where("cl is not null")
    else:
        rows = p.withColumns(totals | {"cut": F.lead("bin").over(node.orderBy("bin")) - 1}).where("cut is not null")
    return rows.select("node", "fid", "cut", "gl", "hl", "cl", "g", "h", "c")


def with_gain(cands: DataFrame, p: Penalties) -> DataFrame:
    return cands.sparkSession.sql(gain_steps("{cands}", p, "node, fid, cut"), cands=cands).select("node", "fid", "cut", "gl", "hl", "cl", "g", "h", "c", "gain")


def best_per_feature(gains: DataFrame) -> DataFrame:
    """Of equal gains the largest cut."""
    best = gains.groupBy("node", "fid").agg(F.max(F.struct("gain", "cut", "gl", "hl", "cl", "g", "h", "c")).alias("b"))
    return best.select("node", "fid", "b.*")


def best_splits(gains: DataFrame, first_category: int | None = None) -> DataFrame:
    """One row per node with a positive gain: the greatest gain, of equal ones the smaller feature, then the largest cut (of categories the smallest)."""
    order = F.col("cut") if first_category is None else F.when(F.col("fid") >= first_category, -F.col("cut")).otherwise(F.col("cut"))
    best = gains.where("gain > 0").groupBy("node").agg(F.max(F.struct("gain", (-F.col("fid")).alias("minus"), order.alias("order"), "cut", "gl", "hl", "cl", "g", "h", "c")).alias("b"))
    return best.select("node", "b.gain", (-F.col("b.minus")).alias("fid"), "b.cut", "b.gl", "b.hl", "b.cl", "b.g", "b.h", "b.c")


def category_candidates(hist: DataFrame) -> DataFrame:
    """One category against the rest: left is the category itself, so sums need no prefixes."""
    node = W.partitionBy("node", "fid")
    return hist.select("node", "fid", F.col("bin").alias("cut"), F.col("g").alias("gl"), F.col("h").alias("hl"), F.col("c").alias("cl"), *(F.sum(x).over(node).alias(x) for x in "ghc"))


def category_splits(hist: DataFrame, p: Penalties) -> DataFrame:
    return with_gain(category_candidates(hist), p)


def all_candidates(hist: DataFrame, exact: bool, first_category: int | None) -> DataFrame:
    """Cuts of numeric features and categories of those from `first_category` on."""
    if first_category is None:
        return candidates(hist, exact)
    own = F.col("fid") >= first_category
    return candidates(hist.where(~own), exact).unionByName(category_candidates(hist.where(own)))


def best_category_splits(gains: DataFrame) -> DataFrame:
    """As best_splits, but of equal gains the smallest category."""
    best = gains.where("gain > 0").groupBy("node").agg(F.max(F.struct("gain", (-F.col("fid")).alias("minus"), (-F.col("cut")).alias("cut"), "gl", "hl", "cl", "g", "h", "c")).alias("b"))
    return best.select("node", "b.gain", (-F.col("b.minus")).alias("fid"), (-F.col("b.cut")).alias("cut"), "b.gl", "b.hl", "b.cl", "b.g", "b.h", "b.c")
