"""Sums of gradients, hessians and rows by (node, feature, bin), and their prefix sums.

A histogram is sparse: bins without rows have no row. In exact mode the value itself stands for the bin."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from timberline.operators.binning import flat_lists
from timberline.operators.routing import node_of_array


def root_sums(df: DataFrame, gradients: Sequence[tuple[str, str]] = (("g", "h"),)) -> DataFrame:
    return df.agg(*(F.sum(c).alias(c) for pair in gradients for c in pair), F.count("*").alias("c"))


def histogram(df: DataFrame, codes: str = "bins", fids: Sequence[int] | None = None) -> DataFrame:
    """(node, fid, bin, g, h, c) of rows with node, g, h and an array of codes; partial sums combine before the shuffle."""
    if fids is None:
        long = df.select("node", "g", "h", F.posexplode(codes).alias("fid", "bin"))
    else:
        own = F.array(*(F.struct(F.lit(f).alias("fid"), F.get(codes, F.lit(f)).alias("bin")) for f in fids))
        long = df.select("node", "g", "h", F.inline(own))
    return long.groupBy("node", "fid", "bin").agg(F.sum("g").alias("g"), F.sum("h").alias("h"), F.count("*").alias("c"))


def histogram_by_task(df: DataFrame, depth: int, tree_fids: Sequence[int], tree_cuts: Sequence[int], sizes: Sequence[int], fids: Sequence[int] | None = None, nodes: Sequence[int] | None = None, first_category: int | None = None) -> DataFrame:
    """The same for bins, nodes found from the tree so far: each task counts into dense arrays (nodes x features x bins, however many rows), and these partial sums are added.

    `nodes` keeps rows of these nodes only, and arrays have room for no others. Rows have bins, g and h."""
    part = Part("g", "h", tree_fids, tree_cuts, range(len(sizes)) if fids is None else fids, nodes)
    return histograms_by_task(df, depth, [part], sizes, first_category)


@dataclass(frozen=True)
class Part:
    """What is counted for one tree: its columns of gradients and hessians, its splits so far, features, nodes (None for all), and what is added to its nodes' numbers."""

    g: str
    h: str
    tree_fids: Sequence[int]
    tree_cuts: Sequence[int]
    fids: Sequence[int]
    nodes: Sequence[int] | None = None
    shift: int = 0


def histograms_by_task(df: DataFrame, depth: int, parts: Sequence[Part], sizes: Sequence[int], first_category: int | None = None) -> DataFrame:
    """histogram_by_task for several trees of the same depth in one pass over the rows."""
    first, made = 2**depth - 1, []
    for p in parts:
        counted = np.arange(first, 2 * first + 1) if p.nodes is None else np.array(sorted(p.nodes), np.int64)
        place = np.full(first + 1, -1, np.int64)
        place[counted - first] = np.arange(len(counted))
        use = list(p.fids)
        widths = np.array([sizes[f] for f in use], np.int64)
        start = np.concatenate(([0], np.cumsum(len(counted) * widths)))  # each feature has its own nodes x bins
        tree_fids, tree_cuts = np.array(list(p.tree_fids) or [0], np.int64), np.array(list(p.tree_cuts) or [0], np.int64)
        made.append((p.g, p.h, tree_fids, tree_cuts, None if first_category is None else tree_fids >= first_category, p.nodes is not None, p.shift, counted, place, use, widths, start))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = [[np.zeros(int(m[-1][-1])) for _ in range(3)] for m in made]
        for batch in batches:
            bins, n = flat_lists(batch.column("bins"))
            if not n:
                continue
            for (g, h, tree_fids, tree_cuts, category, some, _, counted, place, use, widths, start), totals in zip(made, sums):
                x, many = bins, len(counted)
                node = place[node_of_array(x, tree_fids, tree_cuts, depth, category) - first]
                g, h = (batch.column(c).to_numpy(zero_copy_only=False) for c in (g, h))
                if some:
                    keep = node >= 0
                    x, node, g, h = x[keep], node[keep], g[keep], h[keep]
                for i, f in enumerate(use):
                    cell = node * widths[i] + x[:, f]
                    for total, w in zip(totals, (g, h, None)):
                        total[start[i] : start[i + 1]] += np.bincount(cell, weights=w, minlength=many * widths[i])
        for (*_, shift, counted, _, use, widths, start), totals in zip(made, sums):
            at = np.flatnonzero(totals[2])
            i = np.searchsorted(start, at, side="right") - 1
            node, code = np.divmod(at - start[i], widths[i])
            yield pa.RecordBatch.from_arrays(
                [pa.array((counted[node] + shift).astype(np.int32)), pa.array(np.array(use, np.int32)[i]), pa.array(code.astype(np.int32)), pa.array(totals[0][at]), pa.array(totals[1][at]), pa.array(totals[2][at].astype(np.int64))],
                names=["node", "fid", "bin", "g", "h", "c"],
            )

    counts = df.select("bins", *dict.fromkeys(c for p in parts for c in (p.g, p.h))).mapInArrow(run, "node int, fid int, bin int, g double, h double, c long")
    return counts.groupBy("node", "fid", "bin").agg(F.sum("g").alias("g"), F.sum("h").alias("h"), F.sum("c").alias("c"))


def subtracted(parent: DataFrame, small: DataFrame) -> DataFrame:
    """Histograms of both children from the parents' and the smaller children's: the larger is the difference, where rows are left."""
    sibling = small.select(F.floor((F.col("node") - 1) / 2).cast("int").alias("up"), F.col("fid").alias("f"), F.col("bin").alias("b"), F.col("g").alias("gs"), F.col("h").alias("hs"), F.col("c").alias("cs"))
    built = small.select("node").distinct().select(F.floor((F.col("node") - 1) / 2).cast("int").alias("of"), (F.when(F.col("node") % 2 == 1, F.col("node") + 1).otherwise(F.col("node") - 1)).alias("other"))
    p = parent.join(F.broadcast(built), parent["node"] == built["of"])
    both = p.join(sibling, (p["node"] == F.col("up")) & (p["fid"] == F.col("f")) & (p["bin"] == F.col("b")), "left")
    rest = both.select(F.col("other").cast("int").alias("node"), "fid", "bin", (F.col("g") - F.coalesce("gs", F.lit(0.0))).alias("g"), (F.col("h") - F.coalesce("hs", F.lit(0.0))).alias("h"), (F.col("c") - F.coalesce("cs", F.lit(0))).alias("c"))
    return small.unionByName(rest.where("c > 0"))


def prefixed(hist: DataFrame, inclusive: bool = True) -> DataFrame:
    """Adds gl, hl, cl: sums of the node's bins up to this one, or before it. A window holds one node's bins of one feature."""
    w = W.partitionBy("node", "fid").orderBy("bin").rowsBetween(W.unboundedPreceding, 0 if inclusive else -1)
    return hist.withColumns({f"{x}l": F.sum(x).over(w) for x in "ghc"})
