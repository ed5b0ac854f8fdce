"""Growing trees: a Spark job per level, whose result is at most one row per node."""

from __future__ import annotations

import math
from dataclasses import dataclass, replace
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from timberline.config import EXACT, Configuration
from timberline.functions.gain import Penalties, weight_of
from timberline.operators.histogram import Part, histogram, histograms_by_task, root_sums, subtracted
from timberline.operators.routing import literal_array, node_of
from timberline.operators.sampling import ColumnSampler
from timberline.operators.splits import all_candidates, best_splits, with_gain
from timberline.plans.model import Tree

#: Cells of a dense partial histogram (nodes x features x bins) that a task may hold, and passes over the rows that blocks of features may take; beyond, rows are exploded and counted by Spark's own hash aggregate.
TASK_CELLS, PASSES = 1 << 22, 16


@dataclass
class Grown:
    """A tree with its cuts as bins (or values, in exact mode), for routing the training rows."""

    tree: Tree
    cuts: list


def feature_blocks(sizes: list[int], fids: list[int], nodes: int, most: int) -> list[list[int]] | None:
    """The features in blocks whose histograms over so many nodes have at most `most` cells; None if one alone has more."""
    out: list[list[int]] = []
    room = 0
    for f in fids:
        cells = sizes[f] * nodes
        if cells > most:
            return None
        if not out or cells > room:
            out.append([])
            room = most
        out[-1].append(f)
        room -= cells
    return out


def part_blocks(parts: list[Part], sizes: list[int], nodes: list[int], most: int) -> list[list[Part]] | None:
    """feature_blocks of several trees in one sequence: each block has the parts that one pass counts; None if one feature alone has too many cells."""
    out: list[list[Part]] = []
    room = 0
    for p, n in zip(parts, nodes):
        for f in p.fids:
            cells = sizes[f] * n
            if cells > most:
                return None
            if not out or cells > room:
                out.append([])
                room = most
            if out[-1] and out[-1][-1].shift == p.shift:
                out[-1][-1] = replace(p, fids=[*out[-1][-1].fids, f])
            else:
                out[-1].append(replace(p, fids=[f]))
            room -= cells
    return out


def grow(data: DataFrame, config: Configuration, width: int, thresholds: list[np.ndarray] | None, sampler: ColumnSampler, by_task: bool = True, categories: list[int] | None = None) -> Grown:
    """One tree from rows of codes, g and h; see grow_together."""
    return grow_together(data, [("g", "h")], config, width, thresholds, sampler, by_task, categories)[0]


def grow_together(data: DataFrame, gradients: list[tuple[str, str]], config: Configuration, width: int, thresholds: list[np.ndarray] | None, sampler: ColumnSampler, by_task: bool = True, categories: list[int] | None = None) -> list[Grown]:
    """A tree for each pair of columns of gradients and hessians, from rows of codes (bins array<int>, or features array<float or double> in exact mode) and these. `categories` has the number of codes of each category feature; these come last.

    A level of all the trees is one pass over the rows. The node of a row is an expression of its codes and the tree so far, so nothing of the data is rewritten between levels. With the subtraction trick only the smaller child of each split
    is counted; the parents' histograms are cached for it. In the histograms tree j hangs in a larger one, as the subtree of place 2^a - 1 + j, so that parents and children of all are told by the same arithmetic."""
    exact, p, levels = config.method == EXACT, Penalties.of(config), config.tree.max_depth
    first_category = width - len(categories) if categories else None
    codes, kind = ("bins", "int") if not exact else ("features", "double" if categories else "float")
    none = math.inf if exact else 2**31 - 1
    sizes = [len(t) + 1 for t in thresholds] + list(categories or ()) if thresholds is not None else None
    trees = range(len(gradients))
    fids, cuts, limits, equal = ([[] for _ in trees] for _ in range(4))
    drawn = []
    for _ in trees:
        sampled = sampler.tree()
        drawn.append([sampler.level() if len(sampled) > 1 else sampled for _ in range(levels)])
    r = root_sums(data, gradients).first()
    sums = [{0: (r[g] or 0.0, r[h] or 0.0, r["c"])} for g, h in gradients]
    held: DataFrame | None = None  # the histograms that are cached
    cached: DataFrame | None = None
    cached_fids: list[set[int]] = []
    for level in range(levels):
        first, own = 2**level - 1, [d[level] for d in drawn]
        shift = [2**level * (2 ** (len(gradients) - 1).bit_length() - 1 + j) for j in trees]
        size = lambda j, n: sums[j].get(n, (0, 0, 0))[2]
        alive = [[n for n in range(first, 2 * first + 1) if size(j, n) > 0] for j in trees]
        best, small = {}, None
        if any(alive):
            trick = config.internals.use_hist_subtraction_trick and not exact and cached is not None and all(set(own[j]) <= cached_fids[j] for j in trees)
            count = alive
            if trick:  # the smaller child of each pair, the left one if equal
                count = [[min((u, u + 1), key=lambda n: (size(j, n), n)) for u in range(first, 2 * first + 1, 2) if size(j, u) + size(j, u + 1) > 0] for j in trees]
            parts = [Part(*gradients[j], fids[j], cuts[j], own[j], count[j] if len(count[j]) < 2**level else None, shift[j]) for j in trees if count[j]]
            blocks = part_blocks(parts, sizes, [len(c) for c in count if c], TASK_CELLS) if by_task and sizes is not None else None
            if blocks is not None and len(blocks) <= PASSES * len(gradients):
                hists = [histograms_by_task(data, level, b, sizes, first_category) for b in blocks]
            else:
                hists = []
                for part in parts:
                    node = node_of(F.col(codes), part.tree_fids, part.tree_cuts, level, kind, first_category)
                    rows = data.select(codes, F.col(part.g).alias("g"), F.col(part.h).alias("h")).withColumn("node", node)
                    if part.nodes is not None:
                        counted = set(part.nodes)
                        rows = rows.where(F.get(literal_array([int(n in counted) for n in range(first, 2 * first + 1)], "int"), F.col("node") - first) == 1)
                    hists.append(histogram(rows.withColumn("node", F.col("node") + part.shift), codes, part.fids if len(part.fids) < width else None))
            hist = reduce(DataFrame.unionByName, hists)
            if trick:
                if any(len(own[j]) < len(cached_fids[j]) for j in trees):
                    up = [s // 2 + first // 2 for s in shift]  # the first node of each tree in the parents' level
                    cached = cached.where(reduce(Column.__or__, (F.col("node").between(up[j], up[j] + first // 2) & F.col("fid").isin(own[j]) for j in trees)))
                small = hist.persist()
                small.count()  # it is read three times below, and would be counted as often
                hist = subtracted(cached, small)
            if config.internals.use_hist_subtraction_trick and not exact and level + 1 < levels:
                hist = hist.persist()
            best = {b["node"]: b for b in best_splits(with_gain(all_candidates(hist, exact, first_category), p), first_category).collect()}
            for old in (held, small):
                if old is not None:
                    old.unpersist()
            held = cached = hist if hist.is_cached else None
            cached_fids = [set(o) for o in own]
        for j in trees:
            for n in range(first, 2 * first + 1):
                b, total = best.get(n + shift[j]), sums[j].get(n, (0.0, 0.0, 0))
                category = b is not None and first_category is not None and b["fid"] >= first_category
                fids[j].append(b["fid"] if b else 0)
                cuts[j].append(b["cut"] if b else none)
                equal[j].append(int(b["cut"]) if category else None)
                limits[j].append(math.inf if b is None or category else float(b["cut"]) if exact else float(thresholds[b["fid"]][b["cut"]]))
                left = (b["gl"], b["hl"], b["cl"]) if b else total
                sums[j][2 * n + 1] = left
                sums[j][2 * n + 2] = (total[0] - left[0], total[1] - left[1], total[2] - left[2]) if b else (0.0, 0.0, 0)
    if held is not None:
        held.unpersist()
    out = []
    for j in trees:
        leaves = [sums[j][n] for n in range(2**levels - 1, 2 ** (levels + 1) - 1)]
        weights = [float(np.float32(weight_of(*s, p) * config.tree.eta)) for s in leaves]
        out.append(Grown(Tree(levels, fids[j], limits[j], weights, equal[j] if any(c is not None for c in equal[j]) else []), cuts[j]))
    return out
