"""Leaf weight, node score and split gain, as SQL text that Spark and other engines read alike.

G is a node's sum of gradients, H of hessians (its count for the linear objective), C its count."""

from __future__ import annotations

from dataclasses import dataclass

from timberline.config import LINEAR, Configuration


def number(x: float) -> str:
    """A double literal."""
    return f"{float(x)!r}" if "e" in repr(float(x)) else f"{float(x)!r}e0"


@dataclass(frozen=True)
class Penalties:
    lambda_: float = 1.0
    alpha: float = 0.0
    min_child_weight: float = 1.0
    min_leaf_size: int = 1
    gamma_absolute: float = 0.0
    gamma_relative: float = 0.0
    max_leaf_weight: float = 0.0
    #: Both sides need min_child_weight for a split; the linear objective does not ask that.
    gate_hessian: bool = False

    @staticmethod
    def of(c: Configuration) -> Penalties:
        t = c.tree
        return Penalties(t.lambda_, t.alpha, t.min_child_weight, t.min_leaf_size, t.gamma_absolute, t.gamma_relative, t.max_leaf_weight, c.objective != LINEAR)


def weight(g: str, h: str, c: str, p: Penalties) -> str:
    """sign(G) * max(0, |G| - alpha) / (H + lambda), clamped; 0 under the floors, and where H + lambda is 0."""
    w = f"sign({g}) * greatest(0e0, abs({g}) - {number(p.alpha)}) / nullif({h} + {number(p.lambda_)}, 0e0)"
    if p.max_leaf_weight:
        w = f"greatest({number(-p.max_leaf_weight)}, least({number(p.max_leaf_weight)}, {w}))"
    return f"(case when {c} >= {p.min_leaf_size} and {h} >= {number(p.min_child_weight)} then coalesce({w}, 0e0) else 0e0 end)"


def score(g: str, h: str, w: str, p: Penalties) -> str:
    return f"(2 * {g} * {w} - ({h} + {number(p.lambda_)}) * {w} * {w} - {number(2 * p.alpha)} * abs({w}))"


def gain(p: Penalties) -> str:
    """From columns cl, hl, cr, hr, score_l, score_r and score_p: the gain as a 32-bit float, on which ties are judged; 0 if the split is not allowed."""
    d = "(score_l + score_r - score_p)"
    ok = f"cl >= {p.min_leaf_size} and cr >= {p.min_leaf_size}"
    if p.gate_hessian:
        ok += f" and abs(hl) >= {number(p.min_child_weight)} and abs(hr) >= {number(p.min_child_weight)}"
    return f"cast(case when {ok} and {d} > {number(p.gamma_absolute)} and {d} > {number(p.gamma_relative)} * score_p then {d} else 0e0 end as float)"


def gain_steps(source: str, p: Penalties, keep: str) -> str:
    """A select that adds cr, weights, scores and gain to rows with gl, hl, cl (left) and g, h, c (node)."""
    sides = f"select {keep}, gl, hl, cl, g, h, c, g - gl as gr, h - hl as hr, c - cl as cr from {source}"
    weights = f"select *, {weight('gl', 'hl', 'cl', p)} as wl, {weight('gr', 'hr', 'cr', p)} as wr, {weight('g', 'h', 'c', p)} as wp from ({sides}) s1"
    scores = f"select *, {score('gl', 'hl', 'wl', p)} as score_l, {score('gr', 'hr', 'wr', p)} as score_r, {score('g', 'h', 'wp', p)} as score_p from ({weights}) s2"
    return f"select *, {gain(p)} as gain from ({scores}) s3"


def weight_of(g: float, h: float, c: int, p: Penalties) -> float:
    """The leaf weight of sums already in the driver."""
    if c < p.min_leaf_size or h < p.min_child_weight or h + p.lambda_ == 0:
        return 0.0
    w = (1 if g > 0 else -1 if g < 0 else 0) * max(0.0, abs(g) - p.alpha) / (h + p.lambda_)
    return max(-p.max_leaf_weight, min(p.max_leaf_weight, w)) if p.max_leaf_weight else w
