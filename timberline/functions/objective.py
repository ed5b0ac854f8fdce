"""Gradients, hessians and links as Columns. Gradients are negative ones, so a leaf's weight is +G / H."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from timberline.config import LOGISTIC, SOFTMAX

#: Classes up to which softmax is written out as plain arithmetic, which Spark compiles; functions over arrays it interprets for every row.
WRITTEN_OUT = 16


def sigmoid(x: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))


def logit(p: Column) -> Column:
    return F.ln(p / (F.lit(1.0) - p))


def gradients(objective: int, y: Column, margin: Column, weight: Column | None = None) -> tuple[Column, Column]:
    """g and h; the linear objective's h is 1. Weights multiply both (an extension: without them every row counts 1)."""
    y, margin = y.cast("double"), margin.cast("double")
    if objective == LOGISTIC:
        p = sigmoid(margin)
        g, h = y - p, p * (F.lit(1.0) - p)
    else:
        g, h = y - margin, F.lit(1.0)
    return (g, h) if weight is None else (g * weight, h * weight)


def into_margin(objective: int, value: float) -> float:
    return math.log(value / (1 - value)) if objective == LOGISTIC else value


def from_margin(objective: int, margin: Column, labels: int | None = None) -> Column:
    """The prediction; for the softmax objective an array of classes' probabilities from one of margins."""
    return softmax(margin, labels) if objective in SOFTMAX else sigmoid(margin) if objective == LOGISTIC else margin


def _chances(margins: Column, labels: int) -> list[Column]:
    each = [F.get(margins, F.lit(k)) for k in range(labels)]
    top = F.greatest(*each)
    shifted = [F.exp(x - top) for x in each]
    total = reduce(lambda a, b: a + b, shifted, F.lit(0.0))
    return [x / total for x in shifted]


def softmax(margins: Column, labels: int | None = None) -> Column:
    """exp(x_j) / sum of exp(x), from an array, whose length may be given; shifted by the greatest for range."""
    if labels is not None and 2 <= labels <= WRITTEN_OUT:
        return F.array(*_chances(margins, labels))
    shifted = F.transform(margins, lambda x: F.exp(x - F.array_max(margins)))
    return F.transform(shifted, lambda x: x / F.aggregate(shifted, F.lit(0.0), lambda a, b: a + b))


def softmax_gradients(label: Column, margins: Column, weight: Column | None = None, labels: int | None = None) -> tuple[Column, Column]:
    """Arrays of g_j = [j = label] - p_j and h_j = 2 p_j (1 - p_j); a weight multiplies g only. The arrays' length may be given."""
    if labels is not None and 2 <= labels <= WRITTEN_OUT:
        each = _chances(margins, labels)
        g = [F.when(label == j, 1.0).otherwise(0.0) - x for j, x in enumerate(each)]
        return F.array(*(x if weight is None else x * weight for x in g)), F.array(*(2 * x * (1 - x) for x in each))
    p = softmax(margins)
    g = F.transform(p, lambda x, j: F.when(j == label, 1.0).otherwise(0.0) - x)
    if weight is not None:
        g = F.transform(g, lambda x: x * weight)
    return g, F.transform(p, lambda x: 2 * x * (1 - x))
