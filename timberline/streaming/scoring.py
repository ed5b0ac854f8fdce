"""Scoring streams: a stateless projection, so a model scores a streaming DataFrame as it does a table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from timberline.plans.trainer import Model
from timberline.sources.matrix import FeatureMatrix


def score_stream(stream: DataFrame, model: Model, features: list[str], n_rounds: int = -1, categories: Sequence[str] = ()) -> DataFrame:
    """Adds `prediction`. Rows with nulls are scored as they are: a null compares as not under a threshold and goes right."""
    return model.predict(FeatureMatrix(stream, features, categories=categories, check=False), n_rounds)
