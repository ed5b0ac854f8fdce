"""Regressor and classifier with fit, predict, evaluation sets and early stopping."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame

from timberline.config import EXACT, HIST, LINEAR, LOGISTIC, SOFTMAX, Configuration, Internals, TreeParam
from timberline.errors import TreesError
from timberline.functions.metrics import auc_table, log_loss, mse
from timberline.plans.trainer import Model
from timberline.sources.matrix import FeatureMatrix

#: From a DataFrame with y and prediction to a number, the smaller the better.
Metric = Callable[[DataFrame], float]


def mean_squared_error(df: DataFrame) -> float:
    return df.agg(mse()).first()[0]


def negative_auc(df: DataFrame) -> float:
    return -auc_table(df).first()[0]


def mean_log_loss(df: DataFrame) -> float:
    return df.agg(log_loss()).first()[0]


class _Estimator:
    objective, metric = LINEAR, staticmethod(mean_squared_error)

    def __init__(
        self,
        max_depth: int = 6,
        learning_rate: float = 0.1,
        n_estimators: int = 100,
        verbosity: int = 1,
        gamma_absolute: float = 0.0,
        gamma_relative: float = 0.0,
        min_child_weight: float = 1.0,
        min_leaf_size: int = 0,
        max_leaf_weight: float = 0.0,
        colsample_bytree: float = 0.8,
        colsample_bylevel: float = 1.0,
        l1: float = 1.0,
        l2: float = 1.0,
        scale_pos_weight: float = 1.0,
        initial_y: float = 0.5,
        seed: int = 0,
        double_precision: bool = False,
        method: str = "hist",
        hist_size: int = 255,
    ):
        if method not in ("hist", "exact"):
            raise TreesError(f"unknown method {method}")
        tree = TreeParam(max_depth, learning_rate, l2, l1, min_child_weight, min_leaf_size, gamma_absolute, gamma_relative, max_leaf_weight, colsample_bytree, colsample_bylevel, initial_y, scale_pos_weight)
        self.config = Configuration(HIST if method == "hist" else EXACT, self.objective, tree, Internals(double_precision, seed=seed, hist_size=hist_size))
        self.n_estimators, self.verbosity = n_estimators, verbosity
        self.model: Model | None = None
        self.best_round: int | None = None
        self.best_score: float | None = None
        self.scores: list[float] = []

    def fit(self, matrix: FeatureMatrix, eval_set: FeatureMatrix | None = None, early_stopping_rounds: int = 5, eval_metric: Metric | None = None):
        """Grows up to n_estimators trees. With an evaluation set, stops once the score has not become strictly less for over early_stopping_rounds rounds; trees grown since the best stay in the model."""
        self.model, self.scores, self.best_round, self.best_score = Model(self.config, matrix), [], None, None
        metric = eval_metric or self.metric
        for i in range(self.n_estimators):
            self.model.grow_tree()
            if eval_set is None:
                continue
            self.model.append_last_tree(eval_set)
            score = metric(self.model.get_y(eval_set).withColumn("y", eval_set.y))
            self.scores.append(score)
            if self.verbosity > 1:
                print(f"[{i}] {score}")
            if self.best_score is None or score < self.best_score:
                self.best_round, self.best_score = i, score
            if early_stopping_rounds + self.best_round < i:
                break
        return self

    def predict(self, matrix: FeatureMatrix, n_rounds: int = -1) -> DataFrame:
        if self.model is None:
            raise TreesError("fit the estimator first")
        return self.model.predict(matrix, n_rounds)


class TreesRegressor(_Estimator):
    """Linear objective; the metric is the mean squared error."""


class TreesClassifier(_Estimator):
    """Logistic objective; predictions are the positive class's probabilities, the metric is the negative area under the ROC curve.

    With labels_count of 2 or more (an extension), the softmax objective: predictions are arrays of the classes' probabilities, the metric is the mean log loss."""

    objective, metric = LOGISTIC, staticmethod(negative_auc)

    def __init__(self, *given, labels_count: int = 1, **named):
        super().__init__(*given, **named)
        if labels_count > 1:
            self.config = replace(self.config, objective=SOFTMAX[0], tree=replace(self.config.tree, labels_count=labels_count))
            self.metric = mean_log_loss
