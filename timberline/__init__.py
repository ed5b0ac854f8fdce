"""Spark-native gradient-boosted trees, and the training-data operators beside them."""

from timberline.config import Configuration
from timberline.errors import TreesError
from timberline.estimators import TreesClassifier, TreesRegressor
from timberline.plans.trainer import Model, load, train
from timberline.sources.matrix import FeatureMatrix

__version__ = "0.1.0"
__all__ = ["Configuration", "FeatureMatrix", "Model", "TreesClassifier", "TreesError", "TreesRegressor", "load", "train"]
