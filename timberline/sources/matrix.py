"""The data matrix: named feature columns in order, with target, labels and weights."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from timberline.errors import TreesError


class FeatureMatrix:
    """A DataFrame seen as a dense float32 matrix.

    `features` lists numeric columns (or is the name of one array column, then `width` is needed unless it is to be counted); the place in it is a feature's id. `categories` lists
    integer columns of values from 0, whose ids follow. `y`, `labels` and `weights` are names or Columns. Nulls are refused unless `missing` says what stands for them."""

    def __init__(
        self,
        df: DataFrame,
        features: Sequence[str] | str,
        y: Column | str | None = None,
        labels: Column | str | None = None,
        weights: Column | str | None = None,
        categories: Sequence[str] = (),
        missing: float | None = None,
        width: int | None = None,
        check: bool = True,
    ):
        if y is not None and labels is not None:
            raise TreesError("give y or labels, not both")
        self.df, self.category_names = df, list(categories)
        kinds = dict(df.dtypes)
        whole = {"tinyint", "smallint", "int", "bigint"}
        for c in self.category_names:
            if kinds.get(c) not in whole:
                raise TreesError(f"category column {c} must hold integers")
        fill = (lambda c: F.coalesce(c, F.lit(float(missing)).cast("float"))) if missing is not None else (lambda c: c)
        if isinstance(features, str):
            self.features = fill_array(F.col(features).cast("array<float>"), missing)
            self.numeric_width = width or df.select(F.size(features)).first()[0]
            self.names = [f"{features}[{i}]" for i in range(self.numeric_width)]
        else:
            for c in features:
                if not isinstance(df.schema[c].dataType, (T.NumericType, T.BooleanType)):
                    raise TreesError(f"feature column {c} must be numeric")
            self.names, self.numeric_width = list(features), len(features)
            self.features = F.array(*(fill(F.col(c).cast("float")) for c in features))
        if not self.numeric_width:
            raise TreesError("no features")
        self.width = self.numeric_width + len(self.category_names)
        column = lambda x: F.col(x) if isinstance(x, str) else x
        self.y = None if y is None and labels is None else column(y if y is not None else labels).cast("float")
        self.labels = None if labels is None else column(labels).cast("int")
        self.weights = None if weights is None else column(weights).cast("float")
        self.margin: DataFrame | None = None
        self.trees_added = 0
        if check:
            self._check()

    def _check(self) -> None:
        parts = [F.count_if(F.exists(self.features, lambda x: x.isNull()) | (F.size(self.features) != self.numeric_width)).alias("features")]
        for name, c in (("y", self.y), ("weights", self.weights)):
            if c is not None:
                parts.append(F.count_if(c.isNull()).alias(name))
        parts += [F.count_if(F.col(c).isNull() | (F.col(c) < 0)).alias(c) for c in self.category_names]
        for name, n in self.df.agg(*parts).first().asDict().items():
            if n:
                raise TreesError(f"{n} rows have a null, a negative category or a wrong number of values in {name}")

    @property
    def categories(self) -> Column:
        return F.array(*(F.col(c).cast("int") for c in self.category_names)) if self.category_names else F.array().cast("array<int>")

    @property
    def values(self) -> Column:
        """Features and categories in one array, in double precision, which holds both exactly."""
        return F.concat(self.features.cast("array<double>"), self.categories.cast("array<double>"))

    def category_sizes(self) -> list[int]:
        """One more than the greatest code of each category column."""
        return [1 + (x or 0) for x in self.df.agg(*(F.max(c) for c in self.category_names)).first()]

    @property
    def labels_count(self) -> int:
        return 1 if self.labels is None else int(self.df.agg(F.max(self.labels)).first()[0]) + 1

    def design(self) -> DataFrame:
        """features array<float>, and y and weight where given; nothing else is read."""
        out = [self.features.alias("features")]
        if self.category_names:
            out.append(self.categories.alias("categories"))
        if self.y is not None:
            out.append(self.y.alias("y"))
        if self.weights is not None:
            out.append(self.weights.alias("weight"))
        return self.df.select(*out)

    @staticmethod
    def from_arrays(spark: SparkSession, data: np.ndarray, data_category: np.ndarray | None = None, y=None, labels=None, weights=None, missing: float | None = None) -> FeatureMatrix:
        """From arrays in the driver's memory; rows are numbered in column row_id."""
        data = np.asarray(data)
        if data.ndim != 2:
            raise TreesError("data must have two dimensions")
        columns: dict[str, np.ndarray] = {"row_id": np.arange(len(data))} | {f"f{i}": data[:, i].astype(np.float32) for i in range(data.shape[1])}
        names = []
        if data_category is not None:
            data_category = np.asarray(data_category)
            if data_category.ndim != 2 or not np.issubdtype(data_category.dtype, np.integer):
                raise TreesError("data_category must have two dimensions and hold integers")
            names = [f"c{i}" for i in range(data_category.shape[1])]
            columns |= {n: data_category[:, i].astype(np.int32) for i, n in enumerate(names)}
        for name, x in (("y", y), ("labels", labels), ("weights", weights)):
            if x is not None:
                if len(x) != len(data):
                    raise TreesError(f"{name} has {len(x)} values for {len(data)} rows")
                columns[name] = np.asarray(x).astype(np.int32 if name == "labels" else np.float32)
        import pandas as pd

        df = spark.createDataFrame(pd.DataFrame(columns))
        given = {name: name for name, x in (("y", y), ("labels", labels), ("weights", weights)) if x is not None}
        return FeatureMatrix(df, [f"f{i}" for i in range(data.shape[1])], categories=names, missing=missing, **given)


def fill_array(c: Column, missing: float | None) -> Column:
    return c if missing is None else F.transform(c, lambda x: F.coalesce(x, F.lit(float(missing)).cast("float")))

