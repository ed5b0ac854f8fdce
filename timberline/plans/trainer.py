"""Boosting: training, incremental scoring, and the model that users hold."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from timberline.config import HIST, SOFTMAX, Configuration
from timberline.errors import TreesError
from timberline.functions.objective import gradients, softmax_gradients
from timberline.operators.binning import collect_thresholds, encode_bins, hist_thresholds, long_values, sketched_thresholds
from timberline.operators.routing import WRITTEN_OUT, leaf_written_out, literal_array, node_of
from timberline.operators.sampling import ColumnSampler
from timberline.plans.grower import Grown, grow_together
from timberline.plans.model import Tree, add_margin, base_margin, dump_json, load_json, prediction, start_margin
from timberline.sources.matrix import FeatureMatrix
from timberline.sources.tables import discarded, settled

#: Trees after which the training margin is written out anew, so that plans stay short.
SETTLE = 8
#: Labels whose trees are grown in the same passes over the rows.
TOGETHER = 8


class Model:
    """An ensemble. Given a matrix, grow_tree() adds a tree each time (for the softmax objective one for each label); predict() scores any matrix."""

    def __init__(self, config: Configuration | dict | str | None = None, matrix: FeatureMatrix | None = None):
        self.config = Configuration.parse(config)
        self.matrix, self.trees = matrix, []
        self._rows: DataFrame | None = None
        self._tables: list[DataFrame] = []
        self._fresh: list[Grown] = []

    # training

    def _prepare(self) -> None:
        m, c = self.matrix, self.config
        if m is None or m.y is None:
            raise TreesError("training needs a matrix with y or labels")
        if c.objective in SOFTMAX and (m.labels is None or m.labels_count > c.tree.labels_count):
            raise TreesError(f"the softmax objective needs labels from 0 to {c.tree.labels_count - 1}")
        design = m.design()
        self._weighted = "weight" in design.columns
        self._sampler = ColumnSampler(m.width, c.tree.colsample_bytree, c.tree.colsample_bylevel, c.internals.seed)
        self._thresholds = None
        rows = design.select("features", "y", *(["weight"] if self._weighted else []), *(["categories"] if m.category_names else []))
        if c.method == HIST:
            if c.internals.sketch_accuracy > 0:
                self._thresholds = sketched_thresholds(rows, m.numeric_width, c.internals.hist_size, c.internals.sketch_accuracy)
            else:
                self._thresholds = collect_thresholds(hist_thresholds(long_values(rows), c.internals.hist_size), m.numeric_width)
            rows = encode_bins(rows, self._thresholds)
        self._categories = m.category_sizes() if m.category_names else None
        self._first_category = m.numeric_width if m.category_names else None
        if m.category_names:
            codes, kind = self._codes
            rows = rows.withColumn(codes, F.concat(F.col(codes).cast(f"array<{kind}>"), F.col("categories").cast(f"array<{kind}>"))).drop("categories")
        if self.trees:
            raise TreesError("a loaded model can't be trained further")
        self._hold(rows.withColumn("margin", start_margin(c)))

    def _hold(self, rows: DataFrame) -> None:
        old = self._rows
        self._tables.append(settled(rows, "rows"))
        self._rows = self._tables[-1].persist(StorageLevel.MEMORY_AND_DISK)
        self._fresh = []
        if old is not None:
            old.unpersist()

    @property
    def _codes(self) -> tuple[str, str]:
        return ("bins", "int") if self.config.method == HIST else ("features", "double" if self.matrix.category_names else "float")

    @property
    def _labels(self) -> int:
        return self.config.tree.labels_count

    def _margin(self) -> Column:
        """The stored margin (an array with several labels) plus the leaves of the trees since."""
        many = self._labels > 1
        out = [F.get("margin", F.lit(k)) if many else F.col("margin") for k in range(self._labels)]
        codes, kind = self._codes
        few = sum(len(g.cuts) for g in self._fresh) <= WRITTEN_OUT
        for k, g in enumerate(self._fresh):
            t = g.tree
            if few:
                out[k % self._labels] += leaf_written_out(F.col(codes), t.fids, g.cuts, t.weights, kind, self._first_category)
                continue
            node = node_of(F.col(codes), t.fids, g.cuts, t.levels, kind, self._first_category)
            out[k % self._labels] += F.get(literal_array(t.weights, "double"), node - len(t.fids))
        return F.array(*out) if many else out[0]

    def grow_tree(self, grad: tuple[Column, Column] | None = None) -> Tree:
        """Adds one tree and returns it; for the softmax objective one for each label, all from the margins before them, and returns the last. `grad` may give g and h as Columns
        of y, margin (and weight) in place of the objective's; with several labels, arrays."""
        if self._rows is None:
            self._prepare()
        if len(self._fresh) >= SETTLE:
            self._hold(self._rows.withColumn("margin", self._margin()))
        rows = self._rows.withColumn("margin", self._margin())
        weight = F.col("weight") if self._weighted else None
        if self.config.objective in SOFTMAX:
            g, h = grad or softmax_gradients(F.col("y").cast("int"), F.col("margin"), weight, self._labels)
            each = [(F.get(g, F.lit(k)), F.get(h, F.lit(k))) for k in range(self._labels)]
        else:
            each = [grad or gradients(self.config.objective, F.col("y"), F.col("margin"), weight)]
        new = []
        for k in range(0, len(each), TOGETHER):
            own = {f"{x}{j}": c.cast("double") for j, pair in enumerate(each[k : k + TOGETHER]) for x, c in zip("gh", pair)}
            names = list(own)
            data = rows.select(self._codes[0], *(c.alias(n) for n, c in own.items()))
            new += grow_together(data, list(zip(names[::2], names[1::2])), self.config, self.matrix.width, self._thresholds, self._sampler, categories=self._categories)
        self._fresh += new
        self.trees += [n.tree for n in new]
        return self.trees[-1]

    def training_rows(self) -> DataFrame:
        """Codes, y and the margin so far."""
        return self._rows.withColumn("margin", self._margin())

    def close(self) -> None:
        """Frees the cached training rows and deletes their tables; what training_rows() gave can't be read after that."""
        if self._rows is not None:
            self._rows.unpersist()
            self._rows = None
        for table in self._tables:
            discarded(table)
        self._tables.clear()

    # scoring

    def append_last_tree(self, matrix: FeatureMatrix) -> None:
        """Adds the newest tree (with several labels the newest of each) to the matrix's running margin; the trees before must have been added."""
        k = self._labels
        if matrix.trees_added != len(self.trees) - k:
            raise TreesError(f"the matrix has {matrix.trees_added} of {len(self.trees) - k} earlier trees")
        if matrix.margin is None:
            matrix.margin = matrix.df.withColumn("_features", self._values(matrix)).withColumn("_margin", start_margin(self.config))
        out = add_margin(matrix.margin, self.trees[-k:], F.col("_features"), 0.0, "_leaf", labels=k)
        both = F.col("_margin") + F.col("_leaf") if k == 1 else F.zip_with("_margin", "_leaf", lambda a, b: a + b)
        matrix.margin = out.withColumn("_margin", both).drop("_leaf")
        matrix.trees_added += k
        if matrix.trees_added // k % SETTLE == 0:
            matrix.margin = settled(matrix.margin, "margin")

    def get_y(self, matrix: FeatureMatrix) -> DataFrame:
        """The matrix's rows with the running prediction; before any tree, the base value."""
        rows = matrix.margin if matrix.margin is not None else matrix.df.withColumn("_margin", start_margin(self.config))
        return rows.withColumn("prediction", prediction(self.config, F.col("_margin"))).drop("_margin", "_features")

    def predict(self, matrix: FeatureMatrix, n_rounds: int = -1, by_column: bool | None = None) -> DataFrame:
        """The matrix's rows with `prediction`, by the trees of the first n_rounds rounds (all if negative)."""
        trees = self.trees if n_rounds < 0 else self.trees[: n_rounds * self._labels]
        out = add_margin(matrix.df, trees, self._values(matrix), base_margin(self.config), "_margin", by_column, self._labels)
        return out.withColumn("prediction", prediction(self.config, F.col("_margin"))).drop("_margin")

    def _values(self, matrix: FeatureMatrix) -> Column:
        if not any(t.categories for t in self.trees):
            return matrix.features
        if not matrix.category_names:
            raise TreesError("the model splits by categories, which the matrix does not have")
        return matrix.values

    # exchange

    def dump(self) -> str:
        return dump_json(self.config, self.trees)

    @staticmethod
    def load(text: str) -> Model:
        config, trees = load_json(text)
        model = Model(config)
        model.trees = trees
        return model


def train(config: Configuration | dict | str | None, matrix: FeatureMatrix, num_round: int) -> Model:
    model = Model(config, matrix)
    for _ in range(num_round):
        model.grow_tree()
    return model


def load(text: str) -> Model:
    return Model.load(text)
