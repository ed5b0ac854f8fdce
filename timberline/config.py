"""Configuration of a model, and its JSON form."""

from __future__ import annotations

import json
import warnings
from dataclasses import asdict, dataclass, field, fields

from timberline.errors import TreesError

EXACT, HIST = 0, 1
LINEAR, LOGISTIC = 0, 1
#: Two numbers for the same objective: a tree per class each round, softmax of their margins.
SOFTMAX = (3, 4)


@dataclass
class TreeParam:
    max_depth: int = 6
    eta: float = 0.3
    lambda_: float = 1.0
    alpha: float = 0.0
    min_child_weight: float = 1.0
    min_leaf_size: int = 1
    gamma_absolute: float = 0.0
    gamma_relative: float = 0.0
    max_leaf_weight: float = 0.0
    colsample_bytree: float = 1.0
    colsample_bylevel: float = 1.0
    initial_y: float = 0.5
    scale_pos_weight: float = 1.0
    labels_count: int = 1


@dataclass
class Internals:
    """double_precision, compute_overlap and upload_features are accepted for exchange of models; sums are always double and Spark places data itself.

    With sketch_accuracy over 0, thresholds come from mergeable quantile sketches whose ranks are off by one part in so many, in place of exact ones (an extension)."""

    double_precision: bool = False
    compute_overlap: int = 2
    seed: int = 0
    use_hist_subtraction_trick: bool = True
    upload_features: bool = True
    hist_size: int = 255
    sketch_accuracy: int = 0


@dataclass
class Verbose:
    gpu: bool = False
    booster: bool = False
    data: bool = False


@dataclass
class Configuration:
    method: int = HIST
    objective: int = LINEAR
    tree: TreeParam = field(default_factory=TreeParam)
    internals: Internals = field(default_factory=Internals)
    verbose: Verbose = field(default_factory=Verbose)

    def __post_init__(self) -> None:
        t = self.tree
        if self.method not in (EXACT, HIST):
            raise TreesError(f"unknown method {self.method}")
        if self.objective not in (LINEAR, LOGISTIC, *SOFTMAX):
            raise TreesError(f"unknown objective {self.objective}")
        if not 1 <= t.max_depth < 31:
            raise TreesError(f"max_depth must be from 1 to 30, not {t.max_depth}")
        if not (0 < t.colsample_bytree <= 1 and 0 < t.colsample_bylevel <= 1):
            raise TreesError("colsample_bytree and colsample_bylevel must be over 0 and at most 1")
        if self.objective == LOGISTIC and not 0 < t.initial_y < 1:
            raise TreesError("initial_y must be inside (0, 1) for the logistic objective")
        if self.internals.hist_size < 2:
            raise TreesError("hist_size must be 2 or more")
        if (t.labels_count < 2) if self.objective in SOFTMAX else (t.labels_count != 1):
            raise TreesError("labels_count must be 2 or more for the softmax objective, and 1 otherwise")

    @staticmethod
    def parse(given: Configuration | dict | str | None) -> Configuration:
        """From a dict or its JSON; unknown keys are ignored, as models of other versions have them."""
        if isinstance(given, Configuration):
            return given
        try:
            raw = json.loads(given) if isinstance(given, str) else dict(given or {})
        except ValueError as e:
            raise TreesError(f"configuration is not JSON: {e}") from None

        def part(kind, key):
            values = {("lambda_" if k == "lambda" else k): v for k, v in (raw.get(key) or {}).items()}
            return kind(**{f.name: values[f.name] for f in fields(kind) if f.name in values})

        tree = part(TreeParam, "tree")
        if tree.scale_pos_weight != 1.0:
            warnings.warn("scale_pos_weight is kept in the configuration and has no effect", stacklevel=2)
        return Configuration(raw.get("method", HIST), raw.get("objective", LINEAR), tree, part(Internals, "internals"), part(Verbose, "verbose"))

    def to_dict(self) -> dict:
        out = asdict(self)
        out["tree"]["lambda"] = out["tree"].pop("lambda_")
        return out
