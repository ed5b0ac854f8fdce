"""Column sampling: a share of the features for each tree, and of these for each level."""

from __future__ import annotations

import random


class ColumnSampler:
    """Draws feature ids; the same seed draws the same. Shares are of the count of all columns, rounded down, and never none."""

    def __init__(self, columns: int, by_tree: float, by_level: float, seed: int):
        self._all, self._random = list(range(columns)), random.Random(seed)
        self._tree = max(1, int(by_tree * columns))
        self._level = max(1, int(by_level * by_tree * columns))
        self._own = self._all

    def tree(self) -> list[int]:
        if self._tree < len(self._all):
            self._random.shuffle(self._all)
        self._own = self._all[: self._tree]
        return sorted(self._own)

    def level(self) -> list[int]:
        if self._level < len(self._own):
            self._random.shuffle(self._own)
        return sorted(self._own[: self._level])
