"""Cells of neighbouring rows in a numeric space with gaps, and bounds on the distance to them.

A tree fitted on a bounded sample cuts the widest column of a node at its median; rows
without a value there go to a third branch. What a cell really holds is measured over all
rows: the box of its values, how many rows have each column. From this follows how near any
of its rows can be to a given one, so whole cells can be left out of a search.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np


@dataclass
class CellTree:
    """Splits ``(column, cut, below, above, without)`` by node; a leaf has its cell's number."""

    nodes: list = field(default_factory=list)
    cells: int = 0

    @classmethod
    def fit(cls, sample: np.ndarray, leaf: int) -> CellTree:
        tree = cls()
        tree._grow(sample, leaf)
        return tree

    def _grow(self, rows: np.ndarray, leaf: int) -> int:
        node = len(self.nodes)
        self.nodes.append(None)
        low, high = _extremes(rows)
        wide = high - low
        if len(rows) <= leaf or not (wide > 0).any():
            self.nodes[node] = self.cells
            self.cells += 1
            return node
        column = int(np.argmax(wide))
        values = rows[:, column]
        there = values[~np.isnan(values)]
        cut = float(np.median(there))
        if not (there < cut).any():
            cut = float(there[there > cut].min())  # over half of the values are the smallest
        parts = (rows[values < cut], rows[values >= cut], rows[np.isnan(values)])
        self.nodes[node] = (column, cut, *(self._grow(p, leaf) for p in parts))
        return node

    def assign(self, rows: np.ndarray) -> np.ndarray:
        out = np.zeros(len(rows), np.int64)
        stack = [(0, np.arange(len(rows)))]
        while stack:
            node, at = stack.pop()
            split = self.nodes[node]
            if not isinstance(split, tuple):
                out[at] = split
            elif len(at):
                values = rows[at, split[0]]
                gap = np.isnan(values)
                stack += zip(split[2:], (at[values < split[1]], at[values >= split[1]], at[gap]))
        return out


def _extremes(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Smallest and largest value of each column; equal where there is none."""
    gap = np.isnan(rows)
    low = np.where(gap, np.inf, rows).min(axis=0, initial=np.inf)
    high = np.where(gap, -np.inf, rows).max(axis=0, initial=-np.inf)
    return np.where(low > high, 0.0, low), np.where(low > high, 0.0, high)


@dataclass
class Boxes:
    """What cells hold: ``low`` and ``high`` by cell and column, ``always`` where every row has
    the column and ``ever`` where one has; ``size`` rows each."""

    number: np.ndarray
    size: np.ndarray
    low: np.ndarray
    high: np.ndarray
    always: np.ndarray
    ever: np.ndarray

    def nearest_possible(self, rows: np.ndarray) -> np.ndarray:
        """For each row and cell no more than the distance to any row of the cell; infinite
        where no row can share a column.

        The distance is Euclidean over shared columns, scaled up by the share compared. A
        column that some rows of the cell lack may not count, and no more columns are
        shared than any row has.
        """
        width = rows.shape[1]
        out = np.empty((len(rows), len(self.number)))
        for at in range(0, len(rows), 64):
            x = rows[at : at + 64, None, :]
            seen = ~np.isnan(x)
            gap = np.maximum(np.maximum(self.low - x, x - self.high), 0.0)
            total = np.where(seen & self.always, gap, 0.0) ** 2
            shared = (seen & self.ever).sum(axis=2)
            scale = np.divide(width, shared, out=np.full(shared.shape, np.inf), where=shared > 0)
            with np.errstate(invalid="ignore"):
                out[at : at + 64] = np.where(shared > 0, np.sqrt(total.sum(axis=2) * scale), np.inf)
        return out
