"""Pivot distance tables over 64-bit fingerprints.

For any pivot p, |d(x, p) - d(y, p)| <= d(x, y). The distances of a fingerprint
to all pivots are computed once and travel with it, a byte each. A pair whose
distances to some pivot differ by more than allowed is discarded without looking
at the fingerprints; what every coordinate lets pass is verified bit by bit.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

PIVOTS = 16


def pivots(count: int = PIVOTS, seed: int = 11) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 1 << 64, count, dtype=np.uint64)


def distances(prints: np.ndarray, references: np.ndarray) -> np.ndarray:
    """A row of distances for each print."""
    return np.bitwise_count(prints[:, None] ^ references[None, :]).astype(np.int8)


def as_column(table: np.ndarray) -> pa.Array:
    """The rows of `distances` as binary values."""
    return pa.array([r.tobytes() for r in table], pa.binary())


def from_column(column: pa.Array | pa.ChunkedArray, count: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.int8).reshape(-1, count)


class PivotTable:
    """Fingerprints with their pivot distances, and the search over them."""

    def __init__(self, prints: np.ndarray, table: np.ndarray):
        self.prints, self.table = prints, table
        self.met = self.passed = 0

    def linked(self, at: int, others: np.ndarray, distance: int) -> np.ndarray:
        """Those of `others` within `distance` of print `at`."""
        self.met += len(others)
        for start in range(0, self.table.shape[1], 8):
            if not len(others):
                return others
            apart = np.abs(self.table[others, start : start + 8] - self.table[at, start : start + 8]).max(axis=1)
            others = others[apart <= distance]
        self.passed += len(others)
        return others[np.bitwise_count(self.prints[others] ^ self.prints[at]) <= distance]


def pass_all(a: Column, b: Column, distance: int, count: int = PIVOTS) -> Column:
    """Whether no coordinate of two tables (arrays of numbers) differs by more than `distance`."""
    worst = F.lit(0)
    for i in range(count):
        worst = F.greatest(worst, F.abs(a[i] - b[i]))
    return worst <= distance
