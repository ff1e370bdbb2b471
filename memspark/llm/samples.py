"""Bounded samples of labelled rows, and small logistic fits of what is gathered from them."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo the folds."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds


def first_by_hash(ids: DataFrame, most: int, seed: int) -> DataFrame:
    """At most ``most`` rows, those with the lowest hash of ``doc_id``: the same ones however the table is split."""
    return ids.orderBy(F.xxhash64("doc_id", F.lit(seed)), "doc_id").limit(most)


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def adam(gradient, size: int, steps: int = 600, rate: float = 0.05) -> np.ndarray:
    """The weights after so many full steps from zero."""
    w, m, v = np.zeros(size), np.zeros(size), np.zeros(size)
    for t in range(1, steps + 1):
        g = gradient(w)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-9)
    return w
