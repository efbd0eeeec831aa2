"""Folds by checksum of the id, and bounded samples of labelled rows."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold(id_col: str, n: int) -> Column:
    """crc32 of the id as text, modulo n; null for a null id."""
    return F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(n))


def sample(rows: DataFrame, id_col: str, n: int) -> DataFrame:
    """The n rows with the smallest hash of the id: the same ones whatever the order or partitioning of the table."""
    return rows.orderBy(F.xxhash64(F.col(id_col)), id_col).limit(n)


def fit_logistic(x: np.ndarray, y: np.ndarray, w: np.ndarray, ridge: float = 1e-2, steps: int = 60) -> np.ndarray:
    """Weights, intercept last, of a logistic regression by Newton steps; w weighs the rows."""
    a = np.column_stack([x, np.ones(len(x))])
    beta = np.zeros(a.shape[1])
    penalty = np.full(a.shape[1], ridge)
    penalty[-1] = 1e-6
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a @ beta, -30, 30)))
        gradient = a.T @ (w * (p - y)) + penalty * beta
        hessian = (a * (w * p * (1 - p))[:, None]).T @ a + np.diag(penalty + 1e-9)
        step = np.linalg.solve(hessian, gradient)
        step *= min(1.0, 5.0 / (np.abs(step).max() + 1e-12))
        beta -= step
        if np.abs(step).max() < 1e-6:
            break
    return beta
