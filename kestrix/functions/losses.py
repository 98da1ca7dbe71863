"""Pointwise losses, once as Spark columns and once for numpy.

Each loss maps margin z and label y to its value and its first and second
derivatives in z.  Labels above 0.5 are positive for the logistic loss; labels
below 0.5 are negative for the smoothed hinge.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Callable

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

POSITIVE = 0.5


def softplus(z: Column) -> Column:
    """ln(1 + e^z) without overflow."""
    return F.greatest(z, F.lit(0.0)) + F.log1p(F.exp(-F.abs(z)))


def sigmoid(z: Column) -> Column:
    e = F.exp(-F.abs(z))
    return F.when(z >= 0, 1 / (1 + e)).otherwise(e / (1 + e))


def np_softplus(z: np.ndarray) -> np.ndarray:
    return np.maximum(z, 0) + np.log1p(np.exp(-np.abs(z)))


def np_sigmoid(z: np.ndarray) -> np.ndarray:
    e = np.exp(-np.abs(z))
    return np.where(z >= 0, 1 / (1 + e), e / (1 + e))


@dataclass(frozen=True)
class Loss:
    """Column and numpy forms of value, first and second derivative; second is None for a loss without one."""

    name: str
    value: Callable[[Column, Column], Column]
    first: Callable[[Column, Column], Column]
    second: Callable[[Column, Column], Column] | None
    np_value: Callable[[np.ndarray, np.ndarray], np.ndarray]
    np_first: Callable[[np.ndarray, np.ndarray], np.ndarray]
    np_second: Callable[[np.ndarray, np.ndarray], np.ndarray] | None


def _sign(y: Column) -> Column:
    return F.when(y > POSITIVE, F.lit(1.0)).otherwise(F.lit(0.0))


def _hinge_margin(z: Column, y: Column) -> Column:
    return F.when(y < POSITIVE, -z).otherwise(z)


def _np_hinge(z: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    s = np.where(y < POSITIVE, -1.0, 1.0)
    return s, s * z


LOGISTIC = Loss(
    "logistic",
    lambda z, y: F.when(y > POSITIVE, softplus(-z)).otherwise(softplus(z)),
    lambda z, y: sigmoid(z) - _sign(y),
    lambda z, y: sigmoid(z) * sigmoid(-z),
    lambda z, y: np.where(y > POSITIVE, np_softplus(-z), np_softplus(z)),
    lambda z, y: np_sigmoid(z) - (y > POSITIVE),
    lambda z, y: np_sigmoid(z) * np_sigmoid(-z),
)
SQUARED = Loss(
    "squared",
    lambda z, y: (z - y) * (z - y) / 2,
    lambda z, y: z - y,
    lambda z, y: F.lit(1.0),
    lambda z, y: (z - y) ** 2 / 2,
    lambda z, y: z - y,
    lambda z, y: np.ones_like(z),
)
POISSON = Loss(
    "poisson",
    lambda z, y: F.exp(z) - z * y,
    lambda z, y: F.exp(z) - y,
    lambda z, y: F.exp(z),
    lambda z, y: np.exp(z) - z * y,
    lambda z, y: np.exp(z) - y,
    lambda z, y: np.exp(z),
)
HINGE = Loss(
    "hinge",
    lambda z, y: (lambda m: F.when(m <= 0, 0.5 - m).when(m < 1, (1 - m) * (1 - m) / 2).otherwise(0.0))(_hinge_margin(z, y)),
    lambda z, y: F.when(y < POSITIVE, F.lit(-1.0)).otherwise(F.lit(1.0)) * (lambda m: F.when(m <= 0, -1.0).when(m < 1, m - 1).otherwise(0.0))(_hinge_margin(z, y)),
    None,
    lambda z, y: (lambda m: np.where(m <= 0, 0.5 - m, np.where(m < 1, (1 - m) ** 2 / 2, 0.0)))(_np_hinge(z, y)[1]),
    lambda z, y: (lambda s, m: s * np.where(m <= 0, -1.0, np.where(m < 1, m - 1, 0.0)))(*_np_hinge(z, y)),
    None,
)
#: Loss of each task.
TASKS = {
    "LOGISTIC_REGRESSION": LOGISTIC,
    "LINEAR_REGRESSION": SQUARED,
    "POISSON_REGRESSION": POISSON,
    "SMOOTHED_HINGE_LOSS_LINEAR_SVM": HINGE,
}


def mean(task: str, z: Column) -> Column:
    """Inverse link of a margin."""
    return {"LOGISTIC_REGRESSION": sigmoid, "POISSON_REGRESSION": F.exp}.get(task, lambda x: x)(z)


def np_mean(task: str, z: np.ndarray) -> np.ndarray:
    return {"LOGISTIC_REGRESSION": np_sigmoid, "POISSON_REGRESSION": np.exp}.get(task, lambda x: x)(z)


def classify(score: Column, threshold: float = POSITIVE) -> Column:
    """0 below the threshold, else 1."""
    return F.when(score < threshold, F.lit(0.0)).otherwise(F.lit(1.0))
