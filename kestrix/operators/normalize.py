"""Feature statistics and normalization contexts."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NONE, SCALE_MAX, SCALE_STD, STANDARDIZATION = "NONE", "SCALE_WITH_MAX_MAGNITUDE", "SCALE_WITH_STANDARD_DEVIATION", "STANDARDIZATION"


def statistics(df: DataFrame, features: str = "features") -> DataFrame:
    """One row per feature index: count, mean, variance, nnz, max, min, norm_l1, norm_l2, mean_abs.

    Absent entries count as zeros, so only stored entries are shuffled: their
    sums, and the number of rows, give everything.  A sample variance that is
    not finite or not positive becomes 1.
    """
    total = df.agg(F.count("*").alias("count"))
    long = df.select(F.explode(features).alias("x")).select(F.col("x.idx").alias("idx"), F.col("x.val").alias("v"))
    sums = long.groupBy("idx").agg(
        F.count("*").alias("stored"), F.sum("v").alias("s1"), F.var_samp("v").alias("var"), F.avg("v").alias("avg"),
        F.sum((F.col("v") != 0).cast("long")).alias("nnz"), F.max("v").alias("mx"), F.min("v").alias("mn"),
        F.sum(F.abs("v")).alias("norm_l1"), F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("norm_l2"),
    )
    return _finish(sums.crossJoin(F.broadcast(total)))


def _finish(d: DataFrame) -> DataFrame:
    n, k = F.col("count"), F.col("stored")
    some_zero = k < n
    mean = F.col("s1") / n
    # two groups, the stored values and n - k zeros: pooled sum of squares over n - 1
    inner = F.coalesce(F.col("var"), F.lit(0.0)) * (k - 1) + F.col("avg") * F.col("avg") * k * (n - k) / n
    var = F.try_divide(inner, n - 1)
    return d.select(
        "idx", "count", mean.alias("mean"), F.when(var.isNotNull() & ~F.isnan(var) & (var > 0) & (var < float("inf")), var).otherwise(1.0).alias("variance"), "nnz",
        F.when(some_zero, F.greatest("mx", F.lit(0.0))).otherwise(F.col("mx")).alias("max"), F.when(some_zero, F.least("mn", F.lit(0.0))).otherwise(F.col("mn")).alias("min"),
        "norm_l1", "norm_l2", (F.col("norm_l1") / n).alias("mean_abs"),
    )


def factor(kind: str, variance: Column, maximum: Column, minimum: Column) -> Column:
    """Scale of a feature; a zero scale becomes 1."""
    if kind == NONE:
        return F.lit(1.0)
    size = F.greatest(F.abs(maximum), F.abs(minimum)) if kind == SCALE_MAX else F.sqrt(variance)
    return F.when(size == 0, 1.0).otherwise(1 / size)


@dataclass(frozen=True)
class Normalization:
    """x' = (x - shift) * factor, never applied to data; either may be None."""

    factors: np.ndarray | None = None
    shifts: np.ndarray | None = None
    intercept: int | None = None

    @classmethod
    def build(cls, kind: str, stats: DataFrame, size: int, intercept: int | None = None) -> Normalization:
        """From statistics; standardization needs an intercept, which is left alone."""
        if kind == NONE:
            return cls()
        if kind == STANDARDIZATION and intercept is None:
            raise ValueError("standardization needs an intercept")
        rows = stats.select("idx", factor(kind, F.col("variance"), F.col("max"), F.col("min")).alias("f"), "mean").toPandas()
        factors, shifts = np.ones(size), np.zeros(size)
        factors[rows["idx"]], shifts[rows["idx"]] = rows["f"], rows["mean"]
        if intercept is not None:
            factors[intercept], shifts[intercept] = 1.0, 0.0
        return cls(factors, shifts if kind == STANDARDIZATION else None, intercept)

    def effective(self, b: np.ndarray) -> tuple[np.ndarray, float]:
        """Coefficients of the raw data and the constant that belongs to them."""
        e = b if self.factors is None else b * self.factors
        return e, 0.0 if self.shifts is None else -float(e @ self.shifts)

    def pull(self, g: np.ndarray, total: float) -> np.ndarray:
        """Gradient in transformed space from raw sums of d * x and of d."""
        if self.shifts is not None:
            g = g - self.shifts * total
        return g if self.factors is None else g * self.factors

    def to_original(self, b: np.ndarray) -> np.ndarray:
        out = b.copy() if self.factors is None else b * self.factors
        if self.shifts is not None:
            out[self.intercept] -= out @ self.shifts
        return out

    def to_transformed(self, b: np.ndarray) -> np.ndarray:
        out = b.copy()
        if self.shifts is not None:
            out[self.intercept] += out @ self.shifts
        return out if self.factors is None else out / self.factors

    def variances_to_transformed(self, v: np.ndarray) -> np.ndarray:
        return v.copy() if self.factors is None else v / self.factors**2

    def project(self, kept: np.ndarray) -> Normalization:
        """The context of a subspace given by its global indices."""
        where = np.flatnonzero(kept == self.intercept) if self.intercept is not None else []
        return Normalization(
            None if self.factors is None else self.factors[kept], None if self.shifts is None else self.shifts[kept], int(where[0]) if len(where) else None
        )
