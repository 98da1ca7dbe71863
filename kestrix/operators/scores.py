"""Arithmetic and comparison of score tables, and labels with the scores that belong to them.

A score table has uid and score.  Scored data have label, offset and weight
beside them; what one side lacks comes from the other.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

META = ("label", "offset", "weight")


def _combined(a: DataFrame, b: DataFrame, sign: int, meta: tuple[str, ...]) -> DataFrame:
    left, right = (d.select(F.col("uid"), *(F.col(c).alias(f"__{c}{i}") for c in ("score", *meta))) for i, d in enumerate((a, b)))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    joined = left.join(right, "uid", "full")
    return joined.select("uid", (zero("__score0") + sign * zero("__score1")).alias("score"), *(F.coalesce(f"__{c}0", f"__{c}1").alias(c) for c in meta))


def plus(a: DataFrame, b: DataFrame, meta: tuple[str, ...] = ()) -> DataFrame:
    """Sum by uid; a score that one side lacks is 0.  meta names columns to keep, from the side that has them."""
    return _combined(a, b, 1, meta)


def minus(a: DataFrame, b: DataFrame, meta: tuple[str, ...] = ()) -> DataFrame:
    """Difference by uid; see plus."""
    return _combined(a, b, -1, meta)


def differences(a: DataFrame, b: DataFrame, tolerance: float = 1e-12) -> DataFrame:
    """One row (rows, unequal): uids of either table, and those that one lacks or whose scores are further apart; NaN equals NaN."""
    x, y = a.select("uid", F.col("score").alias("x"), F.lit(1).alias("in_x")), b.select("uid", F.col("score").alias("y"), F.lit(1).alias("in_y"))
    j = x.join(y, "uid", "full")
    same = F.coalesce((F.isnan("x") & F.isnan("y")) | (F.abs(F.col("x") - F.col("y")) <= tolerance) | F.col("x").eqNullSafe(F.col("y")), F.lit(False)) & F.col("in_x").isNotNull() & F.col("in_y").isNotNull()
    return j.agg(F.count("*").alias("rows"), F.coalesce(F.sum((~same).cast("long")), F.lit(0)).alias("unequal"))


def equal(a: DataFrame, b: DataFrame, tolerance: float = 1e-12) -> bool:
    return differences(a, b, tolerance).first()["unequal"] == 0


def coefficients_differ(a: DataFrame, b: DataFrame, entity: str, tolerance: float = 1e-12) -> DataFrame:
    """The same for tables of entity models (entity, coefficients): (entity, idx) pairs and how many means differ."""
    long = lambda d: d.select(entity, F.explode("coefficients").alias("c")).select(F.struct(F.col(entity).cast("string").alias("e"), F.col("c.idx").alias("i")).alias("uid"), F.col("c.mean").alias("score"))
    return differences(long(a), long(b), tolerance)


def with_scores(labels: DataFrame, scores: DataFrame) -> DataFrame:
    """labels (uid, label, offset, weight, ..) with score: that of its uid, 0 if there is none, plus the offset."""
    s = scores.select(F.col("uid").alias("__uid"), F.col("score").alias("__score"))
    joined = labels.drop("score").join(s, F.col("uid") == F.col("__uid"), "left")
    return joined.withColumn("score", F.coalesce("__score", F.lit(0.0)) + F.coalesce("offset", F.lit(0.0))).drop("__uid", "__score")
