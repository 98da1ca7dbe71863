"""Evaluation metrics as aggregates and windows over (score, label, weight, groups)."""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kestrix.functions.losses import HINGE, LOGISTIC, POISSON, POSITIVE, mean

#: Decomposable metrics: sums over rows.
_SUMS = {
    "SQUARED_LOSS": lambda: F.sum(F.col("weight") * (F.col("score") - F.col("label")) * (F.col("score") - F.col("label"))),
    "RMSE": lambda: F.sqrt(F.sum(F.col("weight") * (F.col("score") - F.col("label")) * (F.col("score") - F.col("label"))) / F.count("*")),
    "LOGISTIC_LOSS": lambda: F.sum(F.col("weight") * LOGISTIC.value(F.col("score"), F.col("label"))),
    "POISSON_LOSS": lambda: F.sum(F.col("weight") * POISSON.value(F.col("score"), F.col("label"))),
    "SMOOTHED_HINGE_LOSS": lambda: F.sum(F.col("weight") * HINGE.value(F.col("score"), F.col("label"))),
}
#: The metric a task is judged by unless told otherwise.
DEFAULT = {"LOGISTIC_REGRESSION": "AUC", "SMOOTHED_HINGE_LOSS_LINEAR_SVM": "AUC", "LINEAR_REGRESSION": "RMSE", "POISSON_REGRESSION": "POISSON_LOSS"}


@dataclass(frozen=True)
class Evaluator:
    """A parsed metric name: AUC, AUPR, RMSE, ..., AUC:<tag> or PRECISION@k:<tag>."""

    name: str
    base: str
    tag: str | None = None
    k: int | None = None

    @classmethod
    def parse(cls, text: str) -> Evaluator:
        name = text.strip()
        if m := re.fullmatch(r"PRECISION@(\d+):(.+)", name, re.IGNORECASE):
            return cls(name, "PRECISION", m[2], int(m[1]))
        if m := re.fullmatch(r"AUC:(.+)", name, re.IGNORECASE):
            return cls(name, "AUC", m[1])
        base = name.upper()
        if base in ("AUC", "AUPR", *_SUMS):
            return cls(base, base)
        raise ValueError(f"no evaluator {text}")

    def better(self, a: float, b: float) -> bool:
        return a > b if self.base in ("AUC", "AUPR", "PRECISION") else a < b


#: Parts of about equal numbers of scores whose running sums are taken side by side.
BUCKETS = 64


def _curve(df: DataFrame) -> DataFrame:
    """Positive and negative rows by distinct score, with sums over all higher scores.

    The running sum goes through range buckets of the score: their totals form
    a table of a few thousand rows, and the sums inside buckets run in parallel.
    """
    positive = (F.col("label") > POSITIVE).cast("long")
    by = df.groupBy("score").agg(F.sum(positive).alias("p"), F.sum(1 - positive).alias("q"))
    # approximate quantiles: how scores spread over them changes only how evenly the work does
    splits = sorted({s for s in df.agg(F.percentile_approx("score", [i / BUCKETS for i in range(1, BUCKETS)], 1000)).first()[0] or () if not math.isnan(s)})
    by = by.withColumn("b", F.size(F.filter(F.array(*map(F.lit, splits)), lambda s: s < F.col("score"))) if splits else F.lit(0))
    down = Window.orderBy(F.col("b").desc()).rowsBetween(Window.unboundedPreceding, -1)
    totals = by.groupBy("b").agg(F.sum("p").alias("tp"), F.sum("q").alias("tq"))
    before = totals.select("b", F.coalesce(F.sum("tp").over(down), F.lit(0)).alias("bp"), F.coalesce(F.sum("tq").over(down), F.lit(0)).alias("bq"))
    inside = Window.partitionBy("b").orderBy(F.col("score").desc())
    return (
        by.withColumns({"ip": F.sum("p").over(inside), "iq": F.sum("q").over(inside)})
        .join(F.broadcast(before), "b")
        .select("score", "p", "q", (F.col("ip") + F.col("bp")).alias("cp"), (F.col("iq") + F.col("bq")).alias("cq"))
    )


def auc(df: DataFrame) -> DataFrame:
    """One row (auc): area under the ROC curve, exact, unweighted, ties one half; null with one class only."""
    c = _curve(df)
    area = F.sum(F.col("q") * (F.col("cp") - F.col("p") / 2.0))
    return c.agg(F.try_divide(area, F.sum("p").cast("double") * F.sum("q")).alias("auc"))


def aupr(df: DataFrame) -> DataFrame:
    """One row (aupr): trapezoid area under precision and recall; the curve starts at recall 0 with the first precision."""
    c = _curve(df)
    # trapezoid between a score and the one before it; the point before the first has the first's precision
    before_p, before_all = F.col("cp") - F.col("p"), F.col("cp") - F.col("p") + F.col("cq") - F.col("q")
    now = F.col("cp") / (F.col("cp") + F.col("cq"))
    last = F.when(before_all == 0, now).otherwise(F.try_divide(before_p.cast("double"), before_all))
    return c.agg(F.try_divide(F.sum(F.col("p") * (now + last) / 2.0), F.sum("p")).alias("aupr"))


def grouped_auc(df: DataFrame, tag: str) -> DataFrame:
    """(tag, auc) per group: weighted area, ties one half; null where a group has one class only."""
    w = F.col("weight")
    by = df.groupBy(tag, "score").agg(F.sum(F.when(F.col("label") > POSITIVE, w).otherwise(0.0)).alias("p"), F.sum(F.when(F.col("label") > POSITIVE, 0.0).otherwise(w)).alias("q"))
    run = by.withColumn("cp", F.sum("p").over(Window.partitionBy(tag).orderBy(F.col("score").desc())))
    return run.groupBy(tag).agg(F.try_divide(F.sum(F.col("q") * (F.col("cp") - F.col("p") / 2)), F.sum("p") * F.sum("q")).alias("auc"))


def precision_at_k(df: DataFrame, tag: str, k: int, uid: str = "uid") -> DataFrame:
    """(tag, precision): positives among the k best scores over k, whatever the group's size; ties by uid."""
    rank = F.row_number().over(Window.partitionBy(tag).orderBy(F.col("score").desc(), F.col(uid)))
    top = df.withColumn("r", rank).where(F.col("r") <= k)
    return top.groupBy(tag).agg((F.sum((F.col("label") > POSITIVE).cast("long")) / F.lit(float(k))).alias("precision"))


def group_mean(groups: DataFrame, column: str) -> DataFrame:
    """One row: mean over groups with a value; 0 if none has."""
    return groups.agg(F.coalesce(F.avg(column), F.lit(0.0)).alias(column))


def evaluate(df: DataFrame, names: list[str], uid: str = "uid") -> dict[str, float]:
    """Values of several evaluators; all decomposable ones in one pass.  The first name is the primary one."""
    if len({n.upper() for n in names}) != len(names):
        raise ValueError("an evaluator is named twice")
    parsed = [Evaluator.parse(n) for n in names]
    sums = [e for e in parsed if e.base in _SUMS]
    out = df.agg(*(_SUMS[e.base]().alias(e.name) for e in sums)).first().asDict() if sums else {}
    for e in parsed:
        if e.base in _SUMS:
            continue
        if e.tag is None:
            out[e.name] = {"AUC": auc, "AUPR": aupr}[e.base](df).first()[0]
        else:
            out[e.name] = group_mean(*per_group(df, e, uid)).first()[0]
    return {e.name: (float("nan") if out[e.name] is None else float(out[e.name])) for e in parsed}


def per_group(df: DataFrame, e: Evaluator, uid: str = "uid") -> tuple[DataFrame, str]:
    """The (group, value) table of a grouped evaluator and its value column."""
    return (grouped_auc(df, e.tag), "auc") if e.base == "AUC" else (precision_at_k(df, e.tag, e.k, uid), "precision")


def lgamma_plus_one(n: Column) -> Column:
    """ln n! of a non-negative number by Stirling's series after a shift by eight."""
    shifted = n + 9.0
    product = F.aggregate(F.sequence(F.lit(1), F.lit(8)), F.lit(0.0), lambda a, i: a + F.ln(n + i.cast("double")))
    tail = 1 / (12 * shifted) - 1 / (360 * F.pow(shifted, F.lit(3.0))) + 1 / (1260 * F.pow(shifted, F.lit(5.0))) - 1 / (1680 * F.pow(shifted, F.lit(7.0)))
    return (shifted - 0.5) * F.ln(shifted) - shifted + 0.5 * math.log(2 * math.pi) + tail - product


def regression_metrics(df: DataFrame) -> DataFrame:
    """One row: mae, mse, rmse of predictions in ``score``, unweighted."""
    e = F.col("score") - F.col("label")
    mse = F.avg(e * e)
    return df.agg(F.avg(F.abs(e)).alias("mae"), mse.alias("mse"), F.sqrt(mse).alias("rmse"))


def peak_f1(df: DataFrame) -> DataFrame:
    """One row: the largest F1 over thresholds at every distinct score."""
    c = _curve(df)
    total = c.agg(F.sum("p").alias("t"))
    f1 = 2.0 * F.col("cp") / (F.col("t") + F.col("cp") + F.col("cq"))
    return c.crossJoin(F.broadcast(total)).agg(F.max(f1).alias("peak_f1"))


def log_likelihood(df: DataFrame, task: str) -> DataFrame:
    """One row (log_likelihood): mean over rows of the log-likelihood at margins in ``score``."""
    z, y = F.col("score"), F.col("label")
    row = -LOGISTIC.value(z, y) if task == "LOGISTIC_REGRESSION" else -POISSON.value(z, y) - lgamma_plus_one(y)
    return df.agg(F.avg(row).alias("log_likelihood"))


def aic(log_likelihood_sum: float, parameters: int, rows: int) -> float:
    """Akaike's criterion with the small-sample correction."""
    base = 2 * (parameters - log_likelihood_sum)
    return base + 2 * parameters * (parameters + 1) / (rows - parameters - 1)


def legacy_metrics(df: DataFrame, task: str, parameters: int | None = None) -> dict[str, float]:
    """Metrics of the single-model driver, on means and not on margins; df has margins in ``score``."""
    means = df.withColumn("score", mean(task, F.col("score")))
    out = regression_metrics(means).first().asDict()
    if task in ("LOGISTIC_REGRESSION", "SMOOTHED_HINGE_LOSS_LINEAR_SVM"):
        out |= auc(means).first().asDict() | aupr(means).first().asDict() | peak_f1(means).first().asDict()
    if task in ("LOGISTIC_REGRESSION", "POISSON_REGRESSION"):
        out["log_likelihood"] = log_likelihood(df, task).first()[0]
        if parameters is not None:
            n = df.count()
            out["aic"] = aic(out["log_likelihood"] * n, parameters, n)
    return out


def legacy_best(task: str, measured: list[tuple]) -> tuple:
    """The (weight, model, metrics) with the best metric of its task; the first of equal ones."""
    key, sign = {"LINEAR_REGRESSION": ("rmse", -1), "POISSON_REGRESSION": ("log_likelihood", 1)}.get(task, ("auc", 1))
    return max(measured, key=lambda r: sign * r[2][key])
