"""Rows of training data: defaults, id tags, validation, sampling, and per-entity active and passive rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kestrix.functions.features import EPSILON

DEFAULT_OFFSET, DEFAULT_WEIGHT = 0.0, 1.0
RESERVED = ("uid", "response", "offset", "weight", "metadataMap")


def examples(df: DataFrame, features: str | tuple[str, ...], tags: tuple[str, ...] = (), response_required: bool = True, names: dict[str, str] | None = None) -> DataFrame:
    """uid, label, offset, weight, features (or each of several vectors by its own name) and one string column per id tag.

    Absent or null offsets are 0 and weights 1; without a response the label is
    NaN unless it is required.  A tag is a column, else an entry of the
    metadata map, else an error.
    """
    n = {x: x for x in RESERVED} | (names or {})
    if bad := set(tags) & set(n.values()):
        raise ValueError(f"reserved columns can't be id tags: {sorted(bad)}")
    has = set(df.columns)
    if response_required and n["response"] not in has:
        raise ValueError(f"no column {n['response']}")
    number = lambda c, default: F.coalesce(F.col(c).cast("double"), F.lit(default)) if c in has else F.lit(default)
    return df.select(
        F.col(n["uid"]), number(n["response"], float("nan")).alias("label"), number(n["offset"], DEFAULT_OFFSET).alias("offset"),
        number(n["weight"], DEFAULT_WEIGHT).alias("weight"), *([F.col(features).alias("features")] if isinstance(features, str) else map(F.col, features)), *(id_tag(df, t, n["metadataMap"]).alias(t) for t in tags),
    )


def id_tag(df: DataFrame, tag: str, metadata: str = "metadataMap") -> Column:
    if tag in df.columns:
        own = F.col(tag).cast("string")
        return F.coalesce(own, F.try_element_at(F.col(metadata), F.lit(tag))) if metadata in df.columns else own
    if metadata in df.columns:
        return F.try_element_at(F.col(metadata), F.lit(tag))
    raise ValueError(f"id tag {tag} is neither a column nor in {metadata}")


def finite(c: Column) -> Column:
    return F.coalesce(~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < float("inf")), F.lit(False))


def valid_weight(c: Column) -> Column:
    return finite(c) & (c > EPSILON)


def binary_label(c: Column) -> Column:
    return F.coalesce(c.isin(0.0, 1.0), F.lit(False))


def non_negative_label(c: Column) -> Column:
    return finite(c) & (c >= 0)


def finite_features(c: Column) -> Column:
    return F.coalesce(F.forall(c, lambda x: finite(x["val"])), F.lit(False))


_LABELS = {
    "LINEAR_REGRESSION": finite, "LOGISTIC_REGRESSION": binary_label,
    "SMOOTHED_HINGE_LOSS_LINEAR_SVM": binary_label, "POISSON_REGRESSION": non_negative_label,
}


def violations(df: DataFrame, task: str, label: str = "label", features: tuple[str, ...] = ("features",)) -> DataFrame:
    """One row: how many rows break each rule of a task; columns that are absent break none."""
    rules = {f"{label}_invalid": (label, _LABELS[task]), "offset_invalid": ("offset", finite), "weight_invalid": ("weight", valid_weight)}
    rules |= {f"{f}_invalid": (f, finite_features) for f in features}
    return df.agg(*(F.coalesce(F.sum((~rule(F.col(c))).cast("long")), F.lit(0)).alias(name) for name, (c, rule) in rules.items() if c in df.columns))


def validate(df: DataFrame, task: str, mode: str = "FULL", **columns) -> None:
    """Raise ValueError that lists all broken rules; mode FULL, SAMPLE (a tenth of the rows) or DISABLED."""
    if mode == "DISABLED":
        return
    checked = df.sample(False, 0.1, 1234567890) if mode == "SAMPLE" else df
    if broken := {k: v for k, v in violations(checked, task, **columns).first().asDict().items() if v}:
        raise ValueError("; ".join(f"{v} rows with {k}" for k, v in broken.items()))


def down_sample(df: DataFrame, rate: float, task: str, seed: int = 1234567890, key: Column | None = None) -> DataFrame:
    """Rows of a Bernoulli sample; binary tasks keep every positive row and reweight negatives by 1 / rate.

    With key, a column that tells rows apart, the draw hangs on the row alone
    and not on how data is partitioned.
    """
    if not 0 < rate < 1:
        raise ValueError("the rate must lie between 0 and 1")
    draw = F.rand(seed) if key is None else hash_unit(key, seed)
    if task in ("LOGISTIC_REGRESSION", "SMOOTHED_HINGE_LOSS_LINEAR_SVM"):
        positive = F.col("label") >= 0.5
        drawn = df.withColumn("__draw", draw).where(positive | (F.col("__draw") < rate)).drop("__draw")
        return drawn.withColumn("weight", F.when(positive, F.col("weight")).otherwise(F.col("weight") / rate))
    return df.where(draw < rate) if key is not None else df.sample(False, rate, seed)


def hash_unit(key: Column, seed: int = 0) -> Column:
    """A number in [0, 1) from the first 13 hex digits of md5; any engine can compute it."""
    digits = F.substring(F.md5(F.concat(F.lit(f"{seed}#"), key.cast("string")).cast("binary")), 1, 13)
    return F.conv(digits, 16, 10).cast("double") / float(1 << 52)


def active_passive(df: DataFrame, entity: str, kind: str = "", cap: int | None = None, bound: int | None = None, existing: DataFrame | None = None, uid: str = "uid") -> DataFrame:
    """df with count, active and weight for a random effect.

    Rows of an entity beyond cap, those of the smaller md5 keys, are passive
    and the active ones weigh count / cap as much; entities of fewer than bound
    rows vanish, unless existing (a column of that name) lacks them.  A window
    over (entity) reads each row once and spills; nothing is collected.
    """
    w = Window.partitionBy(entity)
    out = df.withColumn("count", F.count("*").over(w))
    if bound is not None:
        keep = F.col("count") >= bound
        if existing is not None:
            marked = existing.select(F.col(entity).alias("__known")).distinct()
            out = out.join(marked, F.col(entity) == F.col("__known"), "left")
            keep = keep | F.col("__known").isNull()
        out = out.where(keep).drop("__known")
    if cap is None:
        return out.withColumn("active", F.lit(True))
    digest = F.md5(F.concat(F.lit(f"{kind}#"), F.col(uid).cast("string")).cast("binary"))
    rank = F.row_number().over(w.orderBy(digest.desc(), F.col(uid)))
    out = out.withColumn("active", rank <= cap)
    more = F.when(F.col("count") > cap, F.col("count") / F.lit(cap)).otherwise(1.0)
    return out.withColumn("weight", F.when(F.col("active"), F.col("weight") * more).otherwise(F.col("weight")))


def feature_scores(df: DataFrame, entity: str, features: str = "features", label: str = "label") -> DataFrame:
    """(entity, idx, n, correlation): Pearson correlation of each feature with the label per entity, zeros included.

    A feature that is 1 in every row of its entity has correlation 1 if it is
    the first such, other constant features 0.  Sums of stored entries and of
    labels are enough, so only they are shuffled.
    """
    # labels are centred per entity first, which keeps the sums well conditioned
    w = Window.partitionBy(entity)
    base = df.select(entity, F.col(label).alias("y"), features).withColumn("d", F.col("y") - F.avg("y").over(w))
    totals = base.groupBy(entity).agg(F.count("*").alias("n"), F.sum(F.col("d") * F.col("d")).alias("syy"))
    long = base.select(entity, "d", F.explode(features).alias("x")).select(entity, "d", F.col("x.idx").alias("idx"), F.col("x.val").alias("v"))
    sums = long.groupBy(entity, "idx").agg(
        F.sum("v").alias("sx"), F.sum(F.col("v") * F.col("v")).alias("sxx"), F.sum(F.col("v") * F.col("d")).alias("sxy"), F.count("*").alias("k"), F.min("v").alias("mn"), F.max("v").alias("mx")
    )
    j = sums.join(totals, entity)
    sxx = F.col("sxx") - F.col("sx") * F.col("sx") / F.col("n")
    constant = (F.col("k") == F.col("n")) & (F.col("mn") == F.col("mx"))
    one = constant & (F.col("mn") == 1)
    first = F.row_number().over(Window.partitionBy(entity, one).orderBy("idx")) == 1
    corr = F.when(one & first, 1.0).when(constant | (sxx <= EPSILON) | (F.col("syy") <= EPSILON), 0.0).otherwise(F.col("sxy") / F.sqrt(sxx * F.col("syy")))
    return j.select(entity, "idx", "n", corr.alias("correlation"))


def select_features(scores: DataFrame, entity: str, ratio: float) -> DataFrame:
    """(entity, idx) of the ceil(ratio * rows) features of largest absolute correlation, all if there are fewer."""
    rank = F.row_number().over(Window.partitionBy(entity).orderBy(F.abs("correlation").desc(), "idx"))
    return scores.withColumn("rank", rank).where(F.col("rank") <= F.ceil(F.lit(ratio) * F.col("n"))).select(entity, "idx")


def fixed_summary(df: DataFrame, features: str = "features") -> DataFrame:
    """One row: rows, weight_sum, label_sum, and mean, population deviation, least and most of the features stored in a row."""
    n = F.size(features).cast("double")
    return df.agg(
        F.count("*").alias("rows"), F.sum("weight").alias("weight_sum"), F.sum("label").alias("label_sum"),
        F.avg(n).alias("mean_features"), F.stddev_pop(n).alias("stddev_features"), F.min(n).alias("min_features"), F.max(n).alias("max_features"),
    )


def entity_counts(df: DataFrame, entity: str) -> DataFrame:
    """(entity, n): rows of each entity."""
    return df.groupBy(entity).agg(F.count("*").alias("n"))


def random_summary(rows: DataFrame, entity: str) -> DataFrame:
    """One row of active_passive's result: active and passive rows, sums over active ones, and active rows by entity."""
    per = rows.groupBy(entity).agg(
        F.sum(F.col("active").cast("long")).alias("a"), F.sum((~F.col("active")).cast("long")).alias("p"),
        F.sum(F.when(F.col("active"), F.col("weight"))).alias("w"), F.sum(F.when(F.col("active"), F.col("label"))).alias("y"),
    )
    return per.agg(
        F.sum("a").alias("active"), F.sum("p").alias("passive"), F.count("*").alias("entities"), F.sum("w").alias("weight_sum"), F.sum("y").alias("label_sum"),
        F.avg("a").alias("mean_active"), F.stddev_pop("a").alias("stddev_active"), F.min("a").alias("min_active"), F.max("a").alias("max_active"),
    )


def feature_sets(df: DataFrame, entity: str, features: str = "features") -> DataFrame:
    """(entity, idx): features with a nonzero value in some row of the entity."""
    return df.select(entity, F.explode(F.filter(features, lambda x: x["val"] != 0)).alias("x")).select(entity, F.col("x.idx").alias("idx")).distinct()


def id_map(rows: DataFrame, entity: str, uid: str = "uid") -> DataFrame:
    """(uid, entity) of active rows."""
    return rows.where("active").select(uid, F.col(entity).cast("string").alias(entity))


def sampler(task: str, rate: float, seed: int = 1234567890, key: Column | None = None):
    """The down-sampler of a task: negatives only for binary ones, else all rows; a rate of 1 samples nothing."""
    if rate == 1:
        return lambda df: df
    return lambda df: down_sample(df, rate, task, seed, key)


def kept_features(vector: Column, kept: Column) -> Column:
    """A sparse vector without the features that an array of indices lacks."""
    return F.filter(vector, lambda x: F.array_contains(kept, x["idx"]))
