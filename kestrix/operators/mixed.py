"""Mixed-effect models: coordinates, coordinate descent, estimator and transformer.

Data stay one DataFrame, with one score column per coordinate.  A coordinate
sees the other coordinates' scores as part of its offset, so residuals are an
expression and not a join.
"""

from __future__ import annotations

import gc
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field, replace
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kestrix.functions import optim_many
from kestrix.functions.losses import TASKS, mean
from kestrix.functions.optim import Result, minimise

from . import dataset, evaluate
from .config import Coordinate
from .normalize import Normalization
from .objective import Distributed, Local, Many, Penalty, Sparse, inverse_diagonal, packed, variances

COEFFICIENTS = "array<struct<idx:int,mean:double,variance:double>>"
#: Rows of an entity beyond which it is trained over the cluster and not in one task.
HOT_ROWS = 500_000


#: Rows whose entities are trained side by side.
TOGETHER = 1 << 16


def _starts(entity: pa.ChunkedArray) -> np.ndarray:
    """Where the entities of ordered rows begin."""
    codes = entity.combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy()
    return np.flatnonzero(np.append(True, codes[1:] != codes[:-1]))


@dataclass
class FixedModel:
    """Coefficients shared by all rows."""

    shard: str
    means: np.ndarray
    variances: np.ndarray | None = None

    def score(self, df: DataFrame) -> Column:
        b = self.means

        def dot(v: pa.Array) -> pa.Array:
            x = Sparse.from_arrow(v)
            known = x.col < len(b)
            return pa.array(np.bincount(x.row[known], x.val[known] * b[x.col[known]], x.n))

        return F.arrow_udf(dot, "double")(F.col(self.shard))


@dataclass
class RandomModel:
    """Coefficients by entity: table has the entity and ``coefficients``, in the shard's index space."""

    shard: str
    entity: str
    table: DataFrame

    def scored(self, df: DataFrame, name: str) -> DataFrame:
        """df with the score; 0 for entities without a model."""

        def dot(v: pa.Array, c: pa.Array) -> pa.Array:
            x, m = Sparse.from_arrow(v), Sparse.from_arrow(c)
            have, want = m.row << 32 | m.col, x.row << 32 | x.col
            order = np.argsort(have)
            have = have[order]
            at = np.minimum(np.searchsorted(have, want), max(len(have) - 1, 0))
            hit = have[at] == want if len(have) else np.zeros(len(want), bool)
            return pa.array(np.bincount(x.row[hit], x.val[hit] * m.val[order[at[hit]]], x.n) if hit.any() else np.zeros(x.n))

        models = self.table.select(F.col(self.entity).alias("__entity"), "coefficients")
        joined = df.join(models, F.col(self.entity) == F.col("__entity"), "left")
        return joined.withColumn(name, F.coalesce(F.arrow_udf(dot, "double")(F.col(self.shard), F.col("coefficients")), F.lit(0.0))).drop("__entity", "coefficients")

    def summary(self) -> DataFrame:
        """Number of entities, and mean and largest length and L2 norm of their coefficients."""
        norm = F.sqrt(F.aggregate("coefficients", F.lit(0.0), lambda a, x: a + x["mean"] * x["mean"]))
        size = F.size("coefficients")
        return self.table.agg(F.count("*").alias("entities"), F.avg(size).alias("mean_length"), F.max(size).alias("max_length"), F.avg(norm).alias("mean_norm"), F.max(norm).alias("max_norm"))


@dataclass
class MixedModel:
    """Sub-models by coordinate; scores add up."""

    task: str
    models: dict[str, FixedModel | RandomModel] = field(default_factory=dict)

    def score(self, df: DataFrame, name: str = "score") -> DataFrame:
        """df with the raw margin: sub-models' scores plus the row's offset, if it has one."""
        out, columns = df, []
        for i, m in enumerate(self.models.values()):
            columns.append(f"__score_{i}")
            out = out.withColumn(columns[-1], m.score(out)) if isinstance(m, FixedModel) else m.scored(out, columns[-1])
        total = reduce(lambda a, b: a + b, (F.coalesce(F.col(c), F.lit(0.0)) for c in columns), F.lit(0.0))
        if "offset" in df.columns:
            total = total + F.coalesce(F.col("offset"), F.lit(0.0))
        return out.withColumn(name, total).drop(*columns)

    def predict(self, df: DataFrame, name: str = "prediction") -> DataFrame:
        return self.score(df, "__margin").withColumn(name, mean(self.task, F.col("__margin"))).drop("__margin")


def _size(df: DataFrame, shard: str) -> int:
    top = df.agg(F.max(F.array_max(F.transform(shard, lambda x: x["idx"])))).first()[0]
    return 0 if top is None else int(top) + 1


@dataclass
class FixedCoordinate:
    """A global model over all rows."""

    config: Coordinate
    task: str
    size: int
    norm: Normalization = Normalization()
    intercept: int | None = None
    variance: str = "NONE"
    result: Result | None = None
    keep_path: bool = False

    def blocks(self, df: DataFrame, offset: Column) -> DataFrame:
        """The packed rows that a training reads again and again; the caller gives them back."""
        c = self.config
        data = df.select("label", offset.alias("offset"), "weight", F.col(c.shard).alias("features"))
        if c.down_sampling_rate < 1:
            data = dataset.down_sample(data, c.down_sampling_rate, self.task)
        return packed(data).persist()

    def train(self, df: DataFrame, offset: Column, before: FixedModel | None = None, prior: FixedModel | None = None, blocks: DataFrame | None = None) -> FixedModel:
        c, loss = self.config, TASKS[self.task]
        data = self.blocks(df, offset) if blocks is None else blocks
        penalty = _penalty(c, self.intercept, self.norm, prior and (prior.means, prior.variances))
        objective = Distributed(loss, data, self.size, penalty, self.norm if loss.np_second else Normalization())
        objective.keep_path = self.keep_path
        start = np.zeros(self.size) if before is None else self.norm.to_transformed(_resized(before.means, self.size))
        self.result = minimise(objective, start, c.optimizer, c.l1, c.tolerance, c.max_iterations, c.bounds)
        self.result.path = [objective.norm.to_original(b) for b in self.result.path]
        means = objective.norm.to_original(self.result.coefficients)
        if not np.isfinite(means).all():
            raise ArithmeticError(f"coefficients {np.flatnonzero(~np.isfinite(means)).tolist()} are not finite")
        found = FixedModel(c.shard, means, variances(objective, means, self.variance))
        if blocks is None:
            data.unpersist()
        return found


def _resized(v: np.ndarray, n: int) -> np.ndarray:
    return np.concatenate([v, np.zeros(n - len(v))]) if len(v) < n else v[:n]


def _penalty(c: Coordinate, intercept: int | None, norm: Normalization, prior) -> Penalty:
    if prior is None:
        return Penalty(c.l2, intercept)
    means, var = prior
    if var is None:
        raise ValueError("incremental training needs a model with variances")
    return Penalty(c.l2, intercept, (norm.to_transformed(means), norm.variances_to_transformed(var)), 1.0 if c.incremental_weight is None else c.incremental_weight)


@dataclass
class RandomCoordinate:
    """A model for each entity, trained where its rows are."""

    config: Coordinate
    task: str
    norm: Normalization = Normalization()
    intercept: int | None = None
    variance: str = "NONE"
    trackers: DataFrame | None = None

    def rows(self, df: DataFrame, existing: DataFrame | None = None) -> DataFrame:
        """Active and passive rows with their weights; see dataset.active_passive."""
        c = self.config
        out = dataset.active_passive(df, c.entity, c.entity, c.cap, c.bound, existing)
        if c.features_ratio is None:
            return out.withColumn("__kept", F.col(c.shard))
        kept = dataset.select_features(dataset.feature_scores(out.where("active"), c.entity, c.shard), c.entity, c.features_ratio)
        sets = kept.groupBy(c.entity).agg(F.collect_set("idx").alias("__set")).withColumnRenamed(c.entity, "__set_entity")
        joined = out.join(sets, F.col(c.entity) == F.col("__set_entity"), "left")
        return joined.withColumn("__kept", dataset.kept_features(F.col(c.shard), F.col("__set"))).drop("__set", "__set_entity")

    def train(self, df: DataFrame, offset: Column, before: RandomModel | None = None, prior: RandomModel | None = None) -> RandomModel:
        """Models of entities with active rows; entities that only an earlier model has keep theirs."""
        c = self.config
        active = df.where("active").select(F.col(c.entity).cast("string").alias("entity"), "uid", "label", offset.alias("offset"), "weight", F.col("__kept").alias("features"))
        solver = _Solver(c, self.task, self.norm, self.intercept, self.variance, prior is not None)
        none = active.sparkSession.createDataFrame([], f"entity string, coefficients {COEFFICIENTS}")
        old = prior or before
        models = none if old is None else old.table.select(F.col(old.entity).cast("string").alias("entity"), "coefficients")
        schema = f"entity string, coefficients {COEFFICIENTS}, reason string, iterations int"
        # there is one of these for each HOT_ROWS rows at most; each takes its own jobs
        few = c.cap is not None and c.cap <= HOT_ROWS
        hot = [] if few else sorted(r[0] for r in active.groupBy("entity").count().where((F.col("count") > HOT_ROWS) & F.col("entity").isNotNull()).collect())
        is_cold = ~F.coalesce(F.col("entity").isin(hot), F.lit(False))
        cold, cold_models = (active.where(is_cold), models.where(is_cold)) if hot else (active, models)
        trained = _by_entity(cold, None if old is None else cold_models).mapInArrow(solver.stream, schema)
        for e in hot:
            rows = models.where(F.col("entity") == e).collect()
            trained = trained.unionByName(active.sparkSession.createDataFrame([solver.spread(e, active.where(F.col("entity") == e), rows[0]["coefficients"] if rows else [])], schema))
        trained = trained.checkpoint() if active.sparkSession.sparkContext.getCheckpointDir() else trained.persist()
        self.trackers = trained.where("reason IS NOT NULL").groupBy("reason").agg(F.count("*").alias("entities"), F.avg("iterations").alias("mean_iterations"), F.max("iterations").alias("max_iterations"))
        return RandomModel(c.shard, c.entity, trained.select(F.col("entity").alias(c.entity), "coefficients"))


def _by_entity(active: DataFrame, models: DataFrame | None) -> DataFrame:
    """Rows in the order of their entities, an entity's in one partition, its earlier coefficients in one row of it.

    The window is last, so that its partitioning and order hold in what reads
    the rows; rows that come from a window over the entity don't move again.
    """
    rows = active.withColumn("row", F.lit(True))
    rows = rows.withColumn("coefficients", F.lit(None).cast(COEFFICIENTS)) if models is None else rows.join(models, "entity", "full_outer")
    first = F.row_number().over(Window.partitionBy("entity").orderBy("uid")) == 1
    rows = rows.withColumn("first", first)
    # of a null entity the earlier model is a row of its own
    old = F.when(F.col("first") | F.col("row").isNull(), F.col("coefficients"))
    # "first" stays, or the window would be left out of the plan where there are no earlier models
    return rows.select("entity", F.col("row").isNotNull().alias("row"), "label", "offset", "weight", "features", old.alias("coefficients"), "first")


@dataclass(frozen=True)
class _Solver:
    """Trains one entity in the subspace of the features it has."""

    config: Coordinate
    task: str
    norm: Normalization
    intercept: int | None
    variance: str
    with_prior: bool

    def _space(self, cols: np.ndarray, old: list) -> tuple:
        """Kept global indices, local normalization and intercept, old means and variances."""
        of = {r["idx"]: r for r in old}
        kept = np.union1d(cols, np.array(sorted(of), np.int64)).astype(np.int64)
        norm = self.norm.project(kept)
        where = np.flatnonzero(kept == self.intercept) if self.intercept is not None else []
        means = np.array([of[k]["mean"] if k in of else 0.0 for k in kept.tolist()])
        var = np.array([(of[k]["variance"] if of[k]["variance"] is not None else 0.0) if k in of else 0.0 for k in kept.tolist()])
        return kept, norm, int(where[0]) if len(where) else None, means, var

    def _solve(self, objective_of, kept, norm, intercept, means, var) -> tuple:
        c, loss = self.config, TASKS[self.task]
        norm = norm if loss.np_second else Normalization()
        penalty = _penalty(c, intercept, norm, (means, var) if self.with_prior and len(means) and means.any() else None)
        objective = objective_of(loss, penalty, norm)
        bounds = None if not c.bounds else {int(np.flatnonzero(kept == k)[0]): v for k, v in c.bounds.items() if k in set(kept.tolist())}
        r = minimise(objective, norm.to_transformed(means), c.optimizer, c.l1, c.tolerance, c.max_iterations, bounds or None)
        raw = norm.to_original(r.coefficients)
        v = variances(objective, raw, self.variance)
        out = [{"idx": int(k), "mean": float(m), "variance": None if v is None else float(v[i])} for i, (k, m) in enumerate(zip(kept, raw))]
        return out, r.reason, r.iterations

    def stream(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Models of the entities of _by_entity's rows, about TOGETHER rows at a time; an entity's rows stay together."""
        held, enough = [], TOGETHER
        for b in batches:
            if not b.num_rows:
                continue
            held.append(b)
            if sum(x.num_rows for x in held) < enough:
                continue
            t = pa.Table.from_batches(held)
            starts = _starts(t.column("entity"))
            whole = int(starts[-1])
            if whole:
                yield from self._solved(t.slice(0, whole))
            held = t.slice(whole).combine_chunks().to_batches()
            enough = max(TOGETHER, 2 * (t.num_rows - whole))
        if held:
            yield from self._solved(pa.Table.from_batches(held))

    def _solved(self, t: pa.Table) -> Iterator[pa.RecordBatch]:
        t = t.combine_chunks()
        starts = _starts(t.column("entity"))
        names = t.column("entity").take(pa.array(starts)).combine_chunks()
        by = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, t.num_rows)))
        is_row = t.column("row").to_numpy()
        has = np.bincount(by[is_row], minlength=len(starts)) > 0
        coefficients = t.column("coefficients").combine_chunks()
        have_old = ~coefficients.is_null().to_numpy(zero_copy_only=False)
        rows, owner = t.filter(pa.array(is_row)), by[is_row]
        kind = pa.list_(pa.struct([("idx", pa.int32()), ("mean", pa.float64()), ("variance", pa.float64())]))
        fields = pa.schema([("entity", pa.string()), ("coefficients", kind), ("reason", pa.string()), ("iterations", pa.int32())])
        stay = np.flatnonzero(have_old & ~has[by])  # only an earlier model: it stays
        if len(stay):
            none = len(stay)
            yield pa.RecordBatch.from_arrays([names.take(pa.array(by[stay])), coefficients.take(pa.array(stay)).cast(kind), pa.nulls(none, pa.string()), pa.nulls(none, pa.int32())], schema=fields)
        if not has.any():
            return
        # entities with rows, numbered anew
        names, number = names.filter(pa.array(has)), np.cumsum(has) - 1
        owner, n = number[owner], int(has.sum())
        x = Sparse.from_arrow(rows.column("features").combine_chunks()) if rows.num_rows else None
        y, offset, weight = (rows.column(k).to_numpy() for k in ("label", "offset", "weight"))
        mine = np.flatnonzero(have_old & has[by])
        earlier = coefficients.take(pa.array(mine))
        sizes = earlier.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        entries = earlier.flatten()
        old_key = np.repeat(number[by[mine]], sizes) << 32 | entries.field(0).to_numpy().astype(np.int64)
        old_mean, old_var = entries.field(1).to_numpy(zero_copy_only=False), entries.field(2).fill_null(0.0).to_numpy(zero_copy_only=False)
        key = owner[x.row] << 32 | x.col.astype(np.int64)
        keys = np.unique(np.concatenate([key, old_key]))
        of, kept = keys >> 32, keys & 0xFFFFFFFF
        means, var = np.zeros(len(keys)), np.zeros(len(keys))
        at = np.searchsorted(keys, old_key)
        means[at], var[at] = old_mean, old_var
        local = Sparse(x.n, x.row, np.searchsorted(keys, key), x.val)
        ends = np.concatenate([[0], np.cumsum(np.bincount(of, minlength=n))]).astype(np.int32)
        raw, v, reasons, iterations = (self._together if self._plain() else self._one_by_one)(local, y, offset, weight, owner, of, kept, ends, n, means, var)
        out = pa.StructArray.from_arrays([pa.array(kept, pa.int32()), pa.array(raw), pa.nulls(len(keys), pa.float64()) if v is None else pa.array(v)], ["idx", "mean", "variance"])
        yield pa.RecordBatch.from_arrays([names, pa.ListArray.from_arrays(pa.array(ends), out).cast(kind), pa.array(reasons, pa.string()), pa.array(iterations, pa.int32())], schema=fields)

    def _plain(self) -> bool:
        """Whether entities can be solved side by side."""
        c, second = self.config, TASKS[self.task].np_second
        scaled = second is not None and (self.norm.factors is not None or self.norm.shifts is not None)
        return not scaled and not c.bounds and not c.l1 and self.variance != "FULL" and (c.optimizer == "LBFGS" or c.optimizer == "TRON" and second is not None)

    def _together(self, x, y, offset, weight, owner, of, kept, ends, n, means, var) -> tuple:
        c, loss = self.config, TASKS[self.task]
        precision, mean = np.full(len(of), float(c.l2)), np.zeros(len(of))
        if self.intercept is not None:
            precision[kept == self.intercept] = 0.0
        if self.with_prior:
            known = (np.bincount(of, means != 0, n) > 0)[of]
            prior, m = Penalty(c.l2, None, (means, var), 1.0 if c.incremental_weight is None else c.incremental_weight)._precision(len(of))
            precision, mean = np.where(known, prior, precision), np.where(known, m, mean)
        objective = Many(loss, x, y, offset, weight, owner, of, n, precision, mean)
        options = {k: o for k, o in (("tolerance", c.tolerance), ("max_iterations", c.max_iterations)) if o is not None}
        raw, reasons, iterations = (optim_many.tron if c.optimizer == "TRON" else optim_many.lbfgs)(objective, means, **options)
        v = None if self.variance == "NONE" or loss.np_second is None else inverse_diagonal(objective.hessian_diagonal(raw))
        return raw, v, reasons.tolist(), iterations

    def _one_by_one(self, x, y, offset, weight, owner, of, kept, ends, n, means, var) -> tuple:
        row_ends, out = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=n))]), []
        entry_ends = np.searchsorted(x.row, row_ends)
        for e in range(n):
            (a, b), (i, j), (f, t) = row_ends[e : e + 2], ends[e : e + 2], entry_ends[e : e + 2]
            local, own = Sparse(b - a, x.row[f:t] - a, x.col[f:t] - i, x.val[f:t]), kept[i:j]
            where = np.flatnonzero(own == self.intercept) if self.intercept is not None else []
            make = lambda loss, penalty, nm: Local(loss, local, y[a:b], offset[a:b], weight[a:b], len(own), penalty, nm)  # noqa: E731, B023
            out.append(self._solve(make, own, self.norm.project(own), int(where[0]) if len(where) else None, means[i:j], var[i:j]))
        flat = [c for found, _, _ in out for c in found]
        v = np.array([np.nan if c["variance"] is None else c["variance"] for c in flat], float)
        return np.array([c["mean"] for c in flat], float), None if all(c["variance"] is None for c in flat) else v, [r for _, r, _ in out], [k for _, _, k in out]

    def spread(self, name: str, rows: DataFrame, old: list) -> tuple:
        """The same for an entity too large for one task, by one job an evaluation."""
        cols = np.array(sorted(r[0] for r in rows.select(F.explode("features.idx")).distinct().collect()), np.int64)
        kept, norm, intercept, means, var = self._space(cols, old)
        place = F.create_map(*(x for i, k in enumerate(kept.tolist()) for x in (F.lit(k), F.lit(i))))
        local = rows.withColumn("features", F.transform("features", lambda x: F.struct(F.element_at(place, x["idx"]).alias("idx"), x["val"].alias("val")))).persist()
        found = self._solve(lambda loss, penalty, nm: Distributed(loss, local, len(kept), penalty, nm), kept, norm, intercept, means, var)
        local.unpersist()
        return (name, *found)


def kept(df: DataFrame) -> DataFrame:
    """df as a compressed table in the checkpoint folder, which cuts its lineage; in memory and on disk if there is no such folder."""
    spark = df.sparkSession
    base = spark.sparkContext.getCheckpointDir()
    if base is None:
        return df.persist()
    at = f"{base}/kestrix-rows-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(at)
    # shuffle files go once the driver has collected the plans that own them
    gc.collect()
    spark._jvm.System.gc()
    return spark.read.parquet(at)


def dropped(df: DataFrame) -> None:
    """Gives back what ``kept`` wrote; whoever calls it has no more use of df."""
    spark = df.sparkSession
    files = df.inputFiles() if spark.sparkContext.getCheckpointDir() else []
    for at in {f.rpartition("/")[0] for f in files if "/kestrix-rows-" in f}:
        path = spark._jvm.org.apache.hadoop.fs.Path(at)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    df.unpersist()


@dataclass
class Descended:
    model: MixedModel
    metrics: dict[str, float]
    history: list


def descend(df: DataFrame, coordinates: dict, task: str, passes: int = 1, validation: DataFrame | None = None, evaluators: list[str] = (), initial: MixedModel | None = None, locked: tuple[str, ...] = (), incremental: bool = False, cut=None) -> Descended:
    """Coordinate descent: each coordinate is trained on the others' scores, then scores anew.

    df has uid, label, offset, weight, id tags and shards.  Locked coordinates
    score with their initial model and are never trained.  With validation
    data every update is evaluated, and the best model after the first full
    pass is returned.  cut cuts a DataFrame's lineage after each update but the
    last; df is read several times and should be kept by the caller.
    """
    cut, give_back = (cut, None) if cut else (kept, dropped)
    if bad := set(locked) - set(initial.models if initial else {}):
        raise ValueError(f"locked coordinates need an initial model: {sorted(bad)}")
    trainable = [k for k in coordinates if k not in locked]
    if len(trainable) == 1:
        passes = 1
    names = {k: f"__c{i}" for i, k in enumerate(coordinates)}
    model = MixedModel(task, dict(initial.models) if initial else {})
    state = df
    for k in coordinates:
        have = model.models.get(k)
        state = state.withColumn(names[k], F.lit(0.0)) if have is None else state.withColumn(names[k], have.score(state)) if isinstance(have, FixedModel) else have.scored(state, names[k])
    shards = {coordinates[k].config.shard for k in trainable}
    entities = {coordinates[k].config.entity for k in trainable if coordinates[k].config.entity}
    state = state.select(*dict.fromkeys(["uid", "label", "offset", "weight", *sorted(entities), *sorted(shards), *names.values()]))
    own = None
    if any(isinstance(m, RandomModel) for k, m in model.models.items() if k in names):
        state = own = cut(state)
    best: tuple | None = None
    history = []
    for n in range(passes):
        for k in trainable:
            c = coordinates[k]
            others = reduce(lambda a, b: a + b, (F.col(names[o]) for o in coordinates if o != k), F.lit(0.0))
            before, prior = model.models.get(k), (initial.models.get(k) if incremental and initial else None)
            if isinstance(c, FixedCoordinate):
                model.models[k] = c.train(state, F.col("offset") + others, before, prior)
                state = state.withColumn(names[k], model.models[k].score(state))
            else:
                rows = c.rows(state, before.table.select(before.entity) if before is not None else None)
                model.models[k] = c.train(rows, F.col("offset") + others, before, prior)
                state = model.models[k].scored(state, names[k])
                if c.config.bound is not None:  # rows that are neither active nor passive have no score here
                    seen = rows.select(F.col("uid").alias("__uid"))
                    state = state.join(seen.withColumn("__in", F.lit(True)), F.col("uid") == F.col("__uid"), "left").withColumn(names[k], F.when(F.col("__in"), F.col(names[k])).otherwise(0.0)).drop("__uid", "__in")
            if n < passes - 1 or k != trainable[-1]:
                before_cut, state = own, cut(state)
                own = state
                if before_cut is not None and give_back:
                    give_back(before_cut)
            if validation is not None and evaluators:
                tags = sorted({e.tag for e in map(evaluate.Evaluator.parse, evaluators) if e.tag})
                scored = model.score(validation).select(*dict.fromkeys(["uid", "label", "weight", "score", *tags])).persist()
                found = evaluate.evaluate(scored, list(evaluators))
                scored.unpersist()
                history.append({"pass": n, "coordinate": k, **found})
                primary = evaluate.Evaluator.parse(evaluators[0])
                full = n > 0 or k == trainable[-1]
                if full and (best is None or primary.better(found[primary.name], best[1][primary.name])):
                    best = (MixedModel(task, dict(model.models)), found)
    if own is not None and give_back:
        give_back(own)
    return Descended(*(best or (model, {})), history)


class Estimator:
    """Fits mixed models for every combination of configurations."""

    def __init__(self, task: str, coordinates: list[Coordinate], passes: int = 1, normalization: dict[str, Normalization] | None = None, intercepts: dict[str, int] | None = None, variance: str = "NONE", evaluators: list[str] | None = None, initial: MixedModel | None = None, locked: tuple[str, ...] = (), incremental: bool = False, warm_start: bool = True):
        if task not in TASKS:
            raise ValueError(f"no task {task}")
        if len({c.name for c in coordinates}) != len(coordinates):
            raise ValueError("coordinates share a name")
        if incremental:
            missing = [c.name for c in coordinates if c.name not in (initial.models if initial else {})]
            if missing:
                raise ValueError(f"incremental training needs models of {missing}")
        self.task, self.coordinates, self.passes = task, coordinates, passes
        self.normalization, self.intercepts, self.variance = normalization or {}, intercepts or {}, variance
        self.evaluators = evaluators or [evaluate.DEFAULT[task]]
        self.initial, self.locked, self.incremental, self.warm_start = initial, locked, incremental, warm_start

    def _coordinate(self, c: Coordinate, df: DataFrame):
        norm, intercept = self.normalization.get(c.shard, Normalization()), self.intercepts.get(c.shard)
        if c.entity:
            return RandomCoordinate(c, self.task, norm, intercept, self.variance)
        return FixedCoordinate(c, self.task, _size(df, c.shard), norm, intercept, self.variance)

    def fit(self, df: DataFrame, validation: DataFrame | None = None, grid: list[dict[str, Coordinate]] | None = None) -> list[tuple[dict[str, Coordinate], Descended]]:
        """One result per combination; with warm start each begins from the one before."""
        from .config import grid as expand

        out, before = [], self.initial
        for combo in grid or expand(self.coordinates):
            parts = {c.name: self._coordinate(combo[c.name], df) for c in self.coordinates}
            start = before if self.warm_start or self.locked or self.incremental else self.initial
            found = descend(df, parts, self.task, self.passes, validation, self.evaluators if validation is not None else [], start, self.locked, self.incremental)
            out.append((combo, found))
            before = found.model if self.warm_start and not self.incremental else self.initial
        return out

    def best(self, results: list) -> tuple:
        """By the primary evaluator, the later of two equals; without evaluations the last."""
        primary = evaluate.Evaluator.parse(self.evaluators[0])
        chosen = results[0]
        for r in results[1:]:
            if not r[1].metrics or not chosen[1].metrics or not primary.better(chosen[1].metrics[primary.name], r[1].metrics[primary.name]):
                chosen = r
        return chosen


class Transformer:
    """Scores rows with a model and evaluates them."""

    def __init__(self, model: MixedModel, evaluators: list[str] = ()):
        self.model, self.evaluators = model, list(evaluators)

    def transform(self, df: DataFrame) -> DataFrame:
        return self.model.score(df)

    def evaluate(self, df: DataFrame) -> dict[str, float]:
        return evaluate.evaluate(self.transform(df), self.evaluators)


def regularization_path(df: DataFrame, config: Coordinate, task: str, weights: list[float], warm_start: bool = True, **options) -> list[tuple[float, FixedModel, Result]]:
    """Models for weights in falling order, each started from the one before, or from zero without warm_start."""
    out, before = [], None
    size = options.pop("size", None) or _size(df, config.shard)
    blocks = FixedCoordinate(config, task, size).blocks(df, F.col("offset"))
    for w in sorted(weights, reverse=True):
        c = FixedCoordinate(replace(config, weight=w), task, size, **options)
        before = c.train(df, F.col("offset"), before if warm_start else None, blocks=blocks)
        out.append((w, before, c.result))
    blocks.unpersist()
    return out
