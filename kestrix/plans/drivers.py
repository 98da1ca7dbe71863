"""Whole jobs: indexing, training, scoring and the single-model driver, with their command lines.

    python -m kestrix.plans.drivers train --input data --output out --task LOGISTIC_REGRESSION \\
        --shard name=global,feature.bags=features --coordinate name=fixed,feature.shard=global,reg.weights=1|10,regularization=L2
"""

from __future__ import annotations

import argparse
import logging
import time
from collections.abc import Callable
from contextlib import contextmanager
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kestrix.functions.features import INTERCEPT, SEPARATOR, DateRange
from kestrix.operators import dataset, evaluate, indexing, mixed, normalize, tuning
from kestrix.operators.config import Coordinate, Shard, grid
from kestrix.sources import readers, writers

log = logging.getLogger("kestrix")


@dataclass
class Events:
    """Listeners are called with (event, details); one that fails stops nobody."""

    listeners: list[Callable[[str, dict], None]] = field(default_factory=list)

    def send(self, event: str, **details) -> None:
        for f in self.listeners:
            try:
                f(event, details)
            except Exception:
                log.exception("a listener failed on %s", event)


@contextmanager
def timed(what: str):
    began = time.time()
    log.info("%s begins", what)
    yield
    log.info("%s took %.1f s", what, time.time() - began)


def session(name: str = "kestrix") -> SparkSession:
    return SparkSession.builder.appName(name).config("spark.sql.adaptive.enabled", "true").config("spark.sql.session.timeZone", "UTC").getOrCreate()


def read_input(spark: SparkSession, path: str, fmt: str = "parquet", days: str | None = None, days_ago: str | None = None, min_partitions: int = 1) -> DataFrame:
    """A folder, or its days of a range."""
    if days and days_ago:
        raise ValueError("give a date range or days ago, not both")
    chosen = DateRange.parse(days) if days else DateRange.days_ago(days_ago) if days_ago else None
    return readers.read_table(spark, readers.daily_paths(spark, path, chosen) if chosen else path, fmt, min_partitions)


def build_indexes(spark: SparkSession, data: DataFrame, shards: list[Shard], output: str) -> None:
    """The index of each shard as a table under output/<shard>."""
    for s in shards:
        words = indexing.vocabulary(data, list(s.bags))
        indexing.index(words.select(F.concat("name", F.lit(SEPARATOR), "term").alias("key")), s.intercept).write.mode("overwrite").parquet(f"{output}/{s.name}")


def build_vocabularies(data: DataFrame, bags: list[str], output: str) -> None:
    """Distinct names and terms of each bag as text under output/<bag>."""
    for b in bags:
        writers.write_names(indexing.vocabulary(data, [b]), f"{output}/{b}")


def load_indexes(spark: SparkSession, path: str, shards: list[Shard]) -> dict[str, DataFrame]:
    return {s.name: spark.read.parquet(f"{path}/{s.name}") for s in shards}


def vocabulary_indexes(spark: SparkSession, path: str, shards: list[Shard]) -> dict[str, DataFrame]:
    """Indexes from vocabularies of the shards' bags."""
    out = {}
    for s in shards:
        words = None
        for b in s.bags:
            w = readers.read_names(spark, f"{path}/{b}")
            words = w if words is None else words.unionByName(w)
        out[s.name] = indexing.index(words.select(F.concat("name", F.lit(SEPARATOR), "term").alias("key")), s.intercept)
    return out


def _prepare(data: DataFrame, shards: list[Shard], tags: tuple[str, ...], indexes, response_required: bool, response: str):
    out, indexes = readers.read_merged(data, shards, indexes)
    return dataset.examples(out, tuple(s.name for s in shards), tags, response_required, {"response": response}), indexes


def train(
    spark: SparkSession, data: DataFrame, output: str, task: str, shards: list[Shard], coordinates: list[Coordinate], validation: DataFrame | None = None, passes: int = 1,
    evaluators: list[str] | None = None, normalization: str = normalize.NONE, variance: str = "NONE", indexes: dict[str, DataFrame] | None = None, model: str | None = None,
    locked: tuple[str, ...] = (), incremental: bool = False, validate: str = "DISABLED", tuning_mode: str = "NONE", tuning_rounds: int = 0, override: bool = False,
    output_mode: str = "BEST", response: str = "response", summary: str | None = None, events: Events | None = None,
):
    """Train, tune, choose and save; returns the chosen (configuration, result)."""
    events = events or Events()
    events.send("setup", task=task, coordinates=[str(c) for c in coordinates])
    writers.prepare_output(spark, output, override)
    groups = {e.tag for e in map(evaluate.Evaluator.parse, evaluators or []) if e.tag}
    tags = tuple(sorted({c.entity for c in coordinates if c.entity} | groups))
    with timed("reading"):
        rows, indexes = _prepare(data, shards, tags, indexes, True, response)
        rows = rows.persist()
        held = None if validation is None else _prepare(validation, shards, tags, indexes, True, response)[0].persist()
    for d in filter(lambda x: x is not None, (rows, held)):
        dataset.validate(d, task, validate, features=tuple(s.name for s in shards))
    norms, intercepts = {}, {}
    for s in shards:
        size = indexes[s.name].count()
        if s.intercept:
            intercepts[s.name] = indexes[s.name].where(F.col("key") == INTERCEPT + SEPARATOR).first()["idx"]
        if normalization != normalize.NONE or summary:
            stats = normalize.statistics(rows, s.name)
            if summary:
                writers.write_summary(stats, indexes[s.name], f"{summary}/{s.name}")
            norms[s.name] = normalize.Normalization.build(normalization, stats, size, intercepts.get(s.name))
    initial = writers.load_model(spark, model, indexes) if model else None
    est = mixed.Estimator(task, coordinates, passes, norms, intercepts, variance, evaluators, initial, locked, incremental)
    events.send("start")
    with timed("training"):
        results = est.fit(rows, held, grid(coordinates))
    for combo, r in results:
        events.send("optimization", configuration={k: str(c) for k, c in combo.items()}, metrics=r.metrics)
    tuned = []
    if held is not None and tuning_mode != "NONE" and tuning_rounds:
        primary = evaluate.Evaluator.parse(est.evaluators[0])
        est.warm_start = False
        f = tuning.EstimatorFunction(est, results[0][0], rows, held, primary.better(1.0, 0.0))
        seen = [(f.vector(c), -r.metrics[primary.name] if f.flip else r.metrics[primary.name], None) for c, r in results]
        tuned = [r for _, _, r in tuning.search(tuning_rounds, f.dimensions, tuning_mode, f, seen)]
    best = est.best([*results, *tuned])
    saved = {"NONE": [], "BEST": [], "ALL": [*results, *tuned], "EXPLICIT": results, "TUNED": tuned}[output_mode]
    if output_mode != "NONE":
        writers.save_model(spark, best[1].model, f"{output}/best", indexes, best[0], override=True)
    for i, (combo, r) in enumerate(saved):
        writers.save_model(spark, r.model, f"{output}/models/{i}", indexes, combo, override=True)
    events.send("finish", metrics=best[1].metrics)
    return best


def score(spark: SparkSession, data: DataFrame, model_path: str, output: str, shards: list[Shard], indexes: dict[str, DataFrame], evaluators: list[str] = (), model_id: str = "N/A", files: int | None = None, validate: str = "DISABLED", response: str = "response") -> dict[str, float]:
    """Score rows with a saved model, write scores, evaluate if asked."""
    model = writers.load_model(spark, model_path, indexes)
    groups = {e.tag for e in map(evaluate.Evaluator.parse, evaluators) if e.tag}
    tags = tuple(sorted({m.entity for m in model.models.values() if isinstance(m, mixed.RandomModel)} | groups))
    used = [s for s in shards if s.name in {m.shard for m in model.models.values()}]
    rows, _ = _prepare(data, used, tags, indexes, bool(evaluators), response)
    dataset.validate(rows, "LINEAR_REGRESSION" if evaluators else model.task, validate if evaluators else "DISABLED", features=tuple(s.name for s in used))
    scored = model.score(rows).persist()
    writers.write_scores(scored, output, model_id, files, tags)
    return evaluate.evaluate(scored, list(evaluators)) if evaluators else {}


def dataset_summary(rows: DataFrame, entity: str) -> DataFrame:
    """Rows, and rows per entity: number, mean, standard deviation, least and most."""
    per = rows.groupBy(entity).agg(F.count("*").alias("n"))
    return per.agg(F.sum("n").alias("rows"), F.count("*").alias("entities"), F.avg("n").alias("mean"), F.stddev_pop("n").alias("stddev"), F.min("n").alias("min"), F.max("n").alias("max"))


def train_single(
    spark: SparkSession, data: DataFrame, output: str, task: str, weights: list[float], size: int, index: DataFrame, validation: DataFrame | None = None, optimizer: str = "LBFGS", regularization: str = "L2",
    alpha: float | None = None, normalization: str = normalize.NONE, intercept: int | None = None, max_iterations: int = 80, tolerance: float = 1e-6, bounds: dict | None = None, validate: str = "FULL",
) -> tuple[float, mixed.FixedModel, dict]:
    """The single-model driver: a path of weights, text models, metrics on means, and the best model.

    data has uid, label, offset, weight, features.
    """
    if bounds and normalization != normalize.NONE:
        raise ValueError("bounds and normalization exclude each other")
    if normalization == normalize.STANDARDIZATION and intercept is None:
        raise ValueError("standardization needs an intercept")
    dataset.validate(data, task, validate)
    rows = data.persist()
    norm = normalize.Normalization.build(normalization, normalize.statistics(rows), size, intercept)
    config = Coordinate("model", optimizer=optimizer, regularization=regularization, alpha=alpha, max_iterations=max_iterations, tolerance=tolerance, bounds=bounds)
    path = mixed.regularization_path(rows, config, task, weights, size=size, norm=norm, intercept=intercept)
    writers.write_text_models(spark, f"{output}/learned-models-text", [(w, m) for w, m, _ in path], index)
    if validation is None:
        return path[-1][0], path[-1][1], {}
    measured = []
    for w, m, _ in path:
        scored = validation.withColumn("score", m.score(validation) + F.col("offset"))
        measured.append((w, m, evaluate.legacy_metrics(scored, task, int((abs(m.means) > 1e-12).sum()))))
    best = evaluate.legacy_best(task, measured)
    writers.write_text_models(spark, f"{output}/best-model-text", [best[:2]], index)
    return best


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="kestrix")
    sub = p.add_subparsers(dest="job", required=True)
    for name in ("index", "vocabulary", "train", "score"):
        s = sub.add_parser(name)
        s.add_argument("--input", required=True)
        s.add_argument("--output", required=True)
        s.add_argument("--format", default="parquet")
        s.add_argument("--days")
        s.add_argument("--days-ago")
        s.add_argument("--min-partitions", type=int, default=1)
        if name == "vocabulary":
            s.add_argument("--bags", required=True, help="a|b")
            continue
        s.add_argument("--shard", action="append", required=True, type=Shard.parse)
        if name == "index":
            continue
        s.add_argument("--indexes", required=name == "score")
        s.add_argument("--model", required=name == "score")
        s.add_argument("--evaluators", default="", help="comma separated; the first is the primary one")
        s.add_argument("--validate", default="DISABLED", choices=("FULL", "SAMPLE", "DISABLED"))
        s.add_argument("--response", default="response")
        if name == "score":
            s.add_argument("--model-id", default="N/A")
            s.add_argument("--files", type=int)
            continue
        s.add_argument("--task", required=True)
        s.add_argument("--coordinate", action="append", required=True, type=Coordinate.parse)
        s.add_argument("--validation")
        s.add_argument("--passes", type=int, default=1)
        s.add_argument("--normalization", default=normalize.NONE)
        s.add_argument("--variance", default="NONE", choices=("NONE", "SIMPLE", "FULL"))
        s.add_argument("--locked", default="")
        s.add_argument("--incremental", action="store_true")
        s.add_argument("--tuning-mode", default="NONE", choices=("NONE", "RANDOM", "BAYESIAN"))
        s.add_argument("--tuning-rounds", type=int, default=0)
        s.add_argument("--output-mode", default="BEST", choices=("NONE", "BEST", "EXPLICIT", "TUNED", "ALL"))
        s.add_argument("--override", action="store_true")
    return p


def main(args: list[str] | None = None) -> None:
    a = parser().parse_args(args)
    spark = session()
    data = read_input(spark, a.input, a.format, a.days, a.days_ago, a.min_partitions)
    if a.job == "index":
        build_indexes(spark, data, a.shard, a.output)
    elif a.job == "vocabulary":
        build_vocabularies(data, a.bags.split("|"), a.output)
    else:
        names = [e for e in a.evaluators.split(",") if e]
        indexes = load_indexes(spark, a.indexes, a.shard) if a.indexes else None
        if a.job == "score":
            print(score(spark, data, a.model, a.output, a.shard, indexes, names, a.model_id, a.files, a.validate, a.response))
        else:
            held = readers.read_table(spark, a.validation, a.format) if a.validation else None
            best = train(
                spark, data, a.output, a.task, a.shard, a.coordinate, held, a.passes, names or None, a.normalization, a.variance, indexes, a.model, tuple(filter(None, a.locked.split(","))), a.incremental,
                a.validate, a.tuning_mode, a.tuning_rounds, a.override, a.output_mode, a.response,
            )
            print(best[1].metrics)


if __name__ == "__main__":
    main()
