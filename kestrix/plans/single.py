"""The single-model job in stages, with the options of its command line.

    python -m kestrix.plans.single --training-data-directory in --output-directory out --task LOGISTIC_REGRESSION
"""

from __future__ import annotations

import importlib
import json
from enum import IntEnum

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kestrix.functions.features import INTERCEPT, SEPARATOR
from kestrix.operators import config, dataset, evaluate, indexing, mixed, normalize
from kestrix.operators.config import Coordinate
from kestrix.operators.params import Parameters, checked, flag, list_of, one_of
from kestrix.sources import readers, writers

from .drivers import Events, log, timed


class Stage(IntEnum):
    INIT = 0
    PREPROCESSED = 1
    TRAINED = 2
    VALIDATED = 3


def _constraints(text: str) -> str:
    entries = json.loads(text)
    if not isinstance(entries, list) or not all(isinstance(e, dict) for e in entries):
        raise ValueError("box constraints are a JSON array of objects")
    return text


class SingleParameters(Parameters):
    """Options of the single-model job.

    ``kryo``, ``tree-aggregate-depth`` and ``offheap-indexmap-num-partitions``
    are read and checked but change nothing: rows are Arrow and Tungsten, the
    depth of sums follows the number of partitions, an index is a table.
    """

    def __init__(self):
        super().__init__()
        add = self.declare
        positive = checked(int, lambda n: n > 0, "positive")
        # fixed values: names and defaults of the options
        add("training-data-directory", "training data", str, required=True)
        add("validating-data-directory", "validation data; with it the best model is chosen", str)
        add("output-directory", "where models go", str, required=True)
        add("job-name", "name of the application", str, "kestrix-training")
        add("regularization-weights", "comma separated; ignored without regularization", list_of(checked(float, lambda w: w >= 0, "a weight of 0 or more")), [10.0])
        add("intercept", "add an intercept", flag, True)
        add("num-iterations", "iterations at most", positive, 80)
        add("convergence-tolerance", "tolerance", float, 1e-6)
        add("task", "task", one_of(*config.TASKS), required=True)
        add("format", "dialect of the records", one_of(*readers.DIALECTS), "RESPONSE_PREDICTION")
        add("optimizer", "optimizer", one_of(*config.OPTIMIZERS), "LBFGS")
        add("regularization-type", "regularization", one_of(*config.REGULARIZATION), "L2")
        add("elastic-net-alpha", "share of L1 in an elastic net, 0.5 if not given", checked(float, lambda a: 0 <= a <= 1, "in [0, 1]"))
        add("kryo", "no effect", flag, True)
        add("optimization-tracker", "send the states of each optimization to listeners", flag, True)
        add("min-partitions", "partitions of the input at least", positive, 1)
        add("validate-per-iteration", "metrics on validation data after every iteration; needs the tracker", flag, False)
        add("summarization-output-dir", "where feature statistics go", str)
        add("normalization-type", "normalization", one_of(normalize.NONE, normalize.SCALE_MAX, normalize.SCALE_STD, normalize.STANDARDIZATION), normalize.NONE)
        add("coefficient-box-constraints", "JSON array of name, term, lowerBound, upperBound", _constraints)
        add("data-validation-type", "checks of the data", one_of("VALIDATE_FULL", "VALIDATE_SAMPLE", "VALIDATE_DISABLED"), "VALIDATE_FULL")
        add("tree-aggregate-depth", "no effect", positive, 1)
        add("selected-features-file", "name<TAB>term lines; only these features are used", str)
        add("offheap-indexmap-dir", "an index table; built from the data if not given", str)
        add("offheap-indexmap-num-partitions", "no effect", positive)
        add("delete-output-dirs-if-exist", "delete what stands at the output places", flag, False)
        add("event-listeners", "comma separated module.function or module.Class of listeners", list_of(str))
        add("feature-dimension", "number of features of LIBSVM data", int, -1)
        add("input-file-format", "AVRO or LIBSVM", one_of("AVRO", "LIBSVM"), "AVRO")
        add("use-warm-start", "start each weight from the model of the one before", flag, True)

    def problems(self) -> list[str]:
        kind, out = self.value("regularization-type"), []
        if kind in ("L1", "ELASTIC_NET") and self.value("optimizer") == "TRON":
            out.append(f"{kind} and TRON exclude each other")
        if self.value("coefficient-box-constraints") and self.value("normalization-type") != normalize.NONE:
            out.append("box constraints and normalization exclude each other")
        if self.value("normalization-type") == normalize.STANDARDIZATION and not self.value("intercept"):
            out.append("standardization needs an intercept")
        return out


def listener(path: str):
    """A function (event, details) by its dotted name; a class is called without arguments first."""
    module, _, name = path.rpartition(".")
    try:
        found = getattr(importlib.import_module(module), name)
        return found() if isinstance(found, type) else found
    except Exception as e:
        raise ValueError(f"no event listener {path}") from e


class SingleJob:
    """INIT, PREPROCESSED, TRAINED and, with validation data, VALIDATED; each step needs the stage before it."""

    def __init__(self, spark: SparkSession, parameters: SingleParameters, listeners: list | None = None):
        parameters.check()
        self.spark, self.p, self.stage = spark, parameters, Stage.INIT
        self.events = Events([*(listeners or []), *map(listener, parameters.value("event-listeners") or [])])
        self.path: list[tuple] = []
        self.best: tuple | None = None
        self.metrics: dict[float, dict] = {}
        self.iterations: dict[float, list[dict]] = {}
        self.events.send("setup", parameters=parameters)

    def _need(self, stage: Stage) -> None:
        if self.stage != stage:
            raise RuntimeError(f"stage {self.stage.name}, not {stage.name}")

    def _read(self, path: str) -> DataFrame:
        p = self.p
        if p.value("input-file-format") == "LIBSVM":
            rows = readers.input_format("LIBSVM", p.value("feature-dimension"), intercept=p.value("intercept"))(self.spark, path)
        else:
            chosen = p.value("selected-features-file")
            if chosen and not writers.exists(self.spark, chosen):
                raise FileNotFoundError(chosen)
            named = readers.input_format("AVRO", dialect=p.value("format"), selected=readers.read_names(self.spark, chosen) if chosen else None)(self.spark, path)
            if self.index is None:
                # keys are kept while they are numbered, so the records are decoded once for it
                words = indexing.vocabulary(named, ["features"]).select(F.concat("name", F.lit(SEPARATOR), "term").alias("key")).persist()
                self.index = indexing.index(words, p.value("intercept")).persist()
                self.index.count()
                words.unpersist()
            rows = indexing.shard(named.withColumnRenamed("features", "bag"), ["bag"], self.index, intercept=p.value("intercept")).drop("bag")
        if (n := p.value("min-partitions")) > 1 and rows.rdd.getNumPartitions() < n:
            rows = rows.repartition(n)
        rows = rows.select("uid", "label", "offset", "weight", "features").persist()
        if rows.isEmpty():
            raise ValueError(f"no rows of positive weight at {path}")
        dataset.validate(rows, p.value("task"), p.value("data-validation-type").removeprefix("VALIDATE_"), features=("features",))
        return rows

    def preprocess(self) -> None:
        self._need(Stage.INIT)
        p, spark = self.p, self.spark
        if p.value("input-file-format") == "LIBSVM":
            if p.value("feature-dimension") <= 0:
                raise ValueError("LIBSVM needs a positive feature-dimension")
            self.index = indexing.identity_index(p.value("feature-dimension"), spark, p.value("intercept"))
        else:
            at = p.value("offheap-indexmap-dir")
            self.index = spark.read.parquet(at) if at else None
        self.rows = self._read(p.required("training-data-directory"))
        self.size = self.index.count()
        last = self.index.where(F.col("key") == INTERCEPT + SEPARATOR).first()
        self.intercept = last["idx"] if last else None
        at = p.value("validating-data-directory")
        # the same records are read and kept once
        self.held = None if not at else self.rows if at == p.value("training-data-directory") else self._read(at)
        self.norm, summary = normalize.Normalization(), p.value("summarization-output-dir")
        if summary or p.value("normalization-type") != normalize.NONE:
            stats = normalize.statistics(self.rows)
            if summary:
                writers.write_summary(stats, self.index, summary)
            self.norm = normalize.Normalization.build(p.value("normalization-type"), stats, self.size, self.intercept)
        self.stage = Stage.PREPROCESSED

    def train(self) -> None:
        self._need(Stage.PREPROCESSED)
        p, kind, alpha = self.p, self.p.value("regularization-type"), None
        if kind == "ELASTIC_NET":
            alpha = 0.5 if p.value("elastic-net-alpha") is None else p.value("elastic-net-alpha")
            kind, alpha = ("L2", None) if alpha == 0 else (kind, alpha)
        text = p.value("coefficient-box-constraints")
        bounds = config.box_constraints(text, [(r["key"], r["idx"]) for r in self.index.collect()], self.intercept) if text else None
        c = Coordinate("model", optimizer=p.value("optimizer"), regularization=kind, alpha=alpha, max_iterations=p.value("num-iterations"), tolerance=p.value("convergence-tolerance"), bounds=bounds or None)
        weights = [0.0] if kind == "NONE" else p.value("regularization-weights")
        each = self.held is not None and p.value("validate-per-iteration") and p.value("optimization-tracker")
        self.path = mixed.regularization_path(self.rows, c, p.value("task"), weights, p.value("use-warm-start"), size=self.size, norm=self.norm, intercept=self.intercept, keep_path=each)
        self.stage = Stage.TRAINED

    def _measured(self, m: mixed.FixedModel) -> dict[str, float]:
        scored = self.held.withColumn("score", m.score(self.held) + F.col("offset"))
        return evaluate.legacy_metrics(scored, self.p.value("task"), int((np.abs(m.means) > 1e-12).sum()))

    def validate(self) -> None:
        """Metrics of every model, of every iteration if asked, and the best model."""
        self._need(Stage.TRAINED)
        task = self.p.value("task")
        for w, m, r in self.path:
            if r.path:
                self.iterations[w] = [self._measured(mixed.FixedModel(m.shard, b)) for b in r.path]
            self.metrics[w] = self._measured(m)
        self.best = evaluate.legacy_best(task, [(w, m, self.metrics[w]) for w, m, _ in self.path])
        writers.write_text_models(self.spark, f"{self.p.value('output-directory')}/best-model-text", [self.best[:2]], self.index)
        self.stage = Stage.VALIDATED

    def run(self) -> SingleJob:
        p, out = self.p, self.p.required("output-directory")
        self.events.send("start")
        for at in filter(None, (out, p.value("summarization-output-dir"))):
            writers.prepare_output(self.spark, at, p.value("delete-output-dirs-if-exist"))
        with timed("reading"):
            self.preprocess()
        with timed("training"):
            self.train()
        if self.held is not None:
            with timed("validation"):
                self.validate()
        for w, _, r in self.path:
            self.events.send("optimization", weight=w, tracker=r if p.value("optimization-tracker") else None, iterations=self.iterations.get(w), metrics=self.metrics.get(w))
        writers.write_text_models(self.spark, f"{out}/learned-models-text", [(w, m) for w, m, _ in self.path], self.index)
        for d in filter(lambda x: x is not None, (self.rows, self.held)):
            d.unpersist()
        self.events.send("finish")
        return self


def main(args: list[str] | None = None) -> SingleJob:
    p = SingleParameters().parse(args, "kestrix-single")
    spark = SparkSession.builder.appName(p.value("job-name")).config("spark.sql.adaptive.enabled", "true").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    log.info("%s", p.explainParams())
    return SingleJob(spark, p).run()


if __name__ == "__main__":
    main()
