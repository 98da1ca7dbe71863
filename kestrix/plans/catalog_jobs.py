"""Registered queries of sources, sinks, models, training and jobs; see ``catalog``.

Whatever a query writes goes to a new folder in the shared checkpoint folder
and is read back from there.
"""

from __future__ import annotations

import math
import uuid
from datetime import timedelta

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kestrix.functions import features as keys
from kestrix.functions import losses
from kestrix.functions.features import INTERCEPT, SEPARATOR, VECTOR, DateRange, dense
from kestrix.operators import config, dataset, evaluate, indexing, mixed, normalize, objective, partitioning, scores, tuning
from kestrix.operators.config import Coordinate, Shard
from kestrix.sources import readers, writers
from kestrix.sources.avro import AvroSource

from . import drivers, single
from .catalog import BETA, FEATURES, _bags, _entity_models, _round, _scored, _SCORED, _two, _vectors, examples, query

#: Names of the features before the intercept.
_NAMES = [f"f{i}" for i in range(4)]


def scratch(spark) -> str:
    """A new folder that all executors share; a local run without a checkpoint folder gets a temporary one."""
    import tempfile

    sc = spark.sparkContext
    base = sc.getCheckpointDir() or sc.getConf().get("spark.checkpoint.dir", None)
    if base is None:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp()
    return f"{base}/kestrix-{uuid.uuid4().hex}"


def _index(spark, intercept: bool = True) -> DataFrame:
    rows = [(f"{n}{SEPARATOR}", i) for i, n in enumerate(_NAMES)] + ([(INTERCEPT + SEPARATOR, 4)] if intercept else [])
    return spark.createDataFrame(rows, "key string, idx int")


# Sources -----------------------------------------------------------------------------------------

@query("avro_round_trip", "SELECT uid, label, supplier, round(x0, 6) AS x0, brand FROM ex")
def avro_round_trip(spark, sf_dir):
    """Written by the distributed sink, schema and rows read back in splits."""
    spark.dataSource.register(AvroSource)
    at = scratch(spark)
    d = examples(spark, sf_dir).select("uid", "label", "supplier", F.array(F.struct("x0", "brand")).alias("inner"))
    d.write.format(AvroSource.name()).mode("append").save(at)
    back = spark.read.format(AvroSource.name()).option("split", 50_000).load(at)
    return back.select("uid", "label", "supplier", F.round(F.col("inner")[0]["x0"], 6).alias("x0"), F.col("inner")[0]["brand"].alias("brand"))


def _svm_lines(spark, sf_dir) -> str:
    at = scratch(spark)
    d = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    sign = F.when(F.col("l_returnflag") == "R", "+1").otherwise("-1")
    d.select(F.concat(sign, F.lit(" 1:"), F.col("l_quantity").cast("long"), F.lit(" 3:"), F.col("l_linenumber").cast("long")).alias("value")).write.text(at)
    return at


@query("libsvm_read", "SELECT CAST(l_returnflag = 'R' AS INTEGER) * 1.0::DOUBLE AS label, CAST(count(*) AS BIGINT) AS n, sum(CAST(CAST(l_quantity AS BIGINT) AS DOUBLE)) AS v0, sum(CAST(l_linenumber AS DOUBLE)) AS v2, CAST(count(*) AS DOUBLE) AS v5 FROM lineitem GROUP BY 1", False)
def libsvm_read(spark, sf_dir):
    d = readers.input_format("LIBSVM", 5)(spark, _svm_lines(spark, sf_dir))
    at = lambda i: F.sum(F.filter("features", lambda x: x["idx"] == i)[0]["val"])
    return d.groupBy("label").agg(F.count("*").alias("n"), at(0).alias("v0"), at(2).alias("v2"), at(5).alias("v5"))


@query("libsvm_to_avro", "SELECT CAST(l_returnflag = 'R' AS INTEGER) * 1.0::DOUBLE AS label, name, CAST(count(*) AS BIGINT) AS n, sum(CASE WHEN name = '1' THEN CAST(CAST(l_quantity AS BIGINT) AS DOUBLE) ELSE CAST(l_linenumber AS DOUBLE) END) AS value FROM lineitem, (VALUES ('1'), ('3')) AS t(name) GROUP BY 1, 2", False)
def libsvm_to_avro(spark, sf_dir):
    spark.dataSource.register(AvroSource)
    at = scratch(spark)
    readers.libsvm_records(spark, _svm_lines(spark, sf_dir)).write.format(AvroSource.name()).mode("append").save(at)
    d = readers.input_format("AVRO")(spark, at)
    return d.select("label", F.explode("features").alias("f")).groupBy("label", F.col("f.name").alias("name")).agg(F.count("*").alias("n"), F.sum("f.value").alias("value"))


@query("training_records_selected", "SELECT uid, 'quantity' AS name, round(x0, 6) AS value, response_w AS weight FROM (SELECT *, CASE WHEN supplier % 3 = 0 THEN 0.0 ELSE weight END AS response_w FROM ex) WHERE response_w > 0")
def training_records_selected(spark, sf_dir):
    """Records in the second dialect: rows of weight 0 go, and only selected features stay."""
    d = _bags(spark, sf_dir).withColumnRenamed("label", "response").withColumnRenamed("bag", "features")
    w = examples(spark, sf_dir).select(F.col("uid").alias("u"), F.when(F.col("supplier") % 3 == 0, 0.0).otherwise(F.col("weight")).alias("weight"))
    chosen = spark.createDataFrame([("quantity", None), ("absent", "x")], "name string, term string")
    out = readers.read_training_records(d.join(w, F.col("uid") == F.col("u")).drop("u"), "RESPONSE_PREDICTION", chosen)
    return out.select("uid", F.explode("features").alias("f"), "weight").select("uid", F.col("f.name").alias("name"), F.round("f.value", 6).alias("value"), "weight")


@query("repartitioned_read", "SELECT CAST(16 AS INTEGER) AS partitions, count(*) AS n, sum(o_orderkey)::BIGINT AS total FROM orders", False)
def repartitioned_read(spark, sf_dir):
    d = readers.read_table(spark, [f"{sf_dir}/orders.parquet"], min_partitions=16)
    return d.agg(F.lit(d.rdd.getNumPartitions()).alias("partitions"), F.count("*").alias("n"), F.sum("o_orderkey").alias("total"))


@query("daily_folders", "WITH d AS (SELECT CAST(min(ts) AS DATE) AS lo FROM events) SELECT event_id, user_id FROM events, d WHERE CAST(ts AS DATE) BETWEEN lo AND lo + 1", False)
def daily_folders(spark, sf_dir):
    """Events written to a folder a day; the days of a range that exist are read."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("day", F.to_date("ts"))
    first = e.agg(F.min("day")).first()[0]
    at = scratch(spark)
    some = e.where(F.date_diff("day", F.lit(first)) <= 2)
    for (day,) in some.select("day").distinct().collect():
        some.where(F.col("day") == day).drop("day").write.parquet(f"{at}/{day:%Y/%m/%d}")
    span = DateRange(first - timedelta(days=3), first + timedelta(days=1))
    return readers.read_table(spark, readers.daily_paths(spark, at, DateRange.parse(f"{span.start:%Y%m%d}-{span.end:%Y%m%d}"))).select("event_id", "user_id")


@query("typed_numbers", "SELECT uid, CASE WHEN supplier % 4 = 0 THEN NULL ELSE round(x0, 6) END AS value FROM ex")
def typed_numbers(spark, sf_dir):
    """Numbers in strings; NaN, infinite and unreadable ones are null."""
    odd = F.element_at(F.array(F.lit("NaN"), F.lit("Infinity"), F.lit("-Infinity"), F.lit("x1")), (F.col("supplier") % 16 / 4 + 1).cast("int"))
    d = examples(spark, sf_dir).select("uid", F.when(F.col("supplier") % 4 == 0, odd).otherwise(F.col("x0").cast("string")).alias("s"))
    return d.select("uid", F.round(readers.number(F.col("s")), 6).alias("value"))


@query("name_lists", "SELECT DISTINCT brand AS term, 'brand' AS name FROM ex UNION ALL SELECT DISTINCT status, 'status' FROM ex UNION ALL SELECT '', 'quantity'")
def name_lists(spark, sf_dir):
    at = scratch(spark)
    drivers.build_vocabularies(_bags(spark, sf_dir), ["bag"], at)
    return readers.read_names(spark, f"{at}/bag").select("term", "name")


@query("string_files", "SELECT n_name AS line, CAST(n_nationkey AS INTEGER) AS at FROM nation", False)
def string_files(spark, sf_dir):
    """Lines written twice by atomic replacement; the folder is refused unless it may be replaced."""
    at = scratch(spark)
    names = [r[0] for r in spark.read.parquet(f"{sf_dir}/nation.parquet").orderBy("n_nationkey").select("n_name").collect()]
    writers.write_strings(spark, f"{at}/names", ["stale"])
    try:
        writers.prepare_output(spark, at, False)
        raise AssertionError("an existing folder was not refused")
    except FileExistsError:
        writers.prepare_output(spark, at, True)
    for lines in (["stale"], names):
        writers.write_strings(spark, f"{at}/names", lines)
    return spark.createDataFrame([(x, i) for i, x in enumerate(writers.read_strings(spark, f"{at}/names"))], "line string, at int")


# Sinks and models ----------------------------------------------------------------------------------

@query("training_records_written", " UNION ALL ".join(f"SELECT uid, 'f{i}' AS name, round({x}, 6) AS value, round(response, 6) AS response, weight FROM ex WHERE {x} <> 0" for i, x in enumerate(FEATURES[:4])))
def training_records_written(spark, sf_dir):
    at = scratch(spark)
    writers.write_training(_vectors(spark, sf_dir, "response"), at, _index(spark, False))
    d = readers.read_training_records(spark.read.parquet(at), "RESPONSE_PREDICTION")
    return d.select("uid", F.explode("features").alias("f"), F.round("label", 6).alias("response"), "weight").select("uid", F.col("f.name").alias("name"), F.round("f.value", 6).alias("value"), "response", "weight")


def _saved(spark, sf_dir, at: str, threshold: float = writers.SPARSITY):
    """A saved and loaded model of a fixed effect and a bias by supplier."""
    model = mixed.MixedModel("LOGISTIC_REGRESSION", {"g": mixed.FixedModel("features", np.array(BETA), np.arange(5) + 1.0), "r": mixed.RandomModel("features", "supplier", _entity_models(spark, sf_dir))})
    configs = {"g": Coordinate("g", regularization="L2", weights=(1.0, 10.0)), "r": Coordinate("r", entity="supplier", cap=7)}
    writers.save_model(spark, model, at, {"features": _index(spark)}, configs, threshold)
    return writers.load_model(spark, at, {"features": _index(spark)})


_RE = "WITH m AS (SELECT s_suppkey AS supplier, s_acctbal / 10000 AS bias FROM supplier WHERE s_suppkey % 2 = 0)"
_SPARSE = " + ".join(f"{b} * {x}" for x, b in zip(FEATURES, BETA) if abs(b) > 0.15)


@query("model_round_trip", f'{_RE} SELECT uid, round({_SPARSE} + CASE WHEN abs(bias) > 0.15 THEN bias ELSE 0 END + "offset", 8) AS score FROM ex LEFT JOIN m USING (supplier)')
def model_round_trip(spark, sf_dir):
    m = _saved(spark, sf_dir, scratch(spark), 0.15)
    return m.score(_vectors(spark, sf_dir)).select("uid", F.round(F.coalesce("score", F.lit(0.0)), 8).alias("score"))


@query("model_records", "SELECT name, rank, value FROM (VALUES ('f2', 1, 0.5::DOUBLE), ('(INTERCEPT)', 2, -0.4), ('f0', 3, 0.3), ('f1', 4, -0.2), ('f3', 5, 0.1)) AS t(name, rank, value)", False)
def model_records(spark, sf_dir):
    """Records of the fixed effect: means by size, largest first."""
    at = scratch(spark)
    _saved(spark, sf_dir, at)
    rows = spark.read.parquet(f"{at}/{writers.FIXED}/g/{writers.COEFFICIENTS}")
    return rows.select(F.posexplode("means")).select(F.col("col.name").alias("name"), (F.col("pos") + 1).alias("rank"), F.col("col.value").alias("value"))


@query("model_metadata", "SELECT * FROM (VALUES ('g', 'LOGISTIC_REGRESSION', '10|1', '', true), ('r', 'LOGISTIC_REGRESSION', '', '7', true)) AS t(name, task, weights, cap, in_spec)", False)
def model_metadata(spark, sf_dir):
    at = scratch(spark)
    _saved(spark, sf_dir, at)
    task, configs = writers.load_metadata(spark, at)
    spec = {x.partition(":")[0] for x in writers.read_strings(spark, f"{at}/{writers.SPEC}")}
    rows = [(n, task, "|".join(f"{w:g}" for w in sorted(c.weights, reverse=True)), str(c.cap or ""), n in spec) for n, c in configs.items()]
    return spark.createDataFrame(rows, "name string, task string, weights string, cap string, in_spec boolean")


@query("model_index", "SELECT * FROM (VALUES ('f0', 0, true), ('f1', 1, true), ('f2', 2, true), ('f3', 3, true), ('(INTERCEPT)', 4, true)) AS t(name, idx, has_intercept)", False)
def model_index(spark, sf_dir):
    at = scratch(spark)
    _saved(spark, sf_dir, at)
    rows = spark.read.parquet(f"{at}/{writers.FIXED}/g/{writers.COEFFICIENTS}")
    return writers.model_index(rows).select(keys.name_of(F.col("key")).alias("name"), "idx", F.lit(writers.has_intercept(rows)).alias("has_intercept"))


@query("text_models", "SELECT * FROM (VALUES ('f2', 0.5::DOUBLE, 1.0::DOUBLE), ('f0', 0.3, 1.0), ('f3', 0.1, 1.0), ('f1', -0.2, 1.0), ('(INTERCEPT)', -0.4, 1.0)) AS t(name, value, strength)", False)
def text_models(spark, sf_dir):
    at = scratch(spark)
    writers.write_text_models(spark, at, [(1.0, mixed.FixedModel("features", np.array(BETA)))], _index(spark))
    p = F.split("value", "\t")
    return spark.read.text(at).select(p[0].alias("name"), p[2].cast("double").alias("value"), p[3].cast("double").alias("strength"))


@query("feature_summary_written", " UNION ALL ".join(f"SELECT 'f{i}' AS name, round(avg({x}), 7) AS mean, round(max({x}), 7) AS max, round(min({x}), 7) AS min, CAST(sum(CAST({x} <> 0 AS INTEGER)) AS DOUBLE) AS nnz FROM ex" for i, x in enumerate(FEATURES[:4])))
def feature_summary_written(spark, sf_dir):
    at = scratch(spark)
    writers.write_summary(normalize.statistics(_vectors(spark, sf_dir)), _index(spark), at)
    m = lambda k: F.round(F.element_at("metrics", F.lit(k)), 7).alias(k)
    return spark.read.parquet(at).select(F.col("featureName").alias("name"), m("mean"), m("max"), m("min"), F.element_at("metrics", F.lit("nnz")).alias("nnz"))


@query("scores_written", f"{_SCORED} SELECT uid, label, weight, round(score, 9) AS score, 'm1' AS model, CAST(supplier AS VARCHAR) AS supplier FROM s")
def scores_written(spark, sf_dir):
    at = scratch(spark)
    writers.write_scores(_scored(spark, sf_dir), at, "m1", 4, ("supplier",))
    d = readers.read_scores(spark, at)
    return d.select("uid", "label", "weight", F.round("predictionScore", 9).alias("score"), F.col("modelId").alias("model"), F.element_at("metadataMap", F.lit("supplier")).alias("supplier"))


@query("group_metrics_written", "WITH r AS (SELECT supplier, label, row_number() OVER (PARTITION BY supplier ORDER BY round(response, 4) DESC, uid) AS r FROM ex) SELECT supplier, sum(label) / 5 AS precision FROM r WHERE r <= 5 GROUP BY supplier")
def group_metrics_written(spark, sf_dir):
    at = scratch(spark)
    d = examples(spark, sf_dir).withColumn("score", F.round("response", 4))
    writers.write_group_metrics(evaluate.per_group(d, evaluate.Evaluator.parse("PRECISION@5:supplier"))[0], at)
    return spark.read.parquet(at)


@query("latent_factors", "SELECT CAST(s_suppkey AS VARCHAR) AS id, CAST(k AS INTEGER) AS at, CAST(CASE k WHEN 0 THEN s_acctbal ELSE s_nationkey END AS DOUBLE) AS value FROM supplier, (VALUES (0), (1)) AS t(k)", False)
def latent_factors(spark, sf_dir):
    """Vectors of entities as records and back."""
    at = scratch(spark)
    s = spark.read.parquet(f"{sf_dir}/supplier.parquet").withColumn("v", F.array(F.col("s_acctbal").cast("double"), F.col("s_nationkey").cast("double")))
    writers.latent_factors(s, "s_suppkey", "v").write.parquet(at)
    return spark.read.parquet(at).select(F.col("effectId").alias("id"), F.posexplode("latentFactor")).select("id", F.col("pos").alias("at"), F.col("col").alias("value"))


# Rows, scores and partitions ------------------------------------------------------------------------

@query("finite_features", "SELECT CAST(sum(CASE WHEN supplier % 6 = 0 OR customer % 9 = 0 THEN 1 ELSE 0 END) AS BIGINT) AS invalid FROM ex")
def finite_features(spark, sf_dir):
    v = F.when(F.col("supplier") % 6 == 0, float("nan")).when(F.col("customer") % 9 == 0, float("inf")).otherwise(F.col("x1"))
    d = examples(spark, sf_dir).withColumn("x1", v).withColumn("features", dense(*FEATURES))
    return dataset.violations(d, "LINEAR_REGRESSION", "response").select(F.col("features_invalid").alias("invalid"))


@query("kept_features", "SELECT uid, CAST(idx AS INTEGER) AS idx, round(CASE idx WHEN 1 THEN x1 ELSE x3 END, 7) AS val FROM ex, (VALUES (1), (3)) AS t(idx)")
def kept_features(spark, sf_dir):
    v = dataset.kept_features(dense(*FEATURES), F.array(F.lit(1), F.lit(3), F.lit(77)))
    return examples(spark, sf_dir).select("uid", F.explode(v).alias("x")).select("uid", F.col("x.idx").alias("idx"), F.round("x.val", 7).alias("val"))


_SIDES = "WITH a AS (SELECT uid, label, weight, x0 AS s FROM ex WHERE supplier % 3 <> 0), b AS (SELECT uid, label, weight, x2 AS s FROM ex WHERE supplier % 3 <> 1)"


def _sides(spark, sf_dir):
    d = examples(spark, sf_dir)
    return d.where("supplier % 3 <> 0").select("uid", "label", "weight", F.col("x0").alias("score")), d.where("supplier % 3 <> 1").select("uid", "label", "weight", F.col("x2").alias("score"))


@query("scored_data_plus_minus", f"{_SIDES} SELECT uid, coalesce(a.label, b.label) AS label, coalesce(a.weight, b.weight) AS weight, round(coalesce(a.s, 0) + coalesce(b.s, 0), 7) AS plus, round(coalesce(a.s, 0) - coalesce(b.s, 0), 7) AS minus FROM a FULL JOIN b USING (uid)")
def scored_data_plus_minus(spark, sf_dir):
    a, b = _sides(spark, sf_dir)
    both = scores.plus(a, b, ("label", "weight")).join(scores.minus(a, b).withColumnRenamed("score", "minus"), "uid")
    return both.select("uid", "label", "weight", F.round("score", 7).alias("plus"), F.round("minus", 7).alias("minus"))


@query("scores_equality", f"{_SIDES} SELECT count(*) AS rows, CAST(sum(CASE WHEN a.s IS NULL OR b.s IS NULL OR abs(a.s - b.s) > 0.1 THEN 1 ELSE 0 END) AS BIGINT) AS unequal, CAST(0 AS BIGINT) AS own, (SELECT count(*) FROM supplier WHERE s_suppkey % 2 = 0) AS models FROM a FULL JOIN b USING (uid)")
def scores_equality(spark, sf_dir):
    a, b = _sides(spark, sf_dir)
    m = _entity_models(spark, sf_dir)
    other = m.withColumn("coefficients", F.transform("coefficients", lambda x: F.struct(x["idx"].alias("idx"), (x["mean"] + 1).alias("mean"), x["variance"].alias("variance"))))
    own, models = scores.differences(a, a).select(F.col("unequal").alias("own")), scores.coefficients_differ(m, other, "supplier").select(F.col("unequal").alias("models"))
    return scores.differences(a, b, 0.1).crossJoin(F.broadcast(own)).crossJoin(F.broadcast(models))


@query("labels_with_scores", 'WITH k AS (SELECT uid, x0 AS s FROM ex WHERE supplier % 3 <> 0) SELECT uid, label, round(coalesce(s, 0) + "offset", 9) AS score FROM ex LEFT JOIN k USING (uid)')
def labels_with_scores(spark, sf_dir):
    return scores.with_scores(examples(spark, sf_dir), _sides(spark, sf_dir)[0]).select("uid", "label", F.round("score", 9).alias("score"))


@query("id_map", "WITH r AS (SELECT *, count(*) OVER (PARTITION BY supplier) AS n, row_number() OVER (PARTITION BY supplier ORDER BY md5('s#' || uid) DESC, uid) AS r FROM ex) SELECT uid, CAST(supplier AS VARCHAR) AS supplier FROM r WHERE n >= 50 AND r <= 100")
def id_map(spark, sf_dir):
    return dataset.id_map(dataset.active_passive(examples(spark, sf_dir), "supplier", "s", 100, 50), "supplier")


@query("uid_partitions", "SELECT CAST(abs(o_orderkey - 500) % 7 AS INTEGER) AS part, count(*) AS n FROM orders GROUP BY 1", False)
def uid_partitions(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return d.groupBy(partitioning.uid_partition(F.col("o_orderkey") - 500, 7).alias("part")).agg(F.count("*").alias("n"))


@query("entity_bins", "WITH n AS (SELECT least(count(*), 400) AS n FROM ex GROUP BY supplier) SELECT CAST(count(*) AS BIGINT) AS entities, CAST(sum(n) AS BIGINT) AS load, true AS even FROM n")
def entity_bins(spark, sf_dir):
    """Loads of eight bins; greedy bins differ by no more than the largest entity."""
    d = examples(spark, sf_dir).select("supplier")
    bins = partitioning.even_bins(d, "supplier", 8, 400)
    per = partitioning.with_bin(d, "supplier", 8, bins).groupBy("bin", "supplier").agg(F.least(F.count("*"), F.lit(400)).alias("n"))
    by_bin = per.groupBy("bin").agg(F.count("*").alias("e"), F.sum("n").alias("load"), F.max("n").alias("most"))
    return by_bin.agg(F.sum("e").alias("entities"), F.sum("load").alias("load"), (F.max("load") - F.min("load") <= F.max("most")).alias("even"))


@query("resized_partitions", "SELECT CAST(3 AS INTEGER) AS fewer, CAST(40 AS INTEGER) AS more, count(*) AS n FROM orders", False)
def resized_partitions(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/orders.parquet").repartition(12)
    fewer, more = partitioning.resized(d, 3), partitioning.resized(d, 40)
    return partitioning.by_entity(fewer, "o_custkey", 5).agg(F.lit(fewer.rdd.getNumPartitions()).alias("fewer"), F.lit(more.rdd.getNumPartitions()).alias("more"), F.count("*").alias("n"))


_DRAW = "CAST(('0x' || substr(md5('7#' || uid), 1, 13)) AS BIGINT) / 4503599627370496.0"


@query("sampler_by_task", f"SELECT 'binary' AS kind, count(*) AS n FROM ex WHERE label >= 0.5 OR {_DRAW} < 0.25 UNION ALL SELECT 'other', count(*) FROM ex WHERE {_DRAW} < 0.25 UNION ALL SELECT 'none', count(*) FROM ex")
def sampler_by_task(spark, sf_dir):
    d, out = examples(spark, sf_dir), None
    for kind, task, rate in (("binary", "SMOOTHED_HINGE_LOSS_LINEAR_SVM", 0.25), ("other", "POISSON_REGRESSION", 0.25), ("none", "LINEAR_REGRESSION", 1)):
        now = dataset.sampler(task, rate, 7, F.col("uid"))(d).agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), "n")
        out = now if out is None else out.unionByName(now)
    return out


_PER = "WITH r AS (SELECT *, count(*) OVER (PARTITION BY supplier) AS n, row_number() OVER (PARTITION BY supplier ORDER BY md5('s#' || uid) DESC, uid) AS r FROM ex), p AS (SELECT supplier, sum(CAST(r <= 100 AS BIGINT)) AS a, sum(CAST(r > 100 AS BIGINT)) AS p, sum(CASE WHEN r <= 100 THEN weight * CASE WHEN n > 100 THEN n / 100.0 ELSE 1 END END) AS w FROM r WHERE n >= 50 GROUP BY supplier)"


@query("random_effect_summary", f"{_PER} SELECT CAST(sum(a) AS BIGINT) AS active, CAST(sum(p) AS BIGINT) AS passive, count(*) AS entities, round(sum(w), 4) AS weight_sum, round(avg(a), 7) AS mean_active, round(stddev_pop(a), 7) AS stddev_active, CAST(min(a) AS BIGINT) AS min_active, CAST(max(a) AS BIGINT) AS max_active FROM p")
def random_effect_summary(spark, sf_dir):
    s = dataset.random_summary(dataset.active_passive(examples(spark, sf_dir), "supplier", "s", 100, 50), "supplier")
    return s.select("active", "passive", "entities", F.round("weight_sum", 4).alias("weight_sum"), F.round("mean_active", 7).alias("mean_active"), F.round("stddev_active", 7).alias("stddev_active"), "min_active", "max_active")


@query("scoring_summary", "WITH p AS (SELECT supplier, count(*) AS n FROM ex GROUP BY supplier) SELECT CAST(sum(n) AS BIGINT) AS rows, count(*) AS entities, round(avg(n), 7) AS mean, round(stddev_pop(n), 7) AS stddev, min(n) AS min, max(n) AS max FROM p")
def scoring_summary(spark, sf_dir):
    return _round(drivers.dataset_summary(examples(spark, sf_dir), "supplier"), 7)


@query("random_model_summary", f"{_RE} SELECT count(*) AS entities, CAST(1.0 AS DOUBLE) AS mean_length, CAST(1 AS INTEGER) AS max_length, round(avg(abs(bias)), 7) AS mean_norm, round(max(abs(bias)), 7) AS max_norm FROM m")
def random_model_summary(spark, sf_dir):
    return _round(mixed.RandomModel("features", "supplier", _entity_models(spark, sf_dir)).summary(), 7)


@query("numeric_helpers", "SELECT uid, abs(x1) < 1e-12 AS zero, CAST(CASE WHEN abs(x0 - x2) < 1e-12 THEN 0 WHEN x0 < x2 THEN -1 ELSE 1 END AS INTEGER) AS compared, CAST(CASE WHEN brand = status THEN 0 ELSE 2 END AS INTEGER) AS apart, round(ln(1 + exp(x0 - x2)), 7) AS softplus FROM ex")
def numeric_helpers(spark, sf_dir):
    f = F.col
    apart = F.size(keys.symmetric_difference(F.array("brand", F.lit("k")), F.array("status", F.lit("k"))))
    return examples(spark, sf_dir).select("uid", keys.almost_zero(f("x1")).alias("zero"), keys.compared(f("x0"), f("x2")).alias("compared"), apart.alias("apart"), F.round(losses.softplus(f("x0") - f("x2")), 7).alias("softplus"))


# Indexes and normalization ----------------------------------------------------------------------------

@query("identity_index", "SELECT CAST(i AS VARCHAR) AS name, CAST(i AS INTEGER) AS idx FROM range(9) AS t(i) UNION ALL SELECT '(INTERCEPT)', 9", False)
def identity_index(spark, sf_dir):
    return indexing.identity_index(9, spark, True).select(keys.name_of(F.col("key")).alias("name"), "idx")


_WORDS = "WITH f AS (SELECT DISTINCT 'brand' AS name, brand AS term FROM ex UNION SELECT DISTINCT 'status', status FROM ex UNION SELECT 'quantity', ''), i AS (SELECT name, term, row_number() OVER (ORDER BY name || chr(1) || term) - 1 AS idx FROM f) SELECT name, term, CAST(idx AS INTEGER) AS idx FROM i UNION ALL SELECT '(INTERCEPT)', '', CAST(count(*) AS INTEGER) FROM i"


def _named_index(d: DataFrame) -> DataFrame:
    return d.select(keys.name_of(F.col("key")).alias("name"), keys.term_of(F.col("key")).alias("term"), "idx")


@query("index_job", _WORDS)
def index_job(spark, sf_dir):
    at, shards = scratch(spark), [Shard("s", ("bag",))]
    drivers.build_indexes(spark, _bags(spark, sf_dir), shards, at)
    return _named_index(drivers.load_indexes(spark, at, shards)["s"])


@query("vocabulary_index", _WORDS)
def vocabulary_index(spark, sf_dir):
    at = scratch(spark)
    drivers.build_vocabularies(_bags(spark, sf_dir), ["bag"], at)
    return _named_index(drivers.vocabulary_indexes(spark, at, [Shard("s", ("bag",))])["s"])


_MOMENTS = "WITH l AS (" + " UNION ALL ".join(f"SELECT {i} AS idx, {b} AS b, {x} AS v FROM ex" for i, (x, b) in enumerate(zip(FEATURES, BETA))) + "), t AS (SELECT idx, any_value(b) AS b, CASE WHEN idx = 4 THEN 0.0 ELSE avg(v) END AS m, CASE WHEN idx = 4 THEN 1.0 ELSE sqrt(var_samp(v)) END AS s FROM l GROUP BY idx)"


@query("coef_to_transformed_space", f"{_MOMENTS} SELECT CAST(idx AS INTEGER) AS idx, round((b + CASE WHEN idx = 4 THEN (SELECT sum(b * m) FROM t) ELSE 0 END) * s, 6) AS coefficient, round((b + 1) * s * s, 6) AS variance FROM t")
def coef_to_transformed_space(spark, sf_dir):
    norm = normalize.Normalization.build(normalize.STANDARDIZATION, normalize.statistics(_vectors(spark, sf_dir)), 5, 4)
    b = np.array(BETA)
    rows = [(i, float(x), float(v)) for i, (x, v) in enumerate(zip(norm.to_transformed(b), norm.variances_to_transformed(b + 1)))]
    return _round(spark.createDataFrame(rows, "idx int, coefficient double, variance double"))


@query("projected_context", f"{_MOMENTS} SELECT CAST(row_number() OVER (ORDER BY idx) - 1 AS INTEGER) AS at, round(1 / s, 6) AS factor, round(m, 6) AS shift FROM t WHERE idx IN (1, 3, 4)")
def projected_context(spark, sf_dir):
    norm = normalize.Normalization.build(normalize.STANDARDIZATION, normalize.statistics(_vectors(spark, sf_dir)), 5, 4).project(np.array([1, 3, 4]))
    assert norm.intercept == 2
    return _round(spark.createDataFrame([(i, float(f), float(s)) for i, (f, s) in enumerate(zip(norm.factors, norm.shifts))], "at int, factor double, shift double"))


@query("constraints_from_json", "SELECT * FROM (VALUES (0, -1.0::DOUBLE, 2.0::DOUBLE), (1, 0.0, 1e300), (2, 0.0, 1e300)) AS t(idx, low, high)", False)
def constraints_from_json(spark, sf_dir):
    index = [("a\x01x", 0), ("b\x01y", 1), ("b\x01z", 2), ("c\x01", 3), (INTERCEPT + SEPARATOR, 4)]
    text = '[{"name": "a", "term": "x", "lowerBound": -1, "upperBound": 2}, {"name": "b", "term": "*", "lowerBound": 0}, {"name": "gone", "term": "", "upperBound": 0}]'
    found = config.box_constraints(text, index, 4)
    return spark.createDataFrame([(i, lo, min(hi, 1e300)) for i, (lo, hi) in found.items()], "idx int, low double, high double")


# Training: residuals of the optimality conditions ------------------------------------------------------

def _optimality(spark, sf_dir, task, label, l1=0.0, l2=0.0, bounds=None, solution=None) -> DataFrame:
    """Largest violation of the first-order conditions at a solution, against the gradient at zero, in steps of 1e-3."""
    o = objective.Distributed(losses.TASKS[task], _vectors(spark, sf_dir, label), 5, objective.Penalty(l2, 4))
    b, g = np.asarray(solution), o.value_gradient(np.asarray(solution))[1]
    worst = np.where(b != 0, np.abs(g + l1 * np.sign(b)), np.maximum(np.abs(g) - l1, 0))
    for i, (low, high) in (bounds or {}).items():
        worst[i] = max(0.0, -g[i]) if b[i] <= low else max(0.0, g[i]) if b[i] >= high else abs(g[i])
    scale = np.abs(o.value_gradient(np.zeros(5))[1]).max()
    inside = all(low <= b[i] <= high for i, (low, high) in (bounds or {}).items())
    return spark.createDataFrame([(float(np.floor(worst.max() / scale * 1e3)), inside)], "residual double, inside boolean")


for _name, _task, _label, _options, _terms in (
    ("lbfgs", "LOGISTIC_REGRESSION", "label", {"regularization": "L2", "weight": 1.0}, {"l2": 1.0}),
    ("tron", "LOGISTIC_REGRESSION", "label", {"optimizer": "TRON", "regularization": "L2", "weight": 1.0, "max_iterations": 30}, {"l2": 1.0}),
    ("poisson", "POISSON_REGRESSION", "counts", {"regularization": "L2", "weight": 1.0, "max_iterations": 200}, {"l2": 1.0}),
    ("svm", "SMOOTHED_HINGE_LOSS_LINEAR_SVM", "label", {"regularization": "L2", "weight": 1.0}, {"l2": 1.0}),
    ("owlqn", "LOGISTIC_REGRESSION", "label", {"regularization": "ELASTIC_NET", "alpha": 0.5, "weight": 50.0}, {"l1": 25.0, "l2": 25.0}),
    ("lbfgsb", "LOGISTIC_REGRESSION", "label", {"optimizer": "LBFGSB", "bounds": {0: (-0.05, 0.05), 2: (0.0, 0.1)}}, {"bounds": {0: (-0.05, 0.05), 2: (0.0, 0.1)}}),
):

    @query(f"optimal_{_name}", "SELECT CAST(0.0 AS DOUBLE) AS residual, true AS inside", False)
    def _optimal(spark, sf_dir, task=_task, label=_label, options=_options, terms=_terms):
        c = mixed.FixedCoordinate(Coordinate("g", **({"tolerance": 1e-9, "max_iterations": 100} | options)), task, 5, intercept=4)
        return _optimality(spark, sf_dir, task, label, solution=c.train(_vectors(spark, sf_dir, label), F.col("offset")).means, **terms)


_MEAN = '(SELECT sum(weight * (response - "offset")) AS s, sum(weight) AS w FROM ex)'


@query("path_closed_form", "SELECT l.strength AS strength, round(s / (w + l.strength), 6) AS bias FROM " + _MEAN + ", (VALUES (1000.0::DOUBLE), (10.0), (0.1)) AS l(strength)")
def path_closed_form(spark, sf_dir):
    """A path of weights, largest first, each from the one before."""
    d = _two(spark, sf_dir).persist()
    path = mixed.regularization_path(d, Coordinate("g", "bias", regularization="L2", tolerance=1e-13, max_iterations=100), "LINEAR_REGRESSION", [0.1, 1000.0, 10.0], size=1)
    assert [w for w, *_ in path] == [1000.0, 10.0, 0.1] and all(r.reason and r.states for *_, r in path)
    return _round(spark.createDataFrame([(w, float(m.means[0])) for w, m, _ in path], "strength double, bias double"))


@query("incremental_closed_form", 'WITH a AS (SELECT sum(weight * (response - "offset")) / sum(weight) AS m, 1 / sum(weight) AS v FROM ex WHERE supplier % 2 = 0), b AS (SELECT sum(weight * (response - "offset")) AS s, sum(weight) AS w FROM ex WHERE supplier % 2 = 1) SELECT round(m, 6) AS before, round((s + m / v) / (w + 1 / v), 6) AS after FROM a, b')
def incremental_closed_form(spark, sf_dir):
    """A bias trained on half of the rows is the other half's prior: precisions add up."""
    d = _two(spark, sf_dir).persist()
    c = [Coordinate("g", "bias", tolerance=1e-13, max_iterations=100)]
    old = mixed.Estimator("LINEAR_REGRESSION", c, variance="SIMPLE").fit(d.where("supplier % 2 = 0"))[0][1].model
    new = mixed.Estimator("LINEAR_REGRESSION", c, variance="SIMPLE", initial=old, incremental=True).fit(d.where("supplier % 2 = 1"))[0][1].model
    return _round(spark.createDataFrame([(float(old.models["g"].means[0]), float(new.models["g"].means[0]))], "before double, after double"))


_LOCKED = 'SELECT CAST(supplier AS VARCHAR) AS supplier, round(sum(weight * (response - "offset" - 0.25)) / (sum(weight) + 2), 6) AS bias FROM ex GROUP BY supplier'


@query("partial_retrain_closed_form", _LOCKED)
def partial_retrain_closed_form(spark, sf_dir):
    """A locked fixed effect scores with its first model; the entities are trained on what it leaves."""
    d = _two(spark, sf_dir).withColumn("supplier", F.col("supplier").cast("string")).persist()
    first = mixed.MixedModel("LINEAR_REGRESSION", {"g": mixed.FixedModel("bias", np.array([0.25]))})
    c = [Coordinate("g", "bias"), Coordinate("r", "bias", "supplier", regularization="L2", weights=(2.0,), tolerance=1e-12)]
    model = mixed.Estimator("LINEAR_REGRESSION", c, passes=3, initial=first, locked=("g",)).fit(d)[0][1].model
    return model.models["r"].table.select("supplier", F.round(F.col("coefficients")[0]["mean"], 6).alias("bias"))


@query("entity_prior_join", 'WITH p AS (SELECT s_suppkey AS supplier, s_acctbal / 10000 AS m FROM supplier WHERE s_suppkey % 2 = 0), t AS (SELECT supplier, sum(weight * (response - "offset")) AS s, sum(weight) AS w FROM ex GROUP BY supplier) SELECT CAST(supplier AS VARCHAR) AS supplier, round(CASE WHEN t.s IS NULL THEN p.m WHEN p.m IS NULL THEN t.s / (t.w + 2) ELSE (t.s + p.m / 0.25) / (t.w + 4) END, 5) AS bias FROM t FULL JOIN p USING (supplier)')
def entity_prior_join(spark, sf_dir):
    """Earlier entity models as priors: entities without one have none, entities without rows keep theirs."""
    d = _two(spark, sf_dir).withColumn("supplier", F.col("supplier").cast("string"))
    s = spark.read.parquet(f"{sf_dir}/supplier.parquet").where("s_suppkey % 2 = 0")
    old = s.select(F.col("s_suppkey").cast("string").alias("supplier"), F.array(F.struct(F.lit(0).alias("idx"), (F.col("s_acctbal") / 10000).alias("mean"), F.lit(0.25).alias("variance"))).alias("coefficients"))
    c = mixed.RandomCoordinate(Coordinate("r", "bias", "supplier", regularization="L2", weight=2.0, tolerance=1e-13, max_iterations=100), "LINEAR_REGRESSION", variance="SIMPLE")
    m = c.train(c.rows(d), F.col("offset"), prior=mixed.RandomModel("bias", "supplier", old))
    return m.table.select("supplier", F.round(F.col("coefficients")[0]["mean"], 5).alias("bias"))


@query("tracker_summary", "SELECT count(DISTINCT supplier) AS entities, true AS reasons FROM ex")
def tracker_summary(spark, sf_dir):
    c = mixed.RandomCoordinate(Coordinate("r", "bias", "supplier", regularization="L2", weight=2.0), "LINEAR_REGRESSION")
    c.train(c.rows(_two(spark, sf_dir)), F.col("offset"))
    known = F.col("reason").isin("GRADIENT_CONVERGED", "FUNCTION_VALUES_CONVERGED", "OBJECTIVE_NOT_IMPROVING", "MAX_ITERATIONS")
    return c.trackers.agg(F.sum("entities").alias("entities"), F.every(known & (F.col("max_iterations") > 0)).alias("reasons"))


@query("not_finite_coefficients", "SELECT 'coefficients [0] are not finite' AS said", False)
def not_finite_coefficients(spark, sf_dir):
    d = spark.createDataFrame([(1.0, 0.0, 1.0, [(0, 1.0)])], f"label double, offset double, weight double, features {VECTOR}")
    try:
        mixed.FixedCoordinate(Coordinate("g", max_iterations=2), "LINEAR_REGRESSION", 1).train(d, F.col("offset"), mixed.FixedModel("features", np.array([float("nan")])))
        said = "nothing"
    except ArithmeticError as e:
        said = str(e)
    return spark.createDataFrame([(said,)], "said string")


@query("penalty_value", f"SELECT round({0.5 * sum(map(abs, BETA)) + 0.75 * sum(b * b for b in BETA)!r}::DOUBLE, 9) AS value", False)
def penalty_value(spark, sf_dir):
    return _round(spark.createDataFrame([(objective.penalty_term(np.array(BETA), 0.5, 1.5),)], "value double"), 9)


# Estimation, selection and evaluation ------------------------------------------------------------------

_GRID = "l AS (SELECT * FROM (VALUES (1000000.0::DOUBLE), (100.0), (1.0)) AS l(strength)), t AS (SELECT sum(weight * (response - \"offset\")) AS s, sum(weight) AS w FROM ex WHERE supplier % 4 <> 0), b AS (SELECT strength, s / (w + strength) AS b FROM t, l), h AS (SELECT strength, sqrt(sum(weight * (b + \"offset\" - response) * (b + \"offset\" - response)) / count(*)) AS rmse FROM ex, b WHERE supplier % 4 = 0 GROUP BY strength)"


def _grid_fit(spark, sf_dir):
    d = _two(spark, sf_dir)
    est = mixed.Estimator("LINEAR_REGRESSION", [Coordinate("g", "bias", regularization="L2", weights=(1.0, 1e6, 100.0), tolerance=1e-13, max_iterations=100)], evaluators=["RMSE"])
    return est, est.fit(d.where("supplier % 4 <> 0").persist(), d.where("supplier % 4 = 0").persist())


@query("grid_of_weights", f"WITH {_GRID} SELECT strength, round(rmse, 6) AS rmse FROM h")
def grid_of_weights(spark, sf_dir):
    _, found = _grid_fit(spark, sf_dir)
    assert [c["g"].weight for c, _ in found] == [1e6, 100.0, 1.0]
    return _round(spark.createDataFrame([(c["g"].weight, r.metrics["RMSE"]) for c, r in found], "strength double, rmse double"))


@query("best_of_grid", f"WITH {_GRID} SELECT strength, round(rmse, 6) AS rmse FROM h ORDER BY h.rmse LIMIT 1")
def best_of_grid(spark, sf_dir):
    est, found = _grid_fit(spark, sf_dir)
    config_, best = est.best(found)
    return _round(spark.createDataFrame([(config_["g"].weight, best.metrics["RMSE"])], "strength double, rmse double"))


@query("evaluation_suite", f"{_SCORED}, r AS (SELECT *, row_number() OVER (PARTITION BY supplier ORDER BY score DESC, uid) AS r FROM s), g AS (SELECT sum(label) / 10 AS p FROM r WHERE r <= 10 GROUP BY supplier) SELECT round(sqrt(sum(weight * (score - label) * (score - label)) / count(*)), 6) AS rmse, round(sum(weight * CASE WHEN label > 0.5 THEN ln(1 + exp(-score)) ELSE ln(1 + exp(score)) END) / 1000, 5) AS logistic_loss, (SELECT round(avg(p), 6) FROM g) AS precision FROM s")
def evaluation_suite(spark, sf_dir):
    """A transformer's metrics: several evaluators of one scored table, the first the primary one."""
    model = mixed.MixedModel("LOGISTIC_REGRESSION", {"g": mixed.FixedModel("features", np.array(BETA))})
    found = mixed.Transformer(model, ["RMSE", "LOGISTIC_LOSS", "PRECISION@10:supplier"]).evaluate(_vectors(spark, sf_dir))
    assert list(found) == ["RMSE", "LOGISTIC_LOSS", "PRECISION@10:supplier"]
    return spark.createDataFrame([(found["RMSE"], found["LOGISTIC_LOSS"] / 1000, found["PRECISION@10:supplier"])], "rmse double, logistic_loss double, precision double").select(F.round("rmse", 6).alias("rmse"), F.round("logistic_loss", 5).alias("logistic_loss"), F.round("precision", 6).alias("precision"))


@query("evaluators", "SELECT * FROM (VALUES ('AUC', 'AUC', true), ('AUC:shop', 'AUC', true), ('PRECISION@7:shop', 'PRECISION', true), ('RMSE', 'RMSE', false), ('POISSON_LOSS', 'POISSON_LOSS', false)) AS t(name, base, larger)", False)
def evaluators(spark, sf_dir):
    """Names, kinds and directions, those of the tasks' own among them."""
    named = {evaluate.DEFAULT[t] for t in evaluate.DEFAULT} | {"AUC:shop", "PRECISION@7:shop"}
    parsed = [evaluate.Evaluator.parse(n) for n in sorted(named)]
    return spark.createDataFrame([(e.name, e.base, e.better(2.0, 1.0)) for e in parsed], "name string, base string, larger boolean")


@query("descent_history", 'WITH t AS (SELECT sum(weight * (response - "offset")) / sum(weight) AS b FROM ex WHERE supplier % 4 <> 0) SELECT CAST(0 AS INTEGER) AS pass, \'g\' AS coordinate, round(sqrt(sum(weight * (b + "offset" - response) * (b + "offset" - response)) / count(*)), 5) AS rmse FROM ex, t WHERE supplier % 4 = 0')
def descent_history(spark, sf_dir):
    """One coordinate is one pass; its update is evaluated on the held-out rows."""
    d = _two(spark, sf_dir)
    est = mixed.Estimator("LINEAR_REGRESSION", [Coordinate("g", "bias", tolerance=1e-13, max_iterations=100)], passes=4, evaluators=["RMSE"])
    out = est.fit(d.where("supplier % 4 <> 0").persist(), d.where("supplier % 4 = 0").persist())[0][1]
    return spark.createDataFrame([(h["pass"], h["coordinate"], h["RMSE"]) for h in out.history], "pass int, coordinate string, rmse double").select("pass", "coordinate", F.round("rmse", 5).alias("rmse"))


# Tuning -----------------------------------------------------------------------------------------------

_POINTS = [(0.1, 0.9), (0.4, 0.2), (0.75, 0.5)]
_POINTS_SQL = "(VALUES " + ", ".join(f"({i}, {a}::DOUBLE, {b}::DOUBLE)" for i, (a, b) in enumerate(_POINTS)) + ")"


@query("kernels", f"WITH p AS (SELECT a.i AS i, b.i AS j, ((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) / 0.25) AS d FROM {_POINTS_SQL} AS a(i, x, y), {_POINTS_SQL} AS b(i, x, y)) SELECT CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j, round(2 * (1 + sqrt(5 * d) + 5 * d / 3) * exp(-sqrt(5 * d)), 8) AS matern, round(2 * exp(-d / 2), 8) AS rbf FROM p", False)
def kernels(spark, sf_dir):
    x = np.array(_POINTS)
    m, r = (tuning.Kernel(2.0, scales=(1.0, 0.5), kind=k)(x, x) for k in ("matern52", "rbf"))
    return _round(spark.createDataFrame([(i, j, float(m[i, j]), float(r[i, j])) for i in range(3) for j in range(3)], "i int, j int, matern double, rbf double"), 8)


@query("gaussian_process", "SELECT CAST(i AS INTEGER) AS i, round(v, 3) AS mean, true AS narrow FROM (VALUES (0, 1.0::DOUBLE), (1, 3.0), (2, 2.0)) AS t(i, v)", False)
def gaussian_process(spark, sf_dir):
    """A process without noise passes through what it has seen."""
    x = np.array(_POINTS)
    mean, var = tuning.GaussianProcess(x, np.array([1.0, 3.0, 2.0]), noisy=False, burn_in=30).predict(x)
    return spark.createDataFrame([(i, round(float(m), 3), bool(v < 1e-3)) for i, (m, v) in enumerate(zip(mean, var))], "i int, mean double, narrow boolean")


@query("acquisition", "SELECT CAST(round(bound, 9) AS DOUBLE) AS bound, true AS falls FROM (SELECT 1.0 - 2 * sqrt(0.25) AS bound)", False)
def acquisition(spark, sf_dir):
    """Lower confidence bound; improvement falls as the mean rises and is nothing without variance."""
    ei = tuning.expected_improvement(1.0)(np.array([0.0, 0.5, 2.0, 3.0]), np.array([0.25, 0.25, 0.25, 0.0]))
    bound = float(tuning.confidence_bound()(np.array([1.0]), np.array([0.25]))[0])
    return spark.createDataFrame([(round(bound, 9), bool((np.diff(ei) < 0).all() and abs(ei[3]) < 1e-9))], "bound double, falls boolean")


@query("rescaling", "SELECT name, round((f(v) - f(lo)) / (f(hi) + extra - f(lo)), 9) AS scaled, v AS back FROM (SELECT 'log' AS name, log10(10.0) AS fv, log10(0.01) AS flo, log10(1000.0) AS fhi, 0 AS extra, 10.0::DOUBLE AS v) AS a".replace("f(v)", "fv").replace("f(lo)", "flo").replace("f(hi)", "fhi") + " UNION ALL SELECT 'root', round((sqrt(9.0) - 1) / (4 - 1), 9), 9.0 UNION ALL SELECT 'count', round((3.0 - 1) / (5 + 1 - 1), 9), 3.0", False)
def rescaling(spark, sf_dir):
    text = '{"tuning_mode": "bayesian", "variables": {"log": {"min": 0.01, "max": 1000, "transform": "LOG"}, "root": {"min": 1, "max": 16, "transform": "SQRT"}, "count": {"type": "INT", "min": 1, "max": 5}}}'
    parsed = tuning.SearchConfig.from_json(text)
    assert parsed.mode == "BAYESIAN"
    values = {"log": 10.0, "root": 9.0, "count": 3.0}
    return spark.createDataFrame([(v.name, round(v.scale(values[v.name]), 9), round(v.unscale(v.scale(values[v.name])), 9)) for v in parsed.variables], "name string, scaled double, back double")


@query("discretization", "SELECT CAST(i AS INTEGER) AS i, floor(x * 4) / 4 AS x, y FROM " + _POINTS_SQL + " AS t(i, x, y)", False)
def discretization(spark, sf_dir):
    return spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(tuning.discretize(np.array(_POINTS), {0: 4}))], "i int, x double, y double")


@query("tuning_priors", "SELECT * FROM (VALUES (0, 0.5::DOUBLE, 0.25::DOUBLE, 0.9::DOUBLE), (1, 0.5, 0.75, 0.8)) AS t(i, a, b, value)", False)
def tuning_priors(spark, sf_dir):
    """Earlier observations as scaled points; what they lack is the default's; ranges shrink inside their own."""
    c = tuning.SearchConfig("RANDOM", (tuning.Variable("a", 1e-2, 1e2, "LOG"), tuning.Variable("b", 0.0, 4.0)))
    seen = c.priors('{"records": [{"a": 1, "b": 1, "evaluationValue": 0.9}, {"b": "3", "evaluationValue": 0.8}]}', {"a": 1.0})
    narrow = tuning.shrink(c, seen, 0.2, pool=50)
    assert all(v.low <= narrow[v.name][0] <= narrow[v.name][1] <= v.high for v in c.variables)
    return spark.createDataFrame([(i, *map(float, p), v) for i, (p, v) in enumerate(seen)], "i int, a double, b double, value double")


@query("search_finds", "SELECT * FROM (VALUES ('BAYESIAN', 12, true), ('DUMMY', 0, true), ('RANDOM', 12, true)) AS t(tuner, n, near)", False)
def search_finds(spark, sf_dir):
    """Searches of a bowl: so many observations, the best of them near its bottom."""
    bowl = lambda x: (float(((x - 0.3) ** 2).sum()), None)
    out = []
    for mode in ("RANDOM", "BAYESIAN"):
        found = tuning.tuner("BUILTIN")(12, 2, mode, bowl, seed=3)
        out.append((mode, len(found), min(v for _, v, _ in found) < 0.08))
    out.append(("DUMMY", len(tuning.tuner("DUMMY")(12, 2, "RANDOM", bowl)), True))
    return spark.createDataFrame(out, "tuner string, n int, near boolean")


@query("estimator_function", f"WITH {_GRID.replace('1000000.0', '0.01')} SELECT round(strength, 6) AS strength, round(rmse, 6) AS rmse FROM h")
def estimator_function(spark, sf_dir):
    """An estimator as a function of the unit interval: the ends and the middle of ln(weight)."""
    d = _two(spark, sf_dir)
    base = {"g": Coordinate("g", "bias", regularization="L2", weight_range=(0.01, 100.0), tolerance=1e-13, max_iterations=100)}
    est = mixed.Estimator("LINEAR_REGRESSION", list(base.values()), evaluators=["RMSE"])
    f = tuning.EstimatorFunction(est, base, d.where("supplier % 4 <> 0").persist(), d.where("supplier % 4 = 0").persist(), False)
    rows = [(float(f.configuration(np.array([x]))["g"].weight), float(f(np.array([x]))[0])) for x in (0.0, 0.5, 1.0)]
    return _round(spark.createDataFrame(rows, "strength double, rmse double"))


# Jobs -------------------------------------------------------------------------------------------------

@query("training_and_scoring_jobs", 'WITH b AS (SELECT sum(weight * (response - "offset")) / sum(weight) AS b FROM ex) SELECT uid, round(b + "offset", 5) AS score, \'job\' AS model FROM ex, b')
def training_and_scoring_jobs(spark, sf_dir):
    """Rows through the training driver and, with the model it saved, the scoring driver."""
    at = scratch(spark)
    d = examples(spark, sf_dir).select("uid", "response", "offset", "weight", F.array().cast(keys.NAMED).alias("bag")).persist()
    shards, index = [Shard("s", ("bag",))], {"s": spark.createDataFrame([(INTERCEPT + SEPARATOR, 0)], "key string, idx int")}
    heard = []
    drivers.train(spark, d, f"{at}/out", "LINEAR_REGRESSION", shards, [Coordinate("g", "s", tolerance=1e-13, max_iterations=100)], d, evaluators=["RMSE"], indexes=index, validate="FULL", events=drivers.Events([lambda e, _: heard.append(e), lambda *_: 1 / 0]))
    assert heard == ["setup", "start", "optimization", "finish"]
    drivers.score(spark, d, f"{at}/out/best", f"{at}/scores", shards, index, ["RMSE"], "job")
    return readers.read_scores(spark, f"{at}/scores").select("uid", F.round("predictionScore", 5).alias("score"), F.col("modelId").alias("model"))


@query("single_model_job", f"WITH l AS (SELECT * FROM (VALUES (1000000.0::DOUBLE), (1.0)) AS l(strength)), t AS (SELECT sum(weight * (response - \"offset\")) AS s, sum(weight) AS w FROM ex), b AS (SELECT strength, s / (w + strength) AS b FROM t, l) SELECT strength, round(sqrt(avg((b + \"offset\" - response) * (b + \"offset\" - response))), 5) AS rmse, round(b, 5) AS bias FROM ex, b GROUP BY strength, b ORDER BY 2 LIMIT 1")
def single_model_job(spark, sf_dir):
    """The single-model driver: a path of weights, text models, and the best by its validation metric."""
    at = scratch(spark)
    d = _two(spark, sf_dir).select("uid", "label", "offset", "weight", F.col("bias").alias("features"))
    index = spark.createDataFrame([(f"bias{SEPARATOR}", 0)], "key string, idx int")
    weight, _, metrics = drivers.train_single(spark, d, at, "LINEAR_REGRESSION", [1.0, 1e6], 1, index, d, max_iterations=100, tolerance=1e-13)
    p = F.split("value", "\t")
    best = spark.read.text(f"{at}/best-model-text").select(p[3].cast("double").alias("strength"), p[2].cast("double").alias("bias"))
    assert spark.read.text(f"{at}/learned-models-text").count() == 2 and math.isfinite(metrics["rmse"]) and weight == best.first()["strength"]
    return best.select("strength", F.round(F.lit(metrics["rmse"]), 5).alias("rmse"), F.round("bias", 5).alias("bias"))


@query("single_model_command_line", "WITH l AS (SELECT * FROM (VALUES (1000000.0::DOUBLE), (1.0)) AS l(strength)), t AS (SELECT sum(weight * (response - \"offset\")) AS s, sum(weight) AS w FROM ex WHERE weight > 0), b AS (SELECT strength, s / (w + strength) AS b FROM t, l) SELECT strength, round(sqrt(avg((b + \"offset\" - response) * (b + \"offset\" - response))), 5) AS rmse, round(b, 5) AS bias FROM ex, b WHERE weight > 0 GROUP BY strength, b ORDER BY 2 LIMIT 1")
def single_model_command_line(spark, sf_dir):
    """The single-model job by its options, from Avro records: both weights are trained, the best by its metric is written."""
    spark.dataSource.register(AvroSource)
    at = scratch(spark)
    named = F.array(F.struct(F.lit("one").alias("name"), F.lit("").alias("term"), F.lit(1.0).alias("value")))
    _two(spark, sf_dir).select(F.col("uid").cast("string").alias("uid"), F.col("label").alias("response"), named.alias("features"), "offset", "weight").write.format(AvroSource.name()).mode("append").save(f"{at}/in")
    job = single.main([
        "--training-data-directory", f"{at}/in", "--validating-data-directory", f"{at}/in", "--output-directory", f"{at}/out", "--task", "linear_regression", "--intercept", "false",
        "--regularization-weights", "1000000,1", "--num-iterations", "100", "--convergence-tolerance", "1e-13",
    ])
    p = F.split("value", "\t")
    best = spark.read.text(f"{at}/out/best-model-text").select(p[3].cast("double").alias("strength"), p[2].cast("double").alias("bias"))
    return best.select("strength", F.round(F.lit(job.metrics[job.best[0]]["rmse"]), 5).alias("rmse"), F.round("bias", 5).alias("bias"))


@query("coordinate_language", "SELECT * FROM (VALUES ('fixed', '', 'TRON', '10|1', 0.5::DOUBLE, 0), ('user', 'userId', 'LBFGS', '3', 1.0, 100)) AS t(name, entity, optimizer, weights, rate, cap)", False)
def coordinate_language(spark, sf_dir):
    """Configurations written in the command line's language, printed and read again."""
    texts = ("name=fixed,feature.shard=g,optimizer=TRON,regularization=L2,reg.weights=1|10,down.sampling.rate=0.5", "name=user,feature.shard=u,random.effect.type=userId,active.data.upper.bound=100,regularization=L2,reg.weights=3")
    parsed = [Coordinate.parse(str(Coordinate.parse(t))) for t in texts]
    rows = [(c.name, c.entity or "", c.optimizer, "|".join(f"{x.weight:g}" for x in c.expanded()), c.down_sampling_rate, c.cap or 0) for c in parsed]
    return spark.createDataFrame(rows, "name string, entity string, optimizer string, weights string, rate double, cap int")


@query("data_configuration", "SELECT * FROM (VALUES ('g', 'a|b', true), ('u', 'c', false)) AS t(name, bags, intercept)", False)
def data_configuration(spark, sf_dir):
    shards = [Shard.parse(str(Shard.parse(t))) for t in ("name=g,feature.bags=a|b", "name=u,feature.bags=c,intercept=false")]
    return spark.createDataFrame([(s.name, "|".join(s.bags), s.intercept) for s in shards], "name string, bags string, intercept boolean")
