"""Sinks: training records, models, metadata, summaries, scores and texts."""

from __future__ import annotations

import json

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kestrix.functions.features import INTERCEPT, SEPARATOR, name_of, term_of
from kestrix.operators.config import Coordinate
from kestrix.operators.mixed import FixedModel, MixedModel, RandomModel

FIXED, RANDOM, METADATA, SPEC, ID_INFO, COEFFICIENTS = "fixed-effect", "random-effect", "model-metadata.json", "model-spec", "id-info", "coefficients"
#: Coefficients of at most this size are not written.
SPARSITY = 1e-4


def put_text(spark: SparkSession, path: str, text: str) -> None:
    """Write a small file in any store Spark writes: beside its place, then renamed; an earlier one stays as .prev."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    to, tmp, old = (jvm.org.apache.hadoop.fs.Path(p) for p in (path, f"{path}.tmp", f"{path}.prev"))
    fs = to.getFileSystem(conf)
    out = fs.create(tmp, True)
    out.write(bytearray(text.encode()))
    out.close()
    if fs.exists(to):
        fs.delete(old, False)
        fs.rename(to, old)
    fs.rename(tmp, to)


def get_text(spark: SparkSession, path: str) -> str:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    stream = p.getFileSystem(spark._jsc.hadoopConfiguration()).open(p)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def children(spark: SparkSession, path: str) -> list[str]:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    return sorted(s.getPath().getName() for s in fs.listStatus(p) if s.isDirectory()) if fs.exists(p) else []


def prepare_output(spark: SparkSession, path: str, override: bool) -> None:
    """Delete an existing folder if told to, else raise."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.exists(p):
        if not override:
            raise FileExistsError(path)
        fs.delete(p, True)


def write_strings(spark: SparkSession, path: str, lines: list[str]) -> None:
    put_text(spark, path, "".join(f"{x}\n" for x in lines))


def read_strings(spark: SparkSession, path: str) -> list[str]:
    return get_text(spark, path).splitlines()


def named_features(df: DataFrame, index: DataFrame, features: str = "features", uid: str = "uid") -> DataFrame:
    """(uid, features) with names and terms in place of indices."""
    long = df.select(uid, F.explode(features).alias("x")).select(uid, F.col("x.idx").alias("idx"), F.col("x.val").alias("value"))
    named = long.join(index, "idx").select(uid, F.struct(name_of(F.col("key")).alias("name"), term_of(F.col("key")).alias("term"), "value").alias("f"))
    return named.groupBy(uid).agg(F.sort_array(F.collect_list("f")).alias("features"))


def write_training(df: DataFrame, path: str, index: DataFrame, response: str = "label", features: str = "features", fmt: str = "parquet", overwrite: bool = False) -> None:
    """Training records: uid, response, offset (0 if null), weight (1 if null) and named features."""
    num = lambda c, d: F.coalesce(F.col(c).cast("double"), F.lit(d)) if c in df.columns else F.lit(d)
    base = df.select("uid", F.col(response).cast("double").alias("response"), num("offset", 0.0).alias("offset"), num("weight", 1.0).alias("weight"))
    base.join(named_features(df, index, features), "uid", "left").write.mode("overwrite" if overwrite else "errorifexists").format(fmt).save(path)


def coefficients_by_size(df: DataFrame, threshold: float, *keys: str) -> DataFrame:
    """(keys, idx, value, rank) of coefficients larger than threshold, ranked by size within keys; ties by idx."""
    order = Window.partitionBy(*(keys or (F.lit(0),))).orderBy(F.abs("value").desc(), "idx")
    return df.where(F.abs("value") > threshold).withColumn("rank", F.row_number().over(order))


def _named(df: DataFrame, index: DataFrame, keys: list[str], threshold: float) -> DataFrame:
    """One record per model: means and variances by name, larger than threshold, largest first."""
    kept = df.join(index, "idx").select(*keys, name_of(F.col("key")).alias("name"), term_of(F.col("key")).alias("term"), "mean", "variance")

    def list_of(c: str):
        size = F.when(F.abs(c) > threshold, F.struct(-F.abs(c), F.col("name"), F.col("term"), F.col(c).alias("value")))
        return F.transform(F.sort_array(F.collect_list(size)), lambda x: F.struct(x["name"].alias("name"), x["term"].alias("term"), x["value"].alias("value")))

    return kept.groupBy(*keys).agg(list_of("mean").alias("means"), list_of("variance").alias("variances"))


def save_model(spark: SparkSession, model: MixedModel, path: str, indexes: dict[str, DataFrame], configs: dict[str, Coordinate] | None = None, threshold: float = SPARSITY, files: int | None = None, override: bool = False) -> None:
    """A folder per coordinate: id-info and coefficients; model-metadata.json and model-spec beside them."""
    prepare_output(spark, path, override)
    for name, m in model.models.items():
        if isinstance(m, FixedModel):
            at = f"{path}/{FIXED}/{name}"
            write_strings(spark, f"{at}/{ID_INFO}", [m.shard])
            rows = [(name, i, float(v), None if m.variances is None else float(m.variances[i])) for i, v in enumerate(m.means) if v]
            long = spark.createDataFrame(rows, "modelId string, idx int, mean double, variance double")
        else:
            at = f"{path}/{RANDOM}/{name}"
            write_strings(spark, f"{at}/{ID_INFO}", [m.entity, m.shard])
            long = m.table.select(F.col(m.entity).alias("modelId"), F.explode("coefficients").alias("c")).select("modelId", "c.*")
        out = _named(long, indexes[m.shard], ["modelId"], threshold).withColumn("lossFunction", F.lit(model.task))
        (out.coalesce(files) if files else out).write.parquet(f"{at}/{COEFFICIENTS}")
    meta = {"modelType": model.task, "coordinates": {k: str(c) for k, c in (configs or {}).items()}}
    put_text(spark, f"{path}/{METADATA}", json.dumps(meta, indent=2))
    fixed = [k for k, m in model.models.items() if isinstance(m, FixedModel)]
    order = [*sorted(fixed), *sorted(k for k in model.models if k not in fixed)]
    write_strings(spark, f"{path}/{SPEC}", [f"{k}: {configs[k] if configs and k in configs else ''}" for k in order])


def load_metadata(spark: SparkSession, path: str) -> tuple[str, dict[str, Coordinate]]:
    """The task of a saved model and the configurations of its coordinates."""
    meta = json.loads(get_text(spark, f"{path}/{METADATA}"))
    return meta["modelType"], {k: Coordinate.parse(c) for k, c in meta["coordinates"].items()}


def load_model(spark: SparkSession, path: str, indexes: dict[str, DataFrame], coordinates: list[str] | None = None) -> MixedModel:
    """The inverse; features that an index lacks are dropped.  coordinates names those to load."""
    task = load_metadata(spark, path)[0]
    model = MixedModel(task)
    for kind in (FIXED, RANDOM):
        for name in children(spark, f"{path}/{kind}"):
            if coordinates is not None and name not in coordinates:
                continue
            at = f"{path}/{kind}/{name}"
            info = read_strings(spark, f"{at}/{ID_INFO}")
            shard = info[-1]
            if shard not in indexes:
                raise ValueError(f"shard {shard} of {name} has no index")
            if name in model.models:
                raise ValueError(f"two coordinates are named {name}")
            rows = spark.read.parquet(f"{at}/{COEFFICIENTS}")
            of = lambda c: rows.select("modelId", F.explode(c).alias("f")).select("modelId", F.concat("f.name", F.lit(SEPARATOR), "f.term").alias("key"), F.col("f.value").alias(c))
            both = of("means").join(of("variances"), ["modelId", "key"], "left")
            long = both.select("modelId", "key", F.col("means").alias("mean"), F.col("variances").alias("variance")).join(indexes[shard], "key")
            if kind == FIXED:
                got = long.toPandas()
                size = indexes[shard].agg(F.max("idx")).first()[0] + 1
                means, var = np.zeros(size), np.zeros(size)
                means[got["idx"]], var[got["idx"]] = got["mean"], got["variance"].fillna(0)
                model.models[name] = FixedModel(shard, means, None if got["variance"].isna().all() else var)
            else:
                table = long.groupBy(F.col("modelId").alias(info[0])).agg(F.sort_array(F.collect_list(F.struct("idx", "mean", "variance"))).alias("coefficients"))
                model.models[name] = RandomModel(shard, info[0], table)
            if not rows.where(F.col("lossFunction") != task).isEmpty():
                raise ValueError(f"models of {name} are for another task than {task}")
    return model


def model_index(rows: DataFrame) -> DataFrame:
    """Index of the features that saved coefficients have."""
    from kestrix.operators.indexing import index

    return index(rows.select(F.explode("means").alias("f")).select(F.concat("f.name", F.lit(SEPARATOR), "f.term").alias("key")), has_intercept(rows))


def has_intercept(rows: DataFrame) -> bool:
    return not rows.where(F.exists("means", lambda f: f["name"] == INTERCEPT)).isEmpty()


def write_text_models(spark: SparkSession, path: str, models: list[tuple[float, FixedModel]], index: DataFrame) -> None:
    """``name, term, value, lambda`` by tabs, largest value first, one folder."""
    rows = [(i, float(v), float(w)) for w, m in models for i, v in enumerate(m.means)]
    long = spark.createDataFrame(rows, "idx int, value double, lambda double").join(index, "idx")
    line = F.concat_ws("\t", name_of(F.col("key")), term_of(F.col("key")), F.col("value").cast("string"), F.col("lambda").cast("string"))
    ordered = long.repartition(len(models) or 1, "lambda").sortWithinPartitions("lambda", F.col("value").desc())
    ordered.select(line.alias("value")).write.mode("overwrite").text(path)


def write_names(df: DataFrame, path: str) -> None:
    df.select(F.concat_ws("\t", "name", "term").alias("value")).write.mode("overwrite").text(path)


def write_summary(stats: DataFrame, index: DataFrame, path: str) -> None:
    """featureName, featureTerm and a map of metrics; the intercept is left out."""
    names = ("max", "min", "mean", "norm_l1", "norm_l2", "nnz", "variance")
    metrics = F.create_map(*(x for n in names for x in (F.lit(n), F.col(n).cast("double"))))
    rows = stats.join(index, "idx").where(name_of(F.col("key")) != INTERCEPT)
    rows.select(name_of(F.col("key")).alias("featureName"), term_of(F.col("key")).alias("featureTerm"), metrics.alias("metrics")).write.mode("overwrite").parquet(path)


def write_scores(scored: DataFrame, path: str, model_id: str = "N/A", files: int | None = None, tags: tuple[str, ...] = ()) -> None:
    """uid, label, modelId, predictionScore, weight and a metadata map of the tags."""
    meta = F.create_map(*(x for t in tags for x in (F.lit(t), F.col(t).cast("string")))) if tags else F.create_map().cast("map<string,string>")
    col = lambda c, kind: F.col(c).cast(kind) if c in scored.columns else F.lit(None).cast(kind)
    out = scored.select(F.col("uid").cast("string").alias("uid"), col("label", "double").alias("label"), F.lit(model_id).alias("modelId"), F.col("score").alias("predictionScore"), col("weight", "double").alias("weight"), meta.alias("metadataMap"))
    (out.coalesce(files) if files else out).write.mode("overwrite").parquet(path)


def write_group_metrics(groups: DataFrame, path: str) -> None:
    groups.coalesce(1).write.mode("overwrite").parquet(path)


def latent_factors(df: DataFrame, entity: str, factors: str) -> DataFrame:
    """(effectId, latentFactor array) of an entity's vector."""
    return df.select(F.col(entity).cast("string").alias("effectId"), F.col(factors).cast("array<double>").alias("latentFactor"))
