"""Sources: tables, LibSVM text, Avro-shaped records, date-partitioned paths and saved results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kestrix.functions.features import NAMED, DateRange
from kestrix.operators import indexing
from kestrix.operators.config import Shard

#: Names of the two dialects of training records: label, weight, offset, features.
DIALECTS = {"TRAINING_EXAMPLE": "label", "RESPONSE_PREDICTION": "response"}


def read_table(spark: SparkSession, paths: str | list[str], fmt: str = "parquet", min_partitions: int = 1, schema: T.StructType | str | None = None) -> DataFrame:
    """Union of paths in one scan; partitions are only ever raised to min_partitions."""
    reader = spark.read.format(fmt)
    df = (reader.schema(schema) if schema is not None else reader).load(paths)
    return df.repartition(min_partitions) if min_partitions > 1 and df.rdd.getNumPartitions() < min_partitions else df


def daily_paths(spark: SparkSession, base: str, days: DateRange) -> list[str]:
    """Existing day folders base/yyyy/MM/dd of a range; at least one must exist.  Any store Spark reads is looked at."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    found = [p for p in days.paths(base) if (h := jvm.org.apache.hadoop.fs.Path(p)).getFileSystem(conf).exists(h)]
    if not found:
        raise FileNotFoundError(f"no day of {days.start} to {days.end} under {base}")
    return found


def read_libsvm(spark: SparkSession, path: str, dimension: int, intercept: bool = True, zero_based: bool = False) -> DataFrame:
    """uid, label (1 if positive else 0), offset, weight, features of ``label idx:val ...`` lines; the intercept comes last.

    Lines are split in the JVM.  uid numbers lines by file position, not by
    partition; equal lines of one file keep separate uids.
    """
    if dimension <= 0:
        raise ValueError("the feature dimension must be positive")
    lines = spark.read.text(path).where(F.trim("value") != "").select(F.monotonically_increasing_id().alias("uid"), F.split(F.trim("value"), "\\s+").alias("p"))
    entries = F.transform(F.filter(F.slice("p", 2, 1 << 30), lambda x: ~x.startswith("#")), lambda x: F.struct(
        (F.split(x, ":")[0].cast("int") - (0 if zero_based else 1)).alias("idx"), F.split(x, ":")[1].cast("double").alias("val")))
    if intercept:
        entries = F.concat(entries, F.array(F.struct(F.lit(dimension).alias("idx"), F.lit(1.0).alias("val"))))
    return lines.select("uid", F.when(F.col("p")[0].cast("double") > 0, 1.0).otherwise(0.0).alias("label"), F.lit(0.0).alias("offset"), F.lit(1.0).alias("weight"), entries.alias("features"))


def number(c: Column) -> Column:
    """A value as a double: strings are parsed, NaN and infinite strings and what can't be read are null."""
    v = c.try_cast("double")
    return F.when(F.isnan(v) | (F.abs(v) == float("inf")), None).otherwise(v)


def read_merged(df: DataFrame, shards: list[Shard], indexes: dict[str, DataFrame] | None = None, uid: str = "uid") -> tuple[DataFrame, dict[str, DataFrame]]:
    """df with one sparse vector per shard, and the index of each shard.

    Indexes that are not given are built from the data.  Keys an index lacks
    are dropped; a row with one feature twice raises an error.
    """
    indexes = dict(indexes or {})
    out = df
    for s in shards:
        if s.name not in indexes:
            words = indexing.vocabulary(df, list(s.bags))
            indexes[s.name] = indexing.index(words.select(F.concat("name", F.lit("\x01"), "term").alias("key")), s.intercept).persist()
        out = indexing.shard(out, list(s.bags), indexes[s.name], uid, s.intercept, s.name)
    return out, indexes


def read_training_records(df: DataFrame, dialect: str = "TRAINING_EXAMPLE", selected: DataFrame | None = None) -> DataFrame:
    """Rows of named features in one of two dialects: uid, label, offset, weight, features (named).

    Rows of weight 0 go, negative weights raise an error; with selected
    (name, term) only those features stay.
    """
    label = DIALECTS[dialect]
    weight = F.coalesce(F.col("weight"), F.lit(1.0)) if "weight" in df.columns else F.lit(1.0)
    checked = F.when(weight < 0, F.raise_error(F.lit("negative weight")).cast("double")).otherwise(weight)
    uid = F.col("uid") if "uid" in df.columns else F.monotonically_increasing_id()
    offset = F.coalesce(F.col("offset"), F.lit(0.0)) if "offset" in df.columns else F.lit(0.0)
    out = df.select(uid.alias("uid"), F.col(label).cast("double").alias("label"), offset.alias("offset"), checked.alias("weight"), F.col("features").cast(NAMED).alias("features")).where("weight > 0")
    if selected is None:
        return out
    long = out.select("uid", F.explode("features").alias("f"))
    hit = (F.col("f.name") == F.col("s_name")) & (F.coalesce("f.term", F.lit("")) == F.col("s_term"))
    kept = long.join(selected.select(F.col("name").alias("s_name"), F.coalesce("term", F.lit("")).alias("s_term")).distinct(), hit, "left_semi")
    named = kept.groupBy("uid").agg(F.collect_list("f").alias("kept"))
    return out.drop("features").join(named, "uid", "left").withColumn("features", F.coalesce("kept", F.array().cast(NAMED))).drop("kept")


def read_names(spark: SparkSession, path: str) -> DataFrame:
    """(name, term) of ``name<TAB>term`` lines; a missing term is empty."""
    parts = F.split("value", "\t")
    return spark.read.text(path).where(F.trim("value") != "").select(parts[0].alias("name"), F.coalesce(F.get(parts, 1), F.lit("")).alias("term")).distinct()


def read_scores(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def libsvm_records(spark: SparkSession, path: str, real_label: bool = False) -> DataFrame:
    """Training records (uid, label, features named by their index with an empty term) of LibSVM text; real_label keeps the number."""
    lines = spark.read.text(path).where(F.trim("value") != "").select(F.monotonically_increasing_id().cast("string").alias("uid"), F.split(F.trim("value"), "\\s+").alias("p"))
    label = F.col("p")[0].cast("double")
    named = F.transform(F.filter(F.slice("p", 2, 1 << 30), lambda x: ~x.startswith("#")), lambda x: F.struct(F.split(x, ":")[0].alias("name"), F.lit("").alias("term"), number(F.split(x, ":")[1]).alias("value")))
    return lines.select("uid", (label if real_label else F.when(label > 0, 1.0).otherwise(0.0)).alias("label"), named.alias("features"))


def input_format(name: str, dimension: int = 0, dialect: str = "TRAINING_EXAMPLE", intercept: bool = True, selected: DataFrame | None = None):
    """A reader (spark, path) of legacy training data: LIBSVM, which needs a dimension, or records of named features."""
    if name == "LIBSVM":
        if dimension <= 0:
            raise ValueError("LIBSVM needs a positive feature dimension")
        return lambda spark, path: read_libsvm(spark, path, dimension, intercept)
    if name == "AVRO":
        from .avro import AvroSource

        def records(spark: SparkSession, path: str) -> DataFrame:
            spark.dataSource.register(AvroSource)
            return read_training_records(spark.read.format(AvroSource.name()).load(path), dialect, selected)

        return records
    raise ValueError(f"no input format {name}")
