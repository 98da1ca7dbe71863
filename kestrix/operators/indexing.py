"""Feature indexes: a table (key, idx) per shard, in key order, the intercept last."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kestrix.functions.features import INTERCEPT, SEPARATOR, VECTOR, key

#: Index rows up to which the index is broadcast; larger ones are joined by a shuffle.
BROADCAST_ROWS = 1_000_000
#: Parts in which an index is numbered side by side, and the keys that are drawn to find their bounds.
PARTS, DRAWN = 256, 8192


def vocabulary(df: DataFrame, bags: list[str]) -> DataFrame:
    """Distinct (name, term) of the named bags."""
    each = [df.select(F.explode(b).alias("f")).select(F.col("f.name").alias("name"), F.coalesce("f.term", F.lit("")).alias("term")) for b in bags]
    out = each[0]
    for e in each[1:]:
        out = out.unionByName(e)
    return out.distinct()


def index(keys: DataFrame, intercept: bool = False) -> DataFrame:
    """(key, idx): distinct keys numbered in key order from 0; the intercept, if wanted, comes last.

    Numbering runs in parallel over ranges of keys: the keys of least hash are
    drawn to find bounds of about equal parts (they change only how even the
    parts are), totals of parts are summed first, then keys are ranked inside.
    """
    k = keys.select("key").where(F.col("key") != INTERCEPT + SEPARATOR).distinct()
    drawn = sorted(r[0] for r in k.orderBy(F.xxhash64("key"), "key").limit(DRAWN).collect())
    bounds = drawn[:: max(1, len(drawn) // PARTS)][1:]
    part = F.size(F.filter(F.array(*map(F.lit, bounds)), lambda x: x <= F.col("key"))) if bounds else F.lit(0)
    k = k.withColumn("b", part)
    totals = k.groupBy("b").agg(F.count("*").alias("n"))
    before = totals.select("b", (F.coalesce(F.sum("n").over(Window.orderBy("b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).alias("before"))
    ranked = k.withColumn("r", F.row_number().over(Window.partitionBy("b").orderBy("key")) - 1)
    out = ranked.join(before, "b").select("key", (F.col("r") + F.col("before")).cast("int").alias("idx"))
    if not intercept:
        return out
    last = out.agg(F.count("*").cast("int").alias("idx")).select(F.lit(INTERCEPT + SEPARATOR).alias("key"), "idx")
    return out.unionByName(last)


def identity_index(dimension: int, spark, intercept: bool = False) -> DataFrame:
    """Index whose keys are the numbers themselves; the intercept last."""
    ids = spark.range(dimension).select(F.concat(F.col("id").cast("string"), F.lit(SEPARATOR)).alias("key"), F.col("id").cast("int").alias("idx"))
    if intercept:
        ids = ids.unionByName(spark.createDataFrame([(INTERCEPT + SEPARATOR, dimension)], "key string, idx int"))
    return ids


def shard(df: DataFrame, bags: list[str], index_table: DataFrame, uid: str = "uid", intercept: bool = False, name: str = "features") -> DataFrame:
    """df with a sparse vector of the bags' features: unknown keys go, an intercept of 1 is added.

    A row that has one feature twice raises an error when it is read.  An index
    of up to BROADCAST_ROWS keys is sent to the executors and no row moves;
    beyond, features are joined with it by a shuffle.  Rows with one uid are
    rows of their own.
    """
    named = F.transform(F.concat(*(F.coalesce(F.col(b), F.array()) for b in bags)), lambda x: F.struct(key(x["name"], x["term"]).alias("key"), x["value"].cast("double").alias("val")))
    known = index_table.limit(BROADCAST_ROWS + 1).toArrow()
    if known.num_rows <= BROADCAST_ROWS:
        out = df.withColumn(name, _lookup(df, known)(named))
    else:
        # a row is known by its uid and its bags: equal ones have equal vectors
        out = df.withColumn("__bag", named).withColumn("__h", F.xxhash64("__bag"))
        once = out.select(uid, "__h", "__bag").dropDuplicates([uid, "__h"])
        long = once.select(uid, "__h", F.explode("__bag").alias("f")).select(F.col(uid).alias("__uid"), F.col("__h").alias("__bag_h"), F.col("f.key").alias("key"), F.col("f.val").alias("val"))
        vectors = long.join(index_table, "key").groupBy("__uid", "__bag_h").agg(F.sort_array(F.collect_list(F.struct("idx", "val"))).alias("__v"))
        joined = out.join(vectors, F.col(uid).eqNullSafe(F.col("__uid")) & (F.col("__h") == F.col("__bag_h")), "left")
        out = joined.withColumn(name, F.coalesce("__v", F.array().cast(VECTOR))).drop("__bag", "__h", "__uid", "__bag_h", "__v")
    twice = F.size(F.array_distinct(F.transform(name, lambda x: x["idx"]))) < F.size(name)
    out = out.withColumn(name, F.when(twice, F.raise_error(F.lit("duplicate features")).cast(VECTOR)).otherwise(F.col(name)))
    if intercept:
        at = index_table.where(F.col("key") == INTERCEPT + SEPARATOR).first()["idx"]
        out = out.withColumn(name, F.concat(name, F.array(F.struct(F.lit(at).alias("idx"), F.lit(1.0).alias("val")))))
    return out


def _lookup(df: DataFrame, known: pa.Table):
    """A function of array<struct<key, val>> that gives sparse vectors, by a broadcast index."""
    order = pc.sort_indices(known.column("idx"))
    keys, idx = known.column("key").take(order).combine_chunks(), known.column("idx").take(order).to_numpy()
    shared = df.sparkSession.sparkContext.broadcast((keys, idx))
    kind = pa.list_(pa.struct([("idx", pa.int32()), ("val", pa.float64())]))

    def vectors(bags: pa.Array) -> pa.Array:
        keys, idx = shared.value
        f = bags.flatten()
        off = bags.offsets.to_numpy().astype(np.int64)
        off = off - off[0]
        at = pc.index_in(f.field(0), value_set=keys)
        hit = at.is_valid().to_numpy(zero_copy_only=False)
        row = np.repeat(np.arange(len(bags)), np.diff(off))[hit]
        number, val = idx[at.drop_null().to_numpy()], f.field(1).to_numpy(zero_copy_only=False)[hit]
        by = np.lexsort((number, row))
        ends = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(bags)))]).astype(np.int32)
        entries = pa.StructArray.from_arrays([pa.array(number[by].astype(np.int32)), pa.array(val[by])], ["idx", "val"])
        return pa.ListArray.from_arrays(pa.array(ends), entries).cast(kind)

    return F.arrow_udf(vectors, VECTOR)


def duplicates(df: DataFrame, bags: list[str], uid: str = "uid") -> DataFrame:
    """(uid, key, n) of features that a row has more than once."""
    bag = F.concat(*(F.coalesce(F.col(b), F.array()) for b in bags))
    long = df.select(uid, F.explode(bag).alias("f")).select(uid, key(F.col("f.name"), F.col("f.term")).alias("key"))
    return long.groupBy(uid, "key").agg(F.count("*").alias("n")).where("n > 1")
