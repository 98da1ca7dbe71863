"""Shared helpers of the training-data operators."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The ASCII white space that separates words, as Java and Python regular expressions take it.
SPACE = r"\x20\x09-\x0D"
#: The same six characters as text.
SPACE_CHARS = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """Cut lineage with an eager checkpoint in the folder all executors share.

    The cluster names that folder in spark.checkpoint.dir; a local run without
    it gets a temporary one, a cluster without it an error.
    """
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        named = sc.getConf().get("spark.checkpoint.dir", None)
        if named is None and not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp())
    return df.checkpoint()


def tidy(run, clear=lambda: None):
    """run, a function of Arrow batches, that gives its memory back to the system when a task ends.

    Python workers are kept for later stages; what one holds on to is missing
    there.  clear empties the worker's own caches.
    """

    def tidied(batches):
        try:
            yield from run(batches)
        finally:
            clear()
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):  # another C library
                ctypes.CDLL(None).malloc_trim(0)

    return tidied


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Connected components of an edge list (a long, b long) by alternating stars.

    Returns (node, component) for every node that occurs, where component is
    the smallest node reachable.  Each round replaces every edge by edges to
    the smallest neighbour (large star upward, small star downward), so path
    lengths shrink geometrically.  Minima are partially aggregated before the
    shuffle and joined back, so a hub's neighbours are never collected.
    Self-loops, repeated and reversed edges are allowed; nulls are ignored; an
    empty list gives an empty result.
    """
    edges = edges.where("a IS NOT NULL AND b IS NOT NULL")
    state = cut(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    seen = None
    for _ in range(rounds):
        both = state.union(state.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))).alias("e"))
        state = cut(small.select(F.col("e.v").alias("u"), F.col("e.m").alias("v")).where("u <> v").distinct())
        now = state.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return state.select(F.col("u").alias("node"), F.col("v").alias("component")).union(state.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
