"""Where rows go: by uid, or by entity with entities packed into bins of even load."""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import indexing

#: Entities that ``entity_bins`` places; ``even_bins`` places all.
CAPACITY = 10_000


def uid_partition(uid: Column, n: int) -> Column:
    """abs(uid) modulo n."""
    return F.pmod(F.abs(uid.cast("long")), F.lit(n)).cast("int")


def entity_bins(rows: DataFrame, entity: str, n: int, cap: int | None = None, capacity: int = CAPACITY) -> dict[str, int]:
    """Bin of each of the ``capacity`` largest entities: largest first, always into the least loaded bin.

    A load counts at most cap rows of an entity.  Of equal entities the lesser
    name is first, of equal bins the lesser number.
    """
    load = F.count("*") if cap is None else F.least(F.count("*"), F.lit(cap))
    top = rows.where(F.col(entity).isNotNull()).groupBy(F.col(entity).cast("string").alias("e")).agg(load.alias("n")).orderBy(F.col("n").desc(), "e").limit(capacity).collect()
    bins, out = [(0, i) for i in range(n)], {}
    for r in top:
        size, i = heapq.heappop(bins)
        out[r["e"]] = i
        heapq.heappush(bins, (size + r["n"], i))
    return out


def even_bins(rows: DataFrame, entity: str, n: int, cap: int | None = None) -> DataFrame:
    """(e, bin) of every entity, null too, placed as ``entity_bins`` does: loads of bins differ by the largest entity's at most.

    Entities of one load fill bins level by level, so the driver needs only how
    many entities have each load; an entity's bin follows from its rank among
    those.  Ranks are taken in ranges of names side by side.  The table of
    entities is kept in memory or on disk.
    """
    load = F.count("*") if cap is None else F.least(F.count("*"), F.lit(cap))
    per = rows.groupBy(F.col(entity).cast("string").alias("e")).agg(load.cast("long").alias("n")).persist()
    placed = rows.sparkSession.sparkContext.broadcast(_placed(dict(map(tuple, per.groupBy("n").count().collect())), n))
    drawn = sorted(r[0] for r in per.where(F.col("e").isNotNull()).orderBy(F.xxhash64("e"), "e").limit(indexing.DRAWN).collect())
    bounds = drawn[:: max(1, len(drawn) // indexing.PARTS)][1:]
    parts = per.withColumn("b", F.size(F.filter(F.array(*map(F.lit, bounds)), lambda x: x <= F.col("e"))) if bounds else F.lit(0))
    totals = parts.groupBy("n", "b").agg(F.count("*").alias("m"))
    earlier = F.sum("m").over(Window.partitionBy("n").orderBy("b").rowsBetween(Window.unboundedPreceding, -1))
    before = totals.select("n", "b", F.coalesce(earlier, F.lit(0)).alias("before"))
    ranked = parts.withColumn("r", F.row_number().over(Window.partitionBy("n", "b").orderBy("e")) - 1).join(before, ["n", "b"])

    def place(load: pa.Array, rank: pa.Array) -> pa.Array:
        sizes, first, begin, at, length, flat = placed.value
        j, r = np.searchsorted(sizes, load.to_numpy()), rank.to_numpy()
        k = np.searchsorted(first, j << 40 | r, "right") - 1
        return pa.array(flat[at[k] + (r - begin[k]) % length[k]], pa.int32())

    return ranked.select("e", F.arrow_udf(place, "int")("n", F.col("r") + F.col("before")).alias("bin"))


def _placed(counts: dict[int, int], n: int) -> tuple[np.ndarray, ...]:
    """Bins by load and rank, of counts of entities by load: ranks from begin on go round flat[at : at + length].

    The least loaded bin is next, so slots of entities of one size are taken
    level by level of that size; a bin takes part from its own level on.
    """
    loads, found = np.zeros(n, np.int64), []
    for size in sorted(counts, reverse=True):
        left, begin = counts[size], 0
        level, rest = np.divmod(loads, size)
        order, levels = np.lexsort((np.arange(n), rest)), np.unique(level).tolist()
        for q, above in zip(levels, [*levels[1:], None]):
            bins = order[level[order] <= q]
            slots = left if above is None else min(left, (above - q) * len(bins))
            bins = bins[:slots]
            found.append((size, begin, bins))
            loads[bins] += size * (slots // len(bins))
            loads[bins[: slots % len(bins)]] += size
            left, begin = left - slots, begin + slots
            if not left:
                break
    found.sort(key=lambda x: x[:2])
    sizes, begin = np.array(sorted(counts), np.int64), np.array([b for _, b, _ in found], np.int64)
    length = np.array([len(x) for _, _, x in found], np.int64)
    first = np.searchsorted(sizes, np.array([s for s, _, _ in found], np.int64)) << 40 | begin
    return sizes, first, begin, np.cumsum(length) - length, length, np.concatenate([x for _, _, x in found] or [np.zeros(0, np.int64)])


def with_bin(rows: DataFrame, entity: str, n: int, bins: dict[str, int] | DataFrame, name: str = "bin") -> DataFrame:
    """rows with their bin: a placed entity's, else that of its hash; bins is broadcast if it is a dict, else joined as Spark sees fit."""
    if isinstance(bins, DataFrame):
        table = bins.select(F.col("e").alias("__e"), F.col("bin").alias("__bin"))
    else:
        table = F.broadcast(rows.sparkSession.createDataFrame(sorted(bins.items()), "__e string, __bin int"))
    joined = rows.join(table, F.col(entity).cast("string").eqNullSafe(F.col("__e")), "left")
    return joined.withColumn(name, F.coalesce("__bin", F.pmod(F.xxhash64(F.col(entity).cast("string")), F.lit(n)).cast("int"))).drop("__e", "__bin")


def by_entity(rows: DataFrame, entity: str, n: int, cap: int | None = None) -> DataFrame:
    """rows in n partitions of about even load, an entity's rows together."""
    binned = with_bin(rows, entity, n, even_bins(rows, entity, n, cap), "__bin_of")
    return binned.repartition(n, "__bin_of").drop("__bin_of")


def resized(df: DataFrame, n: int) -> DataFrame:
    """df in n partitions: merged without a shuffle if there are more, dealt anew if there are fewer."""
    return df.coalesce(n) if df.rdd.getNumPartitions() >= n else df.repartition(n)
