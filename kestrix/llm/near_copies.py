"""Near copies of texts by SimHash: five-word shingle sets of Jaccard similarity 0.8 or more.

Equal shingle sets are one class with one long fingerprint, a ring of 144
segments of 16 bits.  Pigeonring chains bring classes together: they begin at
an equal segment, and each of the next eight links must keep its budget, l * 4
bits for the first l segments.  What hangs together is a unit; inside a unit
every pair whose whole rings keep the budget, the last link, is counted
exactly.

A pair of similarity 0.8 differs in 0.148 to 0.158 of its bits, a segment is
equal in one of 14 to 16 cases, and no chain starts at any of the 144 once in
14,000 times for sets of four and five shingles, once in 40,000 for large ones.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, cut, shuffle_partitions, tidy
from .simhash import BROADCAST_BUCKETS, _bucket_links

SHINGLE = 5
#: Similarity is at least LIKE[0] / LIKE[1].
LIKE = (4, 5)
#: Segments of the ring and their bits.
SEGMENTS, WIDTH = 144, 16
#: Bits a link may add to its chain's budget, and links after the equal one before pairs meet in a unit.
BUDGET, LINKS_AHEAD = 4, 8
#: Shingles and classes of a unit that are compared in one go; larger units, and larger buckets, are cut into blocks of about this many.
BLOCK_SHINGLES, BLOCK = 1 << 20, 2048
#: One class in this many is counted to find large buckets.
SAMPLE = 64
#: Rows of buckets that are compared in one go.
CHUNK = 1 << 16
_WORDS = SEGMENTS * WIDTH // 8
_RNG = np.random.default_rng(42)
_FACTORS = _RNG.integers(0, 1 << 63, (2, _WORDS), np.uint64) * np.uint64(2) + np.uint64(1)
_LANES = np.uint64(0x00FF00FF00FF00FF)
_HELD = np.empty((2, 128, _WORDS), np.uint64)


def shingles(text: str | None) -> np.ndarray:
    """Distinct XXH64 of the five-word shingles in order; a shorter text is one shingle, one without words has none."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    n = max(1, len(words) - SHINGLE + 1)
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])[:n].tolist()
    digest = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((digest(line[a:b], 42) for a, b in zip(starts, ends[-n:].tolist())), np.uint64, n))


def fingerprint(found: np.ndarray) -> np.ndarray:
    """SimHash ring of a shingle set, as bytes: a bit is set if the shingles' weights for it exceed their mean.

    A shingle weighs a byte of its mixed hash for each bit; weights of one bit
    would tie too often in sets of few shingles.
    """
    total = np.zeros((2, _WORDS * 4), np.int64)
    for at in range(0, len(found), _HELD.shape[1]):  # 16-bit lanes hold 257 bytes
        part = found[at : at + _HELD.shape[1], None]
        z, y = _HELD[:, : len(part)]
        np.multiply(part, _FACTORS[0], out=z)
        z ^= np.right_shift(z, np.uint64(32), out=y)
        z *= _FACTORS[1]
        z ^= np.right_shift(z, np.uint64(29), out=y)
        total[0] += np.bitwise_and(z, _LANES, out=y).sum(axis=0).view(np.uint16)
        z >>= np.uint64(8)
        z &= _LANES
        total[1] += z.sum(axis=0).view(np.uint16)
    return np.packbits(total * 2 > 255 * len(found))


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    both = np.intersect1d(a, b, assume_unique=True).size
    return both * LIKE[1] >= LIKE[0] * (len(a) + len(b) - both)


def _rings(docs: DataFrame) -> DataFrame:
    """doc_id, th, node, n and ring of every row; th names the text, node the shingle set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            node, n, ring = [], [], []
            for text in b.column(2).to_pylist():
                found = shingles(text)
                node.append(xxhash.xxh64_intdigest(found.tobytes(), 42))
                n.append(len(found))
                ring.append(fingerprint(found).tobytes())
            columns = [b.column(0), b.column(1), pa.array(np.array(node, np.uint64).view(np.int64)), pa.array(n, pa.int64()), pa.array(ring, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "th", "node", "n", "ring"])

    return _texts(docs).mapInArrow(tidy(run), "doc_id long, th long, node long, n long, ring binary")


def _texts(docs: DataFrame) -> DataFrame:
    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("th"), text.alias("text"))


def _chains(ring: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bucket (segment and its value) and the bits of the following links, of each segment of rings of 16-bit numbers."""
    bucket = np.arange(SEGMENTS, dtype=np.int64) << 16 | ring
    ahead = np.concatenate([ring[:, 1:], ring[:, :LINKS_AHEAD]], axis=1)
    ahead = np.lib.stride_tricks.sliding_window_view(ahead, LINKS_AHEAD, axis=1)
    return bucket.reshape(-1), np.ascontiguousarray(ahead).reshape(-1, LINKS_AHEAD).view(np.uint64)


def _chained(x: np.ndarray, _: np.ndarray) -> np.ndarray:
    """Which XORs of the links after an equal segment keep every link's budget, the last and strictest first."""
    ok = np.flatnonzero(np.bitwise_count(x).sum(axis=1, dtype=np.int64) <= BUDGET * (LINKS_AHEAD + 1))
    links = np.bitwise_count(x[ok].view(np.uint16)).cumsum(axis=1, dtype=np.int64)
    return ok[(links <= BUDGET * np.arange(2, LINKS_AHEAD + 2)).all(axis=1)]


def _keyed(classes: DataFrame) -> DataFrame:
    """A row for every segment of every class: bucket k, the links ahead and the class' id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in (batch.slice(at, 512) for at in range(0, batch.num_rows, 512)):
                ring = np.frombuffer(b"".join(b.column(1).to_pylist()), np.uint16).reshape(b.num_rows, SEGMENTS)
                bucket, ahead = _chains(ring)
                columns = [bucket, *np.ascontiguousarray(ahead.T).view(np.int64), np.repeat(b.column(0).to_numpy(), SEGMENTS)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["k", "p", "q", "id"])

    return classes.where("n > 0").select("id", "ring").mapInArrow(tidy(run), "k long, p long, q long, id long")


def candidates(classes: DataFrame) -> DataFrame:
    """Links (a, b) between ids of classes whose rings have a chain from an equal segment: a forest of each bucket.

    A class is linked to the smallest it hangs together with in a bucket.
    Large buckets are known by a sample of the classes, which decides nothing
    but their number of blocks; every pair of blocks is a key of its own.
    """
    spark = classes.sparkSession
    sampled = _keyed(classes.where(F.pmod(F.xxhash64("id"), F.lit(SAMPLE)) == 0)).groupBy("k").agg((F.count("*") * SAMPLE).alias("n"))
    sizes = cut(sampled.where(F.col("n") > BLOCK).select(F.col("k").alias("s_k"), F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks")))
    rows, large = _keyed(classes), sizes.count()
    if large:
        sizes = F.broadcast(sizes) if large <= BROADCAST_BUCKETS else sizes
        block = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
        rows = rows.join(sizes, F.col("k") == F.col("s_k"), "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
        rows = rows.select("k", "p", "q", "id", block.alias("x"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("y"))
    else:
        rows = rows.withColumns({"x": F.lit(0), "y": F.lit(0)})
    # 8 bits segment, 16 value, 18 and 18 for the blocks; the column order and small ids let rows compress
    lo, hi = F.least("x", "y").cast("long"), F.greatest("x", "y").cast("long")
    key = F.shiftleft("k", 36).bitwiseOR(F.shiftleft(lo, 18)).bitwiseOR(hi)
    side = F.when(F.col("x") == F.col("y"), 0).when(F.col("x") < F.col("y"), 1).otherwise(2).cast("byte")
    rows = rows.select(side.alias("side"), key.alias("key"), "p", "q", "id").repartition(shuffle_partitions(spark), "key").sortWithinPartitions("key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(parts):
            side, key, p, q, name = (np.concatenate([x[c] for x in parts]) for c in range(5))
            by = np.lexsort((name, key))  # roots are then smallest ids, of which the buckets of a large group share many
            a, b = _bucket_links(key[by], side[by], np.stack([p[by], q[by]], axis=1).view(np.uint64), name[by], _chained)
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

        held, count = [], 0
        for batch in batches:
            part = [batch.column(c).to_numpy() for c in range(5)]
            held.append(part)
            count += len(part[0])
            if count < CHUNK or not len(part[0]) or part[1][0] == part[1][-1]:
                continue
            at = int(np.searchsorted(part[1], part[1][-1], "left"))  # the last key may go on
            yield out([*held[:-1], [x[:at] for x in part]])
            held, count = [[x[at:] for x in part]], len(part[0]) - at
        if count:
            yield out(held)

    return rows.mapInArrow(tidy(run), "a long, b long")


def _hooked(edges: DataFrame) -> DataFrame:
    """Fewer edges (a, b) of the same components: those a node is linked to are linked to the smallest of them.

    A node has an edge a bucket and pair of blocks, so its list is short; the
    leads of a large group's buckets are few, and their edges repeat.  Once
    more, the leads are linked to the smallest of theirs.
    """
    found = edges.groupBy("a").agg(F.collect_set("b").alias("leads"))
    hooked = found.select(F.explode(F.array_union("leads", F.array("a"))).alias("a"), F.array_min("leads").alias("b"))
    return hooked.where("a <> b").distinct()


def _unit_links(node: np.ndarray, side: np.ndarray, found: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Spanning forest of the pairs of a unit, or of two of its blocks, that are similar."""
    ring = np.array([fingerprint(f).view(np.uint64) for f in found])
    size = np.fromiter(map(len, found), np.int64, len(found))
    order = np.argsort(size, kind="stable")
    node, side, ring, size, found = node[order], side[order], ring[order], size[order], [found[i] for i in order]
    label, a, b = np.arange(len(node)), [], []
    for i in range(1, len(node)):
        at = int(np.searchsorted(size[:i], -(-size[i] * LIKE[0] // LIKE[1])))  # smaller sets cannot be similar
        want = label[at:i] != label[i]
        if side[i]:
            want &= side[at:i] != side[i]
        near = at + np.flatnonzero(want)
        near = near[np.bitwise_count(ring[near] ^ ring[i]).sum(axis=1, dtype=np.int64) <= BUDGET * SEGMENTS]
        while len(near):
            j, near = near[0], near[1:]
            if similar(found[i], found[j]):
                a.append(node[i])
                b.append(node[j])
                label[label == label[i]] = label[j]
                near = near[label[near] != label[j]]
    return np.array(a, np.int64), np.array(b, np.int64)


def links(docs: DataFrame, classes: DataFrame) -> DataFrame:
    """Links (a, b) between nodes of similar shingle sets: a forest of each unit or pair of its blocks.

    classes: node, first (doc_id and th of its row), n, ring and id.
    """
    spark = docs.sparkSession
    edges = _hooked(_hooked(candidates(classes)))
    units = cut(components(edges).select(F.col("node").alias("id"), F.col("component").alias("unit")).distinct().join(classes.select("id", "node", "first", "n"), "id"))
    sizes = units.groupBy("unit").agg(F.greatest(F.ceil(F.sum("n") / BLOCK_SHINGLES), F.ceil(F.count("*") / BLOCK)).cast("int").alias("blocks"))
    block = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    parts = units.join(sizes, "unit").select("node", "unit", F.col("first.doc_id").alias("i"), F.col("first.th").alias("h"), "blocks", block.alias("x"))
    texts = _texts(docs).join(parts, F.col("doc_id").eqNullSafe(F.col("i")) & (F.col("th") == F.col("h")))
    rows = texts.select("node", "unit", "text", "x", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("y"))
    side = F.when(F.col("x") == F.col("y"), 0).when(F.col("x") < F.col("y"), 1).otherwise(2)
    rows = rows.select("unit", F.least("x", "y").alias("lo"), F.greatest("x", "y").alias("hi"), "node", side.alias("side"), "text")
    rows = rows.repartition(shuffle_partitions(spark), "unit", "lo", "hi").sortWithinPartitions("unit", "lo", "hi", "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(held):
            node, side, found = zip(*held)
            a, b = _unit_links(np.array(node, np.int64), np.array(side), list(found))
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

        now, held = None, []
        for batch in batches:
            for unit, lo, hi, node, side, text in zip(*(c.to_pylist() for c in batch.columns)):
                if now != (unit, lo, hi):
                    if held:
                        yield out(held)
                    now, held = (unit, lo, hi), []
                if not held or held[-1][0] != node:  # a row may be repeated
                    held.append((node, side, shingles(text)))
        if held:
            yield out(held)

    return rows.mapInArrow(tidy(run), "a long, b long")


def near_copies(docs: DataFrame) -> DataFrame:
    """doc_id, th and component of every row; rows are linked at similarity 0.8 or more.

    Texts without words are copies of one another.
    """
    rows = cut(_rings(docs))
    classes = cut(rows.groupBy("node").agg(F.min(F.struct("doc_id", "th")).alias("first"), F.first("n").alias("n"), F.first("ring").alias("ring")).withColumn("id", F.monotonically_increasing_id()))
    found = components(links(docs, classes)).distinct()
    named = found.select(F.col("node").alias("of"), "component")
    return rows.join(named, F.col("node") == F.col("of"), "left").select("doc_id", "th", F.coalesce("component", "node").alias("component"))
