"""SimHash near-duplicates with pigeonring candidate filtering.

Fingerprints are cut into six ring-shaped segments.  If two of them differ in
at most four bits, some segment starts a chain in which the first l segments
together differ in at most l * 4 / 6 bits, for every l (the pigeonring
principle).  The first link of such a chain is an equal segment, and at least
one more segment is equal, so pairs of equal segments bring candidates
together: keys of 20 to 22 bits, of which a bucket holds few fingerprints.  A
chain that starts at one of the two must keep the budget of every link before
the full Hamming distance, the last link, is taken.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, cut, shuffle_partitions, tidy

BITS, DISTANCE, SHINGLE = 64, 4, 4
#: Ring segments as (low bit, width).
SEGMENTS = ((0, 11), (11, 11), (22, 11), (33, 11), (44, 10), (54, 10))
#: Pairs of segments; of a pair within DISTANCE bits at least len(SEGMENTS) - DISTANCE segments are equal.
PAIRS = tuple(itertools.combinations(range(len(SEGMENTS)), 2))
#: Large buckets whose table is broadcast; with more of them it is joined by a shuffle.
BROADCAST_BUCKETS = 100_000
#: Fingerprints of one bucket that are compared in one go; larger buckets are cut into blocks of about this many.
BLOCK = 4096
#: Links held before they are reduced to a spanning forest.
LINKS = 1 << 19
_SHINGLES = 1 << 16


def fingerprint(text: str | None, width: int = SHINGLE) -> int:
    """64-bit SimHash: a bit is set if more than half of the shingles' XXH64 (seed 42) have it."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: ASCII case and white space only
    if not words:
        return 0
    n = max(1, len(words) - width + 1)
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])[:n].tolist()
    stops = ends[-n:].tolist()
    digest, counts = xxhash.xxh64_digest, np.zeros(BITS, np.int64)
    for at in range(0, n, _SHINGLES):  # bounded memory for texts of any length
        part = b"".join([digest(line[a:b], 42) for a, b in zip(starts[at : at + _SHINGLES], stops[at : at + _SHINGLES])])
        bits = np.unpackbits(np.frombuffer(part, np.uint8).reshape(-1, 8), axis=1)
        counts += _column_sums(bits)
    return int.from_bytes(np.packbits(counts * 2 > n).tobytes(), "big")


def _column_sums(bits: np.ndarray) -> np.ndarray:
    """Sums of 0/1 bytes by column; 255 rows at a time fit a byte, added as whole words."""
    total = np.zeros(bits.shape[1], np.int64)
    full = len(bits) // 255 * 255
    if full:
        words = bits[:full].view(np.uint64).reshape(-1, 255, bits.shape[1] // 8).sum(axis=1)
        total += words.view(np.uint8).reshape(-1, bits.shape[1]).sum(axis=0, dtype=np.int64)
    return total + bits[full:].sum(axis=0, dtype=np.int64)


def fingerprints(docs: DataFrame, width: int = SHINGLE) -> DataFrame:
    """(doc_id, fp long) for every row of docs; null text and text without words have fp 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.fromiter((fingerprint(t, width) for t in b.column(1).to_pylist()), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(tidy(run), "doc_id long, fp long")


def roots_of(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest index of each of n nodes' component, by pointer jumping over the links (a, b)."""
    root = np.arange(n)
    while True:
        before = root.copy()
        low = np.minimum(root[a], root[b])
        np.minimum.at(root, root[a], low)
        np.minimum.at(root, root[b], low)
        while True:
            up = root[root]
            if np.array_equal(up, root):
                break
            root = up
        if np.array_equal(before, root):
            return root


def _chained(x: np.ndarray, pair: np.ndarray) -> np.ndarray:
    """Which XORs pass every link of a chain that starts at either segment of their pair, total distance last."""
    m, starts, passed = len(SEGMENTS), np.array(PAIRS), np.zeros(len(x), bool)
    parts = np.stack([np.bitwise_count((x >> np.uint64(lo)) & np.uint64((1 << w) - 1)) for lo, w in SEGMENTS]).astype(np.int64)
    for side in (0, 1):
        alive = np.flatnonzero(~passed)
        first, total = starts[pair[alive], side], np.zeros(len(alive), np.int64)
        for link in range(m):
            total = total + parts[(first + link) % m, alive]
            ok = total * m <= DISTANCE * (link + 1)
            alive, first, total = alive[ok], first[ok], total[ok]
        passed[alive] = True
    return np.flatnonzero(passed)


def _bucket_links(key, side, fp, rep, chained=_chained) -> tuple[np.ndarray, np.ndarray]:
    """Spanning forest of the links inside each run of equal keys.

    key: (pair of segments, value, block pair) as one integer; rows are sorted by it.
    side: 0 if the bucket's pairs are all wanted, else 1 or 2, and only pairs
    of different sides are.  chained: which XORs of fp pass.
    """
    n = len(key)
    ends = np.searchsorted(key, key, "right")
    live, a, b, size = np.arange(n), [], [], 0
    pair = key >> np.int64(58)
    lag = 1
    while len(live := live[ends[live] > live + lag]):
        i, j = live, live + lag
        if side.any():
            want = (side[i] == 0) | (side[i] != side[j])
            i, j = i[want], j[want]
        ok = chained(fp[i] ^ fp[j], pair[i])
        a.append(i[ok])
        b.append(j[ok])
        size += len(ok)
        if size > LINKS:
            root = roots_of(n, np.concatenate(a), np.concatenate(b))
            own = np.flatnonzero(root != np.arange(n))
            a, b, size = [own], [root[own]], 0
        lag += 1
    if not a:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    root = roots_of(n, np.concatenate(a), np.concatenate(b))
    own = np.flatnonzero(root != np.arange(n))
    return rep[own], rep[root[own]]


def links(classes: DataFrame) -> DataFrame:
    """Links (a, b) between the representatives of classes (fp, rep): a forest of each bucket.

    A bucket is a pair of segments with their values.  Large buckets are cut
    into blocks by a hash and every pair of blocks is a task's own key, so no
    key exceeds two blocks.
    """
    spark = classes.sparkSession
    part = lambda i: F.shiftrightunsigned(F.col("fp"), SEGMENTS[i][0]).bitwiseAND(F.lit((1 << SEGMENTS[i][1]) - 1))
    value = lambda a, b: F.shiftleft(part(a), SEGMENTS[b][1]).bitwiseOR(part(b))
    # 4 bits pair, 22 values, 18 and 18 for the blocks
    bucket = [F.shiftleft(value(a, b), 36).bitwiseOR(F.lit(i << 58)) for i, (a, b) in enumerate(PAIRS)]
    keyed = classes.select("fp", "rep", F.explode(F.array(*bucket)).alias("k"))
    sizes = cut(keyed.groupBy("k").agg(F.count("*").alias("n")).where(F.col("n") > BLOCK).select(F.col("k").alias("s_k"), F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks")))
    sizes = F.broadcast(sizes) if sizes.count() <= BROADCAST_BUCKETS else sizes
    rows = keyed.join(sizes, F.col("k") == F.col("s_k"), "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    block = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    rows = rows.select("fp", "rep", "k", block.alias("x"), other.alias("y"))
    lo, hi = F.least("x", "y").cast("long"), F.greatest("x", "y").cast("long")
    key = F.col("k").bitwiseOR(F.shiftleft(lo, 18)).bitwiseOR(hi)
    side = F.when(F.col("x") == F.col("y"), 0).when(F.col("x") < F.col("y"), 1).otherwise(2).cast("int")
    keyed = rows.select(key.alias("key"), side.alias("side"), "fp", "rep").repartition(shuffle_partitions(spark), "key").sortWithinPartitions("key", "fp")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(parts):
            key, side, fp, rep = (np.concatenate([p[c] for p in parts]) for c in range(4))
            a, b = _bucket_links(key, side, fp.view(np.uint64), rep)
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

        held, rows = [], 0
        for batch in batches:
            part = [batch.column(c).to_numpy() for c in range(4)]
            held.append(part)
            rows += len(part[0])
            if rows < 4 * BLOCK or not len(part[0]) or part[0][0] == part[0][-1]:
                continue
            at = int(np.searchsorted(part[0], part[0][-1], "left"))  # the last key may go on
            yield out([*held[:-1], [p[:at] for p in part]])
            held, rows = [[p[at:] for p in part]], len(part[0]) - at
        if rows:
            yield out(held)

    return keyed.mapInArrow(tidy(run), "a long, b long")


def near_duplicates(docs: DataFrame, width: int = SHINGLE) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of every row of docs.

    Fingerprints link at four or fewer differing bits; component_id is the
    smallest doc_id reachable.  Rows with equal fingerprints form a class, and
    only classes are compared.  Null text and text without words have
    fingerprint zero and link like any other; a null doc_id stands for no
    document when the smallest id is taken (null if a component has none);
    repeated rows give repeated results.
    """
    rows = cut(fingerprints(docs, width))
    classes = cut(rows.groupBy("fp").agg(F.min("doc_id").alias("rep")))
    found = components(links(classes.where("rep IS NOT NULL")))
    named = classes.join(found, F.col("rep") == F.col("node"), "left").select(F.col("fp").alias("c_fp"), F.coalesce("component", "rep").alias("component_id"))
    return rows.join(named, F.col("fp") == F.col("c_fp")).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """One row of each component of docs, all columns.

    Components are those of five-word shingle sets of similarity 0.8 or more:
    long fingerprints bring candidates together, and these are counted.  The row of the smallest doc_id stays, null ids last,
    then that of the smallest XXH64 of the text.  If rows of one id would stay
    for several components, only the one of smallest XXH64 does; null ids are
    no documents of one id.  Of rows with equal id and text any one stays.
    """
    from .near_copies import near_copies

    names = ["__null", "__id", "__th"]
    first = near_copies(docs).groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("__null"), F.coalesce("doc_id", F.lit(0)).alias("__id"), F.col("th").alias("__th"))).alias("r")).select("r.*")
    several = F.when(F.col("__null"), F.col("__th"))
    kept = first.groupBy("__null", "__id", several.alias("__own")).agg(F.min("__th").alias("__th")).select(*names)
    doc_id = F.col("doc_id").cast("long")
    rows = docs.withColumns({"__null": doc_id.isNull(), "__id": F.coalesce(doc_id, F.lit(0)), "__th": F.xxhash64(F.col("text").cast("string"))})
    return rows.dropDuplicates(names).join(kept, names, "left_semi").select(*docs.columns)
