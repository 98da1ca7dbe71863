"""Near-duplicates among embeddings by int8 tile products with rigorous error bounds."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, cut
from .simhash import roots_of

THRESHOLD = 0.93
#: Vectors of a block at most, and values; a task compares two blocks, a tile product has TILE rows.
BLOCK, BLOCK_VALUES, TILE = 16_384, 1 << 21, 512


def quantise(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """int8 codes of unit vectors, scales, error norms and norms of what the codes stand for."""
    scale = np.maximum(np.abs(unit).max(axis=1), 1e-300) / 127
    codes = np.rint(unit / scale[:, None]).astype(np.int8)
    back = codes * scale[:, None]
    return codes, scale, np.linalg.norm(unit - back, axis=1), np.linalg.norm(back, axis=1)


def tile_pairs(x: np.ndarray, y: np.ndarray, threshold: float, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i, j) with cosine(x[i], y[j]) >= threshold; i < j if both are the same block.

    With x = a + e and y = b + f, where a and b are decoded codes, the error
    x.y - a.b is a.f + e.y, at most |a||f| + |e||y|.  Only pairs whose bound
    reaches the threshold are recomputed in double precision.  float32 holds
    the integer products exactly up to 1040 dimensions, double beyond.
    """
    nx, ny = np.linalg.norm(x, axis=1), np.linalg.norm(y, axis=1)
    cx, sx, ex, ax = quantise(x / nx[:, None])
    cy, sy, ey, _ = quantise(y / ny[:, None])
    kind = np.float32 if x.shape[1] * 127 * 127 < 1 << 24 else np.float64
    cx, cy = cx.astype(kind), cy.astype(kind)
    found_i, found_j = [], []
    for at in range(0, len(x), TILE):
        for to in range(at if same else 0, len(y), TILE):
            a, b = slice(at, at + TILE), slice(to, to + TILE)
            rough = (cx[a] @ cy[b].T).astype(np.float64) * sx[a, None] * sy[None, b]
            bound = ax[a, None] * ey[None, b] + ex[a, None] * (1 + 1e-9) + 1e-9
            i, j = np.nonzero(rough + bound >= threshold)
            i, j = i + at, j + to
            if same:
                i, j = i[i < j], j[i < j]
            for k in range(0, len(i), 1 << 16):
                p, q = i[k : k + (1 << 16)], j[k : k + (1 << 16)]
                exact = np.einsum("ij,ij->i", x[p], y[q]) / (nx[p] * ny[q])
                found_i.append(p[exact >= threshold])
                found_j.append(q[exact >= threshold])
    empty = np.empty(0, np.int64)
    return np.concatenate(found_i or [empty]), np.concatenate(found_j or [empty])


def _classes(vectors: DataFrame) -> DataFrame:
    """One row per label and distinct valid vector: label, embedding, rep (smallest vec_id), m (vectors)."""
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "label", F.col("embedding").cast("array<double>").alias("embedding"))
    ok = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("embedding", lambda x: x != 0)
    return v.withColumn("valid", F.coalesce(ok, F.lit(False)) & F.col("label").isNotNull())


def link_embeddings(vectors: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of vectors.

    Vectors of equal, non-null label link at cosine >= threshold in double
    precision.  Vectors that are null, empty or zero or hold null or non-finite
    components link with nothing, nor do vectors of different length.  Equal
    vectors are one class (a class of m vectors has m - 1 links inside), and
    classes are compared block by block: a label's classes are cut into blocks
    by a hash, each pair of blocks is a group of its own, and its result is a
    row per class with the number of links and the class that roots it, not the
    pairs.  Repeated rows of one vec_id are vectors of their own; a null vec_id
    is no smallest one, and is kept.  An empty table gives no rows.

    A label of n classes in b blocks sends each class b times and multiplies
    n * n / 2 codes: both grow with the square of a label's distinct vectors,
    the first divided by BLOCK.
    """
    rows = _classes(vectors)
    valid = rows.where("valid").withColumn("dim", F.size("embedding"))
    # a class is known by a number of its own, fixed by the checkpoint; its smallest vec_id may be null or another's too
    classes = cut(valid.groupBy("label", "dim", "embedding").agg(F.min("vec_id").alias("low"), F.count("*").alias("m")).withColumn("rep", F.monotonically_increasing_id()))
    sizes = classes.groupBy("label", "dim").agg(F.ceil(F.count("*") * F.greatest(F.lit(1 / BLOCK), F.col("dim") / BLOCK_VALUES)).cast("int").alias("blocks"))
    blocked = classes.join(sizes, ["label", "dim"]).withColumn("x", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    spread = blocked.withColumn("y", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    spread = spread.select("label", "dim", F.least("x", "y").alias("lo"), F.greatest("x", "y").alias("hi"), "x", "rep", "m", "embedding")

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("rep", kind="stable", ignore_index=True)
        vec = np.array(pdf["embedding"].tolist(), np.float64).reshape(len(pdf), -1)
        rep, m = pdf["rep"].to_numpy(), pdf["m"].to_numpy()
        lo, hi = pdf["lo"].iloc[0], pdf["hi"].iloc[0]
        if lo == hi:
            i, j = tile_pairs(vec, vec, threshold, True)
        else:
            left, right = np.flatnonzero(pdf["x"] == lo), np.flatnonzero(pdf["x"] == hi)
            i, j = tile_pairs(vec[left], vec[right], threshold, False)
            i, j = left[i], right[j]
        n = np.bincount(i, m[j], len(rep)) + np.bincount(j, m[i], len(rep))
        root = roots_of(len(rep), i, j)
        some = n > 0
        return pd.DataFrame({"rep": rep[some], "n": n[some].astype(np.int64), "root": rep[root[some]]})

    linked = cut(spread.groupBy("label", "dim", "lo", "hi").applyInPandas(compare, "rep long, n long, root long"))
    counted = linked.groupBy("rep").agg(F.sum("n").alias("n"))
    found = components(linked.select(F.col("rep").alias("a"), F.col("root").alias("b")))
    placed = classes.join(counted, "rep", "left").join(found, F.col("rep") == F.col("node"), "left").withColumn("of", F.coalesce("component", "rep"))
    lows = placed.groupBy("of").agg(F.min("low").alias("component_low"))
    named = placed.join(lows, "of").select(
        F.col("label").alias("c_label"), F.col("embedding").alias("c_embedding"), (F.coalesce("n", F.lit(0)) + F.col("m") - 1).alias("n"), F.col("component_low").alias("component"),
    )
    out = rows.join(named, F.col("valid") & (F.col("label") == F.col("c_label")) & (F.col("embedding") == F.col("c_embedding")), "left")
    return out.select(
        "vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "vec_id").alias("component_id"),
        F.coalesce(F.col("vec_id") == F.coalesce("component", "vec_id"), F.lit(True)).alias("kept"),
    )
