"""Mixing sources to target weights by temperature.

Source token shares are raised to an exponent and normalised; bisection finds
the exponent that meets a target entropy, or the least one that keeps every
source within a repetition limit.  Weights times a token budget give each
source an allotment, realised as whole passes over a permutation of its blocks
and a last pass that ends where the allotment does.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE, SPACE_CHARS, cut

#: Share of the way from the sources' own entropy to that of equal weights.
ENTROPY = 0.5
#: No source is passed over more often than this.
REPETITION = 4.0
#: Tokens of a block.
BLOCK_TOKENS = 1 << 18
#: Sources whose shares the driver takes; with more of them sums over sources come back, for GRID exponents at a time.
DRIVER_SOURCES, GRID = 100_000, 63
#: Blocks whose table is broadcast; with more of them it is joined by a shuffle.
BROADCAST_BLOCKS = 100_000
COLUMNS = ("__mix_source", "__mix_tokens", "__mix_hash", "__mix_block")
#: Columns that mix adds, and their names inside.
ADDED = {"epoch": "__mix_epoch", "block": "__mix_block", "n_tokens": "__mix_tokens", "position": "__mix_position"}


def weights(shares: np.ndarray, exponent: float) -> np.ndarray:
    w = np.exp(exponent * np.log(shares) - (exponent * np.log(shares)).max())
    return w / w.sum()


def entropy(w: np.ndarray) -> float:
    return float(-(w[w > 0] * np.log(w[w > 0])).sum())


def solve(tokens: np.ndarray, budget: float, target: float | None = ENTROPY, repetition: float | None = REPETITION) -> tuple[float, np.ndarray]:
    """Exponent in [0, 1] and weights.

    Entropy falls and the most repeated source's repetition falls as the
    exponent rises to 1, so each bound is met by bisection and the larger
    exponent meets both.  A repetition limit below budget / tokens, which no
    exponent meets, gives exponent 1.
    """
    shares = tokens / tokens.sum()
    own = entropy(shares)

    def bisect(ok) -> float:
        """Least exponent for which ok holds, if it holds from some point on."""
        if ok(0.0):
            return 0.0
        low, high = 0.0, 1.0
        for _ in range(60):
            mid = (low + high) / 2
            low, high = (low, mid) if ok(mid) else (mid, high)
        return high

    found = [0.0]
    if target is not None:
        goal = own + target * (math.log(len(shares)) - own)
        found.append(bisect(lambda a: entropy(weights(shares, a)) <= goal))
    if repetition is not None:
        found.append(bisect(lambda a: (weights(shares, a) * budget / tokens).max() <= repetition))
    exponent = max(found)
    return exponent, weights(shares, exponent)


def solve_table(totals: DataFrame, budget: float, target: float | None = ENTROPY, repetition: float | None = REPETITION) -> tuple[float, float, float]:
    """The exponent of solve for a table (n) of sources' tokens, the log of its normaliser, and all tokens.

    Entropy and the largest repetition of an exponent are functions of three
    aggregates; a search by GRID exponents at a time takes ten of them.
    """
    whole, least, k = (float(x or 0) for x in totals.agg(F.sum("n"), F.min("n"), F.count("*")).first())
    log_share = F.ln(F.col("n") / whole)

    def measured(exponents: list[float]) -> list[tuple[float, float]]:
        """Entropy and log-normaliser of each exponent."""
        sums = [x for a in exponents for x in (F.sum(F.exp(a * log_share)), F.sum(F.exp(a * log_share) * log_share))]
        row = totals.agg(*(s.alias(f"s{i}") for i, s in enumerate(sums))).first()
        return [(math.log(row[2 * i]) - a * row[2 * i + 1] / row[2 * i], math.log(row[2 * i])) for i, a in enumerate(exponents)]

    own = measured([1.0])[0][0]
    goal = None if target is None else own + target * (math.log(k) - own)
    # the least source is repeated most: its weight is share^a / normaliser
    meets = lambda a, m: (goal is None or m[0] <= goal) and (repetition is None or a * math.log(least / whole) - m[1] + math.log(budget / least) <= math.log(repetition))
    low, high = 0.0, 1.0
    if meets(0.0, measured([0.0])[0]):
        high = 0.0
    while high - low > 1e-15 * max(high, 1e-3):
        tried = [low + (high - low) * i / (GRID + 1) for i in range(1, GRID + 1)]
        if tried[0] <= low or tried[-1] >= high:
            break
        ok = [meets(a, m) for a, m in zip(tried, measured(tried))]
        at = ok.index(True) if True in ok else GRID
        low, high = (tried[at - 1] if at else low), (tried[at] if at < GRID else high)
    return high, measured([high])[0][1], whole


def mix(docs: DataFrame, budget: int | None = None, target: float | None = ENTROPY, repetition: float | None = REPETITION, seed: int = 0) -> DataFrame:
    """Rows of docs as often as their source's allotment asks, with epoch, block and position.

    docs has doc_id, text, source; a document's tokens are its words and one
    end mark, so none has zero.  budget is in such tokens, all of docs' by
    default.  A null source is a source.  position in [0, 1) orders blocks so
    that every stretch of the output holds the sources in their weights; rows
    of a block are ordered by a hash.  Allotments are met to within one
    document.  Columns epoch, block, n_tokens, position are added, replacing
    any of those names; an empty table gives no rows.
    """
    out = _mixed(docs, budget, target, repetition, seed)
    return out.select(*(c for c in docs.columns if c not in ADDED), *(F.col(c).alias(name) for name, c in ADDED.items()))


def _mixed(docs: DataFrame, budget: int | None, target: float | None, repetition: float | None, seed: int) -> DataFrame:
    spark = docs.sparkSession
    source, tokens, hashed, block = COLUMNS
    trimmed = F.btrim(F.coalesce("text", F.lit("")), F.lit(SPACE_CHARS))
    words = F.when(trimmed == "", 0).otherwise(F.size(F.split(trimmed, f"[{SPACE}]+")))
    rows = docs.withColumns({source: F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n")), tokens: (words + 1).cast("long"), hashed: F.xxhash64(F.lit(seed), "doc_id", F.col("text"))})
    slim = cut(rows.select(source, tokens, hashed))
    sources = slim.groupBy(source).agg(F.sum(tokens).alias("n"))
    totals = sources.limit(DRIVER_SOURCES + 1).collect()
    if len(totals) <= DRIVER_SOURCES:
        names, counts = [r[0] for r in totals], np.array([r["n"] for r in totals], float)
        budget = counts.sum() if budget is None else budget
        _, share = solve(counts, budget, target, repetition) if names else (1.0, counts)
        plan = [(s, int(n), float(w * budget), int(max(1, math.ceil(n / BLOCK_TOKENS)))) for s, n, w in zip(names, counts, share)]
        allot = F.broadcast(spark.createDataFrame(plan, "__mix_s string, __mix_total long, __mix_allotment double, __mix_n_blocks int"))
    else:
        sources = cut(sources)
        budget = sources.agg(F.sum("n")).first()[0] if budget is None else budget
        exponent, log_norm, whole = solve_table(sources, budget, target, repetition)
        weight = F.exp(exponent * F.ln(F.col("n") / whole) - log_norm)
        allot = cut(sources.select(F.col(source).alias("__mix_s"), F.col("n").alias("__mix_total"), (weight * float(budget)).alias("__mix_allotment"), F.greatest(F.lit(1), F.ceil(F.col("n") / BLOCK_TOKENS)).cast("int").alias("__mix_n_blocks")))

    def blocked(d: DataFrame) -> DataFrame:
        return d.join(allot, F.col(source) == F.col("__mix_s"), "left").withColumn(block, F.pmod(F.xxhash64(F.lit("block"), hashed), F.col("__mix_n_blocks")).cast("int"))

    sizes = blocked(slim).groupBy(source, block).agg(F.sum(tokens).alias("size"), F.first("__mix_total").alias("total"), F.first("__mix_allotment").alias("allotment"))
    # every block once for each pass that the allotment reaches, in the order of the pass's permutation
    passes = F.ceil(F.col("allotment") / F.col("total")).cast("int")
    passed = sizes.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.greatest(passes - 1, F.lit(0)))))
    # the order is by hash, summed in two levels: over 256 parts of a pass, and inside each
    passed = passed.withColumn("__h", F.xxhash64(F.lit(seed), source, "epoch", block)).withColumn("__part", F.shiftright("__h", 56))
    upto = (Window.unboundedPreceding, -1)
    parts = passed.groupBy(source, "epoch", "__part").agg(F.sum("size").alias("__part_size"))
    parts = parts.withColumn("__parts_before", F.coalesce(F.sum("__part_size").over(Window.partitionBy(source, "epoch").orderBy("__part").rowsBetween(*upto)), F.lit(0))).drop("__part_size")
    order = Window.partitionBy(source, "epoch", "__part").orderBy("__h", block).rowsBetween(*upto)
    before = F.coalesce(F.sum("size").over(order), F.lit(0)) + F.col("__parts_before") + F.col("epoch") * F.col("total")
    table = passed.join(parts, [source, "epoch", "__part"]).withColumn("before", before).where("before < allotment")
    table = cut(table.select(F.col(source).alias("__mix_b_source"), F.col(block).alias("__mix_b_block"), F.col("epoch").alias(ADDED["epoch"]), (F.col("allotment") - F.col("before")).alias("__mix_room"), F.col("size").alias("__mix_size"), (F.col("before") / F.col("allotment")).alias(ADDED["position"])))
    near = F.broadcast(table) if table.count() <= BROADCAST_BLOCKS else table
    met = blocked(rows).join(near, (F.col(source) == F.col("__mix_b_source")) & (F.col(block) == F.col("__mix_b_block")))
    kept = [*docs.columns, *ADDED.values()]
    whole = met.where("__mix_room >= __mix_size").select(*kept)
    # the block in which an allotment ends, one a source: its first documents by hash
    inside = Window.partitionBy(source, block, ADDED["epoch"]).orderBy(hashed, "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    last = met.where("__mix_room < __mix_size").withColumn("__mix_before", F.coalesce(F.sum(tokens).over(inside), F.lit(0))).where("__mix_before < __mix_room")
    return whole.unionByName(last.select(*kept))


def mix_documents(docs: DataFrame, budget: int | None = None, target: float | None = ENTROPY, repetition: float | None = REPETITION, seed: int = 0) -> DataFrame:
    """The rows of mix with the columns of docs alone, as they were."""
    return _mixed(docs, budget, target, repetition, seed).select(*docs.columns)
