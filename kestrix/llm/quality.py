"""Quality rules with risk-controlled thresholds, in DataFrame operations only.

Every rule is a ratio of a document; a rule with a cutoff rejects documents
above it.  Labelled documents are a holdout: for each stratum, rule and cutoff
of a fixed grid, an exact binomial tail tests the hypothesis "more than
``risk`` of the good documents would be rejected".  The smallest cutoff whose
hypothesis is refuted at level ``delta`` divided by the number of all tests
(Bonferroni over strata, rules and cutoffs) becomes the stratum's threshold; a
rule without one is off there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, SPACE_CHARS, cut

#: Largest allowed share of good documents that all rules together reject, per stratum.
RISK = 0.03
#: Chance that any threshold breaks its promise.
DELTA = 0.05
#: Cutoffs tried for each rule, as ratios.
GRID = {
    "symbols": (0.1, 0.2, 0.5, 1.0),
    "dup_lines": (0.3, 0.5, 0.7),
    "repeats": (0.3, 0.4, 0.5),
    "long_words": (10.0, 12.0, 15.0),
    "upper": (0.3, 0.5, 0.7),
    "bangs": (0.1, 0.2, 0.5),
}
#: Texts up to this many words sort packed positions; longer ones take the general sort.
PACKED_WORDS = 1 << 24
FEATURES, STRATUM = "__quality_features", "__quality_stratum"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _let(value: Column, body) -> Column:
    """body(value), with value evaluated once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _adjacent_equal(sorted_keys: Column, n: Column, key) -> Column:
    """Indices j with key(j) = key(j + 1) in a sorted array of n elements."""
    return F.filter(F.when(n > 1, F.sequence(F.lit(0), n - 2)).otherwise(F.array().cast("array<int>")), lambda j: key(sorted_keys, j) == key(sorted_keys, j + 1))


def _repeat_words(w: Column) -> Column:
    """Words inside 3-word windows that occur twice or more, the first included.

    Windows whose 40-bit hashes meet are found in one primitive sort; they
    alone are then compared as text, so the count is exact.
    """
    at = lambda a, i: F.get(a, i)

    def exact(positions: Column) -> Column:
        keyed = F.sort_array(F.transform(positions, lambda p: F.struct(F.concat_ws(" ", at(w, p), at(w, p + 1), at(w, p + 2)).alias("s"), p.alias("p"))))

        def covered(k: Column) -> Column:
            pairs = _adjacent_equal(k, F.size(k), lambda a, j: F.get(a, j)["s"])
            words = F.flatten(F.transform(pairs, lambda j: F.flatten(F.transform(F.array(j, j + 1), lambda x: _let(F.get(k, x)["p"], lambda p: F.array(p, p + 1, p + 2))))))
            return F.size(F.array_distinct(words)).cast("long")

        return _let(keyed, covered)

    starts = F.sequence(F.lit(0), F.size(w) - 3)
    packed = F.sort_array(F.transform(starts, lambda i: F.shiftleft(F.xxhash64(at(w, i), at(w, i + 1), at(w, i + 2)), 24).bitwiseOR(i.cast("long"))))

    def candidates(s: Column) -> Column:
        pairs = _adjacent_equal(s, F.size(s), lambda a, j: F.shiftright(F.get(a, j), 24))
        where = lambda x: F.get(s, x).bitwiseAND(F.lit((1 << 24) - 1)).cast("int")
        return F.array_distinct(F.flatten(F.transform(pairs, lambda j: F.array(where(j), where(j + 1)))))

    some = _let(_let(packed, candidates), lambda c: F.when(F.size(c) > 1, exact(c)).otherwise(F.lit(0).cast("long")))
    return F.when(F.size(w) < 3, F.lit(0).cast("long")).when(F.size(w) <= PACKED_WORDS, some).otherwise(exact(starts))


def measures(text: Column) -> Column:
    """A struct of the five counts, lines, upper-case letters and bangs of a text; all zero for null or empty text.

    It is one expression that names the text once.  A plan that filters by
    its fields must bind it (_let) or keep it, or each field is counted anew.
    """
    text = F.coalesce(text, F.lit(""))
    chars = lambda s: F.char_length(s).cast("long")
    less = lambda t, pattern: chars(t) - chars(F.regexp_replace(t, pattern, ""))

    def counted(t: Column) -> Column:
        trimmed = F.btrim(t, F.lit(SPACE_CHARS))
        words = F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, f"[{SPACE}]+"))
        lines = F.filter(F.split(t, "\n"), lambda x: F.btrim(x, F.lit(SPACE_CHARS)) != "")
        line_part = _let(lines, lambda a: F.struct(F.size(a).cast("long").alias("n_lines"), (F.size(a) - F.size(F.array_distinct(a))).cast("long").alias("n_dup_lines")))
        word_part = _let(words, lambda w: F.struct(F.size(w).cast("long").alias("n_words"), chars(F.array_join(w, "")).alias("word_chars"), _repeat_words(w).alias("n_repeat_words")))
        return F.struct(
            word_part.alias("w"), line_part.alias("l"), less(t, r"[#*$%&|<>]").alias("n_symbols"),
            less(t, r"[A-ZÀ-Þ]").alias("n_upper"), less(t, "!").alias("n_bangs"),
        )

    def flat(f: Column) -> Column:
        return F.struct(
            f["w"]["n_words"].alias("n_words"), f["w"]["word_chars"].alias("word_chars"), f["n_symbols"].alias("n_symbols"), f["l"]["n_dup_lines"].alias("n_dup_lines"),
            f["w"]["n_repeat_words"].alias("n_repeat_words"), f["l"]["n_lines"].alias("n_lines"), f["n_upper"].alias("n_upper"), f["n_bangs"].alias("n_bangs"),
        )

    return _let(_let(text, counted), flat)


def features(docs: DataFrame) -> DataFrame:
    """docs with measures() as the column FEATURES."""
    return docs.withColumn(FEATURES, measures(F.col("text")))


def _base_failed(f: Column) -> Column:
    return (f["n_words"] < 50) | (100 * f["n_repeat_words"] > 50 * f["n_words"])


def _ratios(f: Column) -> Column:
    """map rule -> ratio; every denominator is at least one."""
    over = lambda a, b: a / F.greatest(b, F.lit(1))
    n = f["n_words"]
    return F.create_map(
        F.lit("symbols"), over(f["n_symbols"], n), F.lit("dup_lines"), over(f["n_dup_lines"], f["n_lines"]), F.lit("repeats"), over(f["n_repeat_words"], n),
        F.lit("long_words"), over(f["word_chars"], n), F.lit("upper"), over(f["n_upper"], f["word_chars"]), F.lit("bangs"), over(f["n_bangs"], n),
    )


def _log_factorial(n: Column) -> Column:
    """ln n! by Stirling's series after a shift by ten; its error is below 1e-13."""
    x = n.cast("double") + 11
    shift = F.aggregate(F.sequence(F.lit(1), F.lit(10)), F.lit(0.0), lambda a, i: a + F.ln(n.cast("double") + i))
    series = (x - 0.5) * F.ln(x) - x + 0.9189385332046727 + 1 / (12 * x) - 1 / (360 * x * x * x) + 1 / (1260 * F.pow(x, F.lit(5)))
    return series - shift


def binomial_tail(k: Column, n: Column, p: float) -> Column:
    """P(X <= k) for X ~ Binomial(n, p): the mass at k times the sum of the falling ratios below it.

    The sum ends at 0 or 45 standard deviations (and 45) under k, beyond which
    a double holds nothing of it.  For k >= n * p it is 1, an upper bound.
    """
    mass = F.exp(_log_factorial(n) - _log_factorial(k) - _log_factorial(n - k) + k * F.ln(F.lit(p)) + (n - k) * F.ln(F.lit(1 - p)))
    low = F.greatest(F.lit(1).cast("long"), k - F.ceil(45 + 45 * F.sqrt(n * p)))
    steps = F.when(k >= low, F.sequence(k, low, F.lit(-1).cast("long"))).otherwise(F.array().cast("array<long>"))
    start = F.struct(F.lit(1.0).alias("sum"), F.lit(1.0).alias("term"))

    def add(a: Column, j: Column) -> Column:
        term = a["term"] * j / (n - j + 1) * ((1 - p) / p)
        return F.struct((a["sum"] + term).alias("sum"), term.alias("term"))

    return F.when(k >= n * p, F.lit(1.0)).otherwise(F.least(F.lit(1.0), mass * F.aggregate(steps, start, add, lambda a: a["sum"])))


def thresholds(measured: DataFrame, labels: DataFrame, risk: float = RISK, delta: float = DELTA) -> DataFrame:
    """(stratum, rule, cutoff): the smallest certified cutoff of each rule and stratum.

    measured has doc_id and the columns FEATURES and STRATUM; labels has doc_id
    and quality.  The holdout is every labelled document of quality 1 that
    passes the base rules; a document labelled more than once counts as good if
    any label says so, a null label says nothing.  Each rule gets an equal part
    of risk, each test an equal part of delta.
    """
    good = labels.where("quality = 1 AND doc_id IS NOT NULL").select(F.col("doc_id").alias("__good_id")).distinct()
    f = F.col(FEATURES)
    held = measured.where(~_base_failed(f)).select("doc_id", STRATUM, F.explode(_ratios(f)).alias("rule", "ratio")).join(good, F.col("doc_id") == F.col("__good_id"))
    grid = [(r, c) for r, cuts in GRID.items() for c in cuts]
    over = [F.sum(((F.col("rule") == r) & (F.col("ratio") > c)).cast("long")).alias(f"k{i}") for i, (r, c) in enumerate(grid)]
    counts = held.groupBy(STRATUM).agg((F.count("*") / len(GRID)).cast("long").alias("n"), *over)
    strata = F.count("*").over(_whole())
    tests = counts.withColumn("strata", strata).select(STRATUM, "n", "strata", F.explode(F.array(*(F.struct(F.lit(r).alias("rule"), F.lit(c).alias("cutoff"), F.col(f"k{i}").alias("k")) for i, (r, c) in enumerate(grid)))).alias("t"))
    refuted = binomial_tail(F.col("t.k"), F.col("n"), risk / len(GRID)) <= F.lit(delta) / (len(grid) * F.col("strata"))
    return tests.where(refuted).groupBy(STRATUM, F.col("t.rule").alias("rule")).agg(F.min("t.cutoff").alias("cutoff"))


def _whole():
    from pyspark.sql import Window

    return Window.partitionBy(F.lit(0))


#: Strata whose cutoffs are sent to every executor; with more of them they are joined by a shuffle.
BROADCAST_STRATA = 10_000


def _bounds(cutoffs: DataFrame) -> DataFrame:
    """(__cut_stratum, __cut map rule -> cutoff), broadcast if it is small."""
    maps = cut(cutoffs.groupBy(F.col(STRATUM).alias("__cut_stratum")).agg(F.map_from_entries(F.collect_list(F.struct("rule", "cutoff"))).alias("__cut")))
    return F.broadcast(maps) if maps.count() <= BROADCAST_STRATA else maps


def _kept(f: Column, bounds: Column) -> Column:
    """Whether measures pass the base rules and the cutoffs (null: none)."""
    broken = F.exists(F.map_entries(_ratios(f)), lambda e: F.coalesce(e["value"] > F.try_element_at(bounds, e["key"]), F.lit(False)))
    return ~_base_failed(f) & ~F.when(bounds.isNull(), F.lit(False)).otherwise(broken)


def quality(docs: DataFrame, labels: DataFrame, risk: float = RISK, delta: float = DELTA) -> DataFrame:
    """One row per row of docs: doc_id, the five counts, base_failed and kept.

    base_failed holds for fewer than 50 words or more than half of the words
    inside repeated 3-word windows; kept is false then, and also if a certified
    threshold of the document's stratum (its lang; null counts as one stratum)
    is exceeded.  Null text has no words.  Repeated rows give repeated results;
    without labels no threshold can be certified and only the base rules hold.
    The counts of all texts are made once and kept in the checkpoint folder.
    """
    lang = F.col("lang") if "lang" in docs.columns else F.lit(None).cast("string")
    slim = docs.select("doc_id", "text", lang.alias("lang"))
    measured = cut(features(slim).select("doc_id", F.coalesce("lang", F.lit("")).alias(STRATUM), FEATURES))
    bounds = _bounds(thresholds(measured, labels, risk, delta))
    f = F.col(FEATURES)
    joined = measured.join(bounds, F.col(STRATUM) == F.col("__cut_stratum"), "left")
    return joined.select("doc_id", *(f[c].alias(c) for c in COUNTS), _base_failed(f).alias("base_failed"), _kept(f, F.col("__cut")).alias("kept"))


def keep_quality(docs: DataFrame, labels: DataFrame, risk: float = RISK, delta: float = DELTA) -> DataFrame:
    """Rows of docs whose verdict is kept, all columns as they were.

    Each row is judged by its own text, so repeated ids need no join and texts
    are never shuffled: a first pass counts all texts for the thresholds, whose
    holdout is joined by id and counts alone, and a second one filters.
    """
    lang = F.col("lang") if "lang" in docs.columns else F.lit(None).cast("string")
    stratum = F.coalesce(lang, F.lit(""))
    measured = cut(features(docs.select("doc_id", "text", stratum.alias(STRATUM))).select("doc_id", STRATUM, FEATURES))
    bounds = _bounds(thresholds(measured, labels, risk, delta))
    joined = docs.withColumn(STRATUM, stratum).join(bounds, F.col(STRATUM) == F.col("__cut_stratum"), "left")
    return joined.where(_let(measures(F.col("text")), lambda f: _kept(f, F.col("__cut")))).select(*docs.columns)
