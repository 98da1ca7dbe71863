"""Language identification by multilingual mixture inference.

Each language is a distribution over hashed character n-grams (lengths 1 to
3, lower-cased, white space folded).  A document is a mixture of languages:
expectation-maximisation estimates its proportions from all its n-grams, and
the set of languages is chosen by penalised likelihood, dropping the weakest
language as long as that raises log-likelihood minus penalty.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Labelled documents of each language the classifier is fitted on, at most; those of smallest hash.
FIT_ROWS = 4000
#: Languages a model may have; more labelled values than this raise an error.
MAX_LANGUAGES = 500
BUCKETS = 1 << 16
ROUNDS, SMOOTH = 12, 0.5
#: Code points counted in one go, for up to FEW languages and fewer for more; longer texts are counted in slices.
CHUNK, FEW = 400_000, 8
_FOLD = np.uint64(0x9E3779B97F4A7C15)


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2


def _grams(points: np.ndarray) -> np.ndarray:
    """Bucket of the 1-, 2- and 3-gram that ends at every code point, [3, n]; starts of a document reach into the space before it."""
    p = points.astype(np.uint64)
    one = p
    two = one.copy()
    two[1:] += p[:-1] << np.uint64(21)
    three = two.copy()
    three[2:] += p[:-2] << np.uint64(42)
    mix = lambda x, k: (((x + np.uint64(k)) * _FOLD) >> np.uint64(48)).astype(np.int32)
    return np.stack([mix(one, 1), mix(two, 2), mix(three, 3)])


def _folded(text: str) -> Iterator[np.ndarray]:
    """Code points of the lower-cased text, each run of what is no letter a single space, in slices of about CHUNK."""
    last = False  # whether the last code point was a letter; the text begins after a space
    yield np.array([32], np.uint32)
    for at in range(0, len(text), CHUNK):
        p = np.frombuffer(text[at : at + CHUNK].lower().encode("utf-32-le", "surrogatepass"), np.uint32)
        letter = _LETTER[np.minimum(p, len(_LETTER) - 1)]
        p = np.where(letter, p, 32).astype(np.uint32)
        keep = letter.copy()
        keep[1:] |= letter[:-1]
        keep[:1] |= last
        last = bool(letter[-1]) if len(letter) else last
        yield p[keep]
    if last:
        yield np.array([32], np.uint32)


def _letters() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x30000)), bool, 0x30000)


_LETTER = _letters()


def counts_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, bucket, count) of the n-grams of whole texts, sorted by document."""
    docs, buckets, counts = [], [], []
    part, size, first = [], 0, 0

    def flush(last: int) -> None:
        nonlocal part, size, first
        if part:
            owner = np.repeat(np.arange(first, last), [len(x) for x in part])
            grams = _grams(np.concatenate(part)).astype(np.int64) + owner * BUCKETS
            key, n = np.unique(grams.ravel(), return_counts=True)
            docs.append(key // BUCKETS)
            buckets.append(key % BUCKETS)
            counts.append(n)
        part, size, first = [], 0, last

    for i, t in enumerate(texts):
        if len(t) <= CHUNK:
            part.append(np.concatenate([*_folded(t)]))
            size += len(part[-1])
            if size > CHUNK:
                flush(i + 1)
            continue
        flush(i)
        total, before = np.zeros(BUCKETS, np.int64), np.empty(0, np.uint32)
        for p in _folded(t):  # the two code points before a slice begin its n-grams
            whole = np.concatenate([before, p])
            total += np.bincount(_grams(whole)[:, len(before) :].ravel(), minlength=BUCKETS)
            before = whole[-2:]
        some = np.flatnonzero(total)
        docs.append(np.full(len(some), i))
        buckets.append(some)
        counts.append(total[some])
        first = i + 1
    flush(len(texts))
    empty = np.empty(0, np.int64)
    return np.concatenate(docs or [empty]), np.concatenate(buckets or [empty]), np.concatenate(counts or [empty])


def fit(docs: DataFrame, fit_rows: int = FIT_ROWS) -> tuple[list[str], np.ndarray]:
    """Languages and their log-probabilities [buckets, languages], from documents that are not held out.

    docs has doc_id, text, lang.  At most fit_rows documents of a language are
    read, those of the smallest hash; their n-grams are counted on the
    executors and only counts (languages x buckets) reach the driver.
    """
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~F.coalesce(held_out(F.col("doc_id")), F.lit(False)))
    sizes = known.groupBy("lang").agg(F.count("*").alias("n")).limit(MAX_LANGUAGES + 1).collect()
    if len(sizes) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    # a language's share of hashes that holds twice the rows wanted; only those are ranked
    if not sizes:
        return [], np.zeros((BUCKETS, 0))
    share = F.coalesce(*(F.when(F.col("lang") == r["lang"], F.lit(2.0 * fit_rows / r["n"])) for r in sizes))
    ids = known.select("doc_id", "lang", F.xxhash64(F.lit("fit"), "doc_id").alias("h")).where(F.col("h") / float(1 << 64) + 0.5 <= share)
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("h", "doc_id"))
    chosen = ids.withColumn("r", rank).where(F.col("r") <= fit_rows)
    bars = chosen.groupBy("lang").agg(F.max("h").alias("bar")).select(F.col("lang").alias("b_lang"), "bar").collect()
    langs = sorted(r["b_lang"] for r in bars)
    if not langs:
        return [], np.zeros((BUCKETS, 0))
    place = {x: i for i, x in enumerate(langs)}
    under = F.coalesce(*(F.when(F.col("lang") == r["b_lang"], F.lit(r["bar"])) for r in bars))
    sample = known.where(F.xxhash64(F.lit("fit"), "doc_id") <= under).select("text", "lang")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for b in batches:
            texts, of = b.column(0).to_pylist(), b.column(1).to_pylist()
            if texts:
                d, k, n = counts_of(texts)
                where = np.array([place[x] for x in of])[d]
                for i in np.unique(where):
                    total.setdefault(langs[i], np.zeros(BUCKETS))
                    total[langs[i]] += np.bincount(k[where == i], n[where == i], BUCKETS)
        for lang, n in total.items():
            some = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([place[lang]] * len(some), pa.int32()), pa.array(some.astype(np.int32)), pa.array(n[some].astype(np.int64))], ["l", "k", "n"])

    theta = np.full((BUCKETS, len(langs)), SMOOTH)
    got = sample.mapInArrow(run, "l int, k int, n long").groupBy("l", "k").agg(F.sum("n").alias("n")).toPandas()
    theta[got["k"], got["l"]] += got["n"]
    return langs, np.log(theta / theta.sum(axis=0))


def infer(texts: list[str], logp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the strongest language and its proportion, for whole texts."""
    best, share = np.zeros(len(texts), np.int64), np.zeros(len(texts))
    part, size, first = [], 0, 0
    most = CHUNK * FEW // max(FEW, logp.shape[1])
    for i, t in enumerate([*texts, None]):
        if t is None or size + len(t) > most and part:
            if part:
                best[first:i], share[first:i] = _infer(part, logp)
            part, size, first = [], 0, i
        if t is not None:
            part.append(t)
            size += len(t)
    return best, share


def _infer(texts: list[str], logp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    d, k, n = counts_of(texts)
    lp, n, size, L = logp[k], n.astype(np.float64), len(texts), logp.shape[1]
    starts = np.searchsorted(d, np.arange(size))
    top = lp.max(axis=1)
    like = np.exp(lp - top[:, None])
    single = np.add.reduceat(lp * n[:, None], starts, axis=0)
    base = np.add.reduceat(top * n, starts)
    total = np.add.reduceat(n, starts)
    penalty = 0.5 * np.log(np.maximum(total, 2))

    def em(docs: np.ndarray, pi: np.ndarray, rows: np.ndarray, owner: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        lk, w = like[rows], n[rows]
        for _ in range(ROUNDS):
            mixed = np.maximum((lk * pi[owner]).sum(axis=1), 1e-300)
            pi = pi * np.add.reduceat(lk * (w / mixed)[:, None], at, axis=0) / total[docs, None]
        mixed = np.maximum((lk * pi[owner]).sum(axis=1), 1e-300)
        return pi, np.add.reduceat(np.log(mixed) * w, at) + base[docs]

    pi = np.zeros((size, L))
    one = single.argmax(axis=1)
    pi[np.arange(size), one] = 1.0
    score = single[np.arange(size), one] - penalty
    # documents whose likelihood could rise by more than one penalty if n-grams chose their language freely
    open_ = np.flatnonzero(base - single[np.arange(size), one] > penalty) if L > 1 else np.empty(0, np.int64)
    active = np.ones((len(open_), L), bool)
    docs = open_
    while len(docs):
        inside = np.zeros(size, bool)
        inside[docs] = True
        rows = np.flatnonzero(inside[d])
        new = np.cumsum(inside) - 1
        owner = new[d[rows]]
        at = np.searchsorted(owner, np.arange(len(docs)))
        p, ll = em(docs, active / active.sum(axis=1)[:, None], rows, owner, at)
        value = ll - penalty[docs] * active.sum(axis=1)
        better = value > score[docs]
        pi[docs[better]], score[docs[better]] = p[better], value[better]
        weakest = np.where(active, p, np.inf).argmin(axis=1)
        active[np.arange(len(docs)), weakest] = False
        go = active.sum(axis=1) > 1
        docs, active = docs[go], active[go]
    return pi.argmax(axis=1), pi.max(axis=1)


def identify(docs: DataFrame, langs: list[str], logp: np.ndarray) -> DataFrame:
    """(doc_id, lang_pred, score) for every row of docs from its text alone.

    ``und`` with score 0 for null text, text without a letter, or no learned
    language.  The model is langs x buckets, bounded by MAX_LANGUAGES, and is
    broadcast.
    """
    model = docs.sparkSession.sparkContext.broadcast((langs, logp.astype(np.float64)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, table = model.value
        for b in batches:
            texts = [t if t is not None and any(map(str.isalpha, t)) else None for t in b.column(1).to_pylist()]
            pred, score = ["und"] * len(texts), np.zeros(len(texts))
            known = [i for i, t in enumerate(texts) if t is not None] if names else []
            if known:
                best, share = infer([texts[i] for i in known], table)
                for i, x in zip(known, best):
                    pred[i] = names[x]
                score[known] = np.minimum(share, 1.0)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(pred, pa.string()), pa.array(score)], ["doc_id", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, lang_pred string, score double")


def identify_documents(docs: DataFrame, fit_rows: int = FIT_ROWS) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row of docs.

    The model learns from text and lang of rows that are not held out (crc32
    of doc_id modulo 4 is not 2; a null doc_id is not held out).  Repeated rows
    give repeated results, other columns are ignored, an empty table gives none.
    """
    langs, logp = fit(docs.select("doc_id", "text", "lang"), fit_rows)
    out = identify(docs, langs, logp)
    return out.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "lang_pred", "score")
