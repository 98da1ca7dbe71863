"""Exact substring dedup by a sparse, range-partitioned suffix array.

A byte goes if a string of LENGTH bytes that covers it also starts earlier.

* Every window of LENGTH bytes has an anchor, the position inside it whose
  32 bytes have the smallest hash; equal windows have equal anchors.  Only
  suffixes at anchors are candidates, and only those whose 32 bytes occur
  twice or more anywhere are kept.
* Sampled splitters range-partition the kept suffixes by their leading 16
  bytes, so suffixes with equal leads never stand on two sides of a boundary
  and neighbours are compared inside their bucket.
* A bucket is streamed in lead order.  A multikey sort, eight bytes a key and
  only what is still tied at each, first folds suffixes with equal
  surroundings, then orders the windows of what is left; of equal windows all
  but the earliest are repeats.
* Anchors that occur more than HOT times are taken apart into their windows
  where the text is read.  Equal windows are folded there before the shuffle,
  so a passage in a third of all documents sends a row per batch, not per copy.
  Windows are partitioned and sorted by all their bytes: equal ones are
  neighbours, and what follows a very common line spreads over all buckets.
* The very common anchors of a sample of documents are known before the others
  are grouped.  They take the same way as those found by counting, but are
  dealt out at random and not by their hash.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import shuffle_partitions, tidy

LENGTH, GRAM = 100, 32
REACH = LENGTH - GRAM  # bytes before an anchor that one of its windows can have
#: Occurrences of an anchor up to which its surroundings are shuffled whole.
HOT = 20_000
#: Bytes hashed in one go, at most 2^22 with the reach; longer documents overlap.
SLICE = 1 << 21
#: Suffixes a bucket works on at a time, cut where the lead changes.
CHUNK = 24_000
#: Anchors that one task groups, of which each takes some 30 bytes.
ANCHORS = 1_000_000
#: One of so many documents is sampled for very common anchors; of those at most COMMON are dealt out at random.
SAMPLED, COMMON = 64, 65_536
_DEALT = 1 << 16  # in span: an anchor known to be hot, whose hash is a random number
_NO_ID = -(1 << 63)
_BASE = 0x9E3779B97F4A7C15
_U = np.uint64


def _powers(base: int, n: int) -> np.ndarray:
    p = np.full(n, base, _U)
    p[0] = 1
    return np.cumprod(p)


class _Hasher:
    """Hashes of all strings of a fixed length in a byte array, by prefix sums modulo 2^64."""

    def __init__(self):
        self.clear()

    def clear(self) -> None:
        self.up = self.down = np.empty(0, _U)

    def __call__(self, s: np.ndarray, size: int, base: int = _BASE) -> np.ndarray:
        if len(s) > len(self.up):
            self.up, self.down = _powers(base, len(s)), _powers(pow(base, -1, 1 << 64), len(s))
        total = np.empty(len(s) + 1, _U)
        total[0] = 0
        np.cumsum(s * self.up[: len(s)], out=total[1:])
        h = total[size:] - total[:-size]
        h *= self.down[: len(h)]
        h ^= h >> _U(32)
        h *= _U(0xD6E8FEB86659FD93)
        h ^= h >> _U(32)
        return h


_hash = _Hasher()


def _forget() -> None:
    _hash.clear()


def anchors(s: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
    """Anchor position, its hash, and first and last window start of every anchor.

    s holds documents that end at ends, at most 2^22 bytes.
    """
    if len(s) < LENGTH:
        return (np.empty(0, np.int64),) * 4
    h = _hash(s, GRAM)
    low = _U((1 << 22) - 1)
    m = (h & ~low) | np.arange(len(h), dtype=_U)  # the leftmost of equal hashes is the least
    width, want = 1, REACH + 1
    while width * 2 <= want:
        m = np.minimum(m[:-width], m[width:])
        width *= 2
    if width < want:
        m = np.minimum(m[: width - want], m[want - width :])
    valid = np.ones(len(s), bool)
    start = 0
    for e in ends:
        valid[max(start, e - LENGTH + 1) : e] = False
        start = e
    where = np.flatnonzero(valid[: len(m)])
    at = (m[where] & low).astype(np.int64)
    if not len(at):
        return (np.empty(0, np.int64),) * 4
    first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    last = np.concatenate([first[1:], [len(at)]]) - 1
    p = at[first]
    return p, h[p].view(np.int64), where[first], where[last]


def _binary(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a binary array without nulls."""
    _, offsets, data = column.buffers()
    kind = np.int64 if pa.types.is_large_binary(column.type) else np.int32
    off = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    s = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None and off[-1] > off[0] else np.empty(0, np.uint8)
    return s, off - off[0]


def _slices(off: np.ndarray, size: int) -> Iterator[tuple[int, int, np.ndarray]]:
    """(from, to, ends) of byte ranges of about ``size`` bytes: whole documents, or overlapping parts of a long one."""
    i, n = 0, len(off) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + size, "right")) - 1)
        if j == i + 1 and off[j] - off[i] > size:
            for at in range(int(off[i]), int(off[j]), size):
                to = min(at + size + LENGTH - 1, int(off[j]))
                yield at, to, np.array([to - at])
        else:
            yield int(off[i]), int(off[j]), off[i + 1 : j + 1] - off[i]
        i = j


def _anchor_rows(batches: Iterator[pa.RecordBatch], slice_bytes: int, common=None) -> Iterator[pa.RecordBatch]:
    """Anchors of texts; common, a broadcast, holds sorted hashes of very common ones."""
    common = np.empty(0, np.int64) if common is None else common.value
    for b in batches:
        s, off = _binary(b.column(2))
        ids, nos = b.column(0).to_numpy(), b.column(1).to_numpy()
        for at, to, ends in _slices(off, slice_bytes):
            p, h, lo, hi = anchors(s[at:to], ends)
            doc = np.searchsorted(off, p + at, "right") - 1
            pos, span = (p + at - off[doc]).astype(np.int32), ((p - hi) | (p - lo) << 8).astype(np.int32)
            if len(common) and len(h):
                known = common[np.minimum(np.searchsorted(common, h), len(common) - 1)] == h
                dealt = ((ids[doc].astype(_U) << _U(20)) + pos.astype(_U)) * _U(_BASE)
                h = np.where(known, dealt.view(np.int64), h)
                span[known] |= _DEALT
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (h, ids[doc], nos[doc], pos, span)], ["h", "id", "no", "pos", "span"])


def _repeated_rows(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Rows whose hash occurs twice or more in the partition; hot ones, more than ``most`` of a hash, go out at once."""
    names = ["id", "no", "pos", "span", "hot"]
    held, rows, hot = [], 0, np.empty(0, np.int64)

    def out(cols, flag) -> Iterator[pa.RecordBatch]:
        for k in range(0, len(cols[0]), 1 << 16):
            part = [c[k : k + (1 << 16)] for c in cols[1:]]
            yield pa.RecordBatch.from_arrays([*map(pa.array, part), pa.array(np.full(len(part[0]), flag))], names)

    def split(cols):
        order = np.argsort(cols[0])
        cols = [c[order] for c in cols]
        edge = np.flatnonzero(np.concatenate([[True], cols[0][1:] != cols[0][:-1], [True]]))
        return cols, np.repeat(np.diff(edge), np.diff(edge))

    for b in batches:
        cols = [c.to_numpy() for c in b.columns]
        dealt = cols[4] & _DEALT > 0
        if dealt.any():
            known = [c[dealt] for c in cols]
            known[4] = known[4] & ~np.int32(_DEALT)
            yield from out(known, True)
            cols = [c[~dealt] for c in cols]
        if len(hot):
            known = np.isin(cols[0], hot)
            yield from out([c[known] for c in cols], True)
            cols = [c[~known] for c in cols]
        held.append(cols)
        rows += len(cols[0])
        if rows > 2 * ANCHORS and len(held) > 1:
            cols, n = split([np.concatenate(c) for c in zip(*held)])
            hot = np.union1d(hot, cols[0][n > most])
            yield from out([c[n > most] for c in cols], True)
            held = [[c[n <= most] for c in cols]]
            rows = len(held[0][0]) // 2  # what stays is looked at again when it has doubled
    if held:
        cols, n = split([np.concatenate(c) for c in zip(*held)])
        yield from out([c[n > most] for c in cols], True)
        some = (n > 1) & (n <= most)
        yield from out([c[some] for c in cols], False)


SUFFIX = "id long, no int, pos int, span int, near binary"
WINDOW = -1


def _suffix_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The surroundings of candidate suffixes; windows of hot ones, with span WINDOW, folded by batch.

    A row without surroundings is a finding: bytes pos to span repeat.
    """
    unpack = zstandard.ZstdDecompressor().decompress
    names = ["id", "no", "pos", "span", "near"]
    for b in batches:
        ids, nos, lists = b.column(0).to_numpy(), b.column(1).to_numpy(), b.column(3)
        cand, off = lists.flatten(), lists.offsets.to_numpy() - lists.offsets[0].as_py()
        pos, span = (cand.field(c).to_numpy() for c in (0, 1))
        hot = cand.field(2).to_numpy(zero_copy_only=False)
        doc = np.repeat(np.arange(len(lists)), np.diff(off))
        low, high = (pos - (span >> 8)).tolist(), (pos - (span & 255) + LENGTH).tolist()
        near: list[bytes] = []
        found: list[tuple] = []
        windows: dict[bytes, tuple] = {}
        is_hot, bounds = hot.tolist(), off.tolist()
        for i, z in enumerate(b.column(2)):
            text = unpack(z.as_py())
            for k in range(bounds[i], bounds[i + 1]):
                if not is_hot[k]:
                    near.append(text[low[k] : high[k]])
                    continue
                for w in range(low[k], high[k] - LENGTH + 1):
                    key = text[w : w + LENGTH]
                    now, was = (int(ids[i]), int(nos[i]), w), windows.get(key)
                    if was is None or now < was:
                        windows[key], now = now, was
                    if now is not None:
                        found.append(now)
        cold = ~hot
        yield pa.RecordBatch.from_arrays([pa.array(ids[doc[cold]]), pa.array(nos[doc[cold]]), pa.array(pos[cold]), pa.array(span[cold]), pa.array(near, pa.binary())], names)
        if windows:
            rows = [*((*v, WINDOW, k) for k, v in windows.items()), *((*v, v[2] + LENGTH, None) for v in found)]
            kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)


def _leads(span: np.ndarray, near: pa.Array) -> np.ndarray:
    """The 16 bytes from each suffix's own position on, as two numbers."""
    s, off = _binary(near)
    at = off[:-1] + (span >> 8)
    return np.ascontiguousarray(s[at[:, None] + np.arange(16)]).view(">u8").astype(_U)


def multikey(group: np.ndarray, word, depths: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Multikey sort of items with group numbers, one eight-byte word a level.

    word(items, depth) gives the items' words as big-endian numbers, so items
    stand in the order of group and words.  Only items that are still tied with
    a neighbour are sorted further.  Returns the items tied at every depth and
    their group numbers, groups in order and items of a group in order.
    """
    items = np.arange(len(group))
    for depth in [None, *depths]:
        key = group if depth is None else word(items, depth)
        order = np.argsort(key, kind="stable") if depth is None else np.lexsort((key, group))
        g, k = group[order], key[order]
        new = np.ones(len(g) + 1, bool)
        new[1:-1] = (g[1:] != g[:-1]) | (k[1:] != k[:-1])
        tied = ~(new[:-1] & new[1:])
        group = (np.cumsum(new[:-1]) - 1)[tied]
        items = items[order[tied]]
        if not len(items):
            break
    order = np.lexsort((items, group))  # ties by place
    return items[order], group[order]


def _later(items: np.ndarray, group: np.ndarray) -> np.ndarray:
    """All but the first of each group; the result of multikey."""
    return items[1:][group[1:] == group[:-1]] if len(items) else items


def resolve(ids, nos, pos, span, near: pa.Array) -> tuple[np.ndarray, ...]:
    """(id, no, start, end) of repeated bytes among suffixes with whole lead groups."""
    order = np.lexsort((pos, nos, ids))
    leads = _leads(span, near)[order]
    ids, nos, pos, span = (x[order] for x in (ids, nos, pos, span))
    s, off = _binary(near)
    n, width = len(order), REACH + LENGTH
    least, most = (span & 255).astype(np.int64), (span >> 8).astype(np.int64)
    size = (off[1:] - off[:-1])[order]
    flat = np.zeros(n * width + 8, np.uint8)
    inside = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    flat[np.repeat(np.arange(n) * width + REACH - most, size) + inside] = s[np.repeat(off[:-1][order], size) + inside]
    w2 = flat[:-1].astype(_U) << _U(8) | flat[1:]
    w4 = w2[:-2] << _U(16) | w2[2:]
    words = w4[:-4] << _U(32) | w4[4:]
    by_lead = np.lexsort((leads[:, 1], leads[:, 0]))
    differ = np.any(leads[by_lead[1:]] != leads[by_lead[:-1]], axis=1)
    lead = np.empty(n, np.int64)
    lead[by_lead] = np.concatenate([[0], np.cumsum(differ)])
    # equal surroundings: every later one repeats as a whole
    tied, group = multikey(lead << 16 | span, lambda i, d: words[i * width + 8 * d], list(range(width // 8)))
    whole = _later(tied, group)
    out = [np.stack([whole, pos[whole] - most[whole], pos[whole] - least[whole] + LENGTH], 1)]
    # what is left: windows of leads that still have two suffixes
    rest = np.ones(n, bool)
    rest[whole] = False
    rest &= np.bincount(lead[rest], minlength=n)[lead] > 1
    rows = np.flatnonzero(rest)
    count = (most - least + 1)[rows]
    row = np.repeat(rows, count)
    o = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + least[row]
    at = row * width + REACH - o
    tied, group = multikey(lead[row] << 8 | o, lambda i, d: words[at[i] + d], [LENGTH - 8, 0, *range(8, LENGTH - 8, 8)])
    again = np.sort(_later(tied, group))
    r, o = row[again], o[again]
    if len(r):
        first = np.flatnonzero(np.concatenate([[True], (r[1:] != r[:-1]) | (o[1:] != o[:-1] + 1)]))
        last = np.concatenate([first[1:], [len(r)]]) - 1
        out.append(np.stack([r[first], pos[r[first]] - o[last], pos[r[first]] - o[first] + LENGTH], 1))
    found = np.concatenate(out)
    return ids[found[:, 0]], nos[found[:, 0]], found[:, 1], found[:, 2]


def _window_rows(b: pa.RecordBatch, last: tuple | None) -> tuple[list[tuple], tuple]:
    """Findings among windows in order of their bytes, and the last window with its earliest place, for the next batch."""
    found = []
    ids, nos, pos = (b.column(c).to_pylist() for c in range(3))
    for i, n, p, w in zip(ids, nos, pos, b.column(4)):
        now, w = (i, n, p), w.as_buffer().to_pybytes()
        if last is not None and last[0] == w:
            now, later = min(last[1], now), max(last[1], now)
            found.append((*later, later[2] + LENGTH))
        last = (w, now)
    return found, last


def _span_rows(batches: Iterator[pa.RecordBatch], chunk: int) -> Iterator[pa.RecordBatch]:
    names = ["id", "no", "start", "end"]

    def rows(cols) -> pa.RecordBatch:
        kinds = [np.int64, np.int32, np.int32, np.int32]
        return pa.RecordBatch.from_arrays([pa.array(np.asarray(c).astype(k)) for c, k in zip(cols, kinds)], names)

    def done(table: pa.Table) -> pa.RecordBatch:
        t = table.combine_chunks()
        return rows(resolve(*(t.column(c).to_numpy() for c in range(4)), t.column(4).chunk(0)))

    held, size, last = [], 0, None
    for b in batches:
        plain = b.column(4).is_null().to_numpy(zero_copy_only=False)
        window = ~plain & (b.column(3).to_numpy() == WINDOW)
        if plain.any():
            f = b.filter(pa.array(plain))
            yield rows([f.column(c).to_numpy() for c in range(4)])
        if window.any():
            found, last = _window_rows(b.filter(pa.array(window)), last)
            if found:
                yield rows([np.array(c, np.int64) for c in zip(*found)])
        b = b.filter(pa.array(~plain & ~window))
        while b.num_rows:
            take = b.slice(0, chunk)
            b = b.slice(chunk)
            held.append(take)
            size += take.num_rows
            if size < chunk:
                continue
            leads = _leads(take.column(3).to_numpy(), take.column(4))
            other = np.flatnonzero((leads != leads[-1]).any(axis=1))
            cut = size - take.num_rows + int(other[-1]) + 1 if len(other) else 0  # the last lead may go on
            if cut:
                whole = pa.Table.from_batches(held)
                yield done(whole.slice(0, cut))
                held = [x for x in whole.slice(cut).to_batches() if x.num_rows]
                size -= cut
    if held:
        yield done(pa.Table.from_batches(held))


def merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal runs of the union of half-open spans."""
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def _size(docs: DataFrame) -> int:
    """Bytes of all texts."""
    return docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0


ID, NO = "__suffix_id", "__suffix_no"


def numbered(docs: DataFrame) -> DataFrame:
    """docs with ID (doc_id, the least long for null) and NO (place of the row among those of its doc_id, by text)."""
    rows = docs.withColumn(ID, F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID)))
    if rows.groupBy(ID).count().where("count > 1").isEmpty():
        return rows.withColumn(NO, F.lit(0))
    order = Window.partitionBy(ID).orderBy(F.coalesce("text", F.lit("")).cast("binary"))
    return rows.withColumn(NO, F.row_number().over(order) - 1)


ANCHOR = "h long, id long, no int, pos int, span int"


def _common(rows: DataFrame):
    """A broadcast of the sorted hashes of very common anchors of a sample; the sample decides how rows travel, not what is found."""
    sample = rows.where(F.pmod(F.xxhash64(F.lit("anchors"), "id", "no"), F.lit(SAMPLED)) == 0)
    counts = sample.mapInArrow(tidy(partial(_anchor_rows, slice_bytes=SLICE), _forget), ANCHOR).groupBy("h").agg(F.count("*").alias("n"))
    top = counts.where(F.col("n") > max(1, HOT // SAMPLED)).orderBy(F.col("n").desc(), "h").limit(COMMON).collect()
    return rows.sparkSession.sparkContext.broadcast(np.array(sorted(r["h"] for r in top), np.int64))


def repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, no, text binary, spans) for every row of docs; spans are sorted, disjoint removed runs.

    Documents are ordered by doc_id (null first); rows with one doc_id are
    ordered by their text and told apart by no.  Null text is empty.  Texts
    shorter than LENGTH bytes keep everything.
    """
    spark = docs.sparkSession
    size = _size(docs)
    parts = max(shuffle_partitions(spark), math.ceil(size / (128 << 20)))
    many = max(parts, math.ceil(size / (REACH + 2) * 2 / ANCHORS))  # an anchor every half reach
    rows = numbered(docs).select(F.col(ID).alias("id"), F.col(NO).alias("no"), F.coalesce("text", F.lit("")).cast("binary").alias("text"))

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=1)
        for b in batches:
            z = pa.array([press.compress(t.as_buffer()) for t in b.column(2)], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), z], ["id", "no", "z"])

    # columns that can't be null leave both joins the same plan below, so one exchange of the texts serves both
    texts = rows.mapInArrow(tidy(packed), "id long not null, no int not null, z binary not null").repartition(parts, "id", "no")
    shared = _common(rows)
    found = rows.mapInArrow(tidy(partial(_anchor_rows, slice_bytes=SLICE, common=shared), _forget), ANCHOR).repartition(many, "h")
    found = found.mapInArrow(tidy(partial(_repeated_rows, most=HOT)), "id long not null, no int not null, pos int, span int, hot boolean")
    wanted = found.groupBy("id", "no").agg(F.collect_list(F.struct("pos", "span", "hot")).alias("c"))
    near = texts.join(wanted.hint("shuffle_hash"), ["id", "no"]).select("id", "no", "z", "c").mapInArrow(tidy(_suffix_rows), SUFFIX)
    own = F.when(F.col("span") == WINDOW, F.col("near")).otherwise(F.substring(F.col("near"), F.shiftright("span", 8) + 1, F.lit(16)))
    lead = F.coalesce(own, F.unhex(F.md5(F.col("id").cast("string").cast("binary"))))  # findings only pass through
    buckets = near.repartitionByRange(parts, lead).sortWithinPartitions(lead)
    spans = buckets.mapInArrow(tidy(partial(_span_rows, chunk=CHUNK)), "id long not null, no int not null, start int, end int")
    spans = spans.groupBy("id", "no").agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    return texts.join(spans.hint("shuffle_hash"), ["id", "no"], "left").select("id", "no", "z", "spans")


def dedup_substrings(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and the removed spans of every row of docs (see repeats)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        for b in batches:
            out = [[] for _ in range(6)]
            for d, z, c in zip(b.column(0).to_pylist(), b.column(2), b.column(3).to_pylist()):
                text = unpack.decompress(z.as_py())
                runs = merge([(x["start"], x["end"]) for x in c or ()])
                digest, at = hashlib.sha256(), 0
                for lo, hi in [*runs, (len(text), 0)]:
                    digest.update(text[at:lo])
                    at = hi
                row = (None if d == _NO_ID else d, len(text), sum(hi - lo for lo, hi in runs), len(runs), digest.hexdigest(), [{"start": lo, "end": hi} for lo, hi in runs])
                for column, v in zip(out, row):
                    column.append(v)
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"])

    return repeats(docs).mapInArrow(tidy(run), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start:int,end:int>>")


def whole_characters(text: bytes, lo: int, hi: int) -> tuple[int, int]:
    """The span without bytes of characters that lie in it only in part."""
    while lo < hi and text[lo] & 0xC0 == 0x80:
        lo += 1
    while hi > lo and hi < len(text) and text[hi] & 0xC0 == 0x80:
        hi -= 1
    return lo, hi


def remove_repeats(docs: DataFrame) -> DataFrame:
    """docs with repeated bytes taken out of text, n_chars (if there) set to what is left, other columns as they were.

    A span that cuts a character in two leaves that character.  Rows with one
    doc_id get the texts of that id in the order of the original texts.  A row
    whose text is null keeps null.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        for b in batches:
            ids, texts = [], []
            for d, z, c in zip(b.column(0).to_pylist(), b.column(2), b.column(3).to_pylist()):
                text = unpack.decompress(z.as_py())
                kept, at = [], 0
                for lo, hi in merge([(x["start"], x["end"]) for x in c or ()]):
                    lo, hi = whole_characters(text, lo, hi)
                    kept.append(text[at:lo])
                    at = max(at, hi)
                ids.append(None if d == _NO_ID else d)
                texts.append(b"".join([*kept, text[at:]]).decode("utf-8", "replace"))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), b.column(1), pa.array(texts, pa.string())], ["__id", "__no", "__text"])

    clean = repeats(docs).mapInArrow(tidy(run), "__id long, __no int, __text string")
    other = [c for c in docs.columns if c != "text"]
    rest = numbered(docs).select(*other, ID, NO, F.col("text").isNull().alias("__null"))
    joined = rest.join(clean, (F.col(ID) == F.col("__id")) & (F.col(NO) == F.col("__no")))
    text = F.when(F.col("__null"), F.lit(None)).otherwise(F.col("__text")).alias("text")
    size = F.char_length("__text").cast("long").alias("n_chars")
    return joined.select(*(text if c == "text" else size if c == "n_chars" else F.col(c) for c in docs.columns))
