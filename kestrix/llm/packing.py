"""Best-fit packing by a linear grouping scheme.

Lengths are at most the capacity, so a histogram of them is all the planner
needs, whatever the number of documents.  Large lengths are cut into groups of
equal cardinality and rounded up within their group; configurations of the few
rounded sizes are optimised by column generation (a linear program over
configurations, rounded down).  Actual documents take the places of rounded
ones: a slot gets the longest document that leaves the later slots their
rounded sizes, so what rounding wastes in one slot lets the next take a longer
document.  Documents without a slot are put best-fit into what is left.  The
plan is a table of places ``length, ranks, sequence, offset`` with runs of
equal sequences folded together.
"""

from __future__ import annotations

import os
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, tidy

CAPACITY = 2048
#: Lengths over this share of the capacity are large: the shares that are tried.
LARGE = (0.4, 0.34, 0.25, 0.15)
#: Groups of rounded sizes, and configurations tried at most.
GROUPS, COLUMNS = 24, 200
#: Parts a length is dealt into while documents are ranked.
SALTS = 64
TOKENIZER = "word_bpe_49k.json"
#: Words a task remembers the ids of, some 200 bytes each.
CACHE = 500_000


def _knapsack(sizes: list[int], values: np.ndarray, limit: list[int], capacity: int) -> tuple[float, list[int]]:
    """Best multiset of sizes within the capacity; size i at most limit[i] times."""
    order = [i for i in sorted(range(len(sizes)), key=lambda i: -values[i] / sizes[i]) if values[i] > 1e-12]
    best, choice = 0.0, [0] * len(sizes)
    now = [0] * len(sizes)

    def go(at: int, room: int, value: float) -> None:
        nonlocal best, choice
        if value > best + 1e-12:
            best, choice = value, now.copy()
        for p in range(at, len(order)):
            i = order[p]
            if value + room * values[i] / sizes[i] <= best + 1e-12:
                return  # no later size is worth more by token
            if sizes[i] <= room and now[i] < limit[i]:
                now[i] += 1
                go(p, room - sizes[i], value + values[i])
                now[i] -= 1

    go(0, capacity, 0.0)
    return best, choice


def _configurations(sizes: list[int], demand: np.ndarray, capacity: int) -> list[tuple[list[int], int]]:
    """Configurations of rounded sizes and how often each is used, at most demand in all.

    Column generation: the simplex basis starts with one size in each
    configuration; the dual prices it, a knapsack finds the configuration of
    most value, until none is worth more than a sequence.
    """
    k = len(sizes)
    basis = np.zeros((k, k))
    for i, s in enumerate(sizes):
        basis[i, i] = capacity // s
    x = demand / basis.diagonal()
    for _ in range(COLUMNS):
        price = np.linalg.solve(basis.T, np.ones(k))
        value, choice = _knapsack(sizes, price, [capacity // s for s in sizes], capacity)
        if value <= 1 + 1e-7:
            break
        column = np.array(choice, float)
        way = np.linalg.solve(basis, column)
        ratio = np.where(way > 1e-9, x / np.where(way > 1e-9, way, 1), np.inf)
        out = int(ratio.argmin())
        x = np.maximum(x - ratio[out] * way, 0)
        x[out] = ratio[out]
        basis[:, out] = column
    return [([int(v) for v in basis[:, j]], int(np.floor(x[j] + 1e-9))) for j in range(k) if np.floor(x[j] + 1e-9) >= 1]


class _Bins:
    """Runs of sequences that have the same room left: room -> list of [first sequence, count]."""

    def __init__(self, capacity: int):
        self.capacity, self.next, self.places = capacity, 0, []
        self.by_room: dict[int, list[list[int]]] = {}
        self.rooms: list[int] = []

    def add(self, room: int, first: int, count: int) -> None:
        if count and room:
            if room not in self.by_room:
                self.by_room[room] = []
                self.rooms.insert(bisect_left(self.rooms, room), room)
            self.by_room[room].append([first, count])

    def best(self, length: int) -> int | None:
        """Least room that holds length."""
        at = bisect_left(self.rooms, length)
        return self.rooms[at] if at < len(self.rooms) else None

    def take(self, room: int) -> list[int]:
        run = self.by_room[room].pop()
        if not self.by_room[room]:
            del self.by_room[room]
            self.rooms.pop(bisect_left(self.rooms, room))
        return run

    def place(self, length: int, rank: int, first: int, count: int, offset: int) -> None:
        """Documents rank.. rank + count - 1 of a length go to sequences first.. at one offset."""
        self.places.append((length, rank, count, first, offset))


def _groups(histogram: dict[int, int], least: float) -> tuple[list[int], np.ndarray]:
    """Rounded sizes, longest first, and how many large documents each stands for.

    Groups have equal cardinality and round up to their longest length; those
    that round to one size are one.  With few large lengths each is a group.
    """
    large = sorted((k for k, n in histogram.items() if n and k > least), reverse=True)
    each = -(-sum(histogram[k] for k in large) // GROUPS)
    merged, size, room = {}, 0, 0
    for k in large:
        n = histogram[k]
        while n:
            if not room or len(large) <= GROUPS:
                size, room = k, n if len(large) <= GROUPS else each
            take = min(n, room)
            merged[size] = merged.get(size, 0) + take
            n, room = n - take, room - take
    return list(merged), np.array(list(merged.values()), float)


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Places (length, first rank, count, first sequence, offset) and the number of sequences.

    Documents of a length are interchangeable and ranked from 0.  Grouped
    plans are made for each share in LARGE until one has no more sequences
    than the tokens fill; else the shortest is taken.  An empty histogram needs
    no sequence.
    """
    if any(not 1 <= length <= capacity for length in histogram):
        raise ValueError("lengths must lie between 1 and the capacity")
    bound, best = -(-sum(k * n for k, n in histogram.items()) // capacity), None
    for share in LARGE:
        found = _grouped(histogram, capacity, share)
        best = min(filter(None, (best, found)), key=lambda p: p[1])
        if best[1] == bound:
            break
    return best


def _grouped(histogram: dict[int, int], capacity: int, share: float) -> tuple[list[tuple[int, int, int, int, int]], int]:
    bins, used = _Bins(capacity), dict.fromkeys(histogram, 0)
    left = {k: n for k, n in histogram.items() if n}
    have = sorted(left)

    def place(length: int, first: int, count: int, offset: int) -> None:
        bins.place(length, used[length], first, count, offset)
        used[length] += count
        left[length] -= count
        if not left[length]:
            have.pop(bisect_left(have, length))

    sizes, demand = _groups(left, capacity * share)
    full = lambda choice: sum(s * c for s, c in zip(sizes, choice))
    for choice, times in sorted(_configurations(sizes, demand, capacity) if sizes else [], key=lambda c: -full(c[0])):
        runs = [(bins.next, times, 0)]
        bins.next += times
        later = full(choice)
        for size in (s for s, c in zip(sizes, choice) for _ in range(c)):
            later -= size
            after = []
            for first, count, offset in runs:
                while count:
                    at = bisect_right(have, capacity - offset - later) - 1
                    if at < 0:
                        after.append((first, count, offset))
                        break
                    n = min(count, left[have[at]])
                    after.append((first, n, offset + have[at]))
                    place(have[at], first, n, offset)
                    first, count = first + n, count - n
            runs = after
        for first, n, offset in runs:
            bins.add(capacity - offset, first, n)
    for k in have[::-1]:  # the rest: best fit, longest first, whole runs at a time
        while k in left and left[k]:
            room = bins.best(k)
            if room is None:
                room, first, count = capacity, bins.next, -(-left[k] // (capacity // k))
                bins.next += count
            else:
                first, count = bins.take(room)
            whole = min(count, left[k] // (room // k))
            times, here = (room // k, whole) if whole else (left[k], 1)
            for t in range(times):
                place(k, first, here, capacity - room + t * k)
            bins.add(room - times * k, first, here)
            bins.add(room, first + here, count - here)
    return bins.places, bins.next


_LATIN = "A-Za-zÀ-ÖØ-öø-ÿ"
_PLAIN = re.compile(f"[{_LATIN}]+")
#: Letters and ASCII marks after them, which the pre-tokenizer takes apart there.
_MARKED = re.compile(rf"([{_LATIN}]+)([!-/:-@\[-`{{-~]+)")


class WordIds:
    """Token ids of a text, remembered by white-space-separated word.

    The vocabulary's pre-tokenizer never joins characters across white space,
    so a text's ids are the concatenation of its words' ids.  Texts with rarer
    white space or control characters, and words that are not plain Latin
    letters with ASCII marks after them, go through the tokenizer itself: lower
    case makes letters and marks of some other letters, which join the marks.
    """

    def __init__(self, path: str, size: int = CACHE):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        level = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.bytes = {c: level.pre_tokenize_str(chr(c))[0][0] for c in range(0xC0, 0x100)}
        self.full, self.size = Tokenizer.from_file(path), size
        self.known: dict[str, bytes] = {}
        self.model = self.full.model
        self.special = tuple(x.content for x in self.full.get_added_tokens_decoder().values())

    def word(self, w: str) -> bytes:
        found = self.known.get(w)
        if found is not None:
            return found
        if _PLAIN.fullmatch(w):
            low = w.lower()
            ids = self.word(low) if low != w else np.array([t.id for t in self.model.tokenize(w.translate(self.bytes))], "<u4").tobytes()
        elif parts := _MARKED.fullmatch(w):
            ids = self.word(parts[1]) + self.word(parts[2])
        else:
            ids = np.array(self.full.encode(w, add_special_tokens=False).ids, "<u4").tobytes()
        if len(self.known) < self.size:
            self.known[w] = ids
        return ids

    def text(self, text: str) -> bytes:
        if not text.isprintable() and any(c in text for c in "\x1c\x1d\x1e\x1f\x85") or any(s in text for s in self.special):
            return np.array(self.full.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        known = self.known
        words = text.split()
        try:
            return b"".join([known[w] for w in words])
        except KeyError:
            return b"".join([known[w] if w in known else self.word(w) for w in words])


@lru_cache(maxsize=2)
def _word_ids(name: str) -> WordIds:
    path = name
    if not os.path.isabs(name):
        import public_tokenizers

        path = public_tokenizers.path(name)
    return WordIds(path)


def tokenize(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str = TOKENIZER) -> DataFrame:
    """Pieces (doc_id, piece, start, length, ids) of every row of docs.

    ids are little-endian unsigned 32-bit, the document's ids and then 0; a
    null text has only the 0.  Documents longer than capacity are cut into
    pieces of capacity; only the last may be shorter.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, step = _word_ids(tokenizer), 4 * capacity
        for b in batches:
            doc, piece, start, length, ids = [], [], [], [], []
            for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                all_ids = words.text(t or "") + b"\0\0\0\0"
                for p, at in enumerate(range(0, len(all_ids), step)):
                    part = all_ids[at : at + step]
                    doc.append(d)
                    piece.append(p)
                    start.append(at // 4)
                    length.append(len(part) // 4)
                    ids.append(part)
            yield pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(ids, pa.binary())], ["doc_id", "piece", "start", "length", "ids"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(tidy(run, lambda: _word_ids(tokenizer).known.clear()), "doc_id long, piece int, start long, length long, ids binary")


def assign(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """pieces (with doc_id, piece, length and any more) with sequence_id and offset.

    Lengths are dealt into salted parts, ranked there, and the parts' ranks
    follow each other, so a length that many documents share is no task's
    alone.  The driver sees at most capacity * SALTS counts; the places, a few
    times capacity rows, are broadcast.  Ranks need pieces to be the same each
    time they are computed: pass a checkpointed or written table.
    """
    spark = pieces.sparkSession
    salted = pieces.withColumn("__salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(SALTS)).cast("int"))
    counts = salted.groupBy("length", "__salt").agg(F.count("*").alias("n")).collect()
    histogram: dict[int, int] = {}
    before: dict[tuple[int, int], int] = {}
    for r in sorted(counts, key=lambda r: (r["length"], r["__salt"])):
        before[r["length"], r["__salt"]] = histogram.get(r["length"], 0)
        histogram[r["length"]] = histogram.get(r["length"], 0) + r["n"]
    places, _ = plan(histogram, capacity)
    table = np.array(sorted(places), np.int64).reshape(-1, 5)
    shared = spark.sparkContext.broadcast((table, before))
    ranked = salted.withColumn("__rank", F.row_number().over(Window.partitionBy("length", "__salt").orderBy("doc_id", "piece")) - 1)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema.fields)
    names = [*pieces.columns, "sequence_id", "offset"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, before = shared.value
        first = table[:, 0] << 40 | table[:, 1]
        for b in batches:
            length, salt, rank = (b.column(c).to_numpy().astype(np.int64) for c in ("length", "__salt", "__rank"))
            rank = rank + np.fromiter((before[k] for k in zip(length.tolist(), salt.tolist())), np.int64, len(rank))
            at = np.searchsorted(first, length << 40 | rank, "right") - 1
            sequence = table[at, 3] + rank - table[at, 1]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names[:-2]), pa.array(sequence), pa.array(table[at, 4])], names)

    return ranked.mapInArrow(tidy(run), f"{fields}, sequence_id long, offset long")


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, n_pieces, length, ids) with the pieces' ids one after the other; packed carries ids."""
    part = F.struct("offset", "ids")
    grouped = packed.groupBy("sequence_id").agg(F.sort_array(F.collect_list(part)).alias("p"), F.sum("length").alias("length"))
    joined = F.aggregate("p", F.lit(b""), lambda a, x: F.concat(a, x["ids"]))
    return grouped.select("sequence_id", F.size("p").alias("n_pieces"), "length", joined.alias("ids"))


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str = TOKENIZER) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece of every row of docs.

    Rows with one doc_id are packed each for itself.  An empty table gives no
    rows.  Texts are tokenised once; what is kept in the checkpoint folder are
    lengths and checksums.
    """
    pieces = tokenize(docs, capacity, tokenizer).select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))
    return assign(cut(pieces), capacity)
