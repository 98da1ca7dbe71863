"""GLM objectives: over a DataFrame with one job an evaluation, or over numpy arrays of one group.

Both share regularization: L2 without the intercept, or a Gaussian prior in
its place.  Data stay as they are; normalization is folded into coefficients.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kestrix.functions.losses import Loss

from .normalize import Normalization

#: Partial sums above which they are added on executors before the driver, and entries of a vector that are added together.
PARTIALS, CHUNK = 64, 1 << 16
#: Entries of the dense rows that a Gram matrix is made of at a time.
DENSE = 1 << 22


@dataclass(frozen=True)
class Penalty:
    """l2 / 2 * |b|^2 without the intercept; a prior (means, variances), weighted by prior_weight, replaces it."""

    l2: float = 0.0
    intercept: int | None = None
    prior: tuple[np.ndarray, np.ndarray] | None = None
    prior_weight: float = 1.0

    def _precision(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if self.prior is not None:
            mean, var = self.prior
            inverse = np.where(np.abs(var) < 1e-12, self.l2, 1 / np.where(np.abs(var) < 1e-12, 1.0, var))
            return self.prior_weight * inverse, mean
        p = np.full(n, self.l2)
        if self.intercept is not None:
            p[self.intercept] = 0.0
        return p, np.zeros(n)

    def value_gradient(self, b: np.ndarray) -> tuple[float, np.ndarray]:
        p, mean = self._precision(len(b))
        d = b - mean
        return 0.5 * float(p @ (d * d)), p * d

    def curvature(self, n: int) -> np.ndarray:
        return self._precision(n)[0]


class Sparse:
    """Rows of a sparse matrix as (row, column, value) entries."""

    def __init__(self, n: int, row: np.ndarray, col: np.ndarray, val: np.ndarray):
        self.n, self.row, self.col, self.val = n, row, col, val

    @classmethod
    def from_arrow(cls, column: pa.Array) -> Sparse:
        """From list<struct<idx, val>>."""
        lists = column if isinstance(column, pa.Array) else column.combine_chunks()
        entries = lists.flatten()
        off = lists.offsets.to_numpy().astype(np.int64)
        n = np.diff(off)
        if lists.null_count:
            n = np.where(lists.is_null().to_numpy(zero_copy_only=False), 0, n)
        return cls(len(lists), np.repeat(np.arange(len(lists)), n), entries.field(0).to_numpy(), entries.field(1).to_numpy())

    def times(self, b: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, self.val * b[self.col], self.n)

    def transposed(self, d: np.ndarray, size: int) -> np.ndarray:
        return np.bincount(self.col, self.val * d[self.row], size)

    def squares(self, d: np.ndarray, size: int) -> np.ndarray:
        return np.bincount(self.col, self.val**2 * d[self.row], size)

    def gram(self, d: np.ndarray, size: int) -> np.ndarray:
        out, step = np.zeros((size, size)), max(1, DENSE // max(size, 1))
        for at in range(0, self.n, step):
            a, b = np.searchsorted(self.row, [at, at + step])
            x = np.zeros((min(step, self.n - at), size))
            np.add.at(x, (self.row[a:b] - at, self.col[a:b]), self.val[a:b])
            out += x.T @ (d[at : at + step, None] * x)
        return out


class Local:
    """Objective over rows in memory."""

    def __init__(self, loss: Loss, x: Sparse, y, offset, weight, size: int, penalty: Penalty = Penalty(), norm: Normalization = Normalization()):
        self.loss, self.x, self.y, self.offset, self.weight = loss, x, y, offset, weight
        self.size, self.penalty, self.norm = size, penalty, norm

    def _margin(self, b):
        e, c = self.norm.effective(b)
        return self.x.times(e) + c + self.offset

    def value_gradient(self, b: np.ndarray) -> tuple[float, np.ndarray]:
        z = self._margin(b)
        d = self.weight * self.loss.np_first(z, self.y)
        v, g = self.penalty.value_gradient(b)
        return float(self.weight @ self.loss.np_value(z, self.y)) + v, self.norm.pull(self.x.transposed(d, self.size), d.sum()) + g

    def hessian_vector(self, b: np.ndarray, v: np.ndarray) -> np.ndarray:
        e, c = self.norm.effective(v)
        d = self.weight * self.loss.np_second(self._margin(b), self.y) * (self.x.times(e) + c)
        return self.norm.pull(self.x.transposed(d, self.size), d.sum()) + self.penalty.curvature(self.size) * v

    def _curvature(self, raw: np.ndarray) -> np.ndarray:
        return self.weight * self.loss.np_second(self.x.times(raw) + self.offset, self.y)

    def hessian_diagonal(self, raw: np.ndarray) -> np.ndarray:
        """Of coefficients in original space, with the penalty."""
        return self.x.squares(self._curvature(raw), self.size) + self.penalty.curvature(self.size)

    def hessian_matrix(self, raw: np.ndarray) -> np.ndarray:
        return self.x.gram(self._curvature(raw), self.size) + np.diag(self.penalty.curvature(self.size))


class Many:
    """Objectives of n entities in memory, side by side: ``by`` has the entity of each row, ``of`` that of each coefficient.

    precision and mean are the penalty's, coefficient by coefficient.  An
    evaluation for some of the entities takes only their rows.
    """

    def __init__(self, loss: Loss, x: Sparse, y, offset, weight, by: np.ndarray, of: np.ndarray, n: int, precision: np.ndarray, mean: np.ndarray):
        self.loss, self.of, self.n, self.precision, self.mean = loss, of, n, precision, mean
        self.all = (x.row, x.col, x.val, y, offset, weight, by)
        self.who, self.some = np.ones(n, bool), self.all

    def _rows(self, who: np.ndarray) -> tuple:
        if not np.array_equal(who, self.who):
            row, col, val, y, offset, weight, by = self.all
            keep = who[by]
            entries = keep[row]
            place = np.cumsum(keep) - 1
            self.some = (place[row[entries]], col[entries], val[entries], y[keep], offset[keep], weight[keep], by[keep])
            self.who = who.copy()
        return self.some

    def value_gradient(self, b: np.ndarray, who: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        row, col, val, y, offset, weight, by = self._rows(who)
        z = np.bincount(row, val * b[col], len(y)) + offset
        d, away = weight * self.loss.np_first(z, y), b - self.mean
        value = np.bincount(by, weight * self.loss.np_value(z, y), self.n) + 0.5 * np.bincount(self.of, self.precision * away * away, self.n)
        return value, np.bincount(col, val * d[row], len(b)) + self.precision * away

    def hessian_vector(self, b: np.ndarray, v: np.ndarray, who: np.ndarray) -> np.ndarray:
        row, col, val, y, offset, weight, _ = self._rows(who)
        z = np.bincount(row, val * b[col], len(y)) + offset
        d = weight * self.loss.np_second(z, y) * np.bincount(row, val * v[col], len(y))
        return np.bincount(col, val * d[row], len(b)) + self.precision * v

    def hessian_diagonal(self, b: np.ndarray) -> np.ndarray:
        row, col, val, y, offset, weight, _ = self.all
        d = weight * self.loss.np_second(np.bincount(row, val * b[col], len(y)) + offset, y)
        return np.bincount(col, val * val * d[row], len(b)) + self.precision


def packed(data: DataFrame) -> DataFrame:
    """(label, offset, weight, features) as compressed Arrow blocks: an evaluation need not turn rows into Arrow again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = pa.BufferOutputStream()
            with pa.ipc.new_stream(out, b.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
                w.write_batch(b)
            yield pa.RecordBatch.from_arrays([pa.array([out.getvalue().to_pybytes()], pa.binary())], ["block"])

    return data.select("label", "offset", "weight", "features").mapInArrow(run, "block binary")


class Distributed:
    """Objective over a DataFrame (label, offset, weight, features) or its ``packed`` blocks, kept in memory by the caller.

    An evaluation sends the coefficients with the tasks and brings back one
    vector a partition.  With many partitions executors add them first, chunk
    by chunk of the vector, in as many levels as leave at most PARTIALS at one
    place: a task holds two chunks, whatever the number of partitions.
    """

    def __init__(self, loss: Loss, data: DataFrame, size: int, penalty: Penalty = Penalty(), norm: Normalization = Normalization()):
        self.loss, self.size, self.penalty, self.norm = loss, size, penalty, norm
        self.packed = data.columns == ["block"]
        self.data = data if self.packed else data.select("label", "offset", "weight", "features")
        self.partitions = self.data.rdd.getNumPartitions()

    def _sum(self, part) -> np.ndarray:
        """Sum over the data of part(x, y, offset, weight), a vector."""
        is_packed = self.packed

        def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if is_packed:
                    for x in b.column(0):
                        yield from pa.ipc.open_stream(x.as_buffer())
                else:
                    yield b

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = None
            for b in rows(batches):
                if b.num_rows:
                    y, offset, weight = (b.column(c).to_numpy() for c in range(3))
                    now = part(Sparse.from_arrow(b.column(3)), y, offset, weight)
                    total = now if total is None else total + now
            if total is not None:
                for c, at in enumerate(range(0, len(total), CHUNK)):
                    yield pa.RecordBatch.from_arrays([pa.array([c], pa.int32()), pa.array([total[at : at + CHUNK].astype("<f8").tobytes()], pa.binary())], ["c", "v"])

        def add(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            v = None
            for b in batches:
                for x in b.column("v"):
                    now = np.frombuffer(x.as_buffer(), "<f8")
                    v = now.copy() if v is None else np.add(v, now, out=v)
            yield pa.RecordBatch.from_arrays([pa.array([key[-1].as_py()], pa.int32()), pa.array([v.tobytes()], pa.binary())], ["c", "v"])

        sums, n = self.data.mapInArrow(run, "c int, v binary"), self.partitions
        while n > PARTIALS:
            n = -(-n // PARTIALS)
            sums = sums.withColumn("g", F.spark_partition_id() % n).groupBy("g", "c").applyInArrow(add, "c int, v binary")
        found: dict[int, np.ndarray] = {}
        for r in sums.collect():
            now = np.frombuffer(r["v"], "<f8")
            found[r["c"]] = now if r["c"] not in found else found[r["c"]] + now
        return np.concatenate([found[c] for c in sorted(found)]) if found else np.zeros(1)

    def value_gradient(self, b: np.ndarray) -> tuple[float, np.ndarray]:
        (e, c), loss, size = self.norm.effective(b), self.loss, self.size

        def part(x, y, offset, weight):
            z = x.times(e) + c + offset
            d = weight * loss.np_first(z, y)
            return np.concatenate([[weight @ loss.np_value(z, y), d.sum()], x.transposed(d, size)])

        s = self._sum(part)
        s = s if len(s) > 1 else np.zeros(size + 2)
        v, g = self.penalty.value_gradient(b)
        return float(s[0]) + v, self.norm.pull(s[2:], s[1]) + g

    def hessian_vector(self, b: np.ndarray, v: np.ndarray) -> np.ndarray:
        (e, c), (f, k), loss, size = self.norm.effective(b), self.norm.effective(v), self.loss, self.size

        def part(x, y, offset, weight):
            d = weight * loss.np_second(x.times(e) + c + offset, y) * (x.times(f) + k)
            return np.concatenate([[d.sum()], x.transposed(d, size)])

        s = self._sum(part)
        s = s if len(s) > 1 else np.zeros(size + 1)
        return self.norm.pull(s[1:], s[0]) + self.penalty.curvature(size) * v

    def hessian_diagonal(self, raw: np.ndarray) -> np.ndarray:
        loss, size = self.loss, self.size
        s = self._sum(lambda x, y, offset, weight: x.squares(weight * loss.np_second(x.times(raw) + offset, y), size))
        return (s if len(s) == size else np.zeros(size)) + self.penalty.curvature(size)

    def hessian_matrix(self, raw: np.ndarray) -> np.ndarray:
        loss, size = self.loss, self.size
        s = self._sum(lambda x, y, offset, weight: x.gram(weight * loss.np_second(x.times(raw) + offset, y), size).ravel())
        return (s if len(s) == size * size else np.zeros(size * size)).reshape(size, size) + np.diag(self.penalty.curvature(size))


def variances(objective, raw: np.ndarray, kind: str) -> np.ndarray | None:
    """NONE, SIMPLE (inverse Hessian diagonal, 1e12 for a zero) or FULL (diagonal of the inverse Hessian)."""
    if kind == "NONE" or objective.loss.np_second is None:
        return None
    if kind == "SIMPLE":
        return inverse_diagonal(objective.hessian_diagonal(raw))
    if kind == "FULL":
        low = np.linalg.cholesky(objective.hessian_matrix(raw))
        inverse = np.linalg.inv(low)
        return (inverse**2).sum(axis=0)
    raise ValueError(f"no variance computation {kind}")


def inverse_diagonal(d: np.ndarray) -> np.ndarray:
    return np.where(np.abs(d) < 1e-12, 1e12, 1 / np.where(np.abs(d) < 1e-12, 1.0, d))


def penalty_term(b: np.ndarray, l1: float, l2: float) -> float:
    """Reported value of the penalty: the intercept counts here."""
    return l1 * float(np.abs(b).sum()) + l2 / 2 * float(b @ b)
