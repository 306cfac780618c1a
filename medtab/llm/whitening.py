"""Whitening of embeddings along the principal components of their covariance.

The covariance comes from exact integer sums over all distinct vectors. Its eigenvectors come from spectral divide and
conquer: the polar factor of the covariance less a shift is the sign of its eigenvalues, so it holds the projector on the
invariant subspace above the shift; a basis of that subspace and one of its complement split the matrix in two, and so on
down to single components. Polar factors are computed by the QDWH iteration (QR-based, dynamically weighted Halley). Then
every row is projected, with the components sent to the tasks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from medtab.llm.common import cut, give_back

#: Integer steps of 1.0, components that are returned, rows of a product, and rows that partial sums are merged to.
SCALE, COMPONENTS, CHUNK, MERGED = 256, 4, 1024, 16
EPS = float(np.finfo(float).eps)
#: A component whose eigenvalue is below this part of the largest, times the dimension, has no variance.
NO_VARIANCE = 16 * EPS


def quantised(vectors: DataFrame) -> DataFrame:
    """``(vec_id, x)``: entries as floor(SCALE * entry), longs; vectors null, empty or with a null or non-finite entry leave."""
    c = F.transform("embedding", lambda e: e.cast("double"))
    bad = F.exists(c, lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf")))
    return vectors.where("embedding is not null").where(~bad & (F.size("embedding") > 0)).select("vec_id", F.transform(c, lambda e: F.floor(e * F.lit(float(SCALE)))).alias("x"))


def qdwh(a: np.ndarray) -> np.ndarray:
    """The orthogonal polar factor of a symmetric matrix: for regular ones, its eigenvectors with the signs of its eigenvalues."""
    n = len(a)
    size = np.linalg.norm(a, 1)  # at least the largest singular value
    if not size:
        return np.eye(n)
    x = a / (size * (1 + 8 * EPS))
    # a lower bound of the singular values; one that is too small only costs steps
    try:
        low = min(max(0.9 / (np.linalg.norm(np.linalg.inv(x), 1) * np.sqrt(n)), EPS), 1.0)
    except np.linalg.LinAlgError:
        low = EPS
    for _ in range(30):
        d = np.cbrt(4 * (1 - low * low) / low**4) if low < 1 else 0.0
        u = np.sqrt(1 + d) + 0.5 * np.sqrt(max(0.0, 8 - 4 * d + 8 * (2 - low * low) / (low * low * np.sqrt(1 + d))))
        v = (u - 1) ** 2 / 4
        w = u + v - 1
        q, _ = np.linalg.qr(np.vstack([np.sqrt(w) * x, np.eye(n)]))
        y = v / w * x + (u - v / w) / np.sqrt(w) * q[:n] @ q[n:].T
        y = (y + y.T) / 2
        low = min(1.0, low * (u + v * low * low) / (1 + w * low * low))
        done = np.linalg.norm(y - x) <= np.cbrt(10 * EPS) * 1e-3 * np.sqrt(n) and abs(1 - low) < 1e-8
        x = y
        if done:
            break
    return x


def _split(a: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
    """Orthonormal bases of the invariant subspaces of a symmetric matrix above and below a shift; None where no shift parts
    its eigenvalues, as all are equal to rounding."""
    n = len(a)
    reach = np.abs(a).sum(axis=1) - np.abs(np.diag(a))
    high, low = float((np.diag(a) + reach).max()), float((np.diag(a) - reach).min())
    shift = float(np.median(np.diag(a)))
    tiny = EPS * max(abs(high), abs(low), np.finfo(float).tiny)
    for _ in range(80):
        polar = qdwh(a - shift * np.eye(n))
        above = round((n + float(np.trace(polar))) / 2)
        if 0 < above < n:
            p = (np.eye(n) + polar) / 2
            # the basis of the projector's range: QR of its columns, largest first, and once more for orthogonality
            order = np.argsort(-np.diag(p), kind="stable")
            q, _ = np.linalg.qr(p[:, order])
            q, _ = np.linalg.qr(np.hstack([p @ q[:, :above], np.eye(n) - p]))
            q = q[:, :n]
            if np.linalg.norm(q[:, above:].T @ a @ q[:, :above]) <= 1e3 * n * max(tiny, EPS * np.linalg.norm(a)):
                return q[:, :above], q[:, above:]
            shift += (high - low) * 1e-3 + tiny  # an eigenvalue lies on the shift
        elif above == 0:
            high, shift = shift, (shift + low) / 2
        else:
            low, shift = shift, (shift + high) / 2
        if high - low <= 4 * n * tiny:
            return None
    return None


def components(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors (columns, the largest entry positive) of a symmetric matrix."""
    values, vectors = [], []

    def part(a: np.ndarray, basis: np.ndarray) -> None:
        if len(a) == 1:
            values.append(float(a[0, 0]))
            vectors.append(basis[:, 0])
            return
        off = a - np.diag(np.diag(a))
        halves = None if np.linalg.norm(off) <= EPS * np.linalg.norm(a) else _split(a)
        if halves is None:
            for k in range(len(a)):
                part(a[k : k + 1, k : k + 1], basis[:, k : k + 1])
            return
        for q in halves:
            b = q.T @ a @ q
            part((b + b.T) / 2, basis @ q)

    part((v + v.T) / 2, np.eye(len(v)))
    q = np.array(vectors).T
    # one step back to the matrix itself: orthonormal again, and each eigenvalue as its vector's quotient
    q, _ = np.linalg.qr(q)
    e = np.einsum("ij,ij->j", q, v @ q)
    order = np.argsort(-e, kind="stable")
    q, e = q[:, order], e[order]
    sign = np.sign(q[np.abs(q).argmax(axis=0), np.arange(len(e))])
    return e, q * np.where(sign == 0, 1, sign)


@dataclass
class Whitening:
    """What is known of the vectors of one dimension: their number ``n``, exact sums, and the components with variance."""

    n: int
    sums: list[int]
    vectors: np.ndarray
    values: np.ndarray
    trace: float
    error: float = 0.0
    mean: np.ndarray = field(init=False)

    def __post_init__(self) -> None:
        self.mean = np.array([s / self.n for s in self.sums])

    def project(self, x: np.ndarray) -> np.ndarray:
        """Rows to whitened coordinates."""
        return (x - self.mean) @ self.vectors / np.sqrt(self.values)


def _rows(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """``(dimension, places, matrix)`` of the vectors of a batch."""
    column = batch.column(batch.schema.get_field_index("x"))
    sizes = column.value_lengths().to_numpy(zero_copy_only=False)
    flat, at = column.flatten().to_numpy(zero_copy_only=False), np.r_[0, np.cumsum(sizes)]
    for d in np.unique(sizes):
        places = np.flatnonzero(sizes == d)
        for k in range(0, len(places), CHUNK):
            own = places[k : k + CHUNK]
            yield int(d), own, flat[at[own][:, None] + np.arange(d)]


def _partial(measure: Callable[[int, np.ndarray], list[np.ndarray]]):
    """Sums of a task's rows by dimension, as exact integers or doubles in text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for d, _, x in _rows(b):
                own = np.concatenate([np.asarray(m, object).ravel() for m in measure(d, x)])
                total[d] = total[d] + own if d in total else own
        yield from _sent(total)
        give_back()

    return run


def _sent(total: dict[int, np.ndarray]) -> Iterator[pa.RecordBatch]:
    if total:
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([[repr(x) for x in v.tolist()] for v in total.values()], pa.list_(pa.string()))], ["dim", "sums"])


def _number(x: str) -> int | float:
    return float(x) if "." in x or "e" in x or "n" in x else int(x)


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[int, np.ndarray] = {}
    for b in batches:
        for d, sums in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            own = np.array([_number(x) for x in sums], object)
            total[d] = total[d] + own if d in total else own
    yield from _sent(total)


def summed(rows: DataFrame, measure: Callable[[int, np.ndarray], list[np.ndarray]]) -> dict[int, np.ndarray]:
    """``measure(dimension, matrix)`` added up over all rows, by dimension: sums in each task, then in few, then here."""
    kind = "dim int, sums array<string>"
    parts = rows.select("x").mapInArrow(_partial(measure), kind).repartition(MERGED).mapInArrow(_merge, kind).collect()
    total: dict[int, np.ndarray] = {}
    for r in parts:
        own = np.array([_number(x) for x in r.sums], object)
        total[r.dim] = total[r.dim] + own if r.dim in total else own
    return total


def _exact_sum(x: np.ndarray) -> np.ndarray:
    return x.sum(axis=0) if float(np.abs(x.astype(float)).max(initial=0)) * len(x) < 2**62 else x.astype(object).sum(axis=0)


def _exact_square(x: np.ndarray) -> np.ndarray:
    """X'X of integers, exactly: in doubles where no sum passes 2**53, else in Python's integers."""
    if float(np.abs(x.astype(float)).max(initial=0)) ** 2 * len(x) < 2**53:
        f = x.astype(float)
        return (f.T @ f).astype(np.int64)
    o = x.astype(object)
    return o.T @ o


def fit(vectors: DataFrame) -> dict[int, Whitening]:
    """Components of distinct vectors ``(x)`` by dimension; numbers and sums are exact, whatever the order of the rows."""
    first = summed(vectors, lambda d, x: [np.array([len(x)]), _exact_sum(x)])
    known = {d: (int(t[0]), [int(s) for s in t[1:]]) for d, t in first.items()}
    # centred on the whole numbers next to the means, so that products stay small and exact
    centre = {d: np.array([s // n for s in sums], object) for d, (n, sums) in known.items()}
    squares = summed(vectors, lambda d, x: [_exact_square(_less(x, centre[d]))])
    out = {}
    for d, (n, sums) in known.items():
        rest = [s - n * int(c) for s, c in zip(sums, centre[d], strict=True)]
        g = squares[d].reshape(d, d)
        v = np.array([[(n * int(g[i, j]) - rest[i] * rest[j]) / (n * n) for j in range(d)] for i in range(d)])
        e, q = components(v)
        keep = int(min(COMPONENTS, (e > NO_VARIANCE * d * max(e[0], 0.0)).sum())) if len(e) else 0
        out[d] = Whitening(n, sums, q[:, :keep], e[:keep], float(np.trace(v)))
    # the covariance of what comes out, measured on the rows
    after = summed(vectors, lambda d, x: _moments(out[d].project(x.astype(float))))
    for d, w in out.items():
        k = len(w.values)
        mean, square = np.array(after[d][:k], float) / w.n, np.array(after[d][k:], float).reshape(k, k) / w.n
        w.error = float(np.abs(square - np.outer(mean, mean) - np.eye(k)).max(initial=0.0))
    return out


def _less(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    small = max((abs(int(v)) for v in c), default=0) < 2**61 and int(np.abs(x.astype(float)).max(initial=0)) < 2**61
    return x - c.astype(np.int64) if small else x.astype(object) - c


def _moments(w: np.ndarray) -> list[np.ndarray]:
    return [w.sum(axis=0), w.T @ w]


def deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int]:
    """Sum over dimensions of (n * x - S) squared, exactly; what passes a long stands at its end."""
    widest = max(float(np.abs(x.astype(float)).max(initial=0)) * n, max((float(abs(s)) for s in sums), default=0.0))
    if (2 * widest) ** 2 * x.shape[1] < 2**62:
        return ((x * n - np.array(sums, np.int64)) ** 2).sum(axis=1).tolist()
    return [min(int(v), 2**63 - 1) for v in ((x.astype(object) * n - np.array(sums, object)) ** 2).sum(axis=1)]


def _apply(fits: dict[int, Whitening]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(b.schema.get_field_index("vec_id"))
            for d, places, x in _rows(b):
                w = fits[d]
                k = min(COMPONENTS, d)
                y = np.full((len(x), k), np.nan)
                y[:, : len(w.values)] = w.project(x.astype(float))
                share = np.r_[w.values / w.trace if w.trace else w.values, np.zeros(k - len(w.values))]
                flat = y.ravel()
                columns = [ids.take(pa.array(np.repeat(places, k))), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))), pa.array(np.full(len(flat), w.n)), pa.array(np.repeat(deviations(x, w.n, w.sums), k), pa.int64()),
                           pa.array(flat, mask=np.isnan(flat)), pa.array(np.tile(share, len(x))), pa.array(np.full(len(flat), w.error))]
                yield pa.RecordBatch.from_arrays(columns, ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])
        give_back()

    return run


def whiten(vectors: DataFrame) -> DataFrame:
    """``(vec_id, component, n, deviation, whitened, explained, identity_error)`` of every row, for its first ``COMPONENTS``.

    Vectors that are null, empty or hold a null or non-finite entry are left out; a vector that repeats counts once for the
    components and comes out as often as it stands in the table, whatever its id. Vectors of another dimension have components of
    their own. A component without variance (as all are where there is one vector) has a null ``whitened`` and explains 0.
    Equal eigenvalues share a subspace, in which some orthonormal basis is taken, the same for all rows. An empty table gives
    an empty result; further columns are ignored.
    """
    rows = quantised(vectors)
    kind = dict(vectors.dtypes)["vec_id"]
    distinct = cut(rows.select("x").distinct(), "distinct_vectors")
    return rows.mapInArrow(_apply(fit(distinct)), f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double")
