"""Embedding whitening: project centred vectors on the leading components, each scaled to unit variance.

Entries are put on an integer grid, so counts, sums and deviations are exact and equal vectors are equal.  Statistics
are over the distinct vectors: a vector that a third of all rows share counts once.  Three passes over the distinct
vectors add up per task and then per entry: sums, centred products, and the check that whitened vectors have the unit
matrix as covariance.  What reaches the driver is d x d for d entries a vector, whatever the number of rows.  There the
matrix is brought to tridiagonal form by Householder reflections, the leading eigenvalues are found by bisection on
Sturm counts, their vectors by inverse iteration, reorthogonalised within clusters of close eigenvalues.  The
components, d x k, go to the tasks that project the rows.

Defined results: vectors that are null, or hold null, non-finite or immense (2^31 and more) entries are dropped; so
are vectors whose length is not the commonest one (of equally common ones the longest) and empty ones; rows without id
and repeated rows are returned as they are; directions without variance (below 1e-12 of all) have no component, so a
single distinct vector gives no rows, as an empty table does; a deviation beyond 64 bits is null.  Of equal eigenvalues
the vectors are some orthonormal basis, the same for all rows.  Only the two named columns are read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from secscan.llm.common import written

COMPONENTS = 16
SCALE, SHIFT, LARGEST = 64, 1_000_000, float(1 << 31)
NO_VARIANCE = 1e-12
BATCH_VALUES = 1 << 20


def grid(df: DataFrame, id_: str, vector: str) -> DataFrame:
    """(id, x): the vectors that count, as long integers."""
    v = F.col(f"`{vector}`")
    fine = v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < LARGEST))
    x = F.transform(v, lambda c: F.floor(c.cast("double") * SCALE).cast("bigint") + SHIFT)
    rows = df.filter(F.coalesce(fine, F.lit(False))).select(F.col(f"`{id_}`").alias("id"), x.alias("x"))
    size = rows.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return rows.filter(F.size("x") == (size.d if size else 0))


def blocks(batches: Iterator[pa.RecordBatch], d: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Batches of bounded size with their vectors as an array of integers, a row each."""
    step = max(1, BATCH_VALUES // d)
    for b in batches:
        for at in range(0, len(b), step):
            part = b.slice(at, step)
            yield part, part.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def added(vectors: DataFrame, d: int, rows: int, of: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """Sum of of(block), a ``rows`` x m array, over all blocks: added up per task, then per entry."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for _, x in blocks(batches, d):
            part = of(x)
            total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(range(rows), pa.int32()), pa.array(total.tolist(), pa.list_(pa.float64()))], names=["i", "v"])

    entry = vectors.select("x").mapInArrow(work, "i int, v array<double>").select("i", F.posexplode("v").alias("j", "v"))
    got = entry.groupBy("i", "j").agg(F.sum("v").alias("v")).collect()
    out = np.zeros((rows, max((r.j for r in got), default=-1) + 1))
    for r in got:
        out[r.i, r.j] = r.v
    return out


def sums(vectors: DataFrame, d: int) -> tuple[int, list[int]]:
    """(number of vectors, exact sum of each dimension)."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, x in blocks(batches, d):
            yield pa.RecordBatch.from_arrays([pa.array(range(-1, d), pa.int32()), pa.array([len(x), *x.sum(axis=0).tolist()], pa.int64())], names=["j", "s"])

    got = vectors.select("x").mapInArrow(work, "j int, s bigint").groupBy("j").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect()
    by = {r.j: int(r.s) for r in got}
    return by.get(-1, 0), [by.get(j, 0) for j in range(d)]


def tridiagonal(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(diagonal, off-diagonal, q) with q' a q tridiagonal, by Householder reflections."""
    a, n = a.copy(), len(a)
    q = np.eye(n)
    for k in range(n - 2):
        x = a[k + 1:, k].copy()
        scale = np.abs(x).max()
        if scale == 0 or not np.abs(x[1:]).max() > 0:
            continue
        v = x / scale
        v[0] += np.copysign(np.linalg.norm(v), v[0])
        v /= np.linalg.norm(v)
        p = a[k + 1:, k + 1:] @ v
        w = p - v * (v @ p)
        a[k + 1:, k + 1:] -= 2 * (np.outer(v, w) + np.outer(w, v))
        a[k + 1:, k] = x - 2 * v * (v @ x)
        a[k, k + 1:] = a[k + 1:, k]
        q[:, k + 1:] -= 2 * np.outer(q[:, k + 1:] @ v, v)
    return np.diag(a).copy(), np.diag(a, 1).copy(), q


def below(diag: np.ndarray, off: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sturm counts: how many eigenvalues are smaller than each of ``at``."""
    tiny = np.finfo(float).tiny * max(1.0, float((off * off).max(initial=0.0)))
    count = np.zeros(len(at), int)
    q = np.ones(len(at))
    square = np.concatenate([[0.0], off * off])
    for i, x in enumerate(diag):
        q = x - at - square[i] / q
        q = np.where(np.abs(q) < tiny, -tiny, q)
        count += q < 0
    return count


def eigenvalues(diag: np.ndarray, off: np.ndarray, k: int) -> np.ndarray:
    """The k largest, falling, by bisection to the last bit."""
    n = len(diag)
    reach = np.concatenate([np.abs(off), [0.0]]) + np.concatenate([[0.0], np.abs(off)])
    low, high = np.full(k, (diag - reach).min()), np.full(k, (diag + reach).max())
    slack = 2 * np.finfo(float).eps * max(abs(low[0]), abs(high[0])) + np.finfo(float).tiny
    low, high = low - slack, high + slack
    rank = n - 1 - np.arange(k)  # of the wanted one among all, from the smallest
    for _ in range(2000):
        middle = low + (high - low) / 2
        if ((middle <= low) | (middle >= high)).all():
            break
        over = below(diag, off, middle) > rank
        low, high = np.where(over, low, middle), np.where(over, middle, high)
    return low + (high - low) / 2


def solve(diag: np.ndarray, off: np.ndarray, shift: float, right: np.ndarray) -> np.ndarray:
    """(T - shift) z = right by elimination with row exchanges; zero pivots become tiny."""
    n = len(diag)
    norm = max(np.abs(diag).max(), np.abs(off).max(initial=0.0)) or 1.0
    least = np.finfo(float).eps * norm
    a, b, c, z = diag - shift, np.concatenate([off, [0.0]]), np.zeros(n), right.astype(float).copy()
    for i in range(n - 1):
        low, nxt, after = off[i], a[i + 1], b[i + 1] if i + 2 < n else 0.0
        if abs(low) > abs(a[i]):
            f = a[i] / low
            a[i], keep = low, b[i]
            b[i], c[i] = nxt, after
            a[i + 1], b[i + 1] = keep - f * nxt, -f * after
            z[i], z[i + 1] = z[i + 1], z[i] - f * z[i + 1]
        else:
            if abs(a[i]) < least:
                a[i] = least
            f = low / a[i]
            a[i + 1] = nxt - f * b[i]
            z[i + 1] -= f * z[i]
    if abs(a[n - 1]) < least:
        a[n - 1] = least
    for i in range(n - 1, -1, -1):
        z[i] -= (b[i] * z[i + 1] if i + 1 < n else 0.0) + (c[i] * z[i + 2] if i + 2 < n else 0.0)
        z[i] /= a[i]
        if abs(z[i]) > 1e100:
            z /= 1e100
    return z


def eigenvectors(diag: np.ndarray, off: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Unit vectors of the tridiagonal matrix, a column each: inverse iteration, orthogonal within clusters."""
    n = len(diag)
    norm = max((np.abs(diag) + np.concatenate([np.abs(off), [0.0]]) + np.concatenate([[0.0], np.abs(off)])).max(), np.finfo(float).tiny)
    rng = np.random.default_rng(12)
    out = np.zeros((n, len(values)))
    first, last = 0, np.inf
    for j, value in enumerate(values):
        if j and values[j - 1] - value > 1e-3 * norm:
            first = j
        shift = min(value, last - 4 * np.finfo(float).eps * norm) if j > first else value
        last = shift
        z = rng.standard_normal(n)
        for _ in range(5):
            for _ in range(2):
                z -= out[:, first:j] @ (out[:, first:j].T @ z)
            z = solve(diag, off, shift, z / np.linalg.norm(z))
            z /= np.abs(z).max()
        for _ in range(2):
            z -= out[:, first:j] @ (out[:, first:j].T @ z)
        out[:, j] = z / np.linalg.norm(z)
    return out


def leading(v: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(values, vectors) of the k largest eigenvalues that hold some variance."""
    diag, off, q = tridiagonal((v + v.T) / 2)
    values = eigenvalues(diag, off, min(k, len(v)))
    values = values[values > NO_VARIANCE * np.trace(v)]
    vectors = q @ eigenvectors(diag, off, values) if len(values) else np.zeros((len(v), 0))
    return values, vectors


def whiten(df: DataFrame, id_: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """A row per row and component: id, component, n, deviation, whitened, explained, identity_error."""
    spark = df.sparkSession
    rows = grid(df, id_, vector)
    kind = rows.schema["id"].dataType
    distinct = written(rows.select("x").distinct(), "distinct-vectors")
    schema = f"`{id_}` {kind.simpleString()}, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"
    head = distinct.first()
    if head is None:
        return spark.createDataFrame([], schema)
    d = len(head.x)
    n, total = sums(distinct, d)
    whole = np.array([s // n for s in total])
    rest = np.array([s % n for s in total])
    centred = lambda x: (x - whole).astype(float) - rest / n
    v = added(distinct, d, d, lambda x: (y := centred(x)).T @ y) / n
    values, vectors = leading(v, components)
    if not len(values):
        return spark.createDataFrame([], schema)
    k = len(values)
    project = vectors / np.sqrt(values)
    explained = values / np.trace(v)

    def moments(x: np.ndarray) -> np.ndarray:
        w = centred(x) @ project
        return np.vstack([w.T @ w, w.sum(axis=0)])

    got = added(distinct, d, k + 1, moments) / n
    error = float(np.abs(got[:k] - np.outer(got[k], got[k]) - np.eye(k)).max())

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, x in blocks(batches, d):
            y = centred(x)
            w = y @ project
            m = (x - whole) * np.int64(n) - rest
            exact = (m * m).sum(axis=1)
            lost = np.square(y).sum(axis=1) * float(n) ** 2 > 9.2e18
            ids = b.column("id").take(pa.array(np.repeat(np.arange(len(x)), k)))
            yield pa.RecordBatch.from_arrays([
                ids, pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))), pa.array(np.full(len(x) * k, n, np.int64)),
                pa.array(np.repeat(exact, k), mask=np.repeat(lost, k)), pa.array(w.reshape(-1)),
                pa.array(np.tile(explained, len(x))), pa.array(np.full(len(x) * k, error))],
                names=[id_, "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.mapInArrow(apply, schema)
