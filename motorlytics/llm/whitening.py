"""Embedding whitening by a bidiagonal qd solver.

1. Rows are quantised to whole numbers, each distinct vector is taken once (the fit
   list, a stored table), and its count and per-dimension sums are exact integers.
2. Blockwise QR: each task reduces its blocks of centred rows to one triangle; triangles
   are stacked and reduced again in groups until a few are left, so one triangle of
   dimension x dimension is all that reaches the driver, whatever the number of rows.
3. Householder reflections make the triangle bidiagonal; its squared singular values come
   from dqds (differential quotient-difference with shifts) to high relative accuracy, the
   right vectors from twisted factorisations, taken back through the reflections.
4. Every row is projected; the covariance of the projected fit list, merged from
   per-block means and scatters, is compared with the identity.

The shift of a dqds step is 1 / sum(1 / d_i), d_i being the pivots of the unshifted
transform: these are the reciprocals of the diagonal of the inverse, so the shift never
passes the smallest eigenvalue.

Defined results: vectors that are null, hold null, NaN or infinite components, or differ
in length from most others (ties: the longer length) take no part; null and repeated ids
are rows like any other; whole numbers beyond 64 bits saturate; a direction without
variance (its eigenvalue below ``RANK`` times the largest) can't be whitened and is left
out, so a table with one distinct vector, or none, gives no rows; of equal eigenvalues any
orthonormal directions are taken; a deviation beyond 64 bits is null. Only the columns named are read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from motorlytics.llm.common import stored

SCALE = 256
COMPONENTS = 4
#: Rows of a block that is reduced at once, and triangles that one task stacks.
BLOCK, FAN_IN = 4096, 16
RANK = 1e-13
EPS = np.finfo(np.float64).eps
#: Eigenvalues closer than this, relative to the larger, count as a cluster.
CLUSTER = 1e-4


class Whitening(NamedTuple):
    n: int
    sums: list[int]
    values: np.ndarray      # eigenvalues of the covariance, falling
    directions: np.ndarray  # one row each
    trace: float
    identity_error: float


# -- rows ------------------------------------------------------------------
def quantised(table: DataFrame, vector: str, keep: list[str]) -> DataFrame:
    """``keep`` and ``x`` (array of long) of the rows that take part."""
    v = F.col(vector).cast("array<double>")
    rows = table.select(*keep, v.alias("x")).where("x is not null")
    finite = F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    rows = rows.where(F.coalesce(finite, F.lit(False)))
    width = rows.groupBy(F.size("x").alias("w")).count().orderBy(F.desc("count"), F.desc("w")).limit(1).collect()
    rows = rows.where(F.size("x") == (width[0]["w"] if width else 0))
    whole = F.transform("x", lambda c: F.floor(F.greatest(F.least(c * float(SCALE), F.lit(2.0 ** 63)), F.lit(-2.0 ** 63))))
    return rows.withColumn("x", whole)


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), -1)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
    for batch in batches:
        for at in range(0, batch.num_rows, BLOCK):
            yield _matrix(batch.column("x").slice(at, BLOCK))


class Centre:
    """Rows minus the exact mean: the whole part of the mean is taken off in integers."""

    def __init__(self, n: int, sums: list[int]) -> None:
        whole = [s // n for s in sums]
        self.rest = np.array([(s - w * n) / n for s, w in zip(sums, whole)])
        self.wide = max(map(abs, whole), default=0) >= 1 << 61
        self.whole = np.array(whole, dtype=object if self.wide else np.int64)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        if self.wide or (x.size and max(abs(int(x.max())), abs(int(x.min()))) >= 1 << 61):
            return (x.astype(object) - self.whole.astype(object)).astype(np.float64) - self.rest
        return (x - self.whole).astype(np.float64) - self.rest


def sums_of(fit: DataFrame) -> tuple[int, list[int]]:
    """Count and exact sums of the fit list. Each task adds the upper and lower halves of
    the numbers, so 64 bits hold them; the halves are added as decimals."""
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, high, low = 0, 0, 0
        for x in _blocks(batches):
            n, high, low = n + len(x), high + (x >> 32).sum(axis=0), low + (x & 0xFFFFFFFF).sum(axis=0)
        if n:
            at = np.arange(len(high))
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(np.full(len(at), n)), pa.array(high), pa.array(low)], names=["at", "n", "high", "low"])

    # one row for each dimension
    rows = fit.mapInArrow(add, "at int, n long, high long, low long").groupBy("at").agg(
        *(F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in ("n", "high", "low"))).orderBy("at").collect()
    return (int(rows[0]["n"]), [(int(r["high"]) << 32) + int(r["low"]) for r in rows]) if rows else (0, [])


# -- blockwise QR ----------------------------------------------------------
def _reduce(rows: np.ndarray, triangle: np.ndarray | None) -> np.ndarray:
    return np.linalg.qr(rows if triangle is None else np.vstack([triangle, rows]), mode="r")


def triangle_of(fit: DataFrame, centre: Centre) -> np.ndarray:
    """R of the centred fit list."""
    def as_batch(r: np.ndarray, key: int) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([key]), pa.array([r.ravel().tolist()], pa.list_(pa.float64()))], names=["key", "r"])

    def reduce_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        r = None
        for x in _blocks(batches):
            r = _reduce(centre(x), r)
        if r is not None:
            yield as_batch(r, TaskContext.get().partitionId())

    width = len(centre.rest)

    def stack(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = None
        for batch in batches:
            for row in batch.column("r"):
                r = _reduce(np.array(row.values).reshape(-1, width), r)
        yield as_batch(r, key[0].as_py())

    parts = stored(fit.mapInArrow(reduce_rows, "key long, r array<double>"), "whitening-triangles")
    while parts.count() > FAN_IN:
        parts = stored(parts.withColumn("key", F.expr(f"key div {FAN_IN}")).groupBy("key").applyInArrow(stack, parts.schema), "whitening-triangles")
    r = None
    for row in parts.orderBy("key").collect():  # at most FAN_IN triangles
        r = _reduce(np.array(row["r"]).reshape(-1, width), r)
    return r


# -- the solver ------------------------------------------------------------
def bidiagonalise(r: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Diagonal, superdiagonal and right reflectors (vector ``v``: I - 2 v v') of
    U' R V = B, B upper bidiagonal."""
    a = np.zeros((r.shape[1], r.shape[1]))
    a[:len(r)] = r[:r.shape[1]]
    m, right = len(a), []

    def reflector(x: np.ndarray) -> np.ndarray | None:
        size = np.linalg.norm(x)
        if size == 0 or np.linalg.norm(x[1:]) == 0:
            return None
        v = x / size
        v[0] += math.copysign(1.0, v[0])
        return v / np.linalg.norm(v)

    for k in range(m):
        v = reflector(a[k:, k].copy())
        if v is not None:
            a[k:, k:] -= 2 * np.outer(v, v @ a[k:, k:])
        v = reflector(a[k, k + 1:].copy()) if k + 2 < m else None
        whole = np.zeros(m)
        if v is not None:
            a[k:, k + 1:] -= 2 * np.outer(a[k:, k + 1:] @ v, v)
            whole[k + 1:] = v
        right.append(whole)
    return np.diagonal(a).copy(), np.diagonal(a, 1).copy(), right


def _dqds(q: list[float], e: list[float], shift: float) -> tuple[list[float], list[float], list[float]]:
    """One differential qd transform with a shift: new q, new e and its pivots d."""
    d, pivots, qq, ee = q[0] - shift, [], [], []
    for i in range(len(e)):
        pivots.append(d)
        top = d + e[i]
        ratio = q[i + 1] / top if top else 0.0
        qq.append(top)
        ee.append(e[i] * ratio)
        d = d * ratio - shift if top else q[i + 1] - shift
    pivots.append(d)
    qq.append(d)
    return qq, ee, pivots


def _step(q: list[float], e: list[float]) -> tuple[list[float], list[float], float]:
    """A transform by the largest shift known to be safe, and that shift."""
    plain = _dqds(q, e, 0.0)
    if min(plain[2]) <= 0:
        return plain[0], plain[1], 0.0
    bound = 1.0 / sum(1.0 / d for d in plain[2])
    for part in (1.0, 0.9, 0.5):  # rounding may carry the bound a little too far
        done = _dqds(q, e, bound * part)
        if min(done[2]) >= 0:
            return done[0], done[1], bound * part
    return plain[0], plain[1], 0.0


def squared_singular_values(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squares of the singular values of the bidiagonal (a, b), falling, by dqds."""
    largest = max(np.abs(a).max(initial=0.0), np.abs(b).max(initial=0.0))
    if largest == 0:
        return np.zeros(len(a))
    q, e = [float(v) ** 2 for v in a / largest], [float(v) ** 2 for v in b / largest]
    found: list[float] = []
    work = [(q, e, 0.0)]  # blocks, each with the sum of its shifts
    while work:
        q, e, shifted = work.pop()
        while True:
            m = len(q)
            if m == 1:
                found.append(shifted + q[0])
                break
            cut = next((i for i in range(m - 2, -1, -1) if e[i] <= EPS ** 2 * (shifted + max(q[i], q[i + 1])) or e[i] < 1e-290), None)
            if cut is not None:
                work.append((q[:cut + 1], e[:cut], shifted))
                q, e = q[cut + 1:], e[cut + 1:]
                continue
            if max(q) + max(e) <= EPS * shifted:
                found.extend(shifted + v for v in q)
                break
            q, e, shift = _step(q, e)
            shifted += shift
    return np.sort(np.array(found))[::-1] * largest ** 2


def twisted_vectors(a: np.ndarray, b: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Unit right singular vectors (rows) of the bidiagonal for squared singular values
    ``values`` (falling), from twisted factorisations L D L' - value. Within a cluster the
    next best twist is taken until the vector is new."""
    m = len(a)
    scale = max(np.abs(a).max(initial=0.0), np.abs(b).max(initial=0.0))
    a = np.where(np.abs(a) < EPS * scale * 1e-3, EPS * scale * 1e-3, a)
    big_d, lower = a ** 2, b / a[:-1]
    tiny = EPS ** 3 * scale ** 2
    out: list[np.ndarray] = []
    for j, value in enumerate(values):
        below, above, s, p = np.zeros(m - 1), np.zeros(m - 1), np.zeros(m), np.zeros(m)
        s[0] = -value
        for i in range(m - 1):  # stationary transform, from the top
            pivot = s[i] + big_d[i] or tiny
            below[i] = big_d[i] * lower[i] / pivot
            s[i + 1] = below[i] * lower[i] * s[i] - value
        p[m - 1] = big_d[m - 1] - value
        for i in range(m - 2, -1, -1):  # progressive transform, from the bottom
            pivot = big_d[i] * lower[i] ** 2 + p[i + 1] or tiny
            ratio = big_d[i] / pivot
            above[i] = lower[i] * ratio
            p[i] = p[i + 1] * ratio - value
        cluster = [out[k] for k in range(j) if abs(values[k] - value) <= CLUSTER * abs(values[k])]
        best, best_size = None, -1.0
        for twist in np.argsort(np.abs(s + p + value), kind="stable"):
            z = np.zeros(m)
            z[twist] = 1.0
            for i in range(twist - 1, -1, -1):
                z[i] = -below[i] * z[i + 1]
            for i in range(twist, m - 1):
                z[i + 1] = -above[i] * z[i]
            z = z / np.linalg.norm(z)
            if not np.isfinite(z).all():
                continue
            for _ in range(2):
                for other in cluster:
                    z = z - (other @ z) * other
            size = np.linalg.norm(z)
            if size > best_size:
                best, best_size = z / (size or 1.0), size
            if size > 0.1:
                break
        out.append(best)
    return np.array(out).reshape(len(values), m)


def principal(r: np.ndarray, n: int, components: int) -> tuple[np.ndarray, np.ndarray]:
    """Largest eigenvalues of R'R / n with unit eigenvectors as rows, falling; those
    without variance are left out."""
    largest = np.abs(r).max(initial=0.0)
    if largest == 0:
        return np.empty(0), np.empty((0, r.shape[1]))
    a, b, right = bidiagonalise(r / largest)
    values = squared_singular_values(a, b)[:components]
    values = values[values > RANK * values[0]]
    vectors = twisted_vectors(a, b, values)
    for v in reversed(right):
        vectors = vectors - 2 * np.outer(vectors @ v, v)
    return values * largest ** 2 / n, vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


# -- fit and apply ---------------------------------------------------------
def _identity_error(fit: DataFrame, centre: Centre, project: np.ndarray) -> tuple[float, float]:
    """Largest absolute entry of the covariance of the projected fit list minus the
    identity, and the trace of the covariance of the list. Means and scatters of the
    blocks are merged by task, then over the tasks' rows in groups."""
    k = len(project)

    def merged(x: tuple, y: tuple) -> tuple:
        if x[0] == 0:
            return y
        n, gap = x[0] + y[0], y[1] - x[1]
        return n, x[1] + gap * (y[0] / n), x[2] + y[2] + np.outer(gap, gap) * (x[0] * y[0] / n), x[3] + y[3]

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = (0, np.zeros(k), np.zeros((k, k)), 0.0)
        for x in _blocks(batches):
            c = centre(x)
            w = c @ project.T
            mean = w.mean(axis=0)
            total = merged(total, (len(w), mean, (w - mean).T @ (w - mean), float((c * c).sum())))
        if total[0]:
            yield pa.RecordBatch.from_arrays([pa.array([total[0]]), pa.array([total[1].tolist()], pa.list_(pa.float64())),
                                              pa.array([total[2].ravel().tolist()], pa.list_(pa.float64())), pa.array([total[3]])], names=["n", "mean", "scatter", "square"])

    parts = fit.mapInArrow(moments, "n long, mean array<double>, scatter array<double>, square double")
    # of all parts, scatter = sum of scatters + sum of n (mean - grand mean)(mean - grand mean)'; the grand
    # mean is zero but for rounding, so the products below lose nothing
    cells = parts.select(F.sum("n").alias("n"), F.sum("square").alias("square"), *(
        F.sum(F.col("n") * F.col("mean")[i]).alias(f"m{i}") for i in range(k)), *(
        F.sum(F.col("scatter")[i * k + j] + F.col("n") * F.col("mean")[i] * F.col("mean")[j]).alias(f"c{i}_{j}") for i in range(k) for j in range(k))).first()
    n = cells["n"]
    mean = np.array([cells[f"m{i}"] / n for i in range(k)])
    cov = np.array([[cells[f"c{i}_{j}"] / n for j in range(k)] for i in range(k)]) - np.outer(mean, mean)
    return float(np.abs(cov - np.eye(k)).max()), cells["square"] / n


def fit_whitening(rows: DataFrame, components: int = COMPONENTS) -> Whitening | None:
    """Fitted on each distinct ``x`` of ``rows`` once; None without variance."""
    fit = stored(rows.select("x").distinct(), "whitening-fit")
    n, sums = sums_of(fit)
    if n < 2 or not sums:
        return None
    centre = Centre(n, sums)
    values, directions = principal(triangle_of(fit, centre), n, components)
    if not len(values):
        return None
    error, trace = _identity_error(fit, centre, directions / np.sqrt(values)[:, None])
    return Whitening(n, sums, values, directions, trace, error)


RESULT = [("component", "int"), ("n", "long"), ("deviation", "long"), ("whitened", "double"), ("explained", "double"), ("identity_error", "double")]


def deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """sum (n x - S)^2 of each row, exact: in 64 bits where a bound proves them enough."""
    widest = n * (max(abs(int(x.max())), abs(int(x.min()))) if x.size else 0) + max(map(abs, sums))
    if widest * widest * x.shape[1] < 1 << 63:
        gap = x * n - np.array(sums, dtype=np.int64)
        return (gap * gap).sum(axis=1).tolist()
    gap = x.astype(object) * n - np.array(sums, dtype=object)
    return [v if v < 1 << 63 else None for v in (gap * gap).sum(axis=1)]


def whiten(table: DataFrame, vector: str, keep: list[str], components: int = COMPONENTS) -> DataFrame:
    """``keep`` of every row that takes part, for each component in turn with its place
    in the whitened space."""
    rows = quantised(table, vector, keep)
    schema = T.StructType([*rows.select(*keep).schema.fields, *(T.StructField(n, T._parse_datatype_string(t)) for n, t in RESULT)])
    model = fit_whitening(rows, components)
    if model is None:
        return rows.sparkSession.createDataFrame([], schema)
    centre, project = Centre(model.n, model.sums), model.directions / np.sqrt(model.values)[:, None]
    explained, k = model.values / model.trace, len(model.values)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                x = _matrix(part.column("x"))
                m = len(x)
                each = pa.array(np.repeat(np.arange(m), k))
                yield pa.RecordBatch.from_arrays([
                    *(part.column(c).take(each) for c in keep),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, model.n, np.int64)),
                    pa.array(deviations(x, model.n, model.sums), pa.int64()).take(each),
                    pa.array((centre(x) @ project.T).ravel()), pa.array(np.tile(explained, m)), pa.array(np.full(m * k, model.identity_error)),
                ], names=schema.names)

    return rows.mapInArrow(apply, schema)
