"""Embedding whitening by a bidiagonal qd solver.

1. Entries become whole levels x = floor(64 * c) + 1000000; the fit list has each distinct x vector once. Sums are exact.
2. Every task reduces its centred rows (n*x - S)/n to one triangular factor by QR of block after block; the factors are
   reduced sixteen at a time, a table a round, until one R of dimensions x dimensions is left. R'R / n is the
   covariance, which is never formed.
3. On the driver, on R alone: Householder reflections make R bidiagonal, dqds finds its singular values to high relative
   accuracy, and the twisted factorisation of L D L' - sigma**2 gives each direction where its last pivot is smallest.
   Directions of singular values that lie close together are made orthogonal, by inverse iteration where needed.
4. All rows are projected in one narrow stage. The identity error comes from a further pass over the fit list.

Vectors that are null or hold null or non-finite entries get no rows. Vectors of different lengths have nothing in
common: each length is fitted by itself. Directions of zero variance (constant dimensions, fewer distinct vectors than
dimensions) cannot be whitened and are no components, so one distinct vector, and the empty table, give no rows. Repeated
rows and ids each get their rows; null ids are kept. Components of equal variance are numbered in any one order, and each
direction has its largest entry positive. Levels are held within 2**52; a deviation beyond 64 bits is null.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import stored

SCALE, OFFSET = 64, 1_000_000
LIMIT = float(1 << 52)
#: Rows that a task adds to its triangular factor at a time, and factors that are reduced together.
BLOCK, FAN_IN = 2048, 16
EPS = float(np.finfo(float).eps)
#: Eigenvalues closer than this, relatively, form a cluster whose vectors are made orthogonal.
CLUSTER = 1e-3
#: Relative distance of the shift from eigenvalues that are equal to rounding.
APART = 1e-9


# ---------------------------------------------------------------- solver on the triangular factor

def triangle(rows: np.ndarray) -> np.ndarray:
    """The triangular factor of ``rows``, at most as many rows as columns."""
    return np.linalg.qr(rows, mode="r") if len(rows) else rows


def bidiagonal(r: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a, b, v): U'rV has diagonal a >= 0 and superdiagonal b >= 0; v has V's columns."""
    x, d = r.copy(), r.shape[1]
    v = np.eye(d)
    for k in range(d):
        h = _reflector(x[k:, k])
        x[k:, k:] -= np.outer(h, h @ x[k:, k:])
        if k + 1 < d:
            h = _reflector(x[k, k + 1:])
            x[k:, k + 1:] -= np.outer(x[k:, k + 1:] @ h, h)
            v[:, k + 1:] -= np.outer(v[:, k + 1:] @ h, h)
    a, b = np.diag(x).copy(), np.diag(x, 1).copy()
    left, right = 1.0, np.ones(d)
    for k in range(d):
        left = right[k] * (-1 if a[k] < 0 else 1)
        if k + 1 < d:
            right[k + 1] = left * (-1 if b[k] < 0 else 1)
    return np.abs(a), np.abs(b), v * right


def _reflector(x: np.ndarray) -> np.ndarray:
    """h with (I - hh')x along the first axis; zero where x is there already."""
    h = np.array(x, float)
    top = np.abs(h).max(initial=0.0)
    if top == 0 or not h[1:].any():
        return np.zeros(len(h))
    h /= top
    h[0] += np.copysign(np.linalg.norm(h), h[0])
    return h * (np.sqrt(2) / np.linalg.norm(h))


def dqds(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squares of the singular values of the bidiagonal matrix (a, b), falling."""
    q, e = (a * a).tolist(), (b * b).tolist()
    found, start = [], 0
    for i in range(len(q)):
        if i == len(e) or e[i] <= EPS * EPS * min(q[i], q[i + 1]):
            found += _block(q[start:i + 1], e[start:i])
            start = i + 1
    return np.sort(np.array(found))[::-1]


def _transform(q: list, e: list, n: int, shift: float):
    """One dqds step on the first n values: (q, e) of the shifted matrix, or None if the shift is too large."""
    d = q[0] - shift
    qq, ee = [0.0] * n, [0.0] * (n - 1)
    for i in range(n - 1):
        if d < 0:
            return None
        s = d + e[i]
        qq[i] = s
        if s == 0:
            d = q[i + 1] - shift
        else:
            t = q[i + 1] / s
            ee[i] = e[i] * t
            d = d * t - shift
    if d < 0 or d != d:
        return None
    qq[n - 1] = d
    return qq, ee


def _block(q: list, e: list) -> list:
    out, total, n = [], 0.0, len(q)
    while n:
        while n > 1 and e[n - 2] <= 100 * EPS * EPS * (total + q[n - 1]):
            out.append(total + q[n - 1])
            n -= 1
        if n == 1:
            out.append(total + q[0])
            break
        # the smaller eigenvalue of the last two rows bounds the smallest from above; smaller shifts follow if it fails
        p, r, s = q[n - 2], q[n - 1], e[n - 2]
        half = (p + r + s) / 2
        shift = p * r / (half + max(half * half - p * r, 0.0) ** 0.5) if half else 0.0
        shift *= 1 - 1e-8
        step = None
        for _ in range(6):
            if shift <= EPS * total * 1e-2:
                break
            step = _transform(q, e, n, shift)
            if step:
                break
            shift /= 4
        if step is None:
            shift, step = 0.0, _transform(q, e, n, 0.0)
        total += shift
        q, e = step
    return out


class Tridiagonal:
    """B'B of a bidiagonal B = (a, b) as L D L'."""

    def __init__(self, a: np.ndarray, b: np.ndarray):
        top = max(a.max(initial=0.0), b.max(initial=0.0))
        a = np.maximum(a, EPS * top * 1e-3)  # a zero on the diagonal would have no L
        self.d, self.l = a * a, b / a[:len(b)]
        self.tiny = (EPS * top) ** 2 * 1e-6 or 1.0

    def twisted(self, value: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(D+, L+, U-, gamma) of L D L' - value."""
        n, d, l = len(self.d), self.d, self.l
        plus, lower, s = np.empty(n), np.empty(n), np.empty(n)
        upper, p = np.empty(n), np.empty(n)
        s[0] = -value
        for i in range(n):
            plus[i] = self._safe(d[i] + s[i])
            if i + 1 < n:
                lower[i] = l[i] * d[i] / plus[i]
                s[i + 1] = lower[i] * l[i] * s[i] - value
        p[n - 1] = d[n - 1] - value
        for i in range(n - 2, -1, -1):
            t = d[i] / self._safe(d[i] * l[i] * l[i] + p[i + 1])
            upper[i] = l[i] * t
            p[i] = p[i + 1] * t - value
        return plus, lower, upper, s + p + value

    def _safe(self, x: float) -> float:
        return x if abs(x) > self.tiny else self.tiny

    def vector(self, value: float) -> np.ndarray:
        """Unit eigenvector for the eigenvalue ``value``."""
        _, lower, upper, gamma = self.twisted(value)
        n, r = len(self.d), int(np.argmin(np.abs(gamma)))
        z = np.zeros(n)
        z[r] = 1
        for i in range(r - 1, -1, -1):
            z[i] = -lower[i] * z[i + 1]
        for i in range(r, n - 1):
            z[i + 1] = -upper[i] * z[i]
        return z / np.linalg.norm(z)

    def solve(self, value: float, rhs: np.ndarray) -> np.ndarray:
        """Direction of (L D L' - value)^-1 rhs."""
        plus, lower, _, _ = self.twisted(value)
        x = rhs.copy()
        for i in range(1, len(x)):
            x[i] -= lower[i - 1] * x[i - 1]
        x /= plus
        for i in range(len(x) - 2, -1, -1):
            x[i] -= lower[i] * x[i + 1]
        return x / np.linalg.norm(x)


def _orthogonal(z: np.ndarray, others: list) -> tuple[np.ndarray, float]:
    """z without its parts along ``others``, as a unit vector, and the share of its length that was left."""
    z = z / np.linalg.norm(z)
    for _ in range(2):
        for o in others:
            z = z - (o @ z) * o
    left = float(np.linalg.norm(z))
    return (z / left if left else z), left


def directions(a: np.ndarray, b: np.ndarray, values: np.ndarray, most: int) -> np.ndarray:
    """Right singular vectors (columns) of the bidiagonal (a, b) for the ``most`` largest of ``values``."""
    edges = [0, *[i + 1 for i in range(len(b)) if b[i] <= EPS * min(a[i], a[i + 1])], len(a)]
    blocks = [(s, t, Tridiagonal(a[s:t], b[s:t - 1]), dqds(a[s:t], b[s:t - 1]).tolist()) for s, t in zip(edges, edges[1:])]
    rng, out = np.random.default_rng(0), []
    owned = sorted(((v, k) for k, (_, _, _, vs) in enumerate(blocks) for v in vs), key=lambda x: -x[0])[:most]
    before: dict[int, list] = {}
    for value, k in owned:
        s, t, matrix, _ = blocks[k]
        near = before.setdefault(k, [])
        # a cluster: each value is close to the one before it
        if near and near[-1][0] - value > CLUSTER * near[-1][0]:
            near.clear()
        z, left = _orthogonal(matrix.vector(value), [x for _, x in near])
        if left < 0.5:  # equal to rounding: a shift a little off amplifies all of the cluster alike, what is found is taken out
            z = rng.standard_normal(t - s)
            for _ in range(4):
                z, _ = _orthogonal(matrix.solve(value * (1 + APART), z), [x for _, x in near])
        near.append((value, z))
        whole = np.zeros(len(a))
        whole[s:t] = z
        out.append(whole)
    return np.array(out).T.reshape(len(a), -1)


def principal(r: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(squared singular values, unit right singular vectors as columns) of a triangular r, the ``most`` largest above rounding."""
    d = r.shape[1]
    square = np.zeros((d, d))
    square[:min(len(r), d)] = r[:d]
    top = np.abs(square).max(initial=0.0)
    if top == 0:
        return np.zeros(0), np.zeros((d, 0))
    a, b, v = bidiagonal(square / top)
    values = dqds(a, b)
    values = values[values > values[0] * (8 * d * EPS) ** 2][:most]
    z = v @ directions(a, b, values, len(values))
    z *= np.where(z[np.abs(z).argmax(axis=0), np.arange(z.shape[1])] < 0, -1, 1)
    return values * top * top, z


# ---------------------------------------------------------------- over tables

@dataclass(frozen=True)
class Whitening:
    """Of one vector length: count and sums of the fit list, directions over sqrt(e), share of the variance."""

    n: int
    sums: np.ndarray
    axes: np.ndarray
    explained: np.ndarray

    def centred(self, x: np.ndarray) -> np.ndarray:
        """x - S/n, the whole part taken off first."""
        return (x - self.sums // self.n) - (self.sums % self.n) / self.n

    def deviation(self, x: np.ndarray) -> list:
        """Sum of (n*x - S)**2 for each row, exactly; None beyond 64 bits."""
        part, rest = x - self.sums // self.n, self.sums % self.n
        far = np.abs(part).max(axis=1, initial=0).astype(float) + 1
        if len(x) == 0 or x.shape[1] * (far.max() * self.n) ** 2 < 4e18:
            return ((self.n * part - rest) ** 2).sum(axis=1).tolist()
        found = [sum((self.n * p - r) ** 2 for p, r in zip(row, rest.tolist())) for row in part.tolist()]
        return [s if s < 1 << 63 else None for s in found]


def levels(df: DataFrame, vector: str, *keep: str) -> DataFrame:
    """``keep`` and x, the levels of the vectors that are not null and hold no null or non-finite entry."""
    v = F.transform(F.col(vector), lambda c: c.cast("double"))
    bad = F.exists(v, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == F.lit(float("inf"))))
    bounded = F.transform(v, lambda c: F.floor(F.greatest(F.least(c * SCALE, F.lit(LIMIT)), F.lit(-LIMIT))) + F.lit(OFFSET).cast("long"))
    return df.filter(F.col(vector).isNotNull() & ~bad).select(*keep, bounded.alias("x"))


def _by_length(column: pa.Array):
    """(rows, matrix) for every length of an Arrow list column; empty vectors have none."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    size = np.diff(np.asarray(column.offsets))
    for d in np.unique(size[size > 0]).tolist():
        at = np.flatnonzero(size == d)
        yield at, np.asarray(column.take(pa.array(at)).flatten(), np.int64).reshape(-1, d)


def _sums(fit: DataFrame) -> dict[int, tuple[int, np.ndarray]]:
    """By length: rows of the fit list and their exact sums; one small row a task and dimension."""
    def run(batches):
        n, sums = {}, {}
        for batch in batches:
            for at, x in _by_length(batch.column(0)):
                d = x.shape[1]
                n[d] = n.get(d, 0) + len(at)
                sums[d] = sums.get(d, 0) + x.sum(axis=0)
        for d in n:
            yield pa.RecordBatch.from_arrays([pa.array([n[d]] * d), pa.array([d] * d), pa.array(range(d)), pa.array(sums[d])],
                                             ["n", "d", "i", "s"])

    total = fit.mapInArrow(run, "n long, d long, i long, s long").groupBy("d", "i").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    out: dict = {}
    for r in total.collect():  # one number for each dimension of the vectors
        n, sums = out.setdefault(r["d"], (r["n"], np.zeros(r["d"], np.int64)))
        sums[r["i"]] = r["s"]
    return out


def _triangles(fit: DataFrame, centre: dict[int, Whitening]) -> dict[int, np.ndarray]:
    """By length: the triangular factor of all centred rows."""
    shared = fit.sparkSession.sparkContext.broadcast(centre)

    def run(batches):
        own: dict[int, np.ndarray] = {}
        for batch in batches:
            for _, x in _by_length(batch.column(0)):
                d = x.shape[1]
                for k in range(0, len(x), BLOCK):
                    rows = shared.value[d].centred(x[k:k + BLOCK])
                    own[d] = triangle(np.vstack([own[d], rows]) if d in own else rows)
        for d, r in own.items():
            yield pa.RecordBatch.from_arrays([pa.array([d]), pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([r.ravel().tolist()])],
                                             ["d", "id", "r"])

    def reduce(table: pa.Table) -> pa.Table:
        d = table.column("d")[0].as_py()
        both = triangle(np.vstack([np.array(r.as_py()).reshape(-1, d) for r in table.column("r")]))
        return pa.table({"d": table.column("d").slice(0, 1), "id": table.column("id").slice(0, 1), "r": [both.ravel().tolist()]})

    kind = "d long, id long, r array<double>"
    parts = stored(fit.mapInArrow(run, kind), "whitening-factors")
    while (parts.agg(F.max("id")).first()[0] or 0) > 0:
        step = parts.withColumn("id", F.floor(F.col("id") / FAN_IN))
        parts = stored(step.groupBy("d", "id").applyInArrow(reduce, kind), "whitening-factors")
    return {r["d"]: np.array(r["r"]).reshape(-1, r["d"]) for r in parts.collect()}


def fit_model(fit: DataFrame, components: int) -> dict[int, Whitening]:
    """The whitening of each vector length of ``fit`` (x: distinct level vectors)."""
    centre = {d: Whitening(n, s, np.zeros((d, 0)), np.zeros(0)) for d, (n, s) in _sums(fit).items()}
    model = {}
    for d, r in _triangles(fit, centre).items():
        values, z = principal(r, components)
        trace = float((r * r).sum())
        model[d] = Whitening(centre[d].n, centre[d].sums, z * np.sqrt(centre[d].n / values) if len(values) else z, values / trace if trace else values)
    return model


def identity_error(fit: DataFrame, model: dict[int, Whitening]) -> dict[int, float]:
    """By length: the largest absolute entry of (covariance of the whitened fit list - identity)."""
    shared = fit.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for _, x in _by_length(batch.column(0)):
                m = shared.value[x.shape[1]]
                w = np.hstack([m.centred(x) @ m.axes, np.ones((len(x), 1))])  # the last row and column: sums, count
                total[x.shape[1]] = total.get(x.shape[1], 0) + w.T @ w
        for d, g in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([d] * g.size), pa.array(range(g.size)), pa.array(g.ravel())], ["d", "i", "g"])

    rows = fit.mapInArrow(run, "d long, i long, g double").groupBy("d", "i").agg(F.sum("g").alias("g")).collect()
    out = {}
    for d, m in model.items():
        k = m.axes.shape[1]
        g = np.zeros((k + 1) ** 2)
        for r in rows:
            if r["d"] == d:
                g[r["i"]] = r["g"]
        g = g.reshape(k + 1, k + 1)
        mean = g[:k, k] / m.n
        out[d] = float(np.abs(g[:k, :k] / m.n - np.outer(mean, mean) - np.eye(k)).max(initial=0.0))
    return out


def whiten(df: DataFrame, key: str = "vec_id", vector: str = "embedding", components: int = 16) -> DataFrame:
    """(key, component, n, deviation, whitened, explained, identity_error) for each row and component."""
    fit = stored(levels(df, vector).distinct(), "whitening-fit")
    model = fit_model(fit, components)
    error = identity_error(fit, model)
    shared = df.sparkSession.sparkContext.broadcast((model, error))
    schema = T.StructType([T.StructField(key, df.schema[key].dataType), T.StructField("component", T.IntegerType()),
                           T.StructField("n", T.LongType()), T.StructField("deviation", T.LongType()),
                           *[T.StructField(c, T.DoubleType()) for c in ("whitened", "explained", "identity_error")]])

    def run(batches):
        model, error = shared.value
        for whole in batches:
            for low in range(0, whole.num_rows, BLOCK):
                batch = whole.slice(low, BLOCK)
                for at, x in _by_length(batch.column(1)):
                    m = model[x.shape[1]]
                    k, rows = m.axes.shape[1], len(at)
                    deviation = pa.array(m.deviation(x), pa.int64())
                    each = pa.array(np.repeat(np.arange(rows), k))
                    yield pa.RecordBatch.from_arrays([
                        batch.column(0).take(pa.array(at)).take(each),
                        pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), rows)),
                        pa.array(np.full(rows * k, m.n, np.int64)),
                        deviation.take(each),
                        pa.array((m.centred(x) @ m.axes).ravel()),
                        pa.array(np.tile(m.explained, rows)),
                        pa.array(np.full(rows * k, error[x.shape[1]])),
                    ], schema.names)

    return levels(df, vector, key).mapInArrow(run, schema)


def op12(spark, sf_dir: str) -> DataFrame:
    """op12: all vectors on the first 16 whitened components."""
    return whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))
