"""Whitening of embeddings by spectral divide and conquer.

The fit list is every distinct x vector once (x = floor(256 * c), see
`vectors`). Its number, sums and products are added up as whole numbers,
exactly, task by task, so the covariance (n * Q - S S') / n**2 is that of the
centred vectors, rounded once. It is d x d for d components, and only it comes
to the driver.

Its eigenvectors come from polar decompositions: for a symmetric A and a shift
s, the QDWH iteration gives the polar factor of A - s, which has the
eigenvectors of A and eigenvalues 1 above s and -1 below. (U + 1) / 2 projects
on the space above; an orthonormal basis of its range and one of the rest cut A
in two smaller matrices, which are cut in turn until they are single numbers or
multiples of the identity. The mean, the components and their scales are then
sent to all tasks, which hold d numbers for each.

A component whose eigenvalue is at most FLAT times the largest is left out: it
is rounding. So a table of fewer than two different vectors has no components
and gives no rows, as does an empty one. A deviation that a long can't hold is
null; `deviation_digits` is always exact. Repeated rows give repeated results
and count once in the fit; null ids are kept; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .vectors import EXACT, matrix, quantised

#: Eigenvalues up to this share of the largest are rounding.
FLAT = 1e-11
#: Sums travel as three limbs of this many bits.
LIMB = 48
EPS = float(np.finfo(float).eps)


def _products(x: np.ndarray) -> np.ndarray:
    """x' x of whole numbers, exact, as Python's integers."""
    most = max(1, int(max(x.max(), -int(x.min()))))
    step = EXACT // (most * most)
    if step < 1:
        big = x.astype(object)
        return big.T @ big
    total = np.zeros((x.shape[1],) * 2, object)
    for k in range(0, len(x), step):
        part = x[k : k + step].astype(float)
        total = total + (part.T @ part).astype(np.int64).astype(object)
    return total


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (i, j, limbs) of the number (-1, -1), the sums (-1, j) and the products (i, j), i <= j, of a task's vectors."""
    n, s, q = 0, 0, 0
    for batch in batches:
        if len(batch):
            x = matrix(batch.column("x"))
            n, s, q = n + len(x), s + x.astype(object).sum(axis=0), q + _products(x)
    if n:
        d = len(s)
        rows = [(-1, -1, n), *((-1, j, s[j]) for j in range(d)), *((i, j, q[i, j]) for i in range(d) for j in range(i, d))]
        mask = (1 << LIMB) - 1
        i, j, v = zip(*rows, strict=True)
        yield pa.RecordBatch.from_pydict({"i": pa.array(i, pa.int32()), "j": pa.array(j, pa.int32()), "a": pa.array([int(x) & mask for x in v], pa.int64()), "b": pa.array([(int(x) >> LIMB) & mask for x in v], pa.int64()), "c": pa.array([int(x) >> 2 * LIMB for x in v], pa.int64())})


@dataclass
class Moments:
    """Exact: number of vectors, sums, and products as a matrix of Python's integers."""

    n: int
    sums: list[int]
    products: np.ndarray

    @classmethod
    def of(cls, fit: DataFrame) -> Moments:
        """fit: x of each vector once. d * (d + 3) / 2 + 1 rows come to the driver."""
        parts = fit.mapInArrow(_sums, "i int, j int, a long, b long, c long")
        rows = parts.groupBy("i", "j").agg(*(F.sum(c).alias(c) for c in "abc")).collect()
        value = {(r.i, r.j): r.a + (r.b << LIMB) + (r.c << 2 * LIMB) for r in rows}
        n = value.get((-1, -1), 0)
        d = sum(i == -1 for i, _ in value) - 1 if n else 0
        q = np.empty((d, d), object)
        for (i, j), v in value.items():
            if i >= 0:
                q[i, j] = q[j, i] = v
        return cls(n, [value[-1, j] for j in range(d)], q)

    def covariance(self) -> np.ndarray:
        """Of the centred vectors, divisor n: each entry is rounded once."""
        d, n = len(self.sums), self.n
        return np.array([[(n * self.products[i, j] - self.sums[i] * self.sums[j]) / (n * n) for j in range(d)] for i in range(d)], float).reshape(d, d)


def polar(a: np.ndarray, steps: int = 60) -> np.ndarray:
    """Orthogonal polar factor of a symmetric matrix by the dynamically weighted Halley iteration."""
    d = len(a)
    x = a / np.linalg.norm(a)
    # a lower bound of the least singular value; one that is too high costs steps only
    low = min(max(EPS, 1 / max(np.linalg.norm(np.linalg.pinv(x)), 1.0)), 1 - EPS)
    for _ in range(steps):
        l2 = low * low
        h = np.cbrt(4 * (1 - l2) / (l2 * l2))
        root = np.sqrt(1 + h)
        wa = root + np.sqrt(max(0.0, 8 - 4 * h + 8 * (2 - l2) / (l2 * root))) / 2
        wb = (wa - 1) ** 2 / 4
        wc = wa + wb - 1
        if wc > 100:  # badly conditioned: by QR
            q, _ = np.linalg.qr(np.vstack([np.sqrt(wc) * x, np.eye(d)]))
            new = wb / wc * x + (wa - wb / wc) / np.sqrt(wc) * (q[:d] @ q[d:].T)
        else:
            new = wb / wc * x + (wa - wb / wc) * np.linalg.solve(np.eye(d) + wc * (x.T @ x), x.T).T
        new = (new + new.T) / 2
        low = min(low * (wa + wb * l2) / (1 + wc * l2), 1.0)
        moved, x = np.linalg.norm(new - x), new
        if moved <= d * EPS or (abs(low - 1) < 10 * EPS and moved <= EPS ** (1 / 3)):
            break
    return x


def _cut(a: np.ndarray, size: float, draw: np.random.Generator) -> tuple[np.ndarray, np.ndarray] | None:
    """Bases of two invariant subspaces of a, the one of the larger eigenvalues first; None where no shift tried divides it."""
    d = len(a)
    mean, spread = np.trace(a) / d, np.linalg.norm(a - np.trace(a) / d * np.eye(d)) / np.sqrt(d)
    best = None
    # the mean lies inside the spectrum; another shift is needed only where an eigenvalue sits on it
    for shift in (float(np.median(np.diag(a))), mean, *(mean + spread * u for u in draw.uniform(-1, 1, 60))):
        u = polar(a - shift * np.eye(d))
        projector = (u + np.eye(d)) / 2
        k = int(round(np.trace(projector)))
        if not 0 < k < d or np.linalg.norm(u @ u - np.eye(d)) > 1e-8 * d:
            continue
        q = np.linalg.qr(projector @ draw.standard_normal((d, k)))[0]
        q = np.linalg.qr(projector @ q, mode="complete")[0]
        off = np.linalg.norm(q[:, k:].T @ a @ q[:, :k])
        if best is None or off < best[0]:
            best = off, q[:, :k], q[:, k:]
        if off <= 8 * d * EPS * size:
            break
    return best and best[1:]


def spectrum(a: np.ndarray, size: float | None = None, draw: np.random.Generator | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors (columns) of a symmetric matrix."""
    d = len(a)
    size = np.linalg.norm(a) if size is None else size
    draw = draw or np.random.default_rng(0)
    if d == 0:
        return np.zeros(0), np.zeros((0, 0))
    level = np.trace(a) / d
    if d == 1 or np.linalg.norm(a - level * np.eye(d)) <= 4 * EPS * size:
        return np.diag(a).copy(), np.eye(d)
    parts = _cut(a, size, draw)
    if parts is None:
        raise ArithmeticError("no shift divides the spectrum")
    values, vectors = [], []
    for v in parts:
        inner = v.T @ a @ v
        w, z = spectrum((inner + inner.T) / 2, size, draw)
        values.append(w)
        vectors.append(v @ z)
    w, z = np.concatenate(values), np.hstack(vectors)
    order = np.argsort(-w, kind="stable")
    return w[order], z[:, order]


def polished(a: np.ndarray, w: np.ndarray, z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One step that makes the vectors orthonormal and diagonalising to the last digits; vectors of equal values are left as they are."""
    r, s = np.eye(len(a)) - z.T @ z, z.T @ a @ z
    value = np.diag(s) / (1 - np.diag(r))
    near = 2 * (np.linalg.norm(s - np.diag(value)) + np.linalg.norm(a) * np.linalg.norm(r))
    gap = value[None, :] - value[:, None]
    far = np.abs(gap) > near
    e = np.where(far, (s + value[None, :] * r) / np.where(far, gap, 1.0), r / 2)
    z = z + z @ e
    z = z / np.linalg.norm(z, axis=0)
    value = np.einsum("ij,ij->j", z, a @ z)
    order = np.argsort(-value, kind="stable")
    return value[order], z[:, order]


@dataclass
class Whitener:
    """n, sums of the fit list; values (falling) and components (columns) of its covariance; the identity error of what it whitens."""

    n: int
    sums: list[int]
    values: np.ndarray
    components: np.ndarray
    trace: float
    identity_error: float

    @classmethod
    def fit(cls, vectors: DataFrame, count: int = 4) -> Whitener:
        """vectors: x, any row as often as it likes."""
        moments = Moments.of(vectors.select("x").distinct())
        v = moments.covariance()
        w, z = spectrum(v)
        if len(w):
            w, z = polished(v, w, z)
        k = int(sum(w[:count] > FLAT * w[0])) if len(w) and w[0] > 0 else 0
        w, z = w[:k], z[:, :k]
        scaled = z / np.sqrt(w)
        error = float(np.abs(scaled.T @ v @ scaled - np.eye(k)).max()) if k else 0.0
        return cls(moments.n, moments.sums, w, z, float(np.trace(v)), error)

    def transform(self, rows: DataFrame, key: str = "vec_id") -> DataFrame:
        """One row for each row of (key, x) and component."""
        k, d = len(self.values), len(self.sums)
        n, sums, total = self.n, self.sums, sum(abs(x) for x in self.sums)
        mean = np.array([s / n for s in sums], float) if n else np.zeros(0)
        project, explained, error = self.components / np.sqrt(self.values), self.values / self.trace if k else self.values, self.identity_error
        kind = next((f.dataType.simpleString() for f in rows.schema.fields if f.name == key))
        schema = f"{key} {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double, deviation_digits string"

        def whiten(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                m = len(batch)
                if not m or not k:
                    continue
                x = matrix(batch.column("x"))
                small = (n * max(int(x.max()), -int(x.min())) + total) ** 2 * d < 1 << 63
                whole = x if small else x.astype(object)
                away = whole * n - np.array(sums, np.int64 if small else object)
                deviation = [int(v) for v in (away * away).sum(axis=1)]
                out = (x.astype(float) - mean) @ project
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(key).take(pa.array(np.repeat(np.arange(m), k))), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, n, np.int64)),
                        pa.array([v if v < 1 << 63 else None for v in deviation for _ in range(k)], pa.int64()), pa.array(out.reshape(-1)), pa.array(np.tile(explained, m)), pa.array(np.full(m * k, error)),
                        pa.array([str(v) for v in deviation for _ in range(k)], pa.string()),
                    ],
                    names=[key, "component", "n", "deviation", "whitened", "explained", "identity_error", "deviation_digits"],
                )

        return rows.select(key, "x").mapInArrow(whiten, schema)


def op11(embeddings: DataFrame) -> DataFrame:
    """One row per whole vector and component up to four."""
    rows = quantised(embeddings, "embedding", "vec_id")
    return Whitener.fit(rows).transform(rows)
