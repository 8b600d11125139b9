"""Whitening of embeddings by a QDWH spectral divide-and-conquer.

Vectors are put on an integer lattice. The distinct lattice vectors are the fit list; one
pass over it gives their number, sums and covariance, centred before multiplying and
merged from partition to partition. The covariance, whose size is the square of the
dimension whatever the number of rows, is split on the driver: the polar factor of the
covariance less a shift (dynamically weighted Halley iterations) is a spectral projector,
its range and its complement are invariant subspaces, and each is split again until it is
one component or a multiple of the identity. The components go to the tasks that whiten
every row, in their closures.

Defined results: vectors that are null or hold a null or a non-finite entry are dropped.
Of the others only those of the most frequent length (of equally frequent ones the
longest) can share a covariance; the rest is dropped too, as are empty vectors. Components
whose eigenvalue is zero to rounding cannot be whitened and are left out, so a table with
fewer than two distinct vectors gives no rows. Repeated rows and null ids give rows each.
A deviation beyond a long is null. Extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bookloom.llm.shared import drop_written, read, written
from bookloom.runtime import ship

SCALE, SHIFT = 64, 1_000_000
COMPONENTS = 16
EPS = float(np.finfo(np.float64).eps)
#: Partial moments are merged by so many tasks before the driver merges theirs.
MERGERS = 16
#: Entries of a block of rows that is held as doubles at once.
BLOCK_ENTRIES = 1 << 18
LONG_MAX = (1 << 63) - 1


# ------------------------------------------------------------------ polar factor and splitting

def polar(a: np.ndarray) -> np.ndarray:
    """Orthogonal polar factor of a symmetric matrix by dynamically weighted Halley
    iterations: by QR while the weights are large, by a solve of a definite system after."""
    n = len(a)
    eye = np.eye(n)
    x = a / max(np.sqrt(np.abs(a).sum(axis=0).max() * np.abs(a).sum(axis=1).max()), np.finfo(np.float64).tiny)
    low = EPS / 2  # a lower bound of the singular values; a small one costs an iteration or two
    for _ in range(30):
        square = low * low
        root = np.sqrt(1 + np.cbrt(4 * (1 - square) / square**2)) if low < 1 else 1.0
        wide = 8 - 4 * (root * root - 1) + 8 * (2 - square) / (square * root)
        wa = root + np.sqrt(max(wide, 0.0)) / 2
        wb = (wa - 1) ** 2 / 4
        wc = wa + wb - 1
        if wc > 100:
            q = np.linalg.qr(np.vstack([np.sqrt(wc) * x, eye]))[0]
            new = wb / wc * x + (wa - wb / wc) / np.sqrt(wc) * (q[:n] @ q[n:].T)
        else:
            new = wb / wc * x + (wa - wb / wc) * np.linalg.solve(eye + wc * (x.T @ x), x.T).T
        new = (new + new.T) / 2
        moved = np.linalg.norm(new - x)
        x, low = new, min(low * (wa + wb * square) / (1 + wc * square), 1.0)
        if moved <= np.cbrt(5 * EPS) * np.sqrt(n) and 1 - low <= 10 * EPS:
            break
    return x


def halves(a: np.ndarray, size: float) -> tuple[np.ndarray, np.ndarray] | None:
    """Orthonormal bases of two invariant subspaces of a, the one of the larger
    eigenvalues first. None if a is a multiple of the identity to rounding."""
    n, mean = len(a), np.trace(a) / len(a)
    if np.linalg.norm(a - mean * np.eye(n)) <= 4 * n * EPS * size:
        return None
    spread, best, least = np.linalg.norm(a - mean * np.eye(n)) / np.sqrt(n), None, np.inf
    random = np.random.default_rng(n)
    for shift in (np.median(np.diag(a)), mean, mean + spread / 3, mean - spread / 3, mean + spread / 17, mean - spread / 17):
        projector = (polar(a - shift * np.eye(n)) + np.eye(n)) / 2
        k = int(round(np.trace(projector)))
        if not 0 < k < n:
            continue
        q = np.linalg.qr(projector @ random.standard_normal((n, k)))[0]
        q = np.linalg.qr(projector @ q, mode="complete")[0]
        left = np.linalg.norm(q[:, k:].T @ a @ q[:, :k])
        if left < least:
            best, least = (q[:, :k], q[:, k:]), left
        if left <= 10 * n * EPS * size:
            break
    return best


def eigen(a: np.ndarray, most: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors (columns) of a symmetric matrix; the
    `most` largest. Subspaces that hold none of those are not split."""
    n = len(a)
    most, size = n if most is None else most, float(np.linalg.norm(a))
    values, vectors, open_ = [], [], [(a, np.eye(n))]
    while open_ and len(values) < most:
        block, basis = open_.pop()
        parts = halves(block, size) if len(block) > 1 else None
        if parts is None:
            values += [float(v) for v in np.diag(block)]
            vectors += list(basis.T)
            continue
        for part in reversed(parts):  # the larger eigenvalues come next
            small = part.T @ block @ part
            open_.append(((small + small.T) / 2, basis @ part))
    if not vectors:
        return np.zeros(0), np.zeros((n, 0))
    found = np.array(vectors).T
    # one step that takes out what rounding has left of each component in the others
    found = np.linalg.qr(found)[0]
    quotients = np.einsum("ij,ij->j", found, a @ found)
    for i in range(found.shape[1]):
        for j in range(i):
            gap = quotients[i] - quotients[j]
            if abs(gap) > 1e-6 * size:
                turn = (found[:, i] @ a @ found[:, j]) / gap
                found[:, i], found[:, j] = found[:, i] + turn * found[:, j], found[:, j] - turn * found[:, i]
    found /= np.linalg.norm(found, axis=0)
    quotients = np.einsum("ij,ij->j", found, a @ found)
    order = np.argsort(-quotients, kind="stable")[:most]
    return quotients[order], found[:, order]


# ------------------------------------------------------------------ moments over partitions

class Moments:
    """Number, sums and centred second moments of rows, merged without cancellation: the
    second moments of two parts are added about the mean of both."""

    def __init__(self, n: int, total: list, second: np.ndarray):
        self.n, self.total, self.second = n, total, second

    def merge(self, other: Moments) -> None:
        if not self.n or not other.n:
            if other.n:
                self.n, self.total, self.second = other.n, other.total, other.second
            return
        n = self.n + other.n
        # difference of the means, exact where the sums are integers
        apart = np.array([float(b * self.n - a * other.n) / float(self.n * other.n) for a, b in zip(self.total, other.total, strict=True)])
        self.second = self.second + other.second + np.outer(apart, apart) * (self.n / n * other.n)
        self.n, self.total = n, [a + b for a, b in zip(self.total, other.total, strict=True)]


def block_moments(x: np.ndarray, whole: bool) -> Moments:
    if whole:
        base = x[0]
        near = x - base
        sums = [int(v) for v in near.sum(axis=0)]
        total = [s + int(b) * len(x) for s, b in zip(sums, base, strict=True)]
        centred = near - np.array(sums) / len(x)
    else:
        total = list(x.sum(axis=0))
        centred = x - np.array(total) / len(x)
    return Moments(len(x), total, centred.T @ centred)


MOMENTS = "n long, total array<decimal(38,0)>, real array<double>, second array<double>"


def _row(m: Moments, whole: bool) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([
        pa.array([m.n], pa.int64()), pa.array([[Decimal(v) for v in m.total] if whole else []], pa.list_(pa.decimal128(38, 0))),
        pa.array([[] if whole else [float(v) for v in m.total]], pa.list_(pa.float64())), pa.array([m.second.ravel().tolist()], pa.list_(pa.float64()))],
        names=["n", "total", "real", "second"])


def _moments_of(batch: pa.RecordBatch, whole: bool):
    for r in batch.to_pylist():
        total = [int(v) for v in r["total"]] if whole else r["real"]
        yield Moments(r["n"], total, np.array(r["second"]).reshape(len(total), len(total)))


def matrix(column: pa.Array, kind) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(kind, copy=False)
    return flat.reshape(len(column), -1)


def blocks(batches, column: str):
    for batch in batches:
        if batch.num_rows:
            x = matrix(batch.column(column), np.int64)
            step = max(1, BLOCK_ENTRIES // x.shape[1])
            for i in range(0, len(x), step):
                yield batch.slice(i, step), x[i:i + step]


def moments(fit: DataFrame, through=None) -> Moments | None:
    """Moments of the column x of fit, or of through(x) where given. Every partition sends
    one row, MERGERS tasks merge those as a stream, the driver merges MERGERS rows."""
    whole = through is None

    def partial(batches):
        found = Moments(0, [], np.zeros(0))
        for _, x in blocks(batches, "x"):
            found.merge(block_moments(x if whole else through(x), whole))
        if found.n:
            yield _row(found, whole)

    def merged(batches):
        found = Moments(0, [], np.zeros(0))
        for batch in batches:
            for m in _moments_of(batch, whole):
                found.merge(m)
        if found.n:
            yield _row(found, whole)

    rows = fit.select("x").mapInArrow(partial, MOMENTS).repartition(MERGERS).mapInArrow(merged, MOMENTS)
    out = Moments(0, [], np.zeros(0))
    for batch in rows.toArrow().to_batches():
        for m in _moments_of(batch, whole):
            out.merge(m)
    return out if out.n else None


# ------------------------------------------------------------------ the operator

@dataclass
class Whitening:
    """What a fit has found. n and total: number and sums of the fit list; values:
    eigenvalues, falling; vectors: one column a component; trace: of the covariance."""

    n: int
    total: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float

    def __post_init__(self):
        self.base = np.array([s // self.n for s in self.total], np.int64)
        self.rest = [s - self.n * int(b) for s, b in zip(self.total, self.base, strict=True)]

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (x - self.base) - np.array([r / self.n for r in self.rest])

    def whiten(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) @ (self.vectors / np.sqrt(self.values))

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Exact sums over the dimensions of (n*x - S)^2; null beyond a long."""
        near, most = x - self.base, max(1, int(np.abs(x - self.base).max()))
        if (self.n * (most + 1)) ** 2 * x.shape[1] <= LONG_MAX:
            apart = self.n * near - np.array(self.rest, np.int64)
            return (apart * apart).sum(axis=1).tolist()
        found = (sum((self.n * v - r) ** 2 for v, r in zip(row, self.rest, strict=True)) for row in near.tolist())
        return [v if v <= LONG_MAX else None for v in found]


def lattice(vectors: DataFrame, key: str = "vec_id", column: str = "embedding", scale: int = SCALE, shift: int = SHIFT) -> DataFrame:
    """(key, x): the lattice vectors of the rows that can be used (see the module)."""
    rows = vectors.select(F.col(key).alias(key), F.col(column).cast("array<double>").alias("x"))
    rows = rows.where(F.size("x") > 0).where(F.expr("NOT exists(x, c -> c IS NULL OR isnan(c) OR abs(c) = double('Infinity'))"))
    lengths = rows.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
    if not lengths:
        return rows.where("false").select(key, F.col("x").cast("array<long>").alias("x"))
    return rows.where(F.size("x") == lengths[0]["d"]).select(key, F.transform("x", lambda c: F.floor(c * scale) + F.lit(shift)).alias("x"))


def fitted(fit: DataFrame, most: int = COMPONENTS) -> Whitening | None:
    """The whitening of a fit list, a table of distinct lattice vectors x."""
    found = moments(fit)
    if found is None:
        return None
    covariance = found.second / found.n
    values, vectors = eigen(covariance, most)
    fine = values > len(covariance) * EPS * 16 * max(float(values.max(initial=0)), 0.0)
    return Whitening(found.n, found.total, values[fine], vectors[:, fine], float(np.trace(covariance)))


def identity_error(fit: DataFrame, model: Whitening) -> float:
    """Largest absolute entry of the covariance of the whitened fit list less the identity."""
    found = moments(fit, model.whiten)
    return float(np.abs(found.second / found.n - np.eye(len(model.values))).max())


OUT = "component int, n long, deviation long, whitened double, explained double, identity_error double"


def whitened(vectors: DataFrame, key: str = "vec_id", column: str = "embedding", most: int = COMPONENTS, scale: int = SCALE, shift: int = SHIFT) -> DataFrame:
    """Every usable row of vectors on every component: key, component, n, deviation,
    whitened, explained, identity_error."""
    spark = vectors.sparkSession
    ship(spark)
    rows = lattice(vectors, key, column, scale, shift)
    fit = written(rows.select("x").distinct())
    model = fitted(fit, most)
    kind = rows.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, {OUT}"
    if model is None or not len(model.values):
        drop_written(fit)
        return spark.createDataFrame([], schema)
    error = identity_error(fit, model)
    drop_written(fit)
    k, explained = len(model.values), model.values / model.trace

    def project(batches):
        for batch, x in blocks(batches, "x"):
            n = len(x)
            repeated = np.repeat(np.arange(n), k)
            yield pa.RecordBatch.from_arrays([
                batch.column(key).take(pa.array(repeated)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), n)), pa.array(np.full(n * k, model.n)),
                pa.array(model.deviations(x), pa.int64()).take(pa.array(repeated)), pa.array(model.whiten(x).ravel()), pa.array(np.tile(explained, n)),
                pa.array(np.full(n * k, error))], names=[key, *(c.split()[0] for c in OUT.split(", "))])

    return rows.mapInArrow(project, schema)


def op11_qdwh_whitening(spark, sf_dir) -> DataFrame:
    return whitened(read(spark, sf_dir, "embeddings"))
