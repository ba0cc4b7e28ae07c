"""Embedding whitening: pivoted Cholesky, then one-sided Jacobi on the factor.

Entries become whole numbers, floor(scale * c) + shift. The fit list has every
different vector once. Spark adds up its sums, then (centred first) its scatter;
a task holds one batch and one matrix of dimension times dimension, and only that
matrix reaches the driver. There the scatter is factored as L L' with the largest
remaining pivot first, which shows its rank, and the columns of L are rotated in
pairs until they are orthogonal. Their squared norms are the eigenvalues of the
scatter, the columns over their norms the components.

Rows whose vector is null or holds null or non-finite entries are left out, and so
are rows of another dimension than most rows have (the larger one of equally
common ones) and empty vectors. There are as many components as the scatter has
rank, at most the number asked for: a constant table has none and gives no rows,
and neither does an empty one. Rows without id and repeated rows are rows like
others. `deviation` is null where it does not fit 64 bits. Further columns are
left alone.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from activity_timeline.llm.common import in_tasks, stored

SCALE, SHIFT = 64, 1_000_000
FARTHEST = float(1 << 61)   # scaled entries beyond count as this
COMPONENTS = 16
LOW_BITS = 32
SWEEPS = 60


@dataclass(frozen=True)
class Whitening:
    """What has been learned: n and sums of the fit list, components as columns, eigenvalues."""
    n: int
    sums: list[int]
    components: np.ndarray
    eigenvalues: np.ndarray
    trace: float

    @property
    def scaled(self) -> np.ndarray:
        """Components over the roots of their eigenvalues."""
        return self.components / np.sqrt(self.eigenvalues)


def pivoted_cholesky(a: np.ndarray) -> np.ndarray:
    """Columns L with a = L L', as many as a has rank; rows in the order of a."""
    d = len(a)
    rest = np.diag(a).astype(float).copy()
    columns = np.zeros((d, d))
    tiny = d * np.finfo(float).eps * max(rest.max(initial=0.0), 0.0)
    for k in range(d):
        p = int(np.argmax(rest))
        if not rest[p] > tiny:
            return columns[:, :k]
        column = (a[:, p] - columns[:, :k] @ columns[p, :k]) / np.sqrt(rest[p])
        column[np.isneginf(rest)] = 0.0     # rows that were pivots before
        columns[:, k] = column
        rest = np.where(np.isneginf(rest), rest, np.maximum(rest - column ** 2, 0.0))
        rest[p] = -np.inf
    return columns


def _rounds(n: int):
    """Pairings of n columns in which every two meet once (n even)."""
    ring = list(range(n))
    for _ in range(n - 1):
        yield np.array(ring[:n // 2]), np.array(ring[:n // 2 - 1:-1])
        ring = [ring[0], ring[-1], *ring[1:-1]]


def one_sided_jacobi(columns: np.ndarray) -> np.ndarray:
    """The columns rotated in pairs until all are orthogonal to double precision."""
    d, r = columns.shape
    work = np.zeros((d, r + r % 2))
    work[:, :r] = columns
    if r < 2:
        return columns
    for _ in range(SWEEPS):
        turned = False
        for p, q in _rounds(work.shape[1]):
            x, y = work[:, p], work[:, q]
            xx, yy, xy = (x * x).sum(0), (y * y).sum(0), (x * y).sum(0)
            live = np.abs(xy) > 4 * np.finfo(float).eps * np.sqrt(xx * yy)
            if not live.any():
                continue
            turned = True
            zeta = np.where(live, (yy - xx) / np.where(live, 2 * xy, 1.0), 0.0)
            t = np.where(zeta < 0, -1.0, 1.0) / (np.abs(zeta) + np.hypot(1.0, zeta))
            cos = np.where(live, 1 / np.hypot(1.0, t), 1.0)
            sin = np.where(live, cos * t, 0.0)
            work[:, p], work[:, q] = cos * x - sin * y, sin * x + cos * y
        if not turned:
            break
    norms = np.linalg.norm(work, axis=0)
    return work[:, np.argsort(-norms, kind="stable")][:, :r]


def eigen(scatter: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors as columns, of a scatter matrix."""
    turned = one_sided_jacobi(pivoted_cholesky(scatter))
    norms = np.linalg.norm(turned, axis=0)
    kept = norms > 0
    return norms[kept] ** 2, turned[:, kept] / norms[kept]


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), d)


def usable(rows: DataFrame, vector: str = "embedding") -> DataFrame:
    """The rows with a whole vector, and `x`, its entries as whole numbers."""
    entries = F.col(vector)
    bad = F.exists(entries, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))

    def whole(c):
        scaled = c.cast("double") * SCALE
        return F.floor(F.greatest(F.lit(-FARTHEST), F.least(F.lit(FARTHEST), scaled))) + SHIFT

    return rows.where(entries.isNotNull() & (F.size(entries) > 0) & ~bad).withColumn(
        "x", F.transform(entries, whole))


def _sums(d: int):
    def run(batches):
        n, high, low = 0, np.zeros(d, np.int64), np.zeros(d, np.int64)
        for batch in batches:
            x = _matrix(batch.column("x"), d)
            n += len(x)
            high += (x >> LOW_BITS).sum(axis=0)
            low += (x & ((1 << LOW_BITS) - 1)).sum(axis=0)
        yield pa.record_batch([pa.array(np.arange(d, dtype=np.int32)),
                               pa.array(np.full(d, n, np.int64)), pa.array(high), pa.array(low)],
                              names=["at", "n", "high", "low"])
    return run


def centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n * x - sums: exact, as 64-bit numbers if they fit, else as Python's."""
    top = max(abs(int(x.max(initial=0))), abs(int(x.min(initial=0))))
    if top * n + max(abs(s) for s in sums) < 1 << 62:
        return x * np.int64(n) - np.array(sums, np.int64)
    return x.astype(object) * n - np.array(sums, object)


def _products(d: int, n: int, sums: list[int], by: np.ndarray):
    """Sums of products of the centred vectors times `by`, and sums of these themselves."""
    width = by.shape[1]

    def run(batches):
        total, products = np.zeros(width), np.zeros((width, width))
        for batch in batches:
            y = centred(_matrix(batch.column("x"), d), n, sums).astype(float) / n @ by
            total += y.sum(axis=0)
            products += y.T @ y
        i, j = np.indices((width, width)).reshape(2, -1)
        yield pa.record_batch(
            [pa.array(np.append(i, np.full(width, -1)).astype(np.int32)),
             pa.array(np.append(j, np.arange(width)).astype(np.int32)),
             pa.array(np.append(products.ravel(), total))], names=["i", "j", "value"])
    return run


def _added(fit: DataFrame, d: int, n: int, sums: list[int], by: np.ndarray):
    """Products and sums over the fit list."""
    parts = in_tasks(fit, _products(d, n, sums, by), "i int, j int, value double")
    width = by.shape[1]
    out = np.zeros((width + 1, width))
    for i, j, value in parts.groupBy("i", "j").agg(F.sum("value")).collect():
        out[i, j] = value
    return out[:width], out[width]


def learn(fit: DataFrame, d: int, components: int = COMPONENTS) -> Whitening | None:
    """Whitening of the fit list (x: different vectors of d whole numbers); None without rows."""
    rows = (in_tasks(fit, _sums(d), "at int, n bigint, high bigint, low bigint")
            .groupBy("at").agg(*[F.sum(F.col(c).cast("decimal(38,0)")).alias(c)
                                 for c in ("n", "high", "low")]).orderBy("at").collect())
    if not rows or not rows[0]["n"]:
        return None
    n = int(rows[0]["n"])
    sums = [(int(r["high"]) << LOW_BITS) + int(r["low"]) for r in rows]
    scatter, _ = _added(fit, d, n, sums, np.eye(d))
    values, vectors = eigen(scatter)
    return Whitening(n, sums, vectors[:, :components], values[:components] / n,
                     float(np.trace(scatter)) / n)


def identity_error(fit: DataFrame, d: int, learned: Whitening) -> float:
    """Largest entry of the whitened fit list's covariance less the identity."""
    products, total = _added(fit, d, learned.n, learned.sums, learned.scaled)
    mean = total / learned.n
    covariance = products / learned.n - np.outer(mean, mean)
    return float(np.abs(covariance - np.eye(len(mean))).max())


def _deviation(y: np.ndarray) -> list[int | None]:
    """Exact sums of squares; None beyond 64 bits."""
    if y.dtype != object and float(np.abs(y.astype(float)).max(initial=0.0)) ** 2 * y.shape[1] < 2**62:
        return (y * y).sum(axis=1).tolist()
    exact = ((y.astype(object)) ** 2).sum(axis=1).tolist()
    return [v if v < 1 << 63 else None for v in exact]


def _whitened(d: int, learned: Whitening, error: float):
    by, k = learned.scaled, len(learned.eigenvalues)
    explained = learned.eigenvalues / learned.trace

    def run(batches):
        for batch in batches:
            y = centred(_matrix(batch.column("x"), d), learned.n, learned.sums)
            white = y.astype(float) / learned.n @ by
            rows = len(y)
            whole = pa.array(np.repeat(np.arange(rows), k))
            yield pa.record_batch(
                [batch.column("vec_id").take(whole),
                 pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), rows)),
                 pa.array(np.full(rows * k, learned.n, np.int64)),
                 pa.array(_deviation(y), pa.int64()).take(whole), pa.array(white.ravel()),
                 pa.array(np.tile(explained, rows)), pa.array(np.full(rows * k, error))],
                names=["vec_id", "component", "n", "deviation", "whitened", "explained",
                       "identity_error"])
    return run


WHITENED = ("vec_id bigint, component int, n bigint, deviation bigint, whitened double,"
            " explained double, identity_error double")


def whiten(rows: DataFrame, components: int = COMPONENTS, vector: str = "embedding") -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error: a row for each
    usable row and component."""
    spark = rows.sparkSession
    good = usable(rows.select("vec_id", F.col(vector).alias("embedding")))
    sizes = good.groupBy(F.size("x").alias("d")).count()
    most = sizes.agg(F.max(F.struct("count", "d"))["d"]).first()[0]
    if most is None:
        return spark.createDataFrame([], WHITENED)
    good = good.where(F.size("x") == most)
    # equal vectors meet in the task that reads them, then once more
    fit = stored(good.groupBy("x").agg(F.count("*").alias("rows")).select("x"), "fit-list")
    learned = learn(fit, most, components)
    if learned is None or not len(learned.eigenvalues):
        return spark.createDataFrame([], WHITENED)
    error = identity_error(fit, most, learned)
    return in_tasks(good.select("vec_id", "x"), _whitened(most, learned, error), WHITENED)
