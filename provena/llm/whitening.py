"""Embedding whitening: spectral divide-and-conquer by QDWH polar decompositions, then broadcast whitening.

The covariance of the corpus is a ``d`` x ``d`` matrix, whatever the number of vectors: tasks add up centred
products, and only that matrix reaches the driver.  There a symmetric matrix is split at a shift: the polar
factor of ``A - shift`` (QDWH iterations, QR only) has +1 on the eigenvectors above the shift and -1 on those
below, so ``(U + I) / 2`` is a spectral projector.  Orthonormal bases of its range and of the complement give
two smaller matrices, which are split in turn until single components are left.  The components (``d`` x 32
numbers) travel to every task, which whitens its own vectors.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

EPS = float(np.finfo(np.float64).eps)
#: Entries become integers: floor(SCALE * c) + OFFSET.
SCALE, OFFSET = 64, 1_000_000
#: Beyond this an entry times SCALE isn't exact as a double, nor safe as a long.
LARGEST = 2.0**52


def polar_factor(a: np.ndarray, rounds: int = 30) -> np.ndarray:
    """Orthogonal polar factor of a symmetric matrix by QDWH (dynamically weighted Halley steps, each one QR)."""
    n, eye = len(a), np.eye(len(a))
    x = a / np.abs(a).sum(axis=0).max()  # the 1-norm bounds the largest singular value
    low = EPS  # a lower bound of the smallest one; grows to 1 in about six steps
    for _ in range(rounds):
        square = low * low
        d = np.cbrt(4 * (1 - square) / (square * square))
        weight = math.sqrt(1 + d) + math.sqrt(max(0.0, 8 - 4 * d + 8 * (2 - square) / (square * math.sqrt(1 + d)))) / 2
        b = (weight - 1) ** 2 / 4
        c = weight + b - 1
        q, _ = np.linalg.qr(np.vstack([math.sqrt(c) * x, eye]))
        step = (b / c) * x + (weight - b / c) / math.sqrt(c) * (q[:n] @ q[n:].T)
        step = (step + step.T) / 2
        moved, x = np.linalg.norm(step - x), step
        low = min(1.0, low * (weight + b * square) / (1 + c * square))
        if low > 1 - 4 * EPS and moved < 1e-10 * math.sqrt(n):
            break
    return x


def _shifts(m: np.ndarray, spread: float) -> list[float]:
    """Places to split at: the diagonal's median (an even split), its mean (always between the extremes), then near the
    mean, in case an eigenvalue sits on the shift."""
    diagonal = np.diag(m)
    mean = float(diagonal.mean())
    near = [mean + s * spread / math.sqrt(len(m)) for s in (0.1, -0.1, 0.03, -0.03, 0.3, -0.3, 0.01, -0.01)]
    return [float(np.median(diagonal)), mean, *near]


def spectrum(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors (columns) of a symmetric matrix by spectral divide-and-conquer."""
    size = len(a)
    a = (a + a.T) / 2
    whole = np.linalg.norm(a)
    found: list[np.ndarray] = []
    todo = [(a, np.eye(size))] if size else []
    random = np.random.default_rng(0)
    while todo:
        m, basis = todo.pop()
        k = len(m)
        spread = np.linalg.norm(m - np.eye(k) * np.trace(m) / k)
        if k == 1 or spread <= EPS * k * whole:
            found.append(basis)  # a multiple of the identity: any basis of this space does
            continue
        for shift in _shifts(m, spread):
            u = polar_factor(m - shift * np.eye(k))
            above = round((k + float(np.trace(u))) / 2)
            if 0 < above < k and np.linalg.norm(u @ u - np.eye(k)) < 1e-7 * k:
                break
        else:
            if spread > 1e3 * EPS * k * whole:
                raise ArithmeticError("no shift splits the covariance")
            found.append(basis)
            continue
        projector = (u + np.eye(k)) / 2
        g = random.standard_normal((k, k))
        q = np.hstack([projector @ g[:, :above], g[:, above:] - projector @ g[:, above:]])
        for _ in range(2):  # once more: the first bases may be badly conditioned
            q, _ = np.linalg.qr(q)
            q = np.hstack([projector @ q[:, :above], q[:, above:] - projector @ q[:, above:]])
        q, _ = np.linalg.qr(q)
        inner = q.T @ m @ q
        todo.append((inner[:above, :above], basis @ q[:, :above]))
        todo.append((inner[above:, above:], basis @ q[:, above:]))
    vectors = np.hstack(found) if found else np.zeros((0, 0))
    vectors, r = np.linalg.qr(vectors) if size else (vectors, vectors)
    vectors = vectors * np.sign(np.diag(r)) if size else vectors
    values = np.einsum("ij,ij->j", vectors, a @ vectors) if size else np.zeros(0)
    order = np.argsort(-values, kind="stable")
    return values[order], vectors[:, order]


def _vectors(batch: pa.RecordBatch, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the batch's usable rows, and their integer vectors."""
    column = batch.column("vector")
    lengths = pc.fill_null(pc.list_value_length(column), -1).to_numpy(zero_copy_only=False)
    rows = np.flatnonzero(lengths == size)
    flat = column.take(pa.array(rows)).flatten().cast(pa.float64())
    entries = np.array(flat.to_numpy(zero_copy_only=False), dtype=np.float64).reshape(len(rows), size)
    fine = np.isfinite(entries).all(axis=1)
    entries = np.floor(SCALE * entries[fine])
    if entries.size and np.abs(entries).max() >= LARGEST:
        raise OverflowError("an entry is too large for exact integers")
    return rows[fine], entries.astype(np.int64) + OFFSET


class Centre:
    """The mean as whole and broken part, so that ``x - mean`` loses no digits to the offset."""

    def __init__(self, n: int, sums: list[int]):
        self.n = n
        self.sums = np.array(sums, dtype=object)
        self.whole = np.array([round(s / n) for s in sums], dtype=np.int64)
        self.part = np.array([(s - n * int(w)) / n for s, w in zip(sums, self.whole)])

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (x - self.whole) - self.part

    def deviations(self, x: np.ndarray) -> list[int]:
        """Exact sums of ``(n * x - S) ** 2``: in longs if they fit, else in Python's integers."""
        if not len(x):
            return []
        most = int(np.abs(x - self.whole).max()) + 1
        if len(self.whole) * (self.n * most) ** 2 < 2**63:
            y = self.n * (x - self.whole) - np.array([int(s) - self.n * int(w) for s, w in zip(self.sums, self.whole)], dtype=np.int64)
            return np.einsum("ij,ij->i", y, y).tolist()
        return [sum(d * d for d in (self.n * row.astype(object) - self.sums).tolist()) for row in x]


def _products(vectors: DataFrame, size: int, transform) -> np.ndarray:
    """Sum over all rows of the outer products of ``transform(x)``, added up by tasks and then by cell."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            y = transform(_vectors(batch, size)[1])
            total = y.T @ y if total is None else total + y.T @ y
        if total is not None:
            i, j = np.triu_indices(len(total))
            yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(total[i, j])], names=["i", "j", "v"])

    cells = vectors.select("vector").mapInArrow(add, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).collect()
    side = 1 + max((c.j for c in cells), default=-1)
    out = np.zeros((side, side))
    for c in cells:
        out[c.i, c.j] = out[c.j, c.i] = c.v
    return out


def whiten(embeddings: DataFrame, *, components: int = 32, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``(id, component, n, deviation, whitened, explained, identity_error)``: a row per usable vector and component.

    Rows whose vector is null or holds a null or non-finite entry are left out; so are vectors of another length
    than the most frequent one (the longer one, if two are as frequent).  Entries become integers; the covariance
    has divisor ``n`` and is centred first.  Components come by falling eigenvalue and stop where the spectrum is
    zero to rounding (fewer vectors than dimensions, constant dimensions), as nothing can be scaled to one there;
    a single vector, or vectors that are all equal, therefore give no rows.  Repeated rows and ids count and are
    returned each; a null id is returned as null.  An empty table gives an empty result; other columns are not
    read.  An entry of 2**46 or more, or a ``deviation`` beyond a long, raises an error.

    Reads the vectors four times (sums, covariance, error, result) and keeps no copy.  Tasks hold one batch and one
    ``d`` x ``d`` matrix; the driver holds that matrix; tasks get ``d`` x ``components`` numbers.
    """
    spark = embeddings.sparkSession
    id_type = embeddings.select(id_col).schema[0].dataType
    schema = T.StructType([T.StructField(id_col, id_type), T.StructField("component", T.IntegerType()), T.StructField("n", T.LongType()),
                           T.StructField("deviation", T.LongType()), T.StructField("whitened", T.DoubleType()),
                           T.StructField("explained", T.DoubleType()), T.StructField("identity_error", T.DoubleType())])
    vectors = embeddings.select(F.col(id_col).alias("id"), F.col(vector_col).alias("vector"))
    lengths = (vectors.filter(F.col("vector").isNotNull()).groupBy(F.size("vector").alias("size")).agg(F.count("*").alias("rows"))
               .orderBy(F.desc("rows"), F.desc("size")).limit(1).collect())
    size = lengths[0].size if lengths else 0
    if not size:
        return spark.createDataFrame([], schema)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, np.zeros(size, np.int64)
        for batch in batches:
            _, x = _vectors(batch, size)
            n, total = n + len(x), total + x.sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size), pa.int32()), pa.array(total), pa.array([n] * size, pa.int64())],
                                         names=["j", "total", "n"])

    sums = (vectors.select("vector").mapInArrow(add, "j int, total long, n long")
            .groupBy("j").agg(F.sum("total").alias("total"), F.sum("n").alias("n")).orderBy("j").collect())
    if not sums or not sums[0].n:
        return spark.createDataFrame([], schema)
    centre = Centre(sums[0].n, [s.total for s in sums])
    covariance = _products(vectors, size, centre.centred) / centre.n
    values, axes = spectrum(covariance)
    k = min(components, int((values > size * EPS * max(values[0], 0.0)).sum()))
    if not k:
        return spark.createDataFrame([], schema)
    axes = axes[:, :k]
    axes = axes * np.sign(axes[np.abs(axes).argmax(axis=0), np.arange(k)])  # one sign for all runs
    scaled = axes / np.sqrt(values[:k])
    explained = values[:k] / np.trace(covariance)
    error = float(np.abs(_products(vectors, size, lambda x: centre.centred(x) @ scaled) / centre.n - np.eye(k)).max())
    arrow_id = pa.schema([pa.field("id", _arrow_type(id_type))]).field("id").type

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, x = _vectors(batch, size)
            m = len(rows)
            ids = batch.column("id").take(pa.array(np.repeat(rows, k)))
            yield pa.RecordBatch.from_arrays([
                ids.cast(arrow_id), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, centre.n, np.int64)),
                pa.array(centre.deviations(x), pa.int64()).take(pa.array(np.repeat(np.arange(m), k))),
                pa.array((centre.centred(x) @ scaled).ravel()), pa.array(np.tile(explained, m)), pa.array(np.full(m * k, error))],
                names=[f.name for f in schema])

    return vectors.mapInArrow(apply, schema)


def _arrow_type(kind: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type
    return to_arrow_type(kind)
