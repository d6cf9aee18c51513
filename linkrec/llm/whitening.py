"""Whitening of embeddings by Chebyshev-filtered subspace iteration.

Vectors become whole numbers, and their distinct values, the fit list, are stored as packed
blocks.  The covariance V is never formed.  A pass over the blocks gives V Q = Xᵀ(X Q) / n
for a thin matrix Q, with X centred in whole numbers before anything is multiplied:

1. A few Lanczos steps from a random start tell the range of the spectrum.
2. A Chebyshev polynomial of V, by its three-term recurrence, damps the part of the
   spectrum below the block's smallest Ritz value; what is left is made orthogonal (QR).
3. Rayleigh-Ritz in the block gives eigenvalues and vectors, and residuals |V q - e q|.
   Filter and projection repeat until the residuals certify every wanted pair.
4. One more pass measures the covariance of the whitened fit list against the identity.

The driver holds matrices of dims x block, and one partial result of that size per task or
group of tasks.  Partial sums of a pass are added up in order, so nothing depends on timing.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkrec.llm.common import named, ship_package
from linkrec.storage import stored

SCALE = 64
COMPONENTS = 16
BLOCK_BYTES = 4 << 20
FAN_IN = 256  # partial results that meet in one place
LANCZOS = 10
DEGREE = 16  # of the polynomial at most; also the passes of one iteration
GROWTH = 1e7  # what a polynomial may do to the first value beyond the last wanted one
ITERATIONS = 200
# Residuals, relative to the largest eigenvalue, that certify at once, and those that do
# once rounding keeps them from falling further.
SHARP = 1e-14
ENOUGH = 1e-11
# Directions with less than this share of the largest variance count as having none.
RANK = 1e-10


def usable_vectors(df: DataFrame, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(vec_id, x array<double>) of vectors without null or non-finite entries."""
    x = named(vector).cast("array<double>")
    limit = float("inf")
    fine = F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < limit))
    rows = df.select(named(vec_id).alias("vec_id"), x.alias("x"))
    return rows.where(F.col("x").isNotNull() & fine & (F.size("x") > 0))


def whole(x: pa.Array, dims: int, scale: int) -> np.ndarray:
    """floor(scale * entry) of a batch of vectors, as a matrix of longs."""
    flat = x.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)
    y = np.floor(scale * flat)
    if len(y) and np.abs(y).max() >= 2.0**62:
        raise ValueError("an entry is too large to become a long")
    return y.astype(np.int64)


def fit_list(rows: DataFrame, dims: int, scale: int) -> DataFrame:
    """The distinct whole vectors as a stored table of blocks (wide, v).

    A vector takes four bytes per entry where all of its entries fit, else eight.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            y = whole(b.column(0), dims, scale)
            narrow = np.abs(y).max(axis=1, initial=0) < 1 << 31
            out = [
                (row.astype("<i4") if small else row).tobytes()
                for row, small in zip(y, narrow.tolist(), strict=True)
            ]
            yield pa.record_batch([pa.array(out, pa.binary())], names=["v"])

    def block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bool, list[bytes]] = {False: [], True: []}
        size = {False: 0, True: 0}

        def full(wide: bool) -> pa.RecordBatch:
            both = [pa.array([wide]), pa.array([b"".join(held[wide])], pa.binary())]
            held[wide], size[wide] = [], 0
            return pa.record_batch(both, names=["wide", "v"])

        for b in batches:
            for v in b.column(0).to_pylist():
                wide = len(v) == 8 * dims
                held[wide].append(v)
                size[wide] += len(v)
                if size[wide] >= BLOCK_BYTES:
                    yield full(wide)
        for wide, vectors in held.items():
            if vectors:
                yield full(wide)

    # Copies of a vector are merged in each task before anything is sent.
    distinct = rows.select("x").mapInArrow(pack, "v binary").dropDuplicates(["v"])
    return stored(distinct.mapInArrow(block, "wide boolean, v binary"), "fit_list")


def _matrices(batches: Iterator[pa.RecordBatch], dims: int) -> Iterator[np.ndarray]:
    for b in batches:
        for wide, v in zip(b.column(0), b.column(1), strict=True):
            kind = "<i8" if wide.as_py() else "<i4"
            yield np.frombuffer(v.as_buffer(), kind).reshape(-1, dims).astype(np.int64)


def _sums(blocks: DataFrame, dims: int) -> tuple[int, list[int]]:
    """Number of vectors and the exact sum of each entry."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, high, low = 0, [0] * dims, [0] * dims
        for y in _matrices(batches, dims):
            n += len(y)
            # Halves, so that no sum of a block leaves the long range.
            high = [a + int(c) for a, c in zip(high, (y >> 31).sum(axis=0), strict=True)]
            low = [a + int(c) for a, c in zip(low, (y & 0x7FFFFFFF).sum(axis=0), strict=True)]
        if n:
            total = [Decimal((h << 31) + w) for h, w in zip(high, low, strict=True)]
            yield pa.record_batch(
                [
                    pa.array(range(dims), pa.int32()),
                    pa.array([n] * dims, pa.int64()),
                    pa.array(total, pa.decimal128(38, 0)),
                ],
                names=["dim", "n", "s"],
            )

    each = blocks.mapInArrow(run, "dim int, n long, s decimal(38,0)")
    rows = each.groupBy("dim").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).collect()
    rows.sort(key=lambda r: r["dim"])
    return (rows[0]["n"] if rows else 0), [int(r["s"]) for r in rows]


@dataclass
class Centre:
    """The mean of the fit list as S div n and S mod n, so that centring is exact."""

    n: int
    base: np.ndarray
    rest: np.ndarray

    @classmethod
    def of(cls, n: int, sums: list[int]) -> Centre:
        parts = [divmod(s, n) for s in sums]
        return cls(n, *(np.array(p, np.int64) for p in zip(*parts, strict=True)))

    def centred(self, y: np.ndarray) -> np.ndarray:
        return (y - self.base) - self.rest / self.n

    def deviations(self, y: np.ndarray) -> list[int]:
        """sum of (n y - S)^2 of each row, exact."""
        far = y - self.base
        reach = self.n * (int(np.abs(far).max(initial=0)) + 1)
        if reach * reach * y.shape[1] < 1 << 63:
            return ((self.n * far - self.rest) ** 2).sum(axis=1).tolist()
        exact = self.n * far.astype(object) - self.rest
        return (exact * exact).sum(axis=1).tolist()


class FitList:
    """Passes over the stored blocks."""

    def __init__(self, blocks: DataFrame, dims: int, centre: Centre):
        self.blocks, self.dims, self.centre = blocks, dims, centre
        self.passes = 0
        self.tasks = blocks.rdd.getNumPartitions()

    def _total(self, shape: tuple[int, ...], part: Callable[[np.ndarray], np.ndarray]):
        """The sum of ``part`` over the centred blocks."""
        dims, centre = self.dims, self.centre
        groups = -(-self.tasks // FAN_IN)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(shape)
            for y in _matrices(batches, dims):
                total += part(centre.centred(y))
            task = TaskContext.get().partitionId()
            yield told(task, task % groups, total)

        def told(task: int, group: int, total: np.ndarray) -> pa.RecordBatch:
            return pa.record_batch(
                [
                    pa.array([task], pa.int32()),
                    pa.array([group], pa.int32()),
                    pa.array([total.tobytes()], pa.binary()),
                ],
                names=["task", "part", "total"],
            )

        def add(table: pa.Table) -> pa.Table:
            rows = sorted(table.select(["task", "total"]).to_pylist(), key=lambda r: r["task"])
            total = sum(np.frombuffer(r["total"]).reshape(shape) for r in rows)
            task = rows[0]["task"]
            return pa.Table.from_batches([told(task, task % groups, total)])

        schema = "task int, part int, total binary"
        each = self.blocks.mapInArrow(run, schema)
        while groups > 1:
            here, groups = groups, -(-groups // FAN_IN)
            each = each.withColumn("part", F.col("task") % here).groupBy("part")
            each = each.applyInArrow(add, schema)
        rows = sorted(each.collect(), key=lambda r: r["task"])
        self.passes += 1
        return sum((np.frombuffer(r["total"]).reshape(shape) for r in rows), np.zeros(shape))

    def product(self, q: np.ndarray) -> np.ndarray:
        """V q, V being the covariance."""
        return self._total(q.shape, lambda c: c.T @ (c @ q)) / self.centre.n

    def trace(self) -> float:
        return float(self._total((self.dims,), lambda c: (c * c).sum(axis=0)).sum()) / self.centre.n

    def covariance(self, w: np.ndarray) -> np.ndarray:
        """The covariance of the fit list projected on ``w``."""
        k = w.shape[1]

        def part(c: np.ndarray) -> np.ndarray:
            z = c @ w
            return np.concatenate([z.T @ z, z.sum(axis=0)[None]])

        total = self._total((k + 1, k), part) / self.centre.n
        return total[:k] - np.outer(total[k], total[k])


def spectrum_range(fit: FitList, start: np.ndarray, steps: int) -> tuple[float, float]:
    """About the smallest and the largest eigenvalue, by Lanczos with full orthogonality."""
    q = start / np.linalg.norm(start)
    basis, diagonal, beside = [q], [], []
    for _ in range(steps):
        w = fit.product(basis[-1][:, None])[:, 0]
        diagonal.append(float(basis[-1] @ w))
        for _ in range(2):
            for b in basis:
                w = w - (b @ w) * b
        size = float(np.linalg.norm(w))
        beside.append(size)
        if size <= 1e-12 * max(abs(x) for x in diagonal):
            break
        basis.append(w / size)
    off = beside[: len(diagonal) - 1]
    values, vectors = np.linalg.eigh(np.diag(diagonal) + np.diag(off, 1) + np.diag(off, -1))
    slip = beside[len(diagonal) - 1] * np.abs(vectors[-1])
    return max(0.0, float(values[0] - slip[0])), float(values[-1] + slip[-1])


def degree(low: float, cut: float, top: float, last: float, worst: float) -> int:
    """Of the polynomial that damps [low, cut] against ``last`` as far as is of use.

    It must not raise ``top`` so far above ``last`` that rounding drowns the latter.
    """
    rate = lambda e: math.acosh(max(1.0, (2 * e - low - cut) / (cut - low)))
    enough = math.log(2 * worst / SHARP) / max(rate(last), 1e-3)
    apart = math.log(GROWTH) / max(rate(top) - rate(last), 1e-3)
    return max(1, min(DEGREE, math.ceil(enough), int(apart)))


def filtered(
    fit: FitList, q: np.ndarray, low: float, cut: float, top: float, steps: int
) -> np.ndarray:
    """The Chebyshev polynomial of V of this degree on ``q``: small on [low, cut], one at ``top``."""
    half, middle = (cut - low) / 2, (cut + low) / 2
    sigma = first = half / (top - middle)
    before, now = q, (fit.product(q) - middle * q) * (sigma / half)
    for _ in range(steps - 1):
        after = 1 / (2 / first - sigma)
        ahead = 2 * (fit.product(now) - middle * now) * (after / half) - sigma * after * before
        before, now, sigma = now, ahead, after
    return now


@dataclass
class Spectrum:
    """Leading eigenpairs, with what certifies them."""

    values: np.ndarray
    vectors: np.ndarray
    residuals: np.ndarray
    passes: int


def leading_pairs(fit: FitList, k: int, seed: int = 11) -> Spectrum:
    """The ``k`` largest eigenvalues and their unit vectors; largest entries are positive.

    Fewer are given where the variance has fewer directions.
    """
    dims = fit.dims
    k = min(k, dims)
    rng = np.random.default_rng(seed)
    q = np.linalg.qr(rng.standard_normal((dims, min(dims, 2 * k + 8))))[0]
    thin = q.shape[1] < dims
    low, top = spectrum_range(fit, rng.standard_normal(dims), min(dims, LANCZOS)) if thin else (0, 0)
    least = np.inf
    for _ in range(ITERATIONS):
        image = fit.product(q)
        inside = q.T @ image
        values, turn = np.linalg.eigh((inside + inside.T) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        q, image = q @ turn, image @ turn
        residuals = np.linalg.norm(image - q * values, axis=0)[:k]
        worst = float(residuals.max()) / max(float(values[0]), np.finfo(float).tiny)
        stuck = worst <= ENOUGH and worst > least / 2
        least = min(least, worst)
        if not thin or values[0] <= 0 or worst <= SHARP or stuck:
            break
        cut = float(values[-1])
        bottom = min(low, cut / 2)
        steps = degree(bottom, cut, float(values[0]), float(values[k - 1]), worst)
        high = max(top, float(values[0]))
        q = np.linalg.qr(filtered(fit, q, bottom, cut, high, steps))[0]
    else:
        raise RuntimeError(f"residual {worst} after {ITERATIONS} iterations")
    has = values[:k] > max(float(values[0]) * RANK, 0.0)
    vectors = q[:, :k][:, has]
    if vectors.size:
        sign = np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(vectors.shape[1])])
        vectors = vectors * sign
    return Spectrum(values[:k][has], vectors, residuals[has], fit.passes)


WHITENED = (
    "component int, n long, deviation decimal(38,0), whitened double, explained double, "
    "identity_error double"
)


def whiten(
    df: DataFrame,
    components: int = COMPONENTS,
    scale: int = SCALE,
    vec_id: str = "vec_id",
    vector: str = "embedding",
) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error).

    Each entry becomes floor(scale * entry).  (A constant added to all entries would change
    nothing, as centring is in whole numbers.)  ``n`` counts the distinct vectors x, S are
    their sums; ``deviation`` is the exact sum of (n x - S)^2, ``whitened`` the projection of
    x - S / n on an eigenvector of their covariance over the root of its eigenvalue e, and
    ``explained`` e over the trace.  Components are numbered from 1 by falling e, the sign
    makes the largest entry of each vector positive.

    Rows whose vector is null, empty or holds a null or non-finite entry are left out, and
    those of another number of entries than most rows have (of equally many, the smaller
    number).  There are as many components as the variance has directions, so equal vectors,
    or a single one, give no rows, nor does an empty table.  Repeated rows and null keys give
    rows each.  An entry that does not fit a long stops the job, and so does a deviation of
    more than 38 digits.
    """
    spark = df.sparkSession
    ship_package(spark)
    rows = usable_vectors(df, vec_id, vector)
    kind = rows.schema[0].dataType.simpleString()
    sizes = rows.groupBy(F.size("x").alias("dims")).agg(F.count("*").alias("n"))
    first = sizes.orderBy(F.desc("n"), "dims").first()
    if first is None:
        return spark.createDataFrame([], f"vec_id {kind}, {WHITENED}")
    dims = first["dims"]
    rows = rows.where(F.size("x") == dims)
    blocks = fit_list(rows, dims, scale)
    centre = Centre.of(*_sums(blocks, dims))
    fit = FitList(blocks, dims, centre)
    found = leading_pairs(fit, components)
    k = len(found.values)
    if not k:
        return spark.createDataFrame([], f"vec_id {kind}, {WHITENED}")
    explained = found.values / fit.trace()
    project = found.vectors / np.sqrt(found.values)
    error = float(np.abs(fit.covariance(project) - np.eye(k)).max())
    number = np.arange(1, k + 1, dtype=np.int32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            y = whole(b.column(1), dims, scale)
            times = np.repeat(np.arange(len(y)), k)
            exact = pa.array(list(map(Decimal, centre.deviations(y))), pa.decimal128(38, 0))
            size = len(times)
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0).take(pa.array(times)),
                    pa.array(np.tile(number, len(y))),
                    pa.array(np.full(size, centre.n)),
                    exact.take(pa.array(times)),
                    pa.array((centre.centred(y) @ project).ravel()),
                    pa.array(np.tile(explained, len(y))),
                    pa.array(np.full(size, error)),
                ],
                names=["vec_id", *(f.split()[0] for f in WHITENED.split(", "))],
            )

    return rows.mapInArrow(run, f"vec_id {kind}, {WHITENED}")
