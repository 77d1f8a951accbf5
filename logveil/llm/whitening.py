"""Whitening of embeddings by a block Jacobi-Davidson eigensolver.

Entries become whole numbers x = floor(1024 * c) + 100000.  The covariance V of x is
never formed: a product V P for a block of directions P is one Spark job, in which
each task centres its rows, (n * x - S) / n with an exact numerator, multiplies twice
and returns one sum of d by k numbers.  Sums of many tasks are added in a tree.

The solver keeps a subspace of at most `SUBSPACE` blocks with its products.  Each round:

1. Rayleigh-Ritz: eigenpairs of V within the subspace.  Leading pairs whose residual
   has reached rounding error are locked and taken out of the subspace.
2. The others get their correction equation
   (I - QQ')(V - theta I)(I - QQ') t = -r, with Q all locked and current vectors, by
   `INNER` steps of MINRES; all equations share the product of a step.
3. The corrections, made orthogonal, extend the subspace with one more product.

It ends when all wanted residuals are at rounding error and nothing left in the
subspace has a larger eigenvalue.  On the driver stand d by (SUBSPACE * k) numbers.

Defined results: rows whose vector is null or holds null, NaN or infinite entries are
left out, and so are rows whose length is not the commonest one and entries beyond
`LARGEST`; a row with a null id is a row like all others, and repeated rows count as
often as they stand there; there are as many components as dimensions, `components`
at most; a direction without variance has a null `whitened` (there is no scale) and
explains 0; `deviation` is exact, and null where it does not fit a long; no usable
row gives an empty table.  Tied eigenvalues have any orthonormal vectors of their
space, the same for all rows.  Other columns are carried, and give way where they
clash with new ones.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logveil.llm.arrowcols import fresh_name
from logveil.llm.bpe import with_columns
from logveil.llm.exchange import cut, small_batches
from logveil.llm.vectors import common_length, matrix, usable

COMPONENTS = 8
SCALE, SHIFT = 1024, 100_000
#: Entries (after scaling) beyond this are no embedding; n of them still fit a long for 2^31 rows.
LARGEST = 1 << 31
#: Blocks in the subspace before it is restarted, and those that are kept then.
SUBSPACE, KEPT = 5, 2
#: MINRES steps for a correction.
INNER = 4
ROUNDS = 300
#: A residual of so many rounding errors of the largest eigenvalue is at double precision.
TOLERANCE = 256 * np.finfo(float).eps
#: Partial sums that come to the driver at once; more are added in Spark first.
FAN_IN = 256


class Spectrum(NamedTuple):
    """Eigenvalues falling, unit eigenvectors in columns, the centre as n and S, the trace, and the largest residual."""

    values: np.ndarray
    vectors: np.ndarray
    n: int
    sums: np.ndarray
    trace: float
    residual: float


def summed(rows: DataFrame, tasks: int, partial: Callable[[pa.RecordBatch], np.ndarray], shape: tuple[int, ...], kind=np.float64) -> np.ndarray:
    """The sum of partial(batch) over a table of so many tasks: one array a task, added in a tree."""
    kind = np.dtype(kind)

    def within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape, kind)
        for batch in batches:
            if batch.num_rows:
                total += partial(batch)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["part"])

    def together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape, kind)
        for batch in batches:
            for part in batch.column(0).to_pylist():
                total += np.frombuffer(part, kind).reshape(shape)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["part"])

    parts = rows.mapInArrow(within, "part binary")
    while tasks > FAN_IN:
        tasks = -(-tasks // FAN_IN)
        parts = parts.repartition(tasks).mapInArrow(together, "part binary")
    return sum((np.frombuffer(r["part"], kind).reshape(shape) for r in parts.collect()), np.zeros(shape, kind))


def _minres(product: Callable[[np.ndarray], np.ndarray], b: np.ndarray, steps: int) -> np.ndarray:
    """Solutions of symmetric equations, a column each; all columns share product(P)."""
    k = b.shape[1]
    norm = lambda a: np.sqrt(np.einsum("ij,ij->j", a, a))
    over = lambda a, c: np.divide(a, c, out=np.zeros_like(a), where=np.broadcast_to(c, a.shape) != 0)
    x, beta = np.zeros_like(b), norm(b)
    v_before, v = np.zeros_like(b), over(b, beta)
    d_before, d = np.zeros_like(b), np.zeros_like(b)
    cos, sin, cos_before, sin_before = np.ones(k), np.zeros(k), np.ones(k), np.zeros(k)
    rest, start = beta.copy(), beta.copy()
    beta = np.zeros(k)
    for _ in range(steps):
        # Lanczos: one more row of the tridiagonal matrix
        w = product(v) - beta * v_before
        alpha = np.einsum("ij,ij->j", v, w)
        w -= alpha * v
        after = norm(w)
        after = np.where(after > 1e-14 * start, after, 0.0)
        # the two rotations before this row, then its own
        far, near = sin_before * beta, cos_before * beta
        mid = cos * near + sin * alpha
        own = cos * alpha - sin * near
        length = np.hypot(own, after)
        cos_before, sin_before = cos, sin
        cos, sin = np.where(length > 0, over(own, length), 1.0), over(after, length)
        step = over(v - mid * d - far * d_before, length)
        x += cos * rest * step
        rest = -sin * rest
        d_before, d, v_before, v, beta = d, step, v, over(w, after), after
        if (np.abs(rest) <= 1e-3 * start).all():
            break
    return x


def _orthonormal(block: np.ndarray, *against: np.ndarray) -> np.ndarray:
    """An orthonormal basis of what a block adds to orthonormal columns."""
    for _ in range(3):
        for basis in against:
            block = block - basis @ (basis.T @ block)
        size = np.sqrt(np.einsum("ij,ij->j", block, block))
        block = block[:, size > 1e-12] / size[size > 1e-12]
        if block.shape[1]:
            q, r = np.linalg.qr(block)
            block = q[:, np.abs(np.diag(r)) > 1e-10]
    return block


def jacobi_davidson(product: Callable[[np.ndarray], np.ndarray], d: int, wanted: int, seed: int = 7) -> tuple[np.ndarray, np.ndarray, float]:
    """The largest eigenpairs of a symmetric matrix that is known by its products with blocks of columns.

    Returns values (falling), vectors and the largest residual.  Raises ArithmeticError if they do not converge.
    """
    rng = np.random.default_rng(seed)
    locked, values, worst = np.zeros((d, 0)), np.zeros(0), 0.0
    basis = _orthonormal(rng.standard_normal((d, min(d, wanted + 2))))
    images = product(basis)
    scale = 0.0
    for _ in range(ROUNDS):
        projected = basis.T @ images
        theta, s = np.linalg.eigh((projected + projected.T) / 2)
        theta, s = theta[::-1], s[:, ::-1]
        scale = max([scale, *np.abs(theta[:1]), *values[:1]])
        missing = min(wanted - len(values), len(theta))
        basis, images = basis @ s, images @ s
        residual = images[:, :missing] - theta[:missing] * basis[:, :missing]
        residual -= locked @ (locked.T @ residual)
        size = np.sqrt(np.einsum("ij,ij->j", residual, residual))
        good = size <= TOLERANCE * scale
        n_good = missing if good.all() else int(np.argmin(good))
        if n_good:
            worst = max(worst, float(size[:n_good].max()))
            locked, values = np.hstack([locked, basis[:, :n_good]]), np.append(values, theta[:n_good])
            basis, images, theta, residual = basis[:, n_good:], images[:, n_good:], theta[n_good:], residual[:, n_good:]
        if len(values) == wanted:
            larger = theta[:1] > values.min() + TOLERANCE * scale
            if not larger.any():
                order = np.argsort(-values, kind="stable")
                return values[order], locked[:, order], worst
            # a larger one turned up late: the smallest gives its place back
            back = int(np.argmin(values))
            image = product(locked[:, [back]])
            basis, images = np.hstack([basis, locked[:, [back]]]), np.hstack([images, image])
            locked, values = np.delete(locked, back, 1), np.delete(values, back)
            continue
        if residual.shape[1]:
            fixed = np.hstack([locked, basis[:, : residual.shape[1]]])
            project = lambda p, q=fixed: p - q @ (q.T @ p)
            shift = theta[: residual.shape[1]]
            apply = lambda p, s=shift, f=project: f(product(f(p)) - s * f(p))
            block = _minres(apply, project(-residual), INNER)
        else:
            block = rng.standard_normal((d, min(wanted, d)))
        if basis.shape[1] + block.shape[1] > SUBSPACE * wanted:
            basis, images = basis[:, : KEPT * wanted], images[:, : KEPT * wanted]
        block = _orthonormal(block, locked, basis)
        if not block.shape[1]:
            block = _orthonormal(rng.standard_normal((d, min(wanted, d))), locked, basis)
        if block.shape[1]:
            basis, images = np.hstack([basis, block]), np.hstack([images, product(block)])
    raise ArithmeticError("the eigenvectors did not converge")


def fit(whole: DataFrame, vector: str, d: int, components: int) -> Spectrum:
    """Centre and leading eigenpairs of the covariance of a column of whole-number vectors, all of length d."""
    tasks = whole.rdd.getNumPartitions()
    stats = summed(whole, tasks, lambda b: np.append((x := matrix(b.column(vector), d)).sum(axis=0), len(x)), (d + 1,), np.int64)
    n, sums = int(stats[-1]), stats[:-1]

    def centred(batch: pa.RecordBatch) -> np.ndarray:
        return (matrix(batch.column(vector), d) * n - sums).astype(np.float64) / n

    def product(block: np.ndarray) -> np.ndarray:
        def partial(batch: pa.RecordBatch) -> np.ndarray:
            rows = centred(batch)
            return rows.T @ (rows @ block)

        return summed(whole, tasks, partial, block.shape) / n

    trace = float(summed(whole, tasks, lambda b: np.square(centred(b)).sum(), ())) / n
    if trace == 0:
        return Spectrum(np.zeros(min(components, d)), np.eye(d)[:, : min(components, d)], n, sums, 0.0, 0.0)
    return Spectrum(*(found := jacobi_davidson(product, d, min(components, d)))[:2], n, sums, trace, found[2])


def whiten(df: DataFrame, vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """Adds component, n, deviation, whitened, explained and identity_error: a row for each vector and component."""
    spark = df.sparkSession
    small_batches(spark)
    x = fresh_name(df.columns, "x")
    added = {"component": "int", "n": "long", "deviation": "long", "whitened": "double", "explained": "double", "identity_error": "double"}
    kept = [c for c in df.columns if c not in added]
    scaled = F.transform(F.col(vector).cast("array<double>"), lambda c: F.floor(c * SCALE) + SHIFT)
    inside = ~F.exists(F.col(vector).cast("array<double>"), lambda c: F.abs(c * SCALE) >= LARGEST)
    fitting = df.where(usable(vector) & inside)
    d = common_length(fitting, vector)
    whole = cut(fitting.where(F.size(vector) == d).select(*(F.col(f"`{c}`") for c in kept), scaled.alias(x)))
    schema = with_columns(df.select(*(F.col(f"`{c}`") for c in kept)), added)
    if d == 0 or whole.isEmpty():
        return spark.createDataFrame([], schema)
    found = fit(whole.select(x), x, d, components)
    n, sums, k = found.n, found.sums, len(found.values)
    present = found.values > TOLERANCE * max(found.trace, 0.0)
    directions = found.vectors / np.sqrt(np.where(present, found.values, 1.0))

    def project(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        shifted = matrix(batch.column(x), d) * n - sums
        return shifted, (shifted.astype(np.float64) / n) @ directions

    tasks = whole.rdd.getNumPartitions()
    mean = summed(whole.select(x), tasks, lambda b: project(b)[1].sum(axis=0), (k,)) / n
    covariance = summed(whole.select(x), tasks, lambda b: (w := project(b)[1] - mean).T @ w, (k, k)) / n
    real = np.ix_(present, present)
    error = float(np.abs(covariance[real] - np.eye(int(present.sum()))).max(initial=0.0))
    explained = np.where(present, found.values, 0.0) / (found.trace or 1.0)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m = batch.num_rows
            shifted, white = project(batch)
            exact = np.square(shifted).sum(axis=1)
            fits = np.square(shifted.astype(np.float64)).sum(axis=1) < 9.2e18
            at = pa.array(np.repeat(np.arange(m), k))
            columns = [batch.column(c).take(at) for c in kept]
            columns += [
                pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                pa.array(np.full(m * k, n, np.int64)),
                pa.array(np.repeat(exact, k), mask=~np.repeat(fits, k)),
                pa.array(white.ravel(), mask=~np.tile(present, m)),
                pa.array(np.tile(explained, m)),
                pa.array(np.full(m * k, error)),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=[*kept, *added])

    return whole.mapInArrow(rows, schema)
