"""Whitening of embeddings by contour integration (FEAST).

Spark sums the vectors exactly and adds up the centred products of partitions; the covariance of the dimensions, which does not grow with the
rows, is what the eigenvalue search works on. Inertia counts place intervals that hold the wanted eigenvalues; every interval is a task that
projects onto its eigenvectors with complex shifted solves along a circle, extracts them by Rayleigh-Ritz, and repeats until they are exact.
Inertia counts at both ends verify that none is missed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from poremetry.llm.common import map_texts
from poremetry.workspace import materialize

COMPONENTS = 16
SCALE, SHIFT = 64, 1_000_000
NODES = 8  # quadrature points on the upper half circle
ROUNDS = 40
PER_INTERVAL = 12  # eigenvalues an interval should hold at most
BLOCK_ROWS = 4096
LARGEST = 2.0 ** 62  # entries beyond are held at this value


def tridiagonal(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Diagonal and off-diagonal of a tridiagonal matrix with the same eigenvalues, by reflections."""
    a = np.array(matrix, float)
    for k in range(len(a) - 2):
        v = a[k + 1:, k].copy()
        norm = np.sqrt(v @ v)
        if norm == 0:
            continue
        v[0] += norm if v[0] >= 0 else -norm
        v /= np.sqrt(v @ v)
        block = a[k + 1:, k:]
        block -= 2 * np.outer(v, v @ block)
        block = a[k:, k + 1:]
        block -= 2 * np.outer(block @ v, v)
    return np.diag(a).copy(), np.diag(a, 1).copy()


def inertia_above(form: tuple[np.ndarray, np.ndarray], shifts: np.ndarray) -> np.ndarray:
    """Eigenvalues above every shift: the positive pivots of the shifted elimination (Sylvester's law)."""
    diagonal, off = form
    least = np.finfo(float).tiny * max(1.0, float((off ** 2).max(initial=0.0))) / np.finfo(float).eps
    above = np.zeros(len(shifts), np.int64)
    pivot = np.ones(len(shifts))
    for k in range(len(diagonal)):
        pivot = diagonal[k] - shifts - (off[k - 1] ** 2 / pivot if k else 0.0)
        pivot[np.abs(pivot) < least] = -least
        above += pivot > 0
    return above


def intervals(matrix: np.ndarray, wanted: int) -> list[tuple[float, float, int]]:
    """(low, high, number of eigenvalues) of disjoint intervals that hold at least the ``wanted`` largest eigenvalues.

    Bisection on inertia counts finds where eigenvalues are, and ends are put into gaps that are wide beside the interval, so that
    the projector can tell inside from outside. A cluster too tight to split shares one interval, however many it holds.
    """
    form, d = tridiagonal(matrix), len(matrix)
    radius = np.abs(matrix).sum(axis=1).max() + 1e-300
    low, high, rank = np.full(d, -radius), np.full(d, radius), np.arange(1, d + 1)
    for _ in range(50):
        middle = (low + high) / 2
        inside = inertia_above(form, middle) >= rank
        low, high = np.where(inside, middle, low), np.where(inside, high, middle)
    near = (low + high) / 2
    gaps = near - np.append(near[1:], near[-1] - radius)
    out, first, top = [], 0, near[0] + max(0.05 * abs(near[0]), 1e-3 * radius)
    while first < wanted:
        width = near[first] - near + gaps
        wide = np.flatnonzero((gaps >= 0.05 * width) & (gaps > 1e-9 * radius))
        wide = wide[wide >= first]
        few = wide[wide < first + PER_INTERVAL]
        last = int(few[-1] if len(few) else wide[0])
        if first + PER_INTERVAL > wanted and (enough := few[few >= wanted - 1]).size:
            last = int(enough[0])
        bottom = near[last] - min(gaps[last] / 2, max(0.5 * abs(near[last]), 1e-3 * radius))
        out.append((float(bottom), float(top), last + 1 - first))
        first, top = last + 1, near[last] - gaps[last] / 2
    return out


def feast(matrix: np.ndarray, low: float, high: float, count: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``count`` eigenvalues between ``low`` and ``high``, largest first, and their unit vectors as columns.

    Each round applies the spectral projector, a Gauss-Legendre sum of (z - matrix)^-1 over the circle through both ends, and
    takes the Ritz vectors inside. Rounds end when residuals reach rounding or stop falling.
    """
    d = len(matrix)
    middle, radius = (low + high) / 2, (high - low) / 2
    nodes, weights = np.polynomial.legendre.leggauss(NODES)
    angles = np.pi / 2 * (nodes + 1)
    turns = np.exp(1j * angles)
    block = np.random.default_rng(7).standard_normal((d, min(d, count + max(4, count // 2))))
    basis, _ = np.linalg.qr(block)
    best = (np.inf, np.zeros(0), np.zeros((d, 0)))
    size = max(np.abs(matrix).max(), 1e-300)
    stalls = 0
    for _ in range(ROUNDS):
        projected = np.zeros_like(basis)
        for turn, weight in zip(turns, weights):
            solved = np.linalg.solve((middle + radius * turn) * np.eye(d) - matrix, basis.astype(complex))
            projected += weight / 2 * np.real(radius * turn * solved)
        basis, _ = np.linalg.qr(projected)
        values, inner = np.linalg.eigh(basis.T @ matrix @ basis)
        vectors = basis @ inner
        order = np.argsort(np.abs(values - middle))[:count]
        order = order[np.argsort(-values[order])]
        residual = np.abs(matrix @ vectors[:, order] - vectors[:, order] * values[order]).max() / size
        if residual < best[0] / 2:
            stalls = 0
        else:
            stalls += 1
        if residual < best[0]:
            best = (residual, values[order], vectors[:, order])
        if residual < 1e-15 or stalls >= 3 and best[0] < 1e-12:
            break
        basis = vectors
    return best[1], best[2]


def components(docs: DataFrame, covariance: np.ndarray, wanted: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``wanted`` largest eigenvalues of a covariance, falling, and their vectors. Every interval is solved in its own task."""
    spark = docs.sparkSession
    trace = float(np.trace(covariance))
    if trace <= 0 or not wanted:
        return np.zeros(0), np.zeros((len(covariance), 0))
    scaled = covariance / trace
    # directions without variance have no whitened value
    form = tridiagonal(scaled)
    wanted = min(wanted, int(inertia_above(form, np.array([1e-12]))[0]))
    parts = intervals(scaled, wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high, count in zip(*[batch.column(i).to_pylist() for i in range(3)]):
                values, vectors = feast(scaled, low, high, count)
                yield pa.RecordBatch.from_arrays([pa.array(values), pa.array(vectors.T.tolist(), pa.list_(pa.float64()))], names=["value", "vector"])

    tasks = spark.createDataFrame(parts, "low double, high double, n int").repartition(len(parts), "low")
    found = sorted(tasks.mapInArrow(run, "value double, vector array<double>").collect(), key=lambda r: -r.value)
    for low, high, count in parts:
        above = inertia_above(form, np.array([low, high]))
        if above[0] - above[1] != count or sum(low <= r.value <= high for r in found) != count:
            raise ArithmeticError(f"{count} eigenvalues were expected between {low} and {high}")
    values, vectors = np.array([r.value for r in found]), np.array([r.vector for r in found]).T
    # clusters that two intervals share are made orthogonal to rounding
    vectors, signs = np.linalg.qr(vectors)
    return (values * trace)[:wanted], (vectors * np.sign(np.diag(signs)))[:, :wanted]


def grid(vector: Column) -> Column:
    """Whole numbers of a vector's entries: floor(64 c) + 1000000."""
    scaled = lambda c: F.floor(F.greatest(F.lit(-LARGEST), F.least(F.lit(LARGEST), c.cast("double") * SCALE))).cast("bigint") + SHIFT
    return F.transform(vector, scaled)


def usable(vector: Column) -> Column:
    """Neither null nor with a null, NaN or infinite entry, and not empty."""
    fine = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) < float("inf"))
    return vector.isNotNull() & (F.size(vector) > 0) & F.forall(vector, lambda c: F.coalesce(fine(c), F.lit(False)))


def _matrix_sum(rows: DataFrame, column: str, map_rows) -> np.ndarray:
    """Sum over all rows of the outer product of what ``map_rows`` makes of them; partitions send one matrix each, groups add them up."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for start in range(0, batch.num_rows, BLOCK_ROWS):
                part = batch.slice(start, BLOCK_ROWS).column(0)
                values = map_rows(part.flatten().to_numpy().reshape(len(part), -1))
                total = values.T @ values + (0 if total is None else total)
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size)), pa.array(total.ravel())], names=["cell", "value"])

    cells = map_texts(rows.select(column), run, "cell bigint, value double").groupBy("cell").agg(F.sum("value").alias("value")).collect()
    side = int(round(np.sqrt(len(cells))))
    out = np.zeros(len(cells))
    out[[r.cell for r in cells]] = [r.value for r in cells]
    return out.reshape(side, side)


def whiten(rows: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", most: int = COMPONENTS) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) for every usable row and up to ``most`` components.

    Entries c count as floor(64 c) + 1000000. The components are those of all distinct vectors, each once; ``n`` is their number, ``deviation`` the
    exact squared distance of n times the vector from their sum (held at the largest long where it is larger), ``whitened`` the centred
    vector's projection over the component's standard deviation.

    Rows whose vector is null, empty, or holds a null or non-finite entry are dropped, as are vectors whose length is not the commonest one
    (the longer of equally common ones). Directions without variance (below 1e-12 of the total) are no components, so a table of one distinct
    vector gives no rows. Repeated rows and null ids are kept. Only dimension x dimension matrices reach the driver. Other columns are ignored.
    """
    kind = rows.schema[vec_id].dataType.simpleString()
    rows = rows.select(F.col(vec_id).alias("vec_id"), F.col(vector).alias("v")).where(usable(F.col("v"))).select("vec_id", grid(F.col("v")).alias("x"))
    lengths = rows.groupBy(F.size("x").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("d")).limit(1).collect()
    schema = f"vec_id {kind}, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"
    if not lengths:
        return rows.sparkSession.createDataFrame([], schema)
    rows = rows.where(F.size("x") == lengths[0].d)
    # Bits of the entries hash alike in copies, so copies meet before they are shuffled.
    fit = materialize(rows.select("x").distinct())
    sums = fit.select(F.posexplode("x").alias("dim", "x")).groupBy("dim").agg(F.sum(F.col("x").cast("decimal(38,0)")).alias("s")).orderBy("dim").collect()
    n, total = fit.metrics["rows"], [int(r.s) for r in sums]
    whole = np.array([s // n for s in total], np.int64)
    rest = np.array([(s - w * n) / n for s, w in zip(total, whole.tolist())])
    centred = lambda x: (x - whole) - rest
    covariance = _matrix_sum(fit, "x", centred) / n
    values, vectors = components(rows, (covariance + covariance.T) / 2, min(most, len(total)))
    if not len(values):
        return rows.sparkSession.createDataFrame([], schema)
    white = vectors / np.sqrt(values)
    gram = _matrix_sum(fit, "x", lambda x: centred(x) @ white) / n
    error = float(np.abs(gram - np.eye(len(values))).max())
    explained = values / float(np.trace(covariance))
    names = np.arange(1, len(values) + 1, dtype=np.int32)
    left = np.array([s - int(w) * n for s, w in zip(total, whole.tolist())], np.int64)
    largest = np.iinfo(np.int64).max

    def deviations(x: np.ndarray) -> np.ndarray:
        near = x - whole
        # in 64 bits where that is exact, else with whole numbers of any size
        if len(x) and float(np.abs(near).max() + 1) ** 2 * float(n) ** 2 * x.shape[1] < 2.0 ** 62:
            return ((n * near - left) ** 2).sum(axis=1)
        return np.array([min(largest, sum((n * int(e) - s) ** 2 for e, s in zip(r, total))) for r in x], np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(1).flatten().to_numpy().reshape(batch.num_rows, -1)
            k = len(names)
            each = np.repeat(np.arange(len(x)), k)
            yield pa.RecordBatch.from_arrays([
                batch.column(0).take(pa.array(each)), pa.array(np.tile(names, len(x))), pa.array(np.full(len(each), n)), pa.array(deviations(x)[each]),
                pa.array((centred(x) @ white).ravel()), pa.array(np.tile(explained, len(x))), pa.array(np.full(len(each), error))],
                names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return map_texts(rows, run, schema)
