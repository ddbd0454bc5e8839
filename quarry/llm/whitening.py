"""Embedding whitening by incremental eigendecomposition.

Each partition holds the count, the mean and the whole spectrum (eigenvalues, eigenvectors)
of the scatter of the vectors it has seen, and takes every vector in by one centred rank-one
update: the secular equation is solved for all roots at once, after deflation (equal poles
are reflected onto one direction, directions that the vector does not touch stay). Spectra
of partitions are combined in the same way, one rank-one update for each eigenpair and one
for the difference of the means, in a tree of groups. The leading directions of the result
span the trial space of a distributed Rayleigh-Ritz refinement: one pass sums V times the
basis over the fit list, the small projected problem is solved on the driver, and the pass
is repeated on the new directions until the residuals are at rounding level.

An entry c becomes the integer floor(256 c); the fit list is each distinct integer vector once,
so copies weigh once however many there are.

Defined cases: rows whose vector is null or holds null, NaN or infinite entries are dropped; vectors
shorter than the longest are filled with zeros (an empty vector is all zeros); rows of null
or repeated vec_id are rows like any other; components without variance are not returned
(whitening is not defined for them), so one distinct vector, or an empty table, gives no
rows; entries beyond a long saturate; a deviation that does not fit a long is null; other
columns are ignored.
"""

from __future__ import annotations

from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import prepare, write_table

COMPONENTS, SCALE = 4, 256.0
#: Directions of the trial space, passes of the refinement and the residual (of the largest eigenvalue) that ends it.
TRIAL, PASSES, RESIDUAL = 128, 40, 1e-13
#: Groups of the tree that combines the partitions' spectra and sums, level by level.
LEVELS = (1024, 32, 1)
EPS = np.finfo(np.float64).eps
#: Relative error of the secular equation at which a root is taken (the refinement polishes what is left).
ROOT_ERROR = 1e-12


def integer_vectors(table: DataFrame, vec_col: str = "embedding") -> DataFrame:
    """(vec_id, x: array<bigint>) of the rows that take part."""
    v = F.col(vec_col).cast("array<double>")
    fine = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    rows = table.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).filter(F.col("v").isNotNull() & fine)
    return rows.select("vec_id", F.transform("v", lambda c: F.floor(c * SCALE).cast("long")).alias("x"))


def _reflect(values: np.ndarray, vectors: np.ndarray, z: np.ndarray, tol: float) -> None:
    """Turn the basis inside each run of equal poles so that one direction of it carries all of z."""
    close = np.flatnonzero(np.diff(values) <= tol)
    if not len(close):
        return
    for run in np.split(close, np.flatnonzero(np.diff(close) > 1) + 1):
        at = slice(run[0], run[-1] + 2)
        part = z[at]
        length = np.sqrt(part @ part)
        if length == 0.0:
            continue
        mirror = part.copy()
        mirror[-1] += np.copysign(length, part[-1])
        mirror /= np.sqrt(mirror @ mirror)
        vectors[:, at] -= 2.0 * np.outer(vectors[:, at] @ mirror, mirror)
        sign = -np.copysign(length, part[-1])
        z[at] = 0.0
        z[run[-1] + 1] = sign


def secular_roots(poles: np.ndarray, weights: np.ndarray, rho: float) -> np.ndarray:
    """poles[j] - root[i] as a matrix (i, j), for the roots of 1 + rho * sum_j weights[j] / (poles[j] - x).

    Poles rise, weights are positive; root i lies between pole i and the next one (the last
    within rho * sum(weights)). Roots are held as distances from their nearest pole, so that
    differences keep their digits; the steps interpolate the two neighbouring poles, and a
    step that leaves the bracket halves it."""
    k = len(poles)
    if k == 1:  # the one root is its pole and the whole weight
        return -rho * weights[:, None], poles + rho * weights
    line = np.arange(k)
    inner = line < k - 1
    weights = rho * weights
    gaps = np.append(poles[1:], poles[-1] + weights.sum()) - poles
    below_root = line[None, :] <= line[:, None]
    lower = below_root.astype(np.float64)
    # the half that holds the root, and a first guess from its two poles with the others' sum taken at the middle
    terms = weights / (poles[None, :] - (poles + 0.5 * gaps)[:, None])
    at_middle = 1.0 + terms.sum(axis=1)
    right = (at_middle < 0.0) & inner
    near, far = np.where(right, np.append(weights[1:], 0.0), weights), np.where(right, weights, np.append(weights[1:], 0.0))
    rest = at_middle + 2.0 * (weights - np.append(weights[1:], 0.0)) / gaps
    rest = np.where(right, -rest, rest)
    lean = rest * gaps + near + far
    guess = 2.0 * near * gaps / (lean + np.sqrt(np.maximum(lean * lean - 4.0 * rest * near * gaps, 0.0)))
    origin = line + right
    shift = poles[None, :] - poles[origin][:, None]
    low = np.where(right, -0.5 * gaps, np.where(at_middle < 0.0, 0.5 * gaps, 0.0))
    high = np.where(right, 0.0, np.where(at_middle < 0.0, gaps, 0.5 * gaps))
    root = np.where(right, -guess, guess)
    root = np.where(inner & (root > low) & (root < high), root, 0.5 * (low + high))
    first = np.where(inner, line, max(k - 2, 0))
    lower[-1] = lower[max(k - 2, 0)]
    second = np.minimum(first + 1, k - 1)
    for _ in range(100):
        delta = shift - root[:, None]
        terms = weights / delta
        slopes = terms / delta
        value = 1.0 + terms.sum(axis=1)
        size = 1.0 + np.abs(value) - 2.0 * np.einsum("ij,ij->i", terms, lower)
        below = np.einsum("ij,ij->i", slopes, lower)
        above = slopes.sum(axis=1) - below
        left = value < 0.0
        low, high = np.where(left, root, low), np.where(left, high, root)
        going = (np.abs(value) > ROOT_ERROR * size) & (high - low > 2 * EPS * np.abs(root))
        if not going.any():
            break
        d1, d2 = delta[line, first], delta[line, second]
        a = (d1 + d2) * value - d1 * d2 * (below + above)
        b = d1 * d2 * value
        c = value - d1 * below - d2 * above
        with np.errstate(all="ignore"):
            square = np.sqrt(np.maximum(a * a - 4.0 * b * c, 0.0))
            square = np.where(inner, -square, square)
            step = np.where((a <= 0.0) == inner, (a + square) / (2.0 * c), 2.0 * b / (a - square))
            new = root + step
        new = np.where((new > low) & (new < high), new, 0.5 * (low + high))
        root = np.where(going, new, root)
    return shift - root[:, None], poles[origin] + root


class Spectrum:
    """Count, mean, exact sums and eigendecomposition of the scatter of the vectors taken in."""

    def __init__(self, d: int):
        self.n, self.mean, self.sums = 0, np.zeros(d), [0] * d
        self.values, self.vectors = np.zeros(d), np.eye(d)

    def rank_one(self, rho: float, v: np.ndarray) -> None:
        """Scatter += rho v v'."""
        z = v @ self.vectors
        size = float(z @ z)
        if rho <= 0.0 or size == 0.0:
            return
        z /= np.sqrt(size)
        rho = rho * size
        tol = 8 * EPS * max(abs(self.values[-1]), rho)
        _reflect(self.values, self.vectors, z, tol)
        live = np.flatnonzero(np.abs(z) * rho > tol)
        if not len(live):
            return
        poles, weights = self.values[live], z[live] ** 2
        delta, roots = secular_roots(poles, weights, rho)
        # the z that has exactly these roots: the vectors come out orthogonal whatever the roots' rounding
        between = poles[:, None] - poles[None, :]
        np.fill_diagonal(between, -rho)
        exact = np.sqrt(np.abs((delta / between).prod(axis=0)))
        turned = np.copysign(exact, z[live])[None, :] / delta
        turned /= np.sqrt((turned * turned).sum(axis=1))[:, None]
        self.vectors[:, live] = self.vectors[:, live] @ turned.T
        self.values[live] = roots
        order = np.argsort(self.values, kind="stable")
        self.values, self.vectors = self.values[order], self.vectors[:, order]

    def add(self, x: np.ndarray) -> None:
        """One centred rank-one update for each row of x (the sums are kept by ``count``)."""
        for row in x:
            away = row - self.mean
            self.rank_one(self.n / (self.n + 1.0), away)
            self.n += 1
            self.mean += away / self.n

    def count(self, x: np.ndarray) -> None:
        """Exact sums of integer rows."""
        small = len(x) == 0 or max(abs(int(x.min())), abs(int(x.max()))) < 2 ** 62 // len(x)
        part = (x if small else x.astype(object)).sum(axis=0)
        self.sums = [a + int(b) for a, b in zip(self.sums, part)]

    def merge(self, other: "Spectrum") -> "Spectrum":
        """Successive rank-one updates with the other's eigenpairs and the difference of the means."""
        if self.n and other.n:
            for value, vector in zip(other.values, other.vectors.T):
                self.rank_one(float(value), vector)
            away = other.mean - self.mean
            self.rank_one(self.n * other.n / (self.n + other.n), away)
            self.mean = self.mean + away * (other.n / (self.n + other.n))
        elif other.n:
            self.mean, self.values, self.vectors = other.mean, other.values, other.vectors
        self.n += other.n
        self.sums = [a + b for a, b in zip(self.sums, other.sums)]
        return self

    def batch(self, slot: int) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([
            pa.array([slot], pa.int32()), pa.array([self.n], pa.int64()),
            *(pa.array([a.ravel()], pa.list_(pa.float64())) for a in (self.mean, self.values, self.vectors)),
            pa.array([[Decimal(s) for s in self.sums]], pa.list_(pa.decimal128(38, 0)))], schema=_STATE)

    @classmethod
    def of(cls, row: dict) -> "Spectrum":
        d = len(row["mean"])
        out = cls(d)
        out.n, out.sums = row["n"], [int(s) for s in row["sums"]]
        out.mean, out.values = np.array(row["mean"]), np.array(row["vals"])
        out.vectors = np.array(row["vecs"]).reshape(d, d)
        return out


_DOUBLES = pa.list_(pa.float64())
_STATE = pa.schema([("slot", pa.int32()), ("n", pa.int64()), ("mean", _DOUBLES), ("vals", _DOUBLES), ("vecs", _DOUBLES),
                    ("sums", pa.list_(pa.decimal128(38, 0)))])
_STATE_DDL = "slot int, n long, mean array<double>, vals array<double>, vecs array<double>, sums array<decimal(38,0)>"
_PIECE = pa.schema([("slot", pa.int32()), ("data", _DOUBLES)])
_PIECE_DDL = "slot int, data array<double>"


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), d)


def _spectra(d: int):
    def run(batches):
        have = Spectrum(d)
        for batch in batches:
            x = _matrix(batch.column("x"), d)
            have.count(x)
            have.add(x.astype(np.float64))
        if have.n:
            yield have.batch(TaskContext.get().partitionId())

    return run


def _merge_spectra(table: pa.Table) -> pa.Table:
    if len(table) == 1:
        return table
    rows = table.to_pylist()
    have = Spectrum.of(rows[0])
    for row in rows[1:]:
        have.merge(Spectrum.of(row))
    return pa.Table.from_batches([have.batch(rows[0]["slot"])])


def _merge_sums(table: pa.Table) -> pa.Table:
    if len(table) == 1:
        return table
    total = sum(np.asarray(c.values) for c in table["data"])
    return pa.table([table["slot"].slice(0, 1).combine_chunks(), pa.array([total], _DOUBLES)], schema=_PIECE)


def tree(rows: DataFrame, merge, ddl: str) -> list:
    """Combine one row for each task in groups, level by level, to a single row."""
    for groups in LEVELS:
        rows = rows.withColumn("slot", F.pmod("slot", F.lit(groups)).cast("int")).groupBy("slot").applyInArrow(merge, ddl)
    return rows.collect()


def _products(center: np.ndarray, basis: np.ndarray):
    """Sums of (x - center) (x - center)' basis over a task's rows."""
    def run(batches):
        total, seen = np.zeros(basis.shape), False
        for batch in batches:
            y = _matrix(batch.column("x"), len(center)) - center
            total += y.T @ (y @ basis)
            seen = seen or len(y) > 0
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()),
                                              pa.array([total.ravel()], _DOUBLES)], schema=_PIECE)

    return run


def refine(fit: DataFrame, center: np.ndarray, basis: np.ndarray, n: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Rayleigh-Ritz on the fit list's covariance: the k largest eigenvalues and their vectors.

    A pass of the data is repeated, on the space that V times the basis spans, until the k
    residuals are at rounding level (a basis as wide as the vectors needs one pass)."""
    for _ in range(PASSES):
        basis, _r = np.linalg.qr(basis)
        rows = tree(fit.mapInArrow(_products(center, basis), _PIECE_DDL), _merge_sums, _PIECE_DDL)
        image = np.array(rows[0]["data"]).reshape(basis.shape) / n
        small = basis.T @ image
        values, turn = np.linalg.eigh((small + small.T) / 2)
        order = np.argsort(-values, kind="stable")[:k]
        vectors = basis @ turn[:, order]
        left = np.abs(image @ turn[:, order] - vectors * values[order]).max(initial=0.0)
        if basis.shape[0] == basis.shape[1] or left <= RESIDUAL * abs(values[order[0]]):
            break
        basis = image
    return values[order], vectors


def _whiten(n: int, sums: list[int], projection: np.ndarray):
    """Components and the exact deviation of each row."""
    d, k = projection.shape
    center = np.array([s / n for s in sums])
    widest = max((abs(s) for s in sums), default=0)

    def run(batches):
        for batch in batches:
            x = _matrix(batch.column("x"), d)
            if not len(x):
                continue
            top = n * max(abs(int(x.min())), abs(int(x.max()))) + widest
            if d * top * top < 2 ** 63:
                away = n * x - np.array(sums, dtype=np.int64)
                deviation = pa.array((away * away).sum(axis=1), pa.int64())
            else:
                away = n * x.astype(object) - np.array(sums, dtype=object)
                far = (away * away).sum(axis=1)
                deviation = pa.array([int(a) if a < 2 ** 63 else None for a in far], pa.int64())
            white = (x - center) @ projection
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), deviation,
                 pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * k, pa.int32()), pa.array(white.ravel()))],
                names=["vec_id", "deviation", "white"])

    return run


def whiten(table: DataFrame, components: int = COMPONENTS, vec_col: str = "embedding") -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error for each row and component."""
    spark = table.sparkSession
    prepare(spark)
    empty = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    rows = integer_vectors(table, vec_col)
    d = rows.agg(F.max(F.size("x"))).first()[0] or 0
    if not d:
        return spark.createDataFrame([], empty)
    fill = F.when(F.size("x") < d, F.concat("x", F.array_repeat(F.lit(0).cast("long"), F.lit(d) - F.size("x")))).otherwise(F.col("x"))
    rows = rows.withColumn("x", fill)
    fit = write_table(rows.select("x").distinct(), "whitening-fit")
    found = Spectrum.of(tree(fit.mapInArrow(_spectra(d), _STATE_DDL), _merge_spectra, _STATE_DDL)[0].asDict())
    n, sums, trial = found.n, found.sums, found.vectors[:, ::-1][:, :min(d, TRIAL)]
    center = np.array([s / n for s in sums])
    values, vectors = refine(fit, center, trial, n, min(d, components))
    kept = values > d * 8 * EPS * max(values[0], 1.0)
    values, vectors = values[kept], vectors[:, kept]
    if not len(values):
        return spark.createDataFrame([], empty)
    trace = _trace(fit, center) / n
    project = _whiten(n, sums, vectors / np.sqrt(values))
    ddl = "vec_id long, deviation long, white array<double>"
    own = fit.select(F.lit(0).cast("long").alias("vec_id"), "x").mapInArrow(project, ddl)
    pairs = [(i, j) for i in range(len(values)) for j in range(i, len(values))]
    together = own.agg(*(F.covar_pop(F.col("white")[i], F.col("white")[j]).alias(f"c{i}_{j}") for i, j in pairs)).first()
    error = max(abs(c - (i == j)) for (i, j), c in zip(pairs, together))
    part = F.array(*(F.struct(F.lit(i + 1).alias("component"), F.lit(float(e / trace)).alias("explained"))
                     for i, e in enumerate(values)))
    return rows.mapInArrow(project, ddl) \
        .select("vec_id", "deviation", F.explode(F.arrays_zip("white", part.alias("part"))).alias("c")) \
        .select("vec_id", F.col("c.part.component").alias("component"), F.lit(n).cast("long").alias("n"), "deviation",
                F.col("c.white").alias("whitened"), F.col("c.part.explained").alias("explained"),
                F.lit(float(error)).alias("identity_error"))


def _trace(fit: DataFrame, center: np.ndarray) -> float:
    """Sum over the fit list of the squared distances from the mean."""
    def run(batches):
        total, seen = 0.0, False
        for batch in batches:
            y = _matrix(batch.column("x"), len(center)) - center
            total, seen = total + float((y * y).sum()), seen or len(y) > 0
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array([total])], names=["part"])

    return float(fit.mapInArrow(run, "part double").agg(F.sum("part")).first()[0])
