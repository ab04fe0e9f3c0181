"""Whitening of embedding vectors by shifted CholeskyQR.

Entries become whole numbers first, so sums are exact. The centred distinct rows are a tall matrix A that never leaves
the executors. A pass adds up the Gram matrix of the current rows in the tasks; the driver takes its shifted Cholesky
factor; the next pass solves every row against it, which brings the columns nearer to orthonormal. The factors composed,
times the symmetric root of the last Gram matrix, give a small R with R'R = A'A, whose singular vectors and values are
the components. The shift keeps a factor in being where columns depend on each other, and the last Gram matrix undoes
it, so such directions come out as singular values of nearly nought and are no components.

A condition number of 10^8 squares to 10^16 in a Gram matrix of A; after one pass of triangular solves the rows are
conditioned well enough for the next Gram matrix to be exact, which is why there are several passes.

The driver holds matrices of dimension by dimension only, executors one batch of rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitalgrid.session import materialize

STEP, OFFSET = 64, 1000000
COMPONENTS = 16
PASSES = 4
#: Singular values below this share of the largest are rounding, not directions.
RANK_TOLERANCE = 1e-10
#: Whole numbers that a double holds exactly; entries beyond are held at it.
LARGEST = float(1 << 53)

RESULT = (
    "vec_id long, component int, n long, deviation long, deviation_exact decimal(38,0), whitened double, "
    "explained double, identity_error double"
)


def whole_numbers(vector: Column) -> Column:
    """floor(64 c) + 1000000 for every entry."""
    scaled = lambda c: F.greatest(F.least(F.floor(F.lit(float(STEP)) * c.cast("double")), F.lit(LARGEST)), F.lit(-LARGEST))
    return F.transform(vector, lambda c: scaled(c).cast("long") + F.lit(OFFSET).cast("long"))


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id and x of the rows whose vector has entries, all of them finite."""
    bad = lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))
    whole = F.col("embedding").isNotNull() & (F.size("embedding") > 0) & ~F.exists("embedding", bad)
    double = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>"))
    return double.where(whole).select("vec_id", whole_numbers(F.col("embedding")).alias("x"))


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def forward_solve(rows: np.ndarray, upper: np.ndarray) -> np.ndarray:
    """rows R^-1 for an upper triangular R, column by column."""
    out = np.empty_like(rows)
    for j in range(upper.shape[0]):
        out[:, j] = (rows[:, j] - out[:, :j] @ upper[:j, j]) / upper[j, j]
    return out


def sums(fit: DataFrame, dimension: int) -> tuple[int, list[int]]:
    """Number of vectors and their exact sum in each dimension."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, total = 0, [0] * dimension
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch.column(0))
                count += len(x)
                # a batch has thousands of rows, so the halves' sums fit
                high, low = (x >> 32).sum(axis=0), (x & 0xFFFFFFFF).sum(axis=0)
                total = [t + (int(h) << 32) + int(w) for t, h, w in zip(total, high, low)]
        yield pa.RecordBatch.from_pydict({"at": list(range(-1, dimension)), "part": [str(v) for v in [count, *total]]})

    parts = fit.select("x").mapInArrow(partial, "at long, part string")
    rows = parts.groupBy("at").agg(F.sum(F.col("part").cast("decimal(38,0)")).alias("total")).collect()
    found = {r["at"]: int(r["total"]) for r in rows}
    return found[-1], [found[i] for i in range(dimension)]


def gram(fit: DataFrame, dimension: int, turn: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """Sum over the fit list of r' r, r the turned row with a last entry of 1; so its last row has the sums."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                rows = turn(_matrix(batch.column(0)))
                rows = np.hstack([rows, np.ones((len(rows), 1))])
                total = rows.T @ rows + (0 if total is None else total)
        if total is not None:
            wide = total.shape[0]
            at = np.arange(wide * wide, dtype=np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total.ravel())], ["at", "part"])

    rows = fit.select("x").mapInArrow(partial, "at long, part double").groupBy("at").agg(F.sum("part").alias("s"))
    values = np.array([tuple(r) for r in rows.collect()])
    wide = int(round(len(values) ** 0.5))
    return values[np.argsort(values[:, 0]), 1].reshape(wide, wide)


def shifted_factor(g: np.ndarray) -> np.ndarray:
    """Upper triangular R with R'R = G + shift; the shift is as small as rounding allows."""
    eye, size = np.eye(len(g)), max(np.linalg.norm(g, 2), np.finfo(float).tiny)
    shift = 11 * len(g) * np.finfo(float).eps * size
    while True:
        try:
            return np.linalg.cholesky(g + shift * eye).T
        except np.linalg.LinAlgError:
            shift *= 10


def centring(n: int, total: list[int]) -> Callable[[np.ndarray], np.ndarray]:
    """x - S / n, its whole part taken off exactly."""
    whole = np.array([s // n for s in total], dtype=np.int64)
    rest = np.array([(s % n) / n for s in total])
    return lambda x: (x - whole).astype(np.float64) - rest


def components_of(
    fit: DataFrame, dimension: int, centred: Callable[[np.ndarray], np.ndarray], passes: int = PASSES
) -> tuple[np.ndarray, np.ndarray]:
    """Right singular vectors (as rows) and singular values of the centred fit list, largest first."""
    factors: list[np.ndarray] = []

    def orthogonal(x: np.ndarray) -> np.ndarray:
        rows = centred(x)
        for r in factors:
            rows = forward_solve(rows, r)
        return rows

    for _ in range(passes):
        g = gram(fit, dimension, orthogonal)[:-1, :-1]
        factors.append(shifted_factor(g))
    # the last rows' Gram matrix tells what shifts and dependent columns have left undone
    g = gram(fit, dimension, orthogonal)[:-1, :-1]
    value, vector = np.linalg.eigh((g + g.T) / 2)
    composed = (vector * np.sqrt(np.clip(value, 0, None))) @ vector.T
    for r in reversed(factors):
        composed = composed @ r
    _, singular, right = np.linalg.svd(composed)
    return right, singular


def _deviation(x: np.ndarray, n: int, total: list[int]) -> list[int]:
    """Sum over dimensions of (n x - S)^2, exact at any size."""
    reach = [max(int(x[:, j].max()) * n - s, s - int(x[:, j].min()) * n, 1) for j, s in enumerate(total)]
    if max(reach) ** 2 * len(total) < 1 << 63 and max(max(abs(s) for s in total), n * int(np.abs(x).max())) < 1 << 62:
        d = x * n - np.array(total, dtype=np.int64)
        return [int(v) for v in (d * d).sum(axis=1)]
    d = x.astype(object) * n - np.array(total, dtype=object)
    return list((d * d).sum(axis=1))


def whitened(vectors: DataFrame, most: int = COMPONENTS) -> DataFrame:
    """Per usable vector and component: n, deviation, whitened, explained and identity_error.

    A vector that is null, empty or holds a null or non-finite entry is dropped. Vectors must be of one length; where
    they are not, those of the most frequent length (the longer of equally frequent ones) are usable. Entries beyond
    2^53 are held there. The fit list has every distinct vector once, however many rows repeat it. Directions in which
    the fit list does not vary are no components, so a single distinct vector, like an empty table, gives no rows.
    ``deviation`` is null where it does not fit a long; ``deviation_exact`` has it as a decimal. Rows with equal or
    null vec_id are answered row by row. Other columns are ignored, whatever their names.
    """
    spark = vectors.sparkSession
    rows = usable(vectors)
    lengths = rows.groupBy(F.size("x").alias("d")).agg(F.count(F.lit(1)).alias("k"))
    common = lengths.orderBy(F.desc("k"), F.desc("d")).limit(1).collect()
    if not common:
        return spark.createDataFrame([], RESULT)
    dimension = common[0]["d"]
    rows = rows.where(F.size("x") == dimension)
    fit = materialize(rows.select("x").distinct(), "fit")
    n, total = sums(fit, dimension)
    centred = centring(n, total)
    right, singular = components_of(fit, dimension, centred)
    some = min(most, int((singular > RANK_TOLERANCE * max(singular[0], 1.0)).sum()))
    if not some:
        return spark.createDataFrame([], RESULT)
    value = singular[:some] ** 2 / n
    explained = (singular[:some] ** 2 / (singular**2).sum()).tolist()
    projection = (right[:some] / np.sqrt(value)[:, None]).T
    turn = lambda x: centred(x) @ projection
    g = gram(fit, dimension, turn)
    mean = g[-1, :-1] / n
    error = float(np.abs(g[:-1, :-1] / n - np.outer(mean, mean) - np.eye(some)).max())

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 4096):
                part = batch.slice(start, 4096)
                x = _matrix(part.column(1))
                exact = _deviation(x, n, total)
                size = len(x) * some
                each = np.repeat(np.arange(len(x)), some)
                deviation = pa.array([v if v < 1 << 63 else None for v in exact], pa.int64())
                text = pa.array([str(v) for v in exact])
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0).take(pa.array(each)),
                        pa.array(np.tile(np.arange(1, some + 1, dtype=np.int32), len(x))),
                        pa.array(np.full(size, n, dtype=np.int64)),
                        deviation.take(pa.array(each)),
                        text.take(pa.array(each)),
                        pa.array(turn(x).ravel()),
                        pa.array(np.tile(explained, len(x))),
                        pa.array(np.full(size, error)),
                    ],
                    ["vec_id", "component", "n", "deviation", "deviation_exact", "whitened", "explained", "identity_error"],
                )

    answered = rows.mapInArrow(answer, RESULT.replace("deviation_exact decimal(38,0)", "deviation_exact string"))
    return answered.withColumn("deviation_exact", F.col("deviation_exact").cast("decimal(38,0)"))
