"""Whitening of embeddings: centred covariance gathered in tasks, its leading components,
and every vector projected on them.

The driver holds one matrix with a row per dimension; nothing there grows with the rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from coppice.llm.common import pick, ship
from coppice.llm.eigen import leading_pairs

COMPONENTS = 32
# Entries become whole numbers: floor(SCALE * c) + OFFSET.
SCALE, OFFSET = 64, 1_000_000
# Entries from here on have no exact whole number as a double.
LARGEST = float(1 << 46)
# Eigenvalues under this share of the largest are zero to rounding.
RANK = 1e-10
# Rows of a batch that are worked on at a time.
ROWS = 4096


def usable(rows: DataFrame, id_col: str = "vec_id", vector: str = "embedding") -> tuple[DataFrame, int]:
    """The rows whose vector can be whitened, as ``_id`` and ``_vector`` (doubles), and
    the number of dimensions: the length that most of them have, the longer of equals."""
    v = F.col("_vector")
    doubles = pick(rows, id_col, vector).toDF("_id", "_vector").withColumn("_vector", v.cast(ArrayType(DoubleType())))
    whole = doubles.filter(v.isNotNull() & F.forall(v, lambda c: c.isNotNull() & (F.abs(c) < LARGEST)) & (F.size(v) > 0))
    sizes = whole.groupBy(F.size(v).alias("size")).agg(F.count("*").alias("n"))
    most = sizes.orderBy(F.desc("n"), F.desc("size")).first()
    size = most["size"] if most else 0
    return whole.filter(F.size(v) == size), size


def _vectors(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[pa.Array, np.ndarray]]:
    """Ids and whole numbers x of a few thousand rows at a time."""
    for batch in batches:
        for start in range(0, batch.num_rows, ROWS):
            part = batch.slice(start, ROWS)
            entries = part.column("_vector").flatten().to_numpy(zero_copy_only=False).reshape(-1, size)
            yield part.column("_id"), np.floor(entries * SCALE).astype(np.int64) + OFFSET


def sums(vectors: DataFrame, size: int) -> tuple[int, list[int]]:
    """Number of vectors, and per dimension the exact sum of x."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, [0] * size
        for _, x in _vectors(batches, size):
            n += len(x)
            total = [a + int(b) for a, b in zip(total, x.sum(axis=0))]
        if n:
            columns = [pa.array(range(size), pa.int32()), pa.array([n] * size), pa.array(map(str, total))]
            yield pa.RecordBatch.from_arrays(columns, names=["i", "n", "s"])

    parts = vectors.mapInArrow(run, "i int, n long, s string")
    found = parts.groupBy("i").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect()
    if not found:
        return 0, []
    return found[0]["n"], [int(row["s"]) for row in sorted(found, key=lambda row: row["i"])]


class Centre:
    """Mean of the x-vectors, kept as whole parts and remainders, so that n * x - S is exact."""

    def __init__(self, n: int, total: list[int]) -> None:
        self.n = n
        self.whole = np.array([s // n for s in total], np.int64)
        self.rest = np.array([s % n for s in total], np.int64)

    def centred(self, x: np.ndarray) -> np.ndarray:
        """x - S/n as doubles."""
        return (x - self.whole) - self.rest / self.n

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sum over the dimensions of (n * x - S)^2, exact; None beyond 64 bits."""
        near = x - self.whole
        bound = self.n * (int(np.abs(near).max(initial=0)) + 1)
        if bound * bound * x.shape[1] < 1 << 63:
            far = self.n * near - self.rest
            return (far * far).sum(axis=1).tolist()
        far = self.n * near.astype(object) - self.rest.astype(object)
        exact = (far * far).sum(axis=1).tolist()
        return [value if value < 1 << 63 else None for value in exact]


def _gram(vectors: DataFrame, size: int, width: int, rows_of) -> np.ndarray:
    """Covariance, divisor n, of the ``width`` numbers that ``rows_of`` makes of each x.

    Each task centres what it has at its own mean and returns one matrix by rows; the
    rows are added up by Spark, with what the tasks' means differ by.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, mean, spread = 0, np.zeros(width), np.zeros((width, width))
        for _, x in _vectors(batches, size):
            y = rows_of(x)
            own = y.mean(axis=0)
            step, both = own - mean, n + len(y)
            spread += (y - own).T @ (y - own) + np.outer(step, step) * (n * len(y) / both)
            mean, n = mean + step * (len(y) / both), both
        if n:
            around = spread + n * np.outer(mean, mean)
            i, j = np.triu_indices(width)
            # The last cells hold the number of rows and the sums.
            columns = [np.r_[i, np.full(width, -1)], np.r_[j, np.arange(width)], np.r_[around[i, j], n * mean]]
            arrays = [pa.array(column, kind) for column, kind in zip(columns, (pa.int32(), pa.int32(), pa.float64()))]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array([n] * len(arrays[0]))], names=["i", "j", "v", "n"])

    cells = vectors.mapInArrow(run, "i int, j int, v double, n long")
    out, first, n = np.zeros((width, width)), np.zeros(width), 1
    for row in cells.groupBy("i", "j").agg(F.sum("v").alias("v"), F.sum("n").alias("n")).toLocalIterator():
        if row["i"] < 0:
            first[row["j"]], n = row["v"], row["n"]
        else:
            out[row["i"], row["j"]] = out[row["j"], row["i"]] = row["v"]
    return (out - np.outer(first, first) / n) / n


def whiten(embeddings: DataFrame, components: int = COMPONENTS, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """A row per vector and component: the id, component (from 1, by falling eigenvalue),
    n, deviation, whitened, explained, identity_error.

    An entry c is the whole number ``x = floor(64 * c) + 1000000``; n vectors with sums S
    are fitted. ``whitened`` is ``x - S/n`` projected on the unit eigenvector of the
    covariance (divisor n) and divided by the root of its eigenvalue, ``explained`` the
    eigenvalue's share of the trace, ``deviation`` the sum of ``(n * x - S)^2``, exact, null
    beyond 64 bits. ``identity_error`` is the largest absolute entry of whitened's own
    covariance minus the identity, gathered in a pass of its own.

    Rows whose vector is null, empty, or holds a null, NaN, infinite or 2^46 or larger
    entry are dropped, and those of another length than most have (the longer of equals).
    Repeated rows and ids, and null ids, count and come back like all others; vectors of
    fewer dimensions have as many components. A component whose eigenvalue is under 1e-10
    of the largest has a null ``whitened`` and no part in identity_error, which is null where no component
    is left; explained is null where all vectors are equal. An empty table gives no
    rows. Other columns are ignored.

    Three narrow passes gather a matrix in each task (of the dimensions' square; only
    these are shuffled), the driver finds the components of one such matrix, and the
    last pass is a projection without a shuffle.
    """
    ship(embeddings.sparkSession)
    vectors, size = usable(embeddings, id_col, vector)
    n, total = sums(vectors, size) if size else (0, [])
    kind = vectors.schema["_id"].dataType
    made = StructType(
        [StructField(id_col, kind)]
        + list(
            StructType.fromDDL(
                "component int, n long, deviation long, whitened double, explained double, identity_error double"
            )
        )
    )
    if not n:
        return embeddings.sparkSession.createDataFrame([], made)
    centre = Centre(n, total)
    covariance = _gram(vectors, size, size, centre.centred)
    values, basis = leading_pairs(covariance, components)
    trace = float(np.trace(covariance))
    real = values > max(values[0], 0.0) * RANK
    roots = np.sqrt(np.where(real, values, 1.0))
    basis = basis / roots
    explained = [float(value) / trace if trace > 0 else None for value in values]
    k, used = len(values), int(real.sum())
    error = None
    if used:
        error = float(np.abs(_gram(vectors, size, used, lambda x: centre.centred(x) @ basis[:, :used]) - np.eye(used)).max())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, x in _vectors(batches, size):
            rows = len(x)
            projected = centre.centred(x) @ basis
            owners = pa.array(np.repeat(np.arange(rows), k))
            columns = [
                ids.take(owners),
                pa.array(np.tile(np.arange(1, k + 1), rows), pa.int32()),
                pa.array(np.full(rows * k, n), pa.int64()),
                pa.array(centre.deviations(x), pa.int64()).take(owners),
                pa.array(projected.ravel(), mask=np.tile(~real, rows)),
                pa.array(explained, pa.float64()).take(pa.array(np.tile(np.arange(k), rows))),
                pa.array([error], pa.float64()).take(pa.array(np.zeros(rows * k, np.int64))),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=made.names)

    return vectors.mapInArrow(run, made)
