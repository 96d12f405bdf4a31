"""Whitening of embeddings onto their principal components.

Vectors become whole numbers, and every distinct one is counted once.  Two passes over that list
give its exact sums and, centred on them, its products; each task sums up what it holds, and one
square matrix, whatever the number of rows, reaches the driver.  There QDWH polar decompositions of
the shifted covariance split the space into its components (``spectral``).  The projection is
broadcast, its effect on the list is measured in a third pass, and all rows are projected.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from pairsieve.functions.values import ref
from pairsieve.llm.common import keep
from pairsieve.llm.spectral import eigenvectors

COMPONENTS = 16
# Fixed values of the contract: the steps of an entry and the number that is added.
STEPS, SHIFT = 64, 1_000_000
#: Steps from zero at which an entry is held, so that sums stay exact; 1.7e10 as an entry.
LARGEST = 1 << 40
#: Share of the largest eigenvalue from which on a component has variance at all; below it double
#: precision cannot tell a component from rounding.
LEAST_SHARE = 1e-10
#: Dimensions up to which a square matrix may be sent to the driver (128 MB).
MOST_DIMENSIONS = 4096
#: Rows whose sums surely fit in a long.
SUM_ROWS = 1 << 20


@dataclass(frozen=True)
class Fit:
    """What the fit list says: its size, exact sums, and the projection of centred vectors."""

    n: int
    sums: tuple[int, ...]
    projection: np.ndarray
    explained: np.ndarray

    def centred(self, x: np.ndarray) -> np.ndarray:
        """``x - S / n``, off by the rounding of the difference only."""
        whole = np.array([s // self.n for s in self.sums], np.int64)
        rest = np.array([(s % self.n) / self.n for s in self.sums])
        return (x - whole).astype(np.float64) - rest

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sums over dimensions of ``(n x - S)^2``, exact; null beyond a long."""
        whole = np.array([s // self.n for s in self.sums], np.int64)
        rest = [s % self.n for s in self.sums]
        apart = x - whole
        largest = (int(np.abs(apart).max(initial=0)) + 1) * self.n
        if largest * largest * max(len(rest), 1) < 1 << 63:
            return ((apart * self.n - np.array(rest, np.int64)) ** 2).sum(axis=1).tolist()
        found = ((apart.astype(object) * self.n - np.array(rest, object)) ** 2).sum(axis=1)
        return [int(v) if v < 1 << 63 else None for v in found]


def vectors_of(batch: pa.RecordBatch, column: int, size: int) -> np.ndarray:
    return batch.column(column).flatten().to_numpy(zero_copy_only=False).astype(np.int64, copy=False).reshape(-1, size)


def quantised(rows: DataFrame, vector: str, vec_id: str) -> DataFrame:
    """``vec_id`` and ``x`` of the rows whose vector is complete and finite and has entries."""
    value = ref(vector).cast("array<double>")
    fine = F.size(value) > 0
    usable = F.forall(value, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    step = lambda c: F.floor(F.greatest(F.least(c * STEPS, F.lit(float(LARGEST))), F.lit(float(-LARGEST)))) + SHIFT
    return rows.select(ref(vec_id).alias("vec_id"), F.when(value.isNotNull() & fine & usable, F.transform(value, step)).alias("x")).filter("x IS NOT NULL")


def _sums(fit: DataFrame, size: int) -> tuple[int, tuple[int, ...]]:
    """The number of vectors and their sums per dimension."""
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(size, np.int64), 0
        for batch in batches:
            total, n = total + vectors_of(batch, 0, size).sum(axis=0), n + batch.num_rows
            if n >= SUM_ROWS:
                yield pa.RecordBatch.from_pydict({"n": [n], "sums": [total.tolist()]})
                total, n = np.zeros(size, np.int64), 0
        yield pa.RecordBatch.from_pydict({"n": [n], "sums": [total.tolist()]})

    found = fit.mapInArrow(add, "n long, sums array<long>").select("n", F.posexplode("sums").alias("at", "value"))
    rows = found.groupBy("at").agg(F.sum("n").alias("n"), F.sum(F.col("value").cast("decimal(38,0)")).alias("value")).orderBy("at").collect()
    return (int(rows[0]["n"]) if rows else 0), tuple(int(r["value"]) for r in rows)  # one row per dimension


def _products(fit: DataFrame, size: int, width: int, move: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """The sum over the list of the outer product of ``move`` of each vector with itself."""
    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width))
        for batch in batches:
            own = move(vectors_of(batch, 0, size))
            total += own.T @ own
        yield pa.RecordBatch.from_pydict({"line": list(range(width)), "values": list(total)}, pa.schema({"line": pa.int32(), "values": pa.list_(pa.float64())}))

    lines = fit.mapInArrow(multiply, "line int, values array<double>").select("line", F.posexplode("values").alias("at", "value"))
    cells = lines.groupBy("line", "at").agg(F.sum("value").alias("value")).toArrow()  # width * width cells
    out = np.zeros((width, width))
    out[cells.column("line").to_numpy(), cells.column("at").to_numpy()] = cells.column("value").to_numpy()
    return out


def whiten(
    rows: DataFrame, vector: str = "embedding", vec_id: str = "vec_id", components: int = COMPONENTS, least_share: float = LEAST_SHARE,
) -> DataFrame:
    """One row per usable vector and component: ``whitened`` and the figures of the fit.

    Vectors that are null or empty, or hold a null or a number that is not finite, are dropped; so
    are those whose length is not the most frequent one (of equally frequent ones the longest).
    Entries beyond ``LARGEST`` steps count as that many.  Repeated vectors are fitted once and
    projected each; repeated and null ids are kept.  Components without variance are left out, so a
    table without usable rows, or with equal ones only, gives no rows.  Components of equal variance
    are any basis of their space.  Other columns are not read, so their names cannot clash.
    """
    spark = rows.sparkSession
    schema = T.StructType([
        T.StructField("vec_id", rows.schema[vec_id].dataType), T.StructField("component", T.IntegerType()), T.StructField("n", T.LongType()),
        *[T.StructField(c, T.LongType() if c == "deviation" else T.DoubleType()) for c in ("deviation", "whitened", "explained", "identity_error")]])
    found = keep(quantised(rows, vector, vec_id), "quantised")
    lengths = found.groupBy(F.size("x").alias("size")).agg(F.count("*").alias("rows"))
    usual = lengths.orderBy(F.desc("rows"), F.desc("size")).first()
    if usual is None:
        return spark.createDataFrame([], schema)
    size = usual["size"]
    if size > MOST_DIMENSIONS:
        raise ValueError(f"vectors of {size} dimensions; the covariance of more than {MOST_DIMENSIONS} is not sent to one place")
    same = found.filter(F.size("x") == size)
    listed = keep(same.select("x").distinct(), "fit")
    n, sums = _sums(listed, size)
    centre = Fit(n, sums, np.zeros((size, 0)), np.zeros(0))
    covariance = _products(listed, size, size, centre.centred) / n
    values, vectors = eigenvectors(covariance, components)
    real = values > least_share * max(values.max(initial=0.0), 0.0)
    values, vectors = values[real], vectors[:, real]
    if not len(values):
        return spark.createDataFrame([], schema)
    fit = Fit(n, sums, vectors / np.sqrt(values), values / np.trace(covariance))
    shared = spark.sparkContext.broadcast(fit)  # dimensions by components
    identity = _products(listed, size, len(values), lambda x: shared.value.centred(x) @ shared.value.projection) / n
    error = float(np.abs(identity - np.eye(len(values))).max())
    count = len(values)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            x = vectors_of(batch, 1, size)
            white = known.centred(x) @ known.projection
            each = pa.array(np.repeat(np.arange(batch.num_rows), count))
            rows_of = batch.num_rows
            yield pa.RecordBatch.from_arrays([
                batch.column(0).take(each), pa.array(np.tile(np.arange(1, count + 1, dtype=np.int32), rows_of)),
                pa.array(np.full(rows_of * count, known.n)), pa.array(known.deviations(x), pa.int64()).take(each), pa.array(white.reshape(-1)),
                pa.array(np.tile(known.explained, rows_of)), pa.array(np.full(rows_of * count, error))], schema.fieldNames())

    return same.select("vec_id", "x").mapInArrow(project, schema)
