"""Whitening of embeddings along the leading eigenvectors of their covariance.

Spark gathers the sums and the covariance, task by task; the eigenpairs of that one small
matrix come from spectrum slicing (``spectrum``); the vectors are projected where they are.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronaudit.llm.spectrum import leading

#: Entries whose scaled value is larger have no exact place on the grid.
LARGEST = 2**53


@dataclass(frozen=True)
class Whitening:
    """What was fitted: rows, sums of each dimension, and the components in falling order."""

    n: int
    sums: np.ndarray
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    scale: float
    shift: int
    identity_error: float = 0.0

    @property
    def explained(self) -> np.ndarray:
        return self.values / self.trace if self.trace else self.values

    def centred(self, grid: np.ndarray) -> np.ndarray:
        """The vectors less their mean, rounded once: n * x - S is an integer."""
        return self.exact(grid).astype(np.float64) / self.n

    def exact(self, grid: np.ndarray) -> np.ndarray:
        """n * x - S, in Python's integers where 64 bits are not enough."""
        largest = int(np.abs(grid).max(initial=0)) * self.n + max(map(abs, self.sums.tolist()), default=0)
        if largest >= 2**62:
            return grid.astype(object) * self.n - self.sums.astype(object)
        return grid * self.n - self.sums

    def deviations(self, grid: np.ndarray) -> list[int]:
        """The sum of (n * x - S)² over the dimensions of each vector, exactly."""
        off = self.exact(grid)
        if off.dtype != object and int(np.abs(off).max(initial=0)) ** 2 * max(1, off.shape[1]) < 2**63:
            return np.einsum("ij,ij->i", off, off).tolist()
        return [sum(x * x for x in row) for row in off.tolist()]

    def project(self, grid: np.ndarray) -> np.ndarray:
        return self.centred(grid) @ (self.vectors / np.sqrt(self.values))


def _usable(embeddings: DataFrame, vec_col: str) -> DataFrame:
    """Rows whose vector is there and has finite entries only, and at least one."""
    finite = F.forall(vec_col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return embeddings.where(F.col(vec_col).isNotNull() & (F.size(vec_col) > 0) & finite)


def _grid(column: pa.Array, scale: float, shift: int, size: int | None = None) -> np.ndarray:
    """One row of integers for each vector of a batch."""
    lengths = set(pc.list_value_length(column).to_pylist()) | ({size} if size else set())
    if len(lengths) > 1:
        raise ValueError(f"vectors have different lengths: {sorted(lengths)}")
    flat = np.floor(scale * column.flatten().to_numpy(zero_copy_only=False).astype(np.float64))
    if np.abs(flat).max(initial=0) > LARGEST:
        raise ValueError(f"entries beyond {LARGEST} once scaled have no exact place on the grid")
    return flat.astype(np.int64).reshape(len(column), -1) + shift


def _summed(rows: DataFrame, vec_col: str, part: Callable, scale: float, shift: int, kind: str) -> list[np.ndarray]:
    """Sums over all rows of what ``part`` makes of each batch (flat arrays of one length for all).

    A task adds up its own batches; partial sums of entries are then combined by Spark. Entries
    are as many as ``part`` gives, whatever the number of rows.
    """

    def add_up(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                new = part(_grid(batch.column(0), scale, shift))
                if total is not None and len(total) != len(new):
                    raise ValueError("vectors have different lengths")
                total = new if total is None else total + new
        if total is not None:
            places = pa.array(np.arange(len(total), dtype=np.int32))
            sizes = pa.array(np.full(len(total), len(total), dtype=np.int64))
            yield pa.RecordBatch.from_arrays([sizes, places, pa.array(total)], ["size", "place", "value"])

    parts = rows.select(vec_col).mapInArrow(add_up, f"size long, place int, value {kind}")
    found = parts.groupBy("size", "place").agg(F.sum("value").alias("value")).toArrow()
    sizes = sorted(set(found.column("size").to_pylist()))
    if len(sizes) > 1:
        raise ValueError("vectors have different lengths")
    order = np.argsort(found.column("place").to_numpy())
    return found.column("value").to_numpy()[order]


def fit(embeddings: DataFrame, vec_col: str = "embedding", components: int = 32, scale: float = 64, shift: int = 1_000_000) -> Whitening:
    """The leading components of the covariance of floor(scale * entry) + shift.

    Vectors that are null or empty or hold null or non-finite entries take no part. Repeated
    rows count each time. No rows, or rows that are all equal, have no components; components
    without variance are left out. Vectors of different lengths are an error.

    Three passes: integer sums, the covariance of centred vectors (divisor n), and the
    covariance of the whitened vectors, whose largest distance from the identity is
    ``identity_error``. A task hands on one partial matrix; only the square of the dimension
    reaches the driver.
    """
    rows = _usable(embeddings, vec_col)
    counted = _summed(rows, vec_col, lambda x: np.append(x.sum(axis=0), len(x)), scale, shift, "long")
    if not len(counted):
        return Whitening(0, np.zeros(0, np.int64), np.zeros(0), np.zeros((0, 0)), 0.0, scale, shift)
    n, sums = int(counted[-1]), counted[:-1].astype(np.int64)
    d = len(sums)
    plain = Whitening(n, sums, np.ones(d), np.eye(d), 0.0, scale, shift)
    square = _summed(rows, vec_col, lambda x: _products(plain.centred(x)), scale, shift, "double")
    covariance = square.reshape(d, d) / n
    values, vectors = leading(covariance, components)
    fitted = Whitening(n, sums, values, vectors, float(np.trace(covariance)), scale, shift)
    if not len(values):
        return fitted
    square = _summed(rows, vec_col, lambda x: _products(fitted.project(x)), scale, shift, "double")
    error = float(np.abs(square.reshape(len(values), -1) / n - np.eye(len(values))).max())
    return Whitening(n, sums, values, vectors, fitted.trace, scale, shift, error)


def _products(x: np.ndarray) -> np.ndarray:
    return (x.T @ x).ravel()


def whiten(
    embeddings: DataFrame, fitted: Whitening, id_col: str = "vec_id", vec_col: str = "embedding"
) -> DataFrame:
    """One row per usable vector: the id, deviation (decimal) and whitened, an entry for each component.

    Usable vectors are those that ``fit`` takes. ``deviation`` is the exact sum of
    (n * x - S)² over the dimensions. Rows are kept as often as they are repeated, with null
    ids too; other columns are not read. An empty table gives an empty table; where there are
    no components ``whitened`` is empty.
    """
    rows = _usable(embeddings, vec_col).select(F.col(id_col).alias("id"), F.col(vec_col).alias("vec"))
    k = len(fitted.values)

    def project(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            grid = _grid(batch.column("vec"), fitted.scale, fitted.shift, len(fitted.sums))
            flat = pa.array(fitted.project(grid).ravel())
            ends = pa.array(np.arange(0, k * len(grid) + 1, k) if k else np.zeros(len(grid) + 1), pa.int32())
            deviations = pa.array(fitted.deviations(grid)).cast(pa.decimal128(38, 0))
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), deviations, pa.ListArray.from_arrays(ends, flat)], ["id", "deviation", "whitened"])

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(project, f"id {kind}, deviation decimal(38,0), whitened array<double>").withColumnRenamed("id", id_col)


def whitened_rows(
    embeddings: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", components: int = 32
) -> DataFrame:
    """``fit`` and ``whiten``, as one row per usable vector and component (numbered from 1).

    id, component, n, deviation (long; more than 64 bits are an error), whitened, explained
    (the component's share of the whole variance) and identity_error. Odd rows are treated as
    ``fit`` and ``whiten`` say; no components give no rows.
    """
    fitted = fit(embeddings, vec_col, components)
    explained = F.array(*[F.lit(float(x)) for x in fitted.explained]).cast("array<double>")
    return (
        whiten(embeddings, fitted, id_col, vec_col)
        .select(id_col, F.col("deviation").cast("long").alias("deviation"), F.posexplode("whitened").alias("at", "whitened"))
        .select(
            id_col, (F.col("at") + 1).alias("component"), F.lit(fitted.n).cast("long").alias("n"), "deviation", "whitened",
            F.get(explained, F.col("at")).alias("explained"), F.lit(fitted.identity_error).alias("identity_error"),
        )
    )
