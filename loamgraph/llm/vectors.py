"""Shared parts of the operators on vectors: validity, dimension, unit vectors, exact cosines."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usable(vector: str) -> Column:
    """Whether a vector takes part: not null, not zero, every component present and finite."""
    x = F.col(vector)
    finite = lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < float("inf"))
    return F.coalesce(F.forall(x, finite) & F.exists(x, lambda c: c != 0), F.lit(False))


def lengths(df: DataFrame, vector: str) -> list[int]:
    """The lengths that the vectors of ``df`` have, the most frequent first.

    Vectors are compared with those of their own length alone, one length after another; the driver gets a row a length.
    """
    sizes = df.groupBy(F.size(vector).alias("d")).count().orderBy(F.desc("count"), F.desc("d"))
    return [r["d"] for r in sizes.collect()]


def matrix(column: pa.Array) -> np.ndarray:
    """The rows of a list column of equal lengths without nulls, in double precision."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = column.chunk(0)
    if not len(column):
        return np.zeros((0, 0))
    return pc.list_flatten(column).to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def unit(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1, first by their largest component so that no square overflows."""
    x = x / np.abs(x).max(axis=1, keepdims=True) if x.size else x
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True)) if x.size else x


def cosines(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Cosines of unit rows, pair by pair, summed in the same order for each, so equal rows get equal values."""
    return (x * y).sum(axis=1)


def bounded_sample(df: DataFrame, id: str, vector: str, limit: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and unit vectors of at most ``limit`` rows, the first by a seeded hash of the id."""
    rows = df.orderBy(F.xxhash64(F.lit(seed), F.col(id)), id).limit(limit).select(id, F.col(vector).cast("array<float>")).toArrow()
    return rows.column(0).to_numpy(), unit(matrix(rows.column(1)))
