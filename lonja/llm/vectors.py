"""Embedding columns as integer vectors, and lists of numbers between Arrow and numpy."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Larger components would not leave room for exact squared distances in 64 bits.
LARGEST = 1 << 27


def integer_vectors(vectors: DataFrame, scale: int, dims: int, column: str = "embedding") -> DataFrame:
    """The rows whose vector has ``dims`` components, none null, NaN or infinite.

    Adds ``x``, each component times ``scale``, rounded down. A component beyond ``LARGEST`` ends
    the job with an error: its squared distances would not fit a long.
    """
    values = F.col(column).cast("array<double>")

    def usable(v: Column) -> Column:
        return v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))

    def rounded(v: Column) -> Column:
        whole = F.floor(v * F.lit(float(scale)))
        too_large = F.raise_error(F.lit("a component is too large for exact distances"))
        return F.when(F.abs(whole) <= LARGEST, whole).otherwise(too_large).cast("int")

    kept = vectors.where((F.size(values) == dims) & F.forall(values, usable))
    return kept.withColumn("x", F.transform(values, rounded))


def matrix(column: pa.Array, width: int, kind: type = np.int64) -> np.ndarray:
    """A column of lists of equal length as rows of a matrix."""
    values = column.flatten().to_numpy(zero_copy_only=False)
    return values.astype(kind, copy=False).reshape(len(column), width)


def lists(rows: np.ndarray) -> pa.Array:
    """The rows of a matrix as a column of lists."""
    count, width = rows.shape
    offsets = pa.array(np.arange(count + 1, dtype=np.int32) * width)
    return pa.ListArray.from_arrays(offsets, pa.array(np.ascontiguousarray(rows).reshape(-1)))


def exact_means(parts: DataFrame, *keys: str) -> dict[tuple, list[int]]:
    """Componentwise floor(sum / count) for each key, from partial rows with ``n`` and ``sums``.

    The sums are exact for any number of rows. What reaches the driver is one number for each key
    and component, so keys must be bounded.
    """
    rows = parts.select(*keys, "n", F.posexplode("sums").alias("place", "value"))
    totals = rows.groupBy(*keys, "place").agg(
        F.sum(F.col("n").cast("decimal(38,0)")).alias("n"), F.sum(F.col("value").cast("decimal(38,0)")).alias("value")
    )
    found: dict[tuple, dict[int, int]] = {}
    for row in totals.collect():
        key = tuple(row[name] for name in keys)
        found.setdefault(key, {})[row["place"]] = int(row["value"]) // int(row["n"])
    return {key: [values[place] for place in range(len(values))] for key, values in found.items()}
