"""Array arithmetic as columns."""

from __future__ import annotations

from typing import TYPE_CHECKING

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

if TYPE_CHECKING:  # a worker is spared the 40 MB of an import for a type
    import pandas as pd


def known(x: Column) -> Column:
    """NaN becomes null, as both stand for a missing value and NaN would compare as larger than any number."""
    return F.when(~F.isnan(x.cast("double")), x)


def is_complete(features: Column) -> Column:
    """Whether a vector is there and none of its entries is null or NaN."""
    return features.isNotNull() & F.forall(features, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")))


def positive(x: Column) -> Column:
    """``max(x, 0)`` with null kept, which ``greatest`` would skip."""
    return F.when(x.isNotNull(), F.greatest(x, F.lit(0.0)))


def mean_squared_error(a: Column, b: Column) -> Column:
    """Mean of squared differences of two equally long arrays."""
    total = F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)
    return total / F.size(a)


def distance(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))


def clip01(x: Column) -> Column:
    """Clip to [0, 1]; null and NaN give null, though ``greatest`` and ``least`` skip nulls."""
    return F.when(known(x).isNotNull(), F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0)))


def stack_arrays(column: pd.Series, width: int) -> np.ndarray:
    """Array cells of a pandas group as one matrix."""
    return np.vstack(column.to_numpy()).reshape(-1, width).astype(np.float64)


def as_matrix(cells: pa.ListArray, width: int) -> np.ndarray:
    """An Arrow batch of array cells as one matrix, without a copy per row; a null cell becomes a row of NaN."""
    flat = cells.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    if cells.null_count == 0:
        return flat.reshape(-1, width)
    out = np.full((len(cells), width), np.nan)
    out[np.asarray(cells.is_valid())] = flat.reshape(-1, width)
    return out


def as_cells(matrix: np.ndarray) -> pa.ListArray:
    """The rows of a matrix as array cells."""
    n, width = matrix.shape
    return pa.ListArray.from_arrays(np.arange(n + 1, dtype=np.int32) * width, np.ascontiguousarray(matrix).ravel())


def as_numbers(values: np.ndarray) -> pa.Array:
    """NaN becomes null."""
    return pa.array(values, mask=np.isnan(values))


def multiply(features: Column, matrix: np.ndarray) -> Column:
    """Row vector times a fixed ``(d, m)`` matrix; null if the vector is null or holds a null or NaN."""
    matrix = np.asarray(matrix, dtype=np.float64)
    d = matrix.shape[0]

    @F.arrow_udf("array<double>")
    def times(batch: pa.Array) -> pa.Array:
        return as_cells(as_matrix(batch, d) @ matrix)

    return F.when(is_complete(features), times(features))


def multiply_written_out(features: Column, matrix: np.ndarray) -> Column:
    """``multiply`` as column arithmetic, which no worker has to see; for matrices of up to some thousand numbers."""
    matrix = np.asarray(matrix, dtype=np.float64)
    d = matrix.shape[0]

    def entry(weights: np.ndarray) -> Column:
        terms = [features[i].cast("double") * F.lit(float(w)) for i, w in enumerate(weights)]
        return sum(terms[1:], terms[0])

    wrong = F.raise_error(F.concat(F.lit(f"a vector of {d} entries expected, not of "), F.size(features).cast("string")))
    return F.when(is_complete(features), F.when(F.size(features) == d, F.array(*[entry(w) for w in matrix.T])).otherwise(wrong))
