"""Integer vectors: what the vector operators share."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: A component becomes floor(SCALE * x); larger ones than LIMIT count as LIMIT (as -LIMIT if negative), so that sums stay exact.
SCALE, LIMIT = 256, 1 << 28


def usable(vector: str) -> Column:
    """Whether a vector is there and all its components are finite numbers."""
    finite = F.forall(F.col(vector), lambda x: F.coalesce(x.cast("double").between(-1.7976931348623157e308, 1.7976931348623157e308) & ~F.isnan(x.cast("double")), F.lit(False)))
    return F.col(vector).isNotNull() & finite


def integers(vector: str) -> Column:
    """floor(SCALE * x) of each component, as array<int>."""
    scaled = lambda x: F.greatest(F.least(x.cast("double") * SCALE, F.lit(float(LIMIT))), F.lit(-float(LIMIT)))
    return F.transform(F.col(vector), lambda x: F.floor(scaled(x)).cast("int"))


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """The rows of a list column as int64; shorter ones are filled up with zeros."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    ends = column.offsets.to_numpy().astype(np.int64)
    values = column.values.to_numpy(zero_copy_only=False)
    n = np.diff(ends)
    out = np.zeros((len(column), width), np.int64)
    if len(column):
        row = np.repeat(np.arange(len(column)), n)
        out[row, np.arange(ends[0], ends[-1]) - ends[row]] = values[ends[0] : ends[-1]]
    return out
