"""Vectors in Arrow lists as numpy matrices."""

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def lengths(column: pa.Array) -> np.ndarray:
    """Components of each row; null counts as none."""
    return pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def matrix(column: pa.Array, rows: np.ndarray) -> np.ndarray:
    """The given rows (a mask; all of one length) in double precision; null components are NaN."""
    some = column.filter(pa.array(rows))
    flat = some.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(some), -1) if len(some) else np.zeros((0, 0))
