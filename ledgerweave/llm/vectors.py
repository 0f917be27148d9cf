"""What the operators on vectors share: which rows are sound, and their components as whole numbers."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def is_sound(column: str | Column) -> Column:
    """Whether a vector is not null and all its components are finite numbers; an empty vector is sound."""
    vector = F.col(column) if isinstance(column, str) else column
    finite = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return vector.isNotNull() & finite


def floored(column: pa.Array, scale: int, width: int, largest: int) -> np.ndarray:
    """floor(scale * component) of sound vectors, a row each; shorter vectors are filled up with zeros to the width.

    Components go to double first. Whole numbers beyond +-largest become +-largest.
    """
    lengths = column.value_lengths().to_numpy(zero_copy_only=False)
    parts = column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
    whole = np.clip(np.floor(parts * scale), -largest, largest).astype(np.int64)
    if len(lengths) and (lengths == width).all():
        return whole.reshape(len(lengths), width)
    out = np.zeros((len(lengths), width), dtype=np.int64)
    out[np.arange(width) < lengths[:, None]] = whole
    return out
