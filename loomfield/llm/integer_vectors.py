"""Vectors as whole numbers: floor(64 * x) of each component, so that scores and distances are exact."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Squared lengths, of whole numbers, up to which scores and squared distances fit a long.
MOST_MASS = float(2**60)
SCALE = 64


def whole(vector: Column) -> Column:
    """array<int> of floor(64 * x)."""
    return F.transform(vector, lambda x: F.floor(x.cast("double") * SCALE).cast("int"))


def kept(rows: DataFrame, id: str, vector: str, length: int | None, *more: Column) -> DataFrame:
    """(vec_id, v, more ...) of rows with a vector of that length (of any, if none is given) whose components are all finite numbers.

    A vector whose squared length in whole numbers exceeds 2**60 takes no part: its distances don't fit a long.
    """
    able = rows.where(F.col(vector).isNotNull())
    if length is not None:
        able = able.where(F.size(vector) == length)
    able = able.where(F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < 2.0**30 / SCALE)))
    able = able.select(F.col(id).alias("vec_id"), whole(F.col(vector)).alias("v"), *more)
    return able.where(F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")) <= MOST_MASS)


def matrix(column: pa.ChunkedArray | pa.Array, length: int) -> np.ndarray:
    """(rows, length) of a list column whose lists all have that length."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, length)
