"""Vectors that may take part, and classes of equal vectors."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def usable_vectors(vectors: DataFrame, id_col: str, vector_col: str, *more: str) -> DataFrame:
    """``vec_id, v`` (array of double), ``dim, h1, h2`` and the columns of ``more``, for
    vectors that are not null or zero and hold no null or non-finite component. Equal
    vectors have equal ``h1, h2`` (128 bits)."""
    v = F.col(vector_col)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.where(v.isNotNull() & F.col(id_col).isNotNull()).where(finite & F.exists(v, lambda x: x != 0))
    wide = F.transform(v, lambda x: x.cast("double") + F.lit(0.0))
    return rows.select(F.col(id_col).cast("long").alias("vec_id"), wide.alias("v"), *more).withColumns({"dim": F.size("v"), "h1": F.xxhash64("v"), "h2": F.xxhash64(F.lit(7), "v")})


def matrix(lists: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Rows of equal length as a double matrix."""
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.combine_chunks()
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(lists), -1)
