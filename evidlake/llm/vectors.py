"""What the three operators on embeddings share: which rows take part, and vectors as numpy matrices in tasks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import plain


def finite(v: Column) -> Column:
    """True where a vector of doubles is not null and holds no null, NaN or infinite component."""
    return F.coalesce(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))), F.lit(False))


def kept_vectors(rows: DataFrame, vec_col: str, **columns: str) -> DataFrame:
    """The rows with finite vectors: the columns asked for under new names, and the vector as `v`, an array of doubles."""
    df, name = plain(rows)
    out = df.select(*[F.col(name(c)).alias(n) for n, c in columns.items()], F.col(name(vec_col)).cast("array<double>").alias("v"))
    return out.where(finite(F.col("v")))


def matrix(column: pa.Array, dim: int | None = None) -> np.ndarray:
    """A column of lists as a matrix of doubles; lists of another length than `dim` (or than each other) are an error."""
    lengths = pc.list_value_length(column)
    dim = dim if dim is not None else (lengths[0].as_py() if len(column) else 0)
    if len(column) and (pc.min(lengths).as_py() != dim or pc.max(lengths).as_py() != dim):
        raise ValueError(f"a vector has another length than {dim}")
    return np.asarray(column.flatten(), dtype=np.float64).reshape(len(column), dim)


def unpack(column: pa.Array, kind, width: int) -> np.ndarray:
    """A column of binaries of one size as a matrix."""
    data = b"".join(column.to_pylist())
    return (np.frombuffer(data, dtype=kind) if data else np.zeros(0, kind)).reshape(len(column), width)


def pack(rows: np.ndarray) -> pa.Array:
    """A matrix as a column of binaries, one for each row."""
    rows = np.ascontiguousarray(rows)
    size = rows.itemsize * (rows.shape[1] if rows.ndim > 1 else 1)
    offsets = np.arange(len(rows) + 1, dtype=np.int64) * size
    if offsets[-1] > np.iinfo(np.int32).max:
        raise ValueError("a batch of more than 2 GB")
    return pa.BinaryArray.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(rows.tobytes())])


def whole(values: np.ndarray, most: int) -> np.ndarray:
    """floor(1024 x) as int64; values of `most` or more, for which the sums that follow would not be exact, are an error."""
    x = np.floor(1024.0 * values)
    if x.size and np.abs(x).max() >= most:
        raise ValueError(f"a component of {most / 1024:g} or more has no exact distances")
    return x.astype(np.int64)
