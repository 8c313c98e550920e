"""Embedding vectors: products, cosine, median of a small gallery, blob codecs."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, functions as F
from pyspark.sql.types import BinaryType

from hallwatch.schemas import VECTOR


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda p, q: p.cast("double") * q.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, p: acc + p)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed a single time, even when used inside a lambda."""
    return F.transform(F.array(value), use)[0]


def unit(a: Column) -> Column:
    """Unit-length double vector; a zero vector stays zero."""
    return once(norm(a), lambda length: F.transform(
        a, lambda v: F.when(length > 0, v.cast("double") / length).otherwise(F.lit(0.0))))


def unit_rows(m: np.ndarray) -> np.ndarray:
    """``unit`` of the rows of a matrix."""
    length = np.sqrt(np.einsum("ij,ij->i", m, m))[:, None]
    return np.divide(m, length, out=np.zeros_like(m), where=length > 0)


def cosine(a: Column, b: Column) -> Column:
    """Cosine in double precision; 0 when either vector has no length."""
    return once(norm(a) * norm(b), lambda lengths: F.when(lengths > 0, dot(a, b) / lengths).otherwise(F.lit(0.0)))


def median_of(values: Column) -> Column:
    """Median of a short array; the two middle values are averaged when the count is even."""
    def middle(ordered: Column) -> Column:
        n = F.size(ordered)
        low = F.element_at(ordered, F.floor((n + 1) / F.lit(2.0)).cast("int"))
        high = F.element_at(ordered, (F.floor(n / F.lit(2.0)) + 1).cast("int"))
        return F.when(n > 0, (low + high) / F.lit(2.0))

    return once(F.array_sort(values), middle)


def _from_blob(blobs: pa.Array) -> pa.Array:
    blobs = blobs.cast(pa.binary())
    size = np.diff(np.frombuffer(blobs.buffers()[1], np.int32)[blobs.offset:blobs.offset + len(blobs) + 1]) if len(blobs) else np.zeros(0, np.int32)
    if (size % 4).any():
        raise ValueError("a vector's bytes must be a multiple of four")
    values = np.frombuffer(b"".join(b.as_buffer() for b in blobs if b.is_valid), dtype="<f4")
    offsets = np.cumsum(np.r_[0, np.where(np.asarray(blobs.is_valid()), size // 4, 0)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, pa.float32()), mask=blobs.is_null())


def _to_blob(vectors: pa.Array) -> pa.Array:
    size = np.asarray(pc.fill_null(pc.list_value_length(vectors), 0))
    body = vectors.drop_null().flatten().to_numpy(zero_copy_only=False).astype("<f4").tobytes()
    ends = (np.cumsum(np.r_[0, size]) * 4).astype(np.int32)
    whole = pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(body)])
    return pc.if_else(vectors.is_valid(), whole, pa.scalar(None, pa.binary()))


# Made at each call: a function object that Spark has used holds a handle of the driver's, and this module travels with the kernels that name it.

def from_blob(blobs: Column | str) -> Column:
    """Little-endian float32 bytes to a vector; the bytes are taken over as they are."""
    return F.arrow_udf(_from_blob, VECTOR)(blobs)


def to_blob(values: Column | str) -> Column:
    return F.arrow_udf(_to_blob, BinaryType())(values)
