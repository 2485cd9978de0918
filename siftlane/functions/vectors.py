"""Dense vectors: norm, inner product, byte form and signatures."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, FloatType, StringType


def dot(a: Column | str, b: Column | str) -> Column:
    """Inner product in DOUBLE, in the order of elements; null if the lengths differ."""
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    return F.when(F.size(a) == F.size(b), F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x))


def norm(v: Column | str) -> Column:
    return F.sqrt(dot(v, v))


def l2_normalize(v: Column | str) -> Column:
    """Unit vector in DOUBLE; null for a zero vector and one with a null or NaN."""
    c = F.col(v) if isinstance(v, str) else v
    n = norm(c)
    return F.when((n > 0) & ~F.isnan(n), F.transform(c, lambda x: x.cast("double") / n))


def checked_unit(v: Column | str, dim: int) -> Column:
    """As ``l2_normalize``, but a zero vector, one with a null or NaN, or one of another length is an error."""
    c = F.col(v) if isinstance(v, str) else v
    wrong = F.when(F.size(c) != dim, f"a vector does not have {dim} elements").when(l2_normalize(c).isNull(), "a vector cannot be normalised")
    return F.when(wrong.isNotNull(), F.raise_error(wrong).cast("array<double>")).otherwise(l2_normalize(c))


def is_usable(v: Column | str, dim: Column | int) -> Column:
    """Whether ``v`` has ``dim`` elements, none null or NaN, and not all zero."""
    c = F.col(v) if isinstance(v, str) else v
    return F.coalesce((F.size(c) == dim) & F.forall(c, lambda x: x.isNotNull() & ~F.isnan(x)) & F.exists(c, lambda x: x != 0), F.lit(False))


@F.arrow_udf(BinaryType())
def to_bytes(vectors: pa.Array) -> pa.Array:
    """Little-endian float32 bytes of a vector; the elements' buffer is taken as it is."""
    flat = np.ascontiguousarray(vectors.flatten().fill_null(float("nan")).to_numpy(zero_copy_only=False), "<f4")
    ends = np.append(0, np.cumsum(pc.fill_null(pc.list_value_length(vectors), 0).to_numpy(zero_copy_only=False) * 4)).astype("<i4")
    whole = pa.Array.from_buffers(pa.binary(), len(vectors), [None, pa.py_buffer(ends), pa.py_buffer(flat)])
    return pc.if_else(vectors.is_valid(), whole, pa.scalar(None, pa.binary()))


@F.arrow_udf(ArrayType(FloatType()))
def from_bytes(blobs: pa.Array) -> pa.Array:
    """The vector of little-endian float32 bytes; null if their number is no multiple of 4."""
    size = pc.binary_length(blobs)
    fine = pc.fill_null(pc.equal(pc.bit_wise_and(size, 3), 0), False)
    kept = pc.if_else(fine, blobs, pa.scalar(b"", blobs.type))
    ends = np.append(0, np.cumsum(pc.fill_null(pc.binary_length(kept), 0).to_numpy(zero_copy_only=False) // 4)).astype("<i4")
    flat = np.frombuffer(b"".join(kept.to_pylist()), "<f4")
    whole = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.float32()))
    return pc.if_else(fine, whole, pa.scalar(None, pa.list_(pa.float32())))


@F.arrow_udf(StringType())
def vector_signature(frames: pa.Array) -> pa.Array:
    """SHA-256 over frames (frame_index, position_millis, vector) in the given order.

    Per frame: frame_index as big-endian int32, position_millis as big-endian int64, elements as little-endian float32.
    """
    flat = frames.flatten()
    index, at = flat.field("frame_index").fill_null(0).to_numpy(zero_copy_only=False).astype(">i4"), flat.field("position_millis").fill_null(0).to_numpy(zero_copy_only=False).astype(">i8")
    vectors = flat.field("vector")
    x, ends = np.ascontiguousarray(vectors.flatten().to_numpy(zero_copy_only=False), "<f4"), np.append(0, np.cumsum(pc.fill_null(pc.list_value_length(vectors), 0).to_numpy(zero_copy_only=False)))
    out, frame = [], 0
    for valid, n in zip(frames.is_valid().to_pylist(), pc.fill_null(pc.list_value_length(frames), 0).to_pylist(), strict=True):
        digest = hashlib.sha256()
        for k in range(frame, frame + n):
            digest.update(index[k : k + 1].tobytes() + at[k : k + 1].tobytes())
            digest.update(x[ends[k] : ends[k + 1]])
        out.append(digest.hexdigest() if valid else None)
        frame += n
    return pa.array(out, pa.string())


def sha256_hex(data: Column | str) -> Column:
    return F.sha2(data, 256)
