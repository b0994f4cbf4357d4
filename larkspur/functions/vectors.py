"""Vector functions as column expressions."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from larkspur.functions.text import col


def smoothed_idf(n: Column | str, df: Column | str) -> Column:
    return F.log((col(n) + 1) / (col(df) + 1)) + 1


def norm(v: Column | str) -> Column:
    return F.sqrt(F.aggregate(col(v), F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def normalize(v: Column | str) -> Column:
    """Unit length; a zero vector stays as it is."""
    v = col(v)
    return F.get(F.transform(F.array(F.struct(v.alias("v"), norm(v).alias("n"))), lambda s: F.when(s["n"] > 0, F.transform(s["v"], lambda x: x.cast("double") / s["n"])).otherwise(F.transform(s["v"], lambda x: x.cast("double")))), 0)


def cosine(a: Column | str, b: Column | str) -> Column:
    """Dot product of unit vectors; 0 for different lengths."""
    a, b = col(a), col(b)
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    return F.when(F.size(a) == F.size(b), dot).otherwise(F.lit(0.0))


def to_bytes(values: list[float]) -> bytes:
    """Little-endian 32-bit floats."""
    import numpy as np

    return np.asarray(values, "<f4").tobytes()


def from_bytes(raw: bytes | None) -> list[float] | None:
    """The floats of to_bytes; None for nothing or a length that is no multiple of four."""
    import numpy as np

    return None if not raw or len(raw) % 4 else np.frombuffer(raw, "<f4").astype(float).tolist()


def _whole(array: pa.Array) -> tuple[pa.Array, list]:
    """An array without an offset, and its buffers."""
    array = pa.concat_arrays([array]) if array.offset else array
    return array, array.buffers()


def pack_floats(values: pa.Array) -> pa.Array:
    """Lists of 32-bit floats as little-endian bytes: the same memory with other offsets. Null for null and empty lists and for those that hold a null."""
    import numpy as np

    lists = values.cast(pa.list_(pa.float32()))
    whole = lists.is_valid().to_numpy(zero_copy_only=False)
    sizes = np.where(whole, lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False), 0)
    flat = lists.flatten()
    if flat.null_count:
        ends = np.cumsum(sizes)
        holes = np.concatenate([[0], np.cumsum(flat.is_null().to_numpy(zero_copy_only=False))])
        whole &= holes[ends] == holes[ends - sizes]
        flat = flat.fill_null(0.0)
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64) * 4
    flat, (_, data) = _whole(flat)
    mask = np.packbits(whole & (sizes > 0), bitorder="little")
    out = pa.Array.from_buffers(pa.large_binary(), len(lists), [pa.py_buffer(mask.tobytes()), pa.py_buffer(offsets.tobytes()), data or pa.py_buffer(b"")])
    return out.cast(pa.binary())


def unpack_floats(raw: pa.Array) -> pa.Array:
    """Little-endian bytes as lists of 32-bit floats. Null for null and empty bytes and for a length that is no multiple of four."""
    import numpy as np
    import pyarrow.compute as pc

    sizes = pc.binary_length(raw).fill_null(0).to_numpy(zero_copy_only=False)
    good = (sizes > 0) & (sizes % 4 == 0)
    kept = raw.cast(pa.large_binary()).filter(pa.array(good))
    kept, buffers = _whole(kept)
    offsets = np.concatenate([[0], np.cumsum(np.where(good, sizes // 4, 0))]).astype(np.int32)
    flat = pa.Array.from_buffers(pa.float32(), int(offsets[-1]), [None, buffers[2] if len(kept) else pa.py_buffer(b"")])
    return pa.ListArray.from_arrays(pa.array(offsets), flat, mask=pa.array(~good))


def floats_to_bytes(v: Column | str) -> Column:
    """pack_floats() of a column, a batch at a time."""
    return F.arrow_udf(pack_floats, "binary")(col(v).cast("array<float>"))


def bytes_to_floats(raw: Column | str) -> Column:
    """unpack_floats() of a column, a batch at a time."""
    return F.arrow_udf(unpack_floats, "array<float>")(col(raw).cast("binary"))
