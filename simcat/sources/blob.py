"""Vector blob codec as bulk jobs (S-6 import, K-2 export).

A blob is the vector as float32 little-endian bytes, stored with its dimension.
Both directions are Arrow UDFs that convert a whole batch with one buffer view:
no per-row Python.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

REASON_BLOB_SIZE = "Blob size does not match 4 * dim"


@F.arrow_udf(T.BinaryType())
def encode_f32(v: pa.Array) -> pa.Array:
    if isinstance(v, pa.ChunkedArray):
        v = v.combine_chunks()
    offs = v.offsets.to_numpy(zero_copy_only=False).astype(np.int64)
    vals = v.values.to_numpy(zero_copy_only=False)[offs[0]:offs[-1]].astype("<f4")
    rel = ((offs - offs[0]) * 4).astype(np.int32)
    out = pa.BinaryArray.from_buffers(pa.binary(), len(v), [None, pa.py_buffer(rel.tobytes()),
                                                             pa.py_buffer(vals.tobytes())])
    return pc.if_else(v.is_null(), pa.scalar(None, pa.binary()), out) if v.null_count else out


@F.arrow_udf(T.ArrayType(T.FloatType(), containsNull=False))
def decode_f32(b: pa.Array) -> pa.Array:
    if isinstance(b, pa.ChunkedArray):
        b = b.combine_chunks()
    n = len(b)
    offs = np.frombuffer(b.buffers()[1], dtype=np.int32)[b.offset:b.offset + n + 1].astype(np.int64)
    data = b.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8)[offs[0]:offs[-1]] if data is not None else np.zeros(0, np.uint8)
    floats = raw.view("<f4")
    rel = ((offs - offs[0]) // 4).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(rel), pa.array(floats, type=pa.float32()))


def export_blob_table(df: DataFrame, vector_col: str = "vector") -> DataFrame:
    """K-2: (..., vector) -> (..., blob binary, dim int)."""
    return (df.withColumn("dim", F.size(vector_col).cast("int"))
            .withColumn("blob", encode_f32(F.col(vector_col))).drop(vector_col))


def import_blob_table(df: DataFrame, blob_col: str = "blob", dim_col: str = "dim",
                      out_col: str = "vector") -> tuple[DataFrame, DataFrame]:
    """S-6: (..., blob, dim) -> (valid with ``vector``, rejects with ``reason``).

    A blob whose length is not 4 * dim is rejected before decoding."""
    ok = F.col(blob_col).isNotNull() & (F.octet_length(blob_col) == F.col(dim_col) * 4)
    valid = df.filter(ok).withColumn(out_col, decode_f32(F.col(blob_col))).drop(blob_col)
    rejects = df.filter(~F.coalesce(ok, F.lit(False))).withColumn("reason", F.lit(REASON_BLOB_SIZE))
    return valid, rejects
