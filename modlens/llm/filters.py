"""A membership filter of fixed size, to keep texts out of joins that cannot need them."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import textops as T

BITS = 1 << 26
_BUCKET = 32768  # positions in one of Spark's bitmaps


def of(df: DataFrame, key: str, hashed: bool = False) -> bytes:
    """One bit for each hash of the long column `key` (itself a hash if hashed), 8 MB whatever the input: a bit
    that is not set says surely that a key is absent; a set one says nothing, so a join has to follow."""
    at = F.pmod(F.col(key) if hashed else F.xxhash64(key), F.lit(BITS)) + 1
    rows = df.groupBy(F.bitmap_bucket_number(at).alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("bits")).collect()
    out = np.zeros(BITS // 8 + _BUCKET // 8, np.uint8)
    for r in rows:
        begin = (r["k"] - 1) * (_BUCKET // 8)
        own = np.frombuffer(bytes(r["bits"]), np.uint8)
        out[begin : begin + len(own)] |= own
    return out.tobytes()


def holds(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which of the hashes may be in the filter."""
    p = np.mod(hashes, BITS)
    return ((bits[p >> 3] >> (p & 7).astype(np.uint8)) & 1).astype(bool)


def only(df: DataFrame, key: str, bits: bytes) -> DataFrame:
    """The rows of df whose key may be in the filter."""
    sent = df.sparkSession.sparkContext.broadcast(bits)
    at = df.select("*", F.pmod(F.xxhash64(key), F.lit(BITS)).alias("_at"))
    schema = df.schema

    def run(batches):
        own = np.frombuffer(sent.value, np.uint8)
        for b in batches:
            yield b.filter(pa.array(holds(own, b.column("_at").to_numpy()))).drop_columns(["_at"])

    return at.transform(T.mapped, run, schema)
