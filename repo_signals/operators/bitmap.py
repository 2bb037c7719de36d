"""Bitmaps of bounded size that tell tasks which keys are asked for."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

# One row of a bitmap holds so many bits.
BUCKET = 32768
LEAST_BITS, MOST_BITS = 20, 29


def asked_slots(keys: DataFrame, hashed: str, n: int) -> tuple[np.ndarray, int]:
    """A bit for the last bits of each hash, sixteen per key: built in the tasks, and no more than 64 MB.

    Keys that nobody asked for may share a bit, so a join must follow; the more
    keys there are beyond the limit, the fewer rows the bitmap saves.
    """
    bits = min(MOST_BITS, max(LEAST_BITS, int(16 * max(n, 1) - 1).bit_length()))
    slot = F.col(hashed).bitwiseAND((1 << bits) - 1) + 1
    bucket, place = (F.call_function(f, slot) for f in ("bitmap_bucket_number", "bitmap_bit_position"))
    rows = keys.groupBy((bucket - 1).alias("bucket")).agg(F.call_function("bitmap_construct_agg", place).alias("bits"))
    found = np.zeros(1 << (bits - 3), np.uint8)
    for row in rows.toLocalIterator():
        low = row["bucket"] * (BUCKET // 8)
        found[low : low + BUCKET // 8] = np.frombuffer(bytes(row["bits"]), np.uint8)
    return found, bits


def is_asked(df: DataFrame, slots: tuple[np.ndarray, int], hashed: Column) -> Column:
    """Whether a key may be among those asked for."""
    shared = df.sparkSession.sparkContext.broadcast(slots)  # bounded by MOST_BITS

    @arrow_udf("boolean")
    def test(hashes: pa.Array) -> pa.Array:
        found, bits = shared.value
        slot = hashes.to_numpy() & np.int64((1 << bits) - 1)
        return pa.array((found[slot >> 3] >> (slot & 7).astype(np.uint8) & 1).astype(bool))

    return test(hashed)
