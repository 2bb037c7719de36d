"""Bitmaps of fixed size that tell tasks which hashes are asked for."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SLOT_BITS = 23
BUCKET = 32768


def bitmap_rows(values: DataFrame, *by: str) -> DataFrame:
    """Bitmaps of 32,768 bits for the non-negative ``value``, built in the tasks; put together in one, as they are of bounded size."""
    # The functions count from 1.
    bucket, place = (F.call_function(f, F.col("value") + 1) for f in ("bitmap_bucket_number", "bitmap_bit_position"))
    rows = values.groupBy(*by, (bucket - 1).alias("bucket")).agg(F.call_function("bitmap_construct_agg", place).alias("bits"))
    return rows.coalesce(1)


def bits_of(row) -> np.ndarray:
    return np.unpackbits(np.frombuffer(bytes(row["bits"]), np.uint8), bitorder="little").astype(bool)


def slot_bitmap(rows: DataFrame, hashed: str) -> np.ndarray:
    """One bit for the last 23 bits of each hash, packed into 2^20 bytes whatever the number of rows.

    Hashes that are not asked for may share a bit, so a join must follow; what
    the bitmap saves is to send the others there.
    """
    found = np.zeros(1 << SLOT_BITS, bool)
    values = rows.select(F.col(hashed).bitwiseAND((1 << SLOT_BITS) - 1).alias("value")).distinct()
    for row in bitmap_rows(values).toLocalIterator():
        found[row["bucket"] * BUCKET : (row["bucket"] + 1) * BUCKET] = bits_of(row)
    return np.packbits(found, bitorder="little")


def is_set(bitmap: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    slot = hashes & np.int64((1 << SLOT_BITS) - 1)
    return (bitmap[slot >> 3] >> (slot & 7).astype(np.uint8) & 1).astype(bool)
