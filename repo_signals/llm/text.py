"""Word and hash arithmetic over the byte buffers of Arrow text columns.

A word is a run of bytes other than blank and 0x09-0x0D. Those bytes never occur
inside a UTF-8 character, so everything here works on bytes and never decodes.
"""

from __future__ import annotations

import tempfile
import zipfile
from collections.abc import Iterator
from pathlib import Path
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

import repo_signals

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
CHUNK_BYTES = 1 << 20
# Rows of text sent to Python at once; a batch of long texts must still fit a worker.
BATCH_ROWS = 256

U64 = np.uint64
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case, every other character as it is."""
    return F.translate(text, UPPER, UPPER.lower())


def python_ready(spark: SparkSession) -> None:
    """Let this session's Python tasks import the package, and keep their Arrow batches small enough for long texts.

    The package goes out as a zip file through Spark, once per application, so
    executors need not have it installed.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    context = spark.sparkContext
    if getattr(context, "_repo_signals_sent", False):
        return
    root = Path(repo_signals.__file__).parent
    archive = Path(tempfile.mkdtemp()) / "repo_signals_package.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for module in sorted(root.rglob("*.py")):
            out.write(module, module.relative_to(root.parent))
    context.addPyFile(str(archive))
    context._repo_signals_sent = True


def id_and_text(docs: DataFrame) -> DataFrame:
    """``doc_id`` and whole ``text``; other columns are left behind, so their names cannot clash."""
    python_ready(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all rows in one array, and the offset of each row; null counts as empty."""
    if column.null_count:
        column = pc.fill_null(column, "")
    if not pa.types.is_string(column.type):
        column = column.cast(pa.string())
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, at, body = column.buffers()
    offsets = np.frombuffer(at, np.int32, n + 1, column.offset * 4).astype(np.int64)
    data = np.frombuffer(body, np.uint8) if body is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of whole rows of about ``limit`` bytes: first row, row after the last, bytes, offsets."""
    data, offsets = utf8(column)
    low, n = 0, len(offsets) - 1
    while low < n:
        high = max(low + 1, int(np.searchsorted(offsets, offsets[low] + limit, "right")) - 1)
        yield low, high, data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low]
        low = high


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: every input bit reaches every output bit."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
        return x ^ (x >> U64(31))


# One pseudo-random number per byte value, and one in which A-Z count as a-z.
BYTE_CODE = mix(np.arange(1, 257, dtype=U64) * U64(0x9E3779B97F4A7C15))
FOLDED_CODE = BYTE_CODE.copy()
FOLDED_CODE[0x41:0x5B] = BYTE_CODE[0x61:0x7B]

_BASE = 0xD6E8FEB86659FD93
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: list[np.ndarray] = [np.ones(1, U64), np.ones(1, U64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of the base and of its inverse, modulo 2^64."""
    if len(_powers[0]) < n:
        with np.errstate(over="ignore"):
            for k, base in enumerate((_BASE, _INVERSE)):
                steps = np.full(2 * n, base, U64)
                steps[0] = 1
                _powers[k] = np.cumprod(steps)
    return _powers[0][:n], _powers[1][:n]


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, code: np.ndarray = BYTE_CODE) -> np.ndarray:
    """A 64-bit hash of each span of bytes, in time that does not depend on the spans' lengths."""
    up, down = powers(len(data) + 1)
    total = np.zeros(len(data) + 1, U64)
    with np.errstate(over="ignore"):
        np.cumsum(code[data] * up[:-1], out=total[1:])
        return mix((total[end] - total[start]) * down[start])


class Words(NamedTuple):
    start: np.ndarray  # first byte of each word
    end: np.ndarray  # byte after its last
    first: np.ndarray  # number of words before each row, and the total

    @property
    def row(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def words(data: np.ndarray, offsets: np.ndarray, is_gap: np.ndarray = IS_SPACE) -> Words:
    space = np.ones(len(data) + 2, bool)
    space[1:-1] = is_gap[data]
    inside = ~space[1:-1]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    start = np.flatnonzero(inside & (space[:-2] | edge[:-1]))
    end = np.flatnonzero(inside & (space[2:] | edge[1:])) + 1
    return Words(start, end, np.searchsorted(start, offsets))


def spaced(data: np.ndarray, found: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The words with one blank after each, and where each then starts and ends; a run of words is one span of these bytes."""
    size = found.end - found.start
    start = np.cumsum(size + 1) - size - 1
    body = np.full(int(size.sum()) + len(size), 0x20, np.uint8)
    shift = np.repeat(found.start - start, size)
    at = np.arange(len(shift)) + np.repeat(np.arange(len(size)), size)
    body[at] = data[at + shift]
    return body, start, start + size


def window_hashes(hashes: np.ndarray, width: int) -> np.ndarray:
    """A hash of every ``width`` neighbouring hashes, also of those that cross rows."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, U64)
    total = np.zeros(n, U64)
    with np.errstate(over="ignore"):
        for k in range(width):
            total += hashes[k : k + n] * U64((2 * k + 3) * 0x9E3779B97F4A7C15 & (1 << 64) - 1 | 1)
    return mix(total)


def row_sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sum of each row's values; rows may be empty."""
    total = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=total[1:])
    return total[first[1:]] - total[first[:-1]]
