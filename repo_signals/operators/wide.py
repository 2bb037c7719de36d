"""Correlations of all columns of a vector, from blocked cross-products that are merged, not from one row per pair."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from math import ceil, sqrt
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Columns whose moments with all others make one row.
BLOCK_COLUMNS = 32
NAMES = ["n", "mean", "mean_t", "cross", "square", "square_t"]
MOMENTS = "part long, grp int, first int, " + ", ".join(f"{n} binary" for n in NAMES)


class Moments(NamedTuple):
    """For columns i (rows) and j over the table rows where both are known; ``_t`` is the same with i and j exchanged."""

    n: np.ndarray
    mean: np.ndarray  # of i
    mean_t: np.ndarray  # of j
    cross: np.ndarray  # centred sum of products
    square: np.ndarray  # centred sum of squares of i
    square_t: np.ndarray

    def rows(self, low: int, high: int) -> Moments:
        return Moments(*(x[low:high] for x in self))


def of_rows(x: np.ndarray) -> Moments:
    """The moments of some rows; NaN is unknown."""
    known = ~np.isnan(x)
    # Columns are shifted by a value of theirs, so that a constant one has no spread at all.
    shift = np.where(known.any(axis=0), x[known.argmax(axis=0), np.arange(x.shape[1])], 0.0)
    m, c = known.astype(float), np.where(known, x - shift, 0.0)
    n = m.T @ m
    each = np.maximum(n, 1)
    total = c.T @ m
    cross = c.T @ c - total * total.T / each
    square = (c * c).T @ m - total * total / each
    mean = total / each + shift[:, None]
    return Moments(n, mean, np.ascontiguousarray(mean.T), cross, square, np.ascontiguousarray(square.T))


def merged(a: Moments, b: Moments) -> Moments:
    """The moments of two sets of rows taken together, by Chan's formula for each pair."""
    n = a.n + b.n
    share = b.n / np.maximum(n, 1)
    d, d_t = b.mean - a.mean, b.mean_t - a.mean_t
    d, d_t = np.where((a.n > 0) & (b.n > 0), d, 0.0), np.where((a.n > 0) & (b.n > 0), d_t, 0.0)
    w = a.n * share
    first = a.n == 0
    return Moments(
        n,
        np.where(first, b.mean, a.mean + d * share),
        np.where(first, b.mean_t, a.mean_t + d_t * share),
        a.cross + b.cross + w * d * d_t,
        a.square + b.square + w * d * d,
        a.square_t + b.square_t + w * d_t * d_t,
    )


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    """The vectors as rows of doubles; a missing vector, or one of another length, is unknown throughout."""
    out = np.full((len(column), dim), np.nan)
    sizes = np.asarray(column.value_lengths().fill_null(-1))
    whole = np.flatnonzero(sizes == dim)
    if len(whole):
        values = column.take(pa.array(whole)).flatten().cast(pa.float64())
        out[whole] = values.to_numpy(zero_copy_only=False).reshape(-1, dim)
    return out


def packed(part: int, group: int, moments: Moments) -> pa.RecordBatch:
    """One row per block of columns."""
    dim = moments.n.shape[1]
    rows = []
    for low in range(0, len(moments.n), BLOCK_COLUMNS):
        rows.append((part, group, low, *(x.tobytes() for x in moments.rows(low, low + BLOCK_COLUMNS))))
    types = [pa.int64(), pa.int32(), pa.int32()] + [pa.binary()] * len(NAMES)
    assert moments.n.shape[0] == dim
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], ["part", "grp", "first", *NAMES])


def partial_moments(vectors: DataFrame, dim: int) -> DataFrame:
    """The moments of each task's rows of ``(part, grp, vector)``, one row per group and block; groups are few."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, Moments] = {}
        part = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            part = batch.column("part")[0].as_py()
            x, groups = matrix(batch.column("vector"), dim), batch.column("grp").to_numpy()
            for group in np.unique(groups).tolist():
                own = of_rows(x[groups == group])
                found[group] = merged(found[group], own) if group in found else own
        for group, moments in found.items():
            yield packed(part, group, moments)

    return vectors.mapInArrow(run, MOMENTS)


def unpacked(row: dict, dim: int) -> Moments:
    return Moments(*(np.frombuffer(row[n]).reshape(-1, dim) for n in NAMES))


def merged_moments(parts: DataFrame, dim: int, fan: int) -> DataFrame:
    """One row per group and block, merged in two steps: ``fan`` heaps of parts, then the heaps."""

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, None
        for batch in batches:
            for row in batch.to_pylist():
                key = row["part"], row["grp"], row["first"]
                own = unpacked(row, dim)
                if key != at and held is not None:
                    yield one_row(at, held)
                held = merged(held, own) if key == at else own
                at = key
        if held is not None:
            yield one_row(at, held)

    def one_row(key: tuple, held: Moments) -> pa.RecordBatch:
        values = [*key, *(x.tobytes() for x in held)]
        types = [pa.int64(), pa.int32(), pa.int32()] + [pa.binary()] * len(NAMES)
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, types)], ["part", "grp", "first", *NAMES])

    def step(rows: DataFrame, heap: Column) -> DataFrame:
        keyed = rows.withColumn("part", heap.cast("long"))
        order = ["part", "grp", "first"]
        return keyed.repartition(*order).sortWithinPartitions(*order).mapInArrow(merge, MOMENTS)

    return step(step(parts, F.col("part") % fan), F.lit(0))


def correlations_of(moments: DataFrame, dim: int) -> DataFrame:
    """``(grp, a, b, correlation)`` for every pair of columns ``a > b``; NULL where one of them is constant."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                own = unpacked(row, dim)
                spread = np.sqrt(np.maximum(own.square, 0) * np.maximum(own.square_t, 0))
                with np.errstate(divide="ignore", invalid="ignore"):
                    r = np.where(spread > 0, own.cross / spread, np.nan)
                a, b = np.nonzero(np.arange(dim)[None, :] < row["first"] + np.arange(len(r))[:, None])
                value = pa.array(r[a, b], from_pandas=True)
                columns = [np.full(len(a), row["grp"], np.int32), (a + row["first"]).astype(np.int32), b.astype(np.int32)]
                yield pa.RecordBatch.from_arrays([*map(pa.array, columns), value], ["grp", "a", "b", "correlation"])

    return moments.mapInArrow(run, "grp int, a int, b int, correlation double")


def with_part(df: DataFrame, vector: Column, group: Column) -> DataFrame:
    return df.select(F.spark_partition_id().cast("long").alias("part"), group.cast("int").alias("grp"), vector.alias("vector"))


def heaps(df: DataFrame) -> int:
    """Heaps of about as many parts as there are heaps, for the parallelism of the session."""
    return max(1, ceil(sqrt(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))))


def correlation_matrix_wide(df: DataFrame, vector: str, dim: int, prefix: str = "emb") -> DataFrame:
    """The lower triangle of the correlations of a vector's columns: ``feature_a, feature_b, correlation``.

    Each pair counts the rows where both values are known; vectors that are
    missing or of another length count for nothing. A task multiplies its rows'
    matrix with itself and hands over one set of moments, so what is shuffled
    depends on the number of columns and tasks and not on rows or values.
    """
    moments = merged_moments(partial_moments(with_part(df, F.col(vector), F.lit(0)), dim), dim, heaps(df))
    found = correlations_of(moments, dim)
    a, b = (F.concat(F.lit(f"{prefix}_"), c) for c in ("a", "b"))
    return found.select(a.alias("feature_a"), b.alias("feature_b"), "correlation")


def target_correlations_by_prefix(df: DataFrame, columns: Sequence[Column], block: str, folds: int) -> DataFrame:
    """``(fold, b, correlation)`` of each column but the last with the last, over the rows of the blocks before each fold."""
    dim = len(columns)
    trained = df.where(F.col(block) < folds)
    parts = partial_moments(with_part(trained, F.array(*columns), F.col(block)), dim)
    nested = parts.withColumn("grp", F.explode(F.sequence(F.col("grp") + 1, F.lit(folds))))
    found = correlations_of(merged_moments(nested, dim, heaps(df)), dim)
    return found.where(F.col("a") == dim - 1).select(F.col("grp").alias("fold"), "b", "correlation")
