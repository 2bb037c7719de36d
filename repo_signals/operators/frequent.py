"""The most frequent values of text columns, proven from summaries of bounded size."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from repo_signals.functions.columns import as_column, scalar
from repo_signals.operators.audit import text_columns
from repo_signals.session import materialize

# Values that a task keeps of each column, at first and at most; beyond that a column is counted in full.
KEPT = 1024
MOST_KEPT = 1 << 18
GROWTH = 16


def shrunk(counts: Counter, kept: int) -> int:
    """Cut a summary to ``kept`` values; what is taken off every count is the most that any value can have lost."""
    if len(counts) <= kept:
        return 0
    sizes = np.fromiter(counts.values(), np.int64, len(counts))
    off = int(np.partition(sizes, len(sizes) - kept - 1)[len(sizes) - kept - 1])
    for value in [v for v, n in counts.items() if n <= off]:
        del counts[value]
    for value in counts:
        counts[value] -= off
    return off


def summaries(df: DataFrame, columns: Sequence[str], kept: int) -> DataFrame:
    """``(column, value, n)`` with the sums of what the tasks kept, as a written table.

    ``n`` is no more than the value's true count, and less by no more than the
    column's row without a value says. A task hands over ``kept`` values at most.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, lost = [Counter() for _ in columns], [0] * len(columns)
        for batch in batches:
            for k, values in enumerate(batch.columns):
                found = pc.value_counts(values.drop_null())
                counts[k].update(dict(zip(found.field("values").to_pylist(), found.field("counts").to_pylist())))
                if len(counts[k]) > 2 * kept:
                    lost[k] += shrunk(counts[k], kept)
        for k, name in enumerate(columns):
            lost[k] += shrunk(counts[k], kept)
            values = [None, *counts[k]]
            n = [lost[k], *counts[k].values()]
            yield pa.RecordBatch.from_arrays(
                [pa.array([name] * len(n)), pa.array(values, pa.string()), pa.array(n, pa.int64())], ["column", "value", "n"]
            )

    cells = [as_column(c).cast("string").alias(f"c{k}") for k, c in enumerate(columns)]
    parts = df.select(*cells).mapInArrow(run, "column string, value string, n long")
    return materialize(parts.groupBy("column", "value").agg(F.sum("n").alias("n")), "summaries")


def counted(df: DataFrame, columns: Sequence[str], among: DataFrame | None = None) -> DataFrame:
    """Exact ``(column, value, n)``; with ``among`` only of the values listed there, which are few."""
    cells = [F.struct(F.lit(c).alias("column"), as_column(c).cast("string").alias("value")) for c in columns]
    rows = df.select(F.inline(F.array(*cells))).where(F.col("value").isNotNull())
    if among is not None:
        rows = rows.join(F.broadcast(among), ["column", "value"])
    return rows.groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))


def frequent_values(
    df: DataFrame, columns: Sequence[str] | None = None, top: int = 5, kept: int = KEPT, most: int = MOST_KEPT
) -> DataFrame:
    """Per text column its ``top`` most frequent values, ties by value: ``column, rank, value, n, pct``, all exact.

    Every task keeps the values that it finds most often; the sums of these
    summaries bound the count of every value from both sides. Where the bounds
    leave at most ``kept`` candidates for the list, only these are counted, and
    what is shuffled does not depend on the number of distinct values. Columns
    whose summaries prove nothing get larger ones, and beyond ``most`` a full
    count: in a column without frequent values the list is decided by ties.
    """
    names, found = list(columns or text_columns(df)), []
    n_rows = scalar(df.agg(F.count(F.lit(1)).alias("n")))["n"]
    while names and kept <= most:
        sums = summaries(df, names, kept)
        values = sums.where(F.col("value").isNotNull())
        order = W.partitionBy("column").orderBy(F.desc("n"))
        least = values.withColumn("rank", F.row_number().over(order)).where(F.col("rank") == top)
        lost = sums.where(F.col("value").isNull()).select("column", F.col("n").alias("lost"))
        # One row per column; a column with fewer values than asked for has no least one.
        bounds = materialize(
            lost.join(least.select("column", F.col("n").alias("least")), "column", "left").withColumn(
                "least", F.coalesce("least", F.lit(0))
            ),
            "bounds",
        ).collect()
        exact = [r["column"] for r in bounds if r["lost"] == 0]
        # At most rows / lost values can have so many, and that is about the number kept.
        proven = {r["column"]: r["least"] - r["lost"] for r in bounds if 0 < 2 * r["lost"] <= r["least"]}
        if exact:
            found.append(values.where(F.col("column").isin(exact)))
        if proven:
            needed = F.create_map(*[F.lit(x) for kv in proven.items() for x in kv])[F.col("column")]
            among = values.where(F.col("column").isin(list(proven)) & (F.col("n") >= needed)).select("column", "value")
            found.append(counted(df, list(proven), among))
        names = [c for c in names if c not in exact and c not in proven]
        kept *= GROWTH
    if names:
        found.append(counted(df, names))
    counts = found[0]
    for more in found[1:]:
        counts = counts.union(more)
    frequent = W.partitionBy("column").orderBy(F.desc("n"), F.asc("value"))
    shown = counts.withColumn("rank", F.row_number().over(frequent)).where(F.col("rank") <= top)
    return shown.select("column", "rank", "value", "n", F.round(F.lit(100.0) * F.col("n") / n_rows, 2).alias("pct"))
