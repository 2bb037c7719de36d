"""Expanding time-ordered folds."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from repo_signals import schema
from repo_signals.functions.columns import flag, scalar
from repo_signals.operators.ordering import with_row_index
from repo_signals.session import materialize


def fold_bounds(df: DataFrame, folds: int = 3) -> DataFrame:
    """Per fold the half-open row ranges: train ``[0, test_start)``, test ``[test_start, test_end)``.

    The last ``folds`` blocks of ``n // (folds + 1)`` rows are the tests; the rest
    of the division belongs to the first train range.
    """
    n = df.agg(F.count(F.lit(1)).alias("n_rows"))
    size = F.call_function("div", F.col("n_rows"), F.lit(folds + 1))
    start = F.col("n_rows") - (F.lit(folds) - F.col("fold") + 1) * size
    return n.withColumn("fold", F.explode(F.sequence(F.lit(1), F.lit(folds)))).select(
        "fold", start.alias("test_start"), (start + size).alias("test_end"), size.alias("n_test")
    )


def with_blocks(
    df: DataFrame,
    order: Sequence[str] = ("ingested_at", "id"),
    folds: int = 3,
    name: str = "block",
) -> DataFrame:
    """Add the time block of each row: 0 for the first train range, ``i`` for the test of fold ``i``.

    Fold ``i`` trains on ``block < i`` and tests on ``block == i``. Only the order
    columns are sorted to find the first key of each test range; the wide rows are
    then labelled in place by comparing their key with those few keys.
    """
    indexed = with_row_index(df.select(*order), order)
    bounds = fold_bounds(indexed, folds)
    firsts = indexed.join(F.broadcast(bounds), F.col("row_idx") == F.col("test_start")).agg(
        *[F.max(F.when(F.col("fold") == i, F.struct(*order))).alias(f"first_{i}") for i in range(1, folds + 1)]
    )
    keys = scalar(materialize(firsts, "folds"))
    own = F.struct(*order)
    block = F.lit(0)
    for i in range(1, folds + 1):
        block = block + flag(own >= keys[f"first_{i}"])
    return df.withColumn(name, block)


def fold_stats(blocks: DataFrame, folds: int = 3) -> DataFrame:
    """Per fold: sizes, train mean of the log target, and the time edges of both sides.

    Blocks are aggregated once; fold figures are running sums over ``folds + 1`` rows.
    """
    per_block = blocks.groupBy("block").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(schema.LOG_TARGET).alias("total"),
        F.min("ingested_at").alias("first_seen"),
        F.max("ingested_at").alias("last_seen"),
    )
    earlier = W.orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    return (
        per_block.select(
            F.col("block").alias("fold"),
            F.sum("n").over(earlier).alias("n_train"),
            F.col("n").alias("n_test"),
            (F.sum("total").over(earlier) / F.sum("n").over(earlier)).alias("train_mean"),
            F.max("last_seen").over(earlier).alias("train_last_seen"),
            F.col("first_seen").alias("test_first_seen"),
        )
        .where(F.col("fold") > 0)
    )
