"""Exact quantiles with linear interpolation, distributed."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from repo_signals.functions.columns import flag, present, scalar
from repo_signals.session import materialize


def count_values(df: DataFrame, columns: Sequence[str], weight: str | None = None) -> DataFrame:
    """How often each value of each column occurs: a written table ``(column, value, _w)``, from one pass.

    NULL and NaN are left out; ``weight`` counts a row several times.
    """
    times = F.lit(1).cast("long") if weight is None else F.col(weight).cast("long")
    cells = [F.struct(F.lit(c).alias("column"), present(c).alias("value")) for c in columns]
    counted = (
        df.select(times.alias("_w"), F.inline(F.array(*cells)))
        .where(F.col("value").isNotNull())
        .groupBy("column", "value")
        .agg(F.sum("_w").alias("_w"))
    )
    return materialize(counted, "counts")


def quantiles_of(counted: DataFrame, probs: Sequence[float]) -> DataFrame:
    """Rows ``(column, prob, value)`` from value counts, with linear interpolation between neighbours.

    The distinct values are range-partitioned; each partition's weights are summed,
    running sums over partitions give every value its place, and only the values
    that hold a wanted rank remain. No task needs more than one partition, and an
    infinite value is a value like others.
    """
    laid = counted.repartitionByRange("column", "value").withColumn("_part", F.spark_partition_id())
    laid = materialize(laid, "ranked")
    parts = laid.groupBy("column", "_part").agg(F.sum("_w").alias("_in"))
    before = W.partitionBy("column").orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    # One row per column and partition.
    starts = parts.select(
        "column",
        "_part",
        F.coalesce(F.sum("_in").over(before), F.lit(0)).alias("_start"),
        F.sum("_in").over(W.partitionBy("column")).alias("_total"),
    )
    inside = F.sum("_w").over(W.partitionBy("column", "_part").orderBy("value"))
    placed = laid.withColumn("_inside", inside).join(starts, ["column", "_part"])
    upto = F.col("_start") + F.col("_inside")

    def held(rank: Column) -> Column:
        return F.max(F.when((rank < upto) & (rank >= upto - F.col("_w")), F.col("value")))

    ends, items = [], []
    for i, p in enumerate(probs):
        at = F.lit(float(p)) * (F.col("_total") - 1)
        ends += [held(F.floor(at)).alias(f"_a{i}"), held(F.ceil(at)).alias(f"_b{i}"), F.max(at - F.floor(at)).alias(f"_t{i}")]
        low, high = F.col(f"_a{i}"), F.col(f"_b{i}")
        value = F.when(low == high, low).otherwise(low + (high - low) * F.col(f"_t{i}"))
        items.append(F.struct(F.lit(float(p)).alias("prob"), value.alias("value")))
    return placed.groupBy("column").agg(*ends).select("column", F.inline(F.array(*items)))


def exact_quantiles(
    df: DataFrame,
    columns: Sequence[str],
    probs: Sequence[float],
    weight: str | None = None,
) -> DataFrame:
    """Rows ``(column, prob, value)``, from one pass over ``df``."""
    return quantiles_of(count_values(df, columns, weight), probs)


# Ranks from a sketch are off by one in this many rows at most.
ACCURACY = 10_000


def sketch_quantiles(df: DataFrame, columns: Sequence[str], probs: Sequence[float], accuracy: int = ACCURACY) -> DataFrame:
    """Rows ``(column, prob, value)`` from one mergeable sketch per column, in one pass and without shuffling values.

    A value is one that occurs, and its rank is off by ``1 / accuracy`` of the
    rows at most. ``exact_quantiles`` gives the figures without an error.
    """
    asked = F.array(*[F.lit(float(p)) for p in probs])
    sketches = df.agg(*[F.percentile_approx(present(c), asked, accuracy).alias(f"_q{i}") for i, c in enumerate(columns)])
    rows = [
        F.struct(F.lit(c).alias("column"), F.lit(float(p)).alias("prob"), F.get(F.col(f"_q{i}"), F.lit(k)).alias("value"))
        for i, c in enumerate(columns)
        for k, p in enumerate(probs)
    ]
    return sketches.select(F.inline(F.array(*rows)))


def judged_sketch(df: DataFrame, columns: Sequence[str], probs: Sequence[float], accuracy: int = ACCURACY) -> DataFrame:
    """``sketch_quantiles`` with the true ranks of its values, from a second pass, and whether they keep the stated error."""
    found = materialize(sketch_quantiles(df, columns, probs, accuracy), "sketch")
    # One row per column and probability.
    wide = scalar(found.groupBy().agg(F.map_from_entries(F.collect_list(F.struct(F.struct("column", "prob"), "value"))).alias("q")))["q"]
    counts, rows = [], []
    for i, c in enumerate(columns):
        counts.append(F.count(present(c)).alias(f"_n{i}"))
        for k, p in enumerate(probs):
            value = wide[F.struct(F.lit(c).alias("column"), F.lit(float(p)).alias("prob"))]
            counts += [F.count_if(present(c) < value).alias(f"_b{i}_{k}"), F.count_if(present(c) <= value).alias(f"_u{i}_{k}")]
            n, below, upto = F.col(f"_n{i}"), F.col(f"_b{i}_{k}"), F.col(f"_u{i}_{k}")
            slack = n / F.lit(float(accuracy)) + 1
            ok = (below - slack <= F.lit(float(p)) * n) & (F.lit(float(p)) * n <= upto + slack)
            names = F.lit(c).alias("column"), F.lit(float(p)).alias("prob")
            rows.append(F.struct(*names, n.alias("n"), below.alias("below"), upto.alias("upto"), flag(ok).alias("rank_ok")))
    judged = df.agg(*counts).select(F.inline(F.array(*rows)))
    return found.join(F.broadcast(judged), ["column", "prob"])


def medians(df: DataFrame, columns: Sequence[str], weight: str | None = None) -> dict[str, float]:
    """The median of each column, computed now; one number per column reaches the driver."""
    return {r["column"]: r["value"] for r in exact_quantiles(df, columns, [0.5], weight).collect()}
