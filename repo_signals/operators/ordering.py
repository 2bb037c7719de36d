"""Global order without a single-task sort: row index, hash sample, top-N with share."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from repo_signals.session import scratch_dir

# monotonically_increasing_id keeps the row position in its low 33 bits.
POSITION_MASK = (1 << 33) - 1


def with_row_index(df: DataFrame, order: Sequence[str], name: str = "row_idx") -> DataFrame:
    """Dense 0-based row index in ``order``, which must be unique per row.

    The rows are range-partitioned and sorted inside their partitions, so ties
    on the leading column are split across tasks. The layout is fixed by a
    reliable checkpoint: a lost executor cannot move a row to another position.
    Only the partition sizes (one row per partition) are summed in one task.
    """
    scratch_dir(df.sparkSession)
    laid = df.repartitionByRange(*order).sortWithinPartitions(*order).checkpoint()
    placed = laid.withColumns(
        {
            "_part": F.spark_partition_id(),
            "_pos": F.monotonically_increasing_id().bitwiseAND(F.lit(POSITION_MASK)),
        }
    )
    sizes = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_rows"))
    before = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    starts = sizes.select("_part", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_start"))
    return (
        placed.join(F.broadcast(starts), "_part")
        .withColumn(name, F.col("_start") + F.col("_pos"))
        .drop("_part", "_pos", "_start")
    )


def hash_sample(
    df: DataFrame, key: str, rows: int | None = None, fraction: float | None = None, seed: int = 42
) -> DataFrame:
    """An exact-size sample: the rows whose keyed digest comes first.

    A global ``orderBy().limit(n)`` would gather ``n`` rows per partition in one
    task. Here the digest's first 32 bits are histogrammed in two steps of 65,536
    buckets, which gives the bucket the cut falls into; all rows before it are
    kept where they are, and only the rows of that one bucket are ranked. One row
    per step reaches the driver.
    """
    digest = F.md5(F.concat_ws(":", F.col(key).cast("string"), F.lit(str(seed))))
    tagged = df.withColumn("_digest", digest).withColumns(
        {"_lead": F.substring("_digest", 1, 4), "_next": F.substring("_digest", 5, 4)}
    )

    lead_counts = tagged.groupBy("_lead").agg(F.count(F.lit(1)).alias("_rows"))
    total = F.sum("_rows").over(W.partitionBy())
    wanted = F.lit(rows).cast("long") if rows is not None else F.bround(total * F.lit(fraction)).cast("long")
    lead_cut = (
        lead_counts.withColumn("_want", F.least(wanted, total))
        .withColumn("_upto", F.sum("_rows").over(W.orderBy("_lead")))
        .where((F.col("_upto") >= F.col("_want")) & (F.col("_upto") - F.col("_rows") < F.col("_want")))
        .select("_lead", (F.col("_want") - F.col("_upto") + F.col("_rows")).alias("_need"))
    )
    lead = lead_cut.first()
    if lead is None:
        return df.limit(0)

    on_lead = F.col("_lead") == lead["_lead"]
    next_counts = tagged.where(on_lead).groupBy("_next").agg(F.count(F.lit(1)).alias("_rows"))
    leaf = (
        next_counts.withColumn("_upto", F.sum("_rows").over(W.orderBy("_next")))
        .where((F.col("_upto") >= lead["_need"]) & (F.col("_upto") - F.col("_rows") < lead["_need"]))
        .select("_next", (F.lit(lead["_need"]) - F.col("_upto") + F.col("_rows")).alias("_need"))
        .first()
    )

    before = tagged.where((F.col("_lead") < lead["_lead"]) | (on_lead & (F.col("_next") < leaf["_next"])))
    ranked = W.partitionBy("_lead", "_next").orderBy("_digest", key)
    edge = (
        tagged.where(on_lead & (F.col("_next") == leaf["_next"]))
        .withColumn("_rank", F.row_number().over(ranked))
        .where(F.col("_rank") <= leaf["_need"])
        .drop("_rank")
    )
    return before.unionByName(edge).select(*df.columns)


def top_n(df: DataFrame, order: Sequence[Column], n: int) -> DataFrame:
    """The first ``n`` rows; every task keeps at most ``n``."""
    return df.orderBy(*order).limit(n)


def top_n_share(df: DataFrame, group: str, item: str, weight: str, n: int) -> DataFrame:
    """Per group, the ``n`` heaviest items with their rank and share of the shown total.

    Weights are summed per (group, item) with partial aggregation; the rank filter
    lets Spark keep ``n`` rows per group in every task before the shuffle.
    """
    summed = df.groupBy(group, item).agg(F.sum(weight).alias(weight))
    heaviest = W.partitionBy(group).orderBy(F.desc(weight), F.asc(item))
    shown = summed.withColumn("rank", F.row_number().over(heaviest)).where(F.col("rank") <= n)
    total = F.sum(weight).over(W.partitionBy(group))
    return shown.withColumn("pct", F.round(F.lit(100.0) * F.try_divide(F.col(weight), total), 2))
