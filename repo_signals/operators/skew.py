"""A left join that splits heavy keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from repo_signals.session import materialize

# A piece of a heavy key holds at most 1/SLOTS of all rows, or LIGHT_ROWS if that is more.
SLOTS = 4096
LIGHT_ROWS = 100_000


def left_join_spread(
    rows: DataFrame,
    lookup: DataFrame,
    key: str,
    weight: str | None,
    spread_on: str,
    slots: int | None = None,
    light_rows: int | None = None,
    counts: DataFrame | None = None,
) -> DataFrame:
    """``rows`` LEFT JOIN ``lookup`` on ``key``, for a lookup with one row per key.

    ``lookup[weight]`` is the number of rows of the key, or ``counts[weight]`` where
    the lookup is expensive to read twice; without a ``weight`` the rows of each key
    are counted first. A key with more rows than a
    piece may hold is cut into as many pieces as it needs, by a hash of ``spread_on``,
    and its lookup row repeated once per piece. As a piece is at least 1/slots of all
    rows, fewer than ``slots`` keys can be that heavy and the repeats number at most
    ``2 * slots``, so their list may be collected and broadcast. Rows without a key
    are spread the same way. When the lookup is small AQE broadcasts it and the
    pieces cost nothing.
    """
    slots, light_rows = slots or SLOTS, light_rows or LIGHT_ROWS
    if weight is None:
        per_key = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
        sizes = materialize(per_key, "sizes")
    else:
        sizes = (lookup if counts is None else counts).select(key, F.col(weight).alias("_n"))
    total = sizes.agg(F.sum("_n").alias("total")).first()["total"] or 0
    piece_rows = max(total / slots, light_rows)
    # An empty list, where no key is heavy, needs no path of its own.
    heavy = sizes.where(F.col("_n") > piece_rows)
    heavy = heavy.select(key, F.ceil(F.col("_n") / F.lit(float(piece_rows))).cast("int").alias("_pieces"))
    nowhere = F.pmod(F.xxhash64(spread_on), F.lit(slots)).cast("int")
    listed = F.broadcast(rows.sparkSession.createDataFrame(heavy.collect(), heavy.schema))
    pieces = F.coalesce("_pieces", F.lit(1))
    own_piece = F.pmod(F.xxhash64(spread_on), pieces).cast("int")
    left = (
        rows.join(listed, key, "left")
        .withColumn("_piece", F.when(F.col(key).isNull(), nowhere).otherwise(own_piece))
        .drop("_pieces")
    )
    right = (
        lookup.join(listed, key, "left")
        .withColumn("_piece", F.explode(F.sequence(F.lit(0), pieces - 1)))
        .drop("_pieces")
    )
    return left.join(right, [key, "_piece"], "left").drop("_piece")
