"""Integer codes for categories."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from repo_signals import schema
from repo_signals.functions.columns import lookup
from repo_signals.operators.ordering import with_row_index
from repo_signals.operators.skew import left_join_spread
from repo_signals.session import materialize


def fit_codes(df: DataFrame, column: str) -> DataFrame:
    """``(column, code, n_rows)``: the rank of each distinct value in text order, from 0.

    Works for any number of categories: the values are counted with partial
    aggregation and ranked across tasks.
    """
    values = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("n_rows"))
    return materialize(with_row_index(values, [column], "code"), "codes")


def apply_codes(
    df: DataFrame,
    codes: DataFrame,
    column: str,
    out: str,
    row_id: str,
    unseen: int = -1,
    same_rows: bool = True,
) -> DataFrame:
    """Add the code of each row's category; a category the fit did not see gets ``unseen``.

    Heavy categories are known from the fit. For other rows than those of the fit,
    ``same_rows=False`` counts them anew.
    """
    wanted = codes.select(column, F.col("code").alias(out), *(["n_rows"] if same_rows else []))
    found = left_join_spread(df, wanted, column, "n_rows" if same_rows else None, row_id)
    return found.withColumn(out, F.coalesce(F.col(out), F.lit(unseen))).drop("n_rows")


def fixed_language_code(
    df: DataFrame,
    column: str = "language",
    out: str = "language_code",
    codes: Mapping[str, int] = schema.LANGUAGE_CODES,
) -> DataFrame:
    """Codes of the fixed serving map; anything else, or nothing, gets the unknown code."""
    return df.withColumn(out, lookup(column, codes, schema.UNKNOWN_LANGUAGE_CODE))
