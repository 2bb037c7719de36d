"""Preprocessing: dates, target, filters, missing values, column contracts."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from repo_signals import schema
from repo_signals.functions.columns import missing, present, utc, whole_days
from repo_signals.operators.quantiles import medians


def preprocess(df: DataFrame, max_age_days: int | None = None) -> DataFrame:
    """Parse dates, add ``age_days`` and ``log_stars``, name missing languages.

    With ``max_age_days`` rows younger than 0 or older than that are dropped, as
    are rows whose age is unknown; without it every row stays.
    """
    out = df.withColumns({"created_at": utc("created_at"), "ingested_at": utc("ingested_at")}).withColumns(
        {"age_days": whole_days("ingested_at", "created_at"), schema.LOG_TARGET: F.log1p(schema.TARGET)}
    )
    if "language" in out.columns:
        out = out.withColumn("language", F.coalesce("language", F.lit("Unknown")))
    return out if max_age_days is None else age_filter(out, max_age_days)


def age_filter(df: DataFrame, max_age_days: int = schema.MAX_AGE_DAYS) -> DataFrame:
    return df.where(F.col("age_days").between(0, max_age_days))


def preprocess_violations(df: DataFrame) -> DataFrame:
    """One row that counts what preprocessing promised not to leave behind."""
    return df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(F.col("age_days").isNull()).alias("null_age_days"),
        F.count_if(F.col(schema.LOG_TARGET).isNull()).alias("null_log_stars"),
    )


def assert_preprocessed(df: DataFrame) -> None:
    row = preprocess_violations(df).first()
    if row.null_age_days or row.null_log_stars:
        raise AssertionError(f"nulls after preprocessing: {row.asDict()}")


def temporal_split(df: DataFrame, cutoff: str, column: str = "created_at") -> tuple[DataFrame, DataFrame]:
    """Rows before the cutoff, and rows at or after it."""
    when = F.lit(cutoff).cast("timestamp")
    return df.where(utc(column) < when), df.where(utc(column) >= when)


def temporal_split_counts(df: DataFrame, cutoff: str, column: str = "created_at") -> DataFrame:
    """Sizes of both sides of the split in one pass, with a warning for a small test side."""
    when = F.lit(cutoff).cast("timestamp")
    counts = df.agg(
        F.count_if(utc(column) < when).alias("train"), F.count_if(utc(column) >= when).alias("test")
    )
    return counts.unpivot([], ["train", "test"], "side", "n_rows").withColumn(
        "small_test",
        F.when((F.col("side") == "test") & (F.col("n_rows") < schema.SMALL_TEST_ROWS), 1).otherwise(0),
    )


def select_features(df: DataFrame, names: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """The wanted columns that exist, in the wanted order."""
    have = set(df.columns)
    return df.select(*keep, *[c for c in names if c in have])


def null_fractions(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.agg(*[F.avg(missing(df, c).cast("double")).alias(c) for c in columns])


def drop_sparse_columns(df: DataFrame, columns: Sequence[str] | None = None, limit: float = 0.5) -> DataFrame:
    """Drop columns of which more than ``limit`` is NULL or NaN. One pass, one row to the driver."""
    judged = list(columns or df.columns)
    shares = null_fractions(df, judged).first()
    return df.drop(*[c for c in judged if shares[c] is not None and shares[c] > limit])


def fill_sentinel(df: DataFrame, columns: Sequence[str] | None = None, value: float = -1) -> DataFrame:
    """Replace NULL and NaN in numeric columns."""
    return df.fillna(value, subset=list(columns) if columns else None)


def impute_median(
    df: DataFrame,
    columns: Sequence[str],
    source: DataFrame | None = None,
    weight: str | None = None,
) -> DataFrame:
    """Fill gaps with the exact median.

    The median is taken over the rows of ``df``. Where a column holds one value
    per group, passing the group table as ``source`` and its row count as
    ``weight`` gives the same median without reading the rows again.
    """
    middle = medians(df if source is None else source, columns, weight)
    return df.withColumns({c: F.coalesce(present(c), F.lit(middle.get(c)).cast("double")) for c in columns})


def align_columns(df: DataFrame, names: Sequence[str], keep: Sequence[str] = (), fill: float = -1.0) -> DataFrame:
    """Exactly the contract's columns as floats, in its order; what is missing becomes ``fill``."""
    have = set(df.columns)
    aligned = [
        (F.coalesce(present(c), F.lit(fill)) if c in have else F.lit(fill)).cast("float").alias(c) for c in names
    ]
    return df.select(*keep, *aligned)


def apply_defaults(df: DataFrame, defaults: Mapping[str, object]) -> DataFrame:
    """Replace missing fields by their defaults; a column that is absent is added."""
    have = set(df.columns)
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(v)) if c in have else F.lit(v) for c, v in defaults.items()})
