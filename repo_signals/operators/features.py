"""Text, topic and velocity features."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from repo_signals import schema
from repo_signals.functions.columns import array_spread, at_least, contains_any, flag, matches_any, strip


def topic_text(df: DataFrame, columns: Sequence[str]) -> Column | None:
    """The existing text columns in lower case, joined by a blank; missing text counts as empty."""
    have = [c for c in columns if c in df.columns]
    if not have:
        return None
    return F.lower(F.concat_ws(" ", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in have]))


def topic_flags(
    df: DataFrame,
    columns: Sequence[str] = ("name", "full_name", "description"),
    topics: Mapping[str, Sequence[str]] = schema.TOPIC_PATTERNS,
    mode: str = "regex",
    count_name: str = "topic_count",
) -> DataFrame:
    """One 0/1 column per topic and their sum.

    ``mode='regex'`` reads keywords as patterns (training side), ``'substring'``
    as plain text (serving side). There are no word boundaries: ``rag`` is found
    in ``storage``. Only this call's own topics are counted, so a second run with
    the same topics gives the same result.
    """
    text = topic_text(df, columns)
    if text is None:
        return df.withColumns({t: F.lit(0) for t in [*topics, count_name]})
    finders = {"regex": matches_any, "substring": contains_any}
    if mode not in finders:
        raise ValueError(f"unknown mode {mode!r}")
    # A column of its own, so that the joined lower-case text is built once per row.
    searched = df.withColumn("_text", text)
    hits = {t: flag(finders[mode](F.col("_text"), words)) for t, words in topics.items()}
    flagged = searched.withColumns(hits).drop("_text")
    total = F.lit(0)
    for topic in topics:
        total = total + F.col(topic)
    return flagged.withColumn(count_name, total)


def velocity(df: DataFrame) -> DataFrame:
    """Rates per day of age (at least one), ratios to stars, and logged rates."""
    age = at_least("age_days", 1)
    stars_plus_one = F.col(schema.TARGET) + 1
    return (
        df.withColumn("age_days_safe", age)
        .withColumns(
            {
                "stars_per_day": F.col(schema.TARGET) / F.col("age_days_safe"),
                "forks_per_day": F.col("forks_count") / F.col("age_days_safe"),
                "issues_per_day": F.col("open_issues_count") / F.col("age_days_safe"),
                "fork_to_star_ratio": F.col("forks_count") / stars_plus_one,
                "issue_to_star_ratio": F.col("open_issues_count") / stars_plus_one,
            }
        )
        .withColumns({f"log_{r}": F.log1p(r) for r in schema.VELOCITY_RATES})
    )


def velocity_clean(df: DataFrame) -> DataFrame:
    """The four velocity columns that do not use the target."""
    age = at_least("age_days", 1)
    return df.withColumns(
        {"forks_per_day": F.col("forks_count") / age, "issues_per_day": F.col("open_issues_count") / age}
    ).withColumns(
        {"log_forks_per_day": F.log1p("forks_per_day"), "log_issues_per_day": F.log1p("issues_per_day")}
    )


def embedding_text(
    description: str | Column, name: str | Column, limit: int | None = None
) -> Column:
    """The whole text to embed: the description, else the name, else a constant; stripped.

    With a ``limit``, such as ``schema.TEXT_LIMIT``, a longer text is cut and
    marked with dots. Encoders with a bounded window get whole texts in pieces,
    see ``embed.encoded_embedding``.
    """
    body = strip(description)
    chosen = F.coalesce(F.when(F.length(body) > 0, body), strip(name), F.lit(schema.NO_TEXT))
    if limit is None:
        return chosen
    return F.when(F.length(chosen) > limit, F.concat(F.substring(chosen, 1, limit), F.lit("..."))).otherwise(chosen)


def embedding_wide(
    df: DataFrame,
    column: str,
    dim: int,
    prefix: str = "readme_emb",
    keep: Sequence[str] = (),
) -> DataFrame:
    """One column per vector element, for consumers that need a flat table."""
    names = schema.embedding_columns(dim, prefix)
    return df.select(*keep, *[F.get(F.col(column), i).alias(n) for i, n in enumerate(names)])


def embedding_validation(df: DataFrame, column: str) -> DataFrame:
    """Row count, dimension range, missing elements and mean length of a vector column."""
    v = F.col(column)
    squares = F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    return df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.min(F.size(v)).alias("min_dim"),
        F.max(F.size(v)).alias("max_dim"),
        F.coalesce(F.sum(F.size(F.filter(v, lambda x: x.isNull()))), F.lit(0)).cast("long").alias("null_elements"),
        F.count_if(v.isNull()).alias("null_vectors"),
        F.avg(F.sqrt(squares)).alias("mean_norm"),
    )


def array_stats(column: str | Column, threshold: float) -> dict[str, Column]:
    """Sum, mean, population spread and count above a threshold of an array."""
    v = F.transform(F.col(column) if isinstance(column, str) else column, lambda x: x.cast("double"))
    n = F.size(v)
    zero = F.lit(0.0)
    total = F.aggregate(v, zero, lambda a, x: a + x)
    return {
        "total": total,
        "mean": F.try_divide(total, n),
        "std": array_spread(v),
        "n_above": F.size(F.filter(v, lambda x: x > threshold)),
    }
