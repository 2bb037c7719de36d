"""The paths taken on large and skewed data give the same results as the plain ones."""

from functools import partial

import pytest
from pyspark.sql import functions as F

from repo_signals import schema
from repo_signals.operators import audit, embed, encode, owners, skew
from repo_signals.plans import stages
from repo_signals.session import scratch_path
from repo_signals.sources import cache


@pytest.fixture(scope="module")
def skewed_repos(spark):
    """A third of the rows share one owner, one language, one name and one ingestion time; some have no owner."""
    i = F.col("id")
    hot = i % 3 == 0
    return spark.range(1200).select(
        "id",
        F.when(hot, "same").otherwise(F.concat(F.lit("n"), i % 50)).alias("name"),
        F.concat(F.lit("f"), i).alias("full_name"),
        F.when(hot, "hot").when(i % 17 == 0, None).otherwise(F.concat(F.lit("o"), i % 70)).alias("owner_login"),
        F.when(hot, "Go").when(i % 5 > 0, F.concat(F.lit("L"), i % 9)).alias("language"),
        (i * i % 997).alias("stargazers_count"),
        (i * i % 997).alias("watchers_count"),
        (i * 7 % 31).alias("forks_count"),
        (i % 4).alias("open_issues_count"),
        (i * 13 % 1009).alias("size"),
        F.timestamp_seconds(F.lit(1_600_000_000) + i * 1000).alias("created_at"),
        F.when(hot, F.timestamp_seconds(F.lit(1_650_000_000)))
        .otherwise(F.timestamp_seconds(F.lit(1_649_000_000) + i * 1500))
        .alias("ingested_at"),
    )


def rows(df):
    rounded = [F.round(c, 9).alias(c) if t == "double" else F.col(c) for c, t in sorted(df.dtypes)]
    return sorted(str(r) for r in df.select(rounded).collect())


def coded(df):
    return encode.apply_codes(df, encode.fit_codes(df, "name"), "name", "code", "id")


def embedded(df):
    path = scratch_path(df.sparkSession, "cache")
    four = partial(embed.hashed_embedding, dim=4)
    out = cache.embed_with_cache(df.select("id", "name"), "name", "id", path, "m", four)
    return out.withColumn("embedding", F.col("embedding").cast("string"))


@pytest.mark.parametrize("work", [stages.enrich, coded, embedded, audit.target_summary, audit.target_histogram])
def test_split_paths_change_nothing(spark, skewed_repos, monkeypatch, work):
    plain = rows(work(skewed_repos))
    monkeypatch.setattr(skew, "LIGHT_ROWS", 5)
    monkeypatch.setattr(skew, "SLOTS", 64)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        split = rows(work(skewed_repos))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plain == split


def test_owner_heavy_in_the_rows_and_unknown_to_the_statistics(spark, monkeypatch):
    monkeypatch.setattr(skew, "LIGHT_ROWS", 20)
    monkeypatch.setattr(skew, "SLOTS", 64)
    scored = spark.createDataFrame([(i, "hot" if i % 3 else f"o{i % 50}") for i in range(600)], "id int, owner_login string")
    figures = [("o3", *[2.0] * len(schema.OWNER_DEFAULTS), 1)]
    stats = spark.createDataFrame(figures, ", ".join(["owner_login string", *[f"{c} double" for c in schema.OWNER_DEFAULTS], "n_rows int"]))
    rows = owners.owner_stats_or_default(scored, stats).collect()
    assert len(rows) == 600
    assert all(r.owner_mean_stars == (2.0 if r.owner_login == "o3" else schema.OWNER_DEFAULTS["owner_mean_stars"]) for r in rows)
