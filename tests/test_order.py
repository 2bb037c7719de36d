"""Quantiles, row index, samples, top-N and the split join, against brute force."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from repo_signals.operators import ordering, quantiles, skew

PROBS = [0.0, 0.25, 0.5, 0.99, 1.0]


def frames(rng):
    heavy = np.floor(rng.pareto(0.6, 3000)).astype(float)
    return {
        "heavy": heavy,
        "uniform": rng.uniform(-5, 5, 3000),
        "constant": np.full(3000, 4.0),
        "narrow": 1.7e9 + rng.uniform(0, 1e-3, 3000),
        "few": rng.integers(0, 3, 3000).astype(float),
        "outlier": np.append(rng.uniform(0, 1, 2999), 1e15),
        "negative": -np.exp(rng.normal(0, 8, 3000)),
    }


def test_exact_quantiles(spark):
    data = frames(np.random.default_rng(3))
    names = list(data)
    df = spark.createDataFrame([tuple(float(data[n][i]) for n in names) for i in range(3000)], ", ".join(f"{n} double" for n in names))
    got = {(r["column"], r["prob"]): r["value"] for r in quantiles.exact_quantiles(df, names, PROBS).collect()}
    assert len(got) == len(names) * len(PROBS)
    for name in names:
        for p in PROBS:
            assert got[name, p] == pytest.approx(np.quantile(data[name], p), rel=1e-12, abs=1e-12), (name, p)


def test_quantile_of_infinities(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (3.0,), (float("inf"),), (float("inf"),)], "x double")
    got = {r.prob: r.value for r in quantiles.exact_quantiles(df, ["x"], [0.25, 0.5, 0.6, 1.0]).collect()}
    assert got == {0.25: 2.0, 0.5: 3.0, 0.6: float("inf"), 1.0: float("inf")}


def test_quantile_skips_null_and_nan_and_counts_weights(spark):
    df = spark.createDataFrame([(1.0, 1), (2.0, 1), (10.0, 1), (11.0, 1), (None, 5), (float("nan"), 5)], "x double, w int")
    assert quantiles.exact_quantiles(df, ["x"], [0.5]).first()["value"] == 6.0
    weighted = spark.createDataFrame([(1.0, 5), (2.0, 1), (9.0, 3)], "x double, w int")
    assert quantiles.exact_quantiles(weighted, ["x"], [0.5], "w").first()["value"] == 1.0


def test_row_index_with_ties_and_skew(spark):
    rows = [(i, "2024-01-01" if i % 3 else f"2024-01-{1 + i % 28:02d}") for i in range(1000)]
    df = spark.createDataFrame(rows, "id int, t string").repartition(7)
    got = {r.id: r.row_idx for r in ordering.with_row_index(df, ["t", "id"]).collect()}
    want = {i: n for n, (i, _) in enumerate(sorted(rows, key=lambda r: (r[1], r[0])))}
    assert got == want


def test_row_index_of_nothing(spark):
    assert ordering.with_row_index(spark.range(0), ["id"]).count() == 0


@pytest.mark.parametrize(("rows", "fraction", "size"), [(17, None, 17), (5000, None, 400), (None, 0.2, 80), (None, 1.0, 400), (0, None, 0)])
def test_hash_sample_takes_the_smallest_digests(spark, rows, fraction, size):
    df = spark.range(400).withColumn("x", F.col("id") * 2)
    got = sorted(r.id for r in ordering.hash_sample(df, "id", rows=rows, fraction=fraction).collect())
    ranked = sorted(range(400), key=lambda i: (hashlib.md5(f"{i}:42".encode()).hexdigest(), i))
    assert got == sorted(ranked[:size])


def test_hash_sample_is_seeded(spark):
    df = spark.range(400)
    a, b, c = (
        {r.id for r in ordering.hash_sample(df, "id", rows=50, seed=s).collect()} for s in (1, 1, 2)
    )
    assert a == b != c


def test_top_n_share(spark):
    df = spark.createDataFrame([("a", "x", 3.0), ("a", "y", 1.0), ("a", "y", 1.0), ("a", "z", 0.5), ("b", "x", 5.0)], "g string, i string, w double")
    got = [tuple(r) for r in ordering.top_n_share(df, "g", "i", "w", 2).orderBy("g", "rank").collect()]
    assert got == [("a", "x", 3.0, 1, 60.0), ("a", "y", 2.0, 2, 40.0), ("b", "x", 5.0, 1, 100.0)]


def test_top_n_is_cut_before_the_shuffle(spark):
    df = spark.range(1000).select((F.col("id") % 3).alias("g"), "id", F.rand(1).alias("w"))
    plan = ordering.top_n_share(df, "g", "id", "w", 5)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") >= 2


def skewed(spark):
    """A third of the rows share one key and some have none."""
    key = F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 17 == 0, None).otherwise(F.concat(F.lit("k"), F.col("id") % 40))
    rows = spark.range(3000).select("id", key.alias("k"))
    lookup = rows.where("k is not null").groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.sum("id").alias("total"))
    return rows, lookup


@pytest.mark.parametrize("light_rows", [10, 100_000])
def test_left_join_spread_equals_plain_join(spark, light_rows):
    rows, lookup = skewed(spark)
    got = skew.left_join_spread(rows, lookup, "k", "n", "id", slots=64, light_rows=light_rows)
    want = rows.join(lookup, "k", "left")
    assert sorted(map(str, got.select("id", "k", "n", "total").collect())) == sorted(map(str, want.select("id", "k", "n", "total").collect()))


@pytest.mark.parametrize("light_rows", [10, 100_000])
def test_left_join_spread_splits_heavy_and_missing_keys(spark, light_rows):
    rows, lookup = skewed(spark)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        joined = skew.left_join_spread(rows, lookup, "k", "n", "id", slots=64, light_rows=light_rows)
        # Reading ``total`` keeps the optimizer from dropping the join.
        tagged = joined.select("k", "total", F.spark_partition_id().alias("p"))
        placed = tagged.groupBy("k", "p").agg(F.count(F.lit(1)).alias("count"), F.max("total")).collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    hot = [r["count"] for r in placed if r.k == "hot"]
    bare = [r["count"] for r in placed if r.k is None]
    assert sum(hot) == 1000 and len(hot) == (4 if light_rows == 10 else 1)
    assert light_rows > 10 or max(hot) < 600
    assert len(bare) == 4
