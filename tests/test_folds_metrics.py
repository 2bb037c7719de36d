import numpy as np
import pytest
from pyspark.sql import functions as F

from repo_signals.operators import folds, metrics, prep

# --- fixed values: published importance tables (feature, importance, pct of the shown total) ---

CLEAN = [
    ("owner_total_stars", 22803.0, 11.39),
    ("owner_std_stars", 19829.0, 9.9),
    ("owner_active_days", 19354.666666666668, 9.67),
    ("log_owner_total_stars", 15931.666666666666, 7.96),
    ("owner_repo_count", 15547.666666666666, 7.77),
    ("owner_total_forks", 13221.0, 6.6),
    ("owner_mean_stars", 12676.333333333334, 6.33),
    ("log_owner_repo_count", 10221.666666666666, 5.11),
    ("owner_mean_forks", 9816.666666666666, 4.9),
    ("forks_per_day", 7919.333333333333, 3.96),
    ("forks_count", 6551.0, 3.27),
    ("log_forks_per_day", 5539.666666666667, 2.77),
    ("age_days", 5189.0, 2.59),
    ("owner_success_rate", 3961.6666666666665, 1.98),
    ("owner_tenure_days", 3915.3333333333335, 1.96),
    ("issues_per_day", 3749.3333333333335, 1.87),
    ("size", 3244.6666666666665, 1.62),
    ("log_issues_per_day", 2569.3333333333335, 1.28),
    ("readme_emb_99", 1854.6666666666667, 0.93),
    ("open_issues_count", 1799.6666666666667, 0.9),
    ("readme_emb_240", 1584.6666666666667, 0.79),
    ("readme_emb_317", 1498.6666666666667, 0.75),
    ("readme_emb_34", 1484.3333333333333, 0.74),
    ("readme_emb_8", 1447.0, 0.72),
    ("readme_emb_227", 1440.3333333333333, 0.72),
    ("readme_emb_29", 1418.6666666666667, 0.71),
    ("readme_emb_233", 1418.3333333333333, 0.71),
    ("readme_emb_35", 1417.0, 0.71),
    ("readme_emb_244", 1413.3333333333333, 0.71),
    ("readme_emb_267", 1405.0, 0.7),
]
ALL = [
    ("stars_per_day", 27800.0, 8.55),
    ("owner_total_stars", 25048.666666666668, 7.7),
    ("owner_mean_stars", 22464.666666666668, 6.91),
    ("fork_to_star_ratio", 20777.666666666668, 6.39),
    ("log_stars_per_day", 20335.333333333332, 6.25),
    ("age_days", 19781.666666666668, 6.08),
    ("log_owner_total_stars", 17494.666666666668, 5.38),
    ("forks_per_day", 16748.666666666668, 5.15),
    ("owner_std_stars", 14885.666666666666, 4.58),
    ("forks_count", 13735.333333333334, 4.22),
    ("owner_mean_forks", 13135.333333333334, 4.04),
    ("owner_tenure_days", 12950.333333333334, 3.98),
    ("owner_total_forks", 12633.0, 3.88),
    ("log_forks_per_day", 12051.666666666666, 3.71),
    ("issue_to_star_ratio", 9711.0, 2.99),
    ("owner_active_days", 9225.333333333334, 2.84),
    ("issues_per_day", 7897.666666666667, 2.43),
    ("owner_repo_count", 7548.666666666667, 2.32),
    ("owner_success_rate", 6101.333333333333, 1.88),
    ("open_issues_count", 5901.666666666667, 1.81),
    ("log_issues_per_day", 5494.0, 1.69),
    ("log_owner_repo_count", 5130.0, 1.58),
    ("size", 4729.0, 1.45),
    ("readme_emb_99", 2335.3333333333335, 0.72),
    ("readme_emb_280", 1951.0, 0.6),
    ("readme_emb_227", 1908.0, 0.59),
    ("readme_emb_267", 1871.0, 0.58),
    ("readme_emb_71", 1868.0, 0.57),
    ("readme_emb_240", 1850.0, 0.57),
    ("readme_emb_149", 1846.6666666666667, 0.57),
]
METADATA = [
    ("age_days", 2283.0, 31.74),
    ("forks_count", 1634.0, 22.72),
    ("size", 1581.0, 21.98),
    ("open_issues_count", 1562.0, 21.72),
    ("language", 132.0, 1.84),
]


def importance(spark, rows):
    return spark.createDataFrame([(f, w) for f, w, _ in rows], "feature string, importance double")


@pytest.mark.parametrize("rows", [CLEAN, ALL, METADATA])
def test_published_percentages(spark, rows):
    got = metrics.importance_top(importance(spark, rows), 30).orderBy("rank").collect()
    assert [(r.feature, r.pct) for r in got] == [(f, p) for f, _, p in rows]


def test_published_families(spark):
    clean = {r.family: r for r in metrics.family_share(importance(spark, CLEAN), metrics.family_rules("feature")).collect()}
    assert {f: (round(r.importance, 2), r.pct) for f, r in clean.items()} == {
        "Owner": (121125.33, 69.6),
        "Velocity (Clean)": (19777.67, 11.4),
        "Metadata": (16784.33, 9.6),
        "Embeddings": (16382.0, 9.4),
        "Topic": (0.0, 0.0),
    }
    assert clean["Embeddings"].n_features == 11
    everything = {r.family: r for r in metrics.family_share(importance(spark, ALL), metrics.family_rules("feature", clean=False)).collect()}
    assert {f: (round(r.importance, 2), r.pct) for f, r in everything.items()} == {
        "Velocity": (143440.67, 44.1),
        "Owner": (123993.0, 38.1),
        "Metadata": (44147.67, 13.6),
        "Embeddings": (13630.0, 4.2),
        "Topic": (0.0, 0.0),
    }


def test_family_share_takes_the_top_only(spark):
    out = metrics.family_share(importance(spark, CLEAN), metrics.family_rules("feature"), top=2).collect()
    assert out[0].family == "Owner" and out[0].importance == 22803.0 + 19829.0


def test_importance_mean(spark):
    df = spark.createDataFrame([(1, "a", 1.0), (2, "a", 4.0), (1, "b", 2.0)], "fold int, feature string, importance double")
    assert {r.feature: r.importance for r in metrics.importance_mean(df).collect()} == {"a": 2.5, "b": 2.0}


@pytest.mark.parametrize("n", [7, 8, 101])
def test_folds_equal_the_index_arithmetic(spark, n):
    df = spark.range(n).select("id", F.date_add(F.lit("2024-01-01"), (F.col("id") % 3).cast("int")).cast("timestamp").alias("ingested_at"))
    order = sorted(range(n), key=lambda i: (i % 3, i))
    size = n // 4
    block_of = {i: 0 if pos < n - 3 * size else (pos - (n - 3 * size)) // size + 1 for pos, i in enumerate(order)}
    got = {r.id: r.block for r in folds.with_blocks(df).collect()}
    assert got == block_of
    bounds = {r.fold: (r.test_start, r.test_end, r.n_test) for r in folds.fold_bounds(df).collect()}
    assert bounds == {i: (n - (4 - i) * size, n - (3 - i) * size, size) for i in (1, 2, 3)}


def test_published_fold_shape(spark):
    bounds = {r.fold: (r.test_start, r.n_test) for r in folds.fold_bounds(spark.range(14743)).collect()}
    assert bounds == {1: (3688, 3685), 2: (7373, 3685), 3: (11058, 3685)}


def test_train_lies_before_test(spark, small_repos):
    rows = prep.preprocess(small_repos).withColumn("log_stars", F.log1p("stargazers_count"))
    stats = folds.fold_stats(folds.with_blocks(rows, folds=2), folds=2).orderBy("fold").collect()
    assert [s.n_train + s.n_test for s in stats] == [4, 5]
    assert all(s.train_last_seen <= s.test_first_seen for s in stats)


def test_rmsle_clamps_negative_predictions(spark):
    df = spark.createDataFrame([(0, -5.0), (9, 9.0), (99, 0.0)], "y int, p double")
    row = metrics.rmsle(df, "y", "p").first()
    assert row.rmsle == pytest.approx(np.sqrt(np.log(100) ** 2 / 3))


def test_cv_summary_uses_population_spread(spark):
    df = spark.createDataFrame([(2, 0.6), (1, 0.5), (3, 1.0)], "fold int, rmsle double")
    row = metrics.cv_summary(df).first()
    assert row.mean_rmsle == pytest.approx(0.7)
    assert row.std_rmsle == pytest.approx(np.std([0.5, 0.6, 1.0]))
    assert row.scores == "0.5000, 0.6000, 1.0000"


def test_assessment_bands(spark):
    df = spark.createDataFrame([("a", 0.57), ("b", 0.6), ("c", 0.64), ("d", 0.6921), ("e", 0.78), ("f", 0.9)], "run string, rmsle double")
    got = {r.run: (r.improvement_band, r.target_band_all, r.target_band_clean, r.gap_band, r.is_valid) for r in metrics.run_assessment(df).collect()}
    assert got == {
        "a": ("excellent", "excellent", "excellent", "excellent", 1),
        "b": ("good", "on_target", "on_target", "excellent", 1),
        "c": ("good", "above_target", "on_target", "excellent", 1),
        "d": ("modest", "above_target", "above_target", "excellent", 1),
        "e": ("modest", "above_target", "above_target", "moderate", 1),
        "f": ("modest", "above_target", "above_target", "large", 0),
    }


def test_missing_predictions_are_counted_not_scored(spark):
    df = spark.createDataFrame([(10.0, 10.0), (5.0, None), (3.0, -1.0)], "actual double, predicted double")
    row = metrics.rmsle(df, "actual", "predicted").first()
    assert (row.n, row.n_missing) == (2, 1)
    assert row.rmsle == pytest.approx(np.sqrt(np.log1p(3) ** 2 / 2))
