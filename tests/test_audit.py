import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from repo_signals.operators import audit, quantiles


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(5)
    stars = np.floor(rng.pareto(1.0, 500) * 10)
    pdf = pd.DataFrame(
        {
            "id": np.arange(500),
            "stargazers_count": stars,
            "watchers_count": stars,
            "forks_count": stars * 0.5 + rng.normal(0, 20, 500),
            "flat": np.ones(500),
            "gappy": np.where(rng.random(500) < 0.3, np.nan, rng.random(500)),
            "empty": np.full(500, np.nan),
            "language": rng.choice(["Go", "C", None], 500),
            "ingested_at": pd.Timestamp("2024-01-01"),
            "created_at": [pd.Timestamp("2023-01-01") if i % 10 else pd.Timestamp("2024-05-01") for i in range(500)],
        }
    )
    df = spark.createDataFrame(pdf)
    return pdf, df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in ("gappy", "empty")}).repartition(4)


def test_correlations_match_pandas(table):
    pdf, df = table
    rows = {r.feature: r for r in audit.leakage_correlations(df).collect()}
    assert "empty" not in rows and "stargazers_count" not in rows
    for c in ("id", "watchers_count", "forks_count", "gappy"):
        assert rows[c].correlation == pytest.approx(pdf[c].corr(pdf.stargazers_count), abs=1e-9)
    assert rows["flat"].correlation is None and rows["flat"].risk == "LOW"
    assert rows["watchers_count"].risk == "CRITICAL"
    assert [r.feature for r in audit.leakage_correlations(df).collect()][0] == "watchers_count"


def test_matrix_is_lower_triangle(table):
    pdf, df = table
    rows = {(r.feature_a, r.feature_b): r.correlation for r in audit.correlation_matrix(df, ["id", "forks_count", "gappy", "flat"]).collect()}
    assert rows["gappy", "forks_count"] == pytest.approx(pdf.gappy.corr(pdf.forks_count), abs=1e-9)
    assert set(rows) <= {("forks_count", "id"), ("gappy", "id"), ("flat", "id"), ("gappy", "forks_count"), ("flat", "forks_count"), ("flat", "gappy")}
    assert len(rows) == 6 and rows["flat", "id"] is None


def test_mirror_and_lists(table):
    _, df = table
    row = audit.mirror_check(df).first()
    assert (row.exact_match_pct, row.max_difference, row.leaks) == (100.0, 0.0, 1)
    assert audit.mirror_check(df, "flat").first().leaks == 0
    lists = {r.band: r.features.split(", ")[0] for r in audit.risk_lists(audit.leakage_correlations(df)).collect()}
    assert lists["CRITICAL"] == "watchers_count"


def test_profiles(table):
    pdf, df = table
    nulls = {r["column"]: r.null_count for r in audit.null_profile(df).collect()}
    assert nulls == {"gappy": int(pdf.gappy.isna().sum()), "empty": 500, "language": int(pdf.language.isna().sum())}
    top = audit.category_profile(df).orderBy("rank").collect()
    counts = pdf.language.value_counts()
    assert [(r.value, r.n) for r in top] == list(counts.items())
    assert {r.n_unique for r in top} == {2}
    assert audit.table_shape(df).first().n_cols == 10


def test_category_profile_ranks_before_the_shuffle(table):
    _, df = table
    plan = audit.category_profile(df)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_dates(table, spark):
    _, df = table
    future = audit.future_dates(df).first()
    assert (future["column"], future.n_future, future.future_pct) == ("created_at", 50, 10.0)
    assert {r["column"] for r in audit.date_ranges(df).collect()} == {"created_at", "ingested_at"}
    odd = spark.createDataFrame([("2024-01-01", "2024-01-02"), ("never", "2024-01-03")], "created_at string, ingested_at string")
    assert str(audit.date_ranges(odd).where("column = 'created_at'").first().max_date) == "2024-01-01 00:00:00"


def test_histogram_matches_numpy(table):
    pdf, df = table
    for column in ("stargazers_count", "forks_count"):
        rows = audit.histogram(df, column).orderBy("bin").collect()
        counts, edges = np.histogram(pdf[column], bins=100)
        assert [r.n for r in rows] == counts.tolist()
        assert [r.low for r in rows] == pytest.approx(edges[:-1].tolist())
    flat = audit.histogram(df, "flat", bins=10).orderBy("bin").collect()
    assert [r.n for r in flat] == np.histogram(pdf.flat, bins=10)[0].tolist()
    view = audit.target_histogram(df).where("in_view = 1").agg(F.max("low")).first()[0]
    assert view <= np.quantile(pdf.stargazers_count, 0.99)


def test_density_matches_the_formula(table):
    pdf, df = table
    x = pdf.stargazers_count.to_numpy()
    h = x.std(ddof=1) * len(x) ** -0.2
    grid = np.linspace(x.min(), x.max(), 200)
    want = np.exp(-0.5 * ((grid[:, None] - x) / h) ** 2).sum(axis=1) / (len(x) * h * np.sqrt(2 * np.pi))
    rows = audit.density_curve(df, "stargazers_count").orderBy("point").collect()
    assert [r.density for r in rows] == pytest.approx(want.tolist())


def test_distributions_of_odd_columns(table):
    _, df = table
    assert {r.density for r in audit.density_curve(df, "flat").collect()} == {None}
    assert {r.n for r in audit.histogram(df, "empty").collect()} == {0}
    row = audit.target_summary(df, "empty").first()
    assert row.n == 0 and row["mean"] is None and row["median"] is None


def test_safe_features_and_guard(table):
    _, df = table
    rows = {r.feature: r for r in audit.safe_features(df).collect()}
    assert rows["watchers_count"].verdict == "excluded" and rows["watchers_count"].match_pct == 100.0
    assert rows["forks_count"].verdict == "safe" and "created_at" not in rows
    assert rows["language"].abs_correlation is None
    kept = audit.drop_leaks(df, ["watchers_count", "gappy", "flat", "stargazers_count", "nope"])
    assert kept == ["gappy", "flat"]


def test_scatter_sample(table):
    pdf, df = table
    rows = audit.scatter_sample(df, rows=100).collect()
    assert len(rows) == 100
    assert {r.line_end for r in rows} == {max(r.stargazers_count for r in rows)}


def test_audit_of_a_raw_table_with_dotted_names(spark):
    raw = spark.createDataFrame(
        [(1, "a", 5, 5, 1.0), (2, None, 7, 7, 1.0), (3, "a", 9, 9, 1.0)],
        "id int, `owner.login` string, stargazers_count int, watchers_count int, score double",
    )
    assert {r["column"]: r.null_count for r in audit.null_profile(raw).collect()} == {"owner.login": 1}
    assert [(r["column"], r.value, r.n) for r in audit.category_profile(raw).collect()] == [("owner.login", "a", 2)]
    assert {r.feature: r.verdict for r in audit.safe_features(raw).collect()} == {
        "owner.login": "safe",
        "watchers_count": "excluded",
        "score": "safe",
    }
    got = {r.key: r.value for r in audit.audit_report(raw).collect()}
    assert got["safe_features"] == "owner.login, score" and got["ingestion_max"] == "None"
    assert got["null_columns"] == "1" and got["watchers_leakage"] == "True"
    assert {r.key: r.value for r in audit.audit_report(raw.drop("watchers_count")).collect()}["watchers_leakage"] == "None"


def test_report(table):
    _, df = table
    got = {(r.section, r.key): r.value for r in audit.audit_report(df).collect()}
    assert got["data_quality", "total_rows"] == "500"
    assert got["data_quality", "null_columns"] == "3"
    assert got["feature_leakage", "critical_features"].startswith("watchers_count")
    assert got["feature_leakage", "watchers_leakage"] == "True"
    assert got["temporal_integrity", "ingestion_max"] == "2024-01-01 00:00:00"
    lines = [r.value for r in audit.report_lines(audit.audit_report(df)).collect()]
    assert "[data_quality] total_rows: 500" in lines


def test_nan_counts_as_missing(spark):
    df = spark.createDataFrame([(1.0, 1), (float("nan"), None), (None, 2)], "x double, y int")
    assert [(r.column, r.null_count) for r in audit.null_profile(df).collect()] == [("x", 2), ("y", 1)]


def test_leak_guard_has_a_row_for_every_feature(spark):
    df = spark.createDataFrame([(1, 1.0, None), (2, 2.0, None)], "stargazers_count int, size double, empty double")
    rows = {r.feature: r.kept for r in audit.leak_guard(df, ["size", "empty"]).collect()}
    assert rows == {"size": 0, "empty": 1}


def test_binned_density(spark):
    """As exact as it says, with many distinct values, gaps, and a far outlier; a constant has no density."""
    rng = np.random.default_rng(7)
    x = np.append(rng.gamma(2.0, 30.0, 3000), 5000.0)
    df = spark.createDataFrame([(float(v),) for v in x] + [(None,), (float("nan"),)], "x double")
    exact = {r.point: r for r in audit.density_curve(df, "x").collect()}
    got = {r.point: r for r in audit.binned_density(df, "x").collect()}
    assert set(got) == set(exact)
    for k, r in got.items():
        assert r.grid_x == pytest.approx(exact[k].grid_x) and r.density == pytest.approx(exact[k].density, abs=1e-9)
    rough = audit.binned_density(df, "x", tolerance=1e-3).collect()
    peak = max(r.density for r in exact.values())
    assert max(abs(r.density - exact[r.point].density) for r in rough) < 1e-2 * peak
    assert {r.density for r in audit.binned_density(df.withColumn("x", F.lit(2.0)), "x").collect()} == {None}


def test_sketched_quantiles(spark):
    rng = np.random.default_rng(8)
    rows = [(float(v), int(v) % 3) for v in rng.exponential(1000.0, 5000)] + [(None, None), (float("nan"), 1)]
    df = spark.createDataFrame(rows, "x double, k int").repartition(7)
    got = quantiles.judged_sketch(df, ["x", "k"], [0.0, 0.1, 0.5, 0.999, 1.0], accuracy=200).collect()
    assert len(got) == 10 and all(r.rank_ok == 1 for r in got)
    values = sorted(v for v, _ in rows if v is not None and not np.isnan(v))
    for r in got:
        if r.column == "x":
            assert abs(np.searchsorted(values, r.value, "right") - r.prob * 5000) <= 5000 / 200 + 1 and r.n == 5000


def test_merged_moments(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(1e6, 1, 300)
    y = x * 0.3 + rng.normal(0, 1, 300)
    df = spark.createDataFrame([(int(i % 4), float(a), float(b)) for i, (a, b) in enumerate(zip(x, y))], "block int, x double, y double")
    parts = audit.pair_moments(df, [("x", "y")], ["block"])
    whole = audit.merged_moments(parts, []).select(audit.moment_correlation().alias("r")).first().r
    assert whole == pytest.approx(np.corrcoef(x, y)[0, 1], abs=1e-9)
