import pytest
from pyspark.sql import functions as F

from repo_signals import schema
from repo_signals.operators import encode, prep


def test_preprocess_keeps_every_row_unless_asked(small_repos):
    rows = {r.id: r for r in prep.preprocess(small_repos).collect()}
    assert {i: r.age_days for i, r in rows.items()} == {1: 10, 2: -1, 3: 5124, 4: 11, 5: 10}
    assert rows[2].language == "Unknown"
    assert rows[1].log_stars == pytest.approx(2.3978952728)
    assert sorted(r.id for r in prep.preprocess(small_repos, schema.MAX_AGE_DAYS).collect()) == [1, 4, 5]


def test_violations(spark, small_repos):
    prep.assert_preprocessed(prep.preprocess(small_repos))
    bad = prep.preprocess(small_repos.withColumn("created_at", F.when(F.col("id") > 1, F.col("created_at"))))
    with pytest.raises(AssertionError):
        prep.assert_preprocessed(bad)


def test_temporal_split(small_repos):
    before, after = prep.temporal_split(small_repos, "2024-01-02")
    assert sorted(r.id for r in before.collect()) == [1, 3, 4]
    assert sorted(r.id for r in after.collect()) == [2, 5]
    counts = {r.side: (r.n_rows, r.small_test) for r in prep.temporal_split_counts(small_repos, "2024-01-02").collect()}
    assert counts == {"train": (3, 0), "test": (2, 1)}


def test_select_drop_fill(spark):
    df = spark.createDataFrame([(1, None, 2.0, "a"), (2, None, float("nan"), None), (3, 7, None, "b")], "id int, x int, y double, s string")
    assert prep.select_features(df, ["y", "nope", "x"], ["id"]).columns == ["id", "y", "x"]
    assert prep.drop_sparse_columns(df).columns == ["id", "s"]
    assert [(r.x, r.y) for r in prep.fill_sentinel(df.orderBy("id"), ["x", "y"]).collect()] == [(-1, 2.0), (-1, -1.0), (7, -1.0)]


def test_median_is_over_rows_and_exact(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (10.0,), (11.0,), (None,)], "x double")
    assert sorted(r.x for r in prep.impute_median(df, ["x"]).collect()) == [1.0, 2.0, 6.0, 10.0, 11.0]


def test_median_of_an_empty_column_stays_missing(spark):
    df = spark.createDataFrame([(None,), (None,)], "x double")
    assert [r.x for r in prep.impute_median(df, ["x"]).collect()] == [None, None]


def test_align_columns(spark):
    df = spark.createDataFrame([(1, 5, None, "x")], "id int, a int, b double, extra string")
    out = prep.align_columns(df, ["b", "missing", "a"], ["id"])
    assert out.dtypes == [("id", "int"), ("b", "float"), ("missing", "float"), ("a", "float")]
    assert tuple(out.first()) == (1, -1.0, -1.0, 5.0)
    assert tuple(prep.align_columns(out, ["b", "missing", "a"], ["id"]).first()) == (1, -1.0, -1.0, 5.0)


def test_defaults(spark):
    df = spark.createDataFrame([(1, None)], "id int, name string")
    assert prep.apply_defaults(df, {"name": "Unknown", "forks_count": 0}).first().asDict() == {"id": 1, "name": "Unknown", "forks_count": 0}


def test_codes_are_ranks_and_unseen_is_minus_one(spark):
    train = spark.createDataFrame([(1, "b"), (2, "a"), (3, "b"), (4, "C")], "id int, lang string")
    codes = encode.fit_codes(train, "lang")
    assert {r.lang: (r.code, r.n_rows) for r in codes.collect()} == {"C": (0, 1), "a": (1, 1), "b": (2, 2)}
    test = spark.createDataFrame([(1, "a"), (2, "z"), (3, None)], "id int, lang string")
    assert {r.id: r.code for r in encode.apply_codes(test, codes, "lang", "code", "id").collect()} == {1: 1, 2: -1, 3: -1}


def test_fixed_codes(spark):
    df = spark.createDataFrame([("Python",), ("MATLAB",), ("Unknown",), ("Elm",), (None,)], "language string")
    assert [r.language_code for r in encode.fixed_language_code(df).collect()] == [0, 19, 99, 99, 99]
