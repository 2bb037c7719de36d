import datetime as dt

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from repo_signals.functions import columns as c


def one(spark, *cols):
    return spark.range(1).select(*cols).first()


@pytest.mark.parametrize(
    ("later", "earlier", "days"),
    [
        ("2024-01-01 00:00:00", "2024-01-01 12:00:00", -1),
        ("2024-01-02 00:00:00", "2024-01-01 23:00:00", 0),
        ("2024-01-03 00:00:00", "2024-01-01 00:00:00", 2),
        ("2024-01-01 00:00:00", "2024-01-01 00:00:00", 0),
        ("2023-12-31 00:00:00", "2024-01-01 00:00:00", -1),
    ],
)
def test_whole_days_floors(spark, later, earlier, days):
    assert one(spark, c.whole_days(F.lit(later), F.lit(earlier)).alias("d")).d == days


def test_whole_days_matches_timedelta(spark):
    rng = np.random.default_rng(7)
    base = dt.datetime(2000, 1, 1)
    pairs = [
        (base + dt.timedelta(microseconds=int(a)), base + dt.timedelta(microseconds=int(b)))
        for a, b in rng.integers(0, 10**15, size=(200, 2))
    ]
    df = spark.createDataFrame(pairs, "a timestamp_ntz, b timestamp_ntz")
    got = [r.d for r in df.select(c.whole_days("a", "b").alias("d")).collect()]
    assert got == [(a - b).days for a, b in pairs]


def test_strict_parse_raises_and_lenient_gives_null(spark):
    df = spark.createDataFrame([("2025-01-15T00:00:00Z",), ("soon",)], "t string")
    with pytest.raises(PySparkException):
        df.select(c.utc("t")).collect()
    assert [r.t is None for r in df.select(c.utc_lenient("t").alias("t")).collect()] == [False, True]


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet=" \t\n\x0b\x1f\xa0 　ab", max_size=8), min_size=20, max_size=20))
def test_strip_is_python_strip(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r.i: r.s for r in df.select("i", c.strip("t").alias("s")).collect()}
    assert got == {i: t.strip() for i, t in enumerate(texts)}


def test_lookup_and_ladders(spark):
    row = one(
        spark,
        c.lookup(F.lit("Python"), {"Python": 0, "Go": 10}, 99).alias("known"),
        c.lookup(F.lit("Elm"), {"Python": 0}, 99).alias("unknown"),
        c.lookup(F.lit(None).cast("string"), {"Python": 0}, 99).alias("missing"),
        c.ladder_above(F.lit(0.9), [(0.9, "a"), (0.7, "b")], "c").alias("edge"),
        c.ladder_below(F.lit(5.0), [(5.0, "low"), (15.0, "mid")], "high").alias("step"),
    )
    assert row.asDict() == {"known": 0, "unknown": 99, "missing": 99, "edge": "b", "step": "mid"}


def test_array_spread(spark):
    values = [1.0, 2.0, 10.0, 11.0]
    row = one(
        spark,
        c.array_spread(F.array(*[F.lit(v) for v in values])).alias("s"),
        c.array_spread(F.array().cast("array<double>")).alias("e"),
    )
    assert row.s == pytest.approx(np.std(values))
    assert row.e is None


def test_scalar_rejects_two_rows(spark):
    two = spark.range(2)
    with pytest.raises(Exception, match="SCALAR_SUBQUERY_TOO_MANY_ROWS"):
        spark.range(1).select(c.scalar(two)["id"]).collect()


def test_missing_stays_missing(spark):
    df = spark.createDataFrame([(None,), (-2.0,), (5.0,)], "x double")
    rows = df.select(c.at_least("x", 1).alias("a"), c.clamp("x", 0, 3).alias("b")).collect()
    assert [(r.a, r.b) for r in rows] == [(None, None), (1.0, 0.0), (5.0, 3.0)]


def test_rounding_of_any_size(spark):
    values = [1.5e13, -2.5e13, float("inf"), float("-inf"), 0.1234567, -0.5, 9.2e9, 1e300, None]
    df = c.rounded(spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x double"))
    got = [r.x for r in df.orderBy("i").collect()]
    assert got == [1.5e13, -2.5e13, float("inf"), float("-inf"), 0.123457, -0.5, 9.2e9, 1e300, None]
    nan = c.rounded(spark.createDataFrame([(float("nan"),)], "x double")).first().x
    assert nan != nan
