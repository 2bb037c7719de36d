import numpy as np
import pytest
from pyspark.sql import functions as F

from repo_signals.operators import wide


def table(spark, x, parts=3):
    rows = [([None if np.isnan(v) else float(v) for v in r],) for r in x]
    return spark.createDataFrame(rows, "v array<double>").repartition(parts)


def plain(x, a, b):
    both = ~np.isnan(x[:, a]) & ~np.isnan(x[:, b])
    p, q = x[both, a], x[both, b]
    if len(p) < 2 or np.ptp(p) == 0 or np.ptp(q) == 0:
        return None
    return float(np.corrcoef(p, q)[0, 1])


def test_matrix_with_gaps_and_constants(spark, monkeypatch):
    """Also more columns than in a block, values far from zero, vectors that are missing or too short."""
    monkeypatch.setattr(wide, "BLOCK_COLUMNS", 4)
    rng = np.random.default_rng(2)
    x = rng.normal(size=(120, 10)) @ rng.normal(size=(10, 10)) + 1e6
    x[rng.random(x.shape) < 0.1] = np.nan
    x[:, 3] = 0.1
    x[:, 7] = np.nan
    odd = spark.createDataFrame([(None,), ([1.0, 2.0],)], "v array<double>")
    got = wide.correlation_matrix_wide(table(spark, x).union(odd), "v", 10, "c").collect()
    assert len(got) == 45
    for r in got:
        a, b = (int(n.removeprefix("c_")) for n in (r.feature_a, r.feature_b))
        want = plain(x, a, b)
        assert a > b and (r.correlation is None if want is None else r.correlation == pytest.approx(want, abs=1e-7))


def test_parts_merge_to_the_whole():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(60, 4))
    x[rng.random(x.shape) < 0.3] = np.nan
    whole = wide.of_rows(x)
    parts = wide.merged(wide.merged(wide.of_rows(x[:1]), wide.of_rows(x[1:20])), wide.of_rows(x[20:]))
    for p, q in zip(whole, parts):
        assert p == pytest.approx(q, abs=1e-9)


def test_folds_nest(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(80, 3))
    rows = [(k % 4, *map(float, r)) for k, r in enumerate(x)]
    df = spark.createDataFrame(rows, "block int, a double, b double, y double")
    got = wide.target_correlations_by_prefix(df, [F.col("a"), F.col("b"), F.col("y")], "block", 3).collect()
    assert len(got) == 6
    for r in got:
        part = x[np.arange(80) % 4 < r.fold]
        assert r.correlation == pytest.approx(plain(part, r.b, 2))
    assert wide.correlation_matrix_wide(df.limit(0).select(F.array("a").alias("v")), "v", 2).collect() == []
