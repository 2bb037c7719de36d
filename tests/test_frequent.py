import random
from collections import Counter

import pytest

from repo_signals.operators import frequent


def rows_of(seed, n=4000):
    rng = random.Random(seed)
    out = []
    for k in range(n):
        often = rng.choices(["a", "b", "c", "d", "e", "f"], [40, 20, 10, 10, 5, 5])[0] if rng.random() < 0.6 else f"rare{k}"
        out.append((often, f"only{k}", rng.choice(["x", "y", None]), f"v{int(rng.expovariate(0.02))}"))
    return out


def plain(rows, column, top=5):
    counts = Counter(r[column] for r in rows if r[column] is not None)
    return sorted(counts.items(), key=lambda e: (-e[1], e[0]))[:top]


@pytest.mark.parametrize("kept,most", [(8, 8), (8, 200), (64, 64), (5000, 5000)])
def test_frequent_values(spark, kept, most):
    """A column with frequent values, one without, one of few values, and one that falls off slowly."""
    rows = rows_of(kept)
    names = ["often", "only", "few", "falling"]
    df = spark.createDataFrame(rows, ", ".join(f"{n} string" for n in names)).repartition(5)
    got = frequent.frequent_values(df, names, kept=kept, most=most).collect()
    for k, name in enumerate(names):
        mine = sorted((r.rank, r.value, r.n) for r in got if r.column == name)
        assert [(v, n) for _, v, n in mine] == plain(rows, k)
        assert all(r.pct == pytest.approx(100 * r.n / len(rows), abs=0.0051) for r in got if r.column == name)


def test_summary_bounds():
    """A summary is never above the count, and below it by no more than it says."""
    rng, true, kept, lost = random.Random(1), Counter(), Counter(), 0
    for _ in range(60):
        batch = Counter(int(rng.paretovariate(0.7)) for _ in range(200))
        true.update(batch)
        kept.update(batch)
        lost += frequent.shrunk(kept, 20)
        assert len(kept) <= 20
    assert all(kept[v] <= n <= kept[v] + lost for v, n in true.items())


def test_no_rows(spark):
    df = spark.createDataFrame([], "a string, b string")
    assert frequent.frequent_values(df).collect() == []
