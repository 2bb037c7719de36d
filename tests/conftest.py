import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
sys.path.insert(0, str(ROOT / "tools"))

from repo_signals.session import build_session, scratch_dir  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "tests",
        "local[4]",
        **{
            "spark.sql.shuffle.partitions": "4",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.driver.memory": "6g",
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    scratch_dir(session)
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def small_repos(spark):
    """Hand-made repositories: a lone owner, a missing owner, ages below zero and above the limit."""
    rows = [
        (1, "storage", "acme/storage", "acme", "Go", "2024-01-01T00:00:00Z", "2024-01-11T12:00:00Z", 10, 10, 2, 1, 100),
        (2, "nextxjs", "acme/nextxjs", "acme", None, "2024-01-05T12:00:00Z", "2024-01-05T00:00:00Z", 200, 200, 50, 5, 2048),
        (3, "agent", "google-lab/agent", "google-lab", "Python", "2010-01-01T00:00:00Z", "2024-01-12T00:00:00Z", 7, 7, 0, 0, 0),
        (4, "plain", "x/plain", None, "C", "2024-01-01T00:00:00Z", "2024-01-12T00:00:00Z", 50, 50, 5, 0, 10),
        (5, "plain", "acme/plain", "acme", "Go", "2024-01-02T00:00:00Z", "2024-01-12T00:00:00Z", 101, 101, 4, 3, 51200),
    ]
    names = (
        "id name full_name owner_login language created_at ingested_at stargazers_count watchers_count "
        "forks_count open_issues_count size"
    ).split()
    types = "bigint string string string string string string bigint bigint bigint bigint bigint".split()
    return spark.createDataFrame(rows, ", ".join(f"{n} {t}" for n, t in zip(names, types)))
