"""Every named query against its SQL twin in DuckDB, whole results, at the smallest scale."""

import check
import pytest

import __spark_entry__ as entry
from repo_signals.plans.catalogue import QUERIES
from repo_signals.plans.oracles import oracle_sql

ORACLES = oracle_sql()


@pytest.fixture(scope="module")
def duck(sf_dir):
    return check.duck(sf_dir)


def test_every_twin_has_a_query():
    assert set(ORACLES) <= set(QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, sf_dir, name):
    good, note = check.compare(spark, duck, name, QUERIES[name], ORACLES.get(name), sf_dir)
    assert good, note


def test_flagship(spark):
    rows = entry.entry(spark).collect()
    assert rows and rows[0].feature == "watchers_count"
