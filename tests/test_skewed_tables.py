"""Queries on copies of the tables in which one key holds a third of the rows, every split path forced."""

import check
import duckdb
import pytest

import __spark_entry__ as entry
from repo_signals.operators import skew

QUERIES, ORACLES = entry.queries(), entry.oracle_sql()

# One customer, one order, one part, one day and one text are everywhere.
SKEWED = {
    "orders": """select * replace (case when o_orderkey % 3 = 0 then 7 else o_custkey end as o_custkey,
        case when o_orderkey % 3 = 1 then timestamp '1999-01-01' else o_orderdate end as o_orderdate) from {t}""",
    "lineitem": """select * replace (case when (l_orderkey + l_linenumber) % 3 = 0 then 5 else l_orderkey end as l_orderkey,
        case when l_linenumber % 3 = 1 then 3 else l_partkey end as l_partkey,
        case when l_orderkey % 3 = 2 then timestamp '2000-05-05' else l_shipdate end as l_shipdate) from {t}""",
    "documents": """select * replace (case when doc_id % 3 = 0 then (select text from {t} where doc_id = 4) else text end as text,
        case when doc_id % 3 = 0 then 'src0' else source end as source) from {t}""",
}

NAMES = [
    "category_profile",
    "category_top",
    "csv_roundtrip",
    "embedding_cache_incremental",
    "embedding_store_incremental",
    "family_share",
    "label_encode",
    "label_encode_holdout",
    "leak_guard",
    "median_impute",
    "null_profile",
    "owner_features_joined",
    "owner_is_org",
    "owner_reputation_as_of",
    "owner_reputation_loo",
    "owner_stats_fallback",
    "owner_stats_serving",
    "rmsle",
    "run_assessment",
    "sample_fraction",
    "scatter_sample",
    "scoring_vector",
    "target_histogram",
    "target_kde",
    "target_kde_binned",
    "target_summary",
    "time_row_index",
    "topic_flags_regex",
    "topn_share",
    "ts_fold_stats",
]


@pytest.fixture(scope="module")
def skewed_dir(tmp_path_factory, sf_dir):
    out = tmp_path_factory.mktemp("skewed")
    con = duckdb.connect()
    for name in check.TABLES:
        source = f"'{sf_dir}/{name}.parquet'"
        query = SKEWED.get(name, "select * from {t}").format(t=source)
        con.execute(f"copy ({query}) to '{out}/{name}.parquet' (format parquet)")
    return str(out)


@pytest.mark.parametrize("name", NAMES)
def test_query_on_skewed_tables(spark, skewed_dir, monkeypatch, name):
    monkeypatch.setattr(skew, "LIGHT_ROWS", 20)
    monkeypatch.setattr(skew, "SLOTS", 64)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        good, note = check.compare(spark, check.duck(skewed_dir), name, QUERIES[name], ORACLES[name], skewed_dir)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert good, note
