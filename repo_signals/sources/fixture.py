"""The repository table, derived from the order tables of the test data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


# Stated, so that no job has to open files just to infer them.
TABLES = {
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
    "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
    "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, "
    "l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "embeddings": "vec_id bigint, embedding array<float>, label int",
    "pages": "page_id bigint, url string, html string",
    "labels": "doc_id bigint, quality int, toxic int",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(TABLES[name]).parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def repos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per order that has lines: the order is the repository, the customer its owner.

    Lines are pre-aggregated per order before the join, on the key both sides
    share, so the wide table is shuffled once.
    """
    lines = (
        table(spark, sf_dir, "lineitem")
        .groupBy("l_orderkey")
        .agg(
            F.sum("l_quantity").alias("q"),
            F.count(F.lit(1)).alias("n"),
            F.sum(F.when(F.col("l_returnflag") == "R", 1).otherwise(0)).alias("r"),
            F.max("l_shipdate").alias("ing"),
            F.min("l_partkey").alias("pk"),
        )
    )
    orders = table(spark, sf_dir, "orders")
    customer = table(spark, sf_dir, "customer")
    part = table(spark, sf_dir, "part")
    return (
        orders.join(lines, F.col("l_orderkey") == F.col("o_orderkey"))
        .join(customer, F.col("c_custkey") == F.col("o_custkey"))
        .join(part, F.col("p_partkey") == F.col("pk"))
        .select(
            F.col("o_orderkey").alias("id"),
            F.col("p_name").alias("name"),
            F.concat("c_name", F.lit("/"), "p_name").alias("full_name"),
            F.col("c_name").alias("owner_login"),
            F.nullif("c_mktsegment", F.lit("HOUSEHOLD")).alias("language"),
            F.col("q").cast("bigint").alias("stargazers_count"),
            F.col("q").cast("bigint").alias("watchers_count"),
            F.col("n").cast("bigint").alias("forks_count"),
            F.col("r").cast("bigint").alias("open_issues_count"),
            F.floor("o_totalprice").cast("bigint").alias("size"),
            F.col("o_orderdate").alias("created_at"),
            F.col("ing").alias("ingested_at"),
        )
    )
