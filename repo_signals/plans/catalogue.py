"""The named queries: every operator on whole tables of the test data."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from repo_signals import schema
from repo_signals.functions.columns import flag, lookup, rounded, scalar, utc, utc_lenient, whole_days
from repo_signals.operators import (
    audit,
    dense,
    embed,
    encode,
    features,
    folds,
    frequent,
    metrics,
    model,
    ordering,
    owners,
    prep,
    quantiles,
    scoring,
    wide,
)
from repo_signals.operators.skew import left_join_spread
from repo_signals.plans import stages
from repo_signals.session import materialize, pin_utc, scratch_path
from repo_signals.sources import cache, readers, store, writers
from repo_signals.sources.fixture import repos, table

Query = Callable[[SparkSession, str], DataFrame]

CUTOFF = "1998-06-01"
SEGMENT_CODES = {"AUTOMOBILE": 0, "BUILDING": 1, "Unknown": 99}
PART_TOPICS = {
    "topic_fastener": ["bolt", "screw", "nut"],
    "topic_round": ["ring", "gear", "wheel"],
    "topic_colour": ["red", "blue", "green"],
    "topic_pattern": ["s.all", "wid.et"],
}
MODEL_COLUMNS = ["age_days", "forks_count", "open_issues_count", "size", "language"]
LANGUAGE_OF = {"AUTOMOBILE": "Python", "BUILDING": "Go", "FURNITURE": "Kotlin"}
ISO = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"

QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return rounded(fn(pin_utc(spark), sf_dir))

    QUERIES[fn.__name__] = run
    return fn


def wall(name: str):
    """A timestamp for the result, without a time zone."""
    return F.col(name).cast("timestamp_ntz").alias(name)


def non_embedding(clean: bool = True) -> list[str]:
    return schema.feature_names(clean, embedding_dim=0)


def labelled_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")


def dated_repos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repositories with an update date that can lie after the last ingestion."""
    updated = F.col("ingested_at") + F.make_dt_interval(days=F.col("open_issues_count").cast("int") * 30)
    return repos(spark, sf_dir).withColumn("updated_at", updated)


def blocked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return folds.with_blocks(prep.preprocess(repos(spark, sf_dir)))


def enriched_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    labelled = blocked(spark, sf_dir)
    return features.velocity(features.topic_flags(owners.owner_features(labelled)))


def strength_columns(clean: bool = True) -> list[str]:
    return [c for c in non_embedding(clean) if c != "language"]


def coded_repos(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Read for the codes, the folds and the rows, so the joins behind it run once.
    rows = materialize(prep.preprocess(repos(spark, sf_dir)), "rows")
    return model.coded_language(rows, encode.fit_codes(rows, "language"))


def with_reputation(df: DataFrame, *measures: str) -> DataFrame:
    """Rows with some of their owner's figures, gaps left open."""
    found = owners.owner_reputation(df).select("owner_login", *measures, "n_rows")
    return left_join_spread(df, found, "owner_login", "n_rows", "id").drop("n_rows")


def latest(df: DataFrame):
    return scalar(df.agg(F.max(utc("ingested_at")).alias("t")))["t"]


# --- sources and sinks -------------------------------------------------------------------------


@query
def scan_parquet(spark, sf):
    return readers.read_parquet_dir(spark, f"{sf}/orders.parquet")


@query
def scan_first_n_files(spark, sf):
    path = scratch_path(spark, "orders")
    orders = table(spark, sf, "orders")
    last = scalar(orders.agg(F.max("o_orderkey").alias("k")))["k"]
    quarter = F.floor(4 * F.col("o_orderkey") / (last + 1)).cast("int")
    # One file for each quarter of the keys, in the order of their names.
    orders.withColumn("quarter", quarter).repartition("quarter").write.partitionBy("quarter").parquet(path)
    part = readers.read_first_files(spark, path, 2)
    return part.groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"), F.max("o_orderkey").alias("last_key"))


@query
def scan_mixed_types(spark, sf):
    """Parts of one table whose columns differ in type."""
    path = scratch_path(spark, "mixed")
    items = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_returnflag")
    early, late = items.where("l_linenumber <= 3"), items.where("l_linenumber > 3")
    early.withColumns({"l_quantity": F.col("l_quantity").cast("int"), "part": F.lit(0)}).write.partitionBy("part").parquet(path)
    shorter = late.withColumns({"l_orderkey": F.col("l_orderkey").cast("string"), "part": F.lit(1)}).drop("l_returnflag")
    shorter.write.mode("append").partitionBy("part").parquet(path)
    return readers.read_mixed_parquet(spark, path)


@query
def sink_chunk_sizes(spark, sf):
    """How many files of which number of rows the sink for equal files leaves."""
    path = scratch_path(spark, "chunks")
    writers.write_equal_chunks(table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice"], path)
    sizes = readers.read_parquet_dir(spark, path).groupBy(F.col("_metadata.file_path").alias("file")).agg(F.count(F.lit(1)).alias("n_rows"))
    return sizes.groupBy("n_rows").agg(F.count(F.lit(1)).alias("n_files"))


@query
def json_rescue(spark, sf):
    """Documents of which some are cut off and some hold values that do not fit, all of them kept and counted."""
    orders = table(spark, sf, "orders")
    key = F.col("o_orderkey")
    doc = F.format_string(
        '{"id": %d, "name": "%s", "size": %s, "forks_count": %s, "owner": {"login": "%d"}}',
        key,
        "o_orderpriority",
        F.when(key % 5 == 0, '"large"').otherwise(F.col("o_custkey").cast("string")),
        F.when(key % 3 == 0, "[1]").otherwise("7"),
        "o_custkey",
    )
    line = F.when(key % 7 == 0, F.expr("left(doc, length(doc) - 4)")).otherwise(F.col("doc"))
    path = scratch_path(spark, "documents")
    writers.write_text(orders.withColumn("doc", doc).select(line.alias("value")), path)
    return readers.rescue_report(readers.rescue_repo_documents(spark, path))


@query
def sink_parquet_chunks(spark, sf):
    path = scratch_path(spark, "repos")
    writers.write_parquet_chunks(repos(spark, sf), path)
    return readers.read_parquet_dir(spark, path)


@query
def json_flatten(spark, sf):
    r = repos(spark, sf)
    listed = F.array(
        F.struct(F.col("stargazers_count"), F.col("forks_count")),
        F.struct(
            (F.col("forks_count") * 50).alias("stargazers_count"), F.col("open_issues_count").alias("forks_count")
        ),
    )
    docs = r.select(
        "id",
        "name",
        "full_name",
        "language",
        "size",
        "forks_count",
        "open_issues_count",
        "stargazers_count",
        F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("created_at"),
        F.struct(
            F.col("owner_login").alias("login"),
            F.when(F.col("size") > 250000, "Organization").otherwise("User").alias("type"),
            F.col("forks_count").alias("public_repos"),
            F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("created_at"),
        ).alias("owner"),
        F.when(F.col("open_issues_count") > 0, listed).alias("owner_repos"),
    )
    path = scratch_path(spark, "documents")
    writers.write_json(docs, path)
    flat = readers.flatten_repo_documents(readers.read_repo_documents(spark, path))
    return flat.select(
        "id",
        "name",
        "full_name",
        "description",
        "size",
        "language",
        "forks_count",
        "open_issues_count",
        "actual_stars",
        wall("created_at"),
        "owner_login",
        flag(F.col("owner_type") == "Organization").alias("owner_is_org"),
        "public_repos",
        *[c.alias(n) for n, c in owners.listed_stats(F.col("owner_repos")).items()],
    )


@query
def json_props(spark, sf):
    props = F.from_json("props", "k bigint, missing string")
    return table(spark, sf, "events").select(
        "event_id", props["k"].alias("k"), F.coalesce(props["missing"], F.lit("none")).alias("missing")
    )


@query
def csv_roundtrip(spark, sf):
    per_part = table(spark, sf, "lineitem").groupBy("l_partkey").agg(F.sum("l_quantity").alias("quantity"))
    weights = (
        per_part.join(table(spark, sf, "part"), F.col("p_partkey") == F.col("l_partkey"))
        .groupBy(F.col("p_name").alias("feature"))
        .agg(F.sum("quantity").alias("importance"))
    )
    path = scratch_path(spark, "importance")
    writers.write_csv(metrics.importance_top(weights, 20).select("feature", "importance", "pct"), path)
    return readers.read_csv(spark, path, schema.IMPORTANCE)


@query
def embedding_cache_incremental(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    labelled = docs.join(table(spark, sf, "labels").select("doc_id"), "doc_id", "left_semi")
    path = scratch_path(spark, "embeddings")
    cache.embed_with_cache(labelled, "text", "doc_id", path, "hashed-384", embed.hashed_embedding)
    done = cache.embed_with_cache(docs, "text", "doc_id", path, "hashed-384", embed.hashed_embedding)
    return done.select("doc_id", "text_hash", "from_cache", F.size("embedding").alias("dim"))


@query
def embedding_store_incremental(spark, sf):
    """The cache laid out by key: a second run reads only what it asks for, also after its batches are merged."""
    docs = table(spark, sf, "documents").select("doc_id", "text")
    labelled = docs.join(table(spark, sf, "labels").select("doc_id"), "doc_id", "left_semi")
    path = scratch_path(spark, "embeddings")
    store.embed_with_store(labelled, "text", "doc_id", path, "hashed-384", embed.hashed_embedding)
    store.compact(spark, path, "hashed-384")
    done = store.embed_with_store(docs, "text", "doc_id", path, "hashed-384", embed.hashed_embedding)
    return done.select("doc_id", "text_hash", "from_cache", F.size("embedding").alias("dim"))


@query
def union_parts(spark, sf):
    c = table(spark, sf, "customer").select(
        F.col("c_name").alias("name"),
        F.col("c_nationkey").alias("nation"),
        F.col("c_acctbal").alias("balance"),
        F.col("c_mktsegment").alias("segment"),
    )
    s = table(spark, sf, "supplier").select(
        F.col("s_name").alias("name"), F.col("s_nationkey").alias("nation"), F.col("s_acctbal").alias("balance")
    )
    return readers.union_by_name(c, s)


# --- preprocessing -----------------------------------------------------------------------------


@query
def parse_ts(spark, sf):
    local = F.date_format("ts", ISO)
    return table(spark, sf, "events").select(
        "event_id",
        utc(F.concat(local, F.lit("Z"))).cast("timestamp_ntz").alias("ts_utc"),
        F.unix_micros(utc(F.concat(local, F.lit("+02:00")))).alias("shifted_us"),
    )


@query
def parse_ts_lenient(spark, sf):
    iso = F.concat(F.date_format("ts", ISO), F.lit("Z"))
    raw = F.when(F.col("event_type") == "error", F.concat(F.lit("about "), iso)).otherwise(iso)
    parsed = table(spark, sf, "events").select("event_id", utc_lenient(raw).alias("parsed"))
    return parsed.select("event_id", wall("parsed"), flag(F.col("parsed").isNull()).alias("is_bad"))


@query
def age_days(spark, sf):
    mark = F.lit("2024-01-03 12:30:00").cast("timestamp")
    return table(spark, sf, "events").select(
        "event_id", whole_days("ts", mark).alias("days_after"), whole_days(mark, "ts").alias("days_before")
    )


@query
def log_target(spark, sf):
    return prep.preprocess(repos(spark, sf)).select("id", "log_stars")


@query
def preprocess(spark, sf):
    return prep.preprocess(repos(spark, sf)).select(
        "id", "language", "age_days", "log_stars", wall("created_at"), wall("ingested_at")
    )


@query
def age_filter(spark, sf):
    return prep.preprocess(repos(spark, sf), schema.MAX_AGE_DAYS).select("id", "age_days")


@query
def preprocess_violations(spark, sf):
    return prep.preprocess_violations(prep.preprocess(repos(spark, sf), schema.MAX_AGE_DAYS))


@query
def temporal_split_counts(spark, sf):
    return prep.temporal_split_counts(repos(spark, sf), CUTOFF)


@query
def feature_select(spark, sf):
    return prep.select_features(stages.enrich(repos(spark, sf)), schema.feature_names(clean=True), ["id"])


@query
def drop_sparse_columns(spark, sf):
    wide = labelled_documents(spark, sf).select("doc_id", "lang", "source", "n_chars", "quality", "toxic")
    return prep.drop_sparse_columns(wide)


@query
def fill_sentinel(spark, sf):
    return prep.fill_sentinel(labelled_documents(spark, sf).select("doc_id", "quality", "toxic"), ["quality", "toxic"])


@query
def median_impute(spark, sf):
    r = repos(spark, sf)
    gappy = r.withColumn("size", F.when(F.col("size") > 100000, F.col("size")))
    rows = with_reputation(gappy, "owner_std_stars", "owner_mean_forks")
    wanted = ["owner_std_stars", "owner_mean_forks", "size"]
    return prep.impute_median(rows.select("id", *wanted), wanted)


@query
def align_columns(spark, sf):
    wanted = ["size", "forks_count", "age_days", "topic_count", "open_issues_count"]
    return prep.align_columns(prep.preprocess(repos(spark, sf)), wanted, ["id"])


@query
def apply_defaults(spark, sf):
    wide = labelled_documents(spark, sf).select("doc_id", "quality", "toxic")
    return prep.apply_defaults(wide, {"quality": 0, "toxic": 1, "license": "none"})


# --- owners and lookups ------------------------------------------------------------------------


@query
def owner_reputation(spark, sf):
    out = owners.owner_reputation(repos(spark, sf)).drop("n_rows")
    return out.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("owner_first_repo", "owner_last_repo")})


@query
def owner_features_joined(spark, sf):
    out = owners.owner_features(prep.preprocess(repos(spark, sf)))
    logs = [f"log_{c}" for c in schema.OWNER_LOGGED]
    return out.select("id", "owner_login", *schema.OWNER_MEASURES, "owner_is_org", *logs)


@query
def owner_is_org(spark, sf):
    per_customer = table(spark, sf, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"))
    groups = (
        per_customer.join(table(spark, sf, "customer"), F.col("c_custkey") == F.col("o_custkey"))
        .join(table(spark, sf, "nation"), F.col("n_nationkey") == F.col("c_nationkey"))
        .groupBy(F.concat_ws("-", "n_name", "c_mktsegment").alias("owner_login"))
        .agg(F.sum("n").alias("owner_repo_count"))
    )
    return groups.withColumn("owner_is_org", owners.is_organisation("owner_login", "owner_repo_count"))


@query
def language_code_fixed(spark, sf):
    out = encode.fixed_language_code(repos(spark, sf), codes=SEGMENT_CODES)
    return out.select("id", "language", "language_code")


@query
def owner_stats_fallback(spark, sf):
    """Figures of the time before the cutoff for all rows; owners who were unknown then have the default profile."""
    r = materialize(repos(spark, sf), "repos")
    train, _ = prep.temporal_split(r, CUTOFF)
    out = owners.owner_stats_or_default(r.select("id", "owner_login"), owners.owner_reputation(train))
    return out.select("id", *schema.OWNER_FEATURES)


@query
def owner_reputation_as_of(spark, sf):
    """What was known of an owner before each of its repositories."""
    return owners.owner_history(prep.preprocess(repos(spark, sf)))


@query
def owner_reputation_loo(spark, sf):
    """What is known of an owner from its other repositories."""
    return owners.owner_leave_one_out(prep.preprocess(repos(spark, sf)))


@query
def owner_stats_serving(spark, sf):
    segment = F.col("c_mktsegment")
    first = table(spark, sf, "orders").groupBy("o_custkey").agg(F.min("o_orderdate").alias("owner_created_at"))
    profiles = (
        table(spark, sf, "customer")
        .join(first, F.col("o_custkey") == F.col("c_custkey"), "left")
        .select(
            F.col("c_name").alias("owner_login"),
            F.when(segment == "BUILDING", "Organization").otherwise("User").alias("owner_type"),
            F.when(segment == "FURNITURE", F.lit(0))
            .when(segment != "HOUSEHOLD", F.col("c_nationkey"))
            .alias("public_repos"),
            "owner_created_at",
        )
    )
    # Suppliers have a profile and no repositories.
    others = table(spark, sf, "supplier").select(
        F.col("s_name").alias("owner_login"), F.lit("User").alias("owner_type"), F.col("s_nationkey").alias("public_repos")
    )
    everyone = profiles.unionByName(others, allowMissingColumns=True)
    return owners.serving_owner_stats(everyone, repos(spark, sf), F.lit("2001-12-31 00:00:00").cast("timestamp"))


# --- features ----------------------------------------------------------------------------------


@query
def velocity(spark, sf):
    out = features.velocity(prep.preprocess(repos(spark, sf)))
    return out.select("id", "age_days_safe", *schema.VELOCITY_FEATURES)


@query
def velocity_missing_age(spark, sf):
    """Rates of repositories some of which have no known age."""
    rows = prep.preprocess(repos(spark, sf))
    gappy = rows.withColumn("age_days", F.when(F.col("open_issues_count") > 0, F.col("age_days")))
    return features.velocity(gappy).select("id", "age_days_safe", *schema.VELOCITY_FEATURES)


@query
def velocity_clean(spark, sf):
    out = features.velocity_clean(prep.preprocess(repos(spark, sf)))
    return out.select("id", "forks_per_day", "issues_per_day", "log_forks_per_day", "log_issues_per_day")


@query
def topic_flags_regex(spark, sf):
    docs = table(spark, sf, "documents").select(
        "doc_id", F.col("source").alias("name"), F.col("text").alias("description")
    )
    return features.topic_flags(docs).select("doc_id", *schema.TOPIC_FEATURES)


@query
def topic_flags_custom(spark, sf):
    parts = table(spark, sf, "part").select("p_partkey", F.col("p_name").alias("name"))
    return features.topic_flags(parts, topics=PART_TOPICS).select("p_partkey", *PART_TOPICS, "topic_count")


@query
def topic_flags_substring(spark, sf):
    docs = table(spark, sf, "documents").select(
        "doc_id", F.col("source").alias("name"), F.col("text").alias("full_name")
    )
    out = features.topic_flags(docs, ["name", "full_name"], schema.TOPIC_SUBSTRINGS, mode="substring")
    return out.select("doc_id", *schema.TOPIC_FEATURES)


@query
def embedding_text(spark, sf):
    return table(spark, sf, "documents").select(
        "doc_id",
        features.embedding_text("text", "source").alias("embedding_text"),
        F.length(features.embedding_text("text", "source", limit=schema.TEXT_LIMIT)).alias("limited_length"),
    )


@query
def embedding_wide(spark, sf):
    return features.embedding_wide(table(spark, sf, "embeddings"), "embedding", 64, "emb", ["vec_id"])


@query
def embedding_validation(spark, sf):
    return features.embedding_validation(table(spark, sf, "embeddings"), "embedding")


@query
def text_embed_hashed(spark, sf):
    docs = table(spark, sf, "documents").select(
        "doc_id", features.embedding_text("text", "source", limit=None).alias("text")
    )
    return embed.hashed_embedding(docs, "text").select("doc_id", "embedding")


@query
def text_embed_dense(spark, sf):
    """Dense vectors of all texts, from an encoder fitted on a bounded sample of them."""
    docs = table(spark, sf, "documents").select("doc_id", "text")
    encoder = dense.fit_dense_encoder(docs, "text", 64)
    return embed.encoded_embedding(docs, "text", encoder, dim=64).select("doc_id", "embedding")


@query
def text_embed_shape(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    vectors = embed.hashed_embedding(docs, "text").select("doc_id", "embedding")
    squares = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    return vectors.select("doc_id", F.size("embedding").alias("dim"), F.sqrt(squares).alias("norm"))


@query
def array_stats(spark, sf):
    stats = features.array_stats("embedding", 0.1)
    return table(spark, sf, "embeddings").select("vec_id", *[c.alias(n) for n, c in stats.items()])


@query
def math_features(spark, sf):
    r = repos(spark, sf)
    size, issues, forks = F.col("size"), F.col("open_issues_count"), F.col("forks_count")
    return r.select(
        "id",
        F.log1p("size").alias("log1p_size"),
        F.expm1(F.log1p("forks_count")).alias("expm1_forks"),
        F.abs(issues - forks).alias("abs_gap"),
        F.sqrt("size").alias("sqrt_size"),
        F.least(F.greatest(size, F.lit(1000)), F.lit(300000)).alias("clipped_size"),
        F.round(size / F.lit(1024), 2).alias("size_mb"),
        F.call_function("div", size + 19999, F.lit(20000)).alias("chunks"),
        F.try_divide(issues, forks).alias("issue_rate"),
    )


@query
def string_features(spark, sf):
    url = F.col("url")
    return table(spark, sf, "pages").select(
        "page_id",
        F.lower(url).alias("lowered"),
        flag(F.lower(url).rlike("blog|spam")).alias("has_word"),
        flag(url.startswith("https://")).alias("is_https"),
        flag(url.contains("example")).alias("has_example"),
        F.rtrim(url, F.lit("/")).alias("no_slash"),
        F.replace(url, F.lit("https://"), F.lit("")).alias("no_scheme"),
        F.split_part(url, F.lit("/"), F.lit(3)).alias("host"),
        F.concat(F.substring(url, 1, 12), F.lit("...")).alias("short"),
        F.length("html").alias("html_length"),
        F.concat_ws(" ", url, F.split_part(url, F.lit("/"), F.lit(4))).alias("joined"),
        F.format_string("%s: %d", F.split_part(url, F.lit("/"), F.lit(3)), F.length(url)).alias("label"),
    )


@query
def risk_bands(spark, sf):
    rate = F.col("open_issues_count") / F.col("forks_count")
    return repos(spark, sf).select("id", rate.alias("rate"), scoring.risk_band(rate).alias("risk"))


@query
def label_encode(spark, sf):
    rows = prep.preprocess(repos(spark, sf))
    out = encode.apply_codes(rows, encode.fit_codes(rows, "name"), "name", "name_code", "id")
    out = encode.apply_codes(out, encode.fit_codes(rows, "language"), "language", "language_code", "id")
    return out.select("id", "name", "name_code", "language", "language_code")


@query
def label_encode_holdout(spark, sf):
    rows = prep.preprocess(repos(spark, sf))
    train, _ = prep.temporal_split(rows, CUTOFF)
    codes = encode.fit_codes(train, "full_name")
    out = encode.apply_codes(rows, codes, "full_name", "name_code", "id", same_rows=False)
    return out.select("id", "full_name", "name_code")


# --- audit -------------------------------------------------------------------------------------


@query
def table_shape(spark, sf):
    return audit.table_shape(repos(spark, sf))


@query
def null_profile(spark, sf):
    return audit.null_profile(with_reputation(repos(spark, sf), "owner_std_stars"))


@query
def null_profile_nan(spark, sf):
    """Missing values that are NaN."""
    rate = F.when(F.col("open_issues_count") > 0, F.col("forks_count") / F.col("open_issues_count"))
    nan = F.coalesce(rate, F.lit(float("nan")))
    r = repos(spark, sf).select("id", "language", "forks_count", nan.alias("rate"), rate.alias("rate_null"))
    return audit.null_profile(r)


@query
def category_profile(spark, sf):
    return audit.category_profile(repos(spark, sf))


@query
def category_top(spark, sf):
    """The most frequent values of all text columns, proven from summaries."""
    return frequent.frequent_values(repos(spark, sf))


@query
def quantile_sketch(spark, sf):
    """Quantiles from one sketch per column, and whether their ranks keep the stated error."""
    return quantiles.judged_sketch(
        repos(spark, sf), ["stargazers_count", "size", "forks_count"], [0.01, 0.25, 0.5, 0.75, 0.99]
    ).select("column", "prob", "n", "rank_ok")


@query
def date_ranges(spark, sf):
    out = audit.date_ranges(dated_repos(spark, sf))
    return out.select("column", wall("min_date"), wall("max_date"))


@query
def target_summary(spark, sf):
    return audit.target_summary(repos(spark, sf))


@query
def leakage_correlations(spark, sf):
    return audit.leakage_correlations(repos(spark, sf))


@query
def mirror_check(spark, sf):
    return audit.mirror_check(repos(spark, sf))


@query
def risk_lists(spark, sf):
    return audit.risk_lists(audit.leakage_correlations(repos(spark, sf)))


@query
def future_dates(spark, sf):
    return audit.future_dates(dated_repos(spark, sf))


@query
def safe_features(spark, sf):
    return audit.safe_features(dated_repos(spark, sf))


@query
def correlation_matrix(spark, sf):
    return audit.correlation_matrix(repos(spark, sf))


@query
def correlation_matrix_wide(spark, sf):
    """All pairs of the 64 columns of a vector."""
    return wide.correlation_matrix_wide(table(spark, sf, "embeddings"), "embedding", 64)


@query
def target_correlation(spark, sf):
    rows = prep.preprocess(repos(spark, sf), schema.MAX_AGE_DAYS)
    return audit.target_correlation(
        rows, ["age_days", "forks_count", "watchers_count", "open_issues_count", "size", "log_stars"]
    )


@query
def leak_guard(spark, sf):
    return audit.leak_guard(stages.enrich(repos(spark, sf)), ["watchers_count", *schema.feature_names(clean=False)])


@query
def target_histogram(spark, sf):
    return audit.target_histogram(repos(spark, sf))


@query
def log_target_histogram(spark, sf):
    return audit.histogram(prep.preprocess(repos(spark, sf)), "log_stars")


@query
def target_kde(spark, sf):
    return audit.density_curve(repos(spark, sf), "stargazers_count")


@query
def target_kde_binned(spark, sf):
    return audit.binned_density(repos(spark, sf), "stargazers_count")


@query
def scatter_sample(spark, sf):
    return audit.scatter_sample(repos(spark, sf))


@query
def audit_report(spark, sf):
    return audit.audit_report(dated_repos(spark, sf))


@query
def audit_report_text(spark, sf):
    path = scratch_path(spark, "report")
    writers.write_text(audit.report_lines(audit.audit_report(dated_repos(spark, sf))), path)
    return spark.read.text(path).select(F.col("value").alias("line"))


# --- order and samples -------------------------------------------------------------------------


@query
def time_row_index(spark, sf):
    order = ["ingested_at", "id"]
    return ordering.with_row_index(repos(spark, sf).select(order), order).select("id", "row_idx")


@query
def topn_share(spark, sf):
    lines = table(spark, sf, "lineitem").select("l_returnflag", "l_partkey", F.col("l_quantity").alias("weight"))
    return ordering.top_n_share(lines, "l_returnflag", "l_partkey", "weight", 20)


@query
def sample_n(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    return ordering.hash_sample(orders, "o_orderkey", rows=10000)


@query
def sample_fraction(spark, sf):
    key = F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    lines = table(spark, sf, "lineitem").select(key.alias("line"), "l_quantity")
    return ordering.hash_sample(lines, "line", fraction=0.2)


# --- folds, scores, importance -----------------------------------------------------------------


@query
def ts_fold_bounds(spark, sf):
    return folds.fold_bounds(repos(spark, sf))


@query
def ts_fold_stats(spark, sf):
    out = folds.fold_stats(blocked(spark, sf))
    return out.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("train_last_seen", "test_first_seen")})


@query
def rmsle(spark, sf):
    r = repos(spark, sf)
    return metrics.rmsle(with_reputation(r, "owner_mean_stars"), "stargazers_count", "owner_mean_stars")


@query
def cv_summary(spark, sf):
    rows = blocked(spark, sf)
    predicted = metrics.mean_predictions(rows, folds.fold_stats(rows))
    return metrics.cv_summary(metrics.rmsle(predicted, "stargazers_count", "predicted", ["fold"]))


@query
def run_assessment(spark, sf):
    rows = blocked(spark, sf)
    predicted = metrics.mean_predictions(rows, folds.fold_stats(rows))
    return metrics.run_assessment(metrics.rmsle(predicted, "stargazers_count", "predicted", ["language", "fold"]))


@query
def importance_mean(spark, sf):
    return metrics.importance_mean(stages.strength_per_fold(enriched_blocks(spark, sf), strength_columns(clean=False)))


@query
def family_share(spark, sf):
    return stages.strength_families(enriched_blocks(spark, sf), strength_columns(clean=True), clean=True)


@query
def family_share_all(spark, sf):
    return stages.strength_families(enriched_blocks(spark, sf), strength_columns(clean=False), clean=False)


# --- model -------------------------------------------------------------------------------------


def checked(scores: DataFrame, preset: str, baseline: DataFrame) -> DataFrame:
    """Fold scores, with the error of the train mean and whether the fit has a sensible size and does not lose to it."""
    near = F.col("rmsle") <= F.col("mean_rmsle") * F.lit(1.05)
    rounds = F.col("best_iteration").between(1, model.PRESETS[preset].trees)
    means = baseline.select("fold", F.col("rmsle").alias("mean_rmsle"))
    return scores.join(F.broadcast(means), "fold").select(
        *scores.columns, "mean_rmsle", flag(rounds).alias("rounds_ok"), flag(near).alias("near_or_below_mean")
    )


def mean_scores(rows: DataFrame) -> DataFrame:
    """What the train mean of each fold scores, for rows with their blocks."""
    predicted = metrics.mean_predictions(rows, folds.fold_stats(rows))
    return metrics.rmsle(predicted, "stargazers_count", "predicted", ["fold"])


def coded_blocks(spark: SparkSession, sf: str) -> DataFrame:
    """The written input of all folds."""
    return materialize(folds.with_blocks(coded_repos(spark, sf)), "blocks")


@query
def gbt_cv(spark, sf):
    rows = coded_blocks(spark, sf)
    scores, _ = model.cross_validate(rows, MODEL_COLUMNS)
    return checked(scores, "metadata", mean_scores(rows))


@query
def gbt_cv_patience(spark, sf):
    """Boosting that goes on for 50 rounds without a gain before it stops."""
    rows = coded_blocks(spark, sf)
    scores, _ = model.cross_validate(rows, MODEL_COLUMNS, patience=50)
    return checked(scores, "metadata", mean_scores(rows))


@query
def gbt_cv_embeddings(spark, sf):
    rows = coded_blocks(spark, sf)
    embedded = embed.hashed_embedding(rows, "full_name")
    scores, _ = model.cross_validate(embedded, MODEL_COLUMNS, preset="embeddings", embedding="embedding")
    return checked(scores, "embeddings", mean_scores(rows))


@query
def gbt_importance(spark, sf):
    """Mean importance over the folds: how often a feature splits, its rank and its share."""
    _, weights = model.cross_validate(coded_blocks(spark, sf), MODEL_COLUMNS)
    return metrics.importance_top(metrics.importance_mean(weights), len(MODEL_COLUMNS))


@query
def gbt_family_share(spark, sf):
    """Importance of the feature families, from the trees of the folds."""
    enriched = materialize(stages.enrich(repos(spark, sf)), "enriched")
    coded = model.coded_language(enriched, encode.fit_codes(enriched, "language"))
    _, weights = model.cross_validate(folds.with_blocks(coded), non_embedding(clean=True))
    return metrics.family_share(metrics.importance_mean(weights), metrics.family_rules("feature", True))


def fitted(spark: SparkSession, sf: str) -> tuple[DataFrame, model.Scorer, int]:
    """The last step of training: as many trees as the folds settled on, on all rows."""
    # Read by every step, so the joins behind it run once.
    rows = materialize(prep.preprocess(repos(spark, sf)), "rows")
    codes = encode.fit_codes(rows, "language")
    coded = model.coded_language(rows, codes)
    scores, _ = model.cross_validate(folds.with_blocks(coded), MODEL_COLUMNS)
    trees = model.settled_trees(scores)
    return rows, model.Scorer(model.refit(coded, MODEL_COLUMNS, "metadata", trees), codes, MODEL_COLUMNS), trees


@query
def gbt_refit(spark, sf):
    """Splits and gain of every feature in the final fit, and its number of trees."""
    _, scorer, trees = fitted(spark, sf)
    last = scorer.model.stages[-1]
    counts = model.split_counts(spark, last, MODEL_COLUMNS)
    return counts.withColumns({"n_trees": F.lit(last.getNumTrees), "trees_ok": flag(F.lit(last.getNumTrees == trees))})


def trained(spark: SparkSession, sf: str, clean: bool, embedding: str | None) -> DataFrame:
    """The whole course: text, cache, embedding, features, folds, final fit, scoring.

    Every row with its prediction, the scores of the folds, and the number of features listed as important.
    """
    ready = repos(spark, sf).withColumn("description", F.col("full_name"))
    if embedding:
        ready = stages.processed(ready, scratch_path(spark, "embeddings"))
    path = scratch_path(spark, "enriched")
    writers.write_parquet(stages.enrich(ready), path)
    enriched = readers.read_parquet_dir(spark, path)
    run = stages.train(enriched, clean=clean, embedding=embedding)
    csv = scratch_path(spark, "importance")
    writers.write_csv(run.importance.select("feature", "importance", "pct"), csv)
    listed = scalar(readers.read_csv(spark, csv, schema.IMPORTANCE).agg(F.count(F.lit(1)).alias("n")))["n"]
    ordered = F.array_sort(F.collect_list(F.struct("fold", "best_iteration")))
    # Joined inside the summary: a subquery cannot stand in a higher-order function.
    joined = F.array_join(F.transform(ordered, lambda r: r["best_iteration"].cast("string")), ", ")
    rounds = scalar(run.scores.agg(joined.alias("r")))["r"]
    summary = scalar(run.summary)
    return run.scorer.score(enriched).select(
        "*",
        *[summary[c].alias(c) for c in ("mean_rmsle", "std_rmsle", "scores")],
        rounds.alias("best_iterations"),
        listed.alias("n_listed"),
    )


@query
def final_training(spark, sf):
    return trained(spark, sf, True, None)


@query
def pipeline_clean(spark, sf):
    return trained(spark, sf, True, "embedding")


@query
def pipeline_leaked(spark, sf):
    return trained(spark, sf, False, "embedding")


@query
def model_roundtrip(spark, sf):
    rows, scorer, _ = fitted(spark, sf)
    path = scratch_path(spark, "scorer")
    scorer.save(path)
    again = model.Scorer.load(spark, path)
    before = scorer.score(rows).select("id", F.col("predicted_stars").alias("before"))
    after = again.score(rows).select("id", "predicted_stars", "input_features")
    return after.join(before, "id").select(
        "id", "input_features", (F.col("before") - F.col("predicted_stars")).alias("difference")
    )


@query
def score_batch(spark, sf):
    rows, scorer, _ = fitted(spark, sf)
    return scorer.score(rows).withColumn("scored", flag(F.col("predicted_stars") >= 0))


@query
def holdout_eval(spark, sf):
    cutoff = "2000-06-01"
    r = materialize(repos(spark, sf), "repos")
    out = model.holdout_evaluation(r, cutoff)
    rounds = F.col("best_iteration").between(1, model.PRESETS["metadata"].trees)
    train, test = prep.temporal_split(prep.preprocess(r), cutoff)
    middle = scalar(train.agg(F.expm1(F.avg("log_stars")).alias("m")))["m"]
    mean = scalar(metrics.rmsle(test.withColumn("predicted", middle), "stargazers_count", "predicted"))["rmsle"]
    near = flag(F.col("rmsle") <= F.col("mean_rmsle") * F.lit(1.05))
    return out.withColumn("mean_rmsle", mean).withColumns({"rounds_ok": flag(rounds), "near_or_below_mean": near})


# --- scoring and explanation -------------------------------------------------------------------


@query
def url_parts(spark, sf):
    out = scoring.url_parts(table(spark, sf, "pages"), "url", prefix="https://")
    return out.select("page_id", "owner_login", "repo_name", "is_valid")


@query
def what_if_owner(spark, sf):
    rows = owners.owner_features(prep.preprocess(repos(spark, sf)))
    scenario = rows.select(
        "id",
        F.col("forks_count").alias("forks"),
        "age_days",
        F.col("owner_mean_stars").alias("mean_stars"),
        F.col("owner_total_stars").alias("total_stars"),
        F.col("owner_repo_count").alias("repos"),
        F.col("owner_is_org").alias("is_org"),
    )
    return scoring.what_if_owner(scenario).select("id", *schema.OWNER_FEATURES)


@query
def scoring_vector(spark, sf):
    """The whole contract: all rows, with owner figures of the time before the cutoff."""
    r = materialize(repos(spark, sf), "repos")
    named = r.withColumn("language", lookup("language", LANGUAGE_OF, "Cobol"))
    train, _ = prep.temporal_split(r, CUTOFF)
    return scoring.scoring_vector(named, owners.owner_reputation(train), latest(r))


@query
def scoring_vector_dense(spark, sf):
    """The same with its vector part filled by the dense encoder, fitted on the names themselves."""
    r = materialize(repos(spark, sf), "repos")
    named = r.withColumn("language", lookup("language", LANGUAGE_OF, "Cobol"))
    train, _ = prep.temporal_split(r, CUTOFF)
    encoder = dense.fit_dense_encoder(train, "full_name", schema.EMBEDDING_DIM)

    def encoded(df: DataFrame, text: str, out: str) -> DataFrame:
        return embed.encoded_embedding(df, text, encoder, out, schema.EMBEDDING_DIM)

    return scoring.scoring_vector(named, owners.owner_reputation(train), latest(r), embed=encoded)


@query
def scoring_vector_floored(spark, sf):
    """The other serving entry: ages are no less than a day, 305 days where nothing is known."""
    train, test = prep.temporal_split(repos(spark, sf), CUTOFF)
    undated = test.withColumn("created_at", F.when(F.col("forks_count") > 1, F.col("created_at")))
    first = scalar(train.agg(F.min("created_at").alias("t")))["t"]
    out = scoring.scoring_vector(undated, None, first, ["age_days", "size"], default_age=305, age_floor=1)
    return out.select("id", "age_days", "size")


@query
def performance_class(spark, sf):
    rows = owners.owner_features(prep.preprocess(repos(spark, sf)))
    verdict = scoring.performance_class("stargazers_count", "owner_mean_stars")
    return rows.select("id", "stargazers_count", "owner_mean_stars", verdict.alias("performance"))


@query
def popularity_band(spark, sf):
    rows = owners.owner_features(prep.preprocess(repos(spark, sf)))
    return rows.select(
        "id",
        F.col("owner_total_stars").alias("predicted"),
        scoring.popularity_band("owner_total_stars").alias("band"),
        scoring.axis_end("owner_total_stars").alias("axis_end"),
    )


@query
def contribution_breakdown(spark, sf):
    rows = owners.owner_features(prep.preprocess(repos(spark, sf))).withColumn("description", F.col("full_name"))
    return scoring.contribution_breakdown(rows).select("id", "category", "influence_pct")


@query
def repo_summary(spark, sf):
    return scoring.repo_summary(owners.owner_features(prep.preprocess(repos(spark, sf))))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Risk bands of every enriched feature against the target."""
    wide = stages.enrich(repos(pin_utc(spark), sf_dir))
    return rounded(audit.leakage_correlations(wide))
