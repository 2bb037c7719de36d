from collections import Counter

import numpy as np
import pytest
from pyspark.errors import AnalysisException
from pyspark.ml.feature import HashingTF
from pyspark.sql import functions as F

from repo_signals import schema
from repo_signals.operators import embed, features, owners, prep
from repo_signals.plans import stages
from repo_signals.sources import cache, readers
from repo_signals.session import scratch_path


def test_owner_reputation(small_repos):
    rows = {r.owner_login: r for r in owners.owner_reputation(small_repos).collect()}
    assert set(rows) == {"acme", "google-lab"}
    acme = rows["acme"]
    assert (acme.owner_repo_count, acme.owner_total_stars, acme.owner_total_forks) == (3, 311, 56)
    assert acme.owner_std_stars == pytest.approx(np.std([10, 200, 101], ddof=1))
    assert acme.owner_success_rate == pytest.approx(2 / 3)
    assert (acme.owner_tenure_days, acme.owner_active_days, acme.owner_is_org) == (11, 4, 0)
    assert rows["google-lab"].owner_is_org == 1
    assert rows["google-lab"].owner_std_stars is None


def test_owner_figures_without_the_row_itself(spark):
    """Earlier rows only, or all other rows; one owner holds most rows, one has a single row, one is unknown."""
    rng = np.random.default_rng(3)
    rows = []
    for k in range(240):
        owner = "big" if k % 4 else ("lone%d" % k if k % 8 else None)
        stars = None if k % 31 == 5 else int(rng.integers(0, 300))
        rows.append((k, owner, f"2024-01-{1 + int(rng.integers(0, 28)):02d}T00:00:00Z", stars, int(rng.integers(0, 9))))
    df = spark.createDataFrame(rows, "id int, owner_login string, created_at string, stargazers_count int, forks_count int")
    df = df.repartition(6)
    before = {r.id: r for r in owners.owner_history(df).collect()}
    others = {r.id: r for r in owners.owner_leave_one_out(df).collect()}
    assert len(before) == len(others) == len(rows)
    for k, owner, at, stars, _ in rows:
        mine = [r for r in rows if owner is not None and r[1] == owner]
        for got, part, prefix in (
            (before[k], [r for r in mine if (r[2], r[0]) < (at, k)], "owner_prior"),
            (others[k], [r for r in mine if r[0] != k], "owner_loo"),
        ):
            known = [r[3] for r in part if r[3] is not None]
            figure = lambda name: got[f"{prefix}_{name}"]
            assert (figure("count"), figure("total_stars")) == (len(known), sum(known))
            assert figure("mean_stars") == (pytest.approx(np.mean(known)) if known else None)
            assert figure("mean_forks") == (pytest.approx(np.mean([r[4] for r in part])) if part else None)
            assert figure("success_rate") == (pytest.approx(np.mean([v is not None and v > 100 for *_, v, _f in part])) if part else None)
        known = [r[3] for r in mine if (r[2], r[0]) < (at, k) and r[3] is not None]
        assert before[k].owner_prior_std_stars == (pytest.approx(np.std(known, ddof=1)) if len(known) > 1 else None)


def test_tenure_to_a_given_day(small_repos):
    rows = {r.owner_login: r.owner_tenure_days for r in owners.owner_reputation(small_repos, as_of="2024-02-01").collect()}
    assert rows["acme"] == 31


def test_owner_features_fill_with_row_medians(small_repos):
    rows = {r.id: r for r in owners.owner_features(prep.preprocess(small_repos)).collect()}
    assert len(rows) == 5
    spread = np.std([10, 200, 101], ddof=1)
    # Three rows of acme and one of google-lab know the mean; the row without an owner gets their median.
    assert rows[4].owner_mean_stars == pytest.approx(np.median([311 / 3] * 3 + [7]))
    assert rows[3].owner_std_stars == pytest.approx(spread)
    assert rows[4].owner_std_stars == pytest.approx(spread)
    assert rows[4].owner_is_org == 0
    assert rows[1].log_owner_total_stars == pytest.approx(np.log1p(311))


def test_owner_features_without_owner_or_dates(small_repos):
    bare = small_repos.drop("owner_login")
    assert owners.owner_features(bare).columns == bare.columns
    undated = owners.owner_features(small_repos.drop("created_at", "ingested_at"))
    assert "owner_tenure_days" not in undated.columns and "log_owner_total_stars" in undated.columns
    assert undated.count() == 5


def test_org_by_size(spark):
    df = spark.createDataFrame([("someone", 100), ("someone", 101), ("MicroSoft-x", 1), (None, 1)], "o string, n int")
    assert [r.f for r in df.select(owners.is_organisation("o", "n").alias("f")).collect()] == [0, 1, 1, 0]


def test_listed_stats(spark):
    df = spark.createDataFrame([([(10, 1), (200, 3), (None, None)],), ([],), (None,)], "l array<struct<stargazers_count:bigint,forks_count:bigint>>")
    rows = df.select(*[c.alias(n) for n, c in owners.listed_stats(F.col("l")).items()]).collect()
    assert rows[0].owner_total_stars == 210
    assert rows[0].owner_std_stars == pytest.approx(np.std([10, 200, 0]))
    assert rows[0].owner_success_rate == pytest.approx(1 / 3)
    for empty in rows[1:]:
        assert (empty.owner_total_stars, empty.owner_std_stars, empty.owner_total_forks, empty.owner_success_rate) == (100, 0, 20, 0)


def test_serving_owner_stats(spark):
    profiles = spark.createDataFrame(
        [("a", "Organization", 0, "2024-01-01"), ("b", "User", None, None), ("c", "User", None, "2024-01-09")],
        "owner_login string, owner_type string, public_repos int, owner_created_at string",
    )
    listed = spark.createDataFrame([("a", 10, 1), ("a", 200, 3), ("c", 5, None)], "owner_login string, stargazers_count int, forks_count int")
    out = owners.serving_owner_stats(profiles, listed, F.lit("2024-01-11").cast("timestamp"))
    rows = {r.owner_login: r for r in out.collect()}
    assert (rows["a"].owner_repo_count, rows["a"].owner_is_org, rows["a"].owner_tenure_days) == (1, 1, 10)
    assert rows["a"].owner_std_stars == pytest.approx(95)
    assert (rows["b"].owner_total_stars, rows["b"].owner_repo_count, rows["b"].owner_tenure_days) == (100, 1, 0)
    assert (rows["c"].owner_repo_count, rows["c"].owner_mean_forks, rows["c"].owner_active_days) == (1, 0, 2)


def test_owner_fallback_is_whole_profile(spark, small_repos):
    known = owners.owner_reputation(small_repos).where("owner_login = 'acme'")
    rows = {r.id: r for r in owners.owner_stats_or_default(small_repos, known).collect()}
    assert rows[1].owner_total_stars == 311
    assert (rows[3].owner_total_stars, rows[3].owner_std_stars, rows[3].owner_success_rate) == (100, 50, 0.1)
    assert rows[3].log_owner_total_stars == pytest.approx(np.log1p(100))
    assert rows[4].owner_repo_count == 1


def test_topics_regex_and_substring_differ(spark):
    df = spark.createDataFrame([(1, "nextxjs", None), (2, "next.js", "x"), (3, "storage", ""), (4, None, None), (5, "NETFLIX", "auto-gpt")], "id int, name string, description string")
    regex = {r.id: r for r in features.topic_flags(df).collect()}
    plain = {r.id: r for r in features.topic_flags(df, mode="substring", topics=schema.TOPIC_SUBSTRINGS).collect()}
    assert [regex[i].topic_web_react for i in (1, 2, 3, 4)] == [1, 1, 0, 0]
    assert [plain[i].topic_web_react for i in (1, 2, 3, 4)] == [0, 1, 0, 0]
    assert regex[3].topic_ai_rag == 1
    assert regex[5].topic_data_tensorflow == 1 and regex[5].topic_ai_agent == 1 and regex[5].topic_ai_llm == 1
    assert regex[5].topic_count == 3


def test_topics_twice_and_without_text(spark, small_repos):
    once = features.topic_flags(small_repos)
    twice = features.topic_flags(once)
    assert sorted(map(str, once.collect())) == sorted(map(str, twice.collect()))
    bare = features.topic_flags(spark.range(1)).first()
    assert bare.topic_count == 0 and bare.topic_ai_llm == 0


def test_topic_dot_crosses_everything_but_line_feed(spark):
    df = spark.createDataFrame([("next\rjs",), ("next\njs",), ("next js",)], "name string")
    assert [r.topic_web_react for r in features.topic_flags(df).collect()] == [1, 0, 1]


def test_topic_search_reads_whole_texts(spark):
    df = spark.createDataFrame([("x " * 50_000 + "kubernetes",)], "description string")
    assert features.topic_flags(df).first().topic_devops_k8s == 1


def test_velocity(small_repos):
    rows = {r.id: r for r in features.velocity(prep.preprocess(small_repos)).collect()}
    assert rows[2].age_days_safe == 1 and rows[2].stars_per_day == 200
    assert rows[1].fork_to_star_ratio == pytest.approx(2 / 11)
    clean = {r.id: r for r in features.velocity_clean(prep.preprocess(small_repos)).collect()}
    assert clean[1].log_forks_per_day == pytest.approx(rows[1].log_forks_per_day)
    assert not {"stars_per_day"} & set(features.velocity_clean(prep.preprocess(small_repos)).columns)


def test_enrich_adds_every_non_embedding_feature(small_repos):
    have = set(stages.enrich(small_repos).columns)
    assert set(schema.feature_names(clean=False, embedding_dim=0)) <= have


def test_feature_registry_sizes():
    assert len(schema.feature_names(clean=True)) == 416
    assert len(schema.feature_names(clean=False)) == 420


def test_embedding_text(spark):
    df = spark.createDataFrame(
        [(1, "    ", " n "), (2, None, None), (3, "y" * 2000, "n"), (4, "y" * 2001, "n"), (5, "\t d ", "n")], "id int, d string, n string"
    )
    got = {r.id: r.t for r in df.select("id", features.embedding_text("d", "n", schema.TEXT_LIMIT).alias("t")).collect()}
    assert got == {1: "n", 2: schema.NO_TEXT, 3: "y" * 2000, 4: "y" * 2000 + "...", 5: "d"}
    whole = df.where("id = 4").select(features.embedding_text("d", "n").alias("t")).first().t
    assert len(whole) == 2001


def test_hashed_embedding(spark):
    df = spark.createDataFrame([(1, "a b b"), (2, "   "), (3, None), (4, "a b b")], "id int, t string")
    rows = {r.id: np.array(r.embedding) for r in embed.hashed_embedding(df, "t").collect()}
    assert rows[1].shape == (384,)
    assert np.linalg.norm(rows[1]) == pytest.approx(1, abs=1e-6)
    assert not rows[2].any() and not rows[3].any()
    assert (rows[1] == rows[4]).all()


def test_hashed_embedding_counts_every_term_of_the_text(spark):
    text = "Alpha beta BETA " * 3000 + "omega"
    got = np.array(embed.hashed_embedding(spark.createDataFrame([(text,)], "t string"), "t").first().embedding)
    want = np.zeros(384)
    hashing = HashingTF(numFeatures=384)
    for term, n in Counter(text.lower().split()).items():
        want[hashing.indexOf(term)] += n
    assert got == pytest.approx(want / np.linalg.norm(want), abs=1e-6)


def test_pluggable_encoder(spark):
    def make():
        def encode(texts):
            assert len(texts) <= embed.ENCODER_BATCH
            return np.array([[len(t), 1.0] for t in texts])

        return encode

    df = spark.createDataFrame([(i, "x" * (i % 5)) for i in range(100)], "id int, t string")
    rows = {r.id: r.embedding for r in embed.encoded_embedding(df, "t", make, dim=2).collect()}
    assert rows[0] == [0.0, 0.0]
    assert rows[3] == pytest.approx([3 / np.sqrt(10), 1 / np.sqrt(10)])


def test_embedding_views(spark):
    df = spark.createDataFrame([(1, [0.6, 0.8]), (2, [1.0, 0.0])], "id int, e array<float>")
    assert features.embedding_wide(df, "e", 2, "emb", ["id"]).columns == ["id", "emb_0", "emb_1"]
    row = features.embedding_validation(df, "e").first()
    assert (row.n_rows, row.min_dim, row.max_dim, row.null_elements, row.null_vectors) == (2, 2, 2, 0, 0)
    assert row.mean_norm == pytest.approx(1, abs=1e-6)


def test_cache_encodes_each_text_once(spark):
    path = scratch_path(spark, "cache")
    seen = spark.sparkContext.accumulator(0)

    def counting(df, text, out):
        def make():
            def encode(texts):
                seen.add(len(texts))
                return np.array([[len(t), 1.0] for t in texts])

            return encode

        return embed.encoded_embedding(df, text, make, out, dim=2)

    first = spark.createDataFrame([(1, "a"), (2, "bb"), (3, "a")], "id int, t string")
    cache.embed_with_cache(first, "t", "id", path, "m", counting)
    assert seen.value == 2
    both = spark.createDataFrame([(i, "a") for i in range(50)] + [(60, "ccc"), (61, "bb")], "id int, t string")
    out = cache.embed_with_cache(both, "t", "id", path, "m", counting)
    assert seen.value == 3
    rows = {r.id: r for r in out.collect()}
    assert len(rows) == 52
    assert rows[0].from_cache == 1 and rows[60].from_cache == 0
    assert rows[60].embedding == pytest.approx([3 / np.sqrt(10), 1 / np.sqrt(10)])
    assert cache.read_cache(spark, path, "other").count() == 0


def test_missing_cache_is_none_and_missing_folder_raises(spark):
    assert cache.read_cache(spark, scratch_path(spark, "none"), "m") is None
    with pytest.raises(AnalysisException):
        readers.read_first_files(spark, scratch_path(spark, "none"), 2)
