"""Language, quality and role models by their accuracy on rows they were not fitted on."""

from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from repo_signals.llm import chat, langid, quality_model
from repo_signals.llm.fit import labelled_sample
from repo_signals.llm.queries import fold


def test_language(docs, rows, nothing):
    model = langid.train_langid(docs, fold(4) != 2)
    got = langid.identify_language(docs, model).collect()
    assert len(got) == len(rows)
    lang = {r.doc_id: r.lang for r in docs.where((fold(4) == 2) & (F.col("doc_id") < 900000)).collect()}
    right = [r.lang_pred == lang[r.doc_id] for r in got if r.doc_id in lang]
    assert sum(right) >= 0.97 * len(right)
    assert all(0 <= r.score <= 1 for r in got)
    odd = {r.doc_id: r for r in got if r.doc_id and r.doc_id >= 900000}
    assert all(odd[k].lang_pred == "und" and odd[k].rejected for k in (900001, 900002, 900003, 900013))
    assert odd[900011].lang_pred != "und"
    assert langid.identify_language(nothing, model).collect() == []


def test_language_of_odd_tables(spark, docs, nothing):
    assert langid.train_langid(nothing) is None
    assert {r.lang_pred for r in langid.identify_language(docs, None).collect()} == {"und"}
    one = spark.createDataFrame([(1, "only text here", "xx"), (2, None, "xx"), (3, "more", None)], "doc_id long, text string, lang string")
    got = langid.identify_language(one, langid.train_langid(one)).collect()
    assert {r.lang_pred for r in got if r.doc_id != 2} == {"xx"}


def test_subwords_by_hand():
    import pyarrow as pa

    from repo_signals.llm.text import utf8

    texts = ["Ab, cde", "", "x", "ab"]
    ids, at = langid.subwords(*utf8(pa.array(texts)))
    # "_ab", "ab_", "_cd", "cde", "de_" and "_ab_", "_cde", "cde_"
    assert np.diff(at).tolist() == [8, 0, 1, 3]
    assert set(ids[at[3] : at[4]]) <= set(ids[: at[1]])


def test_quality_of_rows_left_out(spark):
    """The smallest table has too few labels to learn from; this one has four hundred."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    got = quality_model.quality_scores(docs, quality_model.fit_quality_model(docs, labels, fold(5) != 0)).collect()
    quality = {r.doc_id: r.quality for r in labels.where(fold(5) == 0).collect()}
    held = [(quality[r.doc_id], r.predicted) for r in got if r.doc_id in quality]
    assert sum(q == p for q, p in held) >= 0.95 * len(held)
    assert sum(p for q, p in held if q == 1) >= 0.98 * sum(q for q, _ in held)


def test_quality(docs, rows, labels, nothing):
    model = quality_model.fit_quality_model(docs, labels, fold(5) != 0)
    got = quality_model.quality_scores(docs, model).collect()
    assert len(got) == len(rows)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    kept = quality_model.of_quality(docs, model)
    assert kept.columns == docs.columns and kept.count() == sum(r.predicted for r in got)
    assert quality_model.quality_scores(nothing, model).collect() == []
    assert quality_model.fit_quality_model(nothing, labels) is None
    assert {r.score for r in quality_model.quality_scores(docs, None).collect()} == {0.5}


def test_dual_coordinate_descent_reaches_the_optimum():
    """No direction lowers the primal objective by much."""
    rng = np.random.default_rng(4)
    docs = [np.unique(rng.integers(0, 40, 8)) for _ in range(120)]
    y = np.array([int((d < 15).sum() > 2) for d in docs])
    ratio = np.ones(1 << quality_model.BUCKET_BITS, np.float32)
    cost = np.full(len(docs), 1.0)
    w, bias = quality_model.dual_coordinate_descent(docs, y, cost, ratio, rounds=400)

    def objective(w, bias):
        margins = np.array([w[d].sum() / np.sqrt(len(d)) + bias for d in docs])
        return 0.5 * (w @ w + bias**2) + (cost * np.maximum(0, 1 - (2 * y - 1) * margins)).sum()

    best = objective(w, bias)
    for _ in range(200):
        step = np.zeros_like(w)
        step[:40] = rng.normal(0, 0.02, 40)
        assert objective(w + step, bias + rng.normal(0, 0.02)) >= best - 0.02


def test_ratios_by_hand():
    docs, y = [np.array([1, 2]), np.array([2, 3])], np.array([1, 0])
    r = quality_model.log_count_ratios(docs, y)
    assert r[1] == pytest.approx(np.log(2)) and r[3] == pytest.approx(-np.log(2)) and r[2] == 0


def test_sample_is_bounded_and_weighted(spark):
    rows = [(k, "t", int(k % 10 == 0)) for k in range(5000)] + [(7, "other", 0), (None, "t", 1), (8, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, label int")
    got = labelled_sample(df, df, "label", 200).collect()
    sizes = defaultdict(list)
    for r in got:
        sizes[r.label].append(r.weight)
    assert all(120 < len(w) < 280 for w in sizes.values())
    assert set(sizes[0]) == {22.5} and set(sizes[1]) == {2.5}
    assert len({r.doc_id for r in got}) == len(got)


def plain_roles(model, transcripts):
    """Viterbi over each whole transcript."""
    return {c: chat.viterbi(model, np.array(s), model.start) for c, s in transcripts.items()}


def test_blocks_give_the_path_of_the_whole(spark, monkeypatch):
    monkeypatch.setattr(chat, "BLOCK_BITS", 3)
    rng = np.random.default_rng(6)
    log = lambda x: np.log(x / x.sum(axis=-1, keepdims=True))
    model = chat.Model(log(rng.random(chat.K)), log(rng.random((chat.K, chat.K))), log(rng.random((chat.K, chat.SYMBOLS))))
    transcripts = {k: rng.integers(0, chat.SYMBOLS, n).tolist() for k, n in enumerate([1, 2, 3, 30, 1, 1, 70, 5, 8, 8])}
    lines = [(c, s) for c, symbols in transcripts.items() for s in symbols]
    # Two sorted partitions, the second of which begins inside a transcript.
    rows = [(k if k < 21 else (1 << 33) + k - 21, c, s) for k, (c, s) in enumerate(lines)]
    df = spark.createDataFrame(rows, "mid long, conv_id long, symbol int").repartition(4)
    found = {r.mid: r for r in chat.recover_roles(df, model).collect()}
    whole = plain_roles(model, transcripts)
    at = defaultdict(int)
    for k, (mid, conv, _) in enumerate(rows):
        assert found[mid].state == whole[conv][at[conv]]
        at[conv] += 1
        nexts = whole[conv][at[conv]] if at[conv] < len(whole[conv]) else -1
        assert found[mid].next_state == nexts


def test_transcripts_are_recovered(spark, sf_dir):
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    lines = chat.transcripts(turns)
    seen = lines.withColumn("symbol", chat.symbol(F.col("line"), F.col("pos") == 0))
    model = chat.fit_roles(seen.where(F.crc32(F.col("conv_id").cast("string")) % 5 != 0))
    got = chat.format_transcripts(lines, model)
    both = got.join(lines.select("conv_id", "pos", "role", "at"), ["conv_id", "pos"]).collect()
    assert len(both) == lines.count()
    assert np.mean([r.role == r.role_pred for r in both]) > 0.85
    by_conv = defaultdict(list)
    for r in sorted(both, key=lambda r: (r.conv_id, r.pos)):
        by_conv[r.conv_id].append(r)
    for rows in by_conv.values():
        text = "\n".join(r.rendered for r in rows)
        heads = sum(text.count(chat.TURN % role) for role in chat.ROLES)
        assert heads == text.count(chat.END) == sum(r.new_turn for r in rows) and text.startswith("<|")


def test_odd_transcripts(spark):
    rows = [
        (1, 0, "User: hi"), (1, 1, None), (1, 2, "### Assistant: well"), (1, 3, "more\tof it"),
        (None, 0, "Human: x"), (None, 1, "AI: y"), (2, 0, ""), (3, 5, "[system]: a " + "long " * 5000), (3, 5, "[system]: b"),
    ]
    df = spark.createDataFrame(rows, "conv_id long, pos long, line string").withColumn("mid", F.lit(1)).withColumn("state", F.lit("x"))
    model = chat.fit_roles(spark.createDataFrame([], "conv_id long, turn long, at int, role string, symbol int"))
    assert chat.format_transcripts(df, model).count() == len(rows)
    assert chat.format_transcripts(df.limit(0), model).collect() == []
    markers = spark.createDataFrame([(r[2] or "",) for r in rows], "line string").select(chat.marker(F.col("line")).alias("m"))
    assert [r.m for r in markers.collect()] == [2, 0, 3, 0, 2, 3, 0, 1, 1]
