"""The pipeline's stages, one after another, against plain Python on what each of them is given."""

import re
import zlib
from collections import Counter

import numpy as np
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from repo_signals.llm.packing import binary_lengths, encoder, vocabulary_path
from repo_signals.llm.queries import ORACLES, QUERIES
from repo_signals.session import materialize
from test_dedup import plain_components, plain_lines
from test_scans import plain_secrets


@pytest.fixture(scope="module")
def stages(spark, sf_dir, docs):
    """What goes into each stage, and what comes out of the last."""
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        out.append(materialize(stage(spark, out[-1], sf_dir), name))
    return out


def texts(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def test_columns_stay(stages, docs):
    assert all(df.columns == docs.columns for df in stages[:-1])


def test_quality_stage_keeps_clean_documents(spark, stages, labels):
    kept = {r.doc_id for r in stages[1].collect()}
    good = [r.doc_id for r in labels.where("quality = 1").collect()]
    assert sum(d in kept for d in good) >= 0.98 * len(good)


def test_quality_stage_rejects(spark):
    """On a table with four hundred labels; the smallest has a dozen rejects to learn from."""
    sf_dir = "/root/testdata/sf0.01"
    stage = dict(corpus_pipeline.STAGES)["quality_classifier"]
    kept = {r.doc_id for r in stage(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"), sf_dir).collect()}
    quality = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    good = [d for d, q in quality.items() if q == 1]
    bad = [d for d, q in quality.items() if q == 0]
    assert sum(d in kept for d in good) >= 0.98 * len(good)
    assert sum(d in kept for d in bad) <= 0.2 * len(bad)


def test_line_stage(stages):
    given, got = texts(stages[1]), Counter(texts(stages[2]))
    wanted = Counter()
    for (doc, _, _, text), n in plain_lines(given).items():
        wanted[doc, text] += n
    assert got == wanted


def test_near_copy_stage(stages):
    given = texts(stages[2])
    wanted = {component for (_, _, component) in plain_components(given) if component is not None}
    got = Counter(doc for doc, _ in texts(stages[3]) if doc is not None)
    assert got == Counter(dict.fromkeys(wanted, 1))


def test_secret_stage(stages):
    given, got = dict(texts(stages[3])), dict(texts(stages[4]))
    assert given.keys() == got.keys()
    for doc, text in given.items():
        if text and not plain_secrets(text) and not re.search(r"[A-Za-z0-9+/_-]{20,}", text):
            assert got[doc] == text
        for span in plain_secrets(text):
            assert span[4] not in got[doc]


def test_packing_stage(stages):
    by_doc = Counter(r.doc_id for r in stages[5].collect())
    sizes = {r.doc_id: r.doc_tokens for r in stages[5].collect()}
    assert by_doc == Counter({d: len(binary_lengths(n)) for d, n in sizes.items()})
    assert set(by_doc) == {doc for doc, _ in texts(stages[4])}


def test_sequences_hold_their_ids(spark, sf_dir):
    """The last stage and the packing query return the token ids themselves, from which every text can be read."""
    texts = {1: "One text, " * 700, 2: None, 3: "", 4: "日本語 の テキスト 🎉 <|endoftext|> done"}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    found = {}
    for r in sorted(dict(corpus_pipeline.STAGES)["packing"](spark, df, sf_dir).collect(), key=lambda r: (r.doc_id, r.start)):
        assert len(r.ids) == r.length and zlib.crc32(np.array(r.ids, "<u4")) == r.ids_crc32
        found.setdefault(r.doc_id, []).extend(r.ids)
    read = encoder(vocabulary_path())
    assert {d: read.decode(ids[:-1]) for d, ids in found.items()} == {d: t or "" for d, t in texts.items()}
    assert all(len(r.ids) == r.length for r in QUERIES["op10_packing"](spark, sf_dir).select("ids", "length").collect())


def test_queries_are_registered():
    names = entry.queries()
    assert "pipeline" in names and set(QUERIES) <= set(names) and set(ORACLES) <= set(entry.oracle_sql())
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in QUERIES) == list(range(1, 11))


def test_twins(spark, sf_dir):
    import check

    duck = check.duck(sf_dir)
    for name, sql in ORACLES.items():
        good, note = check.compare(spark, duck, name, QUERIES[name], sql, sf_dir)
        assert good, note
