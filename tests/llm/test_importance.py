"""Importance resampling against plain Python."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa

from repo_signals.llm import importance
from repo_signals.llm.importance import crc32_spans, importance_resample, resampled_documents

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def features(text, ngrams):
    found = WORD.findall((text or "").translate(FOLD))
    runs = [" ".join(found[k : k + n]) for n in range(1, ngrams + 1) for k in range(len(found) - n + 1)]
    return len(found), [zlib.crc32(r.encode()) % 10000 for r in runs]


def plain(rows, target, ngrams=1, percent=10, least=20):
    """Rows without rank, sorted, and the scores of the drawn rows in order."""
    mine = [(doc, *features(text, ngrams)) for doc, text in rows]
    s = Counter(b for _, _, f in mine for b in f)
    t = Counter(b for text in target for b in features(text, ngrams)[1])
    n_s, n_t = sum(s.values()), sum(t.values())
    out = []
    for doc, n_words, f in mine:
        gains = [math.floor(1000 * math.log((t[b] + 1) * (n_s + 10000) / ((s[b] + 1) * (n_t + 10000)))) for b in f]
        weight = sum(gains) // len(gains) if gains else 0
        h = int(hashlib.sha256(f"2024:{'' if doc is None else doc}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append((doc, len(f), weight, score, n_words >= least))
    able = sorted((r for r in out if r[4]), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1]))
    rank = Counter((r[:4], k + 1) for k, r in enumerate(able[: percent * len(able) // 100]))
    return Counter(r[:4] for r in out), rank


def found(df):
    rows = df.select("doc_id", "n_features", "weight", "score", "rank").collect()
    return Counter(tuple(r)[:4] for r in rows), Counter((tuple(r)[:4], r["rank"]) for r in rows if r["rank"] is not None)


def test_resample(spark, sf_dir, docs, rows):
    target = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    texts = [r.text for r in target.select("text").collect()]
    assert found(importance_resample(docs, target)) == plain(rows, texts)
    got = found(importance_resample(docs, target, ngrams=2, percent=50, least=3))
    assert got == plain(rows, texts, ngrams=2, percent=50, least=3)


def test_ranks_over_many_runs(spark):
    """Ties, a document that makes up a third of the rows, and more segments than rows in some."""
    text = "one two three four five six seven eight nine ten " * 2
    rows = [(7 if k % 3 == 0 else k, text if k % 5 else text + "w%d" % k) for k in range(900)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(13)
    target = spark.createDataFrame([("one two",)], "text string")
    spark.conf.set("spark.sql.shuffle.partitions", "9")
    samples, importance.SAMPLES = importance.SAMPLES, 100
    try:
        got = found(importance_resample(df, target, percent=60))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        importance.SAMPLES = samples
    assert got == plain(rows, ["one two"], percent=60)


def test_segments_are_even(spark):
    """A row that repeats very often is spread over the segments."""
    rows = [(1, 30, 30, 5, 5)] * 3000 + [(k, 30, 30, k % 7, k % 7) for k in range(1000)]
    df = spark.createDataFrame(rows, "doc_id long, n_features long, n_words long, weight long, score long").repartition(6)
    runs = df.sortWithinPartitions(*importance.in_order()).withColumn("place", importance.F.monotonically_increasing_id())
    runs = importance.materialize(runs, "runs")
    cut = importance.in_segments(runs, importance.regular_splitters(runs, 4000, 8))
    sizes = [r["count"] for r in cut.groupBy("segment").count().collect()]
    assert len(sizes) == 8 and max(sizes) < 2 * 4000 / 8


def test_documents_and_empty_tables(spark, docs, nothing):
    target = spark.createDataFrame([("alpha beta",), (None,)], "text string")
    drawn = importance_resample(docs, target).where("rank is not null and doc_id is not null")
    ids = {r.doc_id for r in drawn.collect()}
    kept = resampled_documents(docs, target)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.select("doc_id").collect()} == ids
    assert importance_resample(nothing, target).collect() == []
    assert importance_resample(docs, target.limit(0)).count() == docs.count()


def test_crc32_spans():
    words = [b"", b"a", b"abc", b"x" * 64, b"y" * 65, b"z" * 1000, "é日".encode()]
    data = np.frombuffer(b"".join(words), np.uint8)
    end = np.cumsum([len(w) for w in words])
    start = end - [len(w) for w in words]
    assert crc32_spans(data, start, end).tolist() == [zlib.crc32(w) for w in words]


def test_features_of_sliced_columns():
    column = pa.array(["skipped words", "One, two-THREE", None, "", "日本 x_1"])[1:]
    got = [(b.tolist(), f.tolist(), n.tolist()) for _, _, b, f, n in importance.feature_buckets(column, 1, 10000)]
    want = [zlib.crc32(w.encode()) % 10000 for w in ("one", "two", "three", "日本", "x", "1")]
    assert got == [(want, [0, 3, 3, 3, 6], [3, 0, 0, 3])]
