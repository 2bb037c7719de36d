"""Importance resampling towards a target distribution of hashed word n-grams."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from repo_signals.llm.text import chunks, id_and_text, python_ready, row_sums, spaced, words
from repo_signals.session import materialize

NGRAMS = 1
BUCKETS = 10_000
SEED = 2024
PERCENT = 10
LEAST_WORDS = 20

# Regular samples that reach the driver, at most, besides one per sorted run: 28 bytes each.
SAMPLES = 1 << 17
# Spans with more bytes are rare; they are summed one by one.
LOOPED_BYTES = 64
PLACE_BITS = 33

LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20
# Words are runs of ASCII letters, digits and all characters beyond ASCII.
IS_GAP = np.ones(256, bool)
IS_GAP[0x80:] = IS_GAP[0x30:0x3A] = IS_GAP[0x41:0x5B] = IS_GAP[0x61:0x7B] = False

CRC_BYTE = np.arange(256, dtype=np.uint32)
for _ in range(8):
    CRC_BYTE = (CRC_BYTE >> np.uint32(1)) ^ np.where(CRC_BYTE & np.uint32(1), np.uint32(0xEDB88320), np.uint32(0))


def crc32_spans(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The CRC-32 of each span of bytes; spans advance together, the longest first, so those still running stand in front."""
    size = end - start
    order = np.argsort(-size, kind="stable")
    at, rising = start[order], size[order][::-1]
    crc = np.full(len(at), 0xFFFFFFFF, np.uint32)
    for step in range(min(int(size.max(initial=0)), LOOPED_BYTES)):
        running = len(at) - int(np.searchsorted(rising, step, "right"))
        now = crc[:running]
        crc[:running] = CRC_BYTE[(now ^ data[at[:running] + step]) & np.uint32(0xFF)] ^ (now >> np.uint32(8))
    out = np.empty_like(crc)
    out[order] = crc ^ np.uint32(0xFFFFFFFF)
    for k in np.flatnonzero(size > LOOPED_BYTES).tolist():
        out[k] = zlib.crc32(data[start[k] : end[k]])
    return out


def feature_buckets(column: pa.Array, ngrams: int, buckets: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """Runs of rows: first row, row after the last, the bucket of every feature, the number of features before each row, and its words."""
    for low, high, data, offsets in chunks(column):
        data = LOWER[data]
        found = words(data, offsets, IS_GAP)
        body, start, end = spaced(data, found)
        row = found.row
        all_buckets, rows = [], []
        for n in range(1, ngrams + 1):
            last = np.arange(n - 1, len(start))
            whole = row[last - n + 1] == row[last]
            last = last[whole]
            all_buckets.append(crc32_spans(body, start[last - n + 1], end[last]) % np.uint32(buckets))
            rows.append(row[last])
        bucket, row = np.concatenate(all_buckets), np.concatenate(rows)
        if ngrams > 1:
            order = np.argsort(row, kind="stable")
            bucket, row = bucket[order], row[order]
        yield low, high, bucket.astype(np.int64), np.searchsorted(row, np.arange(high - low + 1)), np.diff(found.first)


def bucket_counts(docs: DataFrame, ngrams: int, buckets: int) -> np.ndarray:
    """How many features of all texts fall into each bucket.

    A task sums up all it reads and hands over at most one row per bucket; as
    many sums as there are buckets reach the driver.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, _, bucket, _, _ in feature_buckets(batch.column(0), ngrams, buckets):
                total += np.bincount(bucket, minlength=buckets)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], ["bucket", "n"])

    python_ready(docs.sparkSession)
    parts = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(count, "bucket long, n long")
    found = parts.groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(buckets, np.int64)
    out[found["bucket"].to_numpy()] = found["n"].to_numpy()
    return out


def bucket_gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of a bucket's smoothed share in the target to that in the source, rounded down."""
    s, t, k = source.astype(float), target.astype(float), len(source)
    ratio = (t + 1) * (s.sum() + k) / ((s + 1) * (t.sum() + k))
    return np.floor(1000 * np.log(ratio)).astype(np.int64)


def weighted(docs: DataFrame, gains: np.ndarray, ngrams: int) -> DataFrame:
    """``doc_id, n_features, n_words, weight``: the mean gain over a text's features, rounded down; 0 without features."""
    shared = docs.sparkSession.sparkContext.broadcast(gains)  # one number per bucket

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        for batch in batches:
            for low, high, bucket, first, n_words in feature_buckets(batch.column(1), ngrams, len(table)):
                n = np.diff(first)
                weight = row_sums(table[bucket], first) // np.maximum(n, 1)
                out = [batch.column(0).slice(low, high - low), pa.array(n), pa.array(n_words.astype(np.int64)), pa.array(weight)]
                yield pa.RecordBatch.from_arrays(out, ["doc_id", "n_features", "n_words", "weight"])

    return id_and_text(docs).mapInArrow(score, "doc_id long, n_features long, n_words long, weight long")


def gumbel(seed: int) -> Column:
    """Thousandths of a draw from the Gumbel distribution, rounded down, from the hash of seed and identifier."""
    named = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(named, 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.ln(-F.ln((h + F.lit(0.5)) / F.lit(4294967296.0)))).cast("long")


# --- parallel sorting by regular sampling -------------------------------------------------------

ORDER = ["score", "doc_id", "n_features", "place"]


def in_order() -> list[Column]:
    """Highest scores first, ties to smaller identifiers, a missing one last; the rest makes the order total."""
    return [F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("n_features")]


def sort_keys(score, doc_id, n_features, place) -> np.ndarray:
    """The place of each row in the order, as bytes that compare like it."""
    missing = np.asarray(doc_id.is_null())
    # Complement reverses the order; the sign bit is flipped, as bytes have no sign.
    flip = np.uint64(1 << 63)
    parts = [
        ~score.to_numpy().view(np.uint64) ^ flip,
        doc_id.fill_null(0).to_numpy().view(np.uint64) ^ flip,
        n_features.to_numpy().view(np.uint64),
        place.to_numpy().view(np.uint64),
    ]
    out = np.empty((len(missing), 33), np.uint8)
    for k, part in enumerate(parts):
        low = 8 * k + (k > 0)
        out[:, low : low + 8] = part.astype(">u8").view(np.uint8).reshape(-1, 8)
    out[:, 8] = missing
    return out.reshape(-1).view("S33")


def regular_splitters(runs: DataFrame, rows: int, segments: int) -> np.ndarray:
    """Keys that cut the order into segments of about equal size: every so many rows of each sorted run, sorted, every so many of those."""
    step = max(1, rows // SAMPLES)
    local = F.col("place").bitwiseAND((1 << PLACE_BITS) - 1)
    found = runs.where(local % step == step // 2).select(*ORDER).toArrow().combine_chunks()
    keys = np.sort(sort_keys(*(found[c].combine_chunks() for c in ORDER)))
    at = np.arange(1, segments) * len(keys) // segments
    return np.unique(keys[at]) if len(keys) else keys


def in_segments(runs: DataFrame, splitters: np.ndarray) -> DataFrame:
    """The rows with the number of the segment that they lie in."""
    shared = runs.sparkSession.sparkContext.broadcast(splitters)  # one key per partition

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = sort_keys(*(batch.column(c) for c in ORDER))
            segment = np.searchsorted(shared.value, keys, "right").astype(np.int32)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(segment)], [*batch.schema.names, "segment"])

    python_ready(runs.sparkSession)
    return runs.mapInArrow(find, f"{', '.join(f'{f.name} long' for f in runs.schema)}, segment int")


def ranked(scored: DataFrame, rows: int, drawn: int) -> DataFrame:
    """``scored`` with the exact ``rank`` of the ``drawn`` rows that come first, null for the others.

    Every task sorts what it reads into one run. Regular samples of the runs give
    splitters, rows go to the segment between two of them and are merged there,
    and a row's rank is its place in the segment after the counts of the
    segments before. Segments behind the last drawn row need no merging. The key
    ends in the row's place in its run, so rows that repeat spread over segments.
    """
    spark = scored.sparkSession
    segments = int(spark.conf.get("spark.sql.shuffle.partitions"))
    runs = materialize(scored.sortWithinPartitions(*in_order()).withColumn("place", F.monotonically_increasing_id()), "runs")
    dealt = materialize(in_segments(runs, regular_splitters(runs, rows, segments)), "segments")
    counts = dealt.groupBy("segment").agg(F.count(F.lit(1)).alias("n"))
    # One row per segment, fewer than there are shuffle partitions.
    starts = counts.select("segment", (F.sum("n").over(W.orderBy("segment")) - F.col("n")).alias("start"))
    placed = dealt.join(F.broadcast(materialize(starts, "starts")), "segment")
    ahead = placed.where(F.col("start") < drawn).repartitionById(segments, F.col("segment"))
    place = F.row_number().over(W.partitionBy("segment").orderBy(*in_order(), F.asc("place")))
    rank = F.col("start") + place.cast("long")
    first = ahead.withColumn("rank", rank).withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))
    behind = placed.where(F.col("start") >= drawn).withColumn("rank", F.lit(None).cast("long"))
    return first.select(*scored.columns, "rank").union(behind.select(*scored.columns, "rank"))


def importance_resample(
    docs: DataFrame,
    target: DataFrame,
    ngrams: int = NGRAMS,
    buckets: int = BUCKETS,
    seed: int = SEED,
    percent: int = PERCENT,
    least: int = LEAST_WORDS,
) -> DataFrame:
    """A draw without replacement of the documents that look most like the target, by Gumbel top-k.

    Features are all runs of 1 to ``ngrams`` consecutive words (lower-cased in
    A-Z; words are runs of ASCII letters, digits and characters beyond ASCII),
    hashed into ``buckets``. A document's ``weight`` is the mean log ratio of its
    buckets' shares in ``target`` and ``docs``, its ``score`` adds a Gumbel draw
    that depends on ``seed`` and ``doc_id`` alone, both in thousandths, and
    ``percent`` of the documents with ``least`` or more words are drawn.

    Returns one row per input row: ``doc_id, n_features, n_words, weight, score,
    rank`` (from 1; null where not drawn). Null and empty texts have no features and
    weight 0. A null ``doc_id`` draws like an empty one and comes last among
    ties; repeated rows have one score and follow each other. An empty table
    gives an empty result, an empty target uniform shares. Of ``docs`` only
    ``doc_id`` and ``text`` are read, of ``target`` only ``text``.
    """
    gains = bucket_gains(bucket_counts(docs, ngrams, buckets), bucket_counts(target, ngrams, buckets))
    scored = materialize(weighted(docs, gains, ngrams).withColumn("score", F.col("weight") + gumbel(seed)), "scored")
    enough = scored.where(F.col("n_words") >= least)
    rows = enough.count()
    short = scored.where(F.col("n_words") < least).withColumn("rank", F.lit(None).cast("long"))
    return ranked(enough, rows, percent * rows // 100).union(short)


def resampled_documents(docs: DataFrame, target: DataFrame, **settings) -> DataFrame:
    """The drawn documents with all their columns; settings are those of ``importance_resample``.

    Rows that share an identifier come together if one of them is drawn; a row
    without one cannot be named and is left out.
    """
    drawn = importance_resample(docs, target, **settings).where("rank is not null").select("doc_id").distinct()
    columns = [F.col(f"`{c}`") for c in docs.columns]
    rows = docs.select(F.struct(*columns).alias("row"), F.col("doc_id").cast("long").alias("doc_id"))
    return rows.join(drawn, "doc_id", "left_semi").select("row.*")
