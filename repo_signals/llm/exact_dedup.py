"""Exact duplicates by a content sort."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from repo_signals.llm.text import id_and_text, lower_ascii
from repo_signals.session import materialize

# Leading characters of the text in the sort key. The digest behind them tells texts with equal starts apart.
LEAD_CHARS = 64
ROWS_OUT = 4096

RUNS = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("text_sha256", pa.string()),
        ("part", pa.int32()),
        ("run", pa.int64()),
        ("run_size", pa.int64()),
        ("run_keep", pa.int64()),
        ("leads", pa.bool_()),
        ("opens", pa.bool_()),
        ("closes", pa.bool_()),
        ("edge_body", pa.string()),
    ]
)
RUNS_DDL = (
    "doc_id long, text_sha256 string, part int, run long, run_size long, run_keep long, "
    "leads boolean, opens boolean, closes boolean, edge_body string"
)


def exact_dedup(docs: DataFrame) -> DataFrame:
    """The group of equal texts of every document, and which row of it stays.

    Texts are equal when identical after lower-casing A-Z; null counts as empty.
    Of equal texts the row with the largest ``doc_id`` stays (a null id is the
    smallest); of several rows with that id, one. Returns one row per input row:
    ``doc_id, keep_id, group_size, kept, text_sha256``. An empty table gives an
    empty result; columns other than ``doc_id`` and ``text`` are not read.

    The rows are range-partitioned by sampled splitters and sorted on disk by
    (start of the text, digest, identifier), so equal texts lie next to each
    other, and neighbours are compared byte by byte. The identifier is part of
    the range key: a text that makes up a third of all rows spreads over many
    partitions, and only the two texts at each partition's edges are compared
    across partitions. The start stands in for the whole text in the key, so
    that sampled splitters stay small on the driver.
    """
    body = lower_ascii(F.coalesce("text", F.lit("")))
    keyed = (
        id_and_text(docs)
        .select("doc_id", body.alias("body"))
        .select("doc_id", "body", F.substring("body", 1, LEAD_CHARS).alias("lead"), F.sha2("body", 256).alias("digest"))
    )
    order = [F.col("lead"), F.col("digest"), F.desc_nulls_last("doc_id")]
    ranged = keyed.repartitionByRange(*order).sortWithinPartitions(*order)
    runs = ranged.select("doc_id", "body", "digest").mapInArrow(find_runs, RUNS_DDL)
    return joined_runs(materialize(runs, "runs"))


def find_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of equal neighbours in one sorted partition; a run's rows come out once it ends.

    Of the texts only that of the run at hand is held.
    """
    part = TaskContext.get().partitionId()
    rows: list[tuple] = []
    run, ids, text, digest = -1, [], None, None

    def close(last: bool) -> None:
        for k, doc in enumerate(ids):
            edge = k == 0 and (run == 0 or last)
            rows.append((doc, digest, part, run, len(ids), ids[0], k == 0, run == 0, last, text if edge else None))

    for batch in batches:
        for doc, body, sha in zip(*(batch.column(k).to_pylist() for k in range(3))):
            if run < 0 or sha != digest or body != text:
                if run >= 0:
                    close(False)
                run, ids, text, digest = run + 1, [], body, sha
            ids.append(doc)
        if len(rows) >= ROWS_OUT:
            yield packed(rows)
            rows.clear()
    if run >= 0:
        close(True)
    for low in range(0, len(rows), ROWS_OUT):
        yield packed(rows[low : low + ROWS_OUT])


def packed(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(values, f.type) for values, f in zip(zip(*rows), RUNS)], schema=RUNS
    )


def joined_runs(runs: DataFrame) -> DataFrame:
    """Join runs that go on in the next partition, and give every row its group's figures."""
    edges = runs.where(F.col("edge_body").isNotNull())
    # One or two rows per partition, without their texts: as many as there are partitions.
    places = edges.select("part", "run", "run_size", "run_keep", "opens", "closes")
    before = F.lag("part").over(W.orderBy("part"))
    opening = places.where("opens").select("part", before.alias("before"))
    last = edges.where("closes").select(F.col("part").alias("before"), F.col("edge_body").alias("last_body"))
    goes_on = (
        edges.where("opens")
        .select("part", "edge_body")
        .join(opening, "part")
        .join(last, "before")
        .select("part", (F.col("edge_body") == F.col("last_body")).alias("goes_on"))
    )
    along = W.orderBy("part", "run")
    chain = F.sum(F.when(F.col("opens") & F.coalesce("goes_on", F.lit(False)), 0).otherwise(1)).over(along)
    chained = places.join(goes_on, "part", "left").withColumn("chain", chain)
    whole = W.partitionBy("chain")
    merged = chained.select(
        "part",
        "run",
        F.sum("run_size").over(whole).alias("size"),
        F.max("run_keep").over(whole).alias("keep"),
        (F.row_number().over(whole.orderBy("part", "run")) == 1).alias("head"),
    )
    # At most two rows per partition, so the hint is bounded by the number of partitions.
    return runs.join(F.broadcast(merged), ["part", "run"], "left").select(
        "doc_id",
        F.when(F.col("head").isNotNull(), F.col("keep")).otherwise(F.col("run_keep")).alias("keep_id"),
        F.coalesce("size", "run_size").alias("group_size"),
        (F.col("leads") & F.coalesce("head", F.lit(True))).alias("kept"),
        "text_sha256",
    )
