"""A cache of embeddings laid out by key, read without moving the vectors that nobody asks for."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from repo_signals.operators.bitmap import asked_slots, is_asked
from repo_signals.operators.embed import Embed
from repo_signals.operators.skew import left_join_spread
from repo_signals.session import materialize

STORE = "text_hash string, embedding array<float>, model string, batch int"


def stored(spark: SparkSession, path: str, model: str) -> DataFrame | None:
    """All ``(text_hash, embedding, batch)`` of a model, or None before the first write."""
    try:
        rows = spark.read.schema(STORE).parquet(path)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    return rows.where(F.col("model") == model).select("text_hash", "embedding", "batch")


def write_batch(vectors: DataFrame, path: str, model: str, batch: int) -> None:
    """One more batch: files by range of key, sorted, with Parquet's own Bloom filter on it."""
    named = vectors.select("text_hash", "embedding", F.lit(model).alias("model"), F.lit(batch).alias("batch"))
    (
        named.repartitionByRange("text_hash")
        .sortWithinPartitions("text_hash")
        .write.mode("append")
        .option("parquet.bloom.filter.enabled#text_hash", "true")
        .partitionBy("model", "batch")
        .parquet(path)
    )


def last_batch(rows: DataFrame | None) -> int:
    return -1 if rows is None else rows.agg(F.coalesce(F.max("batch"), F.lit(-1))).first()[0]


def one_per_key(rows: DataFrame) -> DataFrame:
    """Two runs at a time may store the same text; the first batch counts."""
    return rows.groupBy("text_hash").agg(F.min_by("embedding", "batch").alias("embedding"), F.min("batch").alias("batch"))


def embed_with_store(df: DataFrame, text: str, row_id: str, path: str, model: str, embed: Embed) -> DataFrame:
    """Add ``text_hash``, ``embedding`` and ``from_cache`` to each row; ``row_id`` must be unique.

    A bitmap of the texts asked for goes to the tasks that read the store. They
    pass on the keys, and later the vectors, that it may mean and no others: what
    a run shuffles depends on what it asks for and not on what is stored. Only
    texts that the store lacks are encoded, each once.
    """
    spark = df.sparkSession
    hashed = materialize(df.select(row_id, F.sha2(F.coalesce(F.col(text), F.lit("")), 256).alias("text_hash")), "hashes")
    per_text = hashed.groupBy("text_hash").agg(F.count(F.lit(1)).alias("_copies"), F.min(row_id).alias(row_id))
    copies = materialize(per_text, "copies")
    slots = asked_slots(copies.select(F.xxhash64("text_hash").alias("key")), "key", copies.count())

    def asked(rows: DataFrame) -> DataFrame:
        return rows.where(is_asked(df, slots, F.xxhash64("text_hash")))

    known = stored(spark, path, model)
    batch = last_batch(known) + 1
    missing = copies if known is None else copies.join(asked(known.select("text_hash")).distinct(), "text_hash", "left_anti")
    wanted = df.select(row_id, text).join(missing.select(row_id, "text_hash"), row_id)
    write_batch(embed(wanted.select("text_hash", text), text, "embedding"), path, model, batch)
    vectors = one_per_key(asked(stored(spark, path, model)))
    found_before = F.when(F.col("batch") < batch, 1).otherwise(0).alias("from_cache")
    lookup = copies.drop(row_id).join(vectors.select("text_hash", "embedding", found_before), "text_hash")
    found = left_join_spread(hashed, lookup, "text_hash", "_copies", row_id, counts=copies).drop("_copies")
    return df.join(found, row_id)


def compact(spark: SparkSession, path: str, model: str) -> None:
    """Merge the batches of a model into one; the old ones go once the new one is written, so nothing is lost in between."""
    rows = stored(spark, path, model)
    last = last_batch(rows)
    if last < 1:
        return
    write_batch(one_per_key(rows), path, model, last + 1)
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for batch in range(last + 1):
        folder = jvm.org.apache.hadoop.fs.Path(f"{path}/model={model}/batch={batch}")
        folder.getFileSystem(conf).delete(folder, True)
    spark.catalog.refreshByPath(path)
