from pyspark.sql import functions as F

from repo_signals.operators import bitmap
from repo_signals.session import scratch_path
from repo_signals.sources import store


def counted(calls):
    def embed(df, text, out):
        calls.append(df.count())
        return df.withColumn(out, F.array(F.length(F.coalesce(text, F.lit(""))).cast("float")))

    return embed


def test_store_is_read_and_added_to(spark):
    path, calls = scratch_path(spark, "store"), []
    first = spark.createDataFrame([(k, "text %d" % (k % 50)) for k in range(100)] + [(200, None)], "id int, text string")
    more = spark.createDataFrame([(k, "text %d" % k) for k in range(40, 70)], "id int, text string")
    store.embed_with_store(first, "text", "id", path, "m", counted(calls))
    got = store.embed_with_store(more, "text", "id", path, "m", counted(calls)).collect()
    assert calls == [51, 20]
    assert all(r.embedding == [float(len(r.text))] and r.from_cache == (r.id < 50) for r in got) and len(got) == 30
    store.embed_with_store(more, "text", "id", path, "other", counted(calls))
    assert calls[2] == 30
    store.compact(spark, path, "m")
    rows = store.stored(spark, path, "m")
    assert rows.count() == rows.select("text_hash").distinct().count() == 71
    assert rows.select("batch").distinct().count() == 1
    again = store.embed_with_store(first, "text", "id", path, "m", counted(calls))
    assert calls[3] == 0 and again.where("from_cache = 1").count() == 101
    assert store.stored(spark, path, "other").count() == 30


def test_two_writers_of_one_text(spark):
    path = scratch_path(spark, "store")
    vectors = spark.createDataFrame([("h", [1.0])], "text_hash string, embedding array<float>")
    store.write_batch(vectors, path, "m", 0)
    store.write_batch(vectors.withColumn("embedding", F.array(F.lit(2.0).cast("float"))), path, "m", 1)
    assert [tuple(r.embedding) for r in store.one_per_key(store.stored(spark, path, "m")).collect()] == [(1.0,)]


def test_bitmap_has_every_key_and_few_others(spark):
    keys = spark.range(2000).select(F.xxhash64("id").alias("k"))
    slots = bitmap.asked_slots(keys, "k", 2000)
    assert len(slots[0]) == 1 << (bitmap.LEAST_BITS - 3)
    found = keys.where(bitmap.is_asked(keys, slots, F.col("k")))
    assert found.count() == 2000
    others = spark.range(10_000, 60_000).select(F.xxhash64("id").alias("k"))
    assert others.where(bitmap.is_asked(others, slots, F.col("k"))).count() < 500
