import random

from pyspark.sql import functions as F

from backline.llm import histogram as H
from .frames import ODD, docs


def check(rows, shards, slack):
    by = {}
    for r in rows:
        by.setdefault(r.shard, []).append(r)
    sizes = []
    for s in range(shards):
        part = sorted(by.get(s, []), key=lambda r: r.slot)
        assert [r.slot for r in part] == list(range(len(part)))
        sizes.append(sum(len((r.text or "").encode()) + 8 for r in part))
    mean = sum(sizes) / shards
    assert max(abs(x - mean) for x in sizes) <= slack, sizes


def test_equal_bytes_gapless_slots_in_key_order(spark):
    rnd = random.Random(3)
    rows = [(k, "x" * rnd.randrange(300)) for k in range(4000)]
    rows += [(k, "copy of a text that stands in a third of all rows " * 4) for k in range(4000, 6000)]
    frame = docs(spark, rows, extra=("size", "key", "__level"))
    got = H.histogram_shards(frame, shards=24, range_bytes=1 << 14).withColumn("k", H.text_key()).collect()
    assert len(got) == len(rows)
    check(got, 24, 2 * 0.001 * sum(len(t) + 8 for _, t in rows) / 24 + 2 * 300)
    order = sorted(got, key=lambda r: (r.shard, r.slot))
    assert [r.k for r in order] == sorted(r.k for r in order)


def test_splitters_by_brute_force(spark):
    rnd = random.Random(4)
    keys = [rnd.choice([rnd.randrange(50), rnd.randrange(1 << 40), (1 << 39) + rnd.randrange(1000)]) for _ in range(3000)]
    slim = spark.createDataFrame([(k, 1 + k % 97) for k in keys], "key long, size long").repartition(5)
    found = H.find_ranges(slim, 8, 0.01, 500)
    total = sum(1 + k % 97 for k in keys)
    assert sum(found["bytes"]) == total
    heaviest = max(sum(1 + k % 97 for k in keys if k == x) for x in set(keys))
    assert all(abs(b - total / 8) <= 2 * (0.01 * total / 8 + heaviest) for b in found["bytes"])


def test_odd_rows_and_empty_table(spark):
    got = H.histogram_shards(docs(spark, ODD), shards=3).collect()
    assert len(got) == len(ODD)
    for s in range(3):
        part = sorted(r.slot for r in got if r.shard == s)
        assert part == list(range(len(part)))
    empty = H.histogram_shards(docs(spark, []))
    assert empty.count() == 0 and empty.columns[-2:] == ["shard", "slot"]
    same = H.histogram_shards(docs(spark, [(1, "a")] * 50), shards=4, key=F.lit(None).cast("long")).collect()
    assert len(same) == 50


def test_identical_rows_are_divided(spark):
    rows = [(k, "x" * (k % 200)) for k in range(2000)] + [(7, "the same row " * 8)] * 2000
    total = sum(len(t) + 8 for _, t in rows)
    got = H.histogram_shards(docs(spark, rows, extra=("__n", "__copy")), shards=24).collect()
    assert sorted((r.doc_id, r.text) for r in got) == sorted(rows)
    check(got, 24, 2 * 0.001 * total / 24 + 2 * 210)


def test_one_row_many_times(spark):
    got = H.histogram_shards(docs(spark, [(None, None)] * 3000), shards=24)
    sizes = [r["count"] for r in got.groupBy("shard").count().collect()]
    assert len(sizes) == 24 and max(sizes) - min(sizes) <= 2
    same = H.histogram_shards(docs(spark, [(k, "a") for k in range(960)]), shards=24, key=F.lit(5).cast("long")).collect()
    check(same, 24, 9 * 20)


def test_million_repeats_share_no_task(spark):
    one = docs(spark, [(1, "copy")], parts=1)
    rows = spark.range(1_000_000).join(one).drop("id").unionByName(docs(spark, [(k, "other") for k in range(2, 5000)]))
    got = H.histogram_shards(rows, shards=24, range_bytes=1 << 18)
    by = got.groupBy("shard").agg(F.count("*").alias("n"), F.min("slot").alias("a"), F.max("slot").alias("b"), F.sum(F.length("text") + 8).alias("bytes")).collect()
    mean = sum(r.bytes for r in by) / 24
    assert sum(r.n for r in by) == 1_004_998 and all(r.a == 0 and r.b == r.n - 1 and abs(r.bytes - mean) < 0.01 * mean for r in by)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        largest = got.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert largest < 500_000  # four partitions
