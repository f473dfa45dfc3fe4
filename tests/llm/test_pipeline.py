import shutil


import corpus_pipeline as P
from backline.llm import llr

from .frames import docs as frame_of
from .test_chosen_path import brute as linked
from .test_contamination import brute as contaminated
from .test_histogram import check
from .test_llr import brute as rated

SF = "/root/testdata/sf0.001"


def rows(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def test_each_stage_by_brute_force(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    kept = {}
    before = docs
    for k, (name, stage) in enumerate(P.STAGES):
        stage(spark, before, SF).write.parquet(str(tmp_path / str(k)))
        after = spark.read.parquet(str(tmp_path / str(k)))
        kept[name] = (rows(before), rows(after))
        if name != "sharding":
            assert after.columns == columns
        before = after

    old, new = kept["quality rules"]
    good = {r.doc_id for r in spark.read.parquet(f"{SF}/labels.parquet").where("quality = 1").collect()}
    want = rated(old, good, llr.BUCKETS, llr.THRESHOLD)
    assert sorted(new) == sorted(x for x in old if want[x][6])

    old, new = kept["n-gram Jaccard join"]
    groups = linked(old)
    assert sorted(d for d, _ in new) == sorted({g for _, _, g in groups.values()})

    old, new = kept["benchmark decontamination"]
    items = [(str(r.item_id), r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert sorted(new) == sorted(x for x in old if not contaminated(x[1], items)[1])

    old, new = kept["mixing sources to target weights"]
    assert sorted(old) == sorted(new)

    old, new = kept["sharding"]
    assert sorted(old) == sorted(new)
    longest = max(len(t.encode()) + 8 for _, t in old)
    check(before.collect(), 24, 2 * longest)


def test_shards_follow_the_written_order(spark, tmp_path):
    frame = frame_of(spark, [(k, "x" * (k % 50)) for k in range(500)])
    frame.orderBy("doc_id").repartitionByRange(7, "doc_id").sortWithinPartitions("doc_id").write.parquet(str(tmp_path / "o"))
    got = P.sharding(spark, spark.read.parquet(str(tmp_path / "o")), SF).orderBy("shard", "slot").collect()
    assert [r.doc_id for r in got] == list(range(500))
    assert P.sharding(spark, frame, SF).count() == 500  # rows that are not files


def test_empty_documents(spark, tmp_path):
    sf = tmp_path / "sf"
    sf.mkdir()
    spark.read.parquet(f"{SF}/documents.parquet").limit(0).write.parquet(str(sf / "documents.parquet"))
    for name in ("labels", "benchmark"):
        shutil.copy(f"{SF}/{name}.parquet", sf / f"{name}.parquet")
    assert P.run(spark, str(sf)).count() == 0


def test_unlinked_texts_of_null_and_reused_ids_pass_the_join_stage(spark):
    texts = ["red green blue black white grey", "one two three four five six", "north south east west up down", "spring summer autumn winter dawn dusk"]
    frame = frame_of(spark, [(None, texts[0]), (None, texts[1]), (7, texts[2]), (7, texts[3]), (8, texts[2])])
    got = dict(P.STAGES)["n-gram Jaccard join"](spark, frame, SF)
    assert sorted(rows(got), key=str) == sorted([(None, texts[0]), (None, texts[1]), (7, texts[2]), (7, texts[3])], key=str)
