"""From raw documents to shards: quality rules, near copies, decontamination, mixing, sharding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the
next stage's documents.  All but the last return the columns of documents.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from backline.llm import chosen_path, contamination, histogram, llr, pfair
from backline.session import checkpoint_dir


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and reach the likelihood-ratio threshold."""
    return llr.quality_rules(docs, _table(spark, sf_dir, "labels")).where("kept").select(docs.columns)


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of texts linked at five words and similarity 0.8."""
    return chosen_path.keep_one_of_each_group(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any exact benchmark phrase."""
    return contamination.drop_contaminated(docs, _table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, written in the order of the mixture; the next stage cuts its shards along that order."""
    return pfair.in_order(pfair.mix(docs), docs.columns)


def _written_order(docs: DataFrame) -> tuple[DataFrame, Column | None]:
    """``docs`` with __at, a number that rises with the file number and the row in the file; None if docs aren't files."""
    name = F.col("_metadata.file_name")
    number = F.coalesce(F.regexp_extract(name, r"part-(\d+)", 1).try_cast("long"), F.lit(0))
    nth = F.coalesce(F.regexp_extract(name, r"-c(\d+)", 1).try_cast("long"), F.lit(0))
    try:
        placed = docs.select("*", number.alias("__file"), nth.alias("__nth"), F.col("_metadata.row_index").alias("__row"))
    except AnalysisException:
        return docs, None
    rows, parts = placed.agg(F.max("__row") + 1, F.max("__nth") + 1).first()
    if rows is None:
        return docs, None
    return placed.withColumn("__at", (F.col("__file") * parts + F.col("__nth")) * rows + F.col("__row")).drop("__file", "__nth", "__row"), F.col("__at")


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with shard and slot: 24 runs of the mixture of equal bytes.

    Shards hold the target weights until the first source runs out; on check_s that is after 71 % of the mixture, and
    the largest source, with a target of 15 %, has 28 % of the 18th shard, 95 % of the 19th and all of the last five
    (counted in blocks of the unfiltered documents).
    """
    placed, key = _written_order(docs)
    return histogram.histogram_shards(placed, shards=24, key=key).drop("__at")


STAGES = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", jaccard_join),
    ("benchmark decontamination", decontamination),
    ("mixing sources to target weights", mixing),
    ("sharding", sharding),
]

# Hashes, the join's exact sets and the schedule have no SQL twin; tests hold every stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order over the documents of ``sf_dir``."""
    docs = _table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        path = f"{checkpoint_dir(spark)}/stage-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
