"""Registered queries of the text operators, each with production parameters over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from backline.llm import chosen_path, collocation, contamination, dialogue, histogram, huffman, licenses, llr, masks, pfair, toxicity, unwrap, wordpiece

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


@_query
def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of each document inside exact 10-word benchmark phrases; items found in order, and within two extra words in any order."""
    found = contamination.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), slop=2)
    return found.select(
        F.col("id").alias("doc_id"),
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
        F.size("near_items").cast("long").alias("n_near_items"),
    )


ORACLE["op1_decontamination"] = contamination.ORACLE_SQL


@_query
def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts, log-likelihood ratio and verdict of every document."""
    rated = llr.quality_rules(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    return rated.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score")


@_query
def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 24 shards of equal bytes."""
    placed = histogram.histogram_shards(_table(spark, sf_dir, "documents"), shards=24)
    return placed.select(
        "doc_id",
        histogram.text_size().alias("size"),
        F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"),
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


@_query
def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class, number of links and group of every document at five words and similarity 0.8."""
    return chosen_path.jaccard_join(_table(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_links", "group_id", F.hex("group_key").alias("group_key"))


@_query
def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Block, window, slot and place of every document, sources weighted by the root of their bytes."""
    return pfair.mix(_table(spark, sf_dir, "documents")).select("doc_id", "source", "block", "release", "deadline", "slot", "place")


@_query
def op2_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation from every participant's side, with the spans to learn."""
    return dialogue.perspectives(_table(spark, sf_dir, "conversations"))


ORACLE["op2_chat_formatting"] = dialogue.ORACLE_SQL


@_query
def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License notices of all documents with their differences from the public wording."""
    return licenses.license_spans(_table(spark, sf_dir, "documents"))


@_query
def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words and greedy longest-match pieces of every document."""
    return wordpiece.token_counts(_table(spark, sf_dir, "documents"))


@_query
def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document, as they stand and below any nesting of encodings."""
    found = unwrap.secret_spans(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2("base_spans", 256).alias("base_sha256"), "spans", "found_in", "n_layers", "n_oversize")


@_query
def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document."""
    found = toxicity.toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    return found.select("doc_id", "held_out", "score", "predicted")


@_query
def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 2,000 best phrases of every language."""
    return collocation.collocations(_table(spark, sf_dir, "documents"))


ORACLE["op11_collocations"] = collocation.ORACLE_SQL


@_query
def op12_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's token ids, read back from the written files."""
    import public_tokenizers

    read = huffman.round_trip(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return read.select(F.col("id").alias("doc_id"), "start", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))


@_query
def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents of every benchmark item."""
    return masks.ranked_search(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


ORACLE["op13_ranked_search"] = masks.ORACLE_SQL
