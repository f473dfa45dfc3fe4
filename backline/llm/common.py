"""Helpers shared by the text operators: stored tables, bounded broadcasts, words, groups."""

from __future__ import annotations

import uuid
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame, functions as F

from backline.session import checkpoint_dir, cut_lineage

# A side of a join is broadcast only after its rows were counted and found to be at most this many
# (two numbers each, so about 32 MB); a larger one is joined by a shuffle.
BROADCAST_ROWS = 1_000_000

# Word bytes of UTF-8 text: 0-9, a-z, A-Z (folded to a-z) and every byte of a character above 0x7F.
_WORD_BYTES = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256)
)


def words_of(text: bytes) -> list[bytes]:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of UTF-8 text with A-Z in lower case."""
    return text.translate(_WORD_BYTES).split()


def store(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write ``df`` as Parquet below the shared checkpoint folder and read it back."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small_side(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint when it has at most ``rows`` rows, else as it is.  Pass stored tables: it is counted."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads unsigned 64-bit numbers (a fixed bijection)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def group_roots(edges: DataFrame) -> DataFrame:
    """Rows (node, root): the least node of each connected group of ``edges`` (a, b).

    Each round takes the least label among the neighbours, then that label's own label, so chains
    halve; labels go through the checkpoint folder.  It runs until no label changes.
    """
    both = cut_lineage(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct())
    labels = cut_lineage(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("b")).select("node", F.least("node", "b").alias("root")))
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "root"), "b").groupBy(F.col("a").alias("node")).agg(F.min("root").alias("near"))
        step = labels.join(near, "node").select("node", "root", F.least("root", "near").alias("next"))
        far = labels.select(F.col("node").alias("next"), F.col("root").alias("far"))
        step = cut_lineage(step.join(far, "next").select("node", "root", F.least("next", "far").alias("next")))
        labels = step.select("node", F.col("next").alias("root"))
        if step.where("next <> root").isEmpty():
            return labels


def union(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)
