"""Quality rules: hashed n-gram log-likelihood ratio of trusted target and raw corpus.

Words and word pairs are hashed into ``buckets``.  One pass counts every bucket over all documents (raw) and over
all documents labelled good (target); both are smoothed multinomials.  A document's score is the mean over its
n-grams of log(target / raw), so length does not matter, and it is kept if the score reaches a fixed
threshold.  Everything is built-in Spark expressions; the only thing that returns to the driver is the table of
``buckets`` ratios.

Defined cases: a null or empty text has no words, a score of 0 and fails the base rules; ids that are null match no
label; a document labelled more than once is good if any label says so; repeated rows are answered row by row
and count as often as they occur; without a good label every score is 0.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from backline.llm.common import small_side
from backline.session import cut_lineage

BUCKETS = 1 << 14
# Clean documents score about 0 (at worst -0.07 among those labelled good at any tried size), junk -0.05 to -1.5.
THRESHOLD = -0.15
_SPACE = r"[\x20\x09-\x0D]"


def _words(text: Column) -> Column:
    return F.array_remove(F.split(text, _SPACE + "+"), "")


def _bucket(buckets: int, *words: Column) -> Column:
    return F.pmod(F.xxhash64(*words), F.lit(buckets).cast("long")).cast("int")


def log_ratios(docs: DataFrame, good_ids: DataFrame, buckets: int = BUCKETS) -> list[float]:
    """log(target / raw) of each bucket, with one added to every count."""
    marked = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(good_ids.withColumn("good", F.lit(1)), "doc_id", "left")
    tokens = marked.select(F.coalesce("good", F.lit(0)).alias("good"), _words(F.col("text")).alias("words")).select("good", "words", F.posexplode("words").alias("i", "w"))
    after = F.get("words", F.col("i") + 1)
    grams = tokens.select("good", F.explode(F.array(_bucket(buckets, F.col("w")), F.when(after.isNotNull(), _bucket(buckets, F.col("w"), after)))).alias("b")).where("b is not null")
    counted = {r.b: (r.raw, r.target) for r in grams.groupBy("b").agg(F.count("*").alias("raw"), F.sum("good").alias("target")).collect()}
    raw, target = sum(n for n, _ in counted.values()), sum(n for _, n in counted.values())
    if not target:
        return [0.0] * buckets
    base = math.log(raw + buckets) - math.log(target + buckets)
    return [math.log((t + 1) / (n + 1)) + base for n, t in (counted.get(b, (0, 0)) for b in range(buckets))]


def good_labels(labels: DataFrame) -> DataFrame:
    """Ids labelled good, broadcast if they were counted to be few."""
    ids = labels.where("quality = 1 and doc_id is not null").select("doc_id").distinct()
    return small_side(cut_lineage(ids))


def with_base_rules(docs: DataFrame) -> DataFrame:
    """``docs`` with __words, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    text = F.coalesce("text", F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    d = docs.withColumns(
        {
            "__words": _words(text),
            "word_chars": F.length(F.regexp_replace(text, _SPACE + "+", "")).cast("long"),
            "n_symbols": F.length(F.regexp_replace(text, r"[^#*$%&|<>]+", "")).cast("long"),
            "__lines": lines,
        }
    )
    d = d.withColumns({"n_words": F.size("__words").cast("long"), "n_dup_lines": (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long")}).drop("__lines")
    word = lambda i: F.get("__words", i)
    d = d.withColumn("__tri", F.when(F.col("n_words") >= 3, F.transform(F.sequence(F.lit(0), (F.col("n_words") - 3).cast("int")), lambda i: F.xxhash64(word(i), word(i + 1), word(i + 2)))))
    # equal windows become neighbours once (hash, position) is sorted; texts without any skip the sort
    repeats = F.size(F.array_distinct("__tri")) < F.size("__tri")
    d = d.withColumn("__tri", F.when(repeats, F.sort_array(F.transform("__tri", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    at = lambda k: F.get("__tri", k)["h"]
    found = F.filter("__tri", lambda x, k: x["h"].eqNullSafe(at(k - 1)) | x["h"].eqNullSafe(at(k + 1)))
    d = d.withColumn("__tri", F.sort_array(F.transform(found, lambda x: x["i"])))
    step = lambda k: F.least(F.lit(3), F.get("__tri", k) - F.get("__tri", k - 1))
    covered = F.aggregate(F.sequence(F.lit(1), F.size("__tri") - 1), F.lit(3).cast("long"), lambda s, k: s + step(k))
    return d.withColumn("n_repeat_words", F.coalesce(F.when(F.size("__tri") > 1, covered), F.lit(0)).cast("long")).drop("__tri")


def quality_rules(docs: DataFrame, labels: DataFrame, buckets: int = BUCKETS, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with the base rules' counts, ``score``, ``base_failed`` and ``kept``."""
    ratios = log_ratios(docs, good_labels(labels), buckets)
    table = F.split(F.lit(",".join(map(repr, ratios))), ",").cast("array<double>")
    d = with_base_rules(docs)
    n = F.col("n_words").cast("int")
    value = lambda *w: F.get(table, _bucket(buckets, *w))
    single = F.aggregate("__words", F.lit(0.0), lambda s, w: s + value(w))
    pairs = F.when(n >= 2, F.aggregate(F.sequence(F.lit(1), n - 1), F.lit(0.0), lambda s, i: s + value(F.get("__words", i - 1), F.get("__words", i))))
    d = d.withColumn("score", F.when(n > 0, (single + F.coalesce(pairs, F.lit(0.0))) / (2 * n - 1)).otherwise(0.0)).drop("__words")
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    d = d.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & (F.col("score") >= threshold))
    # a filter on the results must not be pushed down: it would repeat the word split inside the loops over words
    results = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "score", "base_failed", "kept"]
    return d.select(*docs.columns, F.explode(F.array(F.struct(*results))).alias("__r")).select(*docs.columns, *[F.col(f"__r.{c}").alias(c) for c in results])
