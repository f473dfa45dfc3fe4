"""Ranked lexical search: documents grouped by the terms they hold, groups evaluated best first.

The documents are read once into stored segments that hold, for every term of the searched items, the documents with it and
its occurrences there.  From these come the corpus numbers (documents, words, documents by term).  Then every segment is searched
on its own: presence bitmaps of an item's terms, turned by bits, give each document's mask of matched terms; documents
with equal masks form a group, and a group's score is at most the sum of its terms' largest contributions in the segment.  Groups are
evaluated by descending bound, and the search of an item ends at the first group whose bound lies below the score of the
item's current k-th document, so no document that could rank is left out.  A task sends at most k rows per item.

Items are searched in slices of about ``slice_bytes`` of text, each with its own segments; a slice is what is broadcast.

Defined cases: null texts have no terms; a document without terms counts nowhere; an item without terms has no rows; repeated
terms of an item count each time; repeated rows are documents (or items) of their own; equal scores are ordered by
document id, null last, and repeated ids among themselves arbitrarily; empty tables give empty results; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from backline.llm.common import store, union, words_of

K = 10
# A segment closes at either size; a document is never divided.
SEGMENT_DOCS = 8192
SEGMENT_BYTES = 16 << 20
SLICE_BYTES = 2 << 20
_LOWER = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))
# A byte that no UTF-8 text holds stands between texts.
_BORDER = b"\xff"


def _item_slices(items: DataFrame, slice_bytes: int) -> Iterator[list[tuple[int, list[bytes]]]]:
    """(row number, terms) of the stored items, about ``slice_bytes`` of text at a time, dealt by row number."""
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = -(-total // slice_bytes)
    for k in range(n):
        rows = items.where(F.pmod(F.xxhash64("item"), F.lit(n)) == k).where("text is not null").select("item", F.col("text").cast("binary")).collect()
        found = [(r.item, words_of(bytes(r.text))) for r in rows]
        yield [(item, terms) for item, terms in found if terms]


_SEGMENT = "n_docs long, n_words long, ids array<long>, lengths array<int>, terms array<int>, df array<int>, docs binary, tf binary"


def _segment(ids: list, texts: list[bytes], numbers: dict[bytes, int]) -> pa.RecordBatch:
    """One row: documents with a searched term, and for each such term its documents and occurrences."""
    tokens = (b" " + _BORDER + b" ").join(t.translate(_LOWER) for t in texts).split()
    coded = np.fromiter(map(numbers.get, tokens, repeat(-1)), np.int64, len(tokens))
    border = coded == -2
    doc = np.cumsum(border)
    lengths = np.bincount(doc[~border], minlength=len(texts))
    hit = coded >= 0
    pairs, tf = np.unique(coded[hit] * len(texts) + doc[hit], return_counts=True)
    term, doc = pairs // len(texts), pairs % len(texts)
    held = np.unique(doc)
    terms, df = np.unique(term, return_counts=True)
    row = [
        (pa.array([int((lengths > 0).sum())], pa.int64())),
        (pa.array([int(lengths.sum())], pa.int64())),
        (pa.array([[ids[d] for d in held]], pa.list_(pa.int64()))),
        (pa.array([lengths[held]], pa.list_(pa.int32()))),
        (pa.array([terms], pa.list_(pa.int32()))),
        (pa.array([df], pa.list_(pa.int32()))),
        (pa.array([np.searchsorted(held, doc).astype("<u2").tobytes()], pa.binary())),
        (pa.array([tf.astype("<u4").tobytes()], pa.binary())),
    ]
    return pa.RecordBatch.from_arrays(row, names=["n_docs", "n_words", "ids", "lengths", "terms", "df", "docs", "tf"])


def build_segments(docs: DataFrame, vocabulary: list[bytes], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Stored segments of the occurrences of the given terms."""
    sent = docs.sparkSession.sparkContext.broadcast(vocabulary)
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = {t: i for i, t in enumerate(sent.value)}
        numbers[_BORDER] = -2
        ids, texts, held = [], [], 0
        for batch in batches:
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids.append(i)
                texts.append(t.as_py())
                held += len(texts[-1])
                if held >= SEGMENT_BYTES or len(ids) == SEGMENT_DOCS:
                    yield _segment(ids, texts, numbers)
                    ids, texts, held = [], [], 0
        if ids:
            yield _segment(ids, texts, numbers)

    return store(source.mapInArrow(run, _SEGMENT), "masks", **{"parquet.block.row.count.limit": "32"})


class Segment:
    """Postings and contributions of one segment."""

    def __init__(self, row: dict, n_docs: int, n_words: int):
        self.ids = row["ids"]
        self.size = len(self.ids)
        self.terms = np.asarray(row["terms"], np.int64)
        self.bounds = np.concatenate([[0], np.cumsum(np.asarray(row["df"], np.int64))])
        self.docs = np.frombuffer(row["docs"], "<u2").astype(np.int64)
        tf = np.frombuffer(row["tf"], "<u4").astype(np.int64)
        m = 25 + 75 * np.asarray(row["lengths"], np.int64) * n_docs // n_words
        self.part = 1_000_000_000 * tf // (1000 * tf + 8 * m[self.docs]) if self.size else tf
        self.best = np.maximum.reduceat(self.part, self.bounds[:-1]) if len(self.terms) else tf

    def masks(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(documents by group, bounds of the groups, (groups x terms) 0/1): documents with the same terms, none left out but those without."""
        bits = np.zeros((len(rows), self.size), np.uint8)
        for bitmap, r in zip(bits, rows):
            bitmap[self.docs[self.bounds[r] : self.bounds[r + 1]]] = 1
        turned = np.packbits(bits, axis=0)  # by document: eight terms in a byte
        turned = np.concatenate([turned, np.zeros((-len(turned) % 8, self.size), np.uint8)])
        words = np.ascontiguousarray(turned.T).view(np.uint64)
        group = np.zeros(self.size, np.int64)
        for w in words.T:
            _, code = np.unique(w, return_inverse=True)
            _, group = np.unique(group * self.size + code, return_inverse=True)
        order = np.argsort(group, kind="stable")
        starts = np.flatnonzero(np.diff(group[order], prepend=-1))
        return order, np.append(starts, self.size), bits[:, order[starts]].T

    def scores(self, rows: np.ndarray, weights: np.ndarray, docs: np.ndarray) -> np.ndarray:
        total = np.zeros(len(docs), np.int64)
        for r, w in zip(rows, weights):
            a, b = self.bounds[r], self.bounds[r + 1]
            at = np.searchsorted(self.docs[a:b], docs)
            at[at == b - a] = 0
            total += np.where(self.docs[a:b][at] == docs, w * self.part[a:b][at], 0)
        return total


def _better(rows: list[tuple[int, bool, int]], k: int) -> list[tuple[int, bool, int]]:
    return sorted(rows, key=lambda r: (-r[0], r[1], r[2]))[:k]


def search_segment(segment: Segment, terms: np.ndarray, weights: np.ndarray, best: list[tuple[int, bool, int]], k: int) -> list[tuple[int, bool, int]]:
    """``best`` (score, id is null, id) of one item after this segment."""
    at = np.searchsorted(segment.terms, terms)
    at[at == len(segment.terms)] = 0
    here = segment.terms[at] == terms if len(segment.terms) else np.zeros(len(terms), bool)
    rows, weights = at[here], weights[here]
    if not len(rows):
        return best
    docs, starts, holds = segment.masks(rows)
    bound = holds.astype(np.int64) @ (weights * segment.best[rows])
    order = np.argsort(-bound, kind="stable")
    sizes = np.diff(starts)[order]
    done, step = 0, 4 * k
    while done < len(order):
        least = best[-1][0] if len(best) == k else 1
        safe = int(np.searchsorted(-bound[order], -least, "right"))  # groups that can still reach the k-th place
        if done >= safe:
            break
        upto = min(safe, done + max(1, int(np.searchsorted(np.cumsum(sizes[done:safe]), step, "right"))))
        chosen = np.concatenate([docs[starts[g] : starts[g + 1]] for g in order[done:upto]])
        score = segment.scores(rows, weights, chosen)
        good = score >= max(least, 1)
        ids = [segment.ids[d] for d in chosen[good]]
        best = _better(best + [(int(s), i is None, i or 0) for s, i in zip(score[good], ids)], k)
        done, step = upto, 2 * step
    return best


def ranked_search(docs: DataFrame, items: DataFrame, k: int = K, slice_bytes: int = SLICE_BYTES, id_col: str = "doc_id", item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """Rows (item_id, rank, doc_id, score): the ``k`` best documents of every item with a score above 0."""
    spark = docs.sparkSession
    items = store(items.select(F.monotonically_increasing_id().alias("item"), F.col(item_col).alias("item_id"), F.col(text_col).alias("text")), "items")
    found = []
    for part in _item_slices(items, slice_bytes):
        if not part:
            continue
        vocabulary = sorted({t for _, terms in part for t in terms})
        numbers = {t: i for i, t in enumerate(vocabulary)}
        segments = build_segments(docs, vocabulary, id_col, text_col)
        n_docs, n_words = segments.agg(F.coalesce(F.sum("n_docs"), F.lit(0)), F.coalesce(F.sum("n_words"), F.lit(0))).first()
        if not n_words:
            break
        # one row per term of the slice
        counted = segments.select(F.explode(F.arrays_zip("terms", "df")).alias("t")).groupBy("t.terms").agg(F.sum("t.df")).collect()
        weight = np.zeros(len(vocabulary), np.int64)
        for term, df in counted:
            weight[term] = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))
        searched = []
        for item, terms in part:
            times = Counter(numbers[t] for t in terms)
            term = np.array(sorted(times), np.int64)
            searched.append((item, term, weight[term] * np.array([times[t] for t in term], np.int64)))
        sent = spark.sparkContext.broadcast(searched)

        def search(batches: Iterator[pa.RecordBatch], sent=sent, n_docs=n_docs, n_words=n_words) -> Iterator[pa.RecordBatch]:
            best: dict[int, list] = {}
            for batch in batches:
                for n in range(batch.num_rows):
                    segment = Segment(batch.slice(n, 1).to_pylist()[0], n_docs, n_words)
                    for item, term, weights in sent.value:
                        best[item] = search_segment(segment, term, weights, best.get(item, []), k)
            rows = [(item, None if null else i, score) for item, top in best.items() for score, null, i in top]
            columns = zip(*rows) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["item", "doc_id", "score"])

        found.append(segments.select("ids", "lengths", "terms", "df", "docs", "tf").mapInArrow(search, "item long, doc_id long, score long"))
    if not found:
        return items.select("item_id", F.lit(0).alias("rank"), F.lit(0).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("score")).where("false")
    place = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
    best = union(found).withColumn("rank", place).where(F.col("rank") <= k)
    return best.join(items.select("item", "item_id"), "item").select("item_id", "rank", "doc_id", "score")


def _sql_terms(text: str) -> str:
    return f"regexp_extract_all(translate(coalesce({text}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"


# The same rows in SQL: every document that shares a term with an item is scored.
ORACLE_SQL = f"""
with d as (select row_number() over () as rid, doc_id, {_sql_terms("text")} as w from documents),
total as (select count(*) as N, sum(len(w)) as L from d where len(w) > 0),
tokens as (select rid, unnest(w) as t from d),
tf as (select rid, t, count(*) as tf from tokens group by rid, t),
weight as (select t, cast(floor(1000 * ln((2 * N + 2) / (2 * count(*) + 1))) as bigint) as w from tf, total group by t, N),
item as (select row_number() over () as iid, item_id, {_sql_terms("text")} as w from benchmark),
term as (select iid, unnest(w) as t from item),
asked as (select iid, t, count(*) as times from term group by iid, t),
m as (select rid, doc_id, 25 + cast((75 * len(w) * N) // L as bigint) as m from d, total where len(w) > 0),
scored as (
  select iid, rid, sum(times * weight.w * ((1000000000 * tf) // (1000 * tf + 8 * m))) as score
  from asked join weight using (t) join tf using (t) join m using (rid) group by iid, rid),
placed as (select iid, doc_id, score, row_number() over (partition by iid order by score desc, doc_id) as rank from scored join m using (rid) where score > 0)
select item_id, cast(rank as integer) as rank, doc_id, cast(score as bigint) as score from placed join item using (iid) where rank <= {K}
"""
