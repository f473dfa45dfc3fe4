"""Benchmark decontamination with a positional inverted index of the training text.

``build_index`` turns documents into *segments* of about a megabyte of text.  A segment row holds
the segment's terms, the number of postings of each and their word positions (gaps, compressed), so
the index is sharded by document: no term's list ever has to meet in one task, and a hot word only
makes each segment's own list longer.  ``find_matches`` reads the index segment by segment.  For every
test phrase it takes the phrase's rarest term in that segment, shifts its positions to phrase starts and
intersects them with the shifted lists of the next rarest terms until all have agreed.

The benchmark is sent to the tasks in slices of at most ``slice_bytes`` of text, whatever its size;
each slice meets the whole index.

Defined cases: null or wordless texts are documents of 0 words; items without words have no phrase; items
with null id mark words but are not listed; repeated rows are answered row by row; empty tables give
empty results; any extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from backline.llm.common import small_side, store, union, words_of
from backline.session import cut_lineage

SEGMENT_BYTES = 1 << 20
WINDOW = 10
_GAP = np.int64(1) << np.int64(32)


# --- index --------------------------------------------------------------------------------------


def _pack(numbers: np.ndarray) -> bytes:
    """uint32 numbers, byte planes apart, compressed."""
    planes = numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes).tobytes())


def _unpack(data: bytes) -> np.ndarray:
    raw = zstandard.ZstdDecompressor().decompress(data)
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(4, -1).T).view("<u4").ravel().astype(np.int64)


def _segment(ids: list, texts: list[bytes]) -> dict:
    lengths, tokens = [], []
    for t in texts:
        w = words_of(t)
        lengths.append(len(w))
        tokens += w
    coded = pa.array(tokens, pa.binary()).dictionary_encode()
    codes, terms = coded.indices.to_numpy(), coded.dictionary.to_pylist()
    counts = np.bincount(codes, minlength=len(terms)) if terms else np.zeros(0, np.int64)
    positions = np.argsort(codes, kind="stable")
    gaps = np.diff(positions, prepend=0)
    firsts = np.concatenate([[0], np.cumsum(counts)[:-1]]).astype(np.int64) if terms else np.zeros(0, np.int64)
    gaps[firsts] = positions[firsts]
    return {
        "ids": ids,
        "lengths": lengths,
        "terms": zstandard.ZstdCompressor(level=1).compress(b" ".join(terms)),
        "counts": _pack(counts),
        "gaps": _pack(gaps),
    }


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", segment_bytes: int = SEGMENT_BYTES) -> DataFrame:
    """The stored index: one row per segment (segment, ids, lengths, terms, counts, gaps).

    A segment closes once it holds ``segment_bytes`` of text; one document is never divided.
    """
    source = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))
    id_type = source.schema["id"].dataType.simpleString()
    arrow_id = source.limit(0).toArrow().schema.field("id").type
    fields = [("segment", pa.int64()), ("ids", pa.list_(arrow_id)), ("lengths", pa.list_(pa.int32())), ("terms", pa.binary()), ("counts", pa.binary()), ("gaps", pa.binary())]

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        ids, texts, held = [], [], 0

        def close():
            nonlocal number, ids, texts, held
            row = {"segment": number} | _segment(ids, texts)
            number, ids, texts, held = number + 1, [], [], 0
            return pa.RecordBatch.from_arrays([pa.array([row[n]], t) for n, t in fields], names=[n for n, _ in fields])

        for batch in batches:
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1)):
                text = t.as_py()
                ids.append(i)
                texts.append(text)
                held += len(text)
                if held >= segment_bytes:
                    yield close()
        if ids:
            yield close()

    schema = f"segment long, ids array<{id_type}>, lengths array<int>, terms binary, counts binary, gaps binary"
    return store(source.mapInArrow(build, schema), "postings", **{"parquet.block.row.count.limit": "32"})


# --- phrases ------------------------------------------------------------------------------------


def _slices(benchmark: DataFrame, id_col: str, text_col: str, slice_bytes: int) -> Iterator[list[tuple[str | None, list[bytes]]]]:
    """(item id as text, words) of the benchmark, at most about ``slice_bytes`` of text at a time."""
    items = benchmark.select(F.col(id_col).cast("string").alias("item"), F.col(text_col).cast("binary").alias("text")).where("text is not null")
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = -(-total // slice_bytes)
    for k in range(n):
        rows = items.where(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == k).distinct().collect()
        yield [(r.item, words_of(bytes(r.text))) for r in rows]


def _phrases(items: list[tuple[str | None, list[bytes]]], window: int) -> dict | None:
    """Phrase table of a slice: vocabulary, term numbers (padded with -1), lengths and owners."""
    vocab: dict[bytes, int] = {}
    rows, owners = {}, []
    for item, words in items:
        if not words:
            continue
        coded = [vocab.setdefault(w, len(vocab)) for w in words]
        for s in range(max(1, len(coded) - window + 1)):
            rows.setdefault(tuple(coded[s : s + window]), set()).add(item)
    if not rows:
        return None
    table = np.full((len(rows), window), -1, np.int64)
    for k, r in enumerate(rows):
        table[k, : len(r)] = r
        owners.append(sorted(rows[r], key=lambda x: (x is None, x)))
    return {"vocab": list(vocab), "table": table, "lengths": np.array([len(r) for r in rows]), "owners": owners}


class _Lists:
    """The posting lists of one segment, terms numbered as in the phrase vocabulary."""

    def __init__(self, row: dict, vocab: list[bytes]):
        data = zstandard.ZstdDecompressor().decompress(row["terms"])
        place = {t: k for k, t in enumerate(data.split(b" "))} if data else {}
        self.local = np.array([place.get(t, -1) for t in vocab] + [-2])
        self.counts = _unpack(row["counts"])
        self.offsets = np.concatenate([[0], np.cumsum(self.counts)])
        gaps = _unpack(row["gaps"])
        running = np.cumsum(gaps)
        before = np.concatenate([[0], running])[self.offsets[:-1]]
        self.positions = running - np.repeat(before, self.counts)
        self.keys = np.repeat(np.arange(len(self.counts)), self.counts) * _GAP + self.positions
        self.bounds = np.concatenate([[0], np.cumsum(row["lengths"])]).astype(np.int64)

    def postings(self, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Owner index and position of every posting of ``terms``."""
        n = self.counts[terms]
        owner = np.repeat(np.arange(len(terms)), n)
        inner = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        return owner, self.positions[np.repeat(self.offsets[terms], n) + inner]

    def has(self, terms: np.ndarray, positions: np.ndarray) -> np.ndarray:
        want = terms * _GAP + positions
        at = np.searchsorted(self.keys, want)
        return (positions >= 0) & (self.keys[np.minimum(at, len(self.keys) - 1)] == want)

    def following(self, terms: np.ndarray, positions: np.ndarray) -> np.ndarray:
        """The first posting of each term at or after the position, else a very large number."""
        at = np.searchsorted(self.keys, terms * _GAP + np.maximum(positions, 0))
        key = self.keys[np.minimum(at, len(self.keys) - 1)]
        return np.where((at < len(self.keys)) & (key // _GAP == terms), key % _GAP, np.int64(1) << 40)

    def document(self, positions: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.bounds, positions, side="right") - 1


def _rarest_first(lists: _Lists, phrases: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Phrases whose terms all occur in the segment: numbers, local terms and slots by rising list length."""
    terms = lists.local[phrases["table"]]
    whole = np.nonzero((terms != -1).all(axis=1))[0]
    terms = terms[whole]
    size = np.where(terms >= 0, lists.counts[np.maximum(terms, 0)], np.iinfo(np.int64).max)
    return whole, terms, np.argsort(size, axis=1, kind="stable")


def _exact(lists: _Lists, phrases: dict) -> tuple[np.ndarray, np.ndarray]:
    """(phrase, start) of every occurrence."""
    whole, terms, slots = _rarest_first(lists, phrases)
    rows = np.arange(len(whole))
    owner, at = lists.postings(terms[rows, slots[:, 0]])
    start = at - slots[owner, 0]
    for k in range(1, terms.shape[1]):
        slot = slots[owner, k]
        term = terms[owner, slot]
        keep = (term < 0) | lists.has(np.maximum(term, 0), start + slot)
        owner, start = owner[keep], start[keep]
    length = phrases["lengths"][whole[owner]]
    keep = (start >= 0) & (lists.document(start) == lists.document(start + length - 1))
    return whole[owner[keep]], start[keep]


def _near(lists: _Lists, phrases: dict, slop: int) -> tuple[np.ndarray, np.ndarray]:
    """(phrase, start) of the first span of length + ``slop`` words, around each posting of the rarest term, with all terms in any order."""
    whole, terms, slots = _rarest_first(lists, phrases)
    rows = np.arange(len(whole))
    owner, anchor = lists.postings(terms[rows, slots[:, 0]])
    for k in range(1, terms.shape[1]):
        reach = phrases["lengths"][whole[owner]] + slop - 1
        term = terms[owner, slots[owner, k]]
        keep = (term < 0) | (lists.following(np.maximum(term, 0), anchor - reach) <= anchor + reach)
        owner, anchor = owner[keep], anchor[keep]
    reach = phrases["lengths"][whole[owner]] + slop - 1
    found = np.full(len(owner), -1, np.int64)
    for back in range(int(reach.max()) if len(reach) else -1, -1, -1):
        start = anchor - back
        good = (found < 0) & (back <= reach) & (start >= 0)
        good &= lists.document(np.maximum(start, 0)) == lists.document(anchor)
        for k in range(1, terms.shape[1]):
            term = terms[owner, slots[owner, k]]
            last = lists.following(np.maximum(term, 0), start)
            good &= (term < 0) | ((last <= start + reach) & (lists.document(np.minimum(last, lists.bounds[-1] - 1)) == lists.document(anchor)))
        found = np.where(good, start, found)
    keep = found >= 0
    return whole[owner[keep]], found[keep]


# --- operators ----------------------------------------------------------------------------------

_MATCH = "segment long, ord int, item string, kind string, starts array<int>, length int"


def find_matches(
    index: DataFrame, benchmark: DataFrame, window: int = WINDOW, slop: int | None = None, item_col: str = "item_id", text_col: str = "text", slice_bytes: int = 1 << 20
) -> DataFrame | None:
    """Rows (segment, ord, item, kind, starts, length): where phrases of an item occur in a document.

    ``kind`` is 'phrase' (all words in order) or, if ``slop`` is given, 'near' (all words in any order within
    the phrase's length + slop words); starts are word numbers in the document.  None if no item has a word.
    """
    spark = index.sparkSession
    found = []
    for items in _slices(benchmark, item_col, text_col, slice_bytes):
        phrases = _phrases(items, window)
        if phrases is None:
            continue
        sent = spark.sparkContext.broadcast(phrases)

        def match(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            table = sent.value
            for batch in batches:
                for row in batch.to_pylist():
                    lists = _Lists(row, table["vocab"])
                    if not len(lists.keys):
                        continue
                    out = []
                    for kind, (which, start) in (("phrase", _exact(lists, table)), ("near", _near(lists, table, slop) if slop is not None else ((), ()))):
                        groups: dict = {}
                        for w, s, d in zip(which, start, lists.document(np.asarray(start, np.int64)) if len(start) else ()):
                            for item in table["owners"][w]:
                                groups.setdefault((int(d), item, int(table["lengths"][w])), set()).add(int(s - lists.bounds[d]))
                        out += [(row["segment"], d, item, kind, sorted(at), n) for (d, item, n), at in groups.items()]
                    if out:
                        types = [pa.int64(), pa.int32(), pa.string(), pa.string(), pa.list_(pa.int32()), pa.int32()]
                        yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out), types)], names=["segment", "ord", "item", "kind", "starts", "length"])

        found.append(index.select("segment", "lengths", "terms", "counts", "gaps").mapInArrow(match, _MATCH))
    return union(found) if found else None


def indexed_documents(index: DataFrame) -> DataFrame:
    """One row per indexed document: (segment, ord, id, n_words)."""
    return index.select("segment", F.posexplode(F.arrays_zip("ids", "lengths"))).select("segment", F.col("pos").alias("ord"), F.col("col.ids").alias("id"), F.col("col.lengths").cast("long").alias("n_words"))


def _sorted_items(items: Column) -> Column:
    return F.sort_array(F.array_distinct(items))


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, slop: int | None = None, id_col: str = "doc_id", item_col: str = "item_id", slice_bytes: int = 1 << 20) -> DataFrame:
    """One row per document: (id, n_words, n_hit, items, near_items).

    n_hit counts the words inside any occurrence of a phrase; ``items`` are the ids, as sorted strings, of
    the items with one; ``near_items`` those with a proximity match (empty unless ``slop`` is given).
    """
    index = build_index(docs, id_col)
    every = indexed_documents(index)
    matches = find_matches(index, benchmark, window, slop, item_col, slice_bytes=slice_bytes)
    none = F.array().cast("array<string>")
    if matches is None:
        return every.select("id", "n_words", F.lit(0).cast("long").alias("n_hit"), none.alias("items"), none.alias("near_items"))
    exact = F.col("kind") == "phrase"
    covered = F.flatten(F.transform("starts", lambda s: F.sequence(s, s + F.col("length") - 1)))
    per_doc = (
        matches.select("segment", "ord", "item", "kind", F.when(exact, F.array_distinct(covered)).alias("words"))
        .groupBy("segment", "ord")
        .agg(
            F.size(F.array_distinct(F.flatten(F.collect_list("words")))).cast("long").alias("n_hit"),
            _sorted_items(F.collect_set(F.when(exact, F.col("item")))).alias("items"),
            _sorted_items(F.collect_set(F.when(~exact, F.col("item")))).alias("near_items"),
        )
    )
    joined = every.join(per_doc, ["segment", "ord"], "left")
    return joined.select("id", "n_words", F.coalesce("n_hit", F.lit(0)).alias("n_hit"), F.coalesce("items", none).alias("items"), F.coalesce("near_items", none).alias("near_items"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The documents without an occurrence of any benchmark phrase, with all their columns."""
    keyed = docs.withColumn("__key", F.xxhash64("doc_id", "text"))
    hit = contamination(keyed, benchmark, window, id_col="__key").where("n_hit > 0").select(F.col("id").alias("__key")).distinct()
    return keyed.join(small_side(cut_lineage(hit)), "__key", "left_anti").drop("__key")


def _sql_words(text: str) -> str:
    return f"regexp_extract_all(translate(coalesce({text}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"


# The same rows in SQL, with a slop of two words; phrases are compared as strings.
ORACLE_SQL = f"""
with d as (select row_number() over () as rid, doc_id, {_sql_words("text")} as w from documents),
items as (select cast(item_id as varchar) as item, {_sql_words("text")} as w from benchmark),
cuts as (select item, w, unnest(range(1, greatest(1, len(w) - {WINDOW - 1}) + 1)) as s from items where len(w) > 0),
phrases as (select distinct item, list_slice(w, s, s + {WINDOW - 1}) as p from cuts),
keyed as (select item, p, len(p) as n, array_to_string(p, ' ') as text, row_number() over () as pid from phrases),
places as (select rid, n, unnest(range(1, len(w) - n + 2)) as s from d, (select distinct n from keyed) where len(w) >= n),
grams as (select places.rid, places.n, s, array_to_string(list_slice(w, s, s + places.n - 1), ' ') as text from places join d using (rid)),
found as (select rid, s, grams.n as n, item from grams join keyed on grams.text = keyed.text and grams.n = keyed.n),
hit as (select rid, count(distinct pos) as n_hit from (select rid, unnest(range(s, s + n)) as pos from found) group by rid),
listed as (select rid, count(*) as n_items, string_agg(item, ',' order by item) as ids from (select distinct rid, item from found where item is not null) group by rid),
tokens as (select rid, unnest(w) as t, unnest(range(1, len(w) + 1)) as pos from d),
df as (select t, count(*) as n from tokens group by t),
rarest as (select pid, arg_min(t, (n, t)) as t from (select pid, unnest(p) as t from keyed) join df using (t) group by pid),
anchors as (select rid, pid, item, n, p, pos from rarest join keyed using (pid) join tokens using (t)),
near as (
  select distinct rid, item from (select rid, item, n, p, unnest(range(greatest(1, pos - n - 1), pos + 1)) as s from anchors) join d using (rid)
  where item is not null and list_has_all(list_slice(w, s, s + n + 1), p)),
nears as (select rid, count(*) as n_near_items from near group by rid)
select doc_id, cast(len(w) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, sha256(coalesce(ids, '')) as items_sha256,
       coalesce(n_hit, 0) > 0 as contaminated, coalesce(n_near_items, 0) as n_near_items
from d left join hit using (rid) left join listed using (rid) left join nears using (rid)
"""
