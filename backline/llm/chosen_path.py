"""Jaccard join of word shingles by chosen paths (recursive splitting on sampled shared tokens).

Every text becomes the set of its five-word shingles and a sketch of ``SKETCH`` minimum hashes.  A run starts with
all sets in one node.  A node is split on one sampled coordinate of the sketch, and in a quarter of the nodes on a
second one: sets with the same minimum token at the coordinate share a child.  The expected number of children is
1 / 0.8, so a pair at similarity 0.8 keeps one shared child on average at each level.  Nodes of at most ``TILE``
sets, and nodes that splitting no longer shrinks, are compared by brute force on the sketches.  ``runs`` trees are
grown at once; a pair at 0.8 survives four levels of one tree with probability 0.57, so twelve runs reach a recall
of 0.9999.

Pairs that look close enough only decide which sets belong to one cluster.  Inside a cluster every pair is then
confirmed on the exact sets, once, and counted.  Large nodes and clusters are laid out as tiles, so that a task holds
at most two tiles, and what leaves a task is one row per set, not one per pair.

Exact copies take part once: equal texts form a class, equal shingle sets one member of the join.

Defined cases: texts of one to four words have a single shingle of all words; null texts count as empty; texts
without words have no links and are classed by equal text; repeated rows are copies; extra columns are ignored;
an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from backline.llm.common import group_roots, mix64, small_side, store, words_of
from backline.session import cut_lineage

SHINGLE, SIMILARITY = 5, 0.8
SKETCH, RUNS = 64, 12
# A sketch estimate has a deviation of 0.05 at 0.8; pairs are looked at exactly down to 4.4 deviations below.
MARGIN = 0.22
TILE, TILE_BYTES = 512, 16 << 20
MAX_DEPTH = 8
_STEP = np.uint64(0x9E3779B97F4A7C15)


# --- sets and sketches --------------------------------------------------------------------------


def shingle_sets(texts: list[bytes], size: int = SHINGLE) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of each text's shingles."""
    lengths, tokens = [], []
    for t in texts:
        w = words_of(t)
        lengths.append(len(w))
        tokens += w
    if not tokens:
        return [np.zeros(0, np.uint64) for _ in texts]
    coded = pa.array(tokens, pa.binary()).dictionary_encode()
    names = np.array([xxhash.xxh64_intdigest(w) for w in coded.dictionary.to_pylist()], np.uint64)
    h = names[coded.indices.to_numpy()]
    rolled = h[: max(0, len(h) - size + 1)].copy()
    for k in range(1, size):
        rolled = rolled * _STEP + h[k : len(h) - size + 1 + k]
    rolled = mix64(rolled)
    sets, at = [], 0
    for n in lengths:
        if n >= size:
            sets.append(np.unique(rolled[at : at + n - size + 1]))
        elif n:
            one = np.array([n], np.uint64)
            for x in h[at : at + n]:
                one = one * _STEP + x
            sets.append(mix64(one))
        else:
            sets.append(np.zeros(0, np.uint64))
        at += n
    return sets


def sketches(sets: list[np.ndarray], size: int = SKETCH) -> np.ndarray:
    """Minimum hashes, a row per set (which must not be empty)."""
    every = np.concatenate(sets)
    starts = np.concatenate([[0], np.cumsum([len(s) for s in sets])[:-1]])
    out = np.empty((size, len(sets)), np.uint64)
    for k in range(size):
        x = (every ^ mix64(np.uint64([k + 1]))) * np.uint64(0xD6E8FEB86659FD93)
        x ^= x >> np.uint64(32)
        out[k] = np.minimum.reduceat(x, starts)
    return (out.T & np.uint64(0xFFFFFFFF)).astype("<u4")


def _sketch_rows(docs: DataFrame) -> DataFrame:
    """(doc_id, tkey, skey, n_shingles, sketch) of every document, stored."""
    text = F.coalesce("text", F.lit(""))
    source = docs.select("doc_id", F.unhex(F.md5(text)).alias("tkey"), text.cast("binary").alias("text"))
    id_type = source.schema["doc_id"].dataType.simpleString()

    def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = shingle_sets(batch.column(2).to_pylist())
        full = [k for k, s in enumerate(sets) if len(s)]
        drawn = sketches([sets[k] for k in full]) if full else []
        keys, marks = [None] * len(sets), [None] * len(sets)
        for k, row in zip(full, drawn):
            keys[k], marks[k] = xxhash.xxh3_128_digest(sets[k].tobytes()), row.tobytes()
        return pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(keys, pa.binary()), pa.array([len(s) for s in sets], pa.int64()), pa.array(marks, pa.binary())],
            names=["doc_id", "tkey", "skey", "n_shingles", "sketch"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _byte_parts(batch, 2, 2 << 20):
                yield rows(part)

    return store(source.mapInArrow(run, f"doc_id {id_type}, tkey binary, skey binary, n_shingles long, sketch binary"), "sketches")


def _byte_parts(batch: pa.RecordBatch, column: int, most: int) -> Iterator[pa.RecordBatch]:
    """Slices of a batch that hold about ``most`` bytes of the column."""
    sizes = np.array([len(x.as_buffer()) for x in batch.column(column)], np.int64)
    part = np.cumsum(sizes) // most
    edges = [0, *(np.nonzero(np.diff(part))[0] + 1), batch.num_rows]
    for a, b in zip(edges, edges[1:]):
        if b > a:
            yield batch.slice(a, b - a)


# --- the tree -----------------------------------------------------------------------------------


def _children(paths: np.ndarray, sketch: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, child paths) for the first and, in a quarter of the nodes, the second coordinate."""
    draw = mix64(paths)
    rows = np.arange(len(paths))
    for k, chosen in enumerate((rows, rows[(draw >> np.uint64(40)) % np.uint64(4) == 0])):
        at = ((draw[chosen] >> np.uint64(16 * k)) % np.uint64(SKETCH)).astype(np.int64)
        yield chosen, mix64(paths[chosen] * _STEP + mix64(sketch[chosen, at].astype(np.uint64) * np.uint64(SKETCH) + at.astype(np.uint64)))


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<u4").reshape(len(column), SKETCH)


def _first_level(sets: DataFrame, runs: int) -> DataFrame:
    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            drawn = _matrix(batch.column(1))
            for r in range(runs):
                for rows, path in _children(np.full(len(drawn), r + 1, np.uint64), drawn):
                    yield pa.RecordBatch.from_arrays([pa.array(path.view(np.int64)), batch.column(0).take(pa.array(rows))], names=["path", "sid"])

    return sets.select("sid", "sketch").mapInArrow(split, "path long, sid long")


def _next_level(nodes: DataFrame) -> DataFrame:
    """Children of (path, sid, sketch, n); ``n`` becomes ``parent_n``."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            path = batch.column(0).to_numpy().view(np.uint64)
            for rows, child in _children(path, _matrix(batch.column(2))):
                take = pa.array(rows)
                yield pa.RecordBatch.from_arrays([pa.array(child.view(np.int64)), batch.column(1).take(take), batch.column(2).take(take), batch.column(3).take(take)], names=["path", "sid", "sketch", "parent_n"])

    return nodes.select("path", "sid", "sketch", "n").mapInArrow(split, "path long, sid long, sketch binary, parent_n long")


def _with_size(nodes: DataFrame) -> DataFrame:
    """Members of nodes of two or more, with the node's size ``n``."""
    return nodes.join(nodes.groupBy("path").agg(F.count("*").alias("n")).where("n > 1"), "path")


def candidate_edges(sets: DataFrame, runs: int = RUNS) -> DataFrame:
    """Edges (a, b) that connect the sets which look similar in some node."""
    level = cut_lineage(_with_size(_first_level(sets, runs)))
    level = level.join(sets.select("sid", "sketch"), "sid").withColumn("parent_n", F.lit(None).cast("long"))
    found = []
    for depth in range(1, MAX_DEPTH + 1):
        level = cut_lineage(level)
        dense = (F.lit(depth) >= 2) & (2 * F.col("n") > F.col("parent_n")) | (F.lit(depth) == MAX_DEPTH)
        ends = (F.col("n") <= TILE) | F.coalesce(dense, F.lit(False))
        leaves = level.where(ends).withColumn("tiles", F.ceil(F.col("n") / TILE).cast("int"))
        found.append(cut_lineage(_tiled(leaves, "path", ["sid", "sketch"], _compare_sketches, "a long, b long")))
        level = level.where(~ends)
        if level.isEmpty():
            break
        level = _with_size(_next_level(level))
    edges = found[0]
    for more in found[1:]:
        edges = edges.union(more)
    return edges.distinct()


# --- brute force inside nodes and clusters ---------------------------------------------------------


def _tiled(members: DataFrame, group: str, columns: list[str], compare: Callable, schema: str) -> DataFrame:
    """Each pair of a group's tiles in one row; ``tiles`` gives the group's number of tiles.

    ``compare`` gets the columns as lists and the tile side of each member (False, True, or all False for one tile with itself).
    """
    tile = F.pmod(F.xxhash64("sid"), F.col("tiles").cast("long")).cast("int")
    spread = members.withColumn("__tile", tile).withColumn("__other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    keyed = spread.select(F.col(group).alias("g"), F.least("__tile", "__other").alias("i"), F.greatest("__tile", "__other").alias("j"), F.struct(F.col("__tile").alias("tile"), *columns).alias("m"))
    gathered = keyed.groupBy("g", "i", "j").agg(F.collect_list("m").alias("m")).where("size(m) > 1").select("i", "j", "m")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                i, j = batch.column(0)[k].as_py(), batch.column(1)[k].as_py()
                m = batch.column(2)[k].values
                side = m.field("tile").to_numpy() == j if i != j else np.zeros(len(m), bool)
                if i != j and (side.all() or not side.any()):
                    continue
                yield from compare([m.field(c) for c in columns], side)

    return gathered.mapInArrow(run, schema)


def _pieces(near: np.ndarray) -> np.ndarray:
    """Number of the first member of each member's connected piece."""
    root = np.full(len(near), -1)
    for s in range(len(near)):
        if root[s] >= 0:
            continue
        root[s] = s
        edge = np.array([s])
        while len(edge):
            edge = np.nonzero(near[edge].any(axis=0) & (root < 0))[0]
            root[edge] = s
    return root


def _compare_sketches(columns: list[pa.Array], side: np.ndarray) -> Iterator[pa.RecordBatch]:
    # in order of the ids: a piece is named by its least member, so tiles of one group give the same edges
    order = np.argsort(columns[0].to_numpy(), kind="stable")
    keys, drawn = columns[0].to_numpy()[order].tolist(), _matrix(columns[1])[order]
    same = np.zeros((len(keys), len(keys)), np.uint8)
    for c in drawn.T:
        same += c[:, None] == c[None, :]
    near = same >= (SIMILARITY - MARGIN) * SKETCH
    root = _pieces(near)
    joined = np.nonzero(root != np.arange(len(keys)))[0]
    if len(joined):
        yield pa.RecordBatch.from_arrays([pa.array([keys[root[k]] for k in joined], pa.int64()), pa.array([keys[k] for k in joined], pa.int64())], names=["a", "b"])


def _shared(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections, from products of 0/1 matrices over the shingles that two sets have."""
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    number = np.cumsum(times > 1) - 1
    keep = times[column] > 1
    owner, column = owner[keep], number[column[keep]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    total = np.zeros((len(sets), len(sets)), np.int64)
    width = max(1, (16 << 20) // (4 * len(sets)))
    for low in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        a, b = np.searchsorted(column, [low, low + width])
        block = np.zeros((len(sets), min(width, int(column[-1]) + 1 - low)), np.float32)
        block[owner[a:b], column[a:b] - low] = 1
        total += np.rint(block @ block.T).astype(np.int64)
    return total


def _confirm(columns: list[pa.Array], side: np.ndarray) -> Iterator[pa.RecordBatch]:
    """(sid, n_links, peer): links of each member to the other tile (or its own), and a member of its piece."""
    first = {}
    for k, key in enumerate(columns[0].to_pylist()):  # a text that stands in several equal rows counts once
        first.setdefault(key, k)
    first = dict(sorted(first.items()))
    take = list(first.values())
    side = side[take]
    weight = columns[1].to_numpy()[take]
    sets = shingle_sets([columns[2][k].as_py() for k in take])
    keys = list(first)
    common = _shared(sets)
    sizes = np.array([len(s) for s in sets])
    close = common >= SIMILARITY * (sizes[:, None] + sizes[None, :] - common) - 1e-9
    np.fill_diagonal(close, False)
    if side.any():
        close &= side[:, None] != side[None, :]
    links = close @ weight
    root = _pieces(close)
    some = np.nonzero(links)[0]
    if len(some):
        yield pa.RecordBatch.from_arrays(
            [pa.array([keys[k] for k in some], pa.int64()), pa.array(links[some].astype(np.int64)), pa.array([keys[root[k]] for k in some], pa.int64())],
            names=["sid", "n_links", "peer"],
        )


# --- operators ----------------------------------------------------------------------------------


def jaccard_join(docs: DataFrame, runs: int = RUNS) -> DataFrame:
    """One row per document: (doc_id, tkey, class_id, n_links, group_id, group_key).

    tkey: hash of the text; class_id: least id with the same text; n_links: different texts at similarity 0.8 or
    more; group_id: least id of the texts connected by links; group_key: tkey of one of these texts.  Ids may be null
    or repeated, so only group_key tells groups apart.
    """
    rows = _sketch_rows(docs.select("doc_id", "text"))
    texts = cut_lineage(rows.groupBy("tkey").agg(F.min("doc_id").alias("class_id"), F.first("skey").alias("skey"), F.first("n_shingles").alias("n_shingles"), F.first("sketch").alias("sketch")))
    alike = texts.where("skey is not null").groupBy("skey").agg(F.count("*").alias("n_texts"), F.min("class_id").alias("first_id"), F.min(F.struct("class_id", "tkey")).alias("rep"), F.first("n_shingles").alias("n_shingles"), F.first("sketch").alias("sketch"))
    sets = store(alike.withColumn("sid", F.monotonically_increasing_id()), "sets")  # numbered once, in the stored table
    clusters = group_roots(candidate_edges(sets, runs)).select(F.col("node").alias("sid"), F.col("root").alias("cluster"))
    members = cut_lineage(clusters.join(sets.select("sid", "n_texts", "rep", "n_shingles"), "sid"))
    tiles = F.ceil(F.greatest(F.count("*") / TILE, F.sum("n_shingles") * 8 / TILE_BYTES)).cast("int")
    sized = members.join(members.groupBy("cluster").agg(tiles.alias("tiles")), "cluster")
    wanted = cut_lineage(sized.select(F.col("rep.class_id").alias("w_id"), F.col("rep.tkey").alias("tkey"), "cluster", "tiles", "sid", "n_texts"))
    full = docs.select("doc_id", "text", F.unhex(F.md5(F.coalesce("text", F.lit("")))).alias("tkey"))
    fetched = full.join(small_side(wanted), (full.tkey == wanted.tkey) & full.doc_id.eqNullSafe(wanted.w_id)).select("cluster", "tiles", "sid", "n_texts", F.col("text").cast("binary").alias("text"))
    confirmed = cut_lineage(_tiled(fetched, "cluster", ["sid", "n_texts", "text"], _confirm, "sid long, n_links long, peer long"))
    links = confirmed.groupBy("sid").agg(F.sum("n_links").alias("linked"))
    roots = group_roots(confirmed.select(F.col("sid").alias("a"), F.col("peer").alias("b"))).select(F.col("node").alias("sid"), "root")
    joined = sets.select("skey", "sid", "n_texts", "first_id", F.col("rep.tkey").alias("first_key")).join(links, "sid", "left").join(roots, "sid", "left")
    joined = joined.select("skey", F.coalesce("root", "sid").alias("root"), (F.col("n_texts") - 1 + F.coalesce("linked", F.lit(0))).alias("n_links"), "first_id", "first_key")
    least = joined.groupBy("root").agg(F.min("first_id").alias("group_id"), F.min("first_key").alias("group_key"))
    per_set = joined.join(least, "root").select("skey", "n_links", "group_id", "group_key")
    per_text = texts.join(per_set, "skey", "left").select("tkey", "class_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.when(F.col("skey").isNull(), F.col("class_id")).otherwise(F.col("group_id")).alias("group_id"), F.coalesce("group_key", "tkey").alias("group_key"))
    return rows.select("doc_id", "tkey").join(cut_lineage(per_text), "tkey").select("doc_id", "tkey", "class_id", "n_links", "group_id", "group_key")


def keep_one_of_each_group(docs: DataFrame, runs: int = RUNS) -> DataFrame:
    """``docs`` with the document of the least id (then text hash) of each group of linked texts."""
    joined = cut_lineage(jaccard_join(docs, runs))
    one = F.struct("doc_id", "tkey")
    best = joined.groupBy("group_key").agg(F.min(one).alias("best"), F.count("*").alias("n"))
    gone = joined.join(best.where("n > 1"), "group_key").where(~one.eqNullSafe(F.col("best"))).select(F.col("doc_id").alias("g_id"), F.col("tkey").alias("g_tkey")).distinct()
    keyed = docs.withColumn("__tkey", F.unhex(F.md5(F.coalesce("text", F.lit("")))))
    gone = small_side(cut_lineage(gone))
    kept = keyed.join(gone, (keyed["__tkey"] == gone.g_tkey) & keyed.doc_id.eqNullSafe(gone.g_id), "left_anti")
    again = joined.groupBy("doc_id", "tkey").agg(F.count("*").alias("n")).where("n > 1")
    if not again.isEmpty():
        kept = kept.dropDuplicates(["doc_id", "__tkey"])
    return kept.drop("__tkey")
