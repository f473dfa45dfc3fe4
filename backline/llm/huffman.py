"""Token ids written as length-limited canonical Huffman codes, and read back.

A written corpus is a folder with two Parquet tables that need nothing else to be read:

``codes``   (id, length): the code length of every id that occurs.  Codes are canonical (given out by length, then id), so
            lengths are the whole code book.
``blocks``  one row per block, in ascending document order: (file, block, first, ids, lengths, bits, payload).  ``first`` counts
            the ids of the same file before the block, ``ids`` and ``lengths`` are the documents of the block and their numbers of
            token ids, ``payload`` is the bit stream (most significant bit first) and ``bits`` the checkpoints: the bit
            offset of every ``STRIDE``-th id as little-endian unsigned 32-bit integers.

A block can be decoded alone, and inside it all checkpoints are followed at the same time, one table look-up per id.  A block
closes after ``BLOCK_IDS`` ids and never divides a document; a file holds about ``FILE_IDS`` ids.

Defined cases: null and empty texts hold the end id alone; a null document id comes first; documents with one id are ordered by
a hash of their token ids and then by row, so a repeated id may fill several files; an empty table writes no block;
extra columns are ignored.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from backline.llm.common import small_side, store
from backline.session import checkpoint_dir

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"
END_ID = 0
#: Longest code; raised by itself when a vocabulary has more ids than codes of this length.
MAX_BITS = 18
BLOCK_IDS = 1 << 18
STRIDE = 128
#: About 40 MB of payload.
FILE_IDS = 1 << 25
# Pieces whose ids a worker remembers (about 200 MB); the memory starts anew beyond it.
REMEMBERED = 1_000_000
# Unicode white space, as the tokenizer's splitting rule understands it.
_SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
# Latin letters up to U+024F.
_LATIN = r"A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\u024f"
# The rule never joins what lies on both sides of these borders, so pieces may be encoded one by one and remembered: Latin
# words before ASCII marks, digits or blanks, marks before Latin letters, digits or blanks, other runs up to white space, white space.
_PIECES = re.compile(
    rf" ?[{_LATIN}]+(?![^\x00-\x40\x5b-\x60\x7b-\x7f])| ?[!-&(-/:-@\[-`{{-~]+(?=[{_LATIN}0-9{_SPACE}]|\Z)"
    rf"| ?[^{_SPACE}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+"
)
_WORD = re.compile(rf" ?[{_LATIN}]+\Z")
_memory: dict[str, Encoder] = {}


def _shown() -> dict[int, str]:
    """Byte-level BPE shows printable bytes as themselves and the others, in order, as the characters from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}


_SHOWN = _shown()


class Encoder(dict):
    """Piece of text -> its ids as little-endian bytes, by the tokenizers library; kept by a worker across tasks."""

    def __init__(self, definition: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(definition)
        self.kind = id_kind(self.tokenizer.get_vocab_size())
        self.whole = [token.content for token in self.tokenizer.get_added_tokens_decoder().values()]

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= REMEMBERED:
            self.clear()
        self[piece] = ids = self._encode(piece)
        return ids

    def _encode(self, text: str) -> bytes:
        if _WORD.match(text):  # one word of the splitting rule: straight to the merges
            return np.array([token.id for token in self.tokenizer.model.tokenize(text.encode().decode("latin-1").translate(_SHOWN))], self.kind).tobytes()
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.kind).tobytes()

    def encode(self, text: str) -> bytes:
        if any(token in text for token in self.whole):  # the library cuts such texts first
            return self._encode(text)
        return b"".join(map(self.__getitem__, _PIECES.findall(text)))

    @staticmethod
    def of(definition: str) -> Encoder:
        if definition not in _memory:
            _memory.clear()
            _memory[definition] = Encoder(definition)
        return _memory[definition]


def id_kind(vocabulary: int) -> str:
    """Little-endian type that holds all ids of a vocabulary of this size."""
    return "<u2" if vocabulary <= 1 << 16 else "<u4"


def encode_texts(docs: DataFrame, definition: str, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, ids): the token ids of each text and the end id, as bytes.  ``definition`` is the tokenizer's JSON.

    Each task adds one row without ids, whose ``token`` and ``n`` count all ids of the task.

    Pieces between white space are encoded alone, which equals encoding the whole text for tokenizers that split at white space
    before merging (byte-level BPE) and have no normalizer; others are refused.
    """
    from tokenizers import Tokenizer

    probe = Tokenizer.from_str(definition)
    if probe.normalizer is not None or type(probe.pre_tokenizer).__name__ != "ByteLevel" or probe.pre_tokenizer.add_prefix_space:
        raise ValueError("the tokenizer must be byte-level, without normalizer or added first blank")
    sent = docs.sparkSession.sparkContext.broadcast(definition)
    source = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.of(sent.value)
        end = np.array([end_id], encoder.kind).tobytes()
        total = np.zeros(0, np.int64)
        for batch in batches:
            ids = [encoder.encode(text.as_py()) + end for text in batch.column(1)]
            total = _added(total, np.bincount(np.frombuffer(b"".join(ids), encoder.kind)))
            nothing = pa.nulls(len(ids), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.binary()), nothing, nothing], names=names)
        if len(total):
            seen = np.flatnonzero(total)
            counts = [pa.array([x], pa.list_(pa.int64())) for x in (seen, total[seen])]
            yield pa.RecordBatch.from_arrays([pa.nulls(1, arrow_id), pa.nulls(1, pa.binary()), *counts], names=names)

    names = ["id", "ids", "token", "n"]
    arrow_id = source.select("id").limit(0).toArrow().schema.field("id").type
    return source.mapInArrow(run, f"id {source.schema['id'].dataType.simpleString()}, ids binary, token array<long>, n array<long>")


def _added(total: np.ndarray, n: np.ndarray) -> np.ndarray:
    size = max(len(total), len(n))
    return np.pad(total, (0, size - len(total))) + np.pad(n, (0, size - len(n)))


def code_lengths(counts: np.ndarray, limit: int = MAX_BITS) -> np.ndarray:
    """Optimal code lengths of at most ``limit`` bits (package-merge)."""
    n = len(counts)
    if n <= 1:
        return np.ones(n, np.int64)
    limit = max(limit, (n - 1).bit_length())
    order = np.argsort(counts, kind="stable")
    leaves = np.asarray(counts, np.int64)[order]
    coins, packaged = leaves, [np.zeros(n, bool)]
    for _ in range(limit - 1):
        pairs = coins[: len(coins) // 2 * 2].reshape(-1, 2).sum(1)
        coins = np.concatenate([leaves, pairs])
        by_weight = np.argsort(coins, kind="stable")
        coins = coins[by_weight]
        packaged.append(by_weight >= n)
    lengths, taken = np.zeros(n, np.int64), 2 * n - 2
    for is_pair in reversed(packaged):
        pairs = int(is_pair[:taken].sum())
        lengths[: taken - pairs] += 1
        taken = 2 * pairs
    out = np.empty(n, np.int64)
    out[order] = lengths
    return out


class CodeBook:
    """Canonical codes of (ids, lengths) with a table over the next ``width`` bits."""

    def __init__(self, ids: np.ndarray, lengths: np.ndarray):
        order = np.lexsort((ids, lengths))
        self.ids, self.lengths = np.asarray(ids, np.int64)[order], np.asarray(lengths, np.int64)[order]
        self.width = int(self.lengths.max(initial=1))
        # a canonical code, left-aligned, is the sum of the room that the codes before it take
        room = np.int64(1) << (self.width - self.lengths)
        starts = np.cumsum(room) - room
        self.codes = starts >> (self.width - self.lengths)
        self._room = room

    def encoding(self) -> tuple[np.ndarray, np.ndarray]:
        """Code and length by id."""
        size = int(self.ids.max(initial=-1)) + 1
        code, length = np.zeros(size, np.uint64), np.zeros(size, np.int64)
        code[self.ids], length[self.ids] = self.codes.astype(np.uint64), self.lengths
        return code, length

    def table(self) -> tuple[np.ndarray, np.ndarray]:
        """Id and length by the next ``width`` bits."""
        symbol, length = np.zeros(1 << self.width, np.uint32), np.ones(1 << self.width, np.int64)
        used = int(self._room.sum())
        symbol[:used] = np.repeat(self.ids, self._room)
        length[:used] = np.repeat(self.lengths, self._room)
        return symbol, length


def pack(ids: np.ndarray, code: np.ndarray, length: np.ndarray, stride: int = STRIDE) -> tuple[bytes, bytes]:
    """(payload, checkpoints) of the ids."""
    size = length[ids]
    ends = np.cumsum(size)
    at = ends - size
    word, shift = at >> 5, (64 - (at & 31) - size).astype(np.uint64)
    wide = code[ids] << shift  # the code inside the 64 bits that begin with its word
    total = int(ends[-1]) if len(ends) else 0
    n = (total >> 5) + 2
    # codes take disjoint bits, so sums of their halves are exact below 2**53
    stream = np.bincount(word, (wide >> np.uint64(32)).astype(np.float64), n) + np.bincount(word + 1, (wide & np.uint64(0xFFFFFFFF)).astype(np.float64), n)
    return stream.astype(np.uint64).astype(">u4").tobytes()[: (total + 7) // 8], at[::stride].astype("<u4").tobytes()


def unpack(payload: bytes, checkpoints: bytes, n: int, symbol: np.ndarray, length: np.ndarray, width: int, stride: int = STRIDE) -> np.ndarray:
    """The ``n`` ids of a block: all checkpoints advance together, one id a step."""
    data = np.frombuffer(payload + bytes(8), np.uint8).astype(np.uint64)
    # the 40 bits that begin at every byte
    ahead = (data[:-4] << np.uint64(32)) | (data[1:-3] << np.uint64(24)) | (data[2:-2] << np.uint64(16)) | (data[3:-1] << np.uint64(8)) | data[4:]
    at = np.frombuffer(checkpoints, "<u4").astype(np.int64)
    out = np.empty((len(at), stride), np.uint32)
    keep = np.uint64((1 << width) - 1)
    last = n - (len(at) - 1) * stride
    for k in range(stride if len(at) > 1 else last):
        lanes = len(at) if k < last else len(at) - 1  # the last lane ends early
        here = at[:lanes]
        peek = ((ahead[here >> 3] >> (40 - width - (here & 7)).astype(np.uint64)) & keep).astype(np.int64)
        out[:lanes, k] = symbol[peek]
        at[:lanes] += length[peek]
    return out.reshape(-1)[:n]


def write_ids(docs: DataFrame, path: str, tokenizer: str = TOKENIZER, end_id: int = END_ID, limit: int = MAX_BITS, block_ids: int = BLOCK_IDS, file_ids: int = FILE_IDS, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write the token ids of all texts below ``path`` in ascending order of the documents' ids.

    The tokenizer file is read on the driver.  Ids are computed once and kept in a table beside ``path`` while they are
    counted and written; the code book has at most as many rows as the vocabulary.
    """
    if limit > 32:
        raise ValueError("codes of at most 32 bits")
    spark = docs.sparkSession
    with open(tokenizer, encoding="utf-8") as f:
        definition = f.read()
    from tokenizers import Tokenizer

    kind = id_kind(Tokenizer.from_str(definition).get_vocab_size())
    tokens = encode_texts(docs, definition, end_id, id_col, text_col)
    tokens = store(tokens.select("*", F.xxhash64("ids").alias("hash"), F.monotonically_increasing_id().alias("row")), "token-ids", compression="zstd")
    sums = tokens.where("ids is null").select(F.explode(F.arrays_zip("token", "n")).alias("c")).groupBy("c.token").agg(F.sum("c.n").alias("n"))
    counted = sums.orderBy("token").toPandas()
    lengths = code_lengths(counted["n"].to_numpy(np.int64), limit)
    book = spark.createDataFrame(pa.table({"id": pa.array(counted["token"], pa.int64()), "length": pa.array(lengths, pa.int64())}))
    book.coalesce(1).write.parquet(f"{path}/codes")
    sent = spark.sparkContext.broadcast((counted["token"].to_numpy(np.int64), lengths))
    id_type = tokens.schema["id"].dataType.simpleString()
    arrow_id = tokens.select("id").limit(0).toArrow().schema.field("id").type
    fields = [("file", pa.int32()), ("block", pa.int32()), ("first", pa.int64()), ("ids", pa.list_(arrow_id)), ("lengths", pa.list_(pa.int64())), ("bits", pa.binary()), ("payload", pa.binary())]

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, length = CodeBook(*sent.value).encoding()
        file, block, first, held = TaskContext.get().partitionId(), 0, 0, 0
        names, parts = [], []

        def close() -> pa.RecordBatch:
            nonlocal block, first, names, parts, held
            payload, bits = pack(np.frombuffer(b"".join(parts), kind), code, length)
            n = np.dtype(kind).itemsize
            row = (file, block, first, names, [len(p) // n for p in parts], bits, payload)
            block, first = block + 1, first + held
            names, parts, held = [], [], 0
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, (_, t) in zip(row, fields)], names=[f for f, _ in fields])

        for batch in batches:
            for name, ids in zip(batch.column(0).to_pylist(), batch.column(1)):
                names.append(name)
                parts.append(ids.as_py())
                held += len(parts[-1]) // np.dtype(kind).itemsize
                if held >= block_ids:
                    yield close()
        if names:
            yield close()

    files = max(1, -(-int(counted["n"].sum()) // file_ids))
    placed = tokens.where("ids is not null").repartitionByRange(files, "id", "hash", "row").sortWithinPartitions("id", "hash", "row").select("id", "ids")
    schema = f"file int, block int, first long, ids array<{id_type}>, lengths array<long>, bits binary, payload binary"
    # payloads are packed already; small row groups keep the reader's tasks small
    placed.mapInArrow(blocks, schema).write.options(**{"compression": "uncompressed", "parquet.block.size": str(16 << 20)}).parquet(f"{path}/blocks")
    sent.destroy()


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """Rows (id, start, ids) of a written corpus: ``start`` counts the ids of all documents before, ``ids`` are the
    document's ids as little-endian unsigned 32-bit integers."""
    book = spark.read.parquet(f"{path}/codes").orderBy("id").toPandas()
    blocks = spark.read.parquet(f"{path}/blocks")
    # one row per file
    sizes = blocks.groupBy("file").agg(F.sum(F.aggregate("lengths", F.lit(0).cast("long"), lambda s, x: s + x)).alias("n"))
    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    bases = store(sizes.select("file", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base")), "file-starts")
    sent = spark.sparkContext.broadcast((book["id"].to_numpy(np.int64), book["length"].to_numpy(np.int64)))
    arrow_id = blocks.select("ids").limit(0).toArrow().schema.field("ids").type.value_type
    id_type = blocks.schema["ids"].dataType.elementType.simpleString()

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = CodeBook(*sent.value)
        symbol, length = codes.table()
        for batch in batches:
            for file, first, names, lengths, bits, payload in zip(*(c.to_pylist() for c in batch.columns)):
                ends = np.cumsum(lengths)
                ids = unpack(payload, bits, int(ends[-1]), symbol, length, codes.width).astype("<u4")
                cuts = [x.tobytes() for x in np.split(ids, ends[:-1])]
                starts = first + ends - np.asarray(lengths)
                yield pa.RecordBatch.from_arrays([pa.array([file] * len(names), pa.int32()), pa.array(names, arrow_id), pa.array(starts, pa.int64()), pa.array(cuts, pa.binary())], names=["file", "id", "at", "ids"])

    decoded = blocks.select("file", "first", "ids", "lengths", "bits", "payload").mapInArrow(decode, f"file int, id {id_type}, at long, ids binary")
    return decoded.join(small_side(bases), "file").select("id", (F.col("base") + F.col("at")).alias("start"), "ids")


def round_trip(docs: DataFrame, tokenizer: str = TOKENIZER, **options) -> DataFrame:
    """``docs`` written to a new folder below the shared one and read back: (id, start, ids)."""
    path = f"{checkpoint_dir(docs.sparkSession)}/coded-{uuid.uuid4().hex}"
    write_ids(docs, path, tokenizer, **options)
    return read_ids(docs.sparkSession, path)
