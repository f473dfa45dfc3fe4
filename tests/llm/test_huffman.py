import heapq
import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from backline.llm import huffman as H
from .frames import ODD, docs


@pytest.mark.parametrize("n", [1, 2, 3, 5, 100, 5000])
@pytest.mark.parametrize("limit", [4, 13, 18])
def test_codes_round_trip(n, limit):
    rng = np.random.default_rng(n)
    lengths = H.code_lengths(rng.zipf(1.3, n).clip(1, 10**9), limit)
    assert (2.0**-lengths).sum() <= 1 and lengths.max() <= max(limit, (n - 1).bit_length())
    book = H.CodeBook(np.arange(n) * 3, lengths)
    code, length = book.encoding()
    words = [f"{int(code[i]):0{int(length[i])}b}" for i in book.ids]
    assert not any(b.startswith(a) for a, b in zip(words, words[1:]))  # canonical codes ascend, so neighbours suffice
    for m in (1, 127, 128, 129, 1000):
        ids = rng.integers(0, n, m) * 3
        payload, bits = H.pack(ids, code, length)
        by_hand = "".join(f"{int(code[i]):0{int(length[i])}b}" for i in ids)
        assert "".join(f"{b:08b}" for b in payload).startswith(by_hand) and len(payload) == -(-len(by_hand) // 8)
        symbol, step = book.table()
        assert (H.unpack(payload, bits, m, symbol, step, book.width) == ids).all()


def test_lengths_are_optimal():
    counts = np.random.default_rng(0).integers(1, 1000, 300)
    heap, cost = [int(c) for c in counts], 0
    heapq.heapify(heap)
    while len(heap) > 1:
        both = heapq.heappop(heap) + heapq.heappop(heap)
        cost += both
        heapq.heappush(heap, both)
    assert (H.code_lengths(counts, 40) * counts).sum() == cost
    assert (H.code_lengths(counts, 9) * counts).sum() >= cost


def test_pieces_equal_whole_texts():
    with open(H.TOKENIZER, encoding="utf-8") as f:
        definition = f.read()
    encoder, whole = H.Encoder(definition), Tokenizer.from_str(definition)
    letters = [chr(c) for c in (9, 10, 11, 12, 13, 28, 31, 32, 32, 32, 0x85, 0xA0, 0x1680, 0x180E, 0x2003, 0x200B, 0x2028, 0x3000, 0xFEFF)]
    letters += list("ab'sé漢1²!_") + ["<|endoftext|>", "'ll", "\n\n", "🙂", chr(0x301)]
    rnd = random.Random(1)
    for _ in range(5000):
        text = "".join(rnd.choice(letters) for _ in range(rnd.randrange(12)))
        assert encoder.encode(text) == np.array(whole.encode(text, add_special_tokens=False).ids, "<u2").tobytes(), repr(text)


def expected(rows):
    whole = Tokenizer.from_file(H.TOKENIZER)
    return {(d, zlib.crc32(np.array(whole.encode(t or "", add_special_tokens=False).ids + [0], "<u4").tobytes())) for d, t in rows}


def check(spark, rows, **options):
    got = H.round_trip(docs(spark, rows, extra=("ids", "start", "file")), **options).collect()
    assert {(r.id, zlib.crc32(r.ids)) for r in got} == expected(rows) and len(got) == len(rows)
    got.sort(key=lambda r: r.start)
    names = [r.id for r in got]
    assert names == sorted(names, key=lambda i: (i is not None, i or 0))
    at = 0
    for r in got:
        assert r.start == at
        at += len(r.ids) // 4


def test_documents(spark):
    check(spark, ODD + [(i, "The café's naïve über-token %d  done\n" % (i % 7) * (i % 11)) for i in range(300, 100, -1)])


def test_many_small_blocks_and_files(spark):
    rnd = random.Random(3)
    rows = [(rnd.randrange(40), " ".join(rnd.choice(["alpha", "beta", "gamma", "δ"]) for _ in range(rnd.randrange(60)))) for _ in range(400)]
    rows += [(7, "the same row")] * 300  # one id with nearly half of the rows
    check(spark, rows, block_ids=50, file_ids=900)


def test_empty_table_and_one_symbol(spark):
    assert H.round_trip(docs(spark, [])).count() == 0
    check(spark, [(1, ""), (2, None)])


def test_blocks_stand_alone(spark, tmp_path):
    rows = [(i, f"text number {i} of this corpus") for i in range(200)]
    H.write_ids(docs(spark, rows), str(tmp_path), block_ids=64, file_ids=10_000)
    book = spark.read.parquet(f"{tmp_path}/codes").toPandas()
    codes = H.CodeBook(book["id"].to_numpy(), book["length"].to_numpy())
    block = spark.read.parquet(f"{tmp_path}/blocks").where("block = 5").first()
    ids = H.unpack(bytes(block.payload), bytes(block.bits), sum(block.lengths), *codes.table(), codes.width)
    whole = Tokenizer.from_file(H.TOKENIZER)
    assert ids.tolist() == [t for i in block.ids for t in whole.encode(rows[i][1], add_special_tokens=False).ids + [0]]


def test_refuses_other_tokenizers(spark):
    with pytest.raises(ValueError):
        H.round_trip(docs(spark, [(1, "a")]), "/opt/tokenizers/word_bpe_49k.json")
