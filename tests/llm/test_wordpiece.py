import random

import pytest

from backline.llm import wordpiece as W
from .frames import ODD, docs


def greedy(word, vocab, mark=b""):
    n, at = 0, 0
    while at < len(word):
        for end in range(len(word), at, -1):
            if (mark if at else b"") + word[at:end] in vocab:
                break
        else:
            return 1
        n, at = n + 1, end
    return n


@pytest.mark.parametrize("mark", [b"", b"##"])
@pytest.mark.parametrize("seed", range(8))
def test_automaton_equals_greedy_matching(seed, mark):
    rnd = random.Random(seed)
    piece = lambda: bytes(rnd.choice(b"abc") for _ in range(rnd.randrange(1, 6)))
    vocab = {piece() for _ in range(rnd.randrange(1, 30))} | ({mark + piece() for _ in range(rnd.randrange(1, 30))} if mark else set())
    if seed % 2:
        vocab |= {b"a", b"b", b"c"} | {mark + x for x in (b"a", b"b", b"c")}
    auto = W.LongestMatch(vocab, mark)
    for _ in range(400):
        word = bytes(rnd.choice(b"abc" if seed % 3 else b"abcd") for _ in range(rnd.randrange(0, 12)))
        assert auto.count(word) == greedy(word, vocab, mark), (word, vocab)


def test_documents(spark):
    rows = ODD + [(6, "The café's naïve über-token 12345 !!! \n\n done"), (7, "x" * 100_000)]
    vocab = set(W.read_ranks(W.VOCABULARY))
    split = W.regex.compile(W.WORDS).findall
    got = sorted(((r.doc_id, r.n_words, r.n_tokens) for r in W.token_counts(docs(spark, rows, extra=("n_tokens",))).collect()), key=str)
    longest = max(map(len, vocab))

    def count(text):
        total = 0
        for w in split(text or ""):
            b, at = w.encode(), 0
            while at < len(b):
                at = next(e for e in range(min(len(b), at + longest), at, -1) if b[at:e] in vocab)
                total += 1
        return total

    assert got == sorted(((d, len(split(t or "")), count(t)) for d, t in rows), key=str)
    assert W.token_counts(docs(spark, [])).count() == 0
