"""Token counts by a linear longest-match automaton.

The vocabulary becomes a trie over bytes.  Every trie node gets a failure link and the number of pieces that
following it takes off the front of what was read (the greedy pieces themselves are never built).  Reading a word is
then one pass: step down the trie, and where that is impossible add the node's count and follow its link.

Words come from the tokenizer's splitting pattern.  A vocabulary may mark pieces that continue a word by a prefix
(``##``); then the first piece of a word must be unmarked and all others marked.  A word that the pieces cannot spell counts as
one unknown token, as in word-piece tokenizers.

Defined cases: null and empty texts have no tokens; repeated rows are counted row by row; whole texts are read,
whatever their length; empty tables give empty results; extra columns are ignored.
"""

from __future__ import annotations

import base64
from collections import deque
from collections.abc import Iterable, Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Words with an optional leading blank, numbers, marks, white space (the splitting rule that belongs to the vocabulary).
WORDS = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
# Words whose count is remembered by a task; the memory starts anew beyond it.
REMEMBERED = 300_000


def read_ranks(path: str) -> list[bytes]:
    """Pieces of a file of base64 pieces and ranks."""
    with open(path, "rb") as f:
        return [base64.b64decode(line.split()[0]) for line in f if line.strip()]


class LongestMatch:
    """Counts the greedy longest-match pieces of a word in time linear in its bytes."""

    def __init__(self, pieces: Iterable[bytes], continuing: bytes = b""):
        self.step: list[dict[int, int]] = [{}]
        ends = [False]

        def add(root: int, piece: bytes) -> None:
            at = root
            for b in piece:
                if b not in self.step[at]:
                    self.step[at][b] = len(self.step)
                    self.step.append({})
                    ends.append(False)
                at = self.step[at][b]
            ends[at] = True

        self.start, self.inner = 0, 0
        if continuing:
            self.inner = 1
            self.step.append({})
            ends.append(False)
        for p in pieces:
            if continuing and p.startswith(continuing):
                if len(p) > len(continuing):
                    add(self.inner, p[len(continuing) :])
            elif p:
                add(self.start, p)
        n = len(self.step)
        self.link = [-1] * n
        self.popped = [0] * n
        todo = deque({self.start, self.inner})
        while todo:
            u = todo.popleft()
            for b, v in self.step[u].items():
                if ends[v]:
                    self.link[v], self.popped[v] = self.inner, 1
                else:
                    z, taken = self.link[u], self.popped[u]
                    while z >= 0 and b not in self.step[z]:
                        taken += self.popped[z]
                        z = self.link[z]
                    if z >= 0:
                        self.link[v], self.popped[v] = self.step[z][b], taken
                todo.append(v)

    def count(self, word: bytes) -> int:
        """Pieces of the word, 1 if it cannot be spelled, 0 if it is empty."""
        if not word:
            return 0
        at, total = self.start, 0
        step, link, popped = self.step, self.link, self.popped
        for b in word:
            while b not in step[at]:
                total += popped[at]
                at = link[at]
                if at < 0:
                    return 1
            at = step[at][b]
        while at != self.inner:
            total += popped[at]
            at = link[at]
            if at < 0:
                return 1
        return total


def token_counts(docs: DataFrame, vocabulary: str = VOCABULARY, pattern: str = WORDS, continuing: bytes = b"") -> DataFrame:
    """One row per document: (doc_id, n_words, n_tokens, longest): pieces in all and in the longest word.

    The vocabulary file is read on the driver and its pieces (not the documents) are sent to the tasks.
    """
    pieces = docs.sparkSession.sparkContext.broadcast(read_ranks(vocabulary))
    source = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    id_type = source.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = LongestMatch(pieces.value, continuing)
        split = regex.compile(pattern).findall

        class Counts(dict):
            def __missing__(self, word: str) -> int:
                if len(self) >= REMEMBERED:
                    self.clear()
                self[word] = n = automaton.count(word.encode())
                return n

        counts = Counts()
        for batch in batches:
            words, tokens, longest = [], [], []
            for text in batch.column(1):
                each = [counts[w] for w in split(text.as_py())]
                words.append(len(each))
                tokens.append(sum(each))
                longest.append(max(each, default=0))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(words, pa.int64()), pa.array(tokens, pa.int64()), pa.array(longest, pa.int64())], names=["doc_id", "n_words", "n_tokens", "longest"])

    return source.mapInArrow(run, f"doc_id {id_type}, n_words long, n_tokens long, longest long")
