"""Toxicity by a support vector machine on a subsequence string kernel over sentences, with Nyström landmarks.

Two words are compared by the three-letter subsequences they share, word ends included.  The letters may lie apart, up to ``SPAN``
places in all, and each place costs a factor ``DECAY``, so ``id*iot`` and ``i.d.i.o.t`` stay close to the plain insult.  The
normalised value is raised to ``POWER``, which tells a disguised word from one that shares a syllable.  Two sentences are
compared by the sum over their pairs of words, and by the pairs of equal words that follow each other in both with gaps of
up to ``REACH`` words, which finds phrases of common words; the sum is scaled by the sentences' lengths.  A row of single letters
is one word.  Sentences end at marks and line breaks, and longer ones are read in windows of ``WINDOW`` words.

Training reads at most ``MAX_LABELLED`` labelled documents, chosen by hash, none of them held out.  Every window of a clean
document is clean; a toxic document has at least one toxic window.  Which one is found in rounds: the machine is fitted on the
current choice against clean windows, then each toxic document chooses its highest window, and the highest clean windows
join the negatives.  The first choice is the window with the word or pair that is likeliest in toxic documents.
Landmarks are windows: of the toxic ones those least covered by those before, of the clean ones some by hash and the highest.
The machine has squared hinge loss on the Nyström features.  As a function it is a weighted sum over the landmarks' words
and pairs, of which the ``BASIS`` heaviest words are kept.  A document's margin is its best window's; a logistic curve, fitted on
a sixth of the labelled documents that the machine did not see, turns it into a score.

Documented bounds of the fit (scoring has none): ``MAX_LABELLED`` documents, ``NEGATIVES`` clean windows, ``LANDMARKS`` and ``BASIS``.

Defined cases: null and empty texts have the margin of an empty window, so a low score; ids that are null are never labelled;
labels are the highest of repeated ones; documents that repeat a labelled id are read once in training and scored row by row;
without toxic or without clean labels every score is the labelled share (0 without labels); whole texts are
read; extra columns are ignored.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame, functions as F

from backline.llm.common import store

DECAY, SPAN, POWER = 0.5, 5, 4
REACH = 3
WINDOW, STEP = 4, 2
MAX_LABELLED = 20_000
NEGATIVES = 12_000
LANDMARKS = 384
BASIS = 1_000
ROUNDS = 3
LETTERS = 62  # the most frequent characters have a number of their own; 62 is any other, 63 a word's end
# Words, as they are spelled, whose value a worker remembers across its tasks (about 150 MB); the memory starts anew beyond it.
REMEMBERED = 1_000_000
_known: dict[str, Known] = {}
_GAPS = [(a, b) for a in range(1, SPAN) for b in range(1, SPAN + 1 - a)]
_SINGLES = re.compile(r"(?<!\S)(?:\S\s+){2,}\S(?!\S)")
_SENTENCE_END = re.compile(r"[.!?]+(?=\s|$)|\n")
_MARKS = ".,;:!?\"'()"

Window = tuple[str, ...]


# --- sentences -----------------------------------------------------------------------------------


def sentences(text: str) -> list[list[str]]:
    """Lower-case words of each sentence, without marks around them; rows of single characters are joined."""
    out = []
    for part in _SENTENCE_END.split(text.lower()):
        words = part.split()
        if len(words) > 2 and any(len(w) == 1 for w in words):
            words = joined(part)
        if words:
            out.append([bare(w) for w in words])
    return out


def bare(word: str) -> str:
    """The word without marks around it; one of marks only stays."""
    return word.strip(_MARKS) or word


def joined(sentence: str) -> list[str]:
    """The words of a sentence, rows of single characters joined."""
    return _SINGLES.sub(lambda m: "".join(m[0].split()), sentence).split()


def spans(n: int) -> list[tuple[int, int]]:
    """Windows (start, end) of a sentence of n words."""
    return [(0, n)] if n <= WINDOW else [(k, min(k + WINDOW, n)) for k in range(0, n - STEP, STEP)]


def all_spans(lens: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, windows a sentence) of ``spans`` for sentences that lie one after the other, by their numbers of words."""
    first = np.cumsum(lens) - lens
    many = np.where(lens <= WINDOW, 1, -(-(lens - STEP) // STEP))
    starts = np.repeat(first, many) + STEP * (np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many))
    return starts, np.minimum(starts + WINDOW, np.repeat(first + lens, many)), many


def windows(text: str) -> list[Window]:
    """Distinct windows of a text, in order."""
    return list(dict.fromkeys(tuple(s[a:b]) for s in sentences(text) for a, b in spans(len(s))))


def pairs(window: Window) -> Iterator[tuple[str, str, int]]:
    for d in range(1, REACH + 1):
        for x, y in zip(window, window[d:]):
            yield x, y, d


def length(n: int) -> float:
    """Scale of a window of n words: its kernel with itself if all words differ."""
    return float(np.sqrt(max(1, n) + sum(DECAY ** (2 * d) * max(0, n - d) for d in range(1, REACH + 1))))


# --- kernel --------------------------------------------------------------------------------------


class Alphabet:
    def __init__(self, letters: str):
        self.numbers = {ord(c): k for k, c in enumerate(letters[:LETTERS])}

    def coded(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of all characters, with ends, and the word each belongs to."""
        flat = np.frombuffer("".join(f"\0{w}\0" for w in words).encode("utf-32-le", "surrogatepass"), "<u4")
        kinds, back = np.unique(flat, return_inverse=True)
        table = np.array([63 if k == 0 else self.numbers.get(int(k), 62) for k in kinds], np.int64)
        return table[back], np.repeat(np.arange(len(words)), [len(w) + 2 for w in words])


def features(alphabet: Alphabet, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sparse rows (word, subsequence, weight), by word, each row of length one."""
    codes, owner = alphabet.coded(words)
    keys, weights = [], []
    for a, b in _GAPS:
        n = len(codes) - a - b
        if n > 0:
            inside = owner[:n] == owner[a + b :]
            keys.append((owner[:n] * 64**3 + (codes[:n] << 12) + (codes[a : n + a] << 6) + codes[a + b :])[inside])
            weights.append(np.full(len(keys[-1]), DECAY ** (a + b)))
    if not keys:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    keys, weights = np.concatenate(keys), np.concatenate(weights)
    order = np.argsort(keys)
    keys = keys[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    total = np.add.reduceat(weights[order], first)
    keys = keys[first]
    word = keys >> 18
    size = np.sqrt(np.bincount(word, total * total, len(words)))
    return word, keys & 64**3 - 1, total / size[word]


def _power(x: np.ndarray, n: int) -> np.ndarray:
    if n == 1:
        return x
    half = _power(x * x, n // 2)
    return half * x if n % 2 else half


class WordKernel:
    """Powered kernel of any words with a fixed list of words, kept as the list's words by subsequence."""

    def __init__(self, alphabet: Alphabet, words: list[str]):
        self.alphabet, self.words, self.power = alphabet, words, POWER
        owner, terms, weights = features(alphabet, words)
        order = np.argsort(terms, kind="stable")
        known, first = np.unique(terms[order], return_index=True)
        self.at = np.full(64**3, -1, np.int32)  # the place of a subsequence in ``first``, -1 if no word of the list has it
        self.at[known] = np.arange(len(known))
        self.first, self.many = first, np.diff(np.append(first, len(terms)))
        self.owner, self.weights = owner[order], weights[order].astype(np.float32).astype(float)

    def of(self, words: list[str], then: np.ndarray) -> np.ndarray:
        """Kernel values of ``words`` with the list, times ``then``."""
        out = np.zeros((len(words), then.shape[1]), np.float32)
        n = len(self.words)
        for low in range(0, len(words), 400):
            part = words[low : low + 400]
            owner, terms, weights = features(self.alphabet, part)
            at = self.at[terms]
            hit = np.flatnonzero(at >= 0)
            owner, weights, many, first = owner[hit], weights[hit], self.many[at[hit]], self.first[at[hit]]
            for k in range(0, len(part), 100):  # so many words by the list are a table at a time
                rows = min(100, len(part) - k)
                a, b = np.searchsorted(owner, (k, k + rows))
                some = many[a:b]
                inside = np.repeat(first[a:b] - np.cumsum(some) + some, some)
                inside += np.arange(len(inside))
                cells = np.repeat((owner[a:b] - k) * n, some)
                cells += self.owner.take(inside)
                each = np.repeat(weights[a:b], some)
                each *= self.weights.take(inside)
                values = np.bincount(cells, each, rows * n).astype(np.float32).reshape(rows, n)
                out[low + k : low + k + rows] = _power(np.minimum(values, 1, out=values), self.power) @ then
        return out


class SentenceKernel:
    """Kernel of windows with landmark windows."""

    def __init__(self, alphabet: Alphabet, marks: list[Window]):
        words = sorted({w for m in marks for w in m})
        number = {w: k for k, w in enumerate(words)}
        self.kernel = WordKernel(alphabet, words)
        self.inside = np.zeros((len(words), len(marks)), np.float32)
        self.pairs: dict[tuple[str, str], np.ndarray] = {}
        for k, m in enumerate(marks):
            for w in m:
                self.inside[number[w], k] += 1 / length(len(m))
            for x, y, d in pairs(m):
                self.pairs.setdefault((x, y), np.zeros(len(marks), np.float32))[k] += DECAY**d / length(len(m))

    def embed(self, some: list[Window]) -> np.ndarray:
        words = sorted({w for s in some for w in s})
        number = {w: k for k, w in enumerate(words)}
        each = self.kernel.of(words, self.inside)
        out = np.zeros((len(some), self.inside.shape[1]), np.float32)
        for k, s in enumerate(some):
            if s:
                out[k] = each[[number[w] for w in s]].sum(0)
            for x, y, d in pairs(s):
                if (x, y) in self.pairs:
                    out[k] += self.pairs[x, y] * DECAY**d
            out[k] /= length(len(s))
        return out


# --- machine -------------------------------------------------------------------------------------


def _svm(z: np.ndarray, y: np.ndarray, weight: np.ndarray, penalty: float = 1e-4, rounds: int = 30) -> np.ndarray:
    """Linear machine with squared hinge loss, by Newton steps; the last weight is the bias."""
    x = np.hstack([z, np.ones((len(z), 1))])
    ridge = penalty * np.eye(x.shape[1])
    ridge[-1, -1] = 1e-9
    w = np.zeros(x.shape[1])
    for k in range(rounds):
        on = y * (x @ w) < 1
        xs, s = x[on], weight[on]
        new = np.linalg.solve(ridge + (xs * s[:, None]).T @ xs, (xs * s[:, None]).T @ y[on])
        if np.abs(new - w).max() < 1e-9:
            break
        w = 0.5 * (w + new) if k > 10 else new
    return w


def spread_out(alphabet: Alphabet, pool: list[Window], n: int) -> list[Window]:
    """``n`` of the windows, each next one the least covered by those before."""
    k = SentenceKernel(alphabet, pool).embed(pool)
    own = np.sqrt(np.maximum(np.diag(k), 1e-9))
    k /= own[:, None] * own
    cover, out = np.zeros(len(pool)), []
    for _ in range(min(n, len(pool))):
        best = int(np.argmin(cover))
        out.append(pool[best])
        cover = np.maximum(cover, k[:, best])
        cover[best] = 2
    return out


class Model:
    """Weights of basis words and pairs, bias and the logistic curve."""

    def __init__(self, kernel: WordKernel, weights: np.ndarray, pair_weights: dict[tuple[str, str], float], bias: float):
        self.kernel, self.weights, self.bias = kernel, weights.astype(np.float32).reshape(-1, 1), bias
        self.slope, self.shift = 1.0, 0.0
        names = sorted({w for p in pair_weights for w in p})
        self.number = {w: k + 1 for k, w in enumerate(names)}
        self.pair = np.zeros((len(names) + 1, len(names) + 1), np.float32)
        for (x, y), v in pair_weights.items():
            self.pair[self.number[x], self.number[y]] = v
        self.lengths = np.array([length(n) for n in range(WINDOW + 1)])

    def words(self, words: list[str]) -> list[float]:
        return self.kernel.of(words, self.weights)[:, 0].tolist()

    def margins(self, flat: list[list[str]], value: dict[str, float]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(margins, starts, ends) of all windows of a text, in the order of its words."""
        words = [w for s in flat for w in s]
        numbers = np.array([self.number.get(w, 0) for w in words], np.int64)
        return self.rated(np.array([value[w] for w in words]), numbers, np.array([len(s) for s in flat], np.int64))[:3]

    def rated(self, values: np.ndarray, numbers: np.ndarray, lens: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(margins, starts, ends, windows a sentence) of sentences that lie one after the other: the value and the pair number of
        every word, and the words a sentence.  A window's margin depends on its own words only, so equal texts get equal ones."""
        starts, ends, many = all_spans(lens)
        total = values[starts]
        paired = np.flatnonzero(numbers)
        for d in range(1, WINDOW):
            inside = starts + d < ends
            total[inside] += values[starts[inside] + d]
        for d in range(1, REACH + 1):
            first = paired[: np.searchsorted(paired, len(numbers) - d)]
            follow = np.zeros(len(values))
            follow[first] = self.pair[numbers[first], numbers[first + d]] * DECAY**d
            for j in range(WINDOW - d):
                inside = starts + j + d < ends
                total[inside] += follow[starts[inside] + j]
        return total / self.lengths[ends - starts] + self.bias, starts, ends, many


class Known:
    """What a worker remembers of words as they are spelled, marks included: value, pair number, and whether it is one character."""

    def __init__(self, model: Model):
        self.model, self.place = model, {}
        self.value, self.number, self.single = np.zeros(1024), np.zeros(1024, np.int32), np.zeros(1024, bool)

    def of(self, words: list[str]) -> np.ndarray:
        """The place of every word in ``value``, ``number`` and ``single``."""
        distinct = list(dict.fromkeys(words))
        self._learn(sorted(w for w in distinct if w not in self.place))
        here = dict(zip(distinct, map(self.place.__getitem__, distinct)))  # a few words, looked up many times
        return np.fromiter(map(here.__getitem__, words), np.int64, len(words))

    def _learn(self, words: list[str]) -> None:
        new = sorted({w for w in map(bare, words) if w not in self.place})
        for low in range(0, len(new), 50_000):
            part = new[low : low + 50_000]
            self._add(part, self.model.words(part), [self.model.number.get(w, 0) for w in part])
        rest = [w for w in words if w not in self.place]
        same = [self.place[bare(w)] for w in rest]
        self._add(rest, self.value[same], self.number[same])

    def _add(self, words: list[str], values, numbers) -> None:
        low, high = len(self.place), len(self.place) + len(words)
        if high > len(self.value):
            self.value, self.number, self.single = (np.concatenate([x, np.zeros(high, x.dtype)]) for x in (self.value, self.number, self.single))
        self.value[low:high], self.number[low:high], self.single[low:high] = values, numbers, [len(w) == 1 for w in words]
        self.place.update(zip(words, range(low, high)))

    def best(self, texts: list[str]) -> tuple[np.ndarray, list[str]]:
        """(margins, windows): the highest window of every text; without words the margin of an empty window and no window."""
        parts = [_SENTENCE_END.split(t.lower()) for t in texts]
        split = [p.split() for some in parts for p in some]
        lens = np.fromiter(map(len, split), np.int64, len(split))
        words = list(chain.from_iterable(split))
        at = self.of(words)
        one = self.single[at]
        row = np.flatnonzero(one[2:] & one[1:-1] & one[:-2])  # three single characters one after the other
        ends = np.cumsum(lens)
        row = row[np.searchsorted(ends, row, "right") == np.searchsorted(ends, row + 2, "right")]
        if len(row):
            flat = list(chain.from_iterable(parts))
            for k in np.unique(np.searchsorted(ends, row, "right")).tolist():
                split[k] = joined(flat[k])
                lens[k] = len(split[k])
            words = list(chain.from_iterable(split))
            at = self.of(words)
        margins, out = np.full(len(texts), self.model.bias), [""] * len(texts)
        if words:
            text = np.repeat(np.arange(len(texts)), [len(p) for p in parts])[lens > 0]
            each, starts, ends, many = self.model.rated(self.value[at], self.number[at], lens[lens > 0])
            text = np.repeat(text, many)
            some, first = np.unique(text, return_index=True)
            margins[some] = np.maximum.reduceat(each, first)
            top = np.flatnonzero(each == margins[text])
            for k in top[np.unique(text[top], return_index=True)[1]].tolist():
                out[text[k]] = " ".join(map(bare, words[starts[k] : ends[k]]))
        return margins, out


def fit(alphabet: Alphabet, marks: list[Window], toxic: list[Window], clean: list[Window]) -> Model:
    kernel = SentenceKernel(alphabet, marks)
    values, vectors = np.linalg.eigh(kernel.embed(marks).astype(float))
    keep = values > 1e-6 * values.max()
    basis = vectors[:, keep] / np.sqrt(values[keep])
    z = np.concatenate([kernel.embed(part[low : low + 4000]) @ basis for part in (toxic, clean) for low in range(0, len(part), 4000)])
    y = np.concatenate([np.ones(len(toxic)), -np.ones(len(clean))])
    w = _svm(z, y, np.where(y > 0, 0.5 / len(toxic), 0.5 / len(clean)))
    alpha = basis @ w[:-1]
    weights = kernel.inside @ alpha
    kept = np.sort(np.argsort(-np.abs(weights), kind="stable")[:BASIS])
    return Model(WordKernel(alphabet, [kernel.kernel.words[k] for k in kept]), weights[kept], {p: float(v @ alpha) for p, v in kernel.pairs.items()}, float(w[-1]))


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the curve, with a little pull towards slope 1."""
    a, b = 1.0, 0.0
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        g = np.array([(p - y) @ x + 0.5 * (a - 1), (p - y).sum() + 0.01 * b])
        s = np.maximum(p * (1 - p), 1e-9)
        h = np.array([[s @ (x * x) + 0.5, s @ x], [s @ x, s.sum() + 0.01]])
        step = np.linalg.solve(h, g)
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-9:
            break
    return max(a, 1e-3), b


# --- training on Spark ---------------------------------------------------------------------------


def held_out(doc_id: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def labelled_texts(docs: DataFrame, labels: DataFrame, most: int = MAX_LABELLED) -> DataFrame:
    """(doc, text, toxic, seen) of at most ``most`` labelled documents that are not held out, chosen by hash of the id; a sixth of
    them is not ``seen`` by the machine."""
    known = labels.where("doc_id is not null and toxic is not null").where(~held_out()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)  # bounded, so it may be broadcast
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")
    once = rows.groupBy("doc_id", "toxic").agg(F.max("text").alias("text"))  # a repeated id is read once
    return once.select(F.col("doc_id").cast("string").alias("doc"), "text", F.col("toxic").cast("int").alias("toxic"), (F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(6)) > 0).alias("seen"))


def _hash(*parts: object) -> int:
    return xxhash.xxh64_intdigest("\0".join(map(str, parts))) >> 1


def _marks_of(text: str) -> set[int]:
    """Hashes of the words of a text and of the pairs of words that follow each other."""
    return {m for s in sentences(text) for m in _marks(s)}


def _marks(words: list[str] | Window) -> list[int]:
    return [*(_hash(w) for w in words), *(_hash(x, y) for x, y in zip(words, words[1:]))]


def _among(some: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which of ``some`` are in the sorted ``known``; the cost does not grow with its length."""
    if not len(known):
        return np.zeros(len(some), bool)
    return known[np.minimum(np.searchsorted(known, some), len(known) - 1)] == some


def first_choice(sample: DataFrame) -> DataFrame:
    """(doc, window, n): of each toxic document the window with the word or pair that is likeliest in toxic documents."""
    spark = sample.sparkSession

    def hashes(wanted):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known = None if wanted is None else wanted.value
            for batch in batches:
                for text in batch.column(0).to_pylist():
                    found = np.array(sorted(_marks_of(text)), np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(found if known is None else found[_among(found, known)])], names=["mark"])

        return run

    toxic = sample.where("toxic = 1").select("text").mapInArrow(hashes(None), "mark long").groupBy("mark").agg(F.count("*").alias("t")).where("t > 1")
    toxic = store(toxic, "toxic-marks").toPandas()  # marks of two documents or more; bounded by the labelled sample
    wanted = spark.sparkContext.broadcast(np.sort(toxic["mark"].to_numpy(np.int64)))
    clean = sample.where("toxic = 0").select("text").mapInArrow(hashes(wanted), "mark long").groupBy("mark").agg(F.count("*").alias("c")).toPandas()
    odds = toxic.merge(clean, "left", on="mark").fillna({"c": 0}).sort_values("mark")
    rate = np.log((odds["t"] + 0.5) / (odds["c"] + 0.5)).to_numpy()
    score = spark.sparkContext.broadcast((odds["mark"].to_numpy(np.int64)[rate > 0], rate[rate > 0].astype(np.float32)))

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rate = dict(zip(*(x.tolist() for x in score.value)))
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                best = max(windows(text), key=lambda s: max(rate.get(m, 0.0) for m in _marks(s)), default=None)
                if best:
                    rows.append((doc, " ".join(best)))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], names=["doc", "window"])

    return sample.where("toxic = 1").select("doc", "text").mapInArrow(choose, "doc string, window string")


def _remembered(name: str, model: Model) -> Known:
    """What is known of words under a model; that of other models, or beyond the bound, is forgotten."""
    if name not in _known or len(_known[name].place) > REMEMBERED:
        _known.clear()
        _known[name] = Known(model)
    return _known[name]


def best_windows(docs: DataFrame, sent: Broadcast, id_col: str) -> DataFrame:
    """(id, margin, window) of every row: the margin of the text's best window under the broadcast model, and the window."""
    source = docs.select(F.col(id_col).alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    id_type, name = source.schema["id"].dataType.simpleString(), uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 200):
                part = batch.slice(low, 200)
                margins, best = _remembered(name, sent.value).best(part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(margins, pa.float64()), pa.array(best, pa.string())], names=["id", "margin", "window"])

    return source.mapInArrow(run, f"id {id_type}, margin double, window string")


def _clean_windows(sample: DataFrame, n: int) -> list[Window]:
    """``n`` windows of clean documents, the least by hash: every task sends its own least, so nothing unbounded moves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least: dict[str, int] = {}
        for batch in batches:
            for text in batch.column(0).to_pylist():
                least.update((" ".join(s), _hash(*s)) for s in windows(text))
                if len(least) > 8 * n:
                    least = dict(sorted(least.items(), key=lambda x: x[1])[:n])
        rows = sorted(least.items(), key=lambda x: x[1])[:n]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in ((0, pa.string()), (1, pa.int64()))], names=["window", "place"])

    found = sample.where("toxic = 0").select("text").mapInArrow(run, "window string, place long").distinct().orderBy("place", "window").limit(n)
    return [tuple(r.window.split(" ")) for r in found.collect()]


def train(docs: DataFrame, labels: DataFrame) -> Model | float:
    """The fitted model, or the share of toxic labels if there is only one class (0 without labels)."""
    sample = store(labelled_texts(docs, labels), "labelled", compression="zstd")
    classes = {r.toxic: r["count"] for r in sample.groupBy("toxic").count().collect()}
    if len(classes) < 2:
        return float(max(classes, default=0))
    seen = sample.where("seen")
    chosen = [tuple(r.window.split(" ")) for r in first_choice(seen).orderBy("doc").collect()]
    clean = _clean_windows(seen, NEGATIVES)
    if not chosen or not clean:
        return classes.get(1, 0) / sum(classes.values())
    letters = Counter("".join(w for s in (*clean, *chosen) for w in s))
    alphabet = Alphabet("".join(sorted(letters, key=lambda c: (-letters[c], c))[:LETTERS]))
    hard: list[Window] = []

    def fitted() -> Model:
        toxic = sorted(set(chosen) - set(clean), key=lambda s: _hash(*s)) or sorted(set(chosen))
        marks = spread_out(alphabet, toxic[: 4 * LANDMARKS], LANDMARKS // 2)
        marks = list(dict.fromkeys(marks + hard[: LANDMARKS // 4] + clean))[: len(marks) + LANDMARKS // 2]
        return fit(alphabet, marks, toxic, list(dict.fromkeys(clean + hard)))

    def rated(rows: DataFrame, model: Model, id_col: str) -> DataFrame:
        sent = rows.sparkSession.sparkContext.broadcast(model)
        out = store(best_windows(rows, sent, id_col), "best")
        sent.destroy()
        return out

    def highest(rows: DataFrame, model: Model) -> tuple[list[Window], list[Window]]:
        """The best window of each toxic document, and the best ones of the clean documents."""
        best = rated(rows.withColumn("doc", F.concat("toxic", "doc")), model, "doc").where("window <> ''")
        toxic = best.where("id like '1%'").orderBy("id").collect()
        top = best.where("id like '0%'").groupBy("window").agg(F.max("margin").alias("margin")).orderBy(F.desc("margin"), "window").limit(NEGATIVES // 3).collect()
        return [tuple(r.window.split(" ")) for r in toxic], [tuple(r.window.split(" ")) for r in top]

    model = fitted()
    for _ in range(ROUNDS - 1):
        chosen, top = highest(seen, model)
        hard = list(dict.fromkeys(top + hard))[: NEGATIVES // 2]
        model = fitted()
    apart = rated(sample.where("not seen"), model, "toxic").select("id", "margin").toPandas()
    if apart["id"].nunique() < 2:  # too few to set some aside
        apart = rated(sample, model, "toxic").select("id", "margin").toPandas()
    model.slope, model.shift = _logistic(apart["margin"].to_numpy(float), apart["id"].to_numpy(float))
    return model


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document: (doc_id, held_out, score, predicted, margin, window); the window is the one that decides."""
    model = train(docs, labels)
    if isinstance(model, float):
        scored = docs.select("doc_id", F.lit(None).cast("double").alias("margin"), F.lit(model).alias("score"), F.lit(None).cast("string").alias("window"))
    else:
        scored = best_windows(docs, docs.sparkSession.sparkContext.broadcast(model), "doc_id").withColumnRenamed("id", "doc_id").withColumn("score", 1 / (1 + F.exp(-(F.col("margin") * model.slope + model.shift))))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "margin", "window")
