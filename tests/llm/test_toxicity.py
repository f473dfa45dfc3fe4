import random
import zlib

import numpy as np

from backline.llm import toxicity as T
from .frames import ODD, docs

LABELS = "doc_id long, quality int, toxic int"


def subsequences(word):
    """The kernel's terms of one word, literally."""
    w, out = "\0" + word + "\0", {}
    for i in range(len(w)):
        for j in range(i + 1, len(w)):
            for k in range(j + 1, len(w)):
                if k - i <= T.SPAN:
                    out[w[i] + w[j] + w[k]] = out.get(w[i] + w[j] + w[k], 0) + T.DECAY ** (k - i)
    return out


def word_kernel(a, b):
    sa, sb = subsequences(a), subsequences(b)
    size = lambda s: sum(v * v for v in s.values()) ** 0.5
    return (sum(v * sb.get(t, 0) for t, v in sa.items()) / max(size(sa) * size(sb), 1e-9)) ** T.POWER


def sentence_kernel(s, t):
    total = sum(word_kernel(a, b) for a in s for b in t)
    for x, y, d in T.pairs(s):
        total += sum(T.DECAY ** (d + e) for u, v, e in T.pairs(t) if (u, v) == (x, y))
    return total / T.length(len(s)) / T.length(len(t))


def test_kernel_equals_its_definition():
    alphabet = T.Alphabet("abcdefghijklmnopqrstuvwxyz*")
    some = [("you", "idiot"), ("you", "id*iot", "you"), ("a",), ("moron", "banana", "you", "idiot"), ("banana",)]
    k = T.SentenceKernel(alphabet, some).embed(some)
    for i, s in enumerate(some):
        for j, t in enumerate(some):
            assert abs(k[i, j] - sentence_kernel(s, t)) < 1e-4, (s, t)
    assert word_kernel("idiot", "id*iot") > 20 * word_kernel("idiot", "banana")


def test_sentences_and_windows():
    assert T.sentences("You are. z w o r f t here!\nv3.5 (ok)") == [["you", "are"], ["zworft", "here"], ["v3.5", "ok"]]
    assert T.windows("a1 b1 c1 d1 e1 f1 g1") == [("a1", "b1", "c1", "d1"), ("c1", "d1", "e1", "f1"), ("e1", "f1", "g1")]
    assert T.sentences(" .. \n ") == [[".."]] or T.sentences(" .. \n ") == []


def test_margins_equal_the_kernel_sum():
    """A document's margins are the fitted function of its windows, landmark by landmark."""
    rnd = random.Random(4)
    words = ["".join(rnd.choice("abcdeimnort") for _ in range(rnd.randrange(2, 8))) for _ in range(40)]
    window = lambda: tuple(rnd.choice(words) for _ in range(rnd.randrange(1, 5)))
    marks, toxic, clean = ([window() for _ in range(n)] for n in (12, 30, 60))
    marks, toxic, clean = list(dict.fromkeys(marks)), sorted(set(toxic)), sorted(set(clean) - set(toxic))
    model = T.fit(T.Alphabet("abcdeimnort"), marks, toxic, clean)
    text = " ".join(rnd.choice(words) for _ in range(9)) + ". " + " ".join(rnd.choice(words) for _ in range(3))
    flat = T.sentences(text)
    each, starts, ends = model.margins(flat, dict(zip(words, model.words(words))))
    flat_words = [w for s in flat for w in s]
    for m, a, b in zip(each, starts, ends):
        s = tuple(flat_words[a:b])
        own = sum(float(model.weights[k, 0]) * word_kernel(w, v) for w in s for k, v in enumerate(model.kernel.words))
        own += sum(float(model.pair[model.number.get(x, 0), model.number.get(y, 0)]) * T.DECAY**d for x, y, d in T.pairs(s))
        assert abs(m - own / T.length(len(s)) - model.bias) < 1e-3 * max(1, abs(m))


def test_many_texts_at_once_equal_each_text_alone():
    """The best windows of a batch are those of the texts one by one; places, neighbours and what is remembered change nothing."""
    rnd = random.Random(5)
    words = ["".join(rnd.choice("abcdeimnort") for _ in range(rnd.randrange(1, 7))) for _ in range(40)]
    window = lambda: tuple(rnd.choice(words) for _ in range(rnd.randrange(1, 5)))
    toxic, clean = sorted({window() for _ in range(30)}), sorted({window() for _ in range(60)})
    model = T.fit(T.Alphabet("abcdeimnort"), list(dict.fromkeys(toxic[:8] + clean[:8])), toxic, sorted(set(clean) - set(toxic)))
    some = [" ".join(rnd.choice(words) + rnd.choice(["", "", ",", ".", "\n", " m o r o n"]) for _ in range(rnd.randrange(0, 30))) for _ in range(300)]
    texts = ["", "m o r", "m o. r o n", "...", " \n", "M o r o n!", *some, *some]
    known = T.Known(model)
    for _ in range(2):
        margins, windows = known.best(texts)
        for t, m, w in zip(texts, margins.tolist(), windows):
            flat = T.sentences(t)
            if not flat:
                assert (m, w) == (model.bias, ""), t
                continue
            own = [x for s in flat for x in s]
            each, starts, ends = model.margins(flat, dict(zip(own, model.words(own))))
            assert abs(m - each.max()) < 1e-5 and any(w == " ".join(own[starts[k] : ends[k]]) for k in np.flatnonzero(each > each.max() - 1e-5)), t
        assert margins[6:306].tolist() == margins[306:].tolist()
    assert all(T.all_spans(np.array([n]))[0].tolist() == [a for a, _ in T.spans(n)] and T.all_spans(np.array([n]))[1].tolist() == [b for _, b in T.spans(n)] for n in range(1, 40))


def corpus(seed=1, n=900):
    rnd = random.Random(seed)
    syllables = ["ta", "ro", "mi", "ne", "lu", "ka", "so", "ve", "di", "pa"]
    word = lambda: "".join(rnd.choice(syllables) for _ in range(rnd.randrange(1, 4)))
    rows, labels = [], []
    for d in range(n):
        toxic = d % 6 == 0
        w = [word() for _ in range(rnd.randrange(20, 120))]
        for _ in range(3 if toxic else 0):
            w.insert(rnd.randrange(len(w)), rnd.choice(["gribbix", "zworft", "blughen"]))
        rows.append((d, ". ".join(" ".join(w[i : i + 9]) for i in range(0, len(w), 9))))
        labels.append((d, 1, int(toxic)))
    return rows, labels


def test_held_out_documents_and_disguised_insults(spark):
    rows, labels = corpus()
    rows += [(5000, "taro mine gri-bbix luka"), (5001, "sove z w o r f t dipa"), (5002, "taro mine luka")]
    got = {r.doc_id: r for r in T.toxicity(docs(spark, rows, extra=("score", "toxic")), spark.createDataFrame(labels, LABELS)).collect()}
    truth = {d: t for d, _, t in labels}
    out = [d for d in truth if zlib.crc32(str(d).encode()) % 5 == 0]
    assert all(got[d].held_out for d in out) and sum(r.held_out for r in got.values()) >= len(out)
    assert np.mean([got[d].predicted == truth[d] for d in out]) > 0.98
    assert got[5000].score > got[5002].score and got[5001].predicted == 1 and got[5002].predicted == 0
    assert all(0 <= r.score <= 1 and (r.score >= 0.5) == r.predicted for r in got.values())


def test_phrase_of_common_words(spark):
    """Three common words one after the other are toxic, each of them alone is not."""
    rnd = random.Random(7)
    rows, labels = corpus(2)
    words = sorted({w.strip(".") for _, t in rows for w in t.split()} - {"gribbix", "zworft", "blughen"})
    phrase, rows2 = rnd.sample([w for w in words if len(w) <= 4], 3), []
    for d, text in rows:
        parts = [[w for w in s.split() if w in words] for s in text.split(". ")]
        for p in parts:
            if rnd.random() < 0.5:
                p.insert(rnd.randrange(len(p) + 1), rnd.choice(phrase))
        if d % 6 == 0:
            for _ in range(2):
                p = rnd.choice(parts)
                at = rnd.randrange(len(p) + 1)
                p[at:at] = phrase
        rows2.append((d, ". ".join(" ".join(p) for p in parts)))
    got = {r.doc_id: r for r in T.toxicity(docs(spark, rows2), spark.createDataFrame(labels, LABELS)).collect()}
    out = [(got[d].predicted, t) for d, _, t in labels if got[d].held_out]
    toxic, found = sum(t for _, t in out), sum(p for p, _ in out)
    both = sum(p and t for p, t in out)
    assert toxic > 20 and both >= 0.9 * toxic and both >= 0.9 * found
    assert sum(set(phrase) <= set(r.window.split()) for r in got.values() if r.predicted) > 0.8 * sum(r.predicted for r in got.values())


def test_few_labels_and_repeated_ids(spark):
    rows, labels = corpus(3, n=60)
    some = labels[:14]
    got = T.toxicity(docs(spark, rows + [rows[0]] * 300), spark.createDataFrame(some, LABELS)).collect()
    assert len(got) == 360 and all(0 <= r.score <= 1 for r in got)
    assert len({r.score for r in got if r.doc_id == 0}) == 1


def test_odd_rows_and_single_classes(spark):
    rows, labels = corpus(n=300)
    got = T.toxicity(docs(spark, rows + ODD), spark.createDataFrame(labels + [(None, 1, 1), (8, None, None), (9, 1, 1)], LABELS))
    assert got.count() == 300 + len(ODD)
    for given, share in ([], 0.0), ([(1, 1, 0)], 0.0), ([(1, 1, 1)], 1.0):
        scores = {r.score for r in T.toxicity(docs(spark, rows[:5]), spark.createDataFrame(given, LABELS)).collect()}
        assert scores == {share}
    assert T.toxicity(docs(spark, []), spark.createDataFrame(labels, LABELS)).count() == 0
