import random
from collections import Counter, defaultdict
from fractions import Fraction

import pytest

from backline.llm import pfair as P
from .frames import ODD, docs


@pytest.mark.parametrize("seed", range(6))
def test_every_source_stays_within_one_block_of_its_weight(seed):
    rnd = random.Random(seed)
    weights = {f"s{k}": rnd.random() ** 3 + 0.001 for k in range(rnd.randrange(1, 12))}
    shares = P.whole_shares(weights, 200)
    assert sum(shares.values()) == 200 and min(shares.values()) >= 1
    blocks = {s: rnd.randrange(1, 400) for s in weights}
    sent, t = Counter(), 0
    for p in P.phases(blocks, shares):
        period = sum(p["shares"].values())
        assert p["first_slot"] == t
        at = Counter()
        assert p["periods"] == 1 or len(p["slots"]) == period
        for k in range(p["periods"] * len(p["slots"])):
            at[p["slots"][k % period]] += 1
            for s, n in p["shares"].items():
                assert abs(at[s] - Fraction(n * (k + 1), period)) < 1
        sent.update(at)
        assert at == Counter(p["blocks"])
        t += p["periods"] * len(p["slots"])
    assert sent == Counter(blocks)


def test_schedule_of_documents(spark):
    rnd = random.Random(9)
    rows = [(k, "x" * rnd.randrange(400), rnd.choice(["hot"] * 6 + ["a", "b", None, ""])) for k in range(3000)]
    got = P.mix(docs(spark, rows, extra=("block", "bytes")).drop("block"), block_bytes=2000, range_bytes=20_000).collect()
    assert sorted(r.doc_id for r in got) == list(range(3000))
    slots = defaultdict(set)
    for r in got:
        slots[r.slot].add((r.source, r.block))
        assert r.release <= r.slot < r.deadline
    assert all(len(x) == 1 for x in slots.values())  # a slot has one block
    per = defaultdict(list)
    for r in got:
        per[r.source].append(r)
    for part in per.values():
        part.sort(key=lambda r: (r.slot, r.place))
        at = 0
        for r in part:  # documents follow each other without a gap
            assert r.block * 2000 + r.place == at
            at += len(r.text) + 8
    # while all sources last, shares follow the weights
    total = {s: sum(len(r.text) + 8 for r in p) for s, p in per.items()}
    shares = P.whole_shares({str(s): b**0.5 for s, b in total.items()}, 1000)
    first = min(max(r.slot for r in p) for p in per.values())
    for s, p in per.items():
        blocks = len({r.block for r in p if r.slot < first})
        assert abs(blocks - first * shares[str(s)] / 1000) <= 2


def test_given_weights_order_and_odd_rows(spark):
    frame = docs(spark, [(*r, None) for r in ODD] + [(9, "z", "t")])
    got = P.mix(frame, weights={None: 3, "t": 1, "unused": 5})
    assert got.count() == len(ODD) + 1
    assert P.in_order(got, frame.columns).columns == frame.columns
    with pytest.raises(ValueError):
        P.mix(frame, weights={"t": 1})
    assert P.mix(docs(spark, [])).count() == 0


@pytest.mark.parametrize("n", [20, 200, 500, 900])
def test_shares_keep_the_targets_with_many_sources(n):
    weights = {"hot": (n - 1) / 2} | {f"s{k}": 1 for k in range(n - 1)}
    resolution = max(P.RESOLUTION, P.SOURCE_SHARES * n)
    shares = P.whole_shares(weights, resolution)
    assert sum(shares.values()) == resolution
    assert all(abs(shares[s] - Fraction(w) / sum(map(Fraction, weights.values())) * resolution) < 1 for s, w in weights.items())


@pytest.mark.parametrize("n", [500, 1500])
def test_documents_of_many_sources(spark, n):
    rows = [(k, "x" * 92, f"s{k}") for k in range(n - 1)] + [(n + k, "y" * 92, "hot") for k in range(n // 2)]
    got = P.mix(docs(spark, rows), weights={"hot": (n - 1) / 2} | {f"s{k}": 1 for k in range(n - 1)}, block_bytes=100).collect()
    assert sorted(r.doc_id for r in got) == sorted(r[0] for r in rows)
    assert sorted(r.slot for r in got) == list(range(len(rows)))
    assert all(r.release <= r.slot < r.deadline for r in got)
