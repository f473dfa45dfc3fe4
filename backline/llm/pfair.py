"""Mixing sources to target weights by proportionate fair (Pfair) scheduling.

A source's documents, in a fixed shuffled order, are cut into blocks of ``block_bytes``.  With weight w (the weights of
the sources that still have blocks add up to one), block k = 0, 1, ... of a source is released at slot floor(k / w) and due by slot
ceil((k + 1) / w); in each slot the released block with the earliest deadline goes out.  At every slot each
source has then received less than one block more or less than its weight times the slots since its weight last changed.
The targets hold for the part of the output before the first source runs out.  After that the scarce source is missing,
the others are above their targets, and the last source left stands alone; README gives measured shares.

Weights are multiples of 1 / ``resolution``, so the schedule repeats: only one period of at most ``resolution`` slots is worked out per
*phase*, and a block's slot follows from its number by arithmetic.  A phase of whole periods ends before the period in which a
source runs out; a last, cut period takes that source to its end, then the others share its weight and start anew.
The resolution is raised to ``SOURCE_SHARES`` shares a source when there are many sources.  There are at most two phases per
source, so the tables sent to the tasks depend on the number of sources only.

Every document is kept, once.  Block numbers come from byte counts per (source, hash range), summed up over the
ranges, and from running sums inside a range, so no task ever holds a whole source.

Defined cases: a null source is a source of its own ('' and null differ); a null or empty text counts ``ROW_BYTES``;
repeated rows each take their place; a document longer than a block fills the blocks it spans and stands in the
first; an empty table gives an empty result; extra columns are kept.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator
from fractions import Fraction

from pyspark.sql import Column, DataFrame, Window, functions as F

from backline.session import cut_lineage

BLOCK_BYTES = 64 << 10
RESOLUTION, SOURCE_SHARES = 1000, 4
ROW_BYTES = 8
RANGE_BYTES = 64 << 20


def windows(share: int, period: int) -> list[tuple[int, int]]:
    """(release, deadline) of the ``share`` blocks of a source with weight share / period, over one period."""
    return [(k * period // share, -(-(k + 1) * period // share)) for k in range(share)]


def one_period(shares: dict[str, int]) -> list[str]:
    """Source of each slot of a period of sum(shares) slots: earliest deadline first among the released blocks."""
    return list(_slots(shares))


def _slots(shares: dict[str, int]) -> Iterator[str]:
    period = sum(shares.values())
    coming, ready = [(0, s, 0) for s, n in shares.items() if n], []
    heapq.heapify(coming)
    for t in range(period):
        while coming and coming[0][0] <= t:
            _, s, k = heapq.heappop(coming)
            heapq.heappush(ready, (-(-(k + 1) * period // shares[s]), s))
            if k + 1 < shares[s]:
                heapq.heappush(coming, ((k + 1) * period // shares[s], s, k + 1))
        deadline, source = heapq.heappop(ready)
        if deadline <= t:
            raise AssertionError("a block missed its deadline")
        yield source


def whole_shares(weights: dict[str, float], resolution: int) -> dict[str, int]:
    """Weights as whole shares of ``resolution`` (largest remainders); a source below one share gets one."""
    if len(weights) > resolution:
        raise ValueError("more sources than shares; raise the resolution")
    large = {s: Fraction(w) for s, w in weights.items()}
    while True:
        rest, total = resolution - len(weights) + len(large), sum(large.values())
        kept = {s: w for s, w in large.items() if w * rest >= total}
        if len(kept) == len(large):
            break
        large = kept
    exact = {s: w / total * rest for s, w in large.items()}
    shares = {s: int(exact.get(s, 1)) for s in weights}
    left = resolution - sum(shares.values())
    for s in sorted(exact, key=lambda s: (int(exact[s]) - exact[s], s))[:left]:
        shares[s] += 1
    return shares


def phases(blocks: dict[str, int], shares: dict[str, int]) -> list[dict]:
    """Phases that place every block of every source.

    Each is {'first_slot', 'shares', 'slots' (one period, or the part up to the last block of a source that runs out), 'periods',
    'first_block', 'blocks' (of each source in the phase)}.
    """
    done, slot, out = dict.fromkeys(blocks, 0), 0, []
    while active := [s for s in blocks if done[s] < blocks[s]]:
        part = {s: shares[s] for s in active}
        periods = min((blocks[s] - done[s]) // part[s] for s in active)
        if periods:
            slots, seen = one_period(part), part
        else:
            periods, slots, seen = 1, [], dict.fromkeys(active, 0)
            for s in _slots(part):
                slots.append(s)
                seen[s] += 1
                if done[s] + seen[s] == blocks[s]:
                    break
        count = {s: periods * seen[s] for s in active}
        out.append({"first_slot": slot, "shares": part, "slots": slots, "periods": periods, "first_block": {s: done[s] for s in active}, "blocks": count})
        slot += periods * len(slots)
        for s in active:
            done[s] += count[s]
    return out


def _inline(df: DataFrame, rows: list[dict], schema: str) -> DataFrame:
    text = json.dumps(rows)
    return df.sparkSession.range(1).select(F.inline(F.from_json(F.lit(text), f"array<struct<{schema}>>")))


def text_bytes() -> Column:
    return (F.coalesce(F.octet_length("text"), F.lit(0)) + ROW_BYTES).cast("long")


def mix(
    docs: DataFrame,
    weights: dict[str | None, float] | None = None,
    exponent: float = 0.5,
    block_bytes: int = BLOCK_BYTES,
    resolution: int = RESOLUTION,
    range_bytes: int = RANGE_BYTES,
) -> DataFrame:
    """``docs`` with block, release, deadline, slot and place (start within the block's bytes).

    ``weights`` gives the target weight of every source.  Left out, a source's weight is its bytes to the power
    ``exponent``, which lifts small sources above their natural share.  Order the rows by (slot, place) to get the mixture.
    """
    name = F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit(""))  # null apart from ''
    order = F.xxhash64("doc_id", "text")
    marked = docs.withColumns({"__source": name, "__order": order, "__size": text_bytes()})
    totals = {r["__source"]: r.bytes for r in marked.groupBy("__source").agg(F.sum("__size").alias("bytes")).collect()}
    if not totals:
        nothing = F.lit(0).cast("long")
        return docs.withColumns({c: nothing for c in ("block", "release", "deadline", "slot", "place")}).limit(0)
    blocks = {s: -(-b // block_bytes) for s, b in totals.items()}
    if weights is None:
        chosen = {s: b**exponent for s, b in totals.items()}
    else:
        given = {"" if s is None else f"={s}": w for s, w in weights.items()}
        if missing := sorted(set(totals) - set(given)):
            raise ValueError(f"no weight for sources {missing}")
        chosen = {s: given[s] for s in totals}
    shares = whole_shares(chosen, max(resolution, SOURCE_SHARES * len(chosen)))
    plan = phases(blocks, shares)

    # start of each document in its source: bytes of the earlier hash ranges, then a running sum in the range
    bits = max(6, min(20, (max(totals.values()) // range_bytes).bit_length()))
    marked = marked.withColumn("__range", F.shiftrightunsigned(F.col("__order"), 64 - bits))
    sums = cut_lineage(marked.groupBy("__source", "__range").agg(F.sum("__size").alias("bytes")))
    earlier = Window.partitionBy("__source").orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    # at most 2^20 ranges a source, one short row each
    starts = sums.select("__source", "__range", F.coalesce(F.sum("bytes").over(earlier), F.lit(0)).alias("__base"))
    inside = Window.partitionBy("__source", "__range").orderBy("__order", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    placed = marked.withColumn("__inner", F.coalesce(F.sum("__size").over(inside), F.lit(0))).join(starts, ["__source", "__range"])
    start = F.col("__base") + F.col("__inner")
    placed = placed.withColumns({"block": F.floor(start / block_bytes), "place": start % block_bytes})

    rows = []
    for k, p in enumerate(plan):
        period, at = sum(p["shares"].values()), {s: [] for s, n in p["blocks"].items() if n}
        for t, s in enumerate(p["slots"]):
            at[s].append(t)
        for s, own in at.items():
            first = p["first_block"][s]
            rows.append({"__source": s, "__first": first, "__last": first + p["blocks"][s] - 1, "__share": p["shares"][s], "__period": period, "__slot0": p["first_slot"], "__slots": own})
    parts = _inline(docs, rows, "__source:string,__first:bigint,__last:bigint,__share:bigint,__period:bigint,__slot0:bigint,__slots:array<bigint>")
    in_phase = placed.join(F.broadcast(parts), "__source").where(F.col("block").between(F.col("__first"), F.col("__last")))
    done = F.col("block") - F.col("__first")
    in_phase = in_phase.withColumns({"__nth": done % F.col("__share"), "__turn": F.floor(done / F.col("__share"))})
    at = F.col("__slot0") + F.col("__turn") * F.col("__period")
    out = in_phase.withColumns(
        {
            "slot": at + F.get("__slots", F.col("__nth").cast("int")),
            "release": at + F.floor(F.col("__nth") * F.col("__period") / F.col("__share")),
            "deadline": at + F.ceil((F.col("__nth") + 1) * F.col("__period") / F.col("__share")),
        }
    )
    return out.select(*docs.columns, "block", "release", "deadline", "slot", "place")


def in_order(mixed: DataFrame, columns: list[str]) -> DataFrame:
    """The mixture's rows in its order: written as files, file by file and row by row."""
    by = ["slot", "place", "doc_id"]
    return mixed.repartitionByRange(*by).sortWithinPartitions(*by).select(columns)
