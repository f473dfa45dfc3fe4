"""Sharding by histogram sort: count exact bytes below key boundaries, refine, exchange once.

Every row has a sort key (a number below 2^62) and a size.  One pass over the slim (key, size) table counts
the bytes in equal ranges of the key space, which gives the exact bytes below each boundary.  A shard's
splitter settles on a boundary within ``tolerance`` of its target; ranges that hold an unsettled splitter,
or more bytes than one task should sort, are divided into finer ranges and counted again.  The final ranges
never straddle a splitter, so a row's range gives its shard and the first slot of its range, and the whole
rows cross the network once, by range.

The default key puts equal texts side by side: the high bits hash the text, the low bits the id.  A group of
copies is therefore cut only if it is heavier than the tolerance allows.

Rows that share a key heavier than the tolerance are divided below it: their distinct rows are counted, and the copies of each are
numbered by arithmetic, so that a million repeats of a row are one row and a count until they are dealt out evenly
over the shards the key covers; no task, list or window holds them together.

Defined cases: a null text has 0 bytes, null keys sort first, identical rows are exchangeable and dealt out like others, an
empty table gives an empty table, extra columns are kept (in heavy keys they must be of types that can be grouped).
Only DataFrame functions are used; the driver sees at most a few counts per range (bounded by ``max_ranges``).
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window, functions as F

from backline.session import cut_lineage

ROW_BYTES = 8
_TEXT_BITS, _ID_BITS = 28, 18
# Bits that divide a heavy key, and copies of one row that a task deals out at a time.
_COPY_BITS, _COPY_BLOCK = 16, 1 << 16


def text_key(id_col: str = "doc_id", text_col: str = "text") -> Column:
    """Key of 46 bits: 28 from the text's hash, 18 from the id's."""
    return F.shiftleft(F.shiftrightunsigned(F.xxhash64(text_col), 64 - _TEXT_BITS), _ID_BITS).bitwiseOR(F.shiftrightunsigned(F.xxhash64(id_col), 64 - _ID_BITS))


def text_size(text_col: str = "text") -> Column:
    return (F.coalesce(F.octet_length(text_col), F.lit(0)) + ROW_BYTES).cast("long")


def _counts(rows: DataFrame, shift: int, inside: list[tuple[int, int]] | None) -> list[tuple[int, int, int]]:
    """(range number at ``shift``, bytes, rows) for the keys within the open ranges (shift, number)."""
    if inside is not None:
        above = inside[0][0]
        rows = rows.where(F.shiftright("key", above).isin([b for _, b in inside]))
    got = rows.groupBy(F.shiftright("key", shift).alias("b")).agg(F.sum("size").alias("bytes"), F.count("*").alias("n")).collect()
    return sorted((r.b, r.bytes, r.n) for r in got)


def find_ranges(rows: DataFrame, shards: int, tolerance: float, range_bytes: int, max_ranges: int = 1 << 16) -> dict | None:
    """Splitters and final ranges of the stored (key, size) table; None if it is empty.

    Returns {'origin', 'levels': [{'shift', 'open': [...]}], 'ranges': [(level, number, shard, base)], 'bytes': per shard,
    'heavy': the single keys, of several rows, that are heavier than the tolerance or than a range may be}.
    """
    low, high, total = rows.agg(F.min("key"), F.max("key"), F.sum("size")).first()
    if low is None:
        return None
    rows = rows.select((F.col("key") - low).alias("key"), "size")
    heavy = max(range_bytes, total // max_ranges)
    slack = tolerance * total / shards
    targets = {j: total * j / shards for j in range(1, shards)}
    span = max(1, (high - low).bit_length())
    shift = max(0, span - min(16, max(10, (total // heavy).bit_length())))
    splitters: dict[int, int] = {}
    levels, leaves = [], []
    open_ranges, start_of = None, {None: 0}
    while True:
        counted = _counts(rows, shift, open_ranges)
        opened, below = [], {}
        running, parent = 0, None
        for b, size, n in counted:
            up = None if open_ranges is None else b >> (open_ranges[0][0] - shift)
            if up != parent or not below:
                running, parent = start_of[up], up
            below[b] = running
            first, last = running, running + size
            running = last
            split = False
            for j, goal in targets.items():
                if j in splitters or not first - slack <= goal <= last + slack:
                    continue
                near = min((first, b << shift), (last, (b + 1) << shift), key=lambda e: abs(e[0] - goal))
                if abs(near[0] - goal) <= slack or (shift == 0 and first <= goal <= last):
                    splitters[j] = near[1]
                elif first <= goal <= last:
                    split = True
            if shift > 0 and (split or size > heavy):
                opened.append((shift, b))
            else:
                leaves.append((len(levels), b, shift, n, size))
        levels.append({"shift": shift, "open": [b for _, b in opened]})
        if not opened:
            break
        start_of = {b: below[b] for _, b in opened}
        open_ranges = opened
        shift = max(0, shift - (10 if len(opened) <= 64 else 4))
    for j in range(1, shards):
        splitters.setdefault(j, (high - low) + 1)
    edges = sorted(splitters.values())
    ranges, rows_in, bytes_in, single = [], [0] * shards, [0] * shards, []
    for level, b, s, n, size in sorted(leaves, key=lambda x: x[1] << x[2]):
        shard = sum(e <= b << s for e in edges)
        ranges.append((level, b, shard, rows_in[shard]))
        rows_in[shard] += n
        bytes_in[shard] += size
        if s == 0 and n > 1 and size > min(slack, heavy):
            single.append(low + b)
    return {"origin": low, "levels": levels, "ranges": ranges, "bytes": bytes_in, "heavy": single}


def _divided(docs: DataFrame, key: Column, found: dict) -> DataFrame:
    """``docs`` with __key, ``key`` with more low bits: 0, but for the rows of heavy keys, which are dealt evenly over them.

    A heavy key weighs more than a shard's tolerance, so there are at most shards / tolerance of them.
    """
    heavy = F.broadcast(docs.sparkSession.createDataFrame([(k,) for k in found["heavy"]], "key long"))
    keyed = docs.select(F.struct(*docs.columns).alias("row"), key.alias("key"))
    light = keyed.join(heavy, "key", "left_anti").select("row", F.shiftleft("key", _COPY_BITS).alias("key"))
    rows = cut_lineage(keyed.join(heavy, "key", "left_semi").groupBy("key", "row").agg(F.count(F.lit(1)).alias("n")))
    # copies in blocks, the blocks over tasks
    blocks = rows.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), (F.col("n") - 1).cast("long"), F.lit(_COPY_BLOCK).cast("long"))))
    copies = blocks.repartition(F.xxhash64("row", "block")).withColumn("copy", F.explode(F.sequence("block", F.least(F.col("block") + _COPY_BLOCK, "n") - 1)))
    # evenly, from a place that the row's hash decides
    low = F.pmod(F.xxhash64("row") + F.floor(F.col("copy") * F.lit(1 << _COPY_BITS) / F.col("n")), F.lit(1 << _COPY_BITS))
    dealt = copies.select("row", F.shiftleft("key", _COPY_BITS).bitwiseOR(low).alias("key"))
    return light.unionByName(dealt).select("row.*", F.col("key").alias("__key"))


def histogram_shards(
    docs: DataFrame,
    shards: int = 24,
    key: Column | None = None,
    size: Column | None = None,
    ties: tuple[str, ...] = ("doc_id", "text"),
    tolerance: float = 0.001,
    range_bytes: int = 64 << 20,
) -> DataFrame:
    """``docs`` with ``shard`` (0 to shards - 1, equal bytes within ``tolerance``) and ``slot`` (0, 1, ... in key order within the shard)."""
    key = F.coalesce(key if key is not None else text_key(), F.lit(0).cast("long"))
    size = size if size is not None else text_size()
    slim = cut_lineage(docs.select(key.alias("key"), size.alias("size")))
    found = find_ranges(slim, shards, tolerance, range_bytes)
    if found is None:
        return docs.withColumns({"shard": F.lit(0), "slot": F.lit(0).cast("long")}).limit(0)
    keyed = docs.withColumn("__key", key)
    if found["heavy"]:
        keyed = _divided(docs, key - F.lit(found["origin"]), found | {"heavy": [k - found["origin"] for k in found["heavy"]]})
        found = find_ranges(cut_lineage(keyed.select(F.col("__key").alias("key"), size.alias("size"))), shards, tolerance, range_bytes)
    offset = F.col("__key") - F.lit(found["origin"])
    level, number = None, None
    for k, at in reversed(list(enumerate(found["levels"]))):
        b = F.shiftright(offset, at["shift"])
        here = (F.lit(k), b)
        if level is None:
            level, number = here
        else:
            deeper = b.isin(at["open"])
            level, number = F.when(deeper, level).otherwise(here[0]), F.when(deeper, number).otherwise(here[1])
    text = json.dumps([{"__level": a, "__number": b, "shard": s, "__base": n} for a, b, s, n in found["ranges"]])
    table = docs.sparkSession.range(1).select(F.inline(F.from_json(F.lit(text), "array<struct<__level:int,__number:bigint,shard:int,__base:bigint>>")))
    placed = keyed.withColumns({"__level": level, "__number": number}).join(F.broadcast(table), ["__level", "__number"])
    within = Window.partitionBy("__level", "__number", "shard", "__base").orderBy("__key", *[F.xxhash64(c) if c == "text" else F.col(c) for c in ties])
    return placed.withColumn("slot", F.col("__base") + F.row_number().over(within) - 1).select(*docs.columns, "shard", "slot")
