"""Newest rows and rows laid over each other, by key."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

Merge = Callable[[Column, Column], Column]


def latest_by_key(df: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Newest row per key by a struct maximum, which combines before the shuffle."""
    rest = [c for c in df.columns if c not in key]
    picked = df.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("r"))
    return picked.select(*key, "r.*").select(*df.columns)


def upsert(base: DataFrame, delta: DataFrame, key: Sequence[str], merge: Mapping[str, Merge] | None = None) -> DataFrame:
    """``base`` with ``delta`` (one row per key) laid over it.

    Columns of ``delta`` replace those of ``base``; ``merge[c](new, old)`` decides otherwise, and may
    look at the whole rows as the structs ``n`` and ``o``.  Nulls in a key are equal to each other, so running
    it twice with the same delta changes nothing.
    """
    old, new = _halves(base, delta, key)
    old, new = old.alias("old"), new.alias("new")
    same = reduce(Column.__and__, [F.col(f"old.{k}").eqNullSafe(F.col(f"new.{k}")) for k in key])
    joined = old.join(new, same, "full_outer").select(*[F.coalesce(F.col(f"old.{k}"), F.col(f"new.{k}")).alias(k) for k in key], "o", "n")
    return _laid_over(joined, base, delta, key, merge)


def upsert_placed(base: DataFrame, delta: DataFrame, key: Sequence[str], place: Mapping[str, Column], merge: Mapping[str, Merge] | None = None) -> DataFrame:
    """``upsert`` whose rows lie by the columns ``place``, functions of the key, which are added: rows move once for both.

    Old and new rows are brought together by a grouping instead of a join, because a grouping keeps a partitioning by some
    of its columns.
    """
    old, new = _halves(base, delta, key)
    rows = old.unionByName(new, allowMissingColumns=True).withColumns(dict(place)).repartition(*place)
    # a number in front of the key makes the sort below the grouping one of numbers
    both = rows.groupBy(F.xxhash64(*key).alias("__hash"), *place, *key).agg(F.first("o", ignorenulls=True).alias("o"), F.first("n", ignorenulls=True).alias("n"))
    return _laid_over(both, base, delta, key, merge, place)


def _halves(base: DataFrame, delta: DataFrame, key: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """The rows of both as key and one struct, ``o`` and ``n``."""
    cols = [c for c in base.columns if c not in key]
    return base.select(*key, F.struct(*cols).alias("o")), delta.select(*key, F.struct(*[c for c in cols if c in delta.columns]).alias("n"))


def _laid_over(both: DataFrame, base: DataFrame, delta: DataFrame, key: Sequence[str], merge: Mapping[str, Merge] | None, more: Iterable[str] = ()) -> DataFrame:
    merge = merge or {}

    def pick(c: str) -> Column:
        o = F.col(f"o.{c}")
        if c not in delta.columns:
            return o.alias(c)
        n = F.col(f"n.{c}")
        value = merge[c](n, o) if c in merge else n
        return F.when(F.col("n").isNull(), o).otherwise(value).alias(c)

    return both.select(*[F.col(k) if k in key else pick(k) for k in base.columns], *more)


class KeepNewest(Mapping):
    """Merge rule for ``upsert``: all columns of the row whose ``order`` columns are greater; an equal row is replaced."""

    def __init__(self, *order: str):
        self.order = order

    def __contains__(self, column: object) -> bool:
        return True

    def __iter__(self):
        return iter(self.order)

    def __len__(self) -> int:
        return len(self.order)

    def __getitem__(self, column: str) -> Merge:
        new, old = (F.struct(*[F.col(f"{row}.{c}") for c in self.order]) for row in ("n", "o"))
        return lambda n, o: F.when(F.col("o").isNull() | (new >= old), n).otherwise(o)


def keep_newest(*order: str) -> KeepNewest:
    return KeepNewest(*order)
