"""Small fixed dictionaries as expressions: no join, no broadcast, codegen-friendly."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping

from pyspark.sql import Column, functions as F


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value worked out once a row, however often ``use`` names it."""
    return F.transform(F.array(value), use)[0]


def exact(c: Column, table: Mapping, default=None) -> Column:
    """Value whose key equals ``c``."""
    pairs = [F.lit(x) for item in table.items() for x in item]
    found = F.try_element_at(F.create_map(*pairs), c)
    return found if default is None else F.coalesce(found, F.lit(default))


def first_contained(c: Column, table: Mapping[str, object], default=None) -> Column:
    """Value of the first key, in table order, that is a substring of ``c``."""
    out = None
    for key, value in table.items():
        out = F.when(c.contains(key), F.lit(value)) if out is None else out.when(c.contains(key), F.lit(value))
    return out.otherwise(F.lit(default))


def any_contained(c: Column, words: Iterable[str]) -> Column:
    """True when any word is a substring of ``c``; false on null."""
    out = F.lit(False)
    for w in words:
        out = out | c.contains(w)
    return F.coalesce(out, F.lit(False))


def bands(c: Column, steps: Iterable[tuple[float, object]], otherwise) -> Column:
    """Value of the first ``(limit, value)`` with ``c < limit``."""
    out = None
    for limit, value in steps:
        cond = c < F.lit(limit)
        out = F.when(cond, F.lit(value)) if out is None else out.when(cond, F.lit(value))
    return out.otherwise(F.lit(otherwise))


def floors(c: Column, steps: Iterable[tuple[float, object]], otherwise) -> Column:
    """Value of the first ``(limit, value)`` with ``c >= limit``."""
    out = None
    for limit, value in steps:
        cond = c >= F.lit(limit)
        out = F.when(cond, F.lit(value)) if out is None else out.when(cond, F.lit(value))
    return out.otherwise(F.lit(otherwise))
