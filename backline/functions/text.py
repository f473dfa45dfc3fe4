"""Name cleaning and similarity as column expressions."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, functions as F

from backline.functions.lookup import any_contained, once

# --- fixed values: words dropped from names, by use ---------------------------------------
EVENT_STOP_WORDS = ["the", "official", "live", "concert", "tour", "show", "band", "presents"]
ARTIST_STOP_WORDS = ["the", "official", "live", "band"]
UPPER_WORDS = ["dj", "edm", "usa", "uk", "uae"]


def _latin_forms() -> tuple[str, str, str, str]:
    """(letters with marks, their bases, compatibility forms without marks, their bases)."""
    marked, base, plain, same = "", "", "", ""
    for code in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00), *range(0xFF01, 0xFF5F)]:
        form = unicodedata.normalize("NFKD", chr(code))
        if form[0].isascii() and form[0].isalnum() and all(unicodedata.combining(x) for x in form[1:]):
            if len(form) > 1:
                marked, base = marked + chr(code), base + form[0]
            elif form != chr(code):
                plain, same = plain + chr(code), same + form
    return marked, base, plain, same


MARKED, MARKED_BASE, PLAIN, PLAIN_BASE = _latin_forms()


def decompose(c: Column) -> Column:
    """Compatibility decomposition of Latin letters; each accent becomes a space after its letter."""
    spaced = F.regexp_replace(c, "([\u00c0-\u024f\u1e00-\u1eff])", "$1 ")
    folded = F.translate(spaced, MARKED + PLAIN, MARKED_BASE + PLAIN_BASE)
    return F.when(F.octet_length(c) > F.length(c), folded).otherwise(c)  # ASCII has one byte a character


def _squeeze(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def event_name_key(c: Column) -> Column:
    """Comparable form for events: accents split off, ``&`` as a word, long stop list."""
    x = F.replace(F.lower(decompose(c)), F.lit("&"), F.lit(" and "))
    x = F.regexp_replace(x, "[^a-z0-9]+", " ")
    return _squeeze(F.regexp_replace(x, r"\b(" + "|".join(EVENT_STOP_WORDS) + r")\b", " "))


def artist_name_key(c: Column) -> Column:
    """Comparable form for artist matching: short stop list, accents dropped."""
    x = F.regexp_replace(F.replace(F.lower(c), F.lit("&"), F.lit("and")), "[^a-z0-9]+", " ")
    return _squeeze(F.regexp_replace(x, r"\b(" + "|".join(ARTIST_STOP_WORDS) + r")\b", " "))


def token_key(c: Column) -> Column:
    """Comparable form for token overlap: no stop list."""
    return _squeeze(F.regexp_replace(F.replace(F.lower(c), F.lit("&"), F.lit("and")), "[^a-z0-9]+", " "))


def display(c: Column) -> Column:
    """One-line display text."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " "), r"[|]+", " "))


def title(c: Column) -> Column:
    """Capitalised words; a few initialisms stay upper case."""
    x = F.initcap(_squeeze(c))
    upper = x
    for w in UPPER_WORDS:
        upper = F.regexp_replace(upper, f"(?<=^| ){w.capitalize()}(?= |$)", w.upper())
    listed = any_contained(x, [w.capitalize() for w in UPPER_WORDS]) & x.rlike("(^| )(" + "|".join(w.capitalize() for w in UPPER_WORDS) + ")( |$)")
    return F.when(listed, upper).otherwise(x)


def tokens(c: Column) -> Column:
    return F.filter(F.array_distinct(F.split(token_key(c), " ")), lambda t: t != "")


def overlap(a: Column, b: Column) -> Column:
    """Shared over all distinct tokens of two token arrays; 0 when either is empty."""
    union = F.size(F.array_union(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / union.cast("double"))


def jaccard(a: Column, b: Column) -> Column:
    return once(F.struct(tokens(a).alias("a"), tokens(b).alias("b")), lambda t: overlap(t.a, t.b))


def artist_match(expected: Column, actual: Column) -> Column:
    """1 for equal names, 0.86 when one contains the other, else token overlap."""
    toks = lambda k: F.filter(F.array_distinct(F.split(k, " ")), lambda t: t != "")
    shared = lambda k: once(F.struct(toks(k.a).alias("a"), toks(k.b).alias("b")), lambda t: overlap(t.a, t.b))
    empty = lambda k: F.coalesce(k, F.lit("")) == ""
    keys = F.struct(artist_name_key(expected).alias("a"), artist_name_key(actual).alias("b"))
    return once(keys, lambda k: F.when(empty(k.a) | empty(k.b), 0.0).when(k.a == k.b, 1.0).when(k.a.contains(k.b) | k.b.contains(k.a), 0.86).otherwise(shared(k)))


def date_similarity(a: Column, b: Column) -> Column:
    days = F.abs(F.datediff(a, b))
    return F.when(days < 0.5, 1.0).when(days <= 1, 0.9).when(days <= 2, 0.65).otherwise(0.0)


def grams(c: Column, n: int) -> Column:
    """Distinct substrings of length n."""
    count = F.length(c) - n + 1
    return F.when(count > 0, F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(count, F.lit(1))), lambda i: F.substring(c, i, F.lit(n))))).otherwise(
        F.array().cast("array<string>")
    )
