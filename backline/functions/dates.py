"""Dates, prices and times in free text.  Whole texts are read, never a prefix."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from backline.functions.lookup import once

# --- fixed values: patterns ---------------------------------------------------------------
MONTHS = "Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec"
DAY_MONTH_YEAR = rf"(?i)(\d{{1,2}})\s+({MONTHS})\w*[\s,]+(\d{{4}})"
MONTH_DAY_YEAR = rf"(?i)({MONTHS})\w*\s+(\d{{1,2}})[\s,]+(\d{{4}})"
DAY_MONTH = rf"(?i)(\d{{1,2}})\s+({MONTHS})"
MONTH_DAY = rf"(?i)({MONTHS})\w*[\s,]+(\d{{1,2}})"
CLOCK = r"(\d{1,2}:\d{2}\s*(?:AM|PM|am|pm))"


def _date(text: Column, pattern: str, d: int, m: int, year: Column | int) -> Column:
    rest = lambda mon: F.concat_ws(" ", F.regexp_extract(text, pattern, d), F.initcap(mon), F.regexp_extract(text, pattern, year) if isinstance(year, int) else year)
    joined = once(F.regexp_extract(text, pattern, m), lambda mon: F.when(mon != "", rest(mon)))
    return F.try_to_timestamp(joined, F.lit("d MMM yyyy")).cast("date")


def date_from_text(text: Column, as_of: str, min_year: int = 2025, yearless: bool = True) -> Column:
    """First date in a text.

    Dates with a year must be ``min_year`` or later.  Without a year the year of ``as_of`` is
    taken, moved one year on unless that day is still to come.
    """

    def first(text: Column) -> Column:
        full = [_date(text, DAY_MONTH_YEAR, 1, 2, 3), _date(text, MONTH_DAY_YEAR, 2, 1, 3)]
        found = [once(x, lambda d: F.when(F.year(d) >= min_year, d)) for x in full]
        if yearless:
            day = F.lit(as_of).cast("date")
            year = F.year(day).cast("string")
            for x in (_date(text, DAY_MONTH, 1, 2, year), _date(text, MONTH_DAY, 2, 1, year)):
                found.append(once(x, lambda d: F.when(d <= day, F.add_months(d, 12)).otherwise(d)))
        return F.coalesce(*found)

    return once(text, first)


def price_from_text(text: Column, marks: str = "₹$£€") -> Column:
    """First number after a currency mark."""
    raw = F.regexp_replace(F.regexp_extract(text, rf"[{marks}]\s*([\d,]+)", 1), ",", "")
    return F.nullif(raw, F.lit("")).try_cast("double")


def all_prices(text: Column, low: float = 50, high: float = 500_000) -> Column:
    """Sorted distinct prices after the rupee sign that lie in a plausible range."""
    nums = F.transform(F.regexp_extract_all(text, F.lit(r"₹\s*([\d,]+)"), 1), lambda x: F.regexp_replace(x, ",", "").try_cast("double"))
    return F.array_sort(F.array_distinct(F.filter(nums, lambda x: x.between(low, high))))


def price_tiers_of(prices: Column) -> dict[str, Column]:
    """Tier prices by position in the sorted list."""
    n = F.size(prices)
    at = lambda i: F.get(prices, i.cast("int") if isinstance(i, Column) else F.lit(i))
    return {
        "tier3": F.when(n >= 2, at(0)),
        "tier2": F.when(n >= 4, at(F.floor(n / 3))).when(n == 3, at(1)),
        "tier1": F.when(n >= 4, at(F.floor(n * 2 / 3))),
        "vip": F.when(n >= 2, at(n - 1)),
    }


def clock_from_text(text: Column) -> Column:
    return F.nullif(F.regexp_extract(text, CLOCK, 1), F.lit(""))
