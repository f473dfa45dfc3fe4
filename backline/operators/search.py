"""Filters, projections, paging and top-k over artists, concerts and metrics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from backline.functions import lookup
from backline.functions.rounding import half_up


def _has(c: str, term: str) -> Column:
    return F.lower(F.col(c)).contains(term.lower())


def list_concerts(concerts: DataFrame, artist_id=None, city=None, country=None, start=None, end=None) -> DataFrame:
    """Concert search, newest first; every filter is optional."""
    out = concerts
    if artist_id is not None:
        out = out.where(F.col("artist_id") == artist_id)
    if city:
        out = out.where(_has("city", city))
    if country:
        out = out.where(_has("country", country))
    if start:
        out = out.where(F.col("concert_date") >= F.lit(start).cast("date"))
    if end:
        out = out.where(F.col("concert_date") <= F.lit(end).cast("date"))
    return out.orderBy(F.col("concert_date").desc(), "concert_id")


def list_artists(artists: DataFrame, artist_genres: DataFrame, search=None, genre=None, active=True) -> DataFrame:
    """Artist search: text in name or nationality, genre by semi join."""
    out = artists.where(F.col("active") == active)
    if search:
        out = out.where(_has("artist_name", search) | _has("nationality", search))
    if genre:
        keys = artist_genres.where(F.lower("genre") == genre.lower()).select("artist_id")
        out = out.join(keys, "artist_id", "left_semi")
    return out.orderBy("artist_name", "artist_id")


def sell_through_pct(tickets: str = "tickets_sold", capacity: str = "capacity") -> Column:
    cap = F.coalesce(F.col(capacity), F.lit(0)).cast("double")
    sold = F.coalesce(F.col(tickets), F.lit(0)).cast("double")
    return F.when(cap > 0, sold / cap * 100.0).otherwise(F.lit(0.0))


SORTS = {
    "date-desc": lambda: F.col("concert_date").desc(),
    "date-asc": lambda: F.col("concert_date").asc(),
    "revenue-desc": lambda: F.coalesce("total_revenue", F.lit(0.0)).desc(),
    "tickets-desc": lambda: F.coalesce("tickets_sold", F.lit(0)).desc(),
    "sell-through-desc": lambda: sell_through_pct().desc(),
}


def search_concerts(concerts: DataFrame, term: str = "", city: str = "", year: int | None = None, sort: str = "date-desc") -> DataFrame:
    """Free text over six columns, city and year filters, five sort orders."""
    out = concerts
    if term.strip():
        needle = term.strip().lower()
        hit = F.lit(False)
        for c in ("artist_name", "city", "event_name", "venue_name", "state", "country"):
            hit = hit | F.coalesce(F.lower(c).contains(needle), F.lit(False))
        out = out.where(hit)
    if city.strip():
        out = out.where(_has("city", city.strip()))
    if year is not None:
        # a date range, so that month partitions are pruned
        out = out.where(F.col("concert_date").between(F.lit(f"{year}-01-01").cast("date"), F.lit(f"{year}-12-31").cast("date")))
    return out.orderBy(SORTS[sort](), "concert_id")


def artist_metrics(metrics: DataFrame, artist_id=None, platform=None, start=None, end=None, limit=None) -> DataFrame:
    out = metrics
    if artist_id is not None:
        out = out.where(F.col("artist_id") == artist_id)
    if platform:
        out = out.where(F.col("platform") == platform.lower())
    if start:
        out = out.where(F.col("date") >= F.lit(start).cast("date"))
    if end:
        out = out.where(F.col("date") <= F.lit(end).cast("date"))
    out = out.orderBy(F.col("date").desc(), "artist_id", "platform")
    return out.limit(limit) if limit else out


def artist_type(artists: DataFrame) -> DataFrame:
    indian = F.coalesce(_has("nationality", "india"), F.lit(False))
    return artists.withColumn("artist_type", F.when(indian, "indian").otherwise("international"))


def concert_label(concerts: DataFrame) -> DataFrame:
    """``artist at venue``, else ``artist in city``."""
    has_venue = F.coalesce(F.col("venue_name"), F.lit("")) != ""
    return concerts.withColumn(
        "label",
        F.when(has_venue, F.concat("artist_name", F.lit(" at "), "venue_name")).otherwise(
            F.concat("artist_name", F.lit(" in "), F.coalesce("city", F.lit("")))
        ),
    )


def sell_through_band(concerts: DataFrame) -> DataFrame:
    """List-page and detail-page bands of tickets over capacity."""
    pct = sell_through_pct()
    no_cap = F.coalesce(F.col("capacity"), F.lit(0)) == 0
    return concerts.withColumn(
        "list_band",
        F.when(no_cap, "Capacity TBA").otherwise(lookup.floors(pct, [(95.0, "Sold out"), (80.0, "Strong")], "Building")),
    ).withColumn("detail_band", lookup.floors(pct, [(95.0, "high"), (75.0, "medium")], "low"))


def top_k(df: DataFrame, measure: str, k: int, tie: str) -> DataFrame:
    return df.orderBy(F.col(measure).desc_nulls_last(), tie).limit(k)


def page(df: DataFrame, order: Sequence[Column | str], page_no: int, size: int) -> DataFrame:
    """One page of a sorted list; total and page count ride along as columns.

    The count is its own aggregate over the input, joined to at most ``size`` rows.
    """
    rows = df.orderBy(*order).offset((page_no - 1) * size).limit(size)
    total = df.agg(F.count(F.lit(1)).alias("total")).withColumn("page_key", F.lit(1))
    return (
        rows.withColumn("page_key", F.lit(1))
        .join(F.broadcast(total), "page_key", "left")
        .withColumn("total_pages", F.ceil(F.col("total") / F.lit(float(size))))
        .drop("page_key")
    )


def next_page(df: DataFrame, date_col: str, id_col: str, after_date, after_id, size: int) -> DataFrame:
    """Keyset page for deep lists: rows after the last one seen, newest first."""
    last = F.lit(after_date).cast("date")
    return (
        df.where((F.col(date_col) < last) | ((F.col(date_col) == last) & (F.col(id_col) > after_id)))
        .orderBy(F.col(date_col).desc(), id_col)
        .limit(size)
    )


def adjusted_popularity(artists: DataFrame, months: int, k: int = 10) -> DataFrame:
    """Popularity scaled by the chosen time window; the k best."""
    pop = F.coalesce(F.col("popularity"), F.lit(0.0))
    score = F.least(half_up(pop * F.lit(1 + (months - 12) * 0.005)), F.lit(100.0))
    return top_k(artists.withColumn("adjusted_popularity", score), "adjusted_popularity", k, "artist_id")


def options(df: DataFrame, c: str, always: Sequence[str] = (), descending: bool = False) -> DataFrame:
    """Distinct non-empty values of a column for a drop-down."""
    vals = df.select(F.col(c).alias("option")).where(F.col("option").isNotNull() & (F.col("option").cast("string") != ""))
    if always:
        vals = vals.unionByName(df.sparkSession.createDataFrame([(v,) for v in always], "option string"))
    vals = vals.distinct()
    return vals.orderBy(F.col("option").desc() if descending else F.col("option"))


def first_by_key(df: DataFrame, key: Sequence[Column | str], seq: Sequence[str]) -> DataFrame:
    """First row per key in the order ``seq``.

    A min over (sequence, row) combines map-side, so a hot key costs one row per task.
    """
    keys = [F.col(k) if isinstance(k, str) else k for k in key]
    names = [f"k{i}" for i in range(len(keys))]
    row = F.struct(*[F.col(c) for c in df.columns])
    order = F.struct(*[F.col(s) for s in seq])
    picked = (
        df.select(*[k.alias(n) for k, n in zip(keys, names)], row.alias("r"), order.alias("o"))
        .groupBy(*names)
        .agg(F.min_by("r", "o").alias("r"))
    )
    return picked.select("r.*")


def union_sources(first: DataFrame, *rest: DataFrame) -> DataFrame:
    out = first
    for df in rest:
        out = out.unionByName(df, allowMissingColumns=True)
    return out
