"""Dashboard and report aggregates.  Every group is pre-aggregated map-side."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, Window as W

from backline.functions import lookup
from backline.functions.refdata import LIST_RATES_TO_INR, SNAPSHOT_COLUMNS, STREAM_PLATFORMS
from backline.functions.rounding import cents_mean, cents_sum, half_even, half_up
from backline.operators.joins import latest_prediction


def _day(value: str) -> Column:
    return F.lit(value).cast("date")


def kpis(artists: DataFrame, concerts: DataFrame, metrics: DataFrame, predictions: DataFrame, as_of: str, platform: str = "youtube") -> DataFrame:
    """One row: active artists, concerts, tickets and revenue this year, mean growth, top artist.

    The parts are one-row aggregates stacked by name, so no part is ever crossed with another.
    """
    start = F.trunc(_day(as_of), "year")
    month_ago = F.date_sub(_day(as_of), 30)
    latest = latest_prediction(predictions).select("concert_id", F.col("expected_revenue").alias("pr"))
    this_year = F.col("concert_date") >= start
    shows = concerts.withColumn("year_id", F.when(this_year, F.col("concert_id"))).join(latest.withColumnRenamed("concert_id", "year_id"), "year_id", "left")
    t, p, r = (F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in ("tickets_sold", "avg_ticket_price", "total_revenue"))
    pr = F.coalesce("pr", F.lit(0.0))
    revenue = F.when(r > 0, r).when((t > 0) & (p > 0), t * p).when(pr > 0, pr).otherwise(F.lit(0.0))
    recent = metrics.where(F.col("date") >= month_ago)
    best = (
        recent.where(F.col("platform") == platform)
        .groupBy("artist_id").agg(F.max("streams").alias("streams"))
        .orderBy(F.col("streams").desc(), "artist_id").limit(1)
        .join(artists.select("artist_id", "artist_name"), "artist_id", "inner")
    )

    def part(df: DataFrame, name: str, value: Column, text: Column | None = None) -> DataFrame:
        return df.select(F.lit(name).alias("k"), value.cast("double").alias("v"), (F.lit(None) if text is None else text).cast("string").alias("s"))

    growth = half_even(cents_mean(F.col("rog_daily")), 2)
    # concerts, tickets and revenue in one pass
    totals = shows.agg(F.count(F.lit(1)).alias("n"), F.sum(F.when(this_year, F.col("tickets_sold"))).alias("tickets"), cents_sum(F.when(this_year, half_up(revenue, 2))).alias("revenue"))
    totals = totals.selectExpr("stack(3, 'concerts', double(n), 'tickets', double(tickets), 'revenue', double(revenue)) as (k, v)").withColumn("s", F.lit(None).cast("string"))
    parts = [
        totals,
        part(artists.where("active").agg(F.count(F.lit(1)).alias("v")), "artists", F.col("v")),
        part(recent.agg(growth.alias("v")), "growth", F.col("v")),
        part(best, "top", F.col("streams"), F.col("artist_name")),
    ]
    stacked = parts[0]
    for x in parts[1:]:
        stacked = stacked.unionByName(x)

    def one(name: str, c: str = "v") -> Column:
        return F.max(F.when(F.col("k") == name, F.col(c)))

    return stacked.agg(
        one("artists").cast("long").alias("total_artists"), one("concerts").cast("long").alias("total_concerts"),
        F.coalesce(one("tickets"), F.lit(0.0)).cast("long").alias("tickets_ytd"),
        F.coalesce(one("revenue"), F.lit(0.0)).alias("revenue_ytd"),
        F.coalesce(one("growth"), F.lit(0.0)).alias("avg_daily_growth"),
        one("top", "s").alias("top_artist"), one("top").cast("long").alias("top_streams"),
    )


def top_artists(metrics: DataFrame, artists: DataFrame, as_of: str, n: int, platform: str | None = None) -> DataFrame:
    """Artists by the sum of each platform's newest followers in 90 days, with the breakdown."""
    recent = metrics.where((F.col("date") >= F.date_sub(_day(as_of), 90)))
    if platform:
        recent = recent.where(F.col("platform") == platform)
    latest = recent.groupBy("artist_id", "platform").agg(F.max_by("followers", "date").alias("followers"))
    # the artists' snapshot columns stand in when there is no series at all: a one-row flag decides, not a job
    names = [p for p in SNAPSHOT_COLUMNS if platform in (None, p)]
    stack = ", ".join(f"'{p}', {SNAPSHOT_COLUMNS[p]}" for p in names)
    snapshot = artists.where("active").selectExpr("artist_id", f"stack({len(names)}, {stack}) as (platform, followers)").where("followers > 0")
    none = recent.agg((F.count(F.lit(1)) == 0).alias("none"))
    latest = latest.unionByName(snapshot.join(none, F.col("none")).drop("none"))
    totals = (
        latest.groupBy("artist_id")
        .agg(
            F.sum("followers").alias("total_followers"),
            # at most one entry per platform
            F.array_sort(F.collect_list(F.struct("platform", "followers"))).alias("platforms"),
        )
        .orderBy(F.col("total_followers").desc(), "artist_id")
        .limit(n)
    )
    return totals.join(artists.select("artist_id", "artist_name"), "artist_id", "left")


def monthly_trend(metrics: DataFrame, months: int, as_of: str, platform: str | None = None, artist_id=None) -> DataFrame:
    """Sum of streams (audio platforms) or followers per calendar month, as many months back as asked."""
    cutoff = F.add_months(_day(as_of), -months)
    df = metrics.where((F.col("date") >= cutoff) & (F.col("date") <= _day(as_of)))
    if platform:
        df = df.where(F.col("platform") == platform)
    if artist_id is not None:
        df = df.where(F.col("artist_id") == artist_id)
    value = F.when(F.col("platform").isin(STREAM_PLATFORMS), F.col("streams")).otherwise(F.col("followers"))
    return (
        df.groupBy("platform", F.trunc("date", "month").alias("month"))
        .agg(F.sum(value).alias("value"))
        .withColumn("label", F.date_format("month", "MMM yyyy"))
    )


def demographics(demo: DataFrame, dimension: str, artist_id=None, concert_id=None) -> DataFrame:
    df = demo.where(F.col("dimension") == dimension)
    if artist_id is not None:
        df = df.where(F.col("artist_id") == artist_id)
    if concert_id is not None:
        df = df.where(F.col("concert_id") == concert_id)
    return (
        df.groupBy("dimension_value")
        .agg(F.coalesce(F.sum("absolute_count"), F.lit(0)).alias("total"), half_up(cents_mean(F.col("percentage")), 2).alias("avg_percentage"))
        .orderBy(F.col("total").desc(), "dimension_value")
    )


def geo_breakdown(demo: DataFrame, n: int = 100) -> DataFrame:
    """The n largest geographies with their rank; the rank window sees those n rows only."""
    top = demographics(demo, "GEOGRAPHY").limit(n)
    return top.withColumn("rank", F.row_number().over(W.orderBy(F.col("total").desc(), "dimension_value")))


def _place_stats(concerts: DataFrame, keys: list[str], n: int) -> DataFrame:
    out = concerts.groupBy(*keys).agg(
        F.coalesce(F.sum("tickets_sold"), F.lit(0)).alias("tickets"),
        F.coalesce(cents_sum(F.col("total_revenue")), F.lit(0.0)).alias("revenue"),
        F.coalesce(F.sum("capacity"), F.lit(0)).alias("capacity"),
        F.count(F.lit(1)).alias("concerts"),
    )
    per_ticket = half_up(F.coalesce(F.try_divide("revenue", F.col("tickets").cast("double")), F.lit(0.0)), 2)
    return out.withColumn("revenue_per_ticket", per_ticket).orderBy(F.col("revenue").desc(), *keys).limit(n)


def city_stats(concerts: DataFrame, country: str | None = None, n: int = 50) -> DataFrame:
    df = concerts.where(F.lower("country").contains(country.lower())) if country else concerts
    return _place_stats(df, ["city", "state", "country"], n)


def venue_stats(concerts: DataFrame, n: int = 50) -> DataFrame:
    return _place_stats(concerts.where(F.col("venue_name").isNotNull()), ["venue_name", "city", "country"], n)


def venue_capacity_rollup(concerts: DataFrame) -> DataFrame:
    """Capacity range per venue as seen in its concerts; verified from three concerts on."""
    df = concerts.where(F.col("venue_name").isNotNull() & (F.col("capacity") > 0))
    return df.groupBy("venue_name", "city", "country").agg(
        F.min("capacity").alias("capacity_min"), F.max("capacity").alias("capacity_max"),
        half_even(F.avg("capacity")).cast("long").alias("avg_capacity"),
        (F.count(F.lit(1)) >= 3).alias("verified"), F.count(F.lit(1)).alias("concerts"),
    )


def genre_popularity(artist_genres: DataFrame, metrics: DataFrame, artist_id=None) -> DataFrame:
    """Artists per genre and the sum of each artist's highest follower count."""
    peak = metrics.groupBy("artist_id").agg(F.max("followers").alias("peak"))
    bridge = artist_genres if artist_id is None else artist_genres.where(F.col("artist_id") == artist_id)
    return (
        bridge.distinct().join(peak, "artist_id", "left").groupBy("genre")
        .agg(F.count(F.lit(1)).alias("artists"), F.coalesce(F.sum("peak"), F.lit(0)).alias("followers"))
        .orderBy(F.col("followers").desc(), "genre")
    )


def in_inr(amount: Column, currency: Column) -> Column:
    """List-page conversion: missing currency is INR, an unknown one uses the USD rate."""
    code = F.upper(F.coalesce(currency, F.lit("INR")))
    return F.coalesce(amount, F.lit(0.0)) * lookup.exact(code, LIST_RATES_TO_INR, LIST_RATES_TO_INR["USD"])


def concert_totals(concerts: DataFrame) -> DataFrame:
    """Totals of a concert set in INR and its best city: one pass by city, then one row."""
    by_city = concerts.groupBy(F.coalesce(F.when(F.col("city") != "", F.col("city")), F.lit("Unknown")).alias("city")).agg(
        F.sum(in_inr(F.col("total_revenue"), F.col("currency")).cast("decimal(24,4)")).alias("revenue"),
        F.sum(F.coalesce("tickets_sold", F.lit(0))).alias("tickets"),
        F.sum(F.coalesce("capacity", F.lit(0))).alias("capacity"),
        F.count(F.lit(1)).alias("concerts"),
    )
    rev, tix, cap = (F.sum(c).cast("double") for c in ("revenue", "tickets", "capacity"))
    return by_city.agg(
        F.sum("tickets").alias("total_tickets"), half_up(rev, 2).alias("total_revenue_inr"),
        half_up(F.when(tix > 0, F.try_divide(rev, tix)).otherwise(F.lit(0.0)), 4).alias("avg_ticket_price"),
        half_up(F.when(cap > 0, F.try_divide(tix, cap) * 100.0).otherwise(F.lit(0.0)), 4).alias("avg_sell_through"),
        F.max_by("city", F.struct("revenue", "city")).alias("top_city"),
        F.max_by("concerts", F.struct("revenue", "city")).alias("top_city_concerts"),
    )


def revenue_by_city(concerts: DataFrame, artists: DataFrame, kind: str | None = None) -> DataFrame:
    """Revenue per city, optionally for one artist type.

    Concerts are summed per (artist, city) before the join, so a hot artist is small by then.
    """
    per = concerts.groupBy("artist_id", "city").agg(F.sum(F.col("total_revenue").cast("decimal(24,4)")).alias("revenue"))
    if kind:
        indian = F.coalesce(F.lower("nationality").contains("india"), F.lit(False))
        per = per.join(artists.where(indian if kind == "indian" else ~indian).select("artist_id"), "artist_id", "left_semi")
    return (
        per.groupBy("city").agg(F.coalesce(F.sum("revenue").cast("double"), F.lit(0.0)).alias("revenue"))
        .orderBy(F.col("revenue").desc(), "city")
    )


def concerts_per_artist(artists: DataFrame, concerts: DataFrame) -> DataFrame:
    counts = concerts.groupBy("artist_id").agg(F.count(F.lit(1)).alias("concerts"))
    return artists.select("artist_id", "artist_name").join(counts, "artist_id", "left").withColumn(
        "concerts", F.coalesce("concerts", F.lit(0))
    )


def artist_profile(artists: DataFrame, metrics: DataFrame, concerts: DataFrame) -> DataFrame:
    """Followers and growth of the newest row per platform, concert sums, leading platform."""
    latest = metrics.groupBy("artist_id", "platform").agg(
        F.max_by("followers", "date").alias("followers"), F.max_by(F.coalesce("rog_daily", F.lit(0.0)), "date").alias("rog")
    )
    social = latest.groupBy("artist_id").agg(
        F.sum("followers").alias("total_followers"), half_up(cents_mean(F.col("rog")), 4).alias("avg_growth"),
        F.max_by("platform", F.struct("followers", "platform")).alias("top_platform"),
        F.max("followers").alias("top_platform_followers"),
    )
    shows = concerts.groupBy("artist_id").agg(
        cents_sum(F.col("total_revenue")).alias("total_revenue"), F.sum("tickets_sold").alias("total_tickets"),
        F.count(F.lit(1)).alias("concerts"),
    )
    out = artists.select("artist_id", "artist_name").join(social, "artist_id", "left").join(shows, "artist_id", "left")
    return out.fillna({"total_followers": 0, "avg_growth": 0.0, "total_revenue": 0.0, "total_tickets": 0, "concerts": 0,
                       "top_platform": "Unknown", "top_platform_followers": 0})


def compare_artists(artists: DataFrame, metrics: DataFrame, concerts: DataFrame, a, b, city: str | None = None) -> DataFrame:
    """Six measures for two artists and the winner of each; the second wins ties."""
    pair = F.col("artist_id").isin(a, b)
    shows = concerts.where(pair & (F.col("city") == city)) if city else concerts.where(pair)
    prof = artist_profile(artists.where(pair), metrics.where(pair), shows)
    names = ["total_followers", "avg_growth", "total_revenue", "total_tickets", "concerts", "top_platform_followers"]
    stack = ", ".join(f"'{n}', cast({n} as double)" for n in names)
    long = prof.selectExpr("artist_id", f"stack({len(names)}, {stack}) as (measure, value)")
    return (
        long.groupBy("measure")
        .agg(F.max(F.when(F.col("artist_id") == a, F.col("value"))).alias("value_a"),
             F.max(F.when(F.col("artist_id") == b, F.col("value"))).alias("value_b"))
        .withColumn("winner", F.when(F.col("value_a") > F.col("value_b"), "a").otherwise("b"))
    )


def profile_demographics(demo: DataFrame) -> DataFrame:
    return demo.groupBy("artist_id", "dimension", F.coalesce("dimension_value", F.lit("Unknown")).alias("dimension_value")).agg(
        F.coalesce(F.sum("absolute_count"), F.lit(0)).alias("total")
    )


def venue_batch(concerts: DataFrame) -> DataFrame:
    """Distinct (venue, place, capacity, artist) with ticket statistics, most frequent first."""
    df = concerts.where(F.col("venue_name").isNotNull() & (F.col("venue_name") != ""))
    return (
        df.groupBy("venue_name", "city", "country", "capacity", "artist_id")
        .agg(F.count(F.lit(1)).alias("concerts"), F.avg("tickets_sold").alias("avg_tickets"), F.max("tickets_sold").alias("max_tickets"))
        .orderBy(F.col("concerts").desc(), "city", "venue_name", "capacity", "artist_id")
    )


def avg_price_by(concerts: DataFrame, keys: list[str], fallback: float | None = None) -> DataFrame:
    """Mean positive ticket price per key."""
    price = cents_mean(F.when(F.col("avg_ticket_price") > 0, F.col("avg_ticket_price")))
    if fallback is not None:
        price = F.coalesce(price, F.lit(fallback))
    return concerts.groupBy(*keys).agg(half_up(price, 4).alias("mean_price"))


def confirmations(refs: DataFrame, key: str) -> DataFrame:
    return refs.groupBy(key).agg(F.count(F.lit(1)).alias("sources"))


def validation_report(audit: DataFrame) -> DataFrame:
    """Sell-through range over positive values and how many rows were flagged or corrected."""
    st = F.when(F.col("sell_through") > 0, F.col("sell_through"))
    return audit.agg(
        F.count(F.lit(1)).alias("rows"), half_up(cents_mean(st), 4).alias("mean_sell_through"),
        F.min(st).alias("min_sell_through"), F.max(st).alias("max_sell_through"),
        F.count_if(F.col("issue_count") > 0).alias("with_issues"), F.count_if("corrected").alias("with_corrections"),
    )


def count_by(results: DataFrame, *keys: str) -> DataFrame:
    """Enrichment and run summaries: rows per status or action."""
    return results.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"))
