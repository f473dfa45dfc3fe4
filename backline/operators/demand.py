"""Demand score and its parts, artist tiers, city popularity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from backline.functions import lookup
from backline.functions.refdata import MONTH_WEIGHTS, SEASONS, SNAPSHOT_COLUMNS, TIER_BREAKS
from backline.functions.rounding import clamp, half_even, half_up
from backline.operators import series as ts

# --- fixed values: city markets ---------------------------------------------------------
CITY_MULTIPLIERS = {
    "mumbai": 1.20, "delhi": 1.15, "new delhi": 1.15, "bangalore": 1.20, "bengaluru": 1.20, "hyderabad": 1.05,
    "pune": 1.10, "kolkata": 0.95, "chennai": 0.90, "ahmedabad": 0.85, "chandigarh": 0.90, "jaipur": 0.80,
}
MAJOR_MARKETS = [
    "mumbai", "delhi", "new delhi", "bangalore", "bengaluru", "hyderabad", "chennai", "pune", "kolkata",
    "new york", "los angeles", "london", "paris", "tokyo", "singapore", "dubai",
]


def sell_through(tickets: Column, capacity: Column, cap: bool = True) -> Column:
    """Tickets over capacity, 0 when unknown; capped at 1 unless told otherwise."""
    rate = F.greatest(tickets.cast("double"), F.lit(0.0)) / F.when(capacity > 0, capacity.cast("double"))
    if cap:
        rate = F.least(rate, F.lit(1.0))
    return F.when(tickets.isNull() | capacity.isNull() | (capacity <= 0), F.lit(0.0)).otherwise(half_even(rate, 4))


def with_sell_through(concerts: DataFrame) -> DataFrame:
    t, c = F.col("tickets_sold"), F.col("capacity")
    return concerts.withColumn("sell_through", sell_through(t, c)).withColumn(
        "sell_through_uncapped", sell_through(t, c, cap=False)
    ).withColumn("sell_through_pct", half_even(sell_through(t, c) * 100.0, 2))


def ticket_velocity(concerts: DataFrame, as_of: str, days: int = 90) -> DataFrame:
    """Mean sell-through of the artist's concerts in the last ``days`` days."""
    day = F.lit(as_of).cast("date")
    recent = concerts.where(F.col("concert_date").between(F.date_sub(day, days), day) & F.col("tickets_sold").isNotNull() & F.col("capacity").isNotNull())
    rate = sell_through(F.col("tickets_sold"), F.col("capacity")).cast("decimal(12,4)")
    mean = F.sum(rate).cast("double") / F.count(F.lit(1))
    return recent.groupBy("artist_id").agg(half_even(mean, 4).alias("ticket_velocity"))


def is_weekend(day: Column) -> Column:
    """Friday to Sunday."""
    return F.weekday(day) >= 4


def seasonality(day: Column) -> Column:
    base = lookup.exact(F.month(day), MONTH_WEIGHTS, 0.7)
    return F.least(F.lit(1.0), base + F.when(is_weekend(day), 0.1).otherwise(0.0))


def recency(targets: DataFrame, concerts: DataFrame, as_of: str) -> DataFrame:
    """How long ago the artist played the target's city or country.

    Three group-maxima joined on equality keys replace an OR join.
    """
    c = concerts.select("artist_id", F.lower("city").alias("k_city"), F.lower("country").alias("k_country"), "concert_date")
    by_city = c.groupBy("artist_id", "k_city").agg(F.max("concert_date").alias("in_city"))
    by_country = c.groupBy("artist_id", "k_country").agg(F.max("concert_date").alias("in_country"))
    any_show = c.groupBy("artist_id").agg(F.lit(True).alias("has_shows"))
    t = targets.withColumn("k_city", F.lower("city")).withColumn("k_country", F.lower("country"))
    t = t.join(by_city, ["artist_id", "k_city"], "left").join(by_country, ["artist_id", "k_country"], "left").join(any_show, "artist_id", "left")
    since = F.datediff(F.lit(as_of).cast("date"), F.greatest("in_city", "in_country"))
    score = (
        F.when(F.col("has_shows").isNull(), 0.5).when(since.isNull(), 0.7)
        .when(since < 30, 0.2).when(since < 90, 0.5).when(since < 180, 0.8).otherwise(0.9)
    )
    return t.withColumn("recency", score).drop("k_city", "k_country", "in_city", "in_country", "has_shows")


def demand_scores(targets: DataFrame, metrics: DataFrame, concerts: DataFrame, as_of: str) -> DataFrame:
    """0-100 demand per target: 40 % social, 30 % tickets, 20 % season, 10 % recency.

    ``targets``: artist_id, city, country, target_date.  Each part is rounded before the sum.
    """
    social = ts.social_velocity(ts.primary_metric(metrics))
    tickets = ticket_velocity(concerts, as_of)
    df = recency(targets, concerts, as_of).join(social, "artist_id", "left").join(tickets, "artist_id", "left")
    sv, tv = F.coalesce("social_velocity", F.lit(0.0)), F.coalesce("ticket_velocity", F.lit(0.0))
    df = df.withColumn("social_velocity", half_even(sv, 4)).withColumn("ticket_velocity", half_even(tv, 4))
    df = df.withColumn("seasonality", half_even(seasonality(F.col("target_date")), 4))
    raw = F.col("social_velocity") * 0.40 + F.col("ticket_velocity") * 0.30 + F.col("seasonality") * 0.20 + F.col("recency") * 0.10
    return df.withColumn("score", half_even(clamp(raw * 100.0, 0, 100), 2))


def demand_targets(concerts: DataFrame, as_of: str) -> DataFrame:
    """Every (artist, city, country) ever played, 30 days ahead."""
    return concerts.select("artist_id", "city", "country").distinct().withColumn("target_date", F.date_add(F.lit(as_of).cast("date"), 30))


def tier_of(followers: Column) -> Column:
    return lookup.bands(F.coalesce(followers, F.lit(0)), TIER_BREAKS, "superstar")


def artist_tier(metrics: DataFrame) -> DataFrame:
    return metrics.groupBy("artist_id").agg(F.max("followers").alias("peak")).select("artist_id", tier_of(F.col("peak")).alias("artist_tier"))


def snapshot_tier(artists: DataFrame) -> DataFrame:
    peak = F.greatest(*[F.coalesce(F.col(c), F.lit(0)) for c in SNAPSHOT_COLUMNS.values()])
    return artists.withColumn("artist_tier", tier_of(peak))


def tier_from_popularity(pop: Column) -> Column:
    return lookup.floors(pop, [(80, "superstar"), (60, "major"), (40, "mid"), (20, "rising")], "micro")


def concert_features(concerts: DataFrame) -> DataFrame:
    """Price, calendar and naive revenue columns of a concert with a price range."""
    spread = F.col("ticket_price_max") - F.col("ticket_price_min")
    out = concerts.withColumn("price_range", spread).withColumn("avg_ticket_price", F.col("ticket_price_min") + spread * 0.235)
    return (
        out.withColumn("max_revenue_naive", F.col("venue_capacity") * F.col("avg_ticket_price"))
        .withColumn("is_weekend", is_weekend(F.col("concert_date")).cast("int"))
        .withColumn("month", F.month("concert_date"))
        .withColumn("season", lookup.exact(F.month("concert_date"), SEASONS))
    )


def city_popularity(pop: Column, city: Column, affinity: float = 1.0) -> Column:
    m = lookup.exact(F.lower(F.coalesce(city, F.lit(""))), CITY_MULTIPLIERS, 0.7)
    return clamp(pop * m * affinity, 0, 100)


def major_market(city: Column, boost: float) -> Column:
    return F.when(F.lower(city).isin(MAJOR_MARKETS), F.lit(float(boost))).otherwise(F.lit(0.0))


def city_share(targets: DataFrame, demo: DataFrame) -> DataFrame:
    """Newest audience share of the target's city: equal artist, value contains the city.

    Shares are reduced to one row per (artist, value) first, so the residual join is small.
    """
    geo = (
        demo.where((F.col("dimension") == "GEOGRAPHY") & F.col("dimension_value").isNotNull())
        .groupBy("artist_id", F.lower("dimension_value").alias("place"))
        .agg(F.max(F.struct("metric_date", "demo_id", "percentage")).alias("m"))
    )
    keys = targets.select("artist_id", F.lower("city").alias("k_city")).distinct()
    hit = keys.join(geo, "artist_id").where(F.col("place").contains(F.col("k_city")))
    best = hit.groupBy("artist_id", "k_city").agg(F.max("m").alias("m")).select("artist_id", "k_city", F.col("m.percentage").alias("city_share"))
    return targets.withColumn("k_city", F.lower("city")).join(best, ["artist_id", "k_city"], "left").drop("k_city")


def city_popularity_history(targets: DataFrame, popularity: DataFrame, concerts: DataFrame, demo: DataFrame) -> DataFrame:
    """Artist popularity in a city from global popularity, audience share, history and market.

    ``targets``: artist_id, city, country; ``popularity``: artist_id, popularity.
    """
    c = concerts.select("artist_id", F.lower("city").alias("k_city"), F.lower("country").alias("k_country"))
    in_city = c.groupBy("artist_id", "k_city").agg(F.count(F.lit(1)).alias("n_city"))
    in_country = c.groupBy("artist_id", "k_country").agg(F.count(F.lit(1)).alias("n_country"))
    total = c.groupBy("artist_id").agg(F.count(F.lit(1)).alias("n_total"))
    t = city_share(targets, demo).withColumn("k_city", F.lower("city")).withColumn("k_country", F.lower("country"))
    t = (
        t.join(in_city, ["artist_id", "k_city"], "left").join(in_country, ["artist_id", "k_country"], "left")
        .join(total, "artist_id", "left").join(popularity.select("artist_id", "popularity"), "artist_id", "left")
    )
    share = F.coalesce("city_share", F.lit(0.0)) * 0.8
    ratio = lambda n: F.coalesce(F.try_divide(F.col(n).cast("double"), F.col("n_total").cast("double")), F.lit(0.0))
    raw = (
        F.coalesce("popularity", F.lit(45.0)) * 0.68 + share + F.least(F.lit(18.0), ratio("n_city") * 45.0)
        + F.least(F.lit(10.0), ratio("n_country") * 20.0) + major_market(F.col("city"), 8)
    )
    return t.select(*targets.columns, half_up(clamp(raw, 5, 100), 2).alias("city_popularity"))


def reach_popularity(artists: DataFrame) -> DataFrame:
    total = F.lit(0)
    for c in SNAPSHOT_COLUMNS.values():
        total = total + F.coalesce(F.col(c), F.lit(0))
    total = total.cast("double")
    score = half_up(F.log10(total + 1.0) * 12.0)
    return artists.withColumn("reach_popularity", F.when(total <= 0, F.lit(50.0)).otherwise(clamp(score, 5, 95)))
