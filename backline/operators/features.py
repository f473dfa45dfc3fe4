"""Event features and the demand, attendance and revenue formulas on top of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from backline.functions import lookup
from backline.functions.rounding import clamp, half_up
from backline.operators import demand, normalize, popularity, pricing, series as ts
from backline.session import cut_lineage

# --- fixed values ---------------------------------------------------------------------------
SEASON_BOOST = {10: 7, 11: 12, 12: 16, 1: 8, 2: 6, 3: 4}
FEATURE_WEIGHTS = {
    "global_popularity": 0.18, "local_popularity": 0.24, "artist_momentum": 0.14, "city_demand": 0.16, "venue_performance": 0.11,
    "ticket_pricing_intelligence": 0.08, "seasonal_trends": 0.06, "engagement_velocity": 0.03,
}
# (words, capacity): the first row with a word of the venue's name counts
NAME_CAPACITY = [
    (["stadium"], 45_000), (["arena"], 15_000), (["amphitheatre", "amphitheater"], 8_000), (["theatre", "theater", "auditorium"], 2_500),
    (["club", "lounge", "bar"], 700), (["festival", "fairground"], 25_000), (["hall", "centre", "center"], 3_500),
]


def _low(*names: str) -> list[Column]:
    return [F.lower(F.col(n)).alias(f"k_{n}") for n in names]


def _keyed(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({f"k_{n}": F.lower(F.col(n)) for n in names})


def _sold_share() -> Column:
    """Capped sell-through; an unknown capacity counts as one half."""
    cap = F.col("capacity")
    rate = clamp(F.coalesce(F.col("tickets_sold"), F.lit(0)).cast("double") / F.when(cap > 0, cap.cast("double")), 0, 1)
    return F.when(F.coalesce(cap, F.lit(0)) == 0, F.lit(0.5)).otherwise(rate)


def concert_summary(concerts: DataFrame) -> DataFrame:
    """The one pass over the concerts that all place features need: exact sums per (artist, venue, city, country).

    Rolling them up by city or venue gives the same sums as going back to the concerts.
    """
    price = F.col("avg_ticket_price")
    cents = price.cast("decimal(24,4)")
    return concerts.groupBy("artist_id", *_low("venue_name", "city", "country")).agg(
        F.sum(_sold_share().cast("decimal(20,12)")).alias("share_sum"), F.count(F.lit(1)).alias("n"),
        F.sum(F.when(price > 0, cents)).alias("paid_sum"), F.count_if(price > 0).alias("paid_n"), F.sum(cents).alias("price_sum"), F.count(price).alias("price_n"),
    )


def _summary(concerts: DataFrame) -> DataFrame:
    """``concerts`` may be the rows or their summary."""
    return concerts if "share_sum" in concerts.columns else concert_summary(concerts)


def _rolled(summary: DataFrame, *keys: str) -> DataFrame:
    total = lambda c: F.sum(c).cast("double")
    return summary.groupBy(*keys).agg(
        (total("share_sum") / F.sum("n")).alias("mean_share"), F.sum("n").alias("n"), F.try_divide(total("paid_sum"), F.sum("paid_n")).alias("paid_price"),
        F.try_divide(total("price_sum"), F.sum("price_n")).alias("market"), F.sum("price_n").alias("price_n"),
    )


def city_demand(targets: DataFrame, concerts: DataFrame, demo: DataFrame) -> DataFrame:
    """Demand of a city for an artist.  ``targets``: artist_id, city, country, and more columns."""
    cols = targets.columns
    summary = _summary(concerts)
    by_city = _rolled(summary, "k_city", "k_country").select("k_city", "k_country", "mean_share")
    own = summary.groupBy("artist_id", "k_city", "k_country").agg(F.sum("n").alias("own"))
    shares = demand.city_share(targets.select("artist_id", "city").distinct(), demo).groupBy("artist_id", F.lower("city").alias("k_city")).agg(F.max("city_share").alias("share"))
    t = _keyed(targets, "city", "country").join(by_city, ["k_city", "k_country"], "left").join(own, ["artist_id", "k_city", "k_country"], "left").join(shares, ["artist_id", "k_city"], "left")
    share, boost = F.coalesce("share", F.lit(0.0)), demand.major_market(F.col("city"), 10)
    none = boost + F.when(share != 0, share).otherwise(F.lit(35.0))
    some = clamp(F.col("mean_share") * 62.0 + boost + F.least(F.lit(18.0), share * 0.8) + F.least(F.lit(12), F.coalesce("own", F.lit(0)) * 3), 0, 100)
    return t.select(*cols, F.when(F.col("mean_share").isNull(), none).otherwise(some).alias("city_demand"))


def venue_performance(targets: DataFrame, concerts: DataFrame, venues: DataFrame) -> DataFrame:
    """How well a venue sells.  ``targets``: venue_name, city, country, and more columns."""
    key = ["venue_name", "city", "country"]
    ks = [f"k_{k}" for k in key]
    perf = _rolled(_summary(concerts).where("k_venue_name is not null"), *ks).select(*ks, "mean_share", "n")
    stored = venues.groupBy(*_low(*key)).agg(F.min(F.struct("venue_id", "verified")).alias("st"))
    t = _keyed(targets, *key).join(perf, ks, "left").join(stored, ks, "left")
    named = (F.coalesce("venue_name", F.lit("")) != "") & (F.coalesce("city", F.lit("")) != "")
    new = F.when(F.coalesce(F.col("st.verified"), F.lit(False)), 58.0).otherwise(48.0)
    seen = clamp(F.col("mean_share") * 76.0 + F.least(F.lit(12), F.col("n")), 0, 100)
    return t.select(*targets.columns, F.when(~named, F.lit(50.0)).when(F.col("n").isNull(), new).otherwise(seen).alias("venue_performance"))


def price_position(targets: DataFrame, concerts: DataFrame) -> DataFrame:
    """Where a ticket price lies against the mean of its city.  ``targets``: price, city, country."""
    market = _rolled(_summary(concerts), "k_city", "k_country").select("k_city", "k_country", "market", F.col("price_n").alias("n"))
    t = _keyed(targets, "city", "country").join(market, ["k_city", "k_country"], "left")
    ratio = F.col("price") / F.when(F.col("market") > 0, F.col("market"))
    score = (
        F.when(F.coalesce("price", F.lit(0.0)) == 0, 50.0).when(F.coalesce("n", F.lit(0)) < 3, 55.0).when(F.col("market") == 0, 50.0)
        .when(ratio.between(0.75, 1.25), 78.0).when((ratio > 1.25) & (ratio <= 1.55), 64.0).when((ratio < 0.75) & (ratio >= 0.5), 68.0).otherwise(42.0)
    )
    return t.select(*targets.columns, score.alias("ticket_pricing_intelligence"))


def seasonal_trend(day: Column) -> Column:
    boost = lookup.exact(F.month(day), SEASON_BOOST, 0).cast("double")
    return clamp(F.lit(48.0) + boost + F.when(demand.is_weekend(day), 10.0).otherwise(0.0), 0, 100)


def name_capacity(venue: Column) -> Column:
    """Capacity guessed from a whole word of the venue's name."""
    tokens = F.split(F.lower(F.coalesce(venue, F.lit(""))), r"\W+")
    guesses = [F.when(F.arrays_overlap(tokens, F.array(*map(F.lit, words))), n) for words, n in NAME_CAPACITY]
    return F.coalesce(*guesses, F.lit(5_000))


def resolve_inputs(events: DataFrame, venues: DataFrame, concerts: DataFrame) -> DataFrame:
    """Capacity and price for prediction with where each came from.

    ``events``: venue_name, city, country, price_min, price_max, and more columns.
    """
    key = ["venue_name", "city", "country"]
    ks = [f"k_{k}" for k in key]
    nz = lambda c: F.when(F.col(c) != 0, F.col(c))
    stored = venues.groupBy(*_low(*key)).agg(F.min(F.struct("venue_id", F.coalesce(nz("avg_capacity"), nz("capacity_max"), nz("capacity_min")).alias("cap"), nz("avg_ticket_price").alias("price"))).alias("st"))
    history = _rolled(_summary(concerts), "k_city", "k_country").select("k_city", "k_country", F.col("paid_price").alias("city_price"))
    t = _keyed(events, *key).join(stored, ks, "left").join(history, ["k_city", "k_country"], "left")
    scraped = normalize.avg_price(F.col("price_min"), F.col("price_max"))
    return t.select(
        *events.columns, F.coalesce(F.col("st.cap"), name_capacity(F.col("venue_name"))).cast("long").alias("venue_capacity"),
        F.when(F.col("st.cap").isNotNull(), "venue_db").otherwise("venue_name_estimate").alias("capacity_source"),
        F.coalesce(scraped, F.col("st.price"), F.col("city_price"), pricing.default_price(F.col("country"))).alias("price"),
        F.when(scraped.isNotNull(), "scraped_ticket_range").when(F.col("st.price").isNotNull(), "venue_db").when(F.col("city_price").isNotNull(), "city_history").otherwise("country_default").alias("price_source"),
    )


def build_features(events: DataFrame, artists: DataFrame, metrics: DataFrame, concerts: DataFrame, venues: DataFrame, demo: DataFrame, as_of: str) -> DataFrame:
    """The feature set of every event.

    ``events``: event_id, artist_id, venue_name, city, country, event_date, price_min, price_max.
    Each source is reduced to one row per artist, city or venue before it meets the events.
    """
    concerts = cut_lineage(concert_summary(concerts))
    t = resolve_inputs(events, venues, concerts)
    t = price_position(venue_performance(city_demand(t, concerts, demo), concerts, venues), concerts)
    t = (
        t.join(ts.artist_momentum(metrics), "artist_id", "left").join(ts.engagement_velocity(metrics), "artist_id", "left")
        .join(popularity.popularity_service(artists).select("artist_id", F.col("popularity").alias("gp")), "artist_id", "left")
    )
    none = F.lit(45.0)
    t = t.withColumns({
        "artist_momentum": F.coalesce("artist_momentum", none),
        "engagement_velocity": F.coalesce("engagement_velocity", F.when(F.col("gp").isNull(), 45.0).otherwise(50.0)),
        "global_popularity": F.coalesce("gp", none), "seasonal_trends": seasonal_trend(F.col("event_date")),
    })
    t = t.withColumn("local_popularity", clamp(F.col("global_popularity") * 0.52 + F.col("city_demand") * 0.32 + F.col("artist_momentum") * 0.16, 0, 100))
    r2 = [half_up(F.col(c), 2).alias(c) for c in FEATURE_WEIGHTS]
    return t.select(
        *events.columns, *r2, F.greatest(F.lit(100), F.col("venue_capacity")).alias("venue_capacity"), half_up(F.greatest(F.lit(1.0), F.col("price")), 2).alias("avg_ticket_price"),
        F.datediff("event_date", F.lit(as_of).cast("date")).alias("days_until_event"), demand.is_weekend(F.col("event_date")).alias("is_weekend"),
        "capacity_source", "price_source",
    )


def predict_from_features(features: DataFrame) -> DataFrame:
    """Demand, sell-out probability, attendance and revenue."""
    raw = None
    for c, w in FEATURE_WEIGHTS.items():
        raw = F.col(c) * w if raw is None else raw + F.col(c) * w
    df = features.withColumn("d", clamp(raw, 0, 100))
    cap = F.col("venue_capacity")
    p = F.lit(0.18) + F.col("d") / 115.0 + F.when(cap < 1000, 0.08).when(cap > 20000, -0.08).otherwise(0.0)
    p = p + F.when(F.col("days_until_event") < 0, -0.05).otherwise(0.0) + F.when(F.col("is_weekend"), 0.04).otherwise(0.0)
    df = df.withColumn("p", clamp(p, 0.05, 0.99))
    df = df.withColumn("expected_attendance", F.least(cap, F.greatest(F.lit(0), half_up(cap * F.col("p")).cast("long"))))
    return df.select(
        *features.columns, half_up(F.col("d"), 2).alias("demand_score"), half_up(F.col("p"), 4).alias("sellout_probability"), "expected_attendance",
        half_up(F.col("expected_attendance") * F.col("avg_ticket_price"), 2).alias("expected_revenue"),
    )


def prediction_accuracy(preds: DataFrame, concerts: DataFrame) -> DataFrame:
    """100 minus the relative error in percent, 0 without actual revenue."""
    df = preds.join(concerts.where("total_revenue <> 0").select("concert_id", "total_revenue"), "concert_id")
    a, p = F.col("total_revenue"), F.col("expected_revenue")
    score = clamp((F.lit(1.0) - F.abs(a - p) / F.when(a > 0, a)) * 100.0, 0, 100)
    return df.withColumn("accuracy", F.when(a > 0, half_up(score, 2)).otherwise(F.lit(0.0)))
