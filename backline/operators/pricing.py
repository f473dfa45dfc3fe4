"""Ticket price tiers, sales and profitability as column formulas over whole tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from backline.functions import lookup
from backline.functions.refdata import BATCH_BOOST, BATCH_RATES_TO_INR, GRID_CITIES, PRICING_BOOST, USD_RATES, VENUE_MULTIPLIERS
from backline.functions.rounding import cents_sum, clamp, half_even, half_up
from backline.operators import money
from backline.operators.demand import major_market

TIERS = ("vip", "tier1", "tier2", "tier3")


def _boost(city: Column, table: dict) -> Column:
    return lookup.exact(F.lower(F.coalesce(city, F.lit(""))), table, 0).cast("double")


def _venue_factor(kind: Column) -> Column:
    return lookup.first_contained(F.lower(F.trim(F.coalesce(kind, F.lit("")))), VENUE_MULTIPLIERS, 1.0)


def price_tiers(df: DataFrame, boosts: dict = PRICING_BOOST) -> DataFrame:
    """Four tier prices and their weighted mean in INR.

    Input columns: artist_popularity, city_popularity, venue_capacity, city, venue_type.
    """
    scarcity = lookup.bands(F.col("venue_capacity"), [(500, 1.3), (2000, 1.1), (10000, 1.0), (30000, 0.9)], 0.75)
    market = F.lit(1.0) + _boost(F.col("city"), boosts) / 100.0
    raw = (F.lit(800.0) + F.col("artist_popularity") * 12.0 + F.col("city_popularity") * 8.0) * market * scarcity * _venue_factor(F.col("venue_type"))
    base = F.greatest(F.lit(500.0), raw)
    out = df
    for name, k in zip(TIERS, (4.5, 2.2, 1.0, 0.5)):
        out = out.withColumn(name, half_even(base * k))
    return out.withColumn("mean_price", F.col("vip") * 0.10 + F.col("tier1") * 0.20 + F.col("tier2") * 0.40 + F.col("tier3") * 0.30)


def share_sold(demand: Column, capacity: Column) -> Column:
    """Sell-through from demand, stretched for small rooms and held to 15-90 %."""
    size = lookup.bands(capacity, [(1000, 1.3), (5000, 1.1), (20000, 1.0)], 0.8)
    return clamp(clamp(F.lit(0.25) + (demand - 10.0) / 85.0 * 0.5, 0.15, 0.85) * size, 0.15, 0.90)


def predict_sales(df: DataFrame, boosts: dict = PRICING_BOOST) -> DataFrame:
    demand = clamp(F.col("city_popularity") * 0.65 + F.col("artist_popularity") * 0.25 + _boost(F.col("city"), boosts) * 0.3, 10, 95)
    out = df.withColumn("demand_score", demand)
    sold = half_even(F.col("venue_capacity") * share_sold(F.col("demand_score"), F.col("venue_capacity")))
    return out.withColumn("tickets_sold", F.least(sold, F.floor("venue_capacity").cast("double")).cast("long"))


def pricing_report(df: DataFrame) -> DataFrame:
    """Prices, sales and revenue in the target ``currency`` and in USD."""
    out = predict_sales(price_tiers(df))
    code = F.upper(F.coalesce(F.when(F.col("currency") != "", F.col("currency")), F.lit("INR")))
    cross = F.when(code == "INR", F.lit(1.0)).otherwise(F.lit(1.0 / USD_RATES["INR"]) * money.usd_rate(code))
    out = out.withColumn("currency", code).withColumn("local_price", F.col("mean_price") * cross)
    out = out.withColumn("local_revenue", F.col("tickets_sold") * F.col("local_price"))
    return out.select(
        *[c for c in df.columns if c != "currency"], "currency", *TIERS, "tickets_sold",
        half_even(F.col("local_price"), 2).alias("avg_ticket_price"), half_even(F.col("local_revenue"), 2).alias("total_revenue"),
        half_even(F.col("demand_score"), 2).alias("demand_score"),
        money.local_to_usd(F.col("local_revenue"), code).alias("total_revenue_usd"),
        money.local_to_usd(F.col("local_price"), code).alias("avg_ticket_price_usd"),
        money.usd_rate(code).alias("exchange_rate"),
    )


def price_all_concerts(df: DataFrame, multiply_by_rate: bool = False) -> DataFrame:
    """Batch pricing of every concert with clamped inputs and a sell-out probability.

    The tier formula is in INR already; ``multiply_by_rate`` keeps the older second conversion.
    """
    pop = clamp(F.coalesce(F.col("artist_popularity").cast("double"), F.lit(50.0)), 0, 100)
    stored = F.col("capacity")
    clean = df.withColumn("artist_popularity", pop).withColumn(
        "city_popularity", clamp(F.coalesce(F.col("city_popularity").cast("double"), F.col("artist_popularity")), 0, 100)
    ).withColumn("venue_capacity", F.greatest(F.lit(100.0), half_even(F.coalesce(F.when(stored != 0, stored), F.lit(5000)).cast("double"))))
    out = predict_sales(price_tiers(clean, BATCH_BOOST), BATCH_BOOST)
    rate = lookup.exact(F.upper(F.coalesce("currency", F.lit("INR"))), BATCH_RATES_TO_INR, 1.0) if multiply_by_rate else F.lit(1.0)
    price = F.col("mean_price") * rate
    out = out.withColumn("avg_ticket_price", half_even(price, 2)).withColumn("total_revenue", half_even(F.col("tickets_sold") * price, 2))
    ratio = F.col("tickets_sold") / F.when(stored > 0, stored.cast("double"))
    return out.withColumn("sellout_probability", F.when(stored > 0, half_up(F.least(F.lit(0.99), ratio), 4)).otherwise(F.lit(0.0))).withColumn(
        "demand_score", half_even(F.col("demand_score"), 2)
    )


def price_fallback(df: DataFrame) -> DataFrame:
    """Simpler pricing used when the main one is not available."""
    a = F.col("artist_popularity").cast("double")
    c = F.coalesce(F.when(F.col("city_popularity") != 0, F.col("city_popularity")), a)
    cap = F.greatest(F.lit(100.0), half_up(F.coalesce(F.when(F.col("capacity") != 0, F.col("capacity")), F.lit(5000)).cast("double")))
    out = df.withColumn("venue_capacity", cap)
    boost = major_market(F.col("city"), 8)
    scarcity = F.when(F.col("venue_capacity") < 1000, 1.18).when(F.col("venue_capacity") > 20000, 0.88).otherwise(1.0)
    base = F.greatest(F.lit(250.0), (F.lit(350.0) + a * 14.0 + c * 9.0) * (F.lit(1.0) + boost / 100.0) * scarcity)
    for name, k in zip(TIERS, (3.1, 1.55, 1.0, 0.62)):
        out = out.withColumn(name, half_up(base * k))
    mean = F.col("vip") * 0.08 + F.col("tier1") * 0.22 + F.col("tier2") * 0.38 + F.col("tier3") * 0.32
    demand = clamp(c * 0.72 + a * 0.18 + boost, 5, 100)
    sold = F.least(F.col("venue_capacity"), half_up(F.col("venue_capacity") * clamp(F.lit(0.22) + demand / 125.0, 0.15, 0.97)))
    return (
        out.withColumn("mean", mean).withColumn("tickets_sold", sold.cast("long")).withColumn("demand_score", half_up(demand, 2))
        .withColumn("avg_ticket_price", half_up(F.col("mean"), 2)).withColumn("total_revenue", half_up(F.col("tickets_sold") * F.col("mean"), 2)).drop("mean")
    )


def tiers_from_avg(avg: Column) -> dict[str, Column]:
    """Tier prices and a price range derived from one mean price."""
    low = F.greatest(F.lit(1.0), avg)
    return {
        "vip": half_up(avg * 2.5), "tier1": half_up(avg * 1.35), "tier2": half_up(avg), "tier3": half_up(avg * 0.65),
        "price_min": half_up(low * 0.75 * 100.0) / 100.0, "price_max": half_up(low * 1.85 * 100.0) / 100.0,
    }


def default_price(country: Column) -> Column:
    from backline.functions.refdata import EURO_COUNTRIES

    c = F.lower(F.coalesce(country, F.lit("")))
    return (
        F.when(c.contains("india"), 1250.0).when(c.contains("united states") | (c == "usa"), 65.0)
        .when(c.contains("united kingdom"), 50.0).when(c.contains("australia"), 75.0).when(c.contains("canada"), 70.0)
        .when(lookup.any_contained(c, EURO_COUNTRIES), 55.0).otherwise(45.0)
    )


def city_profitability(artists: DataFrame, concerts: DataFrame) -> DataFrame:
    """Every artist in each of the eight grid cities: tickets, revenue, sponsors, return."""
    per = concerts.groupBy("artist_id").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.coalesce("tickets_sold", F.lit(0))).cast("double").alias("t"),
        cents_sum(F.coalesce("total_revenue", F.lit(0.0))).alias("r"), cents_sum(F.coalesce("avg_ticket_price", F.lit(0.0))).alias("p"),
    )
    nz = lambda c: F.when(c != 0, c)
    df = artists.select("artist_id").join(per, "artist_id", "left").select(
        "artist_id",
        F.coalesce(nz(F.floor(F.col("t") / F.col("n")).cast("double")), F.lit(15000.0)).alias("avg_tickets"),
        F.coalesce(nz(F.col("p") / F.col("n")), nz(F.try_divide("r", "t")), F.lit(2000.0)).alias("avg_price"),
    )
    grid = F.array(*[F.struct(F.lit(c).alias("city"), F.lit(m).alias("multiplier"), F.lit(float(d)).alias("demand")) for c, m, d in GRID_CITIES])
    df = df.withColumn("g", F.explode(grid)).select("artist_id", "avg_tickets", "avg_price", "g.*")
    df = df.withColumn("capacity", F.floor(F.col("avg_tickets") * 1.2 * F.col("multiplier")).cast("double")).withColumn(
        "tickets", F.floor(F.col("avg_tickets") * F.col("multiplier")).cast("double"))
    df = df.withColumn("price", F.col("avg_price") * F.col("multiplier")).withColumn("ticket_revenue", F.col("tickets") * F.col("price"))
    df = df.withColumn("sponsor_revenue", F.col("ticket_revenue") * 0.18 * (F.col("demand") / 100.0)).withColumn(
        "total_revenue", F.col("ticket_revenue") + F.col("sponsor_revenue"))
    cost = F.col("total_revenue") * 0.45
    return df.select(
        "artist_id", "city", "capacity", "tickets", half_up(F.col("price"), 4).alias("price"),
        half_up(F.col("ticket_revenue"), 2).alias("ticket_revenue"), half_up(F.col("sponsor_revenue"), 2).alias("sponsor_revenue"),
        half_up(F.col("total_revenue"), 2).alias("total_revenue"),
        half_up(F.when(F.col("capacity") > 0, F.least(F.col("tickets") / F.when(F.col("capacity") > 0, F.col("capacity")), F.lit(0.99))).otherwise(0.0) * 100.0, 4).alias("sell_through"),
        half_up(F.when(F.col("total_revenue") > 0, (F.col("total_revenue") - cost) / F.when(cost > 0, cost) * 100.0).otherwise(0.0), 4).alias("roi"),
        F.least(half_up(F.col("demand") * 0.6 + F.col("tickets") / 50000.0 * 40.0), F.lit(99.0)).alias("popularity_score"),
        "demand",
    )


def apply_prediction(grid: DataFrame, preds: DataFrame) -> DataFrame:
    """Replace a grid cell by the model result for that artist and city, where there is one.

    ``preds``: artist_id, city, venue_capacity, avg_ticket_price, predicted_revenue,
    demand_score_used, confidence.
    """
    p = preds.select("artist_id", "city", *[F.col(c).alias(f"m_{c}") for c in ("venue_capacity", "avg_ticket_price", "predicted_revenue", "demand_score_used", "confidence")])
    df = grid.join(p, ["artist_id", "city"], "left")
    hit = F.coalesce(F.col("m_predicted_revenue"), F.lit(0.0)) > 0
    nz = lambda c, d: F.coalesce(F.when(F.col(c) != 0, F.col(c)), F.col(d))
    df = df.withColumn("hit", hit).withColumn("cap2", nz("m_venue_capacity", "capacity").cast("double")).withColumn("price2", nz("m_avg_ticket_price", "price"))
    sold = F.when((F.col("cap2") > 0) & (F.col("price2") > 0), F.least(F.col("cap2"), half_up(F.try_divide("m_predicted_revenue", "price2")))).otherwise(F.col("tickets"))
    df = df.withColumn("tickets2", sold)
    pick = lambda new, old: F.when(F.col("hit"), new).otherwise(F.col(old)).alias(old)
    score = nz("m_demand_score_used", "demand")
    return df.select(
        "artist_id", "city", pick(F.col("cap2"), "capacity"), pick(F.col("tickets2"), "tickets"), pick(F.col("price2"), "price"),
        pick(F.col("m_predicted_revenue"), "ticket_revenue"), pick(F.lit(0.0), "sponsor_revenue"), pick(F.col("m_predicted_revenue"), "total_revenue"),
        pick(half_up(F.when(F.col("cap2") > 0, F.col("tickets2") / F.when(F.col("cap2") > 0, F.col("cap2")) * 100.0).otherwise(F.col("sell_through")), 4), "sell_through"),
        pick(half_up((F.col("m_predicted_revenue") - F.col("m_predicted_revenue") * 0.45) / F.when(hit, F.col("m_predicted_revenue") * 0.45) * 100.0, 4), "roi"),
        pick(F.least(F.lit(99.0), half_up(nz("m_demand_score_used", "popularity_score"))), "popularity_score"),
        pick(half_up(score), "demand"), F.when(F.col("hit"), half_up(F.coalesce("m_confidence", F.lit(0.0)) * 100.0)).alias("confidence"),
    )


def sponsor_split(concerts: DataFrame, share: float = 0.15) -> DataFrame:
    """Detail-page split of revenue into tickets and sponsors."""
    rev = F.coalesce("total_revenue", F.lit(0.0))
    return concerts.withColumn("sponsor_revenue", half_up(rev * share, 2)).withColumn("ticket_revenue", half_up(rev - rev * share, 2))
