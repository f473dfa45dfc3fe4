"""Constraint checks, event validation, repair and audit of concert rows."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, functions as F

from backline.functions import lookup
from backline.functions.refdata import DEFAULT_PRICE_RANGE, PRICE_RANGES
from backline.functions.rounding import clamp, half_even, half_up
from backline.operators.reports import avg_price_by
from backline.sources.tables import apply_updates

# --- fixed values ---------------------------------------------------------------------------
PLATFORM_NAMES = ["facebook", "instagram", "twitter", "youtube", "spotify", "apple_music", "reddit", "quora"]
DIMENSIONS = ["AGE_GROUP", "GENDER", "GEOGRAPHY", "GENRE"]
TRUSTED_SOURCES = ["BOOKMYSHOW", "SONGKICK", "BANDSINTOWN", "EVENTBRITE", "SETLIST_FM"]
TRUSTED_DOMAINS = ["bookmyshow.com", "songkick.com", "bandsintown.com", "eventbrite.com", "ticketmaster.com", "insider.in"]
SCRAPED_SOURCES = ["setlistfm", "songkick", "bookmyshow", "district"]
DEFAULT_PRICE = 1500.0


def _between(c: str, low: float, high: float) -> Column:
    return F.col(c).isNull() | F.col(c).between(low, high)


def _least(c: str, low: float, strict: bool = False) -> Column:
    return F.col(c).isNull() | (F.col(c) > low if strict else F.col(c) >= low)


def concert_rules() -> dict[str, Column]:
    """What a concert row must satisfy, by rule name."""
    return {
        "city required": F.coalesce("city", F.lit("")) != "", "country required": F.coalesce("country", F.lit("")) != "",
        "date required": F.col("concert_date").isNotNull(), "capacity positive": _least("capacity", 0, True),
        "tickets not negative": _least("tickets_sold", 0), "price positive": _least("avg_ticket_price", 0, True),
        "revenue positive": _least("total_revenue", 0, True), "demand 0-100": _between("demand_score", 0, 100),
        "currency code": F.col("currency").isNull() | (F.length("currency") == 3),
    }


def place_rules() -> dict[str, Column]:
    return {"latitude range": _between("latitude", -90, 90), "longitude range": _between("longitude", -180, 180)}


def metric_rules() -> dict[str, Column]:
    counts = {f"{c} not negative": _least(c, 0) for c in ("followers", "streams", "likes", "comments", "shares")}
    return {"platform known": F.lower("platform").isin(PLATFORM_NAMES), "date required": F.col("date").isNotNull(), **counts}


def demographic_rules() -> dict[str, Column]:
    return {
        "dimension known": F.col("dimension").isin(DIMENSIONS), "percentage 0-100": _between("percentage", 0, 100),
        "count not negative": _least("absolute_count", 0), "value required": F.col("dimension_value").isNotNull() & (F.length("dimension_value") <= 100),
        "artist or concert": F.col("artist_id").isNotNull() | F.col("concert_id").isNotNull(),
    }


def check_constraints(df: DataFrame, rules: Mapping[str, Column]) -> tuple[DataFrame, DataFrame]:
    """(rows that pass every rule, rejected rows with ``failed``: the names of the broken rules)."""
    failed = F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()]))
    marked = df.withColumn("failed", failed)
    return marked.where(F.size("failed") == 0).drop("failed"), marked.where(F.size("failed") > 0)


# --- event validation -----------------------------------------------------------------------


def trusted_host(url: Column) -> Column:
    host = F.lower(F.try_parse_url(url, F.lit("HOST")))
    ok = host.isin(TRUSTED_DOMAINS)
    for d in TRUSTED_DOMAINS:
        ok = ok | host.endswith(f".{d}")
    return F.coalesce(ok, F.lit(False))


def validate_events(events: DataFrame, venues: DataFrame, as_of: str) -> DataFrame:
    """Rule scores, confidence, fraud risk, status and reasons of normalised events.

    ``events`` carry ``confirmations`` (source references, null counts as one) and ``duplicate``.
    """
    low = lambda c: F.lower(F.col(c))
    have = venues.select(low("venue_name").alias("k0"), low("city").alias("k1"), low("country").alias("k2")).distinct().withColumn("venue_exists", F.lit(True))
    df = events.withColumns({"k0": low("venue_name"), "k1": low("city"), "k2": low("country")}).join(have, ["k0", "k1", "k2"], "left").drop("k0", "k1", "k2")
    has = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    url, dup = has("source_url"), F.coalesce("duplicate", F.lit(False))
    df = df.withColumns({
        "trusted": F.upper("source_platform").isin(TRUSTED_SOURCES) | trusted_host(F.col("source_url")), "ticketed": has("official_ticket_url") | url,
        "venue_exists": F.coalesce("venue_exists", F.lit(False)), "verified": F.coalesce("verified_artist_account", F.lit(False)),
        "sources": F.greatest(F.lit(1), F.coalesce("confirmations", F.lit(1))), "dup": dup,
        "priced": F.col("price_min").isNotNull() | F.col("price_max").isNotNull(),
    })
    on = lambda c, a, b=0.0: F.when(F.col(c), a).otherwise(b)
    df = df.withColumns({
        "s_trust": on("trusted", 0.22), "s_ticket": on("ticketed", 0.18), "s_venue": on("venue_exists", 0.18, 0.05), "s_account": on("verified", 0.12),
        "s_sources": F.least(F.lit(0.22), (F.col("sources") - 1) * 0.11), "s_dup": on("dup", -0.12),
    })
    scores = ["s_trust", "s_ticket", "s_venue", "s_account", "s_sources", "s_dup"]
    rules = sum((F.col(s) for s in scores[1:]), F.col(scores[0]))
    filled = sum((F.when(has(c), 1).otherwise(0) for c in ("venue_name", "city", "country", "source_url")), F.when(has("artist_name"), 1).otherwise(0)) + F.when(F.col("event_date").isNotNull(), 1).otherwise(0)
    conf = clamp(on("trusted", 0.22, 0.12) + F.col("confidence_score") * 0.2 + filled / 6.0 * 0.12 + rules, 0, 1)
    risk = F.lit(0.5) - F.col("s_trust") - F.col("s_ticket") * 0.75 - F.col("s_venue") * 0.7 - F.col("s_sources") * 0.6
    risk = risk + on("dup", 0.08) + F.when(F.col("event_date") < F.date_sub(F.lit(as_of).cast("date"), 1), 0.05).otherwise(0.0)
    risk = clamp(risk + F.when(url, 0.0).otherwise(0.08) + on("priced", 0.0, 0.03), 0, 1)
    df = df.withColumns({"confidence": half_up(conf, 4), "fraud_risk": half_up(risk, 4)})
    status = (
        F.when(F.col("dup"), "DUPLICATE").when((F.col("confidence") >= 0.76) & (F.col("fraud_risk") <= 0.38), "VALIDATED")
        .when((F.col("confidence") < 0.42) | (F.col("fraud_risk") >= 0.72), "REJECTED").otherwise("REVIEW_REQUIRED")
    )
    df = df.withColumn("status", status)
    reasons = F.array_compact(F.array(
        F.concat(F.lit("status="), "status"), F.when(F.col("trusted"), F.concat(F.lit("trusted source "), "source_platform")), F.when(F.col("ticketed"), F.lit("ticket URL present")),
        F.when(F.col("venue_exists"), F.lit("venue exists in venue database")), F.when(F.col("verified"), F.lit("verified artist source account")),
        F.when(F.col("sources") > 1, F.concat(F.col("sources").cast("string"), F.lit(" source confirmations"))), F.when(F.col("dup"), F.lit("duplicate candidate detected")),
        F.when(~url, F.lit("missing source URL")), F.when(F.col("s_venue") <= 0.05, F.lit("venue not yet verified")),
    ))
    names = ["trusted_source", "official_ticket_url", "venue_existence", "verified_artist_account", "multiple_confirmations", "duplicate_penalty"]
    as_map = F.create_map(*[x for n, s in zip(names, scores) for x in (F.lit(n), F.col(s))])
    return df.select(*events.columns, "confidence", "fraud_risk", "status", reasons.alias("reasons"), as_map.alias("rule_scores"))


# --- concert repair -------------------------------------------------------------------------


def _popular_share(pop: Column) -> Column:
    p = F.coalesce(F.when(pop != 0, pop), F.lit(50.0))
    return clamp(F.lit(0.30) + p / 100.0 * 0.65, 0.30, 0.95)


def _tickets_at(capacity: Column, share: Column) -> Column:
    return F.least(F.floor(capacity * share), capacity).cast("long")


def repair_concerts(concerts: DataFrame, artists: DataFrame) -> DataFrame:
    """Repairs in fixed order: oversold, very low scraped sell-through, missing revenue, status."""
    df = concerts.join(artists.select("artist_id", F.col("popularity").alias("pop"), F.lit(True).alias("known")), "artist_id", "left")
    t, c, p, r = (F.col(x) for x in ("tickets_sold", "capacity", "avg_ticket_price", "total_revenue"))
    over = F.coalesce((t > c) & (c > 0), F.lit(False))
    df = df.withColumn("over", over).withColumn("tickets_sold", F.when(over, F.round(c * F.lit(0.85).cast("decimal(3,2)")).cast("long")).otherwise(t))
    df = df.withColumn("total_revenue", F.when(F.col("over"), t * F.coalesce(p, F.lit(DEFAULT_PRICE))).otherwise(r))
    weak = F.coalesce(F.col("known") & (c > 0) & (t > 0) & (t.cast("double") / F.when(c > 0, c) < 0.20) & F.col("source").isin(SCRAPED_SOURCES), F.lit(False))
    df = df.withColumn("weak", weak).withColumn("tickets_sold", F.when(F.col("weak"), _tickets_at(c, _popular_share(F.col("pop")))).otherwise(t))
    price = F.coalesce(F.when(p != 0, p), F.lit(DEFAULT_PRICE))
    df = df.withColumn("total_revenue", F.when(F.col("weak"), half_even(t * price, 2)).otherwise(r))
    df = df.withColumn("total_revenue", F.when((F.coalesce(r, F.lit(0.0)) == 0) & (t > 0) & (p > 0), t * p).otherwise(r))
    done = (r > 0) & (t > 0) & (c > 0) & (F.col("verification_status") == "PENDING") & F.col("source").isNotNull() & (F.col("source") != "setlistfm")
    df = df.withColumn("verification_status", F.when(done, "VERIFIED").otherwise(F.col("verification_status")))
    return df.select(*concerts.columns)


def audit_concerts(concerts: DataFrame, evidence: DataFrame | None = None) -> DataFrame:
    """Issues and corrections per concert.

    ``evidence``: (concert_id, web_capacity), a capacity found elsewhere for that concert.
    """
    df = concerts.where("capacity > 0 or tickets_sold > 0 or total_revenue > 0")
    df = df.join(evidence, "concert_id", "left") if evidence is not None else df.withColumn("web_capacity", F.lit(None).cast("long"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    df = df.withColumns({"cap": zero("capacity"), "t": zero("tickets_sold"), "p": zero("avg_ticket_price").cast("double"), "r": zero("total_revenue").cast("double"), "web": zero("web_capacity")})
    cap, t, web = F.col("cap"), F.col("t"), F.col("web")
    ratio = web / F.when(cap > 0, cap.cast("double"))
    low = (web > 0) & (cap > 0) & (ratio > 1.5) & (ratio <= 5.0)
    high = (web >= 1000) & (cap > 0) & ~low & (cap > web * 2.5)
    none = (web > 0) & (cap == 0)
    df = df.withColumns({"low": low, "high": high, "none": none}).withColumn("new_capacity", F.when(F.col("low") | F.col("high") | F.col("none"), web))
    df = df.withColumn("eff", F.coalesce("new_capacity", "cap"))
    over = (t > F.col("eff")) & (F.col("eff") > 0)
    df = df.withColumn("over", over).withColumn("negative", t < 0)
    df = df.withColumn("new_tickets", F.when(F.col("over"), F.floor(F.col("eff") * 0.90)).when(F.col("negative"), F.lit(0)).cast("long"))
    # a negative count is corrected but still counts as sold below, as in the rule it follows
    df = df.withColumn("sold", F.when(F.col("over"), F.col("new_tickets")).otherwise(t))
    st = F.when(F.col("eff") > 0, F.col("sold") / F.when(F.col("eff") > 0, F.col("eff").cast("double")) * 100.0).otherwise(0.0)
    name = F.lower(F.coalesce("country", F.lit("")))
    lo = lookup.first_contained(name, {k: float(a) for k, (a, _) in PRICE_RANGES.items()}, float(DEFAULT_PRICE_RANGE[0]))
    hi = lookup.first_contained(name, {k: float(b) for k, (_, b) in PRICE_RANGES.items()}, float(DEFAULT_PRICE_RANGE[1]))
    p, r = F.col("p"), F.col("r")
    odd_price = (p > 0) & ((p < lo * 0.3) | (p > hi * 3))
    expected = F.col("sold") * p
    full = (F.col("sold") > 0) & (p > 0) & (r > 0)
    share = r / F.when(expected > 0, expected)
    off = full & ((share > 2.5) | (share < 0.3))
    missing = (r == 0) & (F.col("sold") > 0) & (p > 0)
    df = df.withColumns({"off": off, "missing": missing, "odd_price": odd_price, "st": st})
    df = df.withColumn("new_revenue", F.when(F.col("off") | F.col("missing"), half_even(expected, 2)))
    issues = F.array_compact(F.array(
        F.when(F.col("low"), F.lit("capacity may be too low")), F.when(F.col("high"), F.lit("capacity may be too high")), F.when(F.col("none"), F.lit("capacity was 0")),
        F.when(F.col("over"), F.lit("tickets above capacity")), F.when(F.col("negative"), F.lit("tickets were negative")), F.when(F.col("st") > 100, F.lit("sell-through above 100%")),
        F.when(F.col("odd_price"), F.lit("price outside expected range")), F.when(F.col("off"), F.lit("revenue inconsistent with tickets and price")), F.when(F.col("missing"), F.lit("revenue was 0")),
    ))
    corrected = F.col("new_capacity").isNotNull() | F.col("new_tickets").isNotNull() | F.col("new_revenue").isNotNull()
    return df.select("concert_id", "country", issues.alias("issues"), "new_capacity", "new_tickets", "new_revenue", corrected.alias("corrected"), half_even(F.col("st"), 1).alias("sell_through")).withColumn("issue_count", F.size("issues"))


def apply_corrections(concerts: DataFrame, audit: DataFrame) -> DataFrame:
    """Corrected values over the stored ones; rows without a correction carry nulls and change nothing."""
    new = audit.select("concert_id", F.col("new_capacity").alias("capacity"), F.col("new_tickets").alias("tickets_sold"), F.col("new_revenue").alias("total_revenue"))
    return apply_updates(concerts, new, "concert_id")


def flag_status(concerts: DataFrame) -> DataFrame:
    """Empty rows are PENDING, pending rows with revenue and tickets VERIFIED; nulls change nothing."""
    r, t, s = F.col("total_revenue"), F.col("tickets_sold"), F.col("verification_status")
    return concerts.withColumn("verification_status", F.when((r == 0) & (t == 0), "PENDING").when((r > 0) & (t > 0) & (s == "PENDING"), "VERIFIED").otherwise(s))


def predict_empty(concerts: DataFrame, artists: DataFrame) -> DataFrame:
    """Tickets, price and revenue for concerts with a capacity and neither tickets nor revenue."""
    price = avg_price_by(concerts, ["artist_id"], DEFAULT_PRICE)
    df = concerts.join(artists.select("artist_id", F.col("popularity").alias("pop")), "artist_id", "left").join(price, "artist_id", "left")
    empty = F.coalesce((F.col("capacity") > 0) & (F.coalesce("total_revenue", F.lit(0.0)) == 0) & (F.coalesce("tickets_sold", F.lit(0)) == 0), F.lit(False))
    atp = F.when(F.col("avg_ticket_price") > 0, F.col("avg_ticket_price")).otherwise(F.coalesce("mean_price", F.lit(DEFAULT_PRICE)))
    df = df.withColumns({"empty": empty, "atp": atp, "tix": _tickets_at(F.col("capacity"), _popular_share(F.col("pop")))})
    pick = lambda new, old: F.when(F.col("empty"), new).otherwise(F.col(old))
    df = df.withColumns({
        "total_revenue": pick(half_even(F.col("tix") * F.col("atp"), 2), "total_revenue"), "tickets_sold": pick(F.col("tix"), "tickets_sold"),
        "avg_ticket_price": pick(half_even(F.col("atp"), 2), "avg_ticket_price"),
    })
    return df.select(*concerts.columns)
