"""Sheets and saved API payloads turned into metric and concert rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from backline.functions import dates, lookup
from backline.functions.rounding import half_up
from backline.operators import normalize
from backline.schemas import TABLES, TRAINING_ROW
from backline.sources.tables import upsert

# --- fixed values: url slugs and page titles ------------------------------------------------
CITY_SLUGS = {
    "mumbai": "Mumbai", "delhi-ncr": "Delhi", "bengaluru": "Bangalore", "hyderabad": "Hyderabad", "chennai": "Chennai",
    "pune": "Pune", "kolkata": "Kolkata", "ahmedabad": "Ahmedabad", "kochi": "Kochi",
}
TITLE_LISTINGS = ["music shows in", "upcoming events", "explore", "near you"]
SITE_RULES = {
    "bookmyshow": {"domain": "bookmyshow", "suffixes": [" - BookMyShow", " | BookMyShow"], "min_year": 2025},
    "district": {"domain": "district.in", "suffixes": [" - District", " | "], "min_year": 2025},
    "songkick": {"domain": "songkick.com", "suffixes": [" | Songkick", " - Songkick"], "min_year": 2024},
}
SETLIST = "eventDate string, url string, tour struct<name:string>, venue struct<name:string, city:struct<name:string, country:struct<name:string, code:string>>>"
RESULT = "title string, snippet string, link string, date string, address array<string>, venue struct<name:string>"


def read_table(spark: SparkSession, name: str, path: str) -> DataFrame:
    """A data-model table with its declared schema; filters and columns push to the scan."""
    return spark.read.schema(TABLES[name]).parquet(path)


def read_training_csv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(TRAINING_ROW).option("header", True).csv(path)


def read_metric_stream(spark: SparkSession, path: str) -> DataFrame:
    return spark.readStream.schema(TABLES["platform_metrics"]).parquet(path)


def split_valid(rows: DataFrame, required: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(complete rows, rejected rows with the missing columns as ``reason``)."""
    missing = F.array_compact(F.array(*[
        F.when(F.coalesce(F.trim(F.col(c).cast("string")), F.lit("")) == "", F.lit(c)) for c in required
    ]))
    marked = rows.withColumn("missing", missing)
    bad = marked.where(F.size("missing") > 0).withColumn("reason", F.concat(F.lit("missing "), F.array_join("missing", ", "))).drop("missing")
    return marked.where(F.size("missing") == 0).drop("missing"), bad


def import_metrics(rows: DataFrame, artists: DataFrame, metrics: DataFrame) -> DataFrame:
    """Sheet rows upserted into the metric table.

    The artist is matched by exact name.  Of several sheet rows with one key the last (``seq``)
    counts.  On update a missing or zero measure keeps the old value.
    """
    names = artists.groupBy("artist_name").agg(F.min("artist_id").alias("artist_id"))
    measures = ["followers", "streams", "likes", "comments", "shares"]
    day = F.try_to_timestamp("date").cast("date")
    new = rows.join(names, "artist_name").select(
        "artist_id", F.lower(F.trim("platform")).alias("platform"), day.alias("date"), "seq",
        *[F.coalesce(F.col(m).try_cast("bigint"), F.lit(0)).alias(m) for m in measures],
    ).where("date is not null and platform <> ''")
    last = new.groupBy("artist_id", "platform", "date").agg(F.max(F.struct("seq", *measures)).alias("r")).select("artist_id", "platform", "date", "r.*").drop("seq")
    base = metrics.select("artist_id", "platform", "date", *measures)
    return upsert(base, last, ["artist_id", "platform", "date"], {m: lambda new, old: F.coalesce(F.when(new != 0, new), old, F.lit(0)) for m in measures})


def import_concerts(rows: DataFrame, artists: DataFrame) -> DataFrame:
    """Sheet rows as concerts: price from the first present column, revenue from tickets x price."""
    names = artists.groupBy("artist_name").agg(F.min("artist_id").alias("artist_id"))
    num = lambda c: F.col(c).try_cast("double")
    price = F.coalesce(num("avg_ticket_price"), num("atp"), num("ticket_price"))
    tickets = F.coalesce(num("tickets_sold"), F.lit(0.0))
    df = rows.join(names, "artist_name").select(
        "artist_id", F.try_to_timestamp("date").cast("date").alias("concert_date"), "city",
        F.coalesce(F.nullif(F.trim("country"), F.lit("")), F.lit("India")).alias("country"), "venue_name",
        num("capacity").cast("long").alias("capacity"), tickets.cast("long").alias("tickets_sold"), price.alias("avg_ticket_price"),
        F.coalesce(F.when(num("total_revenue") > 0, num("total_revenue")), F.when((tickets > 0) & (price > 0), half_up(tickets * price, 2)), F.lit(0.0)).alias("total_revenue"),
        F.lit("excel_import").alias("source"),
    )
    return df.where("concert_date is not null and city is not null")


def api_json_to_metrics(payloads: DataFrame, platform: str, as_of: str, column: str = "body") -> DataFrame:
    """Saved platform responses as metric rows; alternative field names, bad numbers as 0."""
    item = "map<string,string>"
    body = F.from_json(F.col(column), f"items array<{item}>, data array<{item}>")
    items = F.coalesce(body["items"], body["data"], F.array().cast(f"array<{item}>"))
    flat = payloads.select(*[c for c in payloads.columns if c != column], F.explode(items).alias("m"))

    def first(*names: str) -> Column:
        return F.coalesce(*[F.try_element_at("m", F.lit(n)).try_cast("bigint") for n in names], F.lit(0))

    return flat.select(
        *[c for c in payloads.columns if c != column], F.lit(platform).alias("platform"), F.lit(as_of).cast("date").alias("date"),
        first("followers", "subscriberCount").alias("followers"), first("streams", "plays", "views", "viewCount").alias("streams"),
        first("likes", "reactions").alias("likes"), first("comments", "commentCount").alias("comments"), first("shares", "retweets").alias("shares"),
    )


def setlists_to_events(payloads: DataFrame, column: str = "body", artist: str = "artist_name") -> DataFrame:
    """Saved setlist pages as concert rows; ``setlist`` may be a list or one object."""
    as_list = F.from_json(F.col(column), f"setlist array<struct<{_ddl(SETLIST)}>>")["setlist"]
    as_one = F.from_json(F.col(column), f"setlist struct<{_ddl(SETLIST)}>")["setlist"]
    one = F.get_json_object(F.col(column), "$.setlist").startswith("{")
    items = F.when(one, F.array(as_one)).otherwise(as_list)
    keep = [c for c in payloads.columns if c != column]
    flat = payloads.select(*keep, F.explode(items).alias("s"))
    country = F.coalesce(F.nullif(F.trim("s.venue.city.country.name"), F.lit("")), F.trim("s.venue.city.country.code"))
    url = F.coalesce(F.nullif(F.trim("s.url"), F.lit("")), F.lit("https://www.setlist.fm"))
    out = flat.select(
        *keep, F.try_to_timestamp("s.eventDate", F.lit("dd-MM-yyyy")).cast("date").alias("concert_date"), F.trim("s.venue.name").alias("venue_name"),
        F.trim("s.venue.city.name").alias("city"), country.alias("country"), url.alias("source_url"), F.trim("s.tour.name").alias("tour"),
    )
    out = out.where("concert_date is not null and venue_name <> '' and city <> '' and country <> ''")
    return out.withColumn("event_name", F.concat(F.col(artist), F.lit(" at "), F.col("venue_name"))).withColumn(
        "currency", F.when(F.lower("country").contains("india"), "INR").otherwise("USD")
    ).withColumn("source", F.lit("setlistfm"))


def _ddl(fields: str) -> str:
    """Top-level ``name type`` pairs written as struct members."""
    out, depth, start = [], 0, 0
    for i, ch in enumerate(fields + ","):
        depth += (ch == "<") - (ch == ">")
        if ch == "," and depth == 0:
            out.append(fields[start:i].strip().replace(" ", ":", 1))
            start = i + 1
    return ", ".join(out)


def search_results_to_events(payloads: DataFrame, source: str, as_of: str, column: str = "body") -> DataFrame:
    """Saved search pages as concert rows: event blocks naming the artist, and organic hits on the
    source's own site that carry a date.

    ``payloads``: artist_name and the JSON text.
    """
    rule = SITE_RULES[source]
    parsed = F.from_json(F.col(column), f"events_results array<struct<{_ddl(RESULT)}>>, organic_results array<struct<{_ddl(RESULT)}>>")
    keep = [c for c in payloads.columns if c != column]
    base = payloads.select(*keep, parsed.alias("p"))
    yearless = source != "songkick"

    def day(text: Column) -> Column:
        return dates.date_from_text(text, as_of, rule["min_year"], yearless)

    ev = base.select(*keep, F.explode("p.events_results").alias("r")).where(F.contains(F.lower("r.title"), F.lower("artist_name")))
    when = F.col("r.date")
    start, spoken = F.get_json_object(when, "$.start_date"), F.get_json_object(when, "$.when")
    ev_day = day(F.when(when.startswith("{"), spoken).otherwise(when))
    if source == "songkick":
        ev_day = F.coalesce(start.try_cast("date"), ev_day)
    elif source == "district":
        ev_day = F.when(~when.startswith("{"), ev_day)
    addr = F.col("r.address")
    ev_country = F.coalesce(F.when(F.size(addr) > 1, F.try_element_at(addr, F.lit(-1))), F.lit("Unknown")) if source == "songkick" else F.lit("India")
    events = ev.select(
        *keep, F.col("r.title").alias("event_name"), F.coalesce("r.venue.name", F.lit("")).alias("venue_name"), F.coalesce(F.try_element_at(addr, F.lit(1)), F.lit("")).alias("city"),
        ev_country.alias("country"), ev_day.alias("concert_date"), F.lit(None).cast("double").alias("price_min"), F.coalesce("r.link", F.lit("")).alias("source_url"),
    )

    og = base.select(*keep, F.explode("p.organic_results").alias("r"))
    ttl, snip, link = (F.coalesce(F.col(f"r.{c}"), F.lit("")) for c in ("title", "snippet", "link"))
    both = F.concat_ws(" ", ttl, snip)
    ok = F.lower(link).contains(rule["domain"])
    if source == "bookmyshow":
        ok = ok & ~lookup.any_contained(F.lower(ttl), TITLE_LISTINGS)
    elif source == "district":
        ok = ok & normalize.is_music_event(ttl, snip) & ~link.rlike("/events/?$")
    else:
        ok = ok & ~(link.contains("/artists/") & ~link.contains("/calendar") & ~link.contains("/gigography"))
    name = ttl
    for s in rule["suffixes"]:
        name = F.substring_index(name, s, 1)
    place = normalize.place_from_text(both) if source == "songkick" else {"venue_name": F.lit(""), "city": F.lit(""), "country": F.lit("India")}
    if source == "bookmyshow":
        slug = F.regexp_extract(link, r"bookmyshow\.com/([a-z-]+)/", 1)
        place["city"] = F.coalesce(lookup.exact(slug, CITY_SLUGS), F.initcap(F.replace(slug, F.lit("-"), F.lit(" "))))
    land = F.coalesce(F.nullif(place["country"], F.lit("")), F.lit("Unknown"))
    marks = "₹$£€" if source == "songkick" else "₹"
    organic = og.where(ok).select(
        *keep, F.trim(name).alias("event_name"), place["venue_name"].alias("venue_name"), place["city"].alias("city"), land.alias("country"),
        day(both).alias("concert_date"), dates.price_from_text(both, marks).alias("price_min"), link.alias("source_url"),
    )
    # as plain columns the filter would read each date a second time
    found = lambda df: df.select(F.explode(F.array(F.struct(*df.columns))).alias("r")).select("r.*").where("concert_date is not null")
    out = found(events).unionByName(found(organic)).withColumn("source", F.lit(source))
    if source == "songkick":
        return out.withColumn("currency", F.when(F.lower("country").contains("india"), "INR").otherwise("USD"))
    return out.withColumn("currency", F.lit("INR"))


def cards_to_events(cards: DataFrame, column: str = "text") -> DataFrame:
    """Listing-card text: first line the name, first fitting further line the venue, a priced line."""
    lines = F.filter(F.transform(F.split(column, "\n"), lambda x: F.trim(x)), lambda x: x != "")
    df = cards.withColumn("lines", lines).withColumn("event_name", F.try_element_at("lines", F.lit(1)))
    df = df.where((F.length(column) >= 5) & F.length("event_name").between(3, 150))
    rest = F.slice("lines", 2, F.greatest(F.size("lines") - 1, F.lit(0)))
    venue = F.try_element_at(F.filter(rest, lambda x: ~x.contains("₹") & (F.length(x) > 3) & (F.length(x) < 80)), F.lit(1))
    priced = F.try_element_at(F.filter(rest, lambda x: x.contains("₹")), F.lit(-1))
    return df.withColumns({
        "artist_name": normalize.artist_from_title(F.col("event_name")),
        "venue_name": F.coalesce(F.trim(F.regexp_replace(venue, r":\s*\w+$", "")), F.lit("")),
        "price_min": dates.price_from_text(priced, "₹"),
    }).drop("lines", column)


def pages_to_event_detail(pages: DataFrame, as_of: str, column: str = "text") -> DataFrame:
    """Date, prices, tier prices and time named anywhere in a detail page."""
    text = F.col(column)
    df = pages.withColumns({"event_date": dates.date_from_text(text, as_of), "prices": dates.all_prices(text), "event_time": dates.clock_from_text(text)})
    tiers = dates.price_tiers_of(F.col("prices"))
    return df.withColumns({f"price_{k}": c for k, c in tiers.items()} | {"price_min": F.array_min("prices"), "price_max": F.array_max("prices")}).drop(column)
