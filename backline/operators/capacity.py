"""Venue capacity: evidence from text, lists and stored rows, an estimate, and validation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, Window as W

from backline.functions import lookup, refdata as R
from backline.functions.gazetteer import KNOWN_VENUES
from backline.functions.rounding import clamp, half_even
from backline.operators.demand import snapshot_tier


def simple_name(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9]+", " "))


def is_round(capacity: Column) -> Column:
    return capacity.isin(R.ROUND_CAPACITIES)


def venue_type_of(name: Column) -> Column:
    return lookup.first_contained(F.lower(F.coalesce(name, F.lit(""))), R.VENUE_TYPES, "")


def known_capacity(venue: Column, city: Column) -> Column:
    """Capacity from the verified list: exact pair, else the first entry contained either way.

    The list is a fixed literal of under 150 entries, so this is a row expression, not a join.
    """
    entries = F.array(*[F.struct(F.lit(a).alias("v"), F.lit(b).alias("c"), F.lit(n).alias("n")) for a, b, n in KNOWN_VENUES])

    def listed(p: Column) -> Column:
        v, c = p.v, p.c
        exact = lookup.exact(F.concat_ws("|", v, c), {f"{a}|{b}": n for a, b, n in KNOWN_VENUES})
        hits = F.filter(entries, lambda e: (v.contains(e.v) & c.contains(e.c)) | (e.v.contains(v) & e.c.contains(c)))
        return F.coalesce(exact, F.try_element_at(hits, F.lit(1)).n)

    place = F.struct(F.lower(F.trim(venue)).alias("v"), F.lower(F.trim(F.coalesce(city, F.lit("")))).alias("c"))
    return F.when(F.coalesce(venue, F.lit("")) != "", lookup.once(place, listed))


def with_known_capacity(concerts: DataFrame) -> DataFrame:
    """Verified capacity per row, computed once per distinct (venue, city)."""
    places = concerts.select("venue_name", "city").distinct().where(F.col("venue_name").isNotNull())
    # a generated row per place: as a plain column the filter would move below the distinct and search the list for every row
    found = places.withColumn("known_capacity", F.explode(F.array(known_capacity(F.col("venue_name"), F.col("city"))))).where("known_capacity is not null")
    same = [concerts["venue_name"].eqNullSafe(found["venue_name"]), concerts["city"].eqNullSafe(found["city"])]
    return concerts.join(found, same, "left").select(concerts["*"], found["known_capacity"])


def _scaled(value: Column, suffix: Column) -> Column:
    n = F.regexp_replace(value, ",", "").cast("double")
    s = F.lower(F.trim(F.coalesce(suffix, F.lit(""))))
    return half_even(n * F.when(s == "k", 1e3).when(s == "m", 1e6).otherwise(1.0))


def capacity_candidates(texts: DataFrame, key: str, text: str = "text", source: str = "source_text") -> DataFrame:
    """Capacities named in free text, one row per (key, capacity, method) with its confidence.

    The whole text is read.  Rows: number after a capacity word (0.9) and number before a unit
    (0.7); hedging words take 0.12 off.
    """
    low = F.lower(F.trim(F.regexp_replace(F.col(text), r"\s+", " ")))
    df = texts.where(F.col(text).isNotNull() & (F.col(text) != "")).select(F.col(key), low.alias("low"))
    off = F.when(lookup.any_contained(F.col("low"), R.APPROXIMATE_WORDS), 0.12).otherwise(0.0)

    def hits(pattern: str, v: int, s: int, method: str, conf: float) -> Column:
        p = F.lit(pattern)
        z = F.arrays_zip(F.regexp_extract_all("low", p, v).alias("v"), F.regexp_extract_all("low", p, s).alias("s"))
        return F.transform(z, lambda m: F.struct(_scaled(m.v, m.s).alias("capacity"), F.lit(method).alias("method"), clamp(F.lit(conf) - off, 0.35, 0.98).alias("confidence")))

    found = F.concat(
        hits(R.CAPACITY_LABEL, 1, 2, "context_text_extraction", 0.9),
        hits(R.CAPACITY_INLINE, 1, 2, "inline_text_extraction", 0.7),
    )
    rows = df.select(key, F.explode(found).alias("f")).select(key, F.col("f.capacity").cast("long").alias("capacity"), "f.method", "f.confidence")
    return (
        rows.where("capacity > 0").groupBy(key, "capacity", "method").agg(F.max("confidence").alias("confidence"))
        .withColumn("source", F.lit(source))
    )


def with_estimate(df: DataFrame, venue: Column, city: Column, venue_type: Column, artist_tier: Column) -> DataFrame:
    """Adds ``est_capacity`` and ``est_confidence`` from venue words, city tier and artist tier.

    The cleaned names are columns of their own, so the word tests below reuse them.
    """
    given = F.coalesce(venue_type, F.lit(""))
    out = df.withColumn("e_name", simple_name(venue)).withColumn("e_tier", F.lower(F.coalesce(artist_tier, F.lit(""))))
    out = out.withColumn("e_city", simple_name(F.coalesce(city, F.lit(""))))
    out = out.withColumn("e_hint", F.when(given != "", simple_name(given)).otherwise(F.col("e_name")))
    tier1, tier2 = (lookup.any_contained(F.col("e_city"), t) for t in (R.CITY_TIER_1, R.CITY_TIER_2))
    out = (
        out.withColumn("e_place", F.when(tier1, 1).when(tier2, 2).otherwise(3))
        .withColumn("e_type", lookup.first_contained(F.col("e_hint"), R.VENUE_BASELINES))
        .withColumn("e_base", lookup.exact(F.col("e_tier"), R.TIER_BASE))
    )
    base = F.coalesce("e_type", "e_base", F.lit(5000)).cast("double")
    spread = F.when(F.col("e_place") == 1, 1.0).when(F.col("e_place") == 2, 0.72).otherwise(0.45)
    pull = F.when(F.col("e_base").isNotNull() & F.col("e_type").isNull(), 1.0).otherwise(lookup.exact(F.col("e_tier"), R.TIER_MULTIPLIER, 1.0))
    conf = (
        F.lit(0.44) + F.when(lookup.any_contained(F.col("e_name"), ["stadium", "arena", "festival", "grounds"]), 0.18).otherwise(0.0)
        + F.when(lookup.any_contained(F.col("e_name"), ["club", "lounge", "bar"]), 0.12).otherwise(0.0) + F.when(F.col("e_place") == 1, 0.08).otherwise(0.0)
    )
    out = out.withColumn("est_capacity", F.greatest(F.lit(100.0), half_even(base * spread * pull)).cast("long"))
    out = out.withColumn("est_confidence", clamp(conf, 0.35, 0.82))
    return out.drop("e_name", "e_tier", "e_city", "e_hint", "e_place", "e_type", "e_base")


def estimate_capacity(venues: DataFrame) -> DataFrame:
    out = with_estimate(venues, F.col("venue_name"), F.col("city"), F.col("venue_type"), F.col("artist_tier"))
    return out.withColumnsRenamed({"est_capacity": "capacity", "est_confidence": "confidence"})


def validate_capacity(df: DataFrame) -> DataFrame:
    """Penalties, reasons, status and range of a chosen capacity.

    Input: venue_name, city, country, venue_type, artist_tier, capacity, confidence, source, method.
    """
    cap, src, name, kind = (F.col(c) for c in ("capacity", "source", "v_name", "v_kind"))
    tier = F.lower(F.coalesce("artist_tier", F.lit("")))
    df = df.withColumn("v_name", simple_name(F.col("venue_name"))).withColumn("v_kind", simple_name(F.col("venue_type")))
    checks = [
        (cap < 100, "capacity is unusually small", 0.1),
        (cap > 200_000, "capacity is unusually large", 0.2),
        (src == "heuristic", "capacity was estimated from venue metadata", 0.05),
        (F.col("method").endswith("text_extraction"), "capacity was extracted from source text", 0.0),
        (lookup.any_contained(name, ["stadium", "arena", "grounds", "festival"]) & (cap < 1000), "venue type and capacity look inconsistent", 0.15),
        (lookup.any_contained(kind, ["club", "lounge", "bar"]) & (cap > 10_000), "small-venue type and capacity look inconsistent", 0.15),
        (tier.isin("superstar", "major") & (cap < 500), "artist tier likely needs a larger venue", 0.08),
    ]
    conf = F.col("confidence")
    for cond, _, cost in checks:
        if cost:
            conf = conf - F.when(cond, cost).otherwise(0.0)
    out = df.withColumn("reasons", F.array_compact(F.array(*[F.when(cond, F.lit(text)) for cond, text, _ in checks])))
    out = out.withColumn("confidence", half_even(clamp(conf, 0.05, 0.99), 4))
    c = F.col("confidence")
    status = (
        F.when((c >= 0.82) & (cap >= 100), "validated").when(c >= 0.6, "review_required")
        .when(src == "heuristic", "estimated").otherwise("review_required")
    )
    out = out.withColumn("status", status)
    spread = F.greatest(F.lit(1), half_even(cap * F.when(F.col("status") == "validated", 0.08).otherwise(0.18)).cast("long"))
    return out.withColumn("capacity_min", F.greatest(F.lit(1), cap - spread)).withColumn("capacity_max", cap + spread).drop("v_name", "v_kind")


def _candidate(cap: Column, conf: Column, source: str, method: str) -> Column:
    """Ordered so that the greatest struct is the best: confidence, then the smaller capacity."""
    c = cap.cast("long")
    return F.when(c.isNotNull() & (c != 0), F.struct(conf.cast("double").alias("confidence"), (-F.abs(c)).alias("neg"), c.alias("capacity"), F.lit(source).alias("source"), F.lit(method).alias("method")))


def stored_choice(low: Column, high: Column, avg: Column) -> Column:
    lo, hi, mid = (F.coalesce(x, F.lit(0)) for x in (low, high, avg))
    return F.when((lo == 0) & (hi > 0), hi).when(mid > 0, mid).when(hi > 0, hi).when(lo > 0, lo)


def resolve_capacity(venues: DataFrame, stored: DataFrame | None = None, texts: DataFrame | None = None, web: DataFrame | None = None) -> DataFrame:
    """Best capacity per venue row and its validation.

    ``venues``: venue_key, venue_name, city, country, venue_type, artist_tier, supplied_capacity.
    ``stored``: the venue table.  ``texts``: (venue_key, text).  ``web``: (venue_key, capacity,
    confidence), used only where nothing else is known.  Text and web evidence is cut to its best
    candidate per venue by a max that combines map-side.
    """
    def best(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy("venue_key").agg(F.max(F.struct("confidence", (-F.col("capacity")).alias("neg"), "capacity", "method")).alias(name))

    df = venues.withColumn("known", known_capacity(F.col("venue_name"), F.col("city")))
    cands = [_candidate(F.col("known"), F.lit(0.98), "known_venues_db", "curated_lookup"),
             _candidate(F.col("supplied_capacity"), F.lit(0.95), "supplied", "explicit_input")]
    if texts is not None:
        df = df.join(best(capacity_candidates(texts, "venue_key"), "tx"), "venue_key", "left")
        t = F.col("tx")
        cands.append(F.when(t.isNotNull(), F.struct(t.confidence.alias("confidence"), t.neg.alias("neg"), t.capacity.alias("capacity"), F.lit("source_text").alias("source"), t.method.alias("method"))))
    if stored is not None:
        low = [F.lower(F.col(c)) for c in ("venue_name", "city", "country")]
        s = stored.groupBy(*[x.alias(f"k{i}") for i, x in enumerate(low)]).agg(
            F.min(F.struct("venue_id", stored_choice(F.col("capacity_min"), F.col("capacity_max"), F.col("avg_capacity")).alias("cap"), "verified")).alias("st"))
        df = df.select("*", *[x.alias(f"k{i}") for i, x in enumerate(low)]).join(s, ["k0", "k1", "k2"], "left").drop("k0", "k1", "k2")
        cands.append(_candidate(F.col("st.cap"), F.when(F.coalesce(F.col("st.verified"), F.lit(False)), 0.96).otherwise(0.84), "venue_db", "database_lookup"))
    df = df.withColumn("cands", F.array_compact(F.array(*cands)))
    df = with_estimate(df, F.col("venue_name"), F.col("city"), F.col("venue_type"), F.col("artist_tier"))
    fallback = _candidate(F.col("est_capacity"), F.col("est_confidence"), "heuristic", "metadata_estimate")
    if web is not None:
        df = df.join(best(web.withColumn("method", F.lit("search_snippet")), "wb"), "venue_key", "left")
        w = F.col("wb")
        fallback = F.coalesce(F.when(w.isNotNull(), F.struct(w.confidence.alias("confidence"), w.neg.alias("neg"), w.capacity.alias("capacity"), F.lit("web_search").alias("source"), w.method.alias("method"))), fallback)
    df = df.withColumn("cands", F.when(F.size("cands") > 0, F.col("cands")).otherwise(F.array(fallback)))
    df = df.withColumn("b", F.array_max("cands")).select(*venues.columns, F.size("cands").alias("candidates"), "b.capacity", "b.confidence", "b.source", "b.method")
    return validate_capacity(df)


def snippet_capacity(results: DataFrame, top: int = 3) -> DataFrame:
    """Capacities in saved search results; the ``top`` most trusted per venue.

    ``results``: venue_key, venue_name, section, title, snippet, link.  Values outside the range
    the venue's name suggests go, unless that would leave the venue with none.
    """
    text = F.concat_ws(" ", "title", "snippet")
    vals = F.concat(*[F.regexp_extract_all(text, F.lit(p), 1) for p in R.SNIPPET_PATTERNS])
    nums = F.transform(vals, lambda x: F.regexp_replace(x, ",", "").try_cast("double"))
    link, snip = F.lower(F.coalesce("link", F.lit(""))), F.lower(F.coalesce("snippet", F.lit("")))
    first_word = F.split(F.lower("venue_name"), r"\s+")[0]
    organic = (
        F.when(lookup.any_contained(link, R.SNIPPET_TRUSTED), 0.88).when(lookup.any_contained(link, R.SNIPPET_OFFICIAL), 0.85)
        .when(snip.contains("capacity") & snip.contains(first_word), 0.82).otherwise(0.78)
    )
    conf = F.when(F.col("section") == "knowledge_graph", 0.92).when(F.col("section") == "answer_box", 0.90).otherwise(organic)
    rows = results.select("venue_key", F.lower("venue_name").alias("name"), conf.alias("confidence"), F.explode(nums).alias("n"))
    rows = rows.where(F.col("n").between(50, 250_000)).groupBy("venue_key", "name", F.col("n").cast("long").alias("capacity")).agg(F.max("confidence").alias("confidence"))
    lo, hi = F.lit(100), F.lit(250_000)
    for words, a, b in reversed(R.NAME_RANGES):
        hit = lookup.any_contained(F.col("name"), words)
        lo, hi = F.when(hit, a).otherwise(lo), F.when(hit, b).otherwise(hi)
    rows = rows.withColumn("fits", F.col("capacity").between(lo, hi).cast("int"))
    # fitting values sort first; a venue with any fitting value keeps only those
    w = W.partitionBy("venue_key").orderBy(F.col("fits").desc(), F.col("confidence").desc(), "capacity")
    ranked = rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)
    lead = F.max("fits").over(W.partitionBy("venue_key"))
    return ranked.withColumn("lead", lead).where("fits = lead").select("venue_key", "capacity", "confidence", "rank")


def venue_firsts(concerts: DataFrame) -> DataFrame:
    """Most frequent (capacity, artist) row per venue, and its highest ticket count."""
    df = concerts.where(F.col("venue_name").isNotNull() & (F.col("venue_name") != ""))
    g = df.groupBy("venue_name", "city", "country", "capacity", "artist_id").agg(F.count(F.lit(1)).alias("n"), F.max("tickets_sold").alias("max_tickets"))
    keys = [F.lower(F.trim(F.coalesce(c, F.lit("")))).alias(f"k_{c}") for c in ("venue_name", "city", "country")]
    order = F.struct((-F.col("n")).alias("o"), "city", "venue_name", "capacity", "artist_id")
    row = F.struct("venue_name", "city", "country", "capacity", "artist_id", "max_tickets")
    return g.groupBy(*keys).agg(F.min_by(row, order).alias("r")).select("k_venue_name", "k_city", "k_country", "r.*")


def enrich_venues(concerts: DataFrame, venues: DataFrame, artists: DataFrame) -> DataFrame:
    """Re-resolve each venue's capacity from its concerts: what was, what is, and what to do."""
    firsts = venue_firsts(concerts)
    have = venues.groupBy(*[F.lower(F.trim(c)).alias(f"k_{c}") for c in ("venue_name", "city", "country")]).agg(
        F.min(F.struct("venue_id", "avg_capacity", "verified")).alias("x"))
    df = firsts.join(have, ["k_venue_name", "k_city", "k_country"], "left")
    df = df.join(snapshot_tier(artists).select("artist_id", "artist_tier"), "artist_id", "left").withColumn("artist_tier", F.coalesce("artist_tier", F.lit("mid")))
    cur, sold = F.coalesce(F.col("capacity"), F.lit(5000)), F.coalesce(F.col("max_tickets"), F.lit(0))
    stored = F.col("x.avg_capacity")
    settled = F.coalesce(F.col("x.verified"), F.lit(False)) & F.coalesce(stored != 0, F.lit(False)) & ~((sold > 0) & (sold > F.coalesce(stored, F.lit(0))))
    floor = F.when((sold > 0) & (cur > 0) & (sold > cur), F.floor(sold * 1.1)).when((sold > 0) & (cur == 0), F.floor(sold * 1.15))
    supplied = F.when(floor > 0, floor).when((cur > 0) & ~is_round(cur), cur)
    df = df.withColumn("old_capacity", cur).withColumn("settled", settled).withColumn("supplied_capacity", supplied.cast("long"))
    df = df.withColumn("venue_type", venue_type_of(F.col("venue_name"))).withColumn("venue_key", F.concat_ws("|", "k_venue_name", "k_city", "k_country"))
    cols = ["venue_key", "venue_name", "city", "country", "venue_type", "artist_tier", "supplied_capacity", "old_capacity"]
    done = df.where("settled").select(
        *cols, stored.cast("long").alias("new_capacity"), F.lit(0.96).alias("confidence"), F.lit("already_verified").alias("status"),
        F.lit("venue_db").alias("source"), F.lit("skip").alias("action"))
    todo = resolve_capacity(df.where("not settled").select(*cols), stored=venues)
    act = F.when((F.col("capacity") != F.col("old_capacity")) & (F.col("confidence") >= 0.6), "update").otherwise("keep")
    fresh = todo.select(*cols, F.col("capacity").alias("new_capacity"), "confidence", "status", "source", act.alias("action"))
    return done.unionByName(fresh)


def backfill_capacity(concerts: DataFrame, enriched: DataFrame) -> DataFrame:
    """Concerts with the enriched capacity where theirs was missing or the old value."""
    up = enriched.where("action = 'update'").select("venue_name", "city", "country", "old_capacity", "new_capacity")
    df = concerts.join(up, ["venue_name", "city", "country"], "left")
    use = F.col("new_capacity").isNotNull() & (F.col("capacity").isNull() | (F.col("capacity") == F.col("old_capacity")))
    return df.withColumn("capacity", F.when(use, F.col("new_capacity")).otherwise(F.col("capacity"))).select(*concerts.columns)


def fill_capacity(concerts: DataFrame, web: DataFrame | None = None) -> DataFrame:
    """Verified capacity over the stored one; a missing one from saved results, else an estimate.

    ``web``: (venue_name, city, capacity, confidence) saved candidates.
    """
    df = with_known_capacity(concerts)
    df = df.withColumn("capacity", F.coalesce("known_capacity", "capacity")).drop("known_capacity")
    df = with_estimate(df, F.col("venue_name"), F.col("city"), F.lit(""), F.lit(None).cast("string"))
    missing = (F.coalesce("capacity", F.lit(0)) == 0) & F.col("venue_name").isNotNull() & (F.col("venue_name") != "")
    fill = F.col("est_capacity")
    if web is not None:
        good = web.where("capacity >= 500").groupBy("venue_name", "city").agg(F.max_by("capacity", F.struct(F.col("confidence") > 0.8, F.col("capacity"))).alias("web_capacity"))
        df = df.join(good, ["venue_name", "city"], "left")
        fill = F.coalesce("web_capacity", "est_capacity")
    return df.withColumn("capacity", F.when(missing, fill).otherwise(F.col("capacity"))).select(*concerts.columns)
