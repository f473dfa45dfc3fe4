"""Scraped listings: imports, text parsing, normalisation, matching and duplicates."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from backline.functions import dates, text as X, vectors as V
from backline.operators import normalize as N, pairs
from backline.session import checkpoint_dir, cut_lineage, cut_packed
from backline.sources import imports, tables
from backline.streaming import metrics as stream
from catalog.base import any_in, eq_case, even, lit, query, up

# --- imports ----------------------------------------------------------------------------

_SHEET = """sheet as (select o_orderkey as seq, case when o_orderkey % 17 = 0 then 'nobody' when o_orderkey % 19 = 0 then null else 'Customer#' || lpad(cast(o_custkey as varchar), 9, '0') end as artist_name,
   case o_orderkey % 3 when 0 then 'SPOTIFY' when 1 then ' Youtube ' else null end as platform, case when o_orderkey % 23 = 0 then 'n/a' else cast(cast(o_orderdate as date) as varchar) end as date,
   case when o_orderkey % 4 = 0 then '0' else cast(o_orderkey as varchar) end as followers, case when o_orderkey % 5 = 0 then 'x' else '7' end as streams,
   case when o_orderkey % 6 = 0 then null else 'Pune' end as city, case when o_orderkey % 7 = 0 then '' else 'United States' end as country,
   case when o_orderkey % 4 = 1 then '120.5' end as atp, case when o_orderkey % 4 = 2 then cast(o_orderkey % 900 as varchar) end as ticket_price, case when o_orderkey % 8 = 0 then '90' end as avg_ticket_price,
   cast(o_custkey as varchar) as tickets_sold, case when o_orderkey % 9 = 0 then '5000' end as total_revenue from orders)"""


def _sheet(v):
    k = F.col("o_orderkey")
    s = lambda c: c.cast("string")
    return v.orders.select(
        k.alias("seq"), F.when(k % 17 == 0, "nobody").when(k % 19 == 0, F.lit(None)).otherwise(F.concat(F.lit("Customer#"), F.lpad(s(F.col("o_custkey")), 9, "0"))).alias("artist_name"),
        F.when(k % 3 == 0, "SPOTIFY").when(k % 3 == 1, " Youtube ").alias("platform"), F.when(k % 23 == 0, "n/a").otherwise(s(F.col("o_orderdate").cast("date"))).alias("date"),
        F.when(k % 4 == 0, "0").otherwise(s(k)).alias("followers"), F.when(k % 5 == 0, "x").otherwise("7").alias("streams"), F.lit(None).cast("string").alias("likes"),
        F.lit("1").alias("comments"), F.lit("0").alias("shares"), F.when(k % 6 != 0, "Pune").alias("city"), F.when(k % 7 == 0, "").otherwise("United States").alias("country"),
        F.when(k % 4 == 1, "120.5").alias("atp"), F.when(k % 4 == 2, s(k % 900)).alias("ticket_price"), F.when(k % 8 == 0, "90").alias("avg_ticket_price"),
        s(F.col("o_custkey")).alias("tickets_sold"), F.when(k % 9 == 0, "5000").alias("total_revenue"), F.lit(None).cast("string").alias("venue_name"), F.lit("800").alias("capacity"))


@query("sheet_rejects", f"""with {_SHEET} select seq, concat_ws(', ', case when artist_name is null then 'artist_name' end, case when platform is null then 'platform' end) as missing from sheet where artist_name is null or platform is null""")
def _(v):
    _, bad = imports.split_valid(_sheet(v), ["artist_name", "platform", "date"])
    return bad.select("seq", F.regexp_replace("reason", "^missing ", "").alias("missing"))


@query("sheet_accepted", f"with {_SHEET} select seq, artist_name, city from sheet where artist_name is not null and city is not null")
def _(v):
    ok, _ = imports.split_valid(_sheet(v), ["artist_name", "date", "city"])
    return ok.select("seq", "artist_name", "city")


_STORE = "store as (select o_custkey as artist_id, 'spotify' as platform, cast(o_orderdate as date) as date, max(1000000 + o_orderkey) as followers, max(o_orderkey % 3) as streams from orders where o_orderkey % 2 = 0 group by 1, 2, 3)"


@query("import_metrics", f"""with {_SHEET}, {_STORE}, n as (select artist_id, lower(trim(platform)) platform, try_cast(date as date) date, seq, coalesce(try_cast(followers as bigint), 0) f, coalesce(try_cast(streams as bigint), 0) st
    from sheet join dv_artists using (artist_name) where platform is not null and try_cast(date as date) is not null),
   l as (select * from (select *, row_number() over (partition by artist_id, platform, date order by seq desc) rn from n) where rn = 1)
  select coalesce(s.artist_id, l.artist_id) as artist_id, coalesce(s.platform, l.platform) as platform, coalesce(s.date, l.date)::varchar as date,
   case when l.seq is null then followers else coalesce(nullif(f, 0), followers, 0) end as followers, case when l.seq is null then streams else coalesce(nullif(st, 0), streams, 0) end as streams
  from store s full outer join l on s.artist_id = l.artist_id and s.platform = l.platform and s.date = l.date""")
def _(v):
    store = v.orders.where("o_orderkey % 2 = 0").groupBy(F.col("o_custkey").alias("artist_id"), F.lit("spotify").alias("platform"), F.col("o_orderdate").cast("date").alias("date")).agg(
        F.max(F.col("o_orderkey") + 1000000).alias("followers"), F.max(F.col("o_orderkey") % 3).alias("streams"))
    for c in ("likes", "comments", "shares"):
        store = store.withColumn(c, F.lit(0).cast("long"))
    return imports.import_metrics(_sheet(v), v.artists, store).select("artist_id", "platform", "date", "followers", "streams")


@query("import_concerts", f"""with {_SHEET}, p as (select *, coalesce(avg_ticket_price::double, atp::double, ticket_price::double) pr, tickets_sold::double t, total_revenue::double r from sheet join (select artist_id, artist_name from dv_artists) using (artist_name))
  select seq as n, artist_id, try_cast(date as date)::varchar as concert_date, coalesce(nullif(country, ''), 'India') as country, t::bigint as tickets_sold, pr as avg_ticket_price,
   coalesce(case when r > 0 then r end, case when t > 0 and pr > 0 then {up('t * pr', 2)} end, 0) as total_revenue from p where try_cast(date as date) is not null and city is not null""".replace("seq as n, ", ""))
def _(v):
    return imports.import_concerts(_sheet(v), v.artists).select("artist_id", "concert_date", "country", "tickets_sold", "avg_ticket_price", "total_revenue")


_API = """select o_custkey as artist_id, '2024-01-31' as date, 'youtube' as platform, o_orderkey as followers, case when o_orderkey % 2 = 0 then 0 else o_orderkey * 2 end as streams,
   case when o_orderkey % 3 = 0 then 5 else 0 end as likes, case when o_orderkey % 2 = 1 then 9 else 0 end as shares from orders"""


@query("api_json_to_metrics", _API)
def _(v):
    k = F.col("o_orderkey").cast("string")
    one = F.concat(F.lit('{"subscriberCount": "'), k, F.lit('"'), F.when(F.col("o_orderkey") % 3 == 0, F.lit(', "reactions": 5')).otherwise(F.lit(', "likes": "n/a"')),
                   F.when(F.col("o_orderkey") % 2 == 1, F.concat(F.lit(', "retweets": 9, "viewCount": '), (F.col("o_orderkey") * 2).cast("string"))).otherwise(F.lit("")), F.lit("}"))
    body = F.concat(F.when(F.col("o_orderkey") % 2 == 0, F.lit('{"items": [')).otherwise(F.lit('{"data": [')), one, F.lit("]}"))
    p = v.orders.select(F.col("o_custkey").alias("artist_id"), body.alias("body"))
    return imports.api_json_to_metrics(p, "youtube", "2024-01-31").select("artist_id", "date", "platform", "followers", "streams", "likes", "shares")


@query("setlists_to_events", """select o_orderkey, 'Customer ' || o_custkey || ' at Hall ' || (o_custkey % 30) as event_name, cast(o_orderdate as date)::varchar as concert_date, 'Hall ' || (o_custkey % 30) as venue_name, 'Pune' as city,
   case when o_orderkey % 3 = 0 then 'IN' else 'India' end as country, case when o_orderkey % 4 = 0 then 'https://www.setlist.fm' else 'u' || o_orderkey end as source_url,
   case when o_orderkey % 3 = 0 then 'USD' else 'INR' end as currency from orders where o_orderkey % 7 <> 0""")
def _(v):
    k = F.col("o_orderkey")
    s = lambda c: c.cast("string")
    one = F.concat(
        F.lit('{"eventDate": "'), F.when(k % 7 == 0, "soon").otherwise(F.date_format("o_orderdate", "dd-MM-yyyy")), F.lit('", "url": "'), F.when(k % 4 == 0, "").otherwise(F.concat(F.lit("u"), s(k))),
        F.lit('", "venue": {"name": " Hall '), s(F.col("o_custkey") % 30), F.lit('", "city": {"name": "Pune", "country": {"code": "IN"'), F.when(k % 3 == 0, "").otherwise(', "name": "India"'), F.lit("}}}}"))
    body = F.when(k % 2 == 0, F.concat(F.lit('{"setlist": '), one, F.lit("}"))).otherwise(F.concat(F.lit('{"setlist": ['), one, F.lit("]}")))
    p = v.orders.select("o_orderkey", F.concat(F.lit("Customer "), s(F.col("o_custkey"))).alias("artist_name"), body.alias("body"))
    return imports.setlists_to_events(p).select("o_orderkey", "event_name", "concert_date", "venue_name", "city", "country", "source_url", "currency")


@query("search_results_bookmyshow", """select o_orderkey, 'Customer ' || o_custkey || ' Live' as event_name, '2026-03-05' as concert_date, 'Dome' as venue_name, 'Pune' as city, null::double as price_min from orders where o_orderkey % 3 <> 0
   union all select o_orderkey, 'Gala' as event_name, case when o_orderkey % 2 = 0 then '2026-01-15' else '2025-02-01' end, '', case when o_orderkey % 5 = 0 then 'Delhi' else 'Navi Mumbai' end, (1000 + o_orderkey % 900)::double from orders where o_orderkey % 4 <> 0""")
def _(v):
    k = F.col("o_orderkey")
    s = lambda c: c.cast("string")
    name = F.concat(F.lit("Customer "), s(F.col("o_custkey")))
    ev = F.concat(F.lit('{"title": "'), F.when(k % 3 == 0, "Someone else").otherwise(F.concat(name, F.lit(" Live"))), F.lit('", "date": {"start_date": "x", "when": "Thu, 5 Mar 2026"}, "venue": {"name": "Dome"}, "address": ["Pune", "India"]}'))
    og = F.concat(F.lit('{"title": "'), F.when(k % 4 == 0, "Upcoming Events in town").otherwise("Gala - BookMyShow"), F.lit('", "snippet": "Doors 15 Jan'), F.when(k % 2 == 0, "").otherwise(", moved from Feb 1, 2025"),
                  F.lit(' Tickets ₹ 1,'), F.lpad(s(k % 900), 3, "0"), F.lit(' onwards", "link": "https://in.bookmyshow.com/'), F.when(k % 5 == 0, "delhi-ncr").otherwise("navi-mumbai"), F.lit('/x"}'))
    body = F.concat(F.lit('{"events_results": ['), ev, F.lit('], "organic_results": ['), og, F.lit("]}"))
    p = v.orders.select("o_orderkey", name.alias("artist_name"), body.alias("body"))
    return imports.search_results_to_events(p, "bookmyshow", "2025-06-01").select("o_orderkey", "event_name", "concert_date", "venue_name", "city", "price_min")


@query("search_results_songkick", """select o_orderkey, 'Customer ' || o_custkey as event_name, '2024-08-06' as concert_date, 'Forum ' || o_custkey as venue_name, 'Melbourne' as city, case when o_orderkey % 2 = 0 then 'India' else 'Unknown' end as country,
   case when o_orderkey % 2 = 0 then 'INR' else 'USD' end as currency from orders where o_orderkey % 3 <> 0""")
def _(v):
    k = F.col("o_orderkey")
    name = F.concat(F.lit("Customer "), F.col("o_custkey").cast("string"))
    og = F.concat(F.lit('{"title": "'), name, F.lit(' | Songkick", "snippet": "6 August 2024 at Forum '), F.col("o_custkey").cast("string"), F.lit(", Melbourne"), F.when(k % 2 == 0, ", India.").otherwise(""),
                  F.lit('", "link": "https://www.songkick.com/'), F.when(k % 3 == 0, "artists/1").otherwise("concerts/1"), F.lit('"}'))
    p = v.orders.select("o_orderkey", name.alias("artist_name"), F.concat(F.lit('{"organic_results": ['), og, F.lit("]}")).alias("body"))
    return imports.search_results_to_events(p, "songkick", "2024-06-01").select("o_orderkey", "event_name", "concert_date", "venue_name", "city", "country", "currency")


@query("search_results_district", """select o_orderkey, 'Sunset gig ' || o_custkey as event_name, '2026-02-09' as concert_date, (o_custkey + 50)::double as price_min from orders where o_orderkey % 5 <> 0 and o_orderkey % 3 <> 0""")
def _(v):
    k, c = F.col("o_orderkey"), F.col("o_custkey").cast("string")
    og = F.concat(F.lit('{"title": "Sunset gig '), c, F.lit(' - District", "snippet": "Feb 9, 2026 '), F.when(k % 5 == 0, "standup").otherwise("acoustic"), F.lit(' ₹'), (F.col("o_custkey") + 50).cast("string"),
                  F.lit('", "link": "https://www.DISTRICT.in/events'), F.when(k % 3 == 0, "/").otherwise("/e1"), F.lit('"}'))
    p = v.orders.select("o_orderkey", F.concat(F.lit("Customer "), c).alias("artist_name"), F.concat(F.lit('{"organic_results": ['), og, F.lit("]}")).alias("body"))
    return imports.search_results_to_events(p, "district", "2025-06-01").select("o_orderkey", "event_name", "concert_date", "price_min")


@query("cards_to_events", """select p_partkey, p_name || ' - Live in Pune' as event_name, p_name as artist_name, case when p_partkey % 3 = 0 then '' else 'Phoenix Hall ' || p_partkey end as venue_name,
   case when p_partkey % 4 = 0 then null else p_size * 1000 end::double as price_min from part where p_partkey % 6 <> 5""")
def _(v):
    k = F.col("p_partkey")
    text = F.when(k % 6 == 5, "ab\ncd").otherwise(F.concat(
        F.lit(" "), "p_name", F.lit(" - Live in Pune\n\n"), F.when(k % 3 == 0, "abc\n").otherwise(F.concat(F.lit("Phoenix Hall "), k.cast("string"), F.lit(": Pune\nConcerts\n"))),
        F.when(k % 4 == 0, "").otherwise(F.concat(F.lit("₹ "), F.col("p_size").cast("string"), F.lit(",000 onwards")))))
    return imports.cards_to_events(v.part.select("p_partkey", text.alias("text"))).select("p_partkey", "event_name", "artist_name", "venue_name", "price_min")


@query("pages_to_event_detail", """select page_id, case when page_id % 3 = 0 then '2026-04-12' when page_id % 3 = 1 then '2026-01-03' end as event_date, case when page_id % 2 = 0 then '7:30 PM' end as event_time,
   case page_id % 4 when 0 then '500,900,1500,4000' when 1 then '500,900,1500' when 2 then '500,900' else '' end as prices, case when page_id % 4 < 3 then 500 end::double as price_tier3,
   case page_id % 4 when 0 then 900 when 1 then 900 end::double as price_tier2, case when page_id % 4 = 0 then 1500 end::double as price_tier1, case page_id % 4 when 0 then 4000 when 1 then 1500 when 2 then 900 end::double as price_vip from pages""")
def _(v):
    k = F.col("page_id")
    body = F.regexp_replace(F.regexp_replace("html", "[0-9]", "#"), "[₹$]", "")
    body = F.regexp_replace(body, r"(?i)(Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)", "")
    text = F.concat(body, F.when(k % 3 == 0, " Sun 12 April, 2026 ").when(k % 3 == 1, " on 3 Jan ").otherwise(" "), F.when(k % 2 == 0, " 7:30 PM ").otherwise(" "),
                    F.when(k % 4 < 3, " ₹ 900 ₹500 ₹ 9 ₹900 ").otherwise(""), F.when(k % 4 < 2, "₹1,500 ").otherwise(""), F.when(k % 4 == 0, "₹ 4,000").otherwise(""))
    out = imports.pages_to_event_detail(v.pages.select("page_id", text.alias("text")), "2025-06-01")
    return out.select("page_id", "event_date", "event_time", F.array_join(F.transform("prices", lambda p: p.cast("int").cast("string")), ",").alias("prices"), "price_tier3", "price_tier2", "price_tier1", "price_vip")


# --- text -------------------------------------------------------------------------------


@query("date_from_text", """select o_orderkey, case o_orderkey % 5 when 0 then '2026-' || lpad((1 + o_orderkey % 12)::varchar, 2, '0') || '-' || lpad((1 + o_orderkey % 28)::varchar, 2, '0')
   when 1 then '2026-02-20' when 2 then '2026-03-04' when 3 then '2025-09-30' end as day from orders""")
def _(v):
    k = F.col("o_orderkey")
    full = F.date_format(F.make_date(F.lit(2026), (1 + k % 12).cast("int"), (1 + k % 28).cast("int")), "d MMMM, yyyy")
    text = F.when(k % 5 == 0, F.concat(F.lit("Live on "), full)).when(k % 5 == 1, "31 Feb 2026 or never").when(k % 5 == 2, "doors Mar 4 sharp").when(k % 5 == 3, "Sept 30 2024, now 30 SEP").otherwise("no day")
    return v.orders.select("o_orderkey", dates.date_from_text(text, "2025-06-01").alias("day"))


@query("price_from_text", """select o_orderkey, case o_orderkey % 3 when 0 then 1000 + o_orderkey % 100 when 1 then o_orderkey % 500 end::double as price from orders""")
def _(v):
    k = F.col("o_orderkey")
    text = F.when(k % 3 == 0, F.concat(F.lit("from ₹ 1,0"), F.lpad((k % 100).cast("string"), 2, "0"), F.lit(" up"))).when(k % 3 == 1, F.concat(F.lit("$"), (k % 500).cast("string"))).otherwise("free € ,")
    return v.orders.select("o_orderkey", dates.price_from_text(text).alias("price"))


@query("music_event_filter", f"""select doc_id, {any_in('lower(text)', N.MUSIC_WORDS)} and not {any_in('lower(text)', N.OTHER_EVENT_WORDS)} as music, {any_in("lower(text || ' near you')", N.LISTING_PHRASES)} as listing from documents""")
def _(v):
    return v.documents.select("doc_id", N.is_music_event(F.col("text"), F.lit("")).alias("music"), N.is_listing_page(F.concat("text", F.lit(" Near You"))).alias("listing"))


@query("artist_from_title", "select p_partkey, case when p_partkey % 3 = 2 then 'Live' else p_name end as artist from part")
def _(v):
    k = F.col("p_partkey")
    t = F.when(k % 3 == 0, F.concat("p_name", F.lit(" | Live at the park"))).when(k % 3 == 1, F.concat("p_name", F.lit(" performing"))).otherwise(" Live ")
    return v.part.select("p_partkey", N.artist_from_title(t).alias("artist"))


@query("place_from_text", "select s_suppkey, s_name as venue_name, 'New Delhi' as city, case when s_suppkey % 2 = 0 then 'India' else '' end as country from supplier")
def _(v):
    t = F.concat(F.lit("See it at "), "s_name", F.lit(", New Delhi"), F.when(F.col("s_suppkey") % 2 == 0, ", India. Soon").otherwise(""))
    return v.supplier.select("s_suppkey", *[c.alias(n) for n, c in N.place_from_text(t).items()])


@query("avg_price", """select source_event_id, case when price_min is not null and price_max is not null then (price_min + price_max) / 2 else coalesce(price_min, price_max) end as price from dv_raw""")
def _(v):
    return v.raw.select("source_event_id", N.avg_price(F.col("price_min"), F.col("price_max")).alias("price"))


@query("normalize_city", f"select concert_id, coalesce({eq_case('lower(city)', N.CONCERT_CITY_ALIASES)}, city) as city from dv_concerts")
def _(v):
    return N.normalize_city(v.concerts).select("concert_id", "city")


@query("normalize_venue", "select concert_id, coalesce(venue_name, '') as venue from dv_concerts")
def _(v):
    k = F.col("concert_id")
    raw = F.when(k % 3 == 0, F.concat("venue_name", F.lit("  -  mumbai"))).when(k % 3 == 1, F.concat("venue_name", F.lit(", India"))).otherwise(F.col("venue_name"))
    return v.concerts.select("concert_id", N.venue_key(raw).alias("venue"))


def _namekey(x: str, stop: list[str], amp: str = "and", fold: bool = False) -> str:
    if fold:
        x = f"translate(regexp_replace({x}, '([{X.MARKED}])', '\\1 ', 'g'), '{X.MARKED}{X.PLAIN}', '{X.MARKED_BASE}{X.PLAIN_BASE}')"
    x = f"regexp_replace(replace(lower({x}), '&', '{amp}'), '[^a-z0-9]+', ' ', 'g')"
    if stop:
        x = f"regexp_replace({x}, '\\b({'|'.join(stop)})\\b', ' ', 'g')"
    return f"trim(regexp_replace({x}, '\\s+', ' ', 'g'))"


_TRICKY = "t as (select doc_id, 'The ' || substr(text, 1 + doc_id % 40) || ' & Band (live)' as name from documents)"


@query("comparable_names", f"""with {_TRICKY} select doc_id, {_namekey('name', X.EVENT_STOP_WORDS, ' and ', True)} as event_key, {_namekey('name', X.ARTIST_STOP_WORDS)} as artist_key, {_namekey('name', [])} as token_key from t""")
def _(v):
    t = F.concat(F.lit("The "), F.expr("substring(text, cast(1 + doc_id % 40 as int))"), F.lit(" & Band (live)"))
    return v.documents.select("doc_id", X.event_name_key(t).alias("event_key"), X.artist_name_key(t).alias("artist_key"), X.token_key(t).alias("token_key"))


def _words(x: str) -> str:
    return f"list_filter(list_distinct(string_split({_namekey(x, [])}, ' ')), lambda w: w <> '')"


def _jac(a: str, b: str) -> str:
    return f"""case when len({_words(a)}) = 0 or len({_words(b)}) = 0 then 0 else len(list_intersect({_words(a)}, {_words(b)}))::double / len(list_distinct(list_concat({_words(a)}, {_words(b)}))) end"""


@query("name_similarity", f"""with n as (select source_event_id, artist_name as a, 'Customer Band & ' || source_event_id as b from dv_raw),
   k as (select *, {_namekey('a', X.ARTIST_STOP_WORDS)} ka, {_namekey('b', X.ARTIST_STOP_WORDS)} kb from n)
  select source_event_id, {up(_jac('a', 'b'), 6)} as jaccard, case when ka = '' or kb = '' then 0 when ka = kb then 1 when contains(ka, kb) or contains(kb, ka) then 0.86
    else {up("len(list_intersect(list_distinct(string_split(ka, ' ')), list_distinct(string_split(kb, ' '))))::double / len(list_distinct(list_concat(string_split(ka, ' '), string_split(kb, ' '))))", 6)} end::double as artist_match from k""")
def _(v):
    df = v.raw.select("source_event_id", F.col("artist_name").alias("a"), F.concat(F.lit("Customer Band & "), "source_event_id").alias("b"))
    r = lambda c: F.floor(c * 1e6 + 0.5) / 1e6
    return df.select("source_event_id", r(X.jaccard(F.col("a"), F.col("b"))).alias("jaccard"), r(X.artist_match(F.col("a"), F.col("b"))).alias("artist_match"))


@query("date_similarity", """select l_orderkey, l_linenumber, l_partkey, l_suppkey, case abs(date_diff('day', o_orderdate, l_shipdate)) when 0 then 1 when 1 then 0.9 when 2 then 0.65 else 0 end::double as day_score from lineitem join orders on l_orderkey = o_orderkey""")
def _(v):
    df = v.lineitem.join(v.orders, F.col("l_orderkey") == F.col("o_orderkey"))
    return df.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", X.date_similarity(F.col("o_orderdate").cast("date"), F.col("l_shipdate").cast("date")).alias("day_score"))


def _title(x: str) -> str:
    ups = ", ".join(lit(w) for w in X.UPPER_WORDS)
    return f"""coalesce(array_to_string(list_transform(list_filter(string_split(regexp_replace({x}, '\\s+', ' ', 'g'), ' '), lambda w: w <> ''), lambda w: case when lower(w) in ({ups}) then upper(w) else upper(w[1]) || lower(w[2:]) end), ' '), '')"""


def _disp(x: str) -> str:
    return f"trim(regexp_replace(regexp_replace(coalesce({x}, ''), '\\s+', ' ', 'g'), '[|]+', ' ', 'g'))"


def _land(x: str) -> str:
    return f"coalesce({eq_case('lower(' + x + ')', N.COUNTRY_ALIASES)}, {_title(x)})"


_STATES = "(" + ", ".join(lit(x) for x in N.SUBDIVISIONS) + ")"
_EVKEY = lambda x: _namekey(x, X.EVENT_STOP_WORDS, " and ", True)
_NORM = f"""r0 as (select *, {_disp('venue_name')} v, {_disp('city')} c, {_disp('country')} k from dv_raw),
  r1 as (select *, list_filter(list_transform(string_split(v, ','), lambda p: trim(p)), lambda p: p <> '') ps, v <> '' and c <> '' and k <> '' as whole from r0),
  r2 as (select *, len(ps) n, ps[len(ps)] last, list_filter(ps[2:len(ps) - 1], lambda p: upper(p) not in {_STATES}) towns from r1),
  r3 as (select *, case when not whole and (n >= 3 or (n = 2 and k <> '')) then ps[1] else v end v2,
     case when whole then c when n >= 3 then coalesce(nullif(c, ''), towns[len(towns)], ps[2]) when n = 2 and k <> '' then coalesce(nullif(c, ''), ps[2]) else c end c2,
     case when whole or n < 3 then k when k = '' then last when upper(last) in {_STATES} or {_EVKEY(_land('last'))} = {_EVKEY(_land('k'))} then k else last end k2 from r2),
  r4 as (select source_event_id, source_platform, source_url, official_ticket_url, verified_artist_account, price_min, price_max, artist_id, show_date, {_title(_disp('artist_name'))} an, {_disp('event_name')} en,
     {_title("regexp_replace(v2, '(?i)\\b(ltd|llc|pvt|private limited)\\b', '', 'g')")} vn, {_title('c2')} ct, {_land('k2')} kt,
     case when event_date like '%+1000' then (show_date + interval 9 hour)::date when event_date like '%+05:30' then (show_date - interval 4 hour)::date when event_date = 'soon' then null else show_date end dt,
     {up('greatest(0::double, least(1::double, coalesce(confidence_score, 0.5)))', 4)} cf from r3),
  norm as (select source_event_id as event_id, source_event_id, source_platform, source_url, official_ticket_url, verified_artist_account, price_min, price_max, artist_id, an as artist_name, en as event_name, vn as venue_name, coalesce({eq_case('lower(ct)', N.CITY_ALIASES)}, ct) as city, kt as country,
     dt as event_date, cf as confidence_score from r4 where an <> '' and vn <> '' and ct <> '' and kt <> '' and dt is not null),
  nev as (select *, {_EVKEY('artist_name')} na, {_EVKEY('venue_name')} nv, {_EVKEY('city')} nc, {_EVKEY('artist_name')} || '|' || {_EVKEY('venue_name')} || '|' || {_EVKEY('city')} || '|' || {_EVKEY('country')} || '|' || event_date::varchar as canonical_key from norm)"""


def _events(v):
    return N.normalize_events(v.raw).withColumn("event_id", F.col("source_event_id"))


@query("normalize_events", f"with {_NORM} select event_id, artist_name, event_name, venue_name, city, country, event_date::varchar as event_date, confidence_score, canonical_key from nev")
def _(v):
    return _events(v).select("event_id", "artist_name", "event_name", "venue_name", "city", "country", "event_date", "confidence_score", "canonical_key")


# --- vectors ----------------------------------------------------------------------------


@query("cosine_similarity", """with s as (select label, min(vec_id) m from embeddings group by 1), b as (select e.label, e.embedding from embeddings e join s on e.vec_id = s.m)
  select e.vec_id, round(list_cosine_similarity(e.embedding::double[], b.embedding::double[]), 5) as cosine from embeddings e join b using (label)""")
def _(v):
    base = v.embeddings.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("base"))
    return v.embeddings.join(base, "label").select("vec_id", F.round(V.cosine(F.col("embedding"), F.col("base")), 5).alias("cosine"))


_FNV = "list_reduce(list_prepend(2166136261::bigint, flatten(list_transform(regexp_extract_all(tok, '(?s).'), lambda ch: case when unicode(ch) > 65535 then [55296 + (unicode(ch) - 65536) // 1024, 56320 + (unicode(ch) - 65536) % 1024]::bigint[] else [unicode(ch)]::bigint[] end))), lambda h, x: (xor(h, x) * 16777619) % 4294967296)"


@query("hash_embedding", f"""with d as (select conv_id, turn, text, unnest(list_filter(string_split_regex(trim(text), '\\s+'), lambda w: w <> '')) tok from conversations), h as (select conv_id, turn, ({_FNV} % 384)::int i from d),
  e as (select conv_id, turn, i as idx, 1::double w from h union all select conv_id, turn, (i * 31) % 384, 0.5 from h), s as (select conv_id, turn, idx, sum(w) w from e group by all)
  select conv_id, turn, idx, round(round(w / sqrt(sum(w * w) over (partition by conv_id, turn)), 8), 5) as weight from s""")
def _(v):
    df = V.hash_embed(v.conversations.where("trim(text) <> ''").select(F.struct("conv_id", "turn").alias("k"), "text"), "k", "text")
    return df.select("k.conv_id", "k.turn", F.explode("embedding").alias("idx", "weight")).withColumn("weight", F.round("weight", 5))


# --- matching ---------------------------------------------------------------------------

_SQUASH = lambda x: f"replace({_EVKEY(x)}, ' ', '')"


@query("match_artist", f"""with ev as (select distinct artist_name, {_SQUASH('artist_name')} k from dv_raw), ar as (select artist_id, {_SQUASH('artist_name')} ak from dv_artists),
  m as (select ev.artist_name, artist_id, row_number() over (partition by ev.artist_name order by k <> ak, length(ak) desc, artist_id) rn from ev join ar on contains(k, ak) or contains(ak, k) where k <> '' and ak <> '')
  select artist_name, artist_id from m where rn = 1""")
def _(v):
    return pairs.match_artist(v.raw, v.artists)


_STORED = """stored as (select concert_id, artist_id, c.concert_date, city, venue_name, case when concert_id % 2 = 0 then 'id-' || concert_id end as source_event_id, case when concert_id % 3 = 0 then 'https://x.example/' || (concert_id % 500) end as source_url,
    c.concert_date - (concert_id % 30)::int as created_at from dv_concerts c),
  ev as (select concert_id as event_key, artist_id, c.concert_date as event_date, upper(city) as city, venue_name, case when concert_id % 4 = 0 then 'id-' || concert_id end as source_event_id, case when concert_id % 5 = 0 then 'https://x.example/' || (concert_id % 500) end as source_url from dv_concerts c)"""


def _stored(v):
    k = F.col("concert_id")
    url = F.concat(F.lit("https://x.example/"), (k % 500).cast("string"))
    ident = F.concat(F.lit("id-"), k.cast("string"))
    stored = v.concerts.select("concert_id", "artist_id", "concert_date", "city", "venue_name", F.when(k % 2 == 0, ident).alias("source_event_id"), F.when(k % 3 == 0, url).alias("source_url"),
                               F.date_sub("concert_date", (k % 30).cast("int")).alias("created_at"))
    ev = v.concerts.select(k.alias("event_key"), "artist_id", F.col("concert_date").alias("event_date"), F.upper("city").alias("city"), "venue_name",
                           F.when(k % 4 == 0, ident).alias("source_event_id"), F.when(k % 5 == 0, url).alias("source_url"))
    return ev, stored


@query("match_existing", f"""with {_STORED}, m as (select event_key, s.concert_id, row_number() over (partition by event_key order by s.created_at, s.concert_id) rn from ev e join stored s on s.artist_id = e.artist_id
   and (s.source_event_id = e.source_event_id or s.source_url = e.source_url or (s.concert_date = e.event_date and lower(s.city) = lower(e.city) and lower(s.venue_name) = lower(e.venue_name))))
  select e.event_key, m.concert_id as existing_id from ev e left join m on m.event_key = e.event_key and rn = 1""")
def _(v):
    ev, stored = _stored(v)
    return pairs.match_existing(ev, stored).select("event_key", "existing_id")


_VKEY = lambda x: f"lower(trim(regexp_replace(regexp_replace(coalesce({x}, ''), '(?i)\\s*[-:,]\\s*(Mumbai|Delhi|Bangalore|Chennai|Kolkata|India)$', ''), '\\s+', ' ', 'g')))"
# the rule written as one condition over all pairs, then closed transitively
_DUPS = f"""spelled as (select concert_id, artist_id, c0.concert_date as cdate, case when concert_id % 4 = 0 then '' when concert_id % 4 = 1 and city = 'Delhi' then 'New Delhi' else city end as city0,
    case when concert_id % 7 = 0 then '' when concert_id % 7 = 1 then 'The ' || venue_name || ', India' else venue_name end as venue0 from dv_concerts c0),
  dn as (select concert_id, artist_id, cdate, lower(coalesce({eq_case('lower(city0)', N.CONCERT_CITY_ALIASES)}, city0)) c, {_VKEY('venue0')} v,
    list_filter(string_split({_VKEY('venue0')}, ' '), lambda w: length(w) > 3)[1] w from spelled),
  pe as (select a.concert_id a, b.concert_id b from dn a join dn b on a.artist_id = b.artist_id and abs(a.cdate - b.cdate) <= 1 and a.concert_id < b.concert_id
    where ((a.c = b.c and a.c <> '') or ((a.c = '') <> (b.c = ''))) and (a.v = '' or b.v = '' or a.v = b.v or contains(a.v, b.v) or contains(b.v, a.v) or a.w = b.w)),
  sym as (select a, b from pe union select b, a from pe),
  reach(node, other) as (select a, b from sym union select r.node, s.b from reach r join sym s on s.a = r.other),
  grp as (select node as concert_id, least(node, min(other)) as root from reach group by node)"""


def _spelled(v):
    k = F.col("concert_id")
    city = F.when(k % 4 == 0, "").when((k % 4 == 1) & (F.col("city") == "Delhi"), "New Delhi").otherwise(F.col("city"))
    venue = F.when(k % 7 == 0, "").when(k % 7 == 1, F.concat(F.lit("The "), "venue_name", F.lit(", India"))).otherwise(F.col("venue_name"))
    return v.concerts.withColumn("venue_name", venue).withColumn("city", city)


@query("duplicate_groups", f"with recursive {_DUPS} select concert_id, root from grp")
def _(v):
    return pairs.duplicate_groups(_spelled(v))


_COMP = """case when coalesce(total_revenue, 0) > 0 then 100 else 0 end + case when coalesce(tickets_sold, 0) > 0 then 50 else 0 end + case when coalesce(avg_ticket_price, 0) > 0 then 20 else 0 end
  + case when coalesce(capacity, 0) > 0 then 10 else 0 end + case when coalesce(venue0, '') <> '' then 5 else 0 end + case when coalesce(city0, '') <> '' then 3 else 0 end"""


@query("duplicate_winner", f"""with recursive {_DUPS}, s as (select concert_id, {_COMP} as s from dv_concerts join spelled using (concert_id))
  select g.root as a, g.concert_id as b, sa.s as score_a, sb.s as score_b, case when sa.s >= sb.s then root else g.concert_id end as winner from grp g join s sa on sa.concert_id = root join s sb on sb.concert_id = g.concert_id where root <> g.concert_id""")
def _(v):
    c = _spelled(v)
    links = pairs.duplicate_groups(c).where("root <> concert_id").select(F.col("root").alias("a"), F.col("concert_id").alias("b"))
    return pairs.pick_winner(links, c).select("a", "b", "score_a", "score_b", "winner")


@query("dedup_concerts", f"""with recursive {_DUPS}, m as (select c.concert_id, c.artist_id, c.concert_date as cdate, venue0, total_revenue, tickets_sold, capacity, avg_ticket_price, coalesce(root, c.concert_id) root, {_COMP} as s from dv_concerts c join spelled using (concert_id) left join grp using (concert_id)),
  o as (select *, row_number() over (partition by root order by s desc, cdate, concert_id) rn from m)
  select arg_min(concert_id, rn) as concert_id, count(*) as merged, arg_min(venue0, rn) filter (where coalesce(venue0, '') <> '') as venue_name, coalesce(arg_min(tickets_sold, rn) filter (where tickets_sold <> 0), list(tickets_sold order by rn)[1]) as tickets_sold,
   coalesce(arg_min(total_revenue, rn) filter (where total_revenue <> 0), list(total_revenue order by rn)[1]) as total_revenue from o group by root""")
def _(v):
    return pairs.dedup_concerts(_spelled(v)).select("concert_id", "merged", F.nullif("venue_name", F.lit("")).alias("venue_name"), "tickets_sold", "total_revenue")


def _heads(v):
    """One event per canonical key with what pairs compare, read by both sides of every pair: written once."""
    e = _events(v)
    heads = e.groupBy("canonical_key").agg(F.min_by(F.struct(*pairs.COMPARED), "event_id").alias("r"))
    return cut_packed(heads.select("r.*"))


@query("score_duplicate_events")
def _(v):
    h = _heads(v)
    return pairs.score_duplicates(pairs.candidate_pairs(h, h), h, h).select("event_id", "canon_id", F.round("similarity", 3).alias("similarity"))


@query("best_duplicate_event")
def _(v):
    h = _heads(v)
    return pairs.best_duplicate(pairs.score_duplicates(pairs.candidate_pairs(h, h), h, h)).select("event_id", "canon_id", F.round("similarity", 3).alias("similarity"))


@query("resolve_events")
def _(v):
    return pairs.resolve_events(_events(v).select("canonical_key", *pairs.COMPARED)).select("event_id", "canonical_key", "target", "action")


@query("resolve_events_exact", f"""with {_NORM}, known as (select canonical_key, min(event_id) target from nev where artist_id % 2 = 0 group by 1)
  select event_id, target, 'updated' as action from nev join known using (canonical_key) where artist_id % 2 = 1 or true""")
def _(v):
    e = _events(v).select("canonical_key", "artist_id", *pairs.COMPARED)
    out = pairs.resolve_events(e.drop("artist_id"), e.where("artist_id % 2 = 0").drop("artist_id"))
    return out.join(e.where("artist_id % 2 = 0").select("canonical_key").distinct(), "canonical_key", "left_semi").select("event_id", "target", "action")


@query("validate_scraped", f"""with {_NORM}, e as (select *, {_namekey('artist_name', X.ARTIST_STOP_WORDS)} ka, {_namekey("'Customer ' || lpad(artist_id::varchar, 9, '0')", X.ARTIST_STOP_WORDS)} kb from nev),
  s as (select *, case when ka = kb then 1 when contains(ka, kb) or contains(kb, ka) then 0.86 else len(list_intersect(string_split(ka, ' '), string_split(kb, ' ')))::double / len(list_distinct(list_concat(string_split(ka, ' '), string_split(kb, ' ')))) end::double ns,
    year(event_date) between 1996 and 1999 yr, artist_id % 4 = 0 ex from e),
  c as (select *, case when source_platform = 'SETLIST_FM' then 0.45 else 0.25 end::double + case when yr then 0.15 else 0 end::double + case when ns >= 0.72 then ns * 0.2::double else 0 end + 0.12::double + case when source_url is not null then 0.08 else 0 end::double c0 from s),
  f as (select *, {up('case when ex then least(1::double, c0 + 0.08::double) else c0 end', 2)} conf from c)
  select event_id, conf as confidence, yr and ns >= 0.72 and conf >= 0.75 as valid from f""")
def _(v):
    e = _events(v).withColumn("source", F.col("source_platform")).withColumn("source_artist_name", F.concat(F.lit("Customer "), F.lpad(F.col("artist_id").cast("string"), 9, "0")))
    e = e.withColumn("existing_id", F.when(F.col("artist_id") % 4 == 0, F.col("artist_id")))
    return pairs.validate_scraped(e, 1996, 1999).select("event_id", "confidence", "valid")


# --- table writes -----------------------------------------------------------------------


@query("upsert_metrics", """with d as (select artist_id, platform, date + 1 as date, max(followers) + 5 as followers from dv_metrics where followers % 3 = 0 group by all)
  select coalesce(m.artist_id, d.artist_id) as artist_id, coalesce(m.platform, d.platform) as platform, coalesce(m.date, d.date)::varchar as date, coalesce(d.followers, m.followers) as followers, m.streams
  from dv_metrics m full outer join d on d.artist_id = m.artist_id and d.platform = m.platform and d.date = m.date""")
def _(v):
    delta = v.metrics.where("followers % 3 = 0").select("artist_id", "platform", F.date_add("date", 1).alias("date"), (F.col("followers") + 5).alias("followers"))
    return tables.upsert(v.metrics.select("artist_id", "platform", "date", "followers", "streams"), delta, ["artist_id", "platform", "date"])


# Three writes to a stored table: the day's reading, a newer and an older one (which must not win, and whose
# zero measure must keep the stored value), and a narrow delta; read back.
@query("upsert_stored_metrics", """select artist_id, platform, date::varchar as date,
   case when followers % 3 = 0 then followers + 5 when coalesce(followers, 0) = 0 then 7 else followers end as followers,
   coalesce(streams, 0) as streams, case when artist_id % 2 = 0 then 1.5::double end as rog_daily from dv_metrics""")
def _(v):
    path = f"{checkpoint_dir(v.spark)}/metrics-{uuid.uuid4().hex}"
    key = stream.KEY
    at = lambda hour: F.timestamp_seconds(F.unix_date("date").cast("long") * 86400 + hour * 3600)
    noon = v.metrics.select(*key, *stream.MEASURES).withColumn("ingested_at", at(12))
    newer = noon.where("followers % 3 = 0").withColumns({"followers": F.col("followers") + 5, "streams": F.lit(0).cast("long"), "ingested_at": at(20)})
    older = noon.withColumns({"followers": F.lit(7).cast("long"), "streams": F.lit(0).cast("long"), "ingested_at": at(8)})
    for batch in (noon, newer, older):
        tables.upsert_months(v.spark, path, stream.metric_delta(batch), key, "date", stream.KEEP_NEWEST)
    growth = noon.where("artist_id % 2 = 0").select(*key, F.lit(1.5).alias("rog_daily"))
    tables.upsert_months(v.spark, path, growth, key, "date")
    return tables.read_months(v.spark, path).select(*key, "followers", "streams", "rog_daily")


@query("upsert_predictions", """with r as (select *, row_number() over (partition by concert_id, model_version order by created_at desc, prediction_id desc, expected_revenue desc) rn from dv_predictions)
  select concert_id, model_version, created_at::varchar as created_at, prediction_id, expected_revenue from r where rn = 1""")
def _(v):
    p = v.predictions.select("concert_id", "model_version", "created_at", "prediction_id", "expected_revenue")
    return tables.latest_by_key(p, ["concert_id", "model_version"], ["created_at", "prediction_id", "expected_revenue"])


@query("apply_updates", """select concert_id, coalesce(case when concert_id % 3 = 0 then 111 end, tickets_sold) as tickets_sold, coalesce(case when concert_id % 3 = 0 and concert_id % 2 = 0 then 9.5 end::double, avg_ticket_price) as avg_ticket_price from dv_concerts""")
def _(v):
    k = F.col("concert_id")
    up_ = v.concerts.where(k % 3 == 0).select("concert_id", F.lit(111).alias("tickets_sold"), F.when(k % 2 == 0, F.lit(9.5)).alias("avg_ticket_price"))
    return tables.apply_updates(v.concerts, up_, "concert_id").select("concert_id", "tickets_sold", "avg_ticket_price")


@query("saved_recent", "select concert_id, prediction_id, created_at::varchar as created_at from dv_predictions order by dv_predictions.created_at desc, prediction_id, concert_id limit 25")
def _(v):
    p = v.predictions.withColumn("tie", F.struct("prediction_id", "concert_id"))
    return tables.saved_recent(p, "created_at", "tie", 25).select("concert_id", "prediction_id", "created_at")


@query("insert_new_concerts", f"""with have as (select c.*, a.artist_name from dv_concerts c join dv_artists a using (artist_id)),
   scr as (select case when artist_name like 'dj%' then 'dj customer ' || lpad(artist_id::varchar, 9, '0') else 'Customer#' || lpad(artist_id::varchar, 9, '0') end as artist_name, case when source_event_id like '%7' then 'Upcoming events near you' else 'show' end as event_name, coalesce(city, '') as city,
     show_date, case when source_event_id like '%3' then '' else venue_name end as venue, price_min, price_max from dv_raw),
   fr as (select artist_name, city, show_date, venue, min(row(coalesce(price_min, -1e18), coalesce(price_max, -1e18))) p from scr s where event_name = 'show'
     and not (s.venue = '' and (s.artist_name, s.city, s.show_date) in (select (artist_name, city, h.concert_date) from have h))
     and not (s.venue <> '' and (s.artist_name, s.city, s.show_date, s.venue) in (select (artist_name, city, h.concert_date, coalesce(venue_name, '')) from have h)) group by 1, 2, 3, 4),
   ar as (select artist_id, {_SQUASH('artist_name')} ak from dv_artists), fk as materialized (select distinct artist_name, {_SQUASH('artist_name')} k from fr), m as (select f.artist_name, artist_id, row_number() over (partition by f.artist_name order by k <> ak, length(ak) desc, artist_id) rn
      from fk f join ar on contains(k, ak) or contains(ak, k))
  select artist_id, f.artist_name, coalesce(nullif(city, ''), 'TBA') as city, show_date::varchar as concert_date, nullif(venue, '') as venue_name, 'PENDING' as verification_status from fr f join m using (artist_name) where rn = 1
  union all select artist_id, artist_name, city, concert_date::varchar, venue_name, verification_status from have""")
def _(v):
    names = v.artists.select("artist_id", "artist_name")
    have = v.concerts.join(names, "artist_id")
    art = F.lpad(F.col("artist_id").cast("string"), 9, "0")
    scr = v.raw.select(
        F.when(F.col("artist_name").startswith("dj"), F.concat(F.lit("dj customer "), art)).otherwise(F.concat(F.lit("Customer#"), art)).alias("artist_name"),
        F.when(F.col("source_event_id").endswith("7"), "Upcoming events near you").otherwise("show").alias("event_name"), F.coalesce("city", F.lit("")).alias("city"), F.col("show_date").alias("concert_date"),
        F.when(F.col("source_event_id").endswith("3"), "").otherwise(F.col("venue_name")).alias("venue_name"), F.lit("India").alias("country"), "price_min", "price_max",
        F.lit("INR").alias("currency"), F.lit("songkick").alias("source"), F.lit("").alias("source_url"))
    return tables.insert_new_concerts(scr, have, names).select("artist_id", "artist_name", "city", "concert_date", "venue_name", "verification_status")
