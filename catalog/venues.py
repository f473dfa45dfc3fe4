"""Money, prices and venue capacity."""

from __future__ import annotations

from pyspark.sql import functions as F

from backline.functions import refdata as R
from backline.functions.gazetteer import CITY_COORDINATES, KNOWN_VENUES
from backline.operators import capacity, demand, money, normalize, pricing
from catalog.base import any_in, clamp_sql, eq_case, even, in_case, lit, query, up
from catalog.metrics import _MAJOR, tier_sql

# --- money ------------------------------------------------------------------------------


@query("currency_of_country", f"""select distinct country, coalesce({eq_case('lower(country)', R.COUNTRY_CURRENCY)}, {in_case('lower(country)', R.COUNTRY_CURRENCY, "'USD'")}) as currency,
  {in_case('lower(country)', R.COUNTRY_CURRENCY, "'USD'")} as first_hit from dv_concerts""")
def _(v):
    c = F.col("country")
    return v.concerts.select("country").distinct().select("country", money.currency_of(c).alias("currency"), money.currency_of(c, first_hit=True).alias("first_hit"))


@query("service_currency", f"""select concert_id, case when regexp_matches(currency, '^[A-Z]{{3}}$') then currency when contains(lower(country), 'india') then 'INR' when contains(lower(country), 'united states') then 'USD'
  when contains(lower(country), 'united kingdom') then 'GBP' when contains(lower(country), 'australia') then 'AUD' when contains(lower(country), 'canada') then 'CAD' when contains(lower(country), 'emirates') then 'AED'
  when contains(lower(country), 'singapore') then 'SGD' when contains(lower(country), 'new zealand') then 'NZD' when {any_in('lower(country)', R.EURO_COUNTRIES)} then 'EUR' else 'USD' end as currency from dv_concerts""")
def _(v):
    return v.concerts.select("concert_id", money.service_currency(F.col("country"), F.col("currency")).alias("currency"))


@query("convert_to_usd", f"""select concert_id, {even(f"total_revenue / ({eq_case('currency', R.USD_RATES, '1')})::double", 2)} as revenue_usd, {even(f"avg_ticket_price * ({eq_case('currency', R.USD_RATES, '1')})::double", 2)} as price_local from dv_concerts""")
def _(v):
    code = F.coalesce("currency", F.lit(""))
    return v.concerts.select("concert_id", money.local_to_usd(F.col("total_revenue"), code).alias("revenue_usd"), money.usd_to_local(F.col("avg_ticket_price"), code).alias("price_local"))


_SRATE = f"({eq_case('currency', R.SERVICE_RATES_TO_INR)})::double"


@query("convert_to_inr", f"""select concert_id, {up(f'total_revenue * {_SRATE}', 2)} as converted, {_SRATE} as rate_to_inr, case when {_SRATE} is not null then '{R.SERVICE_RATES_AS_OF}' end as rate_as_of from dv_concerts""")
def _(v):
    return money.convert(v.concerts, money.default_rates(v.spark), "total_revenue", "currency").select("concert_id", "converted", "rate_to_inr", "rate_as_of")


@query("convert_from_inr", f"select concert_id, {up(f'total_revenue / {_SRATE}', 2)} as converted from dv_concerts")
def _(v):
    return money.convert(v.concerts, money.default_rates(v.spark), "total_revenue", "currency", to_inr=False).select("concert_id", "converted")


@query("rate_overrides", """select n_nationkey, cur as currency, rate as rate_to_inr from (
   select n_nationkey, 'USD' cur, (80 + n_nationkey)::double rate from nation union all select n_nationkey, 'EUR', (n_nationkey - 3)::double from nation) where rate > 0""")
def _(v):
    n = F.col("n_nationkey").cast("string")
    usd, eur = (F.col("n_nationkey") + 80).cast("string"), (F.col("n_nationkey") - 3).cast("string")
    as_json = F.concat(F.lit('{"usd": '), usd, F.lit(', "eur": "'), eur, F.lit('", "gbp": "x"}'))
    as_list = F.concat(F.lit("usd: "), usd, F.lit(" , EUR:"), eur, F.lit(",,bad"))
    t = v.nation.select("n_nationkey", F.when(F.col("n_nationkey") % 2 == 0, as_json).otherwise(as_list).alias("value"))
    return money.parse_rates(t)


@query("with_coordinates", f"""select concert_id, {eq_case('lower(city)', {k: a for k, (a, b) in CITY_COORDINATES.items()})} as latitude, {eq_case('lower(city)', {k: b for k, (a, b) in CITY_COORDINATES.items()})} as longitude from dv_concerts""")
def _(v):
    return normalize.with_coordinates(v.concerts).select("concert_id", "latitude", "longitude")


# --- prices -----------------------------------------------------------------------------

_KIND = in_case("lower(venue_name)", R.VENUE_TYPES, "''")
_INPUT = f"""pin as (select concert_id, c.artist_id, city, country, currency, venue_name, capacity, tickets_sold, coalesce(popularity, 50)::double as a,
   least(100, greatest(0, coalesce(popularity, 50) * ({eq_case('lower(city)', demand.CITY_MULTIPLIERS, '0.7')})::double)) as c,
   case when capacity > 0 then capacity else 5000 end as cap, case when venue_name is null then '' else {_KIND} end as kind
  from dv_concerts c join (select artist_id, popularity from dv_artists) using (artist_id))"""


def _inputs(v):
    df = v.concerts.join(v.artists.select("artist_id", "popularity"), "artist_id")
    df = df.withColumn("artist_popularity", F.coalesce("popularity", F.lit(50.0)))
    return df.withColumn("city_popularity", demand.city_popularity(F.col("artist_popularity"), F.col("city"))).withColumn(
        "venue_capacity", F.when(F.col("capacity") > 0, F.col("capacity")).otherwise(F.lit(5000))
    ).withColumn("venue_type", F.when(F.col("venue_name").isNull(), F.lit("")).otherwise(capacity.venue_type_of(F.col("venue_name"))))


def _price(boosts: dict, src: str = "pin") -> str:
    scarcity = "case when cap < 500 then 1.3 when cap < 2000 then 1.1 when cap < 10000 then 1.0 when cap < 30000 then 0.9 else 0.75 end::double"
    base = f"""greatest(500::double, (800 + a * 12 + c * 8) * (1 + ({eq_case('lower(city)', boosts, '0')})::double / 100) * {scarcity} * ({in_case('kind', R.VENUE_MULTIPLIERS, '1.0')})::double)"""
    return f"""pb as (select *, {base} as base, ({eq_case('lower(city)', boosts, '0')})::double as boost from {src}),
      pt as (select *, {even('base * 4.5::double')} as vip, {even('base * 2.2::double')} as tier1, {even('base')} as tier2, {even('base * 0.5::double')} as tier3,
        greatest(10::double, least(95::double, c * 0.65::double + a * 0.25::double + boost * 0.3::double)) as demand from pb),
      pm as (select *, vip * 0.1::double + tier1 * 0.2::double + tier2 * 0.4::double + tier3 * 0.3::double as mean_price,
        greatest(0.15::double, least(0.9::double, greatest(0.15::double, least(0.85::double, 0.25::double + (demand - 10) / 85 * 0.5::double)) *
          case when cap < 1000 then 1.3 when cap < 5000 then 1.1 when cap < 20000 then 1.0 else 0.8 end::double)) as st from pt),
      ps as (select *, least({even('cap * st')}, cap)::bigint as sold from pm)"""


@query("price_tiers", f"with {_INPUT}, {_price(R.PRICING_BOOST)} select concert_id, vip, tier1, tier2, tier3, {up('mean_price', 2)} as mean_price from ps")
def _(v):
    out = pricing.price_tiers(_inputs(v))
    return out.select("concert_id", "vip", "tier1", "tier2", "tier3", (F.floor(F.col("mean_price") * 100.0 + 0.5) / 100.0).alias("mean_price"))


@query("predict_sales", f"with {_INPUT}, {_price(R.PRICING_BOOST)} select concert_id, sold as tickets_sold, {up('demand', 4)} as demand_score from ps")
def _(v):
    out = pricing.predict_sales(_inputs(v))
    return out.select("concert_id", "tickets_sold", (F.floor(F.col("demand_score") * 10000.0 + 0.5) / 10000.0).alias("demand_score"))


_USDR = f"({eq_case('cur', R.USD_RATES, '1')})::double"


@query("pricing_report", f"""with {_INPUT}, {_price(R.PRICING_BOOST)}, pl as (select *, coalesce(currency, 'INR') cur from ps),
   pr as (select *, mean_price * case when cur = 'INR' then 1 else (1::double / 84::double) * {_USDR} end as lp from pl)
  select concert_id, cur as currency, sold as tickets_sold, {even('lp', 2)} as avg_ticket_price, {even('sold * lp', 2)} as total_revenue, {even('demand', 2)} as demand_score,
   {even(f'sold * lp / {_USDR}', 2)} as total_revenue_usd, {even(f'lp / {_USDR}', 2)} as avg_ticket_price_usd, {_USDR} as exchange_rate from pr""")
def _(v):
    df = _inputs(v).select("concert_id", "artist_popularity", "city_popularity", "venue_capacity", "venue_type", "city", "currency")
    return pricing.pricing_report(df).select("concert_id", "currency", "tickets_sold", "avg_ticket_price", "total_revenue", "demand_score", "total_revenue_usd", "avg_ticket_price_usd", "exchange_rate")


_BATCH = _INPUT.replace("case when capacity > 0 then capacity else 5000 end as cap", "greatest(100, coalesce(nullif(capacity, 0), 5000))::double as cap")


@query("price_all_concerts", f"""with {_BATCH}, {_price(R.BATCH_BOOST)} select concert_id, sold as tickets_sold, {even('mean_price', 2)} as avg_ticket_price, {even('sold * mean_price', 2)} as total_revenue,
   {even('demand', 2)} as demand_score, case when capacity > 0 then {up('least(0.99::double, sold::double / nullif(capacity, 0))', 4)} else 0 end as sellout_probability from ps""")
def _(v):
    df = _inputs(v).drop("venue_capacity", "demand_score", "tickets_sold", "avg_ticket_price", "total_revenue")
    return pricing.price_all_concerts(df).select("concert_id", "tickets_sold", "avg_ticket_price", "total_revenue", "demand_score", "sellout_probability")


@query("price_fallback", f"""with {_BATCH}, b as (select *, case when {_MAJOR} then 8 else 0 end::double as boost from pin),
   d as (select *, greatest(250::double, (350 + a * 14 + coalesce(nullif(c, 0), a) * 9) * (1 + boost / 100) * case when cap < 1000 then 1.18 when cap > 20000 then 0.88 else 1 end::double) as base,
     greatest(5::double, least(100::double, coalesce(nullif(c, 0), a) * 0.72::double + a * 0.18::double + boost)) as dem from b),
   e as (select *, {up('base * 3.1::double')} vip, {up('base * 1.55::double')} tier1, {up('base')} tier2, {up('base * 0.62::double')} tier3,
     least(cap, {up('cap * greatest(0.15::double, least(0.97::double, 0.22::double + dem / 125))')})::bigint sold from d),
   f as (select *, vip * 0.08::double + tier1 * 0.22::double + tier2 * 0.38::double + tier3 * 0.32::double as m from e)
  select concert_id, vip, tier1, tier2, tier3, sold as tickets_sold, {up('m', 2)} as avg_ticket_price, {up('sold * m', 2)} as total_revenue, {up('dem', 2)} as demand_score from f""")
def _(v):
    df = _inputs(v).drop("venue_capacity", "demand_score", "tickets_sold", "avg_ticket_price", "total_revenue")
    return pricing.price_fallback(df).select("concert_id", "vip", "tier1", "tier2", "tier3", "tickets_sold", "avg_ticket_price", "total_revenue", "demand_score")


@query("tiers_from_mean", f"""select concert_id, {up('avg_ticket_price * 2.5::double')} as vip, {up('avg_ticket_price * 1.35::double')} as tier1, {up('avg_ticket_price')} as tier2, {up('avg_ticket_price * 0.65::double')} as tier3,
   {up('greatest(1, avg_ticket_price) * 0.75::double * 100')} / 100 as price_min, {up('greatest(1, avg_ticket_price) * 1.85::double * 100')} / 100 as price_max from dv_concerts where avg_ticket_price is not null""")
def _(v):
    cols = pricing.tiers_from_avg(F.col("avg_ticket_price"))
    return v.concerts.where("avg_ticket_price is not null").select("concert_id", *[c.alias(n) for n, c in cols.items()])


_DEFAULT_PRICE = f"""case when contains(lower(country), 'india') then 1250 when contains(lower(country), 'united states') then 65 when contains(lower(country), 'united kingdom') then 50
  when contains(lower(country), 'australia') then 75 when contains(lower(country), 'canada') then 70 when {any_in('lower(country)', R.EURO_COUNTRIES)} then 55 else 45 end"""


@query("default_price_by_country", f"select distinct country, {_DEFAULT_PRICE}::double as price from dv_concerts")
def _(v):
    return v.concerts.select("country").distinct().select("country", pricing.default_price(F.col("country")).alias("price"))


_GRID = f"""per as (select artist_id, count(*) n, sum(coalesce(tickets_sold, 0))::double t, sum(coalesce(total_revenue, 0)::decimal(24,4))::double r, sum(coalesce(avg_ticket_price, 0)::decimal(24,4))::double p from dv_concerts group by 1),
  st as (select artist_id, coalesce(nullif(floor(t / n), 0), 15000) avt, coalesce(nullif(p / n, 0), nullif(r / nullif(t, 0), 0), 2000) ap from dv_artists left join per using (artist_id)),
  ct(city, m, d) as (values {", ".join(f"('{c}', {m}::double, {d}::double)" for c, m, d in R.GRID_CITIES)}),
  g0 as (select artist_id, city, d, floor(avt * 1.2::double * m) cap, floor(avt * m) tix, ap * m price from st, ct),
  g1 as (select *, tix * price tr, tix * price * 0.18::double * (d / 100) sr from g0), g2 as (select *, tr + sr total from g1),
  grid as (select artist_id, city, cap as capacity, tix as tickets, {up('price', 4)} as price, {up('tr', 2)} as ticket_revenue, {up('sr', 2)} as sponsor_revenue, {up('total', 2)} as total_revenue,
   {up('case when cap > 0 then least(tix / cap, 0.99::double) else 0 end * 100', 4)} as sell_through,
   {up('case when total > 0 then (total - total * 0.45::double) / (total * 0.45::double) * 100 else 0 end', 4)} as roi,
   least({up('d * 0.6::double + tix / 50000 * 40')}, 99) as popularity_score, d as demand from g2)"""


@query("city_profitability", f"with {_GRID} select * from grid")
def _(v):
    return pricing.city_profitability(v.artists, v.concerts)


@query("apply_prediction", f"""with {_GRID}, m as (select artist_id, city, max(capacity) mc, max(coalesce(avg_ticket_price, 0)) mp, max(total_revenue) mr, max(demand_score) md from dv_concerts where total_revenue > 0 group by 1, 2),
   j as (select g.*, mr is not null and mr > 0 hit, coalesce(nullif(mc, 0), capacity)::double c2, coalesce(nullif(mp, 0), price) p2, mr, md from grid g left join m using (artist_id, city)),
   k as (select *, case when c2 > 0 and p2 > 0 then least(c2, {up('mr / p2')}) else tickets end t2 from j)
  select artist_id, city, case when hit then c2 else capacity end as capacity, case when hit then t2 else tickets end as tickets, case when hit then mr else total_revenue end as total_revenue,
   case when hit then {up('case when c2 > 0 then t2 / c2 * 100 else sell_through end', 4)} else sell_through end as sell_through,
   case when hit then {up('coalesce(nullif(md, 0), demand)')} else demand end as demand, case when hit then 80 end::double as confidence from k""")
def _(v):
    m = v.concerts.where("total_revenue > 0").groupBy("artist_id", "city").agg(
        F.max("capacity").alias("venue_capacity"), F.max(F.coalesce("avg_ticket_price", F.lit(0.0))).alias("avg_ticket_price"),
        F.max("total_revenue").alias("predicted_revenue"), F.max("demand_score").alias("demand_score_used")).withColumn("confidence", F.lit(0.8))
    out = pricing.apply_prediction(pricing.city_profitability(v.artists, v.concerts), m)
    return out.select("artist_id", "city", "capacity", "tickets", "total_revenue", "sell_through", "demand", "confidence")


@query("sponsor_split", f"select concert_id, {up('coalesce(total_revenue, 0) * 0.15::double', 2)} as sponsor_revenue, {up('coalesce(total_revenue, 0) - coalesce(total_revenue, 0) * 0.15::double', 2)} as ticket_revenue from dv_concerts")
def _(v):
    return pricing.sponsor_split(v.concerts).select("concert_id", "sponsor_revenue", "ticket_revenue")


# --- capacity ---------------------------------------------------------------------------

_KNOWN = "kv(ord, kname, kcity, n) as (values " + ", ".join(f"({i}, {lit(a)}, {lit(b)}, {n})" for i, (a, b, n) in enumerate(KNOWN_VENUES)) + ")"


def _known(src: str) -> str:
    """Every (name, city) of ``src`` with its listed capacity."""
    return f"""{_KNOWN}, places as (select distinct name, city from {src}),
      listed as (select name, city, coalesce(min(n) filter (where lower(name) = kname and lower(city) = kcity), arg_min(n, ord)) as known from places, kv
        where (contains(lower(name), kname) and contains(lower(city), kcity)) or (contains(kname, lower(name)) and contains(kcity, lower(city))) group by 1, 2)"""


_NAMES = """nm as (select s_suppkey as venue_key, case s_suppkey % 5 when 0 then split_part(v.venue_name, ' ', 2) when 1 then 'The O2 Arena ' || s_suppkey when 2 then 'singapore indoor stadium' when 3 then 'Forum ' || v.city else v.venue_name end as name,
   v.city, v.country from supplier join dv_venues v on venue_id = s_suppkey)"""


def _names(v):
    w = v.venues
    k = F.col("venue_id") % 5
    name = (
        F.when(k == 0, F.split("venue_name", " ")[1]).when(k == 1, F.concat(F.lit("The O2 Arena "), F.col("venue_id").cast("string")))
        .when(k == 2, F.lit("singapore indoor stadium")).when(k == 3, F.concat(F.lit("Forum "), F.col("city"))).otherwise(F.col("venue_name"))
    )
    return w.select(F.col("venue_id").alias("venue_key"), name.alias("venue_name"), "city", "country")


@query("known_capacity", f"with {_NAMES}, {_known('nm')} select venue_key, name as venue_name, city, known as known_capacity from nm left join listed using (name, city)")
def _(v):
    return capacity.with_known_capacity(_names(v)).select("venue_key", "venue_name", "city", "known_capacity")


def _cands(key: str, src: str, text: str = "text") -> str:
    approx = f"case when {any_in('low', R.APPROXIMATE_WORDS)} then 0.12 else 0 end::double"
    scale = lambda s: f"case lower(trim(coalesce({s}, ''))) when 'k' then 1000 when 'm' then 1000000 else 1 end"
    return f"""lows as (select {key}, lower(trim(regexp_replace({text}, '\\s+', ' ', 'g'))) low from {src} where {text} is not null and {text} <> ''),
      m1 as (select {key}, low, unnest(regexp_extract_all(low, '{R.CAPACITY_LABEL}', 1)) v, unnest(regexp_extract_all(low, '{R.CAPACITY_LABEL}', 2)) s, 'context_text_extraction' as method, 0.9::double as conf from lows),
      m2 as (select {key}, low, unnest(regexp_extract_all(low, '{R.CAPACITY_INLINE}', 1)) v, unnest(regexp_extract_all(low, '{R.CAPACITY_INLINE}', 2)) s, 'inline_text_extraction' as method, 0.7::double as conf from lows),
      cands as (select {key}, {even(f"replace(v, ',', '')::double * {scale('s')}")}::bigint as capacity, method, max(greatest(0.35::double, least(0.98::double, conf - {approx}))) as confidence
        from (select * from m1 union all select * from m2) where replace(v, ',', '')::double > 0 group by 1, 2, 3)"""


@query("capacity_candidates", f"with {_cands('venue_key', 'dv_venue_texts')} select venue_key, capacity, method, {up('confidence', 4)} as confidence from cands where capacity > 0")
def _(v):
    return capacity.capacity_candidates(v.venue_texts, "venue_key").select("venue_key", "capacity", "method", F.round("confidence", 4).alias("confidence"))


@query("capacity_candidates_by_group", f"with {_cands('venue_group', 'dv_venue_texts')} select venue_group, capacity, method, {up('confidence', 4)} as confidence from cands where capacity > 0")
def _(v):
    return capacity.capacity_candidates(v.venue_texts, "venue_group").select("venue_group", "capacity", "method", F.round("confidence", 4).alias("confidence"))


_PAGE_TEXT = "pt as (select page_id, html || ' seating capacity of ' || (page_id * 37 + 60) || ' and holds ' || (page_id % 9) || 'k people' as text from pages)"


@query("capacity_candidates_pages", f"with {_PAGE_TEXT}, {_cands('page_id', 'pt')} select page_id, capacity, method, {up('confidence', 4)} as confidence from cands where capacity > 0")
def _(v):
    t = v.pages.select("page_id", F.concat("html", F.lit(" seating capacity of "), (F.col("page_id") * 37 + 60).cast("string"), F.lit(" and holds "), (F.col("page_id") % 9).cast("string"), F.lit("k people")).alias("text"))
    return capacity.capacity_candidates(t, "page_id").select("page_id", "capacity", "method", F.round("confidence", 4).alias("confidence"))


def _simple(x: str) -> str:
    return f"trim(regexp_replace(lower({x}), '[^a-z0-9]+', ' ', 'g'))"


def _estimate(src: str) -> str:
    """``src``: venue_key, name, city, country, kind, tier -> est with ecap, econf."""
    base = in_case("hint", R.VENUE_BASELINES)
    return f"""e0 as (select *, {_simple('name')} sname, {_simple("case when kind <> '' then kind else name end")} hint, {_simple('city')} scity from {src}),
      e1 as (select *, {base} by_type, {eq_case('tier', R.TIER_BASE)} by_tier, case when {any_in('scity', R.CITY_TIER_1)} then 1 when {any_in('scity', R.CITY_TIER_2)} then 2 else 3 end ctier from e0),
      est as (select * exclude (sname, hint, scity, by_type, by_tier), greatest(100, {even(f"coalesce(by_type, by_tier, 5000)::double * case ctier when 1 then 1 when 2 then 0.72 else 0.45 end::double * case when by_tier is not null and by_type is null then 1 else {eq_case('tier', R.TIER_MULTIPLIER, '1')} end::double")})::bigint as ecap,
        greatest(0.35::double, least(0.82::double, 0.44::double + case when {any_in('sname', ['stadium', 'arena', 'festival', 'grounds'])} then 0.18 else 0 end::double + case when {any_in('sname', ['club', 'lounge', 'bar'])} then 0.12 else 0 end::double + case ctier when 1 then 0.08 else 0 end::double)) as econf from e1)"""


_TIERED = f"""vin as (select venue_key, name, city, country, case when venue_key % 3 = 0 then '' else {in_case('lower(name)', R.VENUE_TYPES, "''")} end as kind,
   case venue_key % 6 when 0 then 'superstar' when 1 then 'major' when 2 then 'mid' when 3 then 'rising' when 4 then 'micro' end as tier, case when venue_key % 4 = 1 then venue_key * 53 end as supplied from nm)"""


def _tiered(v):
    k = F.col("venue_key")
    kind = F.when(k % 3 == 0, F.lit("")).otherwise(capacity.venue_type_of(F.col("venue_name")))
    tier = F.when(k % 6 == 0, "superstar").when(k % 6 == 1, "major").when(k % 6 == 2, "mid").when(k % 6 == 3, "rising").when(k % 6 == 4, "micro")
    return _names(v).select("*", kind.alias("venue_type"), tier.alias("artist_tier"), F.when(k % 4 == 1, k * 53).alias("supplied_capacity"))


@query("estimate_capacity", f"with {_NAMES}, {_TIERED}, {_estimate('vin')} select venue_key, ecap as capacity, {up('econf', 4)} as confidence from est")
def _(v):
    return capacity.estimate_capacity(_tiered(v)).select("venue_key", "capacity", F.round("confidence", 4).alias("confidence"))


def _validate(src: str) -> str:
    """``src``: name, kind, tier, capacity, confidence, source, method."""
    checks = [
        ("capacity < 100", "capacity is unusually small", 0.1), ("capacity > 200000", "capacity is unusually large", 0.2),
        ("source = 'heuristic'", "capacity was estimated from venue metadata", 0.05), ("method like '%text_extraction'", "capacity was extracted from source text", 0.0),
        (f"{any_in(_simple('name'), ['stadium', 'arena', 'grounds', 'festival'])} and capacity < 1000", "venue type and capacity look inconsistent", 0.15),
        (f"{any_in(_simple('kind'), ['club', 'lounge', 'bar'])} and capacity > 10000", "small-venue type and capacity look inconsistent", 0.15),
        ("coalesce(tier, '') in ('superstar', 'major') and capacity < 500", "artist tier likely needs a larger venue", 0.08),
    ]
    cost = "".join(f" - case when {c} then {x} else 0 end::double" for c, _, x in checks if x)
    why = "concat_ws('; ', " + ", ".join(f"case when {c} then '{t}' end" for c, t, _ in checks) + ")"
    return f"""w0 as (select * exclude (confidence), {even(f'greatest(0.05::double, least(0.99::double, confidence{cost}))', 4)} as confidence, {why} as reasons from {src}),
      w1 as (select *, case when confidence >= 0.82 and capacity >= 100 then 'validated' when confidence >= 0.6 then 'review_required' when source = 'heuristic' then 'estimated' else 'review_required' end as status from w0),
      valid as (select *, greatest(1, {even("capacity * case when status = 'validated' then 0.08 else 0.18 end::double")}::bigint) as spread from w1)"""


@query("validate_capacity", f"""with {_NAMES}, {_TIERED}, {_estimate('vin')}, ch as (select venue_key, name, kind, tier, ecap as capacity, econf as confidence, 'heuristic' as source, 'metadata_estimate' as method from est), {_validate('ch')}
  select venue_key, capacity, confidence, reasons, status, greatest(1, capacity - spread) as capacity_min, capacity + spread as capacity_max from valid""")
def _(v):
    df = capacity.estimate_capacity(_tiered(v)).withColumn("source", F.lit("heuristic")).withColumn("method", F.lit("metadata_estimate"))
    out = capacity.validate_capacity(df)
    return out.select("venue_key", "capacity", "confidence", F.array_join("reasons", "; ").alias("reasons"), "status", "capacity_min", "capacity_max")


_STORED = "case when coalesce(capacity_min, 0) = 0 and coalesce(capacity_max, 0) > 0 then capacity_max when coalesce(avg_capacity, 0) > 0 then avg_capacity when coalesce(capacity_max, 0) > 0 then capacity_max when capacity_min > 0 then capacity_min end"
_RESOLVE = f"""with {_NAMES}, {_TIERED}, {_known('nm')}, {_cands('venue_key', 'dv_venue_texts')}, {_estimate('vin')},
  ev as (select venue_key, capacity, confidence, 'source_text' source, method from cands where capacity > 0
    union all select venue_key, known, 0.98, 'known_venues_db', 'curated_lookup' from vin join listed using (name, city)
    union all select venue_key, supplied, 0.95, 'supplied', 'explicit_input' from vin where supplied <> 0
    union all select i.venue_key, {_STORED}, case when verified then 0.96 else 0.84 end, 'venue_db', 'database_lookup' from vin i join dv_venues w on lower(w.venue_name) = lower(i.name) and lower(w.city) = lower(i.city) and lower(w.country) = lower(i.country) where coalesce({_STORED}, 0) <> 0),
  every as (select * from ev union all select venue_key, ecap, econf, 'heuristic', 'metadata_estimate' from est where venue_key not in (select venue_key from ev)),
  ranked as (select *, row_number() over (partition by venue_key order by confidence desc, capacity, source desc) rn from every),
  ch as (select i.venue_key, i.name, kind, tier, capacity, confidence::double as confidence, source, method from vin i join ranked r on r.venue_key = i.venue_key and rn = 1), {_validate('ch')}
  select venue_key, capacity, confidence, source, method, reasons, status, greatest(1, capacity - spread) as capacity_min, capacity + spread as capacity_max from valid"""


@query("resolve_capacity", _RESOLVE)
def _(v):
    out = capacity.resolve_capacity(_tiered(v), v.venues, v.venue_texts.select("venue_key", "text"))
    return out.select("venue_key", "capacity", "confidence", "source", "method", F.array_join("reasons", "; ").alias("reasons"), "status", "capacity_min", "capacity_max")


_SNIPS = """res as (select p_partkey % 100 as venue_key, case p_partkey % 100 % 4 when 0 then 'Royal Arena' when 1 then 'Blue Club' when 2 then 'Open Air' else 'Metro Theatre' end as venue_name,
   case p_partkey % 7 when 0 then 'knowledge_graph' when 1 then 'answer_box' else 'organic' end as section, p_name as title, t.text as snippet,
   case p_partkey % 5 when 0 then 'https://en.wikipedia.org/wiki/x' when 1 then 'https://www.ticketmaster.com/v' when 2 then null else 'https://blog.example.com' end as link
  from part join dv_venue_texts t on t.venue_key = p_partkey)"""


def _snips(v):
    k = F.col("p_partkey")
    t = v.venue_texts.select(F.col("venue_key").alias("p_partkey"), F.col("text").alias("snippet"))
    key = k % 100
    return v.part.join(t, "p_partkey").select(
        key.alias("venue_key"), F.when(key % 4 == 0, "Royal Arena").when(key % 4 == 1, "Blue Club").when(key % 4 == 2, "Open Air").otherwise("Metro Theatre").alias("venue_name"),
        F.when(k % 7 == 0, "knowledge_graph").when(k % 7 == 1, "answer_box").otherwise("organic").alias("section"), F.col("p_name").alias("title"), "snippet",
        F.when(k % 5 == 0, "https://en.wikipedia.org/wiki/x").when(k % 5 == 1, "https://www.ticketmaster.com/v").when(k % 5 == 2, F.lit(None)).otherwise("https://blog.example.com").alias("link"))


_RANGE_CASE = lambda i: "case " + " ".join(f"when {any_in('lower(venue_name)', w)} then {(a, b)[i]}" for w, a, b in R.NAME_RANGES) + f" else {(100, 250000)[i]} end"


@query("snippet_capacity", f"""with {_SNIPS}, hits as ({" union all ".join(f"select *, unnest(regexp_extract_all(title || ' ' || snippet, '{p}', 1)) raw from res" for p in R.SNIPPET_PATTERNS)}),
  sc as (select venue_key, venue_name, try_cast(replace(raw, ',', '') as double) n, case section when 'knowledge_graph' then 0.92 when 'answer_box' then 0.9 else
     case when {any_in("coalesce(link, '')", R.SNIPPET_TRUSTED)} then 0.88 when {any_in("coalesce(link, '')", R.SNIPPET_OFFICIAL)} then 0.85
       when contains(lower(snippet), 'capacity') and contains(lower(snippet), lower(split_part(venue_name, ' ', 1))) then 0.82 else 0.78 end end::double conf from hits),
  agg as (select venue_key, venue_name, n::bigint capacity, max(conf) confidence from sc where n between 50 and 250000 group by 1, 2, 3),
  f as (select *, capacity between {_RANGE_CASE(0)} and {_RANGE_CASE(1)} fits from agg), g as (select *, max(fits::int) over (partition by venue_key) anyfit from f),
  r as (select *, row_number() over (partition by venue_key order by confidence desc, capacity) as rank from g where fits::int = anyfit)
  select venue_key, capacity, confidence, rank from r where rank <= 3""")
def _(v):
    return capacity.snippet_capacity(_snips(v))


@query("round_capacity_flag", f"select concert_id, capacity in ({', '.join(map(str, R.ROUND_CAPACITIES))}) as suspicious from dv_concerts where capacity is not null")
def _(v):
    return v.concerts.where("capacity is not null").select("concert_id", capacity.is_round(F.col("capacity")).alias("suspicious"))


_ENRICH = f"""vb as (select venue_name, city, country, capacity, artist_id, count(*) n, max(tickets_sold) mx from dv_concerts where venue_name is not null group by all),
  fr as (select *, row_number() over (partition by lower(venue_name), lower(city), lower(country) order by n desc, city, venue_name, capacity nulls first, artist_id) rn from vb),
  j as (select f.*, coalesce(f.capacity, 5000) cur, coalesce(mx, 0) sold, w.avg_capacity ac, coalesce(w.verified, false) ver,
     coalesce({tier_sql('greatest(coalesce(spotify_listeners, 0), youtube_subscribers, instagram_followers, coalesce(facebook_followers, 0), twitter_followers)')}, 'mid') tier
    from fr f left join dv_venues w on lower(w.venue_name) = lower(f.venue_name) and lower(w.city) = lower(f.city) and lower(w.country) = lower(f.country) left join dv_artists a on a.artist_id = f.artist_id where rn = 1),
  k as (select *, ver and coalesce(ac, 0) <> 0 and not (sold > 0 and sold > coalesce(ac, 0)) settled, case when sold > 0 and cur > 0 and sold > cur then floor(sold * 1.1::double) when sold > 0 and cur = 0 then floor(sold * 1.15::double) end fl from j),
  nm as (select lower(venue_name) || '|' || lower(city) || '|' || lower(country) as venue_key, venue_name as name, city, country, {in_case('lower(venue_name)', R.VENUE_TYPES, "''")} as kind, tier,
     case when fl > 0 then fl when cur > 0 and cur not in ({', '.join(map(str, R.ROUND_CAPACITIES))}) then cur end::bigint as supplied, cur, ac, settled from k),
  todo as (select * from nm where not settled), {_known('todo')}, {_estimate('todo')},
  ev as (select venue_key, known as capacity, 0.98::double confidence, 'known_venues_db' source, 'curated_lookup' as method from todo join listed using (name, city)
    union all select venue_key, supplied, 0.95, 'supplied', 'explicit_input' from todo where supplied <> 0
    union all select i.venue_key, {_STORED}, case when verified then 0.96 else 0.84 end, 'venue_db', 'database_lookup' from todo i join dv_venues w on lower(w.venue_name) = lower(i.name) and lower(w.city) = lower(i.city) and lower(w.country) = lower(i.country) where coalesce({_STORED}, 0) <> 0),
  every as (select * from ev union all select venue_key, ecap, econf, 'heuristic', 'metadata_estimate' from est where venue_key not in (select venue_key from ev)),
  ranked as (select *, row_number() over (partition by venue_key order by confidence desc, capacity, source desc) rn from every),
  ch as (select i.venue_key, i.name, i.city, i.country, kind, tier, cur, capacity, confidence, source, method from todo i join ranked r on r.venue_key = i.venue_key and rn = 1), {_validate('ch')},
  enriched as (select name as venue_name, city, country, cur as old_capacity, capacity as new_capacity, confidence, status, source, case when capacity <> cur and confidence >= 0.6 then 'update' else 'keep' end as action from valid
    union all select name, city, country, cur, ac, 0.96, 'already_verified', 'venue_db', 'skip' from nm where settled)"""


@query("enrich_venues", f"with {_ENRICH} select * from enriched")
def _(v):
    return capacity.enrich_venues(v.concerts, v.venues, v.artists).select("venue_name", "city", "country", "old_capacity", "new_capacity", "confidence", "status", "source", "action")


@query("enrichment_report", f"with {_ENRICH} select status, action, count(*) as rows from enriched group by 1, 2")
def _(v):
    from backline.operators.reports import count_by

    return count_by(capacity.enrich_venues(v.concerts, v.venues, v.artists), "status", "action")


@query("backfill_capacity", f"""with {_ENRICH} select concert_id, case when action = 'update' and (c.capacity is null or c.capacity = old_capacity) then new_capacity else c.capacity end as capacity
  from dv_concerts c left join enriched e on e.venue_name = c.venue_name and e.city = c.city and e.country = c.country""")
def _(v):
    return capacity.backfill_capacity(v.concerts, capacity.enrich_venues(v.concerts, v.venues, v.artists)).select("concert_id", "capacity")


@query("fill_capacity", f"""with nm as (select concert_id as venue_key, venue_name as name, city, country, '' as kind, null::varchar as tier, capacity from dv_concerts), {_known('(select * from nm where name is not null)')}, {_estimate('nm')}
  select venue_key as concert_id, case when coalesce(known, capacity, 0) = 0 and name is not null then ecap else coalesce(known, capacity) end as capacity from est left join listed using (name, city)""")
def _(v):
    return capacity.fill_capacity(v.concerts).select("concert_id", "capacity")
