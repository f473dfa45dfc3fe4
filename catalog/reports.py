"""Searches, joins and report aggregates."""

from __future__ import annotations

from pyspark.sql import functions as F

from backline.functions.refdata import DEFAULT_CITIES, LIST_RATES_TO_INR
from backline.operators import joins, reports, search
from catalog.base import DAY, DAY_LONG, even, money, query, up

_C = "concert_id, artist_id, concert_date::varchar as concert_date, city, country, tickets_sold, total_revenue"
_CC = ["concert_id", "artist_id", "concert_date", "city", "country", "tickets_sold", "total_revenue"]


@query("table_scan_active", "select artist_id, artist_name, spotify_listeners, youtube_subscribers, instagram_followers, facebook_followers, twitter_followers from dv_artists where active")
def _(v):
    return v.artists.where("active").select(
        "artist_id", "artist_name", "spotify_listeners", "youtube_subscribers", "instagram_followers", "facebook_followers", "twitter_followers")


@query("table_scan_training", f"select {_C} from dv_concerts where total_revenue > 0 and capacity > 0")
def _(v):
    return v.concerts.where("total_revenue > 0 and capacity > 0").select(*_CC)


@query("table_scan_auditable", f"select {_C} from dv_concerts where capacity > 0 or tickets_sold > 0 or total_revenue > 0")
def _(v):
    return v.concerts.where("capacity > 0 or tickets_sold > 0 or total_revenue > 0").select(*_CC)


@query("list_concerts", f"""select {_C} from dv_concerts where lower(city) like '%mum%' and lower(country) like '%india%'
  and concert_date between date '1996-01-01' and date '2000-12-31'""")
def _(v):
    return search.list_concerts(v.concerts, city="Mum", country="INDIA", start="1996-01-01", end="2000-12-31").select(*_CC)


@query("list_artists", """select artist_id, artist_name, nationality from dv_artists where active
  and (lower(artist_name) like '%9%' or lower(nationality) like '%9%')
  and artist_id in (select artist_id from dv_artist_genres where lower(genre) = 'festival')""")
def _(v):
    return search.list_artists(v.artists, v.artist_genres, "9", "festival").select("artist_id", "artist_name", "nationality")


_NAMED = """select c.*, a.artist_name, a.artist_name || ' live' as event_name from dv_concerts c join dv_artists a using (artist_id)"""


def _named(v):
    names = v.artists.select("artist_id", "artist_name")
    return joins.with_artist(v.concerts, names).withColumn("event_name", F.concat("artist_name", F.lit(" live")))


@query("search_concerts", f"""with n as ({_NAMED}) select concert_id, artist_name, city, concert_date::varchar as concert_date from n
  where (lower(artist_name) like '%club%' or lower(city) like '%club%' or lower(event_name) like '%club%' or lower(venue_name) like '%club%'
   or lower(state) like '%club%' or lower(country) like '%club%') and lower(city) like '%dubai%' and year(concert_date) = 1998""")
def _(v):
    return search.search_concerts(_named(v), "Club ", "dubai", 1998, "sell-through-desc").select("concert_id", "artist_name", "city", "concert_date")


@query("artist_metrics", "select artist_id, platform, date::varchar as date, followers, streams from dv_metrics where platform = 'spotify' and date between date '2024-01-05' and date '2024-01-20'")
def _(v):
    return search.artist_metrics(v.metrics, platform="SPOTIFY", start="2024-01-05", end="2024-01-20").select("artist_id", "platform", "date", "followers", "streams")


@query("artist_type", "select artist_id, case when lower(nationality) like '%india%' then 'indian' else 'international' end as artist_type from dv_artists")
def _(v):
    return search.artist_type(v.artists).select("artist_id", "artist_type")


@query("concert_label", f"""with n as ({_NAMED}) select concert_id, case when venue_name is not null and venue_name <> ''
  then artist_name || ' at ' || venue_name else artist_name || ' in ' || city end as label from n""")
def _(v):
    return search.concert_label(_named(v)).select("concert_id", "label")


@query("sell_through_band", """with s as (select concert_id, capacity, case when capacity > 0 then coalesce(tickets_sold, 0)::double / capacity * 100.0::double else 0 end p from dv_concerts)
 select concert_id, case when coalesce(capacity, 0) = 0 then 'Capacity TBA' when p >= 95 then 'Sold out' when p >= 80 then 'Strong' else 'Building' end as list_band,
  case when p >= 95 then 'high' when p >= 75 then 'medium' else 'low' end as detail_band from s""")
def _(v):
    return search.sell_through_band(v.concerts).select("concert_id", "list_band", "detail_band")


@query("concerts_with_artist", """select c.concert_id, a.artist_id, a.artist_name, a.nationality, a.popularity, c.city, c.total_revenue
  from dv_concerts c join dv_artists a using (artist_id)""")
def _(v):
    return joins.with_artist(v.concerts, v.artists).select("concert_id", "artist_id", "artist_name", "nationality", "popularity", "city", "total_revenue")


_LATEST = """(select * exclude (rn) from (select *, row_number() over (partition by concert_id order by created_at desc, prediction_id desc,
   model_version desc, expected_attendance desc, predicted_capacity desc, predicted_price desc, expected_revenue desc, demand_score desc, confidence desc) rn
   from dv_predictions) where rn = 1)"""


@query("latest_prediction_join", f"""select c.concert_id, p.prediction_id as latest_prediction_id, p.created_at::varchar as latest_created_at,
  p.expected_attendance as latest_expected_attendance, p.expected_revenue as latest_expected_revenue
  from dv_concerts c left join {_LATEST} p using (concert_id)""")
def _(v):
    return joins.with_latest_prediction(v.concerts, v.predictions).select(
        "concert_id", "latest_prediction_id", "latest_created_at", "latest_expected_attendance", "latest_expected_revenue")


_RESOLVED = f"""
 a as (select c.*, coalesce(c.tickets_sold, 0)::double t0, coalesce(c.avg_ticket_price, 0)::double p0, coalesce(c.total_revenue, 0)::double r0,
    coalesce(p.expected_attendance, 0)::double pa, coalesce(p.predicted_price, 0)::double pp, coalesce(p.expected_revenue, 0)::double pr,
    coalesce(nullif(c.capacity, 0), p.predicted_capacity, 0)::double c1, coalesce(nullif(c.demand_score, 0), p.demand_score, 0)::double d1
   from dv_concerts c left join {_LATEST} p using (concert_id)),
 b as (select *, case when t0 <= 0 and pa > 0 then floor(pa + 0.5) else t0 end t1, case when p0 <= 0 and pp > 0 then pp else p0 end p1 from a),
 d as (select *, case when r0 > 0 then r0 when t1 > 0 and p1 > 0 then t1 * p1 when pr > 0 then pr else r0 end r1 from b),
 e as (select *, case when t1 <= 0 and r1 > 0 and p1 > 0 then floor(r1 / p1 + 0.5) else t1 end t2 from d),
 f as (select *, case when p1 <= 0 and r1 > 0 and t2 > 0 then r1 / t2 else p1 end p2 from e),
 resolved as (select concert_id, artist_id, concert_date, city, country, currency, venue_name,
   case when c1 > 0 then floor(c1 + 0.5)::bigint else capacity end as capacity,
   case when t2 > 0 then floor(t2 + 0.5)::bigint else 0 end as tickets_sold,
   case when p2 > 0 then {up('p2', 2)} else avg_ticket_price end as avg_ticket_price,
   case when r1 > 0 then {up('r1', 2)} else 0 end as total_revenue,
   case when d1 > 0 then {up('d1', 2)} else demand_score end as demand_score from f)"""


@query("concert_metric_cascade", f"with {_RESOLVED} select concert_id, capacity, tickets_sold, avg_ticket_price, total_revenue, demand_score from resolved")
def _(v):
    return joins.resolve_concert_metrics(v.concerts, v.predictions).select(
        "concert_id", "capacity", "tickets_sold", "avg_ticket_price", "total_revenue", "demand_score")


@query("artists_with_genres", """select a.artist_id, a.artist_name, coalesce(string_agg(distinct g.genre, '|' order by g.genre), '') as genres
  from dv_artists a left join dv_artist_genres g using (artist_id) group by 1, 2""")
def _(v):
    return joins.artists_with_genres(v.artists, v.artist_genres).select("artist_id", "artist_name", F.array_join("genres", "|").alias("genres"))


@query("venue_lookup", """select c.concert_id, w.venue_id as stored_venue_id, coalesce(case when avg_capacity > 0 then avg_capacity end,
   case when capacity_max > 0 then capacity_max end, case when capacity_min > 0 then capacity_min end) as stored_capacity, w.verified as stored_verified
  from dv_concerts c left join dv_venues w on lower(c.venue_name) = lower(w.venue_name) and lower(c.city) = lower(w.city) and lower(c.country) = lower(w.country)""")
def _(v):
    return joins.lookup_venue(v.concerts, v.venues).select("concert_id", "stored_venue_id", "stored_capacity", "stored_verified")


@query("kpis", f"""with latest as (select concert_id, expected_revenue pr from {_LATEST}),
 y as (select coalesce(tickets_sold, 0)::double t, coalesce(avg_ticket_price, 0) p, coalesce(total_revenue, 0) r, coalesce(pr, 0) pr, tickets_sold
   from dv_concerts left join latest using (concert_id) where concert_date >= date '2001-01-01'),
 m as (select * from dv_metrics_long where date >= date '{DAY_LONG}' - 30),
 best as (select artist_id, max(streams) s from m where platform = 'youtube' group by 1 order by s desc, artist_id limit 1)
 select (select count(*) from dv_artists where active) as total_artists, (select count(*) from dv_concerts) as total_concerts,
  (select coalesce(sum(tickets_sold), 0)::bigint from y) as tickets_ytd,
  (select {money(up('case when r > 0 then r when t > 0 and p > 0 then t * p when pr > 0 then pr else 0 end', 2))} from y) as revenue_ytd,
  (select {even(money('rog_daily') + ' / count(rog_daily)', 2)} from m) as avg_daily_growth,
  (select artist_name from best join dv_artists using (artist_id)) as top_artist,
  (select s from best join dv_artists using (artist_id)) as top_streams""")
def _(v):
    return reports.kpis(v.artists, v.concerts, v.metrics_long, v.predictions, DAY_LONG)


@query("top_artists", f"""with l as (select artist_id, platform, arg_max(followers, date) f from dv_metrics where date >= date '{DAY}' - 90 group by 1, 2)
 select artist_id, artist_name, sum(f)::bigint as total_followers, string_agg(platform || ':' || f, ',' order by platform) as platforms
 from l left join dv_artists using (artist_id) group by 1, 2 order by 3 desc, 1 limit 25""")
def _(v):
    out = reports.top_artists(v.metrics, v.artists, DAY, 25)
    return out.withColumn("platforms", F.array_join(F.transform("platforms", lambda p: F.concat_ws(":", p.platform, p.followers.cast("string"))), ","))


@query("top_artists_from_snapshots", """with l as (select artist_id, artist_name, unnest([spotify_listeners, youtube_subscribers, instagram_followers, facebook_followers, twitter_followers]) f
   from dv_artists where active)
 select artist_id, artist_name, sum(f)::bigint as total_followers from l where f > 0 group by 1, 2 order by 3 desc, 1 limit 10""")
def _(v):
    return reports.top_artists(v.metrics.where("date > date '2030-01-01'"), v.artists, "2030-06-01", 10).select("artist_id", "artist_name", "total_followers")


_TREND = """select platform, date_trunc('month', date)::date as month, sum(case when platform in ('spotify', 'apple_music') then streams else followers end)::bigint as value
  from dv_metrics_long where date >= date '2001-08-01' - interval 36 month and date <= date '2001-08-01' group by 1, 2"""


@query("monthly_trend", f"select platform, month::varchar as month, value, strftime(month, '%b %Y') as label from ({_TREND})")
def _(v):
    return reports.monthly_trend(v.metrics_long, 36, DAY_LONG)


for _dim in ("AGE_GROUP", "GENDER"):

    @query(f"demographics_{_dim.lower()}", f"""select dimension_value, coalesce(sum(absolute_count), 0)::bigint as total,
      {up(money('percentage') + ' / count(percentage)', 2)} as avg_percentage from dv_demographics where dimension = '{_dim}' group by 1""")
    def _(v, dim=_dim):
        return reports.demographics(v.demographics, dim)


@query("geo_breakdown", f"""select *, row_number() over (order by total desc, dimension_value) as rank from (select dimension_value, coalesce(sum(absolute_count), 0)::bigint as total,
      {up(money('percentage') + ' / count(percentage)', 2)} as avg_percentage from dv_demographics where dimension = 'GEOGRAPHY' group by 1 order by 2 desc, 1 limit 100)""")
def _(v):
    return reports.geo_breakdown(v.demographics)


def _place(keys: str, where: str) -> str:
    return f"""select *, {up('coalesce(revenue / nullif(tickets, 0), 0)', 2)} as revenue_per_ticket from (
      select {keys}, coalesce(sum(tickets_sold), 0)::bigint as tickets, coalesce({money('total_revenue')}, 0) as revenue,
       coalesce(sum(capacity), 0)::bigint as capacity, count(*) as concerts from dv_concerts where {where} group by all)
      order by revenue desc, {keys} limit 50"""


@query("city_stats", _place("city, state, country", "true"))
def _(v):
    return reports.city_stats(v.concerts)


@query("city_stats_country", _place("city, state, country", "lower(country) like '%united%'"))
def _(v):
    return reports.city_stats(v.concerts, "United")


@query("venue_stats", _place("venue_name, city, country", "venue_name is not null"))
def _(v):
    return reports.venue_stats(v.concerts)


@query("venue_capacity_rollup", f"""select venue_name, city, country, min(capacity) as capacity_min, max(capacity) as capacity_max, {even('avg(capacity)')}::bigint as avg_capacity,
  count(*) >= 3 as verified, count(*) as concerts from dv_concerts where venue_name is not null and capacity > 0 group by 1, 2, 3""")
def _(v):
    return reports.venue_capacity_rollup(v.concerts)


@query("genre_popularity", """with p as (select artist_id, max(followers) peak from dv_metrics group by 1)
  select genre, count(*) as artists, coalesce(sum(peak), 0)::bigint as followers from (select distinct * from dv_artist_genres) left join p using (artist_id) group by 1""")
def _(v):
    return reports.genre_popularity(v.artist_genres, v.metrics)


_RATE = "case coalesce(currency, 'INR') " + " ".join(f"when '{k}' then {x}" for k, x in LIST_RATES_TO_INR.items()) + " else 84.0 end::double"


@query("concert_totals", f"""with x as (select coalesce(nullif(city, ''), 'Unknown') city, sum((coalesce(total_revenue, 0) * {_RATE})::decimal(24,4)) r,
   sum(coalesce(tickets_sold, 0)) t, sum(coalesce(capacity, 0)) c, count(*) n from dv_concerts group by 1)
 select sum(t)::bigint as total_tickets, {up('sum(r)', 2)} as total_revenue_inr, {up('sum(r)::double / sum(t)', 4)} as avg_ticket_price,
  {up('sum(t)::double / sum(c)::double * 100::double', 4)} as avg_sell_through, (select city from x order by r desc, city desc limit 1) as top_city,
  (select n from x order by r desc, city desc limit 1) as top_city_concerts from x""")
def _(v):
    return reports.concert_totals(v.concerts)


@query("revenue_by_city", f"""select city, coalesce({money('total_revenue')}, 0) as revenue from dv_concerts join dv_artists using (artist_id)
  where lower(nationality) like '%india%' group by 1""")
def _(v):
    return reports.revenue_by_city(v.concerts, v.artists, "indian")


@query("concerts_per_artist", "select artist_id, artist_name, count(concert_id) as concerts from dv_artists left join dv_concerts using (artist_id) group by 1, 2")
def _(v):
    return reports.concerts_per_artist(v.artists, v.concerts)


def _profile(where: str = "true") -> str:
    return f"""l as (select artist_id, platform, arg_max(followers, date) f, arg_max(coalesce(rog_daily, 0), date) g from dv_metrics group by 1, 2),
 s as (select artist_id, sum(f)::bigint total_followers, {up(money('g') + ' / count(*)', 4)} avg_growth, max(f) top_platform_followers from l group by 1),
 tp as (select artist_id, platform top_platform from (select *, row_number() over (partition by artist_id order by f desc, platform desc) rn from l) where rn = 1),
 c as (select artist_id, {money('total_revenue')} r, sum(tickets_sold)::bigint t, count(*) n from dv_concerts where {where} group by 1),
 prof as (select a.artist_id, a.artist_name, coalesce(total_followers, 0) as total_followers, coalesce(avg_growth, 0) as avg_growth, coalesce(top_platform, 'Unknown') as top_platform,
  coalesce(top_platform_followers, 0) as top_platform_followers, coalesce(r, 0) as total_revenue, coalesce(t, 0) as total_tickets, coalesce(n, 0) as concerts
  from dv_artists a left join s using (artist_id) left join tp using (artist_id) left join c using (artist_id))"""


@query("artist_profile", f"with {_profile()} select * from prof")
def _(v):
    return reports.artist_profile(v.artists, v.metrics, v.concerts)


def _compare(where: str) -> str:
    names = ["total_followers", "avg_growth", "total_revenue", "total_tickets", "concerts", "top_platform_followers"]
    arms = " union all ".join(f"select '{n}' as measure, a.{n}::double as value_a, b.{n}::double as value_b from a, b" for n in names)
    return f"""with {_profile(where)}, a as (select * from prof where artist_id = 7), b as (select * from prof where artist_id = 8)
      select *, case when value_a > value_b then 'a' else 'b' end as winner from ({arms})"""


@query("compare_artists", _compare("true"))
def _(v):
    return reports.compare_artists(v.artists, v.metrics, v.concerts, 7, 8)


@query("compare_artists_city", _compare("city = 'Mumbai'"))
def _(v):
    return reports.compare_artists(v.artists, v.metrics, v.concerts, 7, 8, "Mumbai")


@query("profile_demographics", """select artist_id, dimension, coalesce(dimension_value, 'Unknown') as dimension_value, coalesce(sum(absolute_count), 0)::bigint as total
  from dv_demographics group by 1, 2, 3""")
def _(v):
    return reports.profile_demographics(v.demographics)


@query("venue_batch", """select venue_name, city, country, capacity, artist_id, count(*) as concerts, avg(tickets_sold) as avg_tickets, max(tickets_sold) as max_tickets
  from dv_concerts where venue_name is not null group by 1, 2, 3, 4, 5""")
def _(v):
    return reports.venue_batch(v.concerts)


_MEAN_P = money("case when avg_ticket_price > 0 then avg_ticket_price end") + " / nullif(count(case when avg_ticket_price > 0 then 1 end), 0)"


@query("avg_price_by_artist", f"select artist_id, {up(f'coalesce({_MEAN_P}, 1500)', 4)} as mean_price from dv_concerts group by 1")
def _(v):
    return reports.avg_price_by(v.concerts, ["artist_id"], 1500.0)


@query("avg_price_by_city", f"select city, country, {up(_MEAN_P, 4)} as mean_price from dv_concerts group by 1, 2")
def _(v):
    return reports.avg_price_by(v.concerts, ["city", "country"])


@query("source_confirmations", "select concert_id, count(*) as sources from dv_predictions group by 1")
def _(v):
    return reports.confirmations(v.predictions, "concert_id")


@query("page_of_concerts", """select concert_id, concert_date::varchar as concert_date, (select count(*) from dv_concerts) as total, ceil((select count(*) from dv_concerts) / 20.0)::bigint as total_pages
  from dv_concerts order by dv_concerts.concert_date desc, concert_id limit 20 offset 40""")
def _(v):
    return search.page(v.concerts.select("concert_id", "concert_date"), [F.col("concert_date").desc(), "concert_id"], 3, 20)


@query("keyset_page", """select concert_id, concert_date::varchar as concert_date from dv_concerts where dv_concerts.concert_date < date '2000-06-01' or (dv_concerts.concert_date = date '2000-06-01' and concert_id > 500)
  order by dv_concerts.concert_date desc, concert_id limit 20""")
def _(v):
    return search.next_page(v.concerts.select("concert_id", "concert_date"), "concert_date", "concert_id", "2000-06-01", 500, 20)


@query("top_k_revenue", "select concert_id, total_revenue from dv_concerts order by total_revenue desc nulls last, concert_id limit 50")
def _(v):
    return search.top_k(v.concerts, "total_revenue", 50, "concert_id").select("concert_id", "total_revenue")


@query("adjusted_popularity", f"""select artist_id, least({up('coalesce(popularity, 0) * 1.06::double')}, 100) as adjusted_popularity from dv_artists order by 2 desc, 1 limit 10""")
def _(v):
    return search.adjusted_popularity(v.artists, 24).select("artist_id", "adjusted_popularity")


@query("city_options", "select distinct city as option from dv_concerts where city <> '' union select unnest(" + str(DEFAULT_CITIES) + ")")
def _(v):
    return search.options(v.concerts, "city", DEFAULT_CITIES)


@query("year_options", "select distinct year(concert_date)::int as option from dv_concerts")
def _(v):
    return search.options(v.concerts.withColumn("year", F.year("concert_date")), "year", descending=True)


@query("first_by_key", """select concert_id, artist_id, city, concert_date::varchar as concert_date from
  (select *, row_number() over (partition by artist_id, lower(city), dv_concerts.concert_date order by concert_id) rn from dv_concerts) where rn = 1""")
def _(v):
    return search.first_by_key(v.concerts, ["artist_id", F.lower("city"), "concert_date"], ["concert_id"]).select("concert_id", "artist_id", "city", "concert_date")


@query("first_listing_by_key", """select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity from
  (select *, row_number() over (partition by l_orderkey, l_linenumber order by l_shipdate, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax) rn from lineitem) where rn = 1""")
def _(v):
    return search.first_by_key(
        v.lineitem, ["l_orderkey", "l_linenumber"],
        ["l_shipdate", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax"],
    ).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")


_SOURCES = ["setlistfm", "songkick", "bookmyshow", "district", "manual"]


@query("union_sources", " union all ".join(f"""select concert_id, {"city" if k != 1 else "null::varchar"} as city, {"venue_name" if k % 2 else "null::varchar"} as venue_name, '{s}' as src
  from dv_concerts where source = '{s}'""" for k, s in enumerate(_SOURCES)))
def _(v):
    # the sources differ in their columns
    part = lambda k, s: v.concerts.where(F.col("source") == s).select("concert_id", *["city"] * (k != 1), *["venue_name"] * (k % 2), F.lit(s).alias("src"))
    first, *rest = [part(k, s) for k, s in enumerate(_SOURCES)]
    return search.union_sources(first, *rest).select("concert_id", "city", "venue_name", "src")
