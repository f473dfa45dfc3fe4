"""Time series, demand and popularity."""

from __future__ import annotations

from pyspark.sql import functions as F

from backline.functions.refdata import GROWTH_WEIGHTS, MONTH_WEIGHTS, PLATFORMS
from backline.operators import demand, popularity, series
from catalog.base import DAY, DAY_LONG, clamp_sql, even, query, up


def _ser(view: str) -> str:
    return f"""ser as (select artist_id, platform, date, (case when platform in ('spotify', 'apple_music') then streams
      when platform = 'youtube' then views else followers end)::double x from {view})"""


def _growth(view: str) -> str:
    rates = ", ".join(
        f"""case when points >= 2 and p{w} > 0 then {even(f'(current_value - p{w}) / p{w} * 100::double', 4)} else 0 end as rog_{w}d""" for w in (7, 30, 90))
    past = ", ".join(f"arg_max(x, date) filter (where date <= last_date - {w}) as p{w}" for w in (7, 30, 90))
    return f"""{_ser(view)}, dated as (select *, max(date) over (partition by artist_id, platform) last_date from ser),
     g0 as (select artist_id, platform, count(*) points, arg_max(x, date) current_value, {past} from dated group by 1, 2),
     growth as (select artist_id, platform, points, current_value, {rates} from g0)"""


@query("canon_platform", """select distinct o_orderpriority as raw, translate(lower(trim(' ' || o_orderpriority || ' ')), '- ', '__') as platform from orders""")
def _(v):
    return v.orders.select("o_orderpriority").distinct().select(
        F.col("o_orderpriority").alias("raw"), series.canon_platform(F.concat(F.lit(" "), "o_orderpriority", F.lit(" "))).alias("platform"))


@query("normalize_metrics", """select artist_id, platform, date::varchar as date, followers::double as followers, streams::double as streams,
  case when platform = 'youtube' then streams else 0 end::double as views, likes::double as likes from dv_metrics""")
def _(v):
    raw = v.metrics.withColumn("platform", F.upper("platform")).withColumn("views", F.lit("n/a")).withColumn("followers", F.col("followers").cast("string"))
    return series.normalize_metrics(raw).select("artist_id", "platform", "date", "followers", "streams", "views", "likes")


for _view, _name in (("dv_metrics", ""), ("dv_metrics_long", "_long")):

    @query(f"primary_metric{_name}", f"with {_ser(_view)} select artist_id, platform, date::varchar as date, x from ser")
    def _(v, n=_view[3:]):
        return series.primary_metric(getattr(v, n))

    @query(f"growth_windows{_name}", f"with {_growth(_view)} select * from growth")
    def _(v, n=_view[3:]):
        return series.growth_windows(series.primary_metric(getattr(v, n)))

    @query(f"daily_growth{_name}", f"""with l as (select *, lag(followers) over w as pf, lag(date) over w as pd from {_view} window w as (partition by artist_id, platform order by date))
      select artist_id, platform, date::varchar as date, case when date - pd between 1 and 7 and pf > 0 then {up('(followers - pf)::double / pf * 100::double', 4)} end as rog_daily from l""")
    def _(v, n=_view[3:]):
        return series.recalc_daily_growth(getattr(v, n)).select("artist_id", "platform", "date", "rog_daily")

    @query(f"social_velocity{_name}", f"""with {_ser(_view)}, l as (select *, max(date) over (partition by artist_id) last from ser),
      p as (select artist_id, platform, count(*) n, arg_max(x, date) - arg_min(x, date) gain from l where date >= last - 14 group by 1, 2),
      a as (select artist_id, coalesce(sum(gain) filter (where n >= 2), 0) gain from p group by 1)
      select artist_id, round(case when gain > 0 then least(1::double, ln(1 + greatest(gain, 0)) / ln(1000001::double)) else 0 end, 6) as social_velocity from a""")
    def _(v, n=_view[3:]):
        return series.social_velocity(series.primary_metric(getattr(v, n))).withColumn("social_velocity", F.round("social_velocity", 6))

    @query(f"trend_class{_name}", f"""with {_growth(_view)} select artist_id, platform, case when rog_30d > 5 or rog_90d > 10 then 'rising'
      when rog_30d < -5 or rog_90d < -10 then 'declining' else 'stable' end as trend from growth""")
    def _(v, n=_view[3:]):
        g = series.growth_windows(series.primary_metric(getattr(v, n)))
        return g.select("artist_id", "platform", series.trend_class(F.col("rog_30d"), F.col("rog_90d")).alias("trend"))


_W = "case platform " + " ".join(f"when '{k}' then {x}" for k, x in GROWTH_WEIGHTS.items()) + " else 0.05 end::double"


@query("cross_platform_score", f"""with {_growth('dv_metrics_long')} select artist_id, {even(f"coalesce(sum({_W} * (50 + 50 * tanh(rog_30d / 20))) filter (where points >= 3) / sum({_W}) filter (where points >= 3), 50)", 2)} as cross_platform_score
  from growth group by 1""")
def _(v):
    return series.cross_platform_score(series.growth_windows(series.primary_metric(v.metrics_long)))


@query("best_growth", f"with {_growth('dv_metrics_long')} select artist_id, greatest(0, max(rog_30d)) as best_rog_30d from growth group by 1")
def _(v):
    return series.best_growth(series.growth_windows(series.primary_metric(v.metrics_long)))


for _p in ("daily", "weekly", "monthly"):

    @query(f"growth_listing_{_p}", f"select artist_id, platform, date::varchar as date, rog_{_p} as rog from dv_metrics where rog_{_p} is not null")
    def _(v, p=_p):
        return series.growth_listing(v.metrics, p)


# the recursive form of the smoothing: one row at a time, level s and twice-smoothed u
_EMA = """num as (select *, row_number() over (partition by artist_id, platform order by date) rn from ser),
  ema as (select artist_id, platform, date, rn, x, x as s, x as u from num where rn = 1
    union all select n.artist_id, n.platform, n.date, n.rn, n.x, 0.3::double * n.x + 0.7::double * e.s,
      0.3::double * (0.3::double * n.x + 0.7::double * e.s) + 0.7::double * e.u
    from ema e join num n on n.artist_id = e.artist_id and n.platform = e.platform and n.rn = e.rn + 1)"""


@query("smooth_series", f"with recursive {_ser('dv_metrics_long')}, {_EMA} select artist_id, platform, date::varchar as date, x, s::float::double as s from ema")
def _(v):
    out = series.smooth(series.primary_metric(v.metrics_long))
    # decimal rounding would meet exact halves; single precision does not
    return out.withColumn("s", F.col("s").cast("float").cast("double"))


_LASTS = "lasts as (select artist_id, platform, max(rn) n, arg_max(u, rn) u, arg_max(u, rn) filter (where rn <= m - 2) u2 from (select *, max(rn) over (partition by artist_id, platform) m from ema) group by 1, 2)"


@query("forecast_linear", f"with recursive {_ser('dv_metrics_long')}, {_EMA}, {_LASTS} select artist_id, platform, " + ", ".join(
    even(f"case when n < 3 then u else greatest(0, u + (u - u2) / 2 * {h}) end", 2) + f" as forecast_{h}d" for h in (30, 90, 180)) + " from lasts")
def _(v):
    return series.forecast(series.primary_metric(v.metrics_long))


@query("anomalies", f"""with recursive {_ser('dv_metrics_long')}, {_EMA}, r as (select artist_id, platform, count(*) points, stddev_samp(x - s) sd, arg_max(x - s, rn) last from ema group by 1, 2)
  select artist_id, platform, points, {up('last', 4)} as last_residual, points >= 7 and coalesce(sd, 0) > 0 and abs(last) / nullif(sd, 0) > 1.2::double as anomaly from r""")
def _(v):
    return series.anomalies(series.primary_metric(v.metrics_long), sigma=1.2)


@query("forecast_holt")
def _(v):
    return series.forecast_holt(series.primary_metric(v.metrics_long))


@query("breakpoints")
def _(v):
    return series.breakpoints(series.primary_metric(v.metrics_long))


@query("growth_report")
def _(v):
    return series.growth_report(v.metrics_long)


@query("latest_metrics", "select artist_id, platform, max(date)::varchar as date, arg_max(followers, date) as followers, arg_max(streams, date) as streams from dv_metrics group by 1, 2")
def _(v):
    return series.latest_metrics(v.metrics).select("artist_id", "platform", "date", "followers", "streams")


_RN = "(select *, row_number() over (partition by artist_id order by date desc, platform) rn from dv_metrics)"


@query("last_n_metrics", f"select artist_id, platform, date::varchar as date, followers, rn from {_RN} where rn <= 5")
def _(v):
    return series.last_n(v.metrics, 5).select("artist_id", "platform", "date", "followers", "rn")


_MOM = f"""mom as (select artist_id, case when count(val) = 0 then 50 else {clamp_sql('50 + avg(val) * 9', 0, 100)} end as artist_momentum from (
   select artist_id, nullif(unnest([coalesce(rog_daily, 0), coalesce(rog_weekly, 0) / 7, coalesce(rog_monthly, 0) / 30]), 0) val from {_RN} where rn <= 30) group by 1)"""


@query("artist_momentum", f"with {_MOM} select artist_id, round(artist_momentum, 5) as artist_momentum from mom")
def _(v):
    return series.artist_momentum(v.metrics).withColumn("artist_momentum", F.round("artist_momentum", 5))


_ENG = f"""eng as (select artist_id, case when count(*) < 2 then 50 when arg_max(e, rn) <= 0 then 55 else {clamp_sql('50 + (arg_min(e, rn) - arg_max(e, rn)) / arg_max(e, rn) * 45', 0, 100)} end as engagement_velocity
  from (select *, likes + comments * 2 + shares * 3 + streams * 0.1::double e from {_RN} where rn <= 14) group by 1)"""


@query("engagement_velocity", f"with {_ENG} select artist_id, round(engagement_velocity, 5) as engagement_velocity from eng")
def _(v):
    return series.engagement_velocity(v.metrics).withColumn("engagement_velocity", F.round("engagement_velocity", 5))


_VAL = "case when platform in ('spotify', 'apple_music') then streams else followers end"


@query("trend_matrix", "select date_trunc('month', date)::date::varchar as month, " + ", ".join(
    f"coalesce(sum({_VAL}) filter (where platform = '{p}'), 0)::bigint as {p}" for p in PLATFORMS) + " from dv_metrics_long group by 1")
def _(v):
    return series.trend_matrix(v.metrics_long)


@query("profile_trend", "select artist_id, date_trunc('month', date)::date::varchar as month, " + ", ".join(
    f"coalesce(arg_min(followers, date) filter (where platform = '{p}'), 0) as {p}" for p in PLATFORMS) + " from dv_metrics_long group by 1, 2")
def _(v):
    return series.profile_trend(v.metrics_long)


_SNAP = "[('spotify', {0}), ('youtube', {1}), ('instagram', {2}), ('facebook', coalesce(facebook_followers, 0)), ('twitter', coalesce(twitter_followers, 0))]"


def _synth(mode: str) -> str:
    d = ("coalesce(spotify_listeners, 0)", "coalesce(youtube_subscribers, 0)", "coalesce(instagram_followers, 0)") if mode == "training" else (
        "coalesce(spotify_listeners, 50000)", "coalesce(youtube_subscribers, 20000)", "coalesce(instagram_followers, 30000)")
    cut = (lambda x: f"floor({x})::bigint") if mode == "training" else (lambda x: f"floor({x} + 0.5)::bigint")
    factor, offs = ("1 - (off::double / 90) * 0.08::double", "range(1, 91)") if mode == "training" else ("1 - off * 0.006::double", "range(0, 14)")
    streams = "platform in ('spotify', 'youtube')" if mode == "training" else "platform = 'spotify'"
    views = "platform = 'youtube'" if mode == "training" else "platform in ('spotify', 'youtube')"
    return f"""with s as (select artist_id, unnest({_SNAP.format(*d)}) t from dv_artists),
      l as (select artist_id, t[1] platform, t[2]::double seed from s where t[2] > 0
        union all select artist_id, 'spotify', 50000 from dv_artists where artist_id not in (select artist_id from s where t[2] > 0)),
      r as (select *, unnest({offs}) off from l), b as (select *, seed * ({factor}) base from r)
      select artist_id, platform, (date '{DAY}' - off::int)::varchar as date, {cut('base')} as followers, case when {streams} then {cut('base')} else 0 end as streams,
       case when {views} then {cut('base')} else 0 end as views, {cut('base * 0.01::double')} as likes, {cut('base * 0.001::double')} as comments, {cut('base * 0.0005::double')} as shares from b"""


for _m in ("training", "serving"):

    @query(f"synthetic_metrics_{_m}", _synth(_m))
    def _(v, m=_m):
        cols = ["artist_id", "spotify_listeners", "youtube_subscribers", "instagram_followers", "facebook_followers", "twitter_followers"]
        return series.synthesize_metrics(v.artists.select(*cols), DAY, m)


# --- demand -----------------------------------------------------------------------------

_ST = even("least(greatest(tickets_sold::double, 0) / capacity::double, 1)", 4)


def _st(cap: bool = True) -> str:
    rate = "greatest(tickets_sold::double, 0) / nullif(capacity, 0)::double"
    rate = f"least({rate}, 1::double)" if cap else rate
    return f"case when tickets_sold is null or capacity is null or capacity <= 0 then 0 else {even(rate, 4)} end"


@query("sell_through", f"select concert_id, {_st()} as sell_through, {_st(False)} as sell_through_uncapped, {even(f'({_st()}) * 100::double', 2)} as sell_through_pct from dv_concerts")
def _(v):
    return demand.with_sell_through(v.concerts).select("concert_id", "sell_through", "sell_through_uncapped", "sell_through_pct")


_TV = f"""tv as (select artist_id, {even(f'sum(({_st()})::decimal(12,4))::double / count(*)', 4)} as ticket_velocity from dv_concerts c
  where c.concert_date between date '{DAY_LONG}' - 90 and date '{DAY_LONG}' and tickets_sold is not null and capacity is not null group by 1)"""


@query("ticket_velocity", f"with {_TV} select * from tv")
def _(v):
    return demand.ticket_velocity(v.concerts, DAY_LONG)


def _season(c: str) -> str:
    base = "case month(" + c + ") " + " ".join(f"when {m} then {x}" for m, x in MONTH_WEIGHTS.items()) + " end::double"
    return f"least(1::double, {base} + case when isodow({c}) >= 5 then 0.1::double else 0::double end)"


@query("seasonality", f"select concert_id, {_season('c.concert_date')} as seasonality from dv_concerts c")
def _(v):
    return v.concerts.select("concert_id", demand.seasonality(F.col("concert_date")).alias("seasonality"))


_REC = f"""targets as (select distinct artist_id, city, country, date '{DAY_LONG}' + 30 as target_date from dv_concerts),
 rec as (select t.artist_id, t.city, t.country, t.target_date, (select date '{DAY_LONG}' - max(c.concert_date) from dv_concerts c
   where c.artist_id = t.artist_id and (lower(c.city) = lower(t.city) or lower(c.country) = lower(t.country))) as since from targets t),
 recency as (select *, case when since is null then 0.7 when since < 30 then 0.2 when since < 90 then 0.5 when since < 180 then 0.8 else 0.9 end::double as recency from rec)"""


@query("recency", f"with {_REC} select artist_id, city, country, recency from recency")
def _(v):
    return demand.recency(demand.demand_targets(v.concerts, DAY_LONG), v.concerts, DAY_LONG).select("artist_id", "city", "country", "recency")


@query("recency_new_places", f"""with t as (select artist_id, 'Mumbai' as city, 'India' as country from dv_artists), h as (select artist_id, max(c.concert_date) filter (where lower(city) = 'mumbai' or lower(country) = 'india') last from dv_concerts c group by 1)
  select artist_id, city, country, case when h.artist_id is null then 0.5 when last is null then 0.7 when date '{DAY_LONG}' - last < 30 then 0.2 when date '{DAY_LONG}' - last < 90 then 0.5
   when date '{DAY_LONG}' - last < 180 then 0.8 else 0.9 end::double as recency from t left join h using (artist_id)""")
def _(v):
    t = v.artists.select("artist_id", F.lit("Mumbai").alias("city"), F.lit("India").alias("country"))
    return demand.recency(t, v.concerts, DAY_LONG)


_SV = f"""{_ser('dv_metrics_long')}, l as (select *, max(date) over (partition by artist_id) last from ser),
      p as (select artist_id, platform, count(*) n, arg_max(x, date) - arg_min(x, date) gain from l where date >= last - 14 group by 1, 2),
      sv as (select artist_id, case when gain > 0 then least(1::double, ln(1 + greatest(gain, 0)) / ln(1000001::double)) else 0 end as sv from (
        select artist_id, coalesce(sum(gain) filter (where n >= 2), 0) gain from p group by 1))"""


@query("demand_scores", f"""with {_REC}, {_TV}, {_SV}, parts as (select artist_id, city, country, {even('coalesce(sv, 0)', 4)} as social_velocity, {even('coalesce(ticket_velocity, 0)', 4)} as ticket_velocity,
   {even(_season('target_date'), 4)} as seasonality, recency from recency left join sv using (artist_id) left join tv using (artist_id))
 select *, {even(clamp_sql('(social_velocity * 0.4::double + ticket_velocity * 0.3::double + seasonality * 0.2::double + recency * 0.1::double) * 100::double', 0, 100), 2)} as score from parts""")
def _(v):
    out = demand.demand_scores(demand.demand_targets(v.concerts, DAY_LONG), v.metrics_long, v.concerts, DAY_LONG)
    return out.select("artist_id", "city", "country", "social_velocity", "ticket_velocity", "seasonality", "recency", "score")


def tier_sql(x: str) -> str:
    return f"case when {x} < 10000 then 'micro' when {x} < 100000 then 'rising' when {x} < 500000 then 'mid' when {x} < 2000000 then 'major' else 'superstar' end"


@query("artist_tier", f"select artist_id, {tier_sql('max(followers)')} as artist_tier from dv_metrics_long group by 1")
def _(v):
    return demand.artist_tier(v.metrics_long)


@query("snapshot_tier", f"""select artist_id, {tier_sql('greatest(coalesce(spotify_listeners, 0), youtube_subscribers, instagram_followers, coalesce(facebook_followers, 0), twitter_followers)')} as artist_tier from dv_artists""")
def _(v):
    return demand.snapshot_tier(v.artists).select("artist_id", "artist_tier")


@query("tier_from_popularity", """select artist_id, case when popularity >= 80 then 'superstar' when popularity >= 60 then 'major' when popularity >= 40 then 'mid' when popularity >= 20 then 'rising' else 'micro' end as tier from dv_artists""")
def _(v):
    return v.artists.select("artist_id", demand.tier_from_popularity(F.col("popularity")).alias("tier"))


_RANGED = """ranged as (select concert_id, c.concert_date, capacity as venue_capacity, avg_ticket_price * 0.5::double as lo, avg_ticket_price * 2::double as hi from dv_concerts c where avg_ticket_price > 0 and capacity > 0)"""


@query("concert_features", f"""with {_RANGED}, f as (select *, hi - lo as price_range, lo + (hi - lo) * 0.235::double as p from ranged)
  select concert_id, {up('price_range', 4)} as price_range, {up('p', 4)} as avg_ticket_price, {up('venue_capacity * p', 2)} as max_revenue_naive, (isodow(concert_date) >= 5)::int as is_weekend,
   month(concert_date)::int as month, case when month(concert_date) in (12, 1, 2) then 'winter' when month(concert_date) < 6 then 'spring' when month(concert_date) < 9 then 'summer' else 'autumn' end as season from f""")
def _(v):
    c = v.concerts.where("avg_ticket_price > 0 and capacity > 0").select(
        "concert_id", "concert_date", F.col("capacity").alias("venue_capacity"),
        (F.col("avg_ticket_price") * 0.5).alias("ticket_price_min"), (F.col("avg_ticket_price") * 2.0).alias("ticket_price_max"))
    r = lambda c, d: (F.floor(F.col(c) * 10.0**d + 0.5) / 10.0**d).alias(c)
    return demand.concert_features(c).select("concert_id", r("price_range", 4), r("avg_ticket_price", 4), r("max_revenue_naive", 2), "is_weekend", "month", "season")


_MULT = "case lower(city) " + " ".join(f"when '{k}' then {x}" for k, x in demand.CITY_MULTIPLIERS.items()) + " else 0.7 end::double"
_MAJOR = "lower(city) in (" + ", ".join(f"'{m}'" for m in demand.MAJOR_MARKETS) + ")"


@query("city_popularity", f"""select concert_id, {up(clamp_sql(f'popularity * {_MULT}', 0, 100), 4)} as city_popularity from dv_concerts join dv_artists using (artist_id) where popularity is not null""")
def _(v):
    df = v.concerts.join(v.artists.select("artist_id", "popularity"), "artist_id").where("popularity is not null")
    p = demand.city_popularity(F.col("popularity"), F.col("city"))
    return df.select("concert_id", (F.floor(p * 10000.0 + 0.5) / 10000.0).alias("city_popularity"))


_SHARE = """tg as (select distinct artist_id, city, country from dv_concerts),
  share as (select t.artist_id, t.city, t.country, (select arg_max(percentage, row(metric_date, demo_id)) from dv_demographics d where d.artist_id = t.artist_id and dimension = 'GEOGRAPHY' and contains(lower(dimension_value), lower(t.city))) as s0,
    (select max(row(metric_date, demo_id)) from dv_demographics d where d.artist_id = t.artist_id and dimension = 'GEOGRAPHY' and contains(lower(dimension_value), lower(t.city))) as k from tg t),
  shares as (select s.artist_id, s.city, s.country, d.percentage as city_share from share s left join dv_demographics d on d.demo_id = s.k[2])"""


@query("city_share", f"with {_SHARE} select artist_id, city, country, city_share from shares")
def _(v):
    return demand.city_share(v.concerts.select("artist_id", "city", "country").distinct(), v.demographics)


@query("city_popularity_history", f"""with {_SHARE}, n as (select artist_id, count(*) total from dv_concerts group by 1), nc as (select artist_id, city, count(*) n_city from dv_concerts group by 1, 2),
   nk as (select artist_id, country, count(*) n_country from dv_concerts group by 1, 2)
  select artist_id, city, country, {up(clamp_sql(f"coalesce(popularity, 45) * 0.68::double + coalesce(city_share, 0) * 0.8::double + least(18::double, n_city::double / total * 45::double) + least(10::double, n_country::double / total * 20::double) + case when {_MAJOR} then 8 else 0 end", 5, 100), 2)} as city_popularity
  from shares join n using (artist_id) join nc using (artist_id, city) join nk using (artist_id, country) left join dv_artists using (artist_id)""".replace("left join dv_artists using (artist_id)", "left join (select artist_id, popularity from dv_artists) using (artist_id)"))
def _(v):
    t = v.concerts.select("artist_id", "city", "country").distinct()
    return demand.city_popularity_history(t, v.artists, v.concerts, v.demographics)


@query("reach_popularity", f"""with t as (select artist_id, coalesce(spotify_listeners, 0) + youtube_subscribers + instagram_followers + coalesce(facebook_followers, 0) + twitter_followers r from dv_artists)
  select artist_id, case when r <= 0 then 50 else greatest(5, least(95, {up('log10(r::double + 1) * 12')})) end as reach_popularity from t""")
def _(v):
    return demand.reach_popularity(v.artists).select("artist_id", "reach_popularity")


# --- popularity -------------------------------------------------------------------------


def _weights(names: list[str], floor: bool, src: str) -> str:
    """Long form with the textbook entropy sum, not the one-pass identity."""
    cols = {"spotify": "spotify_listeners", "youtube": "youtube_subscribers", "instagram": "instagram_followers", "facebook": "facebook_followers", "twitter": "twitter_followers"}
    arms = " union all ".join(f"select artist_id, '{n}' platform, ln(1 + coalesce({cols[n]}, 0)::double) z from {src}" for n in names)
    lift = """lifted as (select platform, case when platform = 'spotify' then greatest(w, 0.4::double) when short > 0 and rest > 0 then w - short * (w / rest) else w end w from (
       select *, max(case when platform = 'spotify' then greatest(0.4::double - w, 0) end) over () short, sum(case when platform <> 'spotify' then w end) over () rest from raw))""" if floor else "lifted as (select platform, w from raw)"
    return f"""long as ({arms}), tot as (select platform, sum(z) s, max(z) top, count(*) n from long group by 1),
      ent as (select platform, any_value(s) s, any_value(top) top, -sum(case when z > 0 then z / s * ln(z / s) else 0 end) / ln(any_value(n)) e from long join tot using (platform) group by 1),
      div as (select platform, top, case when s > 0 then greatest(0, 1 - e) else 0 end d from ent), raw as (select platform, d / sum(d) over () w from div),
      {lift}, weights as (select platform, w / sum(w) over () as w, top from lifted join div using (platform))"""


_FOUR = ["spotify", "youtube", "instagram", "facebook"]
_FIVE = [*_FOUR, "twitter"]


@query("entropy_weights", f"with {_weights(_FIVE, False, 'dv_artists')} select platform, round(w, 6) as weight from weights")
def _(v):
    return popularity.entropy_weights(v.artists, popularity.FIVE).withColumn("weight", F.round("weight", 6))


@query("entropy_weights_floor", f"with {_weights(_FOUR, True, '(select * from dv_artists where active)')} select platform, round(w, 6) as weight from weights")
def _(v):
    return popularity.entropy_weights(v.artists.where("active"), popularity.FOUR, 0.40).withColumn("weight", F.round("weight", 6))


_POP = f"""{_weights(_FOUR, True, '(select * from dv_artists where active)')},
  pop as (select artist_id, {even(clamp_sql("5 + 95 * (" + " + ".join("max(case when platform = '" + n + "' then " + even("z / top * w", 4) + " end)" for n in _FOUR) + ")", 0, 100), 2)} as popularity_score,
    max(case when platform = 'spotify' then {even('z / top * w', 4)} end) as spotify_part from long join weights using (platform) group by 1)"""


@query("popularity_all", f"with {_POP} select * from pop")
def _(v):
    out = popularity.popularity_all(v.artists)
    return out.select("artist_id", "popularity_score", F.col("platform_contributions")["spotify"].alias("spotify_part"))


@query("popularity_service", f"""with {_weights(_FIVE, False, '(select * from dv_artists where active)')}, every as (select artist_id, unnest([('spotify', coalesce(spotify_listeners, 0)), ('youtube', youtube_subscribers), ('instagram', instagram_followers),
   ('facebook', coalesce(facebook_followers, 0)), ('twitter', twitter_followers)]) t from dv_artists)
  select artist_id, case when max(t[2]) <= 0 then 45 else {up(clamp_sql('5 + sum(ln(1 + t[2]::double) / top * w) * 95', 5, 100), 2)} end as popularity from every join weights on platform = t[1] group by 1""")
def _(v):
    return popularity.popularity_service(v.artists)


@query("popularity_series", f"""with {_ser('dv_metrics_long')}, days as (select distinct artist_id, date from ser), pl as (select distinct artist_id, platform from ser),
  grid as (select d.artist_id, p.platform, d.date, ln(1 + greatest(coalesce(x, 0), 0)) z from days d join pl p using (artist_id) left join ser s on s.artist_id = d.artist_id and s.platform = p.platform and s.date = d.date),
  tot as (select artist_id, platform, sum(z) s, max(z) top, count(*) n, arg_max(z, date) zl from grid group by 1, 2),
  ent as (select artist_id, platform, any_value(top) top, any_value(zl) zl, case when any_value(s) > 0 and any_value(n) > 1 then greatest(0, 1 + sum(case when z > 0 then z / s * ln(z / s) else 0 end) / ln(any_value(n))) else 0 end d
    from grid join tot using (artist_id, platform) group by 1, 2),
  raw as (select *, case when sum(d) over a > 0 then d / sum(d) over a else 1::double / count(*) over a end w, sum(d) over a > 0 live from ent window a as (partition by artist_id)),
  sh as (select *, coalesce(max(case when platform = 'spotify' and live then greatest(0.4::double - w, 0) end) over a, 0) short, sum(case when platform <> 'spotify' then w else 0 end) over a rest from raw window a as (partition by artist_id)),
  li as (select *, case when platform = 'spotify' then w + short when rest > 0 then w - short * (w / rest) else w end lw from sh),
  fin as (select *, lw / sum(lw) over (partition by artist_id) weight from li)
  select artist_id, {even(clamp_sql("5 + 95 * sum((" + even("case when top > 0 then zl / top else 0 end * weight", 4) + ")::decimal(12,4))::double", 0, 100), 2)} as popularity_score,
   max(case when platform = 'spotify' then {even('weight', 4)} end) as spotify_weight from fin group by 1""")
def _(v):
    out = popularity.popularity_series(v.metrics_long)
    return out.select("artist_id", "popularity_score", F.try_element_at("platform_weights", F.lit("spotify")).alias("spotify_weight"))


@query("update_popularity", f"with {_POP} select artist_id, artist_name, coalesce(popularity_score, popularity) as popularity from dv_artists left join pop using (artist_id)")
def _(v):
    return popularity.update_popularity(v.artists, popularity.popularity_all(v.artists)).select("artist_id", "artist_name", "popularity")
