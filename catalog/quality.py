"""Validation, repair and features."""

from __future__ import annotations

from pyspark.sql import Window as W, functions as F

from backline.functions import refdata as R
from backline.operators import checks, demand, features, reports
from catalog.base import DAY_LONG, any_in, clamp_sql, even, money, query, up
from catalog.listings import _NORM, _events
from catalog.metrics import _ENG, _MAJOR, _MOM, _weights, _FIVE
from catalog.venues import _DEFAULT_PRICE

_RULES = [
    ("city required", "coalesce(city, '') <> ''"), ("country required", "coalesce(country, '') <> ''"), ("date required", "c.concert_date is not null"),
    ("capacity positive", "capacity is null or capacity > 0"), ("tickets not negative", "tickets_sold is null or tickets_sold >= 0"), ("price positive", "avg_ticket_price is null or avg_ticket_price > 0"),
    ("revenue positive", "total_revenue is null or total_revenue > 0"), ("demand 0-100", "demand_score is null or demand_score between 0 and 100"), ("currency code", "currency is null or length(currency) = 3"),
]


@query("constraint_rejects", "select * from (select concert_id, concat_ws(', ', " + ", ".join(f"case when not ({c}) then '{n}' end" for n, c in _RULES) + ") as failed from dv_concerts c) where failed <> ''")
def _(v):
    _, bad = checks.check_constraints(v.concerts, checks.concert_rules())
    return bad.select("concert_id", F.array_join("failed", ", ").alias("failed"))


@query("constraint_accepts_metrics", "select artist_id, platform, date::varchar as date from dv_metrics_long where followers >= 0 and streams >= 0 and likes >= 0 and comments >= 0 and shares >= 0")
def _(v):
    ok, _ = checks.check_constraints(v.metrics_long, checks.metric_rules())
    return ok.select("artist_id", "platform", "date")


@query("constraint_rejects_demographics", """select demo_id, case when dimension_value is null then 'value required' end as failed from dv_demographics where dimension_value is null""")
def _(v):
    _, bad = checks.check_constraints(v.demographics, checks.demographic_rules())
    return bad.select("demo_id", F.array_join("failed", ", ").alias("failed"))


@query("constraint_rejects_places", """with c as (select concert_id, concert_id % 400 - 200 as latitude, case when concert_id % 5 <> 0 then concert_id % 800 - 400 end as longitude from dv_concerts)
  select concert_id, concat_ws(', ', case when latitude not between -90 and 90 then 'latitude range' end, case when longitude not between -180 and 180 then 'longitude range' end) as failed
  from c where latitude not between -90 and 90 or longitude not between -180 and 180""")
def _(v):
    k = F.col("concert_id")
    placed = v.concerts.select(k, (k % 400 - 200).alias("latitude"), F.when(k % 5 != 0, k % 800 - 400).alias("longitude"))
    _, bad = checks.check_constraints(placed, checks.place_rules())
    return bad.select("concert_id", F.array_join("failed", ", ").alias("failed"))


_HOSTS = "case when regexp_matches(source_url, '^https?://') then lower(regexp_extract(source_url, '^https?://([^/]+)', 1)) end"
_OKHOST = "(" + " or ".join(f"{_HOSTS} = '{d}' or {_HOSTS} like '%.{d}'" for d in checks.TRUSTED_DOMAINS) + ")"
_VAL = f"""{_NORM}, refs as (select canonical_key, count(*) n, min(event_id) head from nev group by 1),
  sig as (select e.*, upper(source_platform) in ({', '.join(f"'{s}'" for s in checks.TRUSTED_SOURCES)}) or coalesce({_OKHOST}, false) tr, official_ticket_url is not null or source_url is not null tk,
    exists (select 1 from dv_venues w where lower(w.venue_name) = lower(e.venue_name) and lower(w.city) = lower(e.city) and lower(w.country) = lower(e.country)) ve, n, head <> event_id dup from nev e join refs using (canonical_key)),
  sc as (select *, case when tr then 0.22 else 0 end::double s1, case when tk then 0.18 else 0 end::double s2, case when ve then 0.18 else 0.05 end::double s3, case when verified_artist_account then 0.12 else 0 end::double s4,
    least(0.22::double, (n - 1) * 0.11::double) s5, case when dup then -0.12 else 0 end::double s6 from sig),
  cr as (select *, {up(clamp_sql("case when tr then 0.22 else 0.12 end::double + confidence_score * 0.2::double + (5 + case when source_url is not null then 1 else 0 end) / 6::double * 0.12::double + (s1 + s2 + s3 + s4 + s5 + s6)", 0, 1), 4)} as confidence,
    {up(clamp_sql(f"0.5::double - s1 - s2 * 0.75::double - s3 * 0.7::double - s5 * 0.6::double + case when dup then 0.08 else 0 end::double + case when event_date < date '2000-01-01' - 1 then 0.05 else 0 end::double + (case when source_url is null then 0.08 else 0 end::double) + case when price_min is null and price_max is null then 0.03 else 0 end::double", 0, 1), 4)} as fraud_risk from sc),
  validated as (select *, case when dup then 'DUPLICATE' when confidence >= 0.76 and fraud_risk <= 0.38 then 'VALIDATED' when confidence < 0.42 or fraud_risk >= 0.72 then 'REJECTED' else 'REVIEW_REQUIRED' end as status from cr)"""


def _to_validate(v):
    # the listings of one event (one artist, venue and day) meet once, with the columns that are read only
    same = W.partitionBy("canonical_key")
    e = _events(v).withColumns({"confirmations": F.count(F.lit(1)).over(same), "head": F.min("event_id").over(same)})
    return e.withColumn("duplicate", F.col("head") != F.col("event_id"))


@query("validate_events", f"with {_VAL} select event_id, confidence, fraud_risk, status from validated")
def _(v):
    return checks.validate_events(_to_validate(v), v.venues, "2000-01-01").select("event_id", "confidence", "fraud_risk", "status")


@query("validation_status_counts", f"with {_VAL} select source_platform, status, count(*) as rows from validated group by 1, 2")
def _(v):
    return reports.count_by(checks.validate_events(_to_validate(v), v.venues, "2000-01-01"), "source_platform", "status")


_STP = "greatest(0.3::double, least(0.95::double, 0.3::double + coalesce(nullif(pop, 0), 50) / 100 * 0.65::double))"


@query("repair_concerts", f"""with a as (select c.*, popularity pop, tickets_sold > capacity and capacity > 0 ov from dv_concerts c join (select artist_id, popularity from dv_artists) using (artist_id)),
  b as (select * replace (case when ov then round(capacity * 0.85)::bigint else tickets_sold end as tickets_sold, case when ov then round(capacity * 0.85)::bigint * coalesce(avg_ticket_price, 1500) else total_revenue end as total_revenue) from a),
  w as (select *, capacity > 0 and tickets_sold > 0 and tickets_sold::double / nullif(capacity, 0) < 0.2 and source in ('setlistfm', 'songkick', 'bookmyshow', 'district') wk, least(floor(capacity * {_STP}), capacity)::bigint nt from b),
  d as (select * replace (case when wk then nt else tickets_sold end as tickets_sold, case when wk then {even('nt * coalesce(nullif(avg_ticket_price, 0), 1500)', 2)} else total_revenue end as total_revenue) from w),
  e as (select * replace (case when coalesce(total_revenue, 0) = 0 and tickets_sold > 0 and avg_ticket_price > 0 then tickets_sold * avg_ticket_price else total_revenue end as total_revenue) from d)
  select concert_id, tickets_sold, {up('total_revenue', 2)} as total_revenue, case when total_revenue > 0 and tickets_sold > 0 and capacity > 0 and verification_status = 'PENDING' and source <> 'setlistfm' then 'VERIFIED' else verification_status end as verification_status from e""")
def _(v):
    return checks.repair_concerts(v.concerts, v.artists).select("concert_id", "tickets_sold", _r("total_revenue", 2), "verification_status")


_LO = "case " + " ".join(f"when contains(lower(country), '{k}') then {a}" for k, (a, _) in R.PRICE_RANGES.items()) + " else 20 end"
_HI = "case " + " ".join(f"when contains(lower(country), '{k}') then {b}" for k, (_, b) in R.PRICE_RANGES.items()) + " else 500 end"
_AUDIT = f"""a as (select concert_id, country, coalesce(capacity, 0) cap, coalesce(tickets_sold, 0) - case when concert_id % 50 = 0 then 1000000 else 0 end t, coalesce(avg_ticket_price, 0) p, coalesce(total_revenue, 0) r, case when concert_id % 3 = 0 then 9000 else 0 end web
    from dv_concerts where capacity > 0 or tickets_sold > 0 or total_revenue > 0),
  b as (select *, web > 0 and cap > 0 and web::double / nullif(cap, 0) > 1.5 and web::double / nullif(cap, 0) <= 5 low, web > 0 and cap = 0 none from a),
  c as (select *, not coalesce(low, false) and cap > 0 and web >= 1000 and cap > web * 2.5 high from b),
  d as (select *, case when low or high or none then web end nc, coalesce(case when low or high or none then web end, cap) eff from c),
  e as (select *, t > eff and eff > 0 over_, t < 0 neg, case when t > eff and eff > 0 then floor(eff * 0.9::double)::bigint when t < 0 then 0 end nt, case when t > eff and eff > 0 then floor(eff * 0.9::double)::bigint else t end sold from d),
  f as (select *, case when eff > 0 then sold::double / eff * 100 else 0 end st, p > 0 and (p < ({_LO}) * 0.3::double or p > ({_HI}) * 3) odd, sold > 0 and p > 0 and r > 0 and (r / nullif(sold * p, 0) > 2.5 or r / nullif(sold * p, 0) < 0.3) off_, r = 0 and sold > 0 and p > 0 miss from e),
  audit as (select concert_id, concat_ws('; ', case when low then 'capacity may be too low' end, case when high then 'capacity may be too high' end, case when none then 'capacity was 0' end, case when over_ then 'tickets above capacity' end, case when neg then 'tickets were negative' end,
    case when st > 100 then 'sell-through above 100%' end, case when odd then 'price outside expected range' end, case when off_ then 'revenue inconsistent with tickets and price' end, case when miss then 'revenue was 0' end) as issues,
    nc as new_capacity, nt as new_tickets, case when off_ or miss then {even('sold * p', 2)} end as new_revenue, {even('st', 1)} as sell_through from f)"""


def _audited(v):
    k = F.col("concert_id")
    c = v.concerts.withColumn("tickets_sold", F.when(k % 50 == 0, F.coalesce("tickets_sold", F.lit(0)) - 1000000).otherwise(F.col("tickets_sold")))
    # the same rows as the plain table: the shift must not change which rows are audited
    keep = v.concerts.where("capacity > 0 or tickets_sold > 0 or total_revenue > 0").select("concert_id")
    ev = v.concerts.where(k % 3 == 0).select("concert_id", F.lit(9000).alias("web_capacity"))
    return c, checks.audit_concerts(c.join(keep, "concert_id", "left_semi"), ev)


@query("audit_concerts", f"with {_AUDIT} select * from audit")
def _(v):
    return _audited(v)[1].select("concert_id", F.array_join("issues", "; ").alias("issues"), "new_capacity", "new_tickets", "new_revenue", "sell_through")


@query("validation_report", f"""with {_AUDIT} select count(*) as rows, {up(money('case when sell_through > 0 then sell_through end') + ' / count(case when sell_through > 0 then 1 end)', 4)} as mean_sell_through, min(sell_through) filter (where sell_through > 0) as min_sell_through,
  max(sell_through) filter (where sell_through > 0) as max_sell_through, count(*) filter (where issues <> '') as with_issues, count(*) filter (where new_capacity is not null or new_tickets is not null or new_revenue is not null) as with_corrections from audit""")
def _(v):
    return reports.validation_report(_audited(v)[1])


@query("apply_corrections", f"""with {_AUDIT} select concert_id, coalesce(new_capacity, c.capacity) as capacity, coalesce(new_tickets, case when concert_id % 50 = 0 then coalesce(c.tickets_sold, 0) - 1000000 else c.tickets_sold end) as tickets_sold, coalesce(new_revenue, c.total_revenue) as total_revenue
  from dv_concerts c left join audit using (concert_id)""")
def _(v):
    c, audit = _audited(v)
    return checks.apply_corrections(c, audit).select("concert_id", "capacity", "tickets_sold", "total_revenue")


@query("flag_status", """select concert_id, case when total_revenue = 0 and tickets_sold = 0 then 'PENDING' when total_revenue > 0 and tickets_sold > 0 and verification_status = 'PENDING' then 'VERIFIED' else verification_status end as verification_status from dv_concerts""")
def _(v):
    return checks.flag_status(v.concerts).select("concert_id", "verification_status")


_MEANP = f"mp as (select artist_id, {up('coalesce(' + money('case when avg_ticket_price > 0 then avg_ticket_price end') + ' / nullif(count(case when avg_ticket_price > 0 then 1 end), 0), 1500)', 4)} mean_price from dv_concerts group by 1)"


@query("predict_empty", f"""with {_MEANP}, x as (select c.*, popularity pop, mean_price, capacity > 0 and coalesce(total_revenue, 0) = 0 and coalesce(tickets_sold, 0) = 0 em from dv_concerts c join (select artist_id, popularity from dv_artists) using (artist_id) join mp using (artist_id)),
  y as (select *, case when avg_ticket_price > 0 then avg_ticket_price else mean_price end atp, least(floor(capacity * {_STP}), capacity)::bigint tix from x)
  select concert_id, case when em then tix else tickets_sold end as tickets_sold, case when em then {even('atp', 2)} else avg_ticket_price end as avg_ticket_price, case when em then {even('tix * atp', 2)} else total_revenue end as total_revenue from y""")
def _(v):
    return checks.predict_empty(v.concerts, v.artists).select("concert_id", "tickets_sold", "avg_ticket_price", "total_revenue")


# --- features ---------------------------------------------------------------------------

_SHAREX = "case when coalesce(capacity, 0) = 0 then 0.5 else least(1::double, greatest(0::double, coalesce(tickets_sold, 0)::double / capacity)) end"
_MEANX = f"sum(({_SHAREX})::decimal(20,12))::double / count(*)"
_FEAT = f"""ev as (select concert_id as event_id, artist_id, venue_name, city, country, c.concert_date as event_date, case when concert_id % 3 = 0 then avg_ticket_price end as price_min, case when concert_id % 6 = 0 then avg_ticket_price * 2 end as price_max from dv_concerts c),
  cd as (select lower(city) kc, lower(country) kk, {_MEANX} ms from dv_concerts group by 1, 2), own as (select artist_id, lower(city) kc, lower(country) kk, count(*) own from dv_concerts group by 1, 2, 3),
  sh as (select t.artist_id, lower(t.city) kc, max(row(metric_date, demo_id)) k from (select distinct artist_id, city from dv_concerts) t join dv_demographics d on d.artist_id = t.artist_id and dimension = 'GEOGRAPHY' and contains(lower(dimension_value), lower(t.city)) group by 1, 2),
  shx as (select sh.artist_id, kc, percentage share from sh join dv_demographics d on d.demo_id = sh.k[2]),
  vp as (select lower(venue_name) kv, lower(city) kc, lower(country) kk, {_MEANX} vms, count(*) vn from dv_concerts where venue_name is not null group by 1, 2, 3),
  mk as (select lower(city) kc, lower(country) kk, {money('avg_ticket_price')} / count(avg_ticket_price) market, count(avg_ticket_price) mn from dv_concerts where avg_ticket_price is not null group by 1, 2),
  hp as (select lower(city) kc, lower(country) kk, {money('avg_ticket_price')} / count(*) city_price from dv_concerts where avg_ticket_price > 0 group by 1, 2),
  j as (select e.*, ms, coalesce(own, 0) own, coalesce(share, 0) share, vms, vn, w.verified, coalesce(nullif(w.avg_capacity, 0), nullif(w.capacity_max, 0), nullif(w.capacity_min, 0)) scap, nullif(w.avg_ticket_price, 0) sprice, market, mn, city_price
    from ev e left join cd on cd.kc = lower(city) and cd.kk = lower(country) left join own o on o.artist_id = e.artist_id and o.kc = lower(city) and o.kk = lower(country) left join shx s on s.artist_id = e.artist_id and s.kc = lower(city)
    left join vp on vp.kv = lower(e.venue_name) and vp.kc = lower(e.city) and vp.kk = lower(e.country) left join dv_venues w on lower(w.venue_name) = lower(e.venue_name) and lower(w.city) = lower(e.city) and lower(w.country) = lower(e.country)
    left join mk on mk.kc = lower(e.city) and mk.kk = lower(e.country) left join hp on hp.kc = lower(e.city) and hp.kk = lower(e.country)),
  inp as (select *, coalesce(case when nullif(price_min, 0) is not null and nullif(price_max, 0) is not null then (price_min + price_max) / 2 end, nullif(price_min, 0), nullif(price_max, 0), sprice, city_price, {_DEFAULT_PRICE})::double price,
     case when coalesce(nullif(price_min, 0), nullif(price_max, 0)) is not null then 'scraped_ticket_range' when sprice is not null then 'venue_db' when city_price is not null then 'city_history' else 'country_default' end price_source,
     coalesce(scap, case when regexp_matches(lower(venue_name), '\\bstadium\\b') then 45000 when regexp_matches(lower(venue_name), '\\barena\\b') then 15000 when regexp_matches(lower(venue_name), '\\bamphitheat') then 8000 when regexp_matches(lower(venue_name), '\\btheatre\\b') then 2500
       when regexp_matches(lower(venue_name), '\\b(club|lounge|bar)\\b') then 700 when regexp_matches(lower(venue_name), '\\bfestival\\b') then 25000 when regexp_matches(lower(venue_name), '\\b(hall|centre|center)\\b') then 3500 else 5000 end)::bigint vcap, case when scap is not null then 'venue_db' else 'venue_name_estimate' end capacity_source from j),
  sc as (select *, case when ms is null then case when {_MAJOR} then 10 else 0 end + coalesce(nullif(share, 0), 35) else {clamp_sql(f"ms * 62 + case when {_MAJOR} then 10 else 0 end + least(18::double, share * 0.8::double) + least(12, own * 3)", 0, 100)} end as city_demand,
     case when venue_name is null then 50 when vn is null then case when verified then 58 else 48 end else {clamp_sql('vms * 76 + least(12, vn)', 0, 100)} end::double as venue_performance,
     case when coalesce(price, 0) = 0 then 50 when coalesce(mn, 0) < 3 then 55 when market = 0 then 50 when price / market between 0.75 and 1.25 then 78 when price / market > 1.25 and price / market <= 1.55 then 64 when price / market < 0.75 and price / market >= 0.5 then 68 else 42 end::double as tpi,
     least(100, 48 + case month(event_date) when 10 then 7 when 11 then 12 when 12 then 16 when 1 then 8 when 2 then 6 when 3 then 4 else 0 end + case when isodow(event_date) >= 5 then 10 else 0 end)::double as seasonal from inp)"""


def _targets(v):
    k, p = F.col("concert_id"), F.col("avg_ticket_price")
    return v.concerts.select(k.alias("event_id"), "artist_id", "venue_name", "city", "country", F.col("concert_date").alias("event_date"), F.when(k % 3 == 0, p).alias("price_min"), F.when(k % 6 == 0, p * 2).alias("price_max"))


def _r(c, d=4):
    return (F.floor(F.col(c) * 10.0**d + 0.5) / 10.0**d).alias(c)


@query("city_demand", f"with {_FEAT} select event_id, {up('city_demand', 4)} as city_demand from sc")
def _(v):
    return features.city_demand(_targets(v), v.concerts, v.demographics).select("event_id", _r("city_demand"))


@query("venue_performance", f"with {_FEAT} select event_id, {up('venue_performance', 4)} as venue_performance from sc")
def _(v):
    return features.venue_performance(_targets(v), v.concerts, v.venues).select("event_id", _r("venue_performance"))


@query("price_position", f"with {_FEAT} select event_id, tpi as ticket_pricing_intelligence from sc")
def _(v):
    return features.price_position(features.resolve_inputs(_targets(v), v.venues, v.concerts), v.concerts).select("event_id", "ticket_pricing_intelligence")


@query("seasonal_trend", f"with {_FEAT} select event_id, seasonal as seasonal_trends from sc")
def _(v):
    return _targets(v).select("event_id", features.seasonal_trend(F.col("event_date")).alias("seasonal_trends"))


@query("resolve_inputs", f"with {_FEAT} select event_id, vcap as venue_capacity, capacity_source, {up('price', 4)} as price, price_source from sc")
def _(v):
    return features.resolve_inputs(_targets(v), v.venues, v.concerts).select("event_id", "venue_capacity", "capacity_source", _r("price"), "price_source")


_BUILT = f"""with {_weights(_FIVE, False, '(select * from dv_artists where active)')}, every as (select artist_id, unnest([('spotify', coalesce(spotify_listeners, 0)), ('youtube', youtube_subscribers), ('instagram', instagram_followers), ('facebook', coalesce(facebook_followers, 0)), ('twitter', twitter_followers)]) t from dv_artists),
  gp as (select artist_id, case when max(t[2]) <= 0 then 45 else {up(clamp_sql('5 + sum(ln(1 + t[2]::double) / top * w) * 95', 5, 100), 2)} end gpop from every join weights on platform = t[1] group by 1), {_MOM}, {_ENG}, {_FEAT},
  f0 as (select s.*, coalesce(artist_momentum, 45)::double m, coalesce(engagement_velocity, case when gpop is null then 45 else 50 end)::double ev, coalesce(gpop, 45)::double g from sc s left join mom using (artist_id) left join eng using (artist_id) left join gp using (artist_id)),
  f1 as (select *, {clamp_sql('g * 0.52::double + city_demand * 0.32::double + m * 0.16::double', 0, 100)} loc from f0),
  feat as (select event_id, {up('g', 2)} as global_popularity, {up('loc', 2)} as local_popularity, {up('m', 2)} as artist_momentum, {up('city_demand', 2)} as city_demand, {up('venue_performance', 2)} as venue_performance, tpi as ticket_pricing_intelligence, seasonal as seasonal_trends, {up('ev', 2)} as engagement_velocity,
    greatest(100, vcap) as venue_capacity, {up('greatest(1::double, price)', 2)} as avg_ticket_price, (event_date - date '{DAY_LONG}')::int as days_until_event, isodow(event_date) >= 5 as is_weekend from f1)"""


def _built(v):
    return features.build_features(_targets(v), v.artists, v.metrics, v.concerts, v.venues, v.demographics, DAY_LONG)


_COLS = ["event_id", *features.FEATURE_WEIGHTS, "venue_capacity", "avg_ticket_price", "days_until_event", "is_weekend"]


@query("event_features", f"{_BUILT} select {', '.join(_COLS)} from feat")
def _(v):
    return _built(v).select(*_COLS)


_DEM = " + ".join(f"{c} * {w}::double" for c, w in features.FEATURE_WEIGHTS.items())


@query("predict_from_features", f"""{_BUILT}, d as (select *, {clamp_sql(_DEM, 0, 100)} dem from feat),
  p as (select *, {clamp_sql("0.18::double + dem / 115 + case when venue_capacity < 1000 then 0.08 when venue_capacity > 20000 then -0.08 else 0 end::double + case when days_until_event < 0 then -0.05 else 0 end::double + case when is_weekend then 0.04 else 0 end::double", 0.05, 0.99)} pr from d),
  a as (select *, least(venue_capacity, greatest(0, {up('venue_capacity * pr')}))::bigint att from p)
  select event_id, {up('dem', 2)} as demand_score, {up('pr', 4)} as sellout_probability, att as expected_attendance, {up('att * avg_ticket_price', 2)} as expected_revenue from a""")
def _(v):
    return features.predict_from_features(_built(v)).select("event_id", "demand_score", "sellout_probability", "expected_attendance", "expected_revenue")


@query("prediction_accuracy", f"""select concert_id, prediction_id, model_version, expected_revenue, created_at::varchar as created_at, case when total_revenue > 0 then {up(clamp_sql('(1 - abs(total_revenue - expected_revenue) / total_revenue) * 100', 0, 100), 2)} else 0 end as accuracy
  from dv_predictions join (select concert_id, total_revenue from dv_concerts) using (concert_id) where total_revenue <> 0""")
def _(v):
    return features.prediction_accuracy(v.predictions, v.concerts).select("concert_id", "prediction_id", "model_version", "expected_revenue", "created_at", "accuracy")
