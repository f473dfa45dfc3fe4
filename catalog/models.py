"""Training frame, revenue model, event flow and the windowed totals."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from backline.functions import refdata as R
from backline.operators import revenue
from backline.plans import event_flow, nightly
from backline.session import checkpoint_dir, cut_lineage
from backline.streaming import metrics as stream
from catalog.base import DAY, DAY_LONG, clamp_sql, eq_case, even, in_case, money, query, up
from catalog.metrics import _W, _growth, _season, _synth, tier_sql


def _r(c, d=4):
    return (F.floor(F.col(c) * 10.0**d + 0.5) / 10.0**d).alias(c)


_MET = f"""syn as ({_synth('training').replace(DAY, DAY_LONG)}), tm as (select artist_id, platform, date, followers, streams, views from dv_metrics_long where artist_id in (select artist_id from dv_metrics_long group by 1 having count(*) >= 7)
   union all select artist_id, platform, date::date, followers, streams, views from syn where artist_id in (select artist_id from dv_artists where active) and artist_id not in (select artist_id from dv_metrics_long group by 1 having count(*) >= 7)),
  {_growth('tm')}, lm as (select *, max(date) over (partition by artist_id) lastd from ser),
  pg as (select artist_id, platform, count(*) n, arg_max(x, date) - arg_min(x, date) gain from lm where date >= lastd - 14 group by 1, 2),
  sv as (select artist_id, case when gain > 0 then least(1::double, ln(1 + greatest(gain, 0)) / ln(1000001::double)) else 0 end sv from (select artist_id, coalesce(sum(gain) filter (where n >= 2), 0) gain from pg group by 1)),
  sm as (select artist_id, {tier_sql('max(followers)')} artist_tier from tm group by 1), bg as (select artist_id, greatest(0, max(rog_30d)) best from growth group by 1),
  cps as (select artist_id, {even(f"coalesce(sum({_W} * (50 + 50 * tanh(rog_30d / 20))) filter (where points >= 3) / sum({_W}) filter (where points >= 3), 50)", 2)} cross_platform_score from growth group by 1),
  tr as (select *, case when p0 <= 0 then 500 else p0 end lo from (select c.*, coalesce(nullif(price_tier3, 0), case when coalesce(avg_ticket_price, 0) > 0 then avg_ticket_price * 0.5::double else 500 end) p0,
     coalesce(nullif(price_vip, 0), case when coalesce(avg_ticket_price, 0) > 0 then avg_ticket_price * 2 else 2000 end)::double p1 from dv_concerts c where total_revenue > 0 and capacity > 0)),
  tr2 as (select *, case when p1 <= lo then lo * 3 else p1 end hi from tr),
  frame as (select concert_id, t.artist_id, capacity::double venue_capacity, lo + (hi - lo) * 0.235::double avg_ticket_price, hi - lo price_range, capacity * (lo + (hi - lo) * 0.235::double) max_revenue_naive, (isodow(t.concert_date) >= 5)::int::double is_weekend, month(t.concert_date)::double as month,
     case when demand_score > 0 then demand_score else {clamp_sql('sv * 100', 5, 95)} end demand_score, best best_rog_30d, cross_platform_score, case when month(t.concert_date) in (12, 1, 2) then 'winter' when month(t.concert_date) < 6 then 'spring' when month(t.concert_date) < 9 then 'summer' else 'autumn' end season,
     city, country, artist_tier, total_revenue actual_revenue from tr2 t join sv using (artist_id) join sm using (artist_id) join bg using (artist_id) join cps using (artist_id))"""


def _frame(v):
    return revenue.training_frame(v.concerts, v.metrics_long, v.artists, DAY_LONG)


@query("training_frame", f"""with {_MET} select concert_id, venue_capacity, {up('avg_ticket_price', 4)} as avg_ticket_price, {up('price_range', 4)} as price_range, {up('max_revenue_naive', 2)} as max_revenue_naive, is_weekend, month, {up('demand_score', 4)} as demand_score, {up('best_rog_30d', 3)} as best_rog_30d,
   cross_platform_score, season, city, country, artist_tier, actual_revenue from frame""")
def _(v):
    return _frame(v).select("concert_id", "venue_capacity", _r("avg_ticket_price"), _r("price_range"), _r("max_revenue_naive", 2), "is_weekend", "month", _r("demand_score"), _r("best_rog_30d", 3), "cross_platform_score", "season", "city", "country", "artist_tier", "actual_revenue")


_RULE = """greatest(0.15::double, least(0.9::double, greatest(0.15::double, least(0.85::double, 0.25::double + (demand_score - 10) / 85 * 0.5::double)) * case when venue_capacity < 1000 then 1.3 when venue_capacity < 5000 then 1.1 when venue_capacity < 20000 then 1.0 else 0.8 end::double))"""
_CODE = f"coalesce({eq_case('lower(country)', R.COUNTRY_CURRENCY)}, {in_case('lower(country)', R.COUNTRY_CURRENCY, chr(39) + 'USD' + chr(39))})"


@query("heuristic_revenue", f"""with {_MET}, h as (select *, venue_capacity * avg_ticket_price * {_RULE} as mid, {_CODE} as currency from frame), k as (select *, {eq_case('currency', R.USD_RATES, '1')}::double as rate from h)
  select concert_id, currency, {even('mid', 2)} as predicted_revenue, {even('mid * 0.7::double', 2)} as lower_bound, {even('mid * 1.3::double', 2)} as upper_bound, {even(even('mid', 2) + ' / rate', 2)} as predicted_revenue_usd, rate as exchange_rate from k""")
def _(v):
    out = revenue.heuristic_revenue(_frame(v))
    return out.select("concert_id", "currency", "predicted_revenue", "lower_bound", "upper_bound", "predicted_revenue_usd", "exchange_rate")


@query("evaluate_predictions", """with p as (select expected_revenue::double p, total_revenue::double y from dv_predictions join (select concert_id, total_revenue from dv_concerts) using (concert_id) where total_revenue > 0)
  select count(*) as rows, round(avg(abs(y - p)), 2) as mae, round(1 - sum((y - p) * (y - p)) / (var_pop(y) * count(*)), 6) as r2, round(avg(abs(y - p) / abs(y)) * 100, 3) as mape, round(stddev_pop(y), 2) as label_std from p""")
def _(v):
    p = v.predictions.join(v.concerts.where("total_revenue > 0").select("concert_id", "total_revenue"), "concert_id")
    e = revenue.evaluate(p, "total_revenue", "expected_revenue")
    return e.select("rows", F.round("mae", 2).alias("mae"), F.round("r2", 6).alias("r2"), F.round("mape", 3).alias("mape"), F.round("label_std", 2).alias("label_std"))


# Stored predictions in folds by a number of the concert: one aggregation rates every fold and all rows.
@query("fold_evaluation", """with p as (select (concert_id % 5)::int as fold, expected_revenue::double p, total_revenue::double y from dv_predictions join (select concert_id, total_revenue from dv_concerts) using (concert_id) where total_revenue > 0)
  select fold, count(*) as rows, round(avg(abs(y - p)), 2) as mae, round(1 - sum((y - p) * (y - p)) / nullif(var_pop(y) * count(*), 0), 6) as r2, round(stddev_pop(y), 2) as label_std from p group by rollup (fold)""")
def _(v):
    p = v.predictions.join(v.concerts.where("total_revenue > 0").select("concert_id", "total_revenue"), "concert_id").withColumn("fold", (F.col("concert_id") % 5).cast("int"))
    e = revenue.evaluate_folds(p, "total_revenue", "expected_revenue")
    return e.select("fold", "rows", F.round("mae", 2).alias("mae"), F.round("r2", 6).alias("r2"), F.round("label_std", 2).alias("label_std"))


# Five folds of the revenue model, each with the settings of the stored model.
@query("cross_validate")
def _(v):
    return revenue.cross_validate(_frame(v))


# Training pairs of predictions whose concert has a revenue.
@query("training_rows", f"""select concert_id, total_revenue as actual_revenue, expected_revenue as predicted_revenue, case when total_revenue > 0 then {up(clamp_sql('(1 - abs(total_revenue - expected_revenue) / total_revenue) * 100', 0, 100), 2)} else 0 end as accuracy, 'm1' as model_version
  from dv_predictions join (select concert_id, total_revenue from dv_concerts) using (concert_id) where total_revenue <> 0""")
def _(v):
    numbered = v.predictions.withColumn("event_id", F.concat_ws("|", "prediction_id", "concert_id", "model_version"))
    links = numbered.select("event_id", "concert_id")
    return event_flow.training_rows(numbered, v.concerts, links.dropDuplicates(["event_id"]), "m1")


@query("score_concerts")
def _(v):
    frame = cut_lineage(_frame(v))
    train, _test = revenue.split_frame(frame)
    return revenue.score_concerts(revenue.train_revenue(train), frame)


_POSX = lambda c: f"{money(f'case when {c} > 0 then {c} end')} / nullif(count(case when {c} > 0 then 1 end), 0)"


@query("revenue_inputs", f"""with g as (select artist_id, min(city) city, min(country) country, {_POSX('capacity')} cap, coalesce({_POSX('avg_ticket_price')}, 1250) price, {_POSX('price_tier3')} lo, {_POSX('price_vip')} hi from dv_concerts group by artist_id, lower(city))
  select artist_id, city, country, greatest(100, {up('coalesce(cap, 5000)')})::bigint as venue_capacity, {up('price', 4)} as avg_ticket_price, {up('coalesce(lo, ' + up('greatest(1, price) * 0.75::double * 100') + ' / 100)', 4)} as ticket_price_min,
   {up('coalesce(hi, ' + up('greatest(1, price) * 1.85::double * 100') + ' / 100)', 4)} as ticket_price_max, (date '{DAY_LONG}' + 30)::varchar as concert_date from g""")
def _(v):
    return revenue.revenue_inputs(v.concerts, DAY_LONG)


@query("event_flow_summary")
def _(v):
    return event_flow.run_event_flow(v.raw, v.artists, v.metrics, v.concerts, v.venues, v.demographics, DAY_LONG).summary


# The flow's tables, stored twice under one run, with their rows: the second run replaces the first.
@query("stored_event_flow")
def _(v):
    out = f"{checkpoint_dir(v.spark)}/flow-{uuid.uuid4().hex}"
    flow = event_flow.run_event_flow(v.raw, v.artists, v.metrics, v.concerts, v.venues, v.demographics, DAY_LONG)
    event_flow.store_event_flow(flow, out, "r1")
    event_flow.store_event_flow(flow, out, "r1")
    counted = [v.spark.read.parquet(f"{out}/{t}").agg(F.lit(t).alias("table_name"), F.count("*").alias("rows")) for t in event_flow.STORED]
    return reduce(DataFrame.unionByName, counted)


# A night with scraped rows and retraining: every step of the chain runs.
@query("nightly_concerts")
def _(v):
    scraped = v.raw.where("city is not null").select(
        "artist_name", "event_name", "venue_name", "city", "country", F.col("show_date").alias("concert_date"), "price_min", "price_max",
        F.lit("USD").alias("currency"), F.lower("source_platform").alias("source"), "source_url")
    model = f"{checkpoint_dir(v.spark)}/model-{uuid.uuid4().hex}"
    return nightly.run_daily(v.artists, v.metrics_long, v.concerts, DAY_LONG, scraped, model, v.venues)["concerts"]


_EVENTS = "select {w}::date::varchar as day, event_type, count(*) as events, round(sum(value::decimal(18,4))::double, 2) as total from events group by 1, 2"


@query("daily_totals", _EVENTS.format(w="date_trunc('day', ts)"))
def _(v):
    out = stream.windowed_totals(v.events.withColumn("ts", F.col("ts").cast("timestamp")))
    return out.select(F.to_date("window_start").alias("day"), "event_type", "events", F.round("total", 2).alias("total"))


@query("weekly_sliding_totals", "with e as (select ts, event_type, value, unnest(range(0, 7)) back from events) select (date_trunc('day', ts)::date - back::int)::varchar as day, event_type, count(*) as events, round(sum(value::decimal(18,4))::double, 2) as total from e group by 1, 2")
def _(v):
    out = stream.windowed_totals(v.events.withColumn("ts", F.col("ts").cast("timestamp")), "7 days", "1 day")
    return out.select(F.to_date("window_start").alias("day"), "event_type", "events", F.round("total", 2).alias("total"))
