"""Stored tables by key: every query writes a table twice or more and reads it back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from backline.operators import capacity, popularity, reports
from backline.schemas import KEYS, TABLES
from backline.session import checkpoint_dir
from backline.sources.imports import read_table
from backline.sources.merging import latest_by_key
from backline.sources.snapshots import StoredTable
from backline.sources.tables import keep_newest, saved_popularity
from catalog.base import even, query
from catalog.metrics import _POP
from catalog.venues import _NAMES, _TIERED, _estimate, _known, _names, _simple, _tiered


def _table(v, name: str, buckets: int = 8) -> StoredTable:
    return StoredTable(v.spark, f"{checkpoint_dir(v.spark)}/{name}-{uuid.uuid4().hex}", KEYS[name], buckets=buckets)


# The venue table, then what the concerts say about each venue: known ones keep their other columns.
@query("stored_venues", f"""with old as (select venue_name, city, country, min(venue_id) as venue_id, max(capacity_max) as capacity_max, max(avg_capacity) as avg_capacity, bool_or(verified) as verified from dv_venues group by 1, 2, 3),
  new as (select venue_name, city, country, {even('avg(capacity)')}::bigint as avg_capacity, count(*) >= 3 as verified from dv_concerts where venue_name is not null and capacity > 0 group by 1, 2, 3)
  select coalesce(old.venue_name, new.venue_name) as venue_name, coalesce(old.city, new.city) as city, coalesce(old.country, new.country) as country, venue_id, capacity_max,
   case when new.venue_name is null then old.avg_capacity else new.avg_capacity end as avg_capacity, case when new.venue_name is null then old.verified else new.verified end as verified
  from old full join new on old.venue_name = new.venue_name and old.city is not distinct from new.city and old.country is not distinct from new.country""")
def _(v):
    key = KEYS["venues"]
    table = _table(v, "venues")
    table.upsert(v.venues.groupBy(*key).agg(F.min("venue_id").alias("venue_id"), F.max("capacity_max").alias("capacity_max"), F.max("avg_capacity").cast("long").alias("avg_capacity"), F.bool_or("verified").alias("verified")))
    rollup = reports.venue_capacity_rollup(v.concerts).select(*key, F.col("avg_capacity").cast("long").alias("avg_capacity"), "verified")
    table.upsert(rollup)
    table.upsert(rollup)
    return table.read()


# Capacity records by normalised place: estimates first, verified capacities laid over them.
_PLACE = ", ".join(f"{_simple(f'coalesce({c}, chr(0))')} as normalized_{n}" for c, n in (("name", "venue_name"), ("city", "city"), ("country", "country")))


@query("stored_capacity", f"""with {_NAMES}, {_TIERED}, {_estimate('vin')}, {_known('nm')},
  old as (select {_PLACE}, min(ecap) as capacity from est group by all),
  new as (select {_PLACE}, max(known) as known from nm join listed using (name, city) where known is not null group by all)
  select normalized_venue_name, normalized_city, normalized_country, coalesce(known, capacity)::bigint as capacity, case when known is null then 'heuristic' else 'known_venues_db' end as source
  from old full join new using (normalized_venue_name, normalized_city, normalized_country)""")
def _(v):
    place = [capacity.simple_name(F.col(c)).alias(f"normalized_{c}") for c in ("venue_name", "city", "country")]
    table = _table(v, "venue_capacity_records")
    estimated = capacity.estimate_capacity(_tiered(v))
    table.upsert(estimated.groupBy(*place).agg(F.min("capacity").cast("long").alias("capacity")).withColumn("source", F.lit("heuristic")))
    known = capacity.with_known_capacity(_names(v)).where("known_capacity is not null")
    table.upsert(known.groupBy(*place).agg(F.max("known_capacity").cast("long").alias("capacity")).withColumn("source", F.lit("known_venues_db")))
    return table.read()


# Popularity by artist, saved twice: a day's scores, then newer ones for every second artist; read best first.
@query("stored_popularity", f"with {_POP} select artist_id, case when artist_id % 2 = 0 then 100 - popularity_score else popularity_score end as popularity_score, case when artist_id % 2 = 0 then '2024-01-02' else '2024-01-01' end as day from pop")
def _(v):
    table = _table(v, "artist_popularity_scores")
    day = lambda d: F.lit(f"2024-01-0{d} 00:00:00").cast("timestamp").alias("computed_at")
    scores = popularity.popularity_all(v.artists).select("artist_id", F.col("popularity_score").cast("double").alias("popularity_score"))
    newer = scores.where("artist_id % 2 = 0").select("artist_id", (100 - F.col("popularity_score")).alias("popularity_score"), day(2))
    table.upsert(scores.select("*", day(1)), keep_newest("computed_at"))
    table.upsert(newer, keep_newest("computed_at"))
    table.upsert(scores.select("*", day(1)), keep_newest("computed_at"))  # an older run must not win
    return saved_popularity(table.read()).select("artist_id", "popularity_score", F.to_date("computed_at").alias("day"))


# References by source key: every second listing first, then all with a higher confidence.
@query("stored_references", """select coalesce(source_platform, '') || '|' || source_event_id as source_event_key, source_event_id, source_url, case when ascii(right(source_event_id, 1)) % 2 = 0 then 0.6 else 0.9 end::double as confidence
  from (select source_platform, source_event_id, max(source_url) as source_url from dv_raw group by 1, 2)""")
def _(v):
    table = _table(v, "source_event_references")
    rows = v.raw.groupBy("source_platform", "source_event_id").agg(F.max("source_url").alias("source_url"))
    rows = rows.select(F.concat_ws("|", F.coalesce("source_platform", F.lit("")), "source_event_id").alias("source_event_key"), "source_event_id", "source_url")
    odd = F.ascii(F.right("source_event_id", F.lit(1))) % 2 != 0
    table.upsert(rows.where(~odd).withColumn("confidence", F.lit(0.6)))
    table.upsert(rows.where(odd).withColumn("confidence", F.lit(0.9)))
    # a delta without the url keeps it
    table.upsert(rows.where(odd).select("source_event_key", F.lit(0.9).alias("confidence")))
    return table.read()


# Predictions by (concert, model version), stored in two halves with the newer half first: the newest row stands.
@query("stored_predictions", """with r as (select *, row_number() over (partition by concert_id, model_version order by created_at desc, prediction_id desc, expected_revenue desc) rn from dv_predictions)
  select concert_id, model_version, created_at::varchar as created_at, prediction_id, expected_revenue from r where rn = 1""")
def _(v):
    key = KEYS["prediction_outputs"]
    table = _table(v, "prediction_outputs")
    rows = v.predictions.select(*key, "created_at", "prediction_id", "expected_revenue")
    order = ["created_at", "prediction_id", "expected_revenue"]
    late = F.pmod(F.xxhash64("prediction_id"), F.lit(2)) == 1
    for part in (rows.where(late), rows.where(~late), rows):
        table.upsert(latest_by_key(part, key, order), keep_newest(*order))
    return table.read().select("concert_id", "model_version", "created_at", "prediction_id", "expected_revenue")


# The concert table written with its declared types and read back typed: filter and columns reach the files.
@query("table_scan_typed", """select concert_id::varchar as concert_id, city, capacity::int as capacity, total_revenue::decimal(14,2)::double as total_revenue from dv_concerts where capacity > 1000""")
def _(v):
    path = f"{checkpoint_dir(v.spark)}/concerts-{uuid.uuid4().hex}"
    rows = v.concerts
    typed = [(F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in TABLES["concerts"].fields]
    rows.select(*typed).write.parquet(path)
    return read_table(v.spark, "concerts", path).where("capacity > 1000").select("concert_id", "city", "capacity", "total_revenue")
