"""Scraped listings as a stream: each batch runs the event flow and appends its results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from backline.operators.normalize import event_day
from backline.operators.pairs import with_embedding
from backline.plans.event_flow import run_event_flow
from backline.session import cut_lineage
from backline.sources.tables import table_exists

# A duplicate lies at most so many days from the event it repeats; an equal canonical key has the same day.
DAYS_APART = 2


def stream_events(source: DataFrame, tables: dict[str, DataFrame], as_of: str, out: str, checkpoint: str) -> StreamingQuery:
    """``tables``: artists, metrics, concerts, venues, demographics.

    Every batch writes its own folder, replaced on replay, so results are appended exactly once.
    Later batches resolve against the events that earlier batches created: these are stored by month with
    their embedding, and only the days around the batch's own are read.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        raw = cut_lineage(batch)
        if raw.isEmpty():
            return
        canon = created_before(spark, out, batch_id, raw)
        flow = run_event_flow(raw, tables["artists"], tables["metrics"], tables["concerts"], tables["venues"], tables["demographics"], as_of, canon)
        flow.events.write.mode("overwrite").parquet(f"{out}/events/batch={batch_id}")
        flow.predictions.write.mode("overwrite").parquet(f"{out}/predictions/batch={batch_id}")
        created = with_embedding(flow.events.where("action = 'created'").select(*CANONICAL))
        created.withColumn("month", F.date_format("event_date", "yyyyMM").cast("int")).write.mode("overwrite").partitionBy("month").parquet(f"{out}/canonical/batch={batch_id}")

    return source.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


CANONICAL = [
    "event_id", "canonical_key", "artist_name", "normalized_artist_name", "event_name", "venue_name", "normalized_venue_name", "city", "normalized_city", "country",
    "event_date", "source_platform", "source_url",
]


def created_before(spark: SparkSession, out: str, batch_id: int, raw: DataFrame) -> DataFrame | None:
    """Events that earlier batches created within two days of a day of the batch; None before the first."""
    if not table_exists(spark, f"{out}/canonical"):
        return None
    near = F.array(*[F.date_add(F.col("day"), k) for k in range(-DAYS_APART, DAYS_APART + 1)])
    days = cut_lineage(raw.select(event_day(F.col("event_date")).alias("day")).where("day is not null").distinct().select(F.explode(near).alias("event_date")).distinct())
    months = [r.m for r in days.select(F.date_format("event_date", "yyyyMM").cast("int").alias("m")).distinct().collect()]  # bounded by the calendar
    stored = spark.read.parquet(f"{out}/canonical")
    return stored.where((F.col("batch") < batch_id) & F.col("month").isin(months)).join(days, "event_date", "left_semi").drop("batch", "month")
