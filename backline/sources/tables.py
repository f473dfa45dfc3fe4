"""Upserts, appends, write-backs and the run ledger."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F, types as T

from backline.schemas import TABLES
from backline.session import cut_lineage
from backline.sources.merging import Merge, keep_newest, latest_by_key, upsert  # noqa: F401
from backline.sources.snapshots import StoredTable, by_month, month_of


def upsert_months(spark: SparkSession, path: str, delta: DataFrame, key: Sequence[str], day: str, merge: Mapping[str, Merge] | None = None) -> None:
    """Upsert into a stored table whose parts are months: only the months touched are read and written, all at once."""
    by_month(spark, path, key, day).upsert(delta.withColumn("month", month_of(day)), merge)


def read_months(spark: SparkSession, path: str, months: Sequence[str] | None = None) -> DataFrame:
    """Rows of a table stored by month, with the month as text; of the given months or all."""
    return StoredTable(spark, path, [], F.lit(None)).read(months)


def table_exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def append(df: DataFrame, path: str, run: str) -> None:
    """Add a run's rows to a log table (snapshots, predictions, validation logs, training pairs).

    The rows lie in the run's own partition, so a run that is repeated after a failure replaces them.
    """
    df.withColumn("run", F.lit(run)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run").parquet(path)


def attach_concerts(log: DataFrame, links: DataFrame) -> DataFrame:
    """Log rows whose event became a concert, with its id where they have none; ``links`` (event_id, concert_id)."""
    found = links.select("event_id", F.col("concert_id").cast(log.schema["concert_id"].dataType).alias("linked"))
    return log.join(found, "event_id", "left").withColumn("concert_id", F.coalesce("concert_id", "linked")).select(*log.columns)


def apply_updates(base: DataFrame, updates: DataFrame, key: str) -> DataFrame:
    """New values where the update has one."""
    cols = [c for c in updates.columns if c != key]
    renamed = updates.select(key, *[F.col(c).alias(f"new_{c}") for c in cols])
    joined = base.join(renamed, key, "left")
    return joined.select(*[F.coalesce(F.col(f"new_{c}"), F.col(c)).alias(c) if c in cols else F.col(c) for c in base.columns])


def saved_popularity(scores: DataFrame, limit: int | None = None) -> DataFrame:
    out = scores.orderBy(F.col("popularity_score").desc(), F.col("computed_at").desc(), "artist_id")
    return out.limit(limit) if limit else out


def saved_recent(df: DataFrame, when: str, tie: str, limit: int | None = None) -> DataFrame:
    """Newest first: capacity records by insert time, jobs by start."""
    out = df.orderBy(F.col(when).desc(), tie)
    return out.limit(limit) if limit else out


def log_job(spark: SparkSession, job_type: str, work: Callable[[], int], path: str) -> dict:
    """Run ``work`` (which returns its row count) and append one ledger row, failed runs included."""
    started, error, rows = time.time(), None, 0
    try:
        rows = work()
    except Exception as e:  # noqa: BLE001
        error = str(e).splitlines()[0][:500]
    row = {"job_id": uuid.uuid4().hex, "job_type": job_type, "status": "FAILED" if error else "COMPLETED", "records": rows,
           "seconds": time.time() - started, "error": error}
    spark.createDataFrame([row], "job_id string, job_type string, status string, records long, seconds double, error string").withColumn(
        "started_at", F.timestamp_seconds(F.lit(started))
    ).select(*TABLES["ingestion_jobs"].fieldNames()).write.mode("append").parquet(path)
    return row


def log_write(rows: DataFrame, job_type: str, write: Callable[[DataFrame], None], path: str) -> dict:
    """Run ``write(rows)`` and log it with the number of rows that it read.

    The rows are counted by an observation while the write runs, so they are not computed a second time.  ``write``
    has to run its rows in one action at first (a write, or a checkpoint that later steps read).
    """
    seen = Observation(f"{job_type}-{uuid.uuid4().hex}")

    def work() -> int:
        write(rows.observe(seen, F.count(F.lit(1)).alias("records")))
        return seen.get["records"]

    return log_job(rows.sparkSession, job_type, work, path)


def new_concert_id(kind: T.DataType, *natural: str) -> Column:
    """Id of a new row from its natural key: a digest, or a negative number where ids are numbers (given ones are positive)."""
    if isinstance(kind, T.StringType):
        return F.sha2(F.concat_ws("|", *[F.col(c).cast("string") for c in natural]), 256)
    if isinstance(kind, T.LongType):
        return -F.shiftrightunsigned(F.xxhash64(*natural), 1) - 1
    raise TypeError(f"concert_id must be text or long, not {kind.simpleString()}")


def insert_new_concerts(scraped: DataFrame, concerts: DataFrame, artists: DataFrame, as_of: str | None = None) -> DataFrame:
    """Concerts plus the scraped rows that are new: known artist, real event, not stored yet.

    ``scraped``: artist_name, event_name, venue_name, city, country, concert_date, price_min,
    price_max, currency, source, source_url.  With ``as_of`` a missing date becomes 30 days later.
    A scraped row without a venue is compared on (artist, city, date) alone.
    """
    from backline.operators import normalize
    from backline.operators.pairs import match_artist

    day = F.col("concert_date") if as_of is None else F.coalesce("concert_date", F.date_add(F.lit(as_of).cast("date"), 30))
    rows = scraped.withColumn("concert_date", day).where(F.col("concert_date").isNotNull() & (F.coalesce("artist_name", F.lit("")) != ""))
    rows = rows.where(~normalize.is_listing_page(F.coalesce("event_name", F.lit("")))).withColumn("venue", F.coalesce("venue_name", F.lit("")))
    have = concerts.select("artist_name", "city", "concert_date", F.coalesce("venue_name", F.lit("")).alias("venue"))
    key = ["artist_name", "city", "concert_date"]
    first = ["event_name", "country", "price_min", "price_max", "currency", "source", "source_url"]
    # a stored concert stands for its venue and for no venue: one join on the columns of the grouping serves both kinds of rows
    taken = have.select(*key, F.explode(F.array_distinct(F.array("venue", F.lit("")))).alias("venue"))
    fresh = rows.select(*key, "venue", *first).join(taken, [*key, "venue"], "left_anti")
    fresh = fresh.groupBy(*key, "venue").agg(F.min(F.struct(*first)).alias("r")).select(*key, "venue", "r.*")
    fresh = cut_lineage(fresh)  # read by the name match and by the join with its result
    known = match_artist(fresh.select("artist_name").distinct(), artists)
    new = fresh.join(known, "artist_name").select(
        "artist_id", "artist_name", "concert_date", F.coalesce(F.nullif("city", F.lit("")), F.lit("TBA")).alias("city"), "country",
        F.nullif("venue", F.lit("")).alias("venue_name"), F.lit(0).cast("long").alias("capacity"), F.lit(0).cast("long").alias("tickets_sold"),
        F.coalesce(normalize.avg_price(F.col("price_min"), F.col("price_max")), F.lit(0.0)).alias("avg_ticket_price"), F.lit(0.0).alias("total_revenue"),
        "currency", "source", F.lit("PENDING").alias("verification_status"),
        new_concert_id(concerts.schema["concert_id"].dataType, "artist_name", "city", "concert_date", "venue").alias("concert_id"),
    )
    return concerts.unionByName(new, allowMissingColumns=True)
