"""Continuous forms of the polling jobs: metric upserts, growth refresh, totals, anomalies."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState

from backline.operators import series as ts
from backline.session import cut_lineage
from backline.sources.snapshots import StoredTable, by_month, month_of

KEY = ["artist_id", "platform", "date"]
MEASURES = ["followers", "streams", "views", "likes", "comments", "shares"]


def metric_delta(batch: DataFrame) -> DataFrame:
    """One row per key: each measure's newest reading that is not zero, and when it was taken (``<measure>_at``).

    A zero or missing measure counts only while there is no other; of readings at one time the larger counts.
    The rule does not depend on the order in which readings arrive.
    """
    rows = batch.withColumn("platform", ts.canon_platform(F.col("platform")))
    best = [F.max(_reading(F.coalesce(F.col(m), F.lit(0)), F.col("ingested_at"))).alias(f"r_{m}") for m in MEASURES]
    picked = rows.groupBy(*KEY).agg(*best)
    return picked.select(*KEY, *[F.col(f"r_{m}.x").alias(m) for m in MEASURES], *[F.col(f"r_{m}.at").alias(f"{m}_at") for m in MEASURES])


def _reading(x: Column, at: Column) -> Column:
    return F.struct((x != 0).alias("some"), at.alias("at"), x.alias("x"))


def _newer(m: str) -> Column:
    new, old = (_reading(F.col(f"{row}.{m}"), F.col(f"{row}.{m}_at")) for row in ("n", "o"))
    return F.col(f"o.{m}").isNull() | F.col(f"o.{m}_at").isNull() | (new >= old)


# The same rule between a stored row and a new one.
KEEP_NEWEST = {c: (lambda new, old, m=m: F.when(_newer(m), new).otherwise(old)) for m in MEASURES for c in (m, f"{m}_at")}


def metric_table(spark: SparkSession, path: str) -> StoredTable:
    """Stored metrics: a part is a month of a sixteenth of the series."""
    return by_month(spark, path, KEY, "date", ts.SERIES, 16)


def stream_metrics(
    source: DataFrame, path: str, checkpoint: str, after: Callable[[DataFrame, StoredTable], None] | None = None, growth: bool = True, drop_repeats: str | None = None,
) -> StreamingQuery:
    """Metric stream into the stored metrics, with the daily growth of the rows that a batch changes.

    Merging is the same in any order and any number of times, so late, repeated and replayed readings need no
    watermark and none is dropped.  With ``drop_repeats`` (an interval like '2 days') readings that were already seen
    within that time are left out before the merge, and older ones go to the side table ``<path>-late`` instead
    (see ``without_repeats``).  ``after`` sees each batch's delta and the table.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        table = metric_table(spark, path)
        seen = None
        if drop_repeats:
            batch, late, seen = without_repeats(cut_lineage(batch), f"{path}-seen", drop_repeats)
            late.withColumn("batch", F.lit(batch_id)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(f"{path}-late")
        delta = cut_lineage(metric_delta(batch))
        if not delta.isEmpty():
            table.upsert(delta.withColumn("month", month_of("date")), KEEP_NEWEST)
            if growth:
                table.upsert(refresh_growth(delta, table).withColumn("month", month_of("date")))
            if after:
                after(delta, table)
        if seen:  # at last, so that a batch that fails before is merged when it runs again
            seen()

    return source.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def without_repeats(batch: DataFrame, path: str, within: str) -> tuple[DataFrame, DataFrame, Callable[[], None]]:
    """(new readings, late readings, step that remembers the batch).

    A reading repeats another if all its values are equal; one without a time is always new.  The readings of the last ``within`` before the newest reading
    seen in earlier batches are remembered by hash, in parts by the hour they were taken; that bounds the state.  What is
    older is late: it cannot be told from a repeat any more and is given back apart.
    """
    spark = batch.sparkSession
    mark = F.xxhash64(F.to_json(F.struct(*sorted(batch.columns))))
    rows = cut_lineage(batch.withColumn("__mark", mark).dropDuplicates(["__mark", "ingested_at"]))
    hour = F.date_format(F.date_trunc("hour", "ingested_at"), "yyyy-MM-dd-HH")
    memory = StoredTable(spark, path, ["__mark", "ingested_at"], hour)
    before = memory.version()
    late, fresh = rows.where("false"), rows
    if before is not None and before.parts:
        line = F.to_timestamp(F.lit(max(before.parts)), "yyyy-MM-dd-HH") - F.expr(f"interval {within}")
        is_late = F.coalesce(F.col("ingested_at") < line, F.lit(False))
        late, fresh = rows.where(is_late), rows.where(~is_late)
        known = memory.read(sorted(set(memory.parts_of(fresh)) & set(before.parts)))
        fresh = fresh.join(known, ["__mark", "ingested_at"], "left_anti")
    fresh = cut_lineage(fresh)

    def remember() -> None:
        memory.upsert(fresh.where("ingested_at is not null").select("__mark", "ingested_at"))
        now = memory.version()
        if now is None or not now.parts:
            return
        last = max(now.parts)
        least = spark.range(1).select(F.date_format(F.to_timestamp(F.lit(last), "yyyy-MM-dd-HH") - F.expr(f"interval {within}"), "yyyy-MM-dd-HH")).first()[0]
        memory.forget([p for p in now.parts if p < least])

    return fresh.drop("__mark"), late.drop("__mark"), remember


# A value more than so many days after the one before has no daily growth.
LONGEST_GAP = 7


def neighbours(delta: DataFrame, table: StoredTable) -> DataFrame:
    """Stored rows of the touched series from ``LONGEST_GAP`` days before to as many after a day of the batch.

    Only the parts that hold such rows are read.
    """
    days = delta.select(*KEY).distinct()
    reach = days.withColumn("date", F.explode(F.array(*[F.date_add("date", k) for k in (-LONGEST_GAP, 0, LONGEST_GAP)])))  # shorter than a month
    first, last = days.agg(F.date_sub(F.min("date"), LONGEST_GAP), F.date_add(F.max("date"), LONGEST_GAP)).first()
    stored = table.read(table.parts_of(reach)).where(F.col("date").between(first, last))
    return stored.join(days.select(*ts.SERIES).distinct(), ts.SERIES, "left_semi")


def refresh_growth(delta: DataFrame, table: StoredTable) -> DataFrame:
    """Daily growth of the rows a batch can change: its own days and the next row of each series.

    A late day changes its own growth and that of the following row.  Growth looks back a week at most, so the rows
    around the batch's days decide it and no other is read.
    """
    days = delta.select(*KEY, F.lit(True).alias("new")).distinct()
    grown = ts.recalc_daily_growth(neighbours(delta, table).drop("rog_daily"))
    marked = grown.join(days, KEY, "left").withColumn("prev_new", F.lag("new").over(W.partitionBy(*ts.SERIES).orderBy("date")))
    return marked.where("new or prev_new").select(*KEY, "rog_daily")


_STATE = "level double, n long, mean double, m2 double, last long, days array<long>, xs array<double>"
_FLAGS = "date date, x double, level double, residual double, points long, anomaly boolean"


def running_anomalies(stream: DataFrame, sigma: float = 3.0, alpha: float = 0.3, late: str = "7 days") -> DataFrame:
    """Every point of a stream (artist_id, platform, date, x) with its residual and anomaly flag, as ``series.anomalies``
    would give them for the series up to that day.

    A series' state is its smoothed level, the number of points and the mean and squared deviations of the residuals, beside
    the points of the last days, which wait until the watermark has passed them, so that days may arrive in any order within
    ``late``.  No history is read.  Of several values of a day the largest counts; a value later than ``late`` is dropped.
    """

    def fold(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        level, n, mean, m2, last, days, xs = state.get if state.exists else (None, 0, 0.0, 0.0, None, [], [])
        held = dict(zip(days, xs))
        for frame in frames:
            for day, x in zip(frame["day"].tolist(), frame["x"].tolist()):
                if last is None or day > last:
                    held[day] = max(x, held.get(day, x))
        passed = state.getCurrentWatermarkMs() // 86_400_000
        out = []
        for day in sorted(d for d in held if d < passed):
            x = held.pop(day)
            level = x if level is None else alpha * x + (1 - alpha) * level
            residual = x - level
            n += 1
            step = residual - mean
            mean += step / n
            m2 += step * (residual - mean)
            std = (m2 / max(n - 1, 1)) ** 0.5
            out.append((day, x, level, residual, n, bool(n >= 7 and std > 0 and abs(residual) / std > sigma)))
            last = day
        days = sorted(held)
        state.update((level, n, mean, m2, last, days, [held[d] for d in days]))
        if days:  # called again once the watermark has passed the first waiting day
            state.setTimeoutTimestamp(max((days[0] + 1) * 86_400_000, state.getCurrentWatermarkMs() + 1))
        if out:
            rows = pd.DataFrame(out, columns=["day", "x", "level", "residual", "points", "anomaly"])
            rows.insert(0, "date", pd.to_datetime(rows.pop("day"), unit="D").dt.date)
            rows.insert(0, "platform", key[1])
            rows.insert(0, "artist_id", key[0])
            yield rows

    key = stream.schema["artist_id"].dataType.simpleString()
    dated = stream.where("date is not null and x is not null").withColumn("at", F.col("date").cast("timestamp")).withWatermark("at", late)
    days = dated.select("artist_id", "platform", "at", F.unix_date("date").cast("long").alias("day"), "x")
    return days.groupBy("artist_id", "platform").applyInPandasWithState(fold, f"artist_id {key}, platform string, {_FLAGS}", _STATE, "append", "EventTimeTimeout")


def windowed_totals(events: DataFrame, size: str = "1 day", slide: str | None = None, late: str = "1 day") -> DataFrame:
    """Event count and value per type and event-time window, tumbling or sliding.

    The value is summed as a decimal, so the result does not depend on arrival order.
    """
    w = F.window("ts", size, slide) if slide else F.window("ts", size)
    return (
        events.withWatermark("ts", late).groupBy(w.alias("w"), "event_type")
        .agg(F.count(F.lit(1)).alias("events"), F.sum(F.col("value").cast("decimal(18,4)")).alias("total"))
        .select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "event_type", "events", F.col("total").cast("double").alias("total"))
    )
