"""Stored tables: versions, failed writes, what a batch reads, and the streams on top of them."""

import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from backline.operators import series
from backline.sources import merging, snapshots, tables
from backline.sources.snapshots import StoredTable, by_month
from backline.streaming import metrics as stream

DAY = dt.date


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def frame(spark, rows, ddl="k string, g string, x long"):
    return spark.createDataFrame(rows, ddl)


def test_upserts_in_any_number(spark, tmp_path):
    table = StoredTable(spark, str(tmp_path / "t"), ["k", "g"], buckets=4)
    assert table.read() is None and table.upsert(frame(spark, [])) == 0
    first = [("a", "p", 1), ("b", None, 2), (None, None, 3), ("c", "p", 4)]
    assert table.upsert(frame(spark, first)) == 1
    table.upsert(frame(spark, first))  # a replay, nulls in the key included
    assert rows_of(table.read()) == sorted(first, key=str)
    table.upsert(frame(spark, [("b", None, "new"), ("z", "q", "new")], "k string, g string, note string"))
    want = [("a", "p", 1, None), ("b", None, 2, "new"), (None, None, 3, None), ("c", "p", 4, None), ("z", "q", None, "new")]
    assert rows_of(table.read()) == sorted(want, key=str)
    assert rows_of(table.read(version=1)) == sorted(first, key=str)


def test_failed_write_leaves_the_old_rows(spark, tmp_path):
    table = StoredTable(spark, str(tmp_path / "t"), ["k", "g"], buckets=2)
    old = [(f"k{i}", "g", i) for i in range(50)]
    table.upsert(frame(spark, old))

    def broken(new, _old):
        return F.when(new == 1040, F.raise_error(F.lit("disk full")).cast("long")).otherwise(new)

    delta = frame(spark, [(f"k{i}", "g", 1000 + i) for i in range(50)])
    with pytest.raises(Exception, match="disk full"):
        table.upsert(delta, {"x": broken})
    assert rows_of(table.read()) == sorted(old) and table.version().number == 1
    # a write that ends before its version is committed leaves files that nobody reads
    commit, table._commit = table._commit, lambda *a: (_ for _ in ()).throw(RuntimeError("lost driver"))
    with pytest.raises(RuntimeError):
        table.upsert(delta)
    assert rows_of(StoredTable(spark, str(tmp_path / "t"), ["k", "g"], buckets=2).read()) == sorted(old)
    table._commit = commit
    table.upsert(delta)
    assert {r.x for r in table.read().collect()} == set(range(1000, 1050))
    assert table.vacuum() > 0 and {r.x for r in table.read().collect()} == set(range(1000, 1050))
    assert table.read(version=1) is None


def test_two_writers_cannot_commit_one_version(spark, tmp_path):
    table = StoredTable(spark, str(tmp_path / "t"), ["k", "g"])
    table.upsert(frame(spark, [("a", "g", 1)]))
    with pytest.raises(Exception, match="ALREADY_EXISTS|already exists"):
        table._commit(1, table.version().schema, {})


def test_untouched_parts_are_not_rewritten(spark, tmp_path):
    table = by_month(spark, str(tmp_path / "t"), ["id", "date"], "date")
    ddl = "id long, date date, x long"
    table.upsert(spark.createDataFrame([(1, DAY(2024, m, 5), m) for m in range(1, 7)] + [(2, None, 0)], ddl))
    before = table.version().parts
    table.upsert(spark.createDataFrame([(1, DAY(2024, 3, 5), 30), (9, DAY(2024, 3, 6), 9)], ddl))
    after = table.version().parts
    assert {p for p in after if after[p] != before.get(p)} == {"2024-03"}
    assert {r.x for r in table.read().collect()} == {1, 2, 30, 4, 5, 6, 9, 0} and set(before) == {f"2024-0{m}" for m in range(1, 7)} | {"none"}


def test_keep_newest_does_not_depend_on_order(spark, tmp_path):
    rows = [("a", "g", x) for x in (3, 9, 1)]
    for k, order in enumerate(([0, 1, 2], [2, 1, 0], [1, 0, 2])):
        table = StoredTable(spark, str(tmp_path / f"t{k}"), ["k", "g"])
        for i in order:
            table.upsert(frame(spark, [rows[i]]).withColumn("note", F.lit(f"n{i}")), tables.keep_newest("x"))
        assert rows_of(table.read()) == [("a", "g", 9, "n1")]


# --- the ledger --------------------------------------------------------------------------------


def test_ledger_counts_what_was_written(spark, tmp_path):
    df = spark.range(1000).where("id % 3 = 0")
    runs = spark.sparkContext.accumulator(0)
    counted = df.rdd.map(lambda r: (runs.add(1), r)[1]).toDF("id long")
    row = tables.log_write(counted, "sync", lambda rows: rows.write.parquet(str(tmp_path / "out")), str(tmp_path / "jobs"))
    assert row["status"] == "COMPLETED" and row["records"] == 334 == spark.read.parquet(str(tmp_path / "out")).count()
    assert runs.value == 334  # computed once
    table = StoredTable(spark, str(tmp_path / "t"), ["id"])
    assert tables.log_write(df, "upsert", table.upsert, str(tmp_path / "jobs"))["records"] == 334 == table.read().count()
    failed = tables.log_write(df, "sync", lambda rows: rows.write.parquet(str(tmp_path / "out")), str(tmp_path / "jobs"))
    assert failed["status"] == "FAILED" and failed["records"] == 0
    assert [r.status for r in spark.read.parquet(str(tmp_path / "jobs")).orderBy("started_at").collect()] == ["COMPLETED", "COMPLETED", "FAILED"]


# --- streams -----------------------------------------------------------------------------------


def readings(spark, rows):
    """(artist, day, hour it was read, followers)"""
    full = [(a, "spotify", DAY(2024, 1, 1) + dt.timedelta(d), dt.datetime(2024, 1, 1) + dt.timedelta(hours=h), f) for a, d, h, f in rows]
    df = spark.createDataFrame(full, "artist_id long, platform string, date date, ingested_at timestamp, followers long")
    return df.withColumns({m: F.lit(0).cast("long") for m in stream.MEASURES[1:]})


def feed(spark, tmp_path, batches, **options):
    for k, batch in enumerate(batches):
        readings(spark, batch).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        src = spark.readStream.schema(readings(spark, batches[0]).schema).parquet(str(tmp_path / "in"))
        q = stream.stream_metrics(src, str(tmp_path / "out"), str(tmp_path / "ck"), **options)
        q.awaitTermination(300)
        assert q.exception() is None


def test_repeats_are_dropped_and_late_readings_put_aside(spark, tmp_path):
    seen = []
    batches = [
        [(1, 0, 10, 100), (1, 0, 10, 100), (2, 0, 10, 7)],  # one reading stands twice
        [(1, 0, 10, 100), (1, 1, 60, 110)],  # and comes again, with a newer one
        [(1, 0, 10, 100), (2, 1, 58, 8), (2, 1, 11, 5)],  # two are older than a day before the newest
    ]
    feed(spark, tmp_path, batches, drop_repeats="1 day", after=lambda delta, table: seen.append(delta.count()))
    stored = stream.metric_table(spark, str(tmp_path / "out")).read()
    assert {(r.artist_id, r.date.day, r.followers) for r in stored.collect()} == {(1, 1, 100), (2, 1, 7), (1, 2, 110), (2, 2, 8)}
    assert seen == [2, 1, 1]
    late = spark.read.parquet(str(tmp_path / "out-late"))
    assert {(r.artist_id, r.followers, r.batch) for r in late.collect()} == {(1, 100, 2), (2, 5, 2)}
    memory = StoredTable(spark, str(tmp_path / "out-seen"), ["__mark"], F.lit(None))
    assert memory.read().count() == 2 and min(memory.version().parts) >= "2024-01-02-12"  # bounded by the interval


def test_growth_reads_only_parts_around_the_batch(spark, tmp_path):
    path = str(tmp_path / "t")
    table = stream.metric_table(spark, path)
    every = readings(spark, [(a, d, 24 * d, 1000 + 10 * d + a) for a in range(40) for d in range(0, 150, 3)])
    table.upsert(stream.metric_delta(every))
    table.upsert(series.recalc_daily_growth(table.read()).select(*stream.KEY, "rog_daily"))
    late = stream.metric_delta(readings(spark, [(5, 61, 5000, 1500), (6, 61, 5000, 1501)]))  # 2 March
    table.upsert(late, stream.KEEP_NEWEST)
    near = stream.neighbours(late, table)
    read = {f.split("__part=")[1].split("/")[0] for f in near.inputFiles()}
    assert {p[:7] for p in read} == {"2024-02", "2024-03"} and len({p[8:] for p in read}) <= 2
    changed = stream.refresh_growth(late, table)
    assert {(r.artist_id, r.date) for r in changed.collect()} == {(a, d) for a in (5, 6) for d in (DAY(2024, 3, 2), DAY(2024, 3, 4))}
    table.upsert(changed)
    want = series.recalc_daily_growth(table.read().drop("rog_daily")).select(*stream.KEY, "rog_daily")
    assert rows_of(table.read().select(*stream.KEY, "rog_daily")) == rows_of(want)


def test_running_anomalies_equal_the_batch(spark, tmp_path):
    rnd = random.Random(2)
    points = []
    for artist in (1, 2, 3):
        for d in range(60):
            if rnd.random() < 0.85:
                points.append((artist, d, 100.0 + d + rnd.random() * 3 + (400 if (artist, d) in ((1, 40), (2, 25)) else 0)))
    close = [(a, 200, 0.0) for a in (1, 2, 3)]  # moves the watermark past all others
    shuffled = sorted(points, key=lambda p: p[1] + rnd.random() * 5)  # at most five days out of order
    cut = [shuffled[i : i + 30] for i in range(0, len(shuffled), 30)] + [close, [(1, 201, 0.0)]]
    ddl = "artist_id long, platform string, date date, x double"
    got = []
    for batch in cut:
        rows = [(a, "spotify", DAY(2024, 1, 1) + dt.timedelta(d), x) for a, d, x in batch + batch[:3]]  # with repeats
        spark.createDataFrame(rows, ddl).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        src = spark.readStream.schema(ddl).parquet(str(tmp_path / "in"))
        q = stream.running_anomalies(src).writeStream.outputMode("append").format("parquet").option("path", str(tmp_path / "o")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        q.awaitTermination(300)
        assert q.exception() is None
    got = {(r.artist_id, (r.date - DAY(2024, 1, 1)).days): r for r in spark.read.parquet(str(tmp_path / "o")).collect()}
    assert set(got) == {(a, d) for a, d, _ in points} and len(got) == spark.read.parquet(str(tmp_path / "o")).count()
    for artist in (1, 2, 3):
        mine = sorted((d, x) for a, d, x in points if a == artist)
        for upto in (7, 20, len(mine)):
            frame = spark.createDataFrame([(artist, "spotify", DAY(2024, 1, 1) + dt.timedelta(d), x) for d, x in mine[:upto]], ddl)
            batch, r = series.anomalies(frame).first(), got[artist, mine[upto - 1][0]]
            assert (r.points, r.anomaly) == (batch.points, batch.anomaly) and math.isclose(r.residual, batch.last_residual, abs_tol=1e-4)
    assert {k for k, r in got.items() if r.anomaly} >= {(1, 40), (2, 25)}


def test_upsert_moves_rows_once_and_divides_large_parts(spark, tmp_path, monkeypatch):
    old = frame(spark, [(f"k{i}" if i else None, None if i % 7 == 0 else "g", i) for i in range(300)])
    new = frame(spark, [(f"k{i}" if i else None, None if i % 7 == 0 else "g", f"n{i}") for i in range(0, 400, 3)], "k string, g string, note string")
    base = old.withColumn("note", F.lit(None).cast("string"))
    place = {"__part": F.pmod(F.xxhash64("k", "g"), F.lit(2)).cast("string")}
    placed = merging.upsert_placed(base, new, ["k", "g"], place)
    assert rows_of(placed.drop("__part")) == rows_of(merging.upsert(base, new, ["k", "g"]))
    assert placed._jdf.queryExecution().sparkPlan().toString().count("Join") == 0
    assert placed._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1].count("Exchange hashpartitioning") == 1
    # every part has many slots, staged deltas are gone, no row is lost or doubled
    monkeypatch.setattr(snapshots, "SLOT", 100)
    monkeypatch.setattr(snapshots, "checkpoint_dir", lambda _: str(tmp_path / "staged"))
    table = StoredTable(spark, str(tmp_path / "t"), ["k", "g"], buckets=2)
    table.upsert(old)
    table.upsert(new)
    table.upsert(new.where("k < 'k2'").withColumn("note", F.lit("last")))
    want = merging.upsert(merging.upsert(base, new, ["k", "g"]), new.where("k < 'k2'").withColumn("note", F.lit("last")), ["k", "g"])
    assert rows_of(table.read()) == rows_of(want)
    assert not any((tmp_path / "staged").iterdir())
