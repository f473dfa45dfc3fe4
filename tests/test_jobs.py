"""Streams, model, plans and the registry."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from backline.binding import Views
from backline.operators import revenue, series
from backline.sources import imports, tables
from backline.streaming import listings as stream_listings, metrics as stream

SF = "/root/testdata/sf0.001"


def test_registry():
    q, o = entry.queries(), entry.oracle_sql()
    assert set(o) <= set(q) and len(q) > 180


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def _readings(spark):
    """Readings of one series over three days: repeats, a zero that comes later, and an older value."""
    at = lambda d, h: dt.datetime(2024, 1, d, h)
    rows = [
        (1, "spotify", dt.date(2024, 1, 30), at(30, 12), 100, 5), (1, "spotify", dt.date(2024, 1, 30), at(30, 20), 0, 6), (1, "spotify", dt.date(2024, 1, 30), at(30, 8), 90, 9),
        (1, "spotify", dt.date(2024, 1, 30), at(30, 22), 200, 0), (1, "spotify", dt.date(2024, 1, 31), at(31, 12), 210, 1), (1, "spotify", dt.date(2024, 1, 31), at(31, 12), 210, 1),
        (1, "spotify", dt.date(2024, 2, 1), at(1, 1), 0, 0), (2, "youtube", dt.date(2024, 2, 1), at(2, 1), 7, None),
    ]
    df = spark.createDataFrame(rows, "artist_id long, platform string, date date, ingested_at timestamp, followers long, streams long")
    return [df.where(F.col("ingested_at") == r[3]).withColumns({m: F.lit(0).cast("long") for m in ("views", "likes", "comments", "shares")}) for r in rows]


@pytest.mark.parametrize("order", [1, -1])
def test_metric_batches_in_any_order_equal_one_batch(spark, tmp_path, order):
    batches = _readings(spark)
    path = str(tmp_path / "t")
    for batch in batches[::order]:
        tables.upsert_months(spark, path, stream.metric_delta(batch), stream.KEY, "date", stream.KEEP_NEWEST)
    every = batches[0]
    for batch in batches[1:]:
        every = every.unionByName(batch)
    columns = [*stream.KEY, *stream.MEASURES]
    want = {tuple(r) for r in stream.metric_delta(every).select(columns).collect()}
    got = {tuple(r) for r in tables.read_months(spark, path).select(columns).collect()}
    assert got == want
    assert {(r[0], r[2].day, r[3], r[4]) for r in want} == {(1, 30, 200, 6), (1, 31, 210, 1), (1, 1, 0, 0), (2, 1, 7, 0)}


def test_narrow_delta_keeps_the_other_columns(spark, tmp_path):
    path = str(tmp_path / "t")
    full = stream.metric_delta(_readings(spark)[0])
    tables.upsert_months(spark, path, full, stream.KEY, "date", stream.KEEP_NEWEST)
    tables.upsert_months(spark, path, full.select(*stream.KEY).withColumn("rog_daily", F.lit(2.5)), stream.KEY, "date")
    tables.upsert_months(spark, path, full, stream.KEY, "date", stream.KEEP_NEWEST)  # a replay
    [row] = tables.read_months(spark, path).collect()
    assert (row.followers, row.streams, row.rog_daily, row.month) == (100, 5, 2.5, "2024-01")


def test_metric_stream_equals_batch_and_writes_growth(spark, tmp_path):
    pm = Views(spark, SF).metrics.select("artist_id", "platform", "date", *stream.MEASURES).where("artist_id < 40")
    feed = pm.withColumn("ingested_at", F.timestamp_seconds(F.unix_date("date") * 86400))
    feed.unionByName(feed).repartition(3).write.parquet(str(tmp_path / "in"))
    late = feed.where("date = date '2024-01-10'").withColumn("followers", F.col("followers") + 1).withColumn("ingested_at", F.col("ingested_at") + F.expr("interval 9 hours"))
    late.write.mode("append").parquet(str(tmp_path / "in"))
    src = spark.readStream.schema(feed.schema).option("maxFilesPerTrigger", 2).parquet(str(tmp_path / "in"))
    seen = []
    q = stream.stream_metrics(src, str(tmp_path / "out"), str(tmp_path / "ck"), lambda d, t: seen.append(t.version().number))
    q.awaitTermination(300)
    assert q.exception() is None and seen
    stored = tables.read_months(spark, str(tmp_path / "out"))
    columns = [*stream.KEY, *stream.MEASURES]
    want = {tuple(r) for r in stream.metric_delta(feed.unionByName(late)).select(columns).collect()}
    assert {tuple(r) for r in stored.select(columns).collect()} == want
    grown = series.recalc_daily_growth(stored.drop("rog_daily")).select(*stream.KEY, "rog_daily")
    assert {tuple(r) for r in stored.select(*stream.KEY, "rog_daily").collect()} == {tuple(r) for r in grown.collect()}


def test_windowed_totals_stream(spark, tmp_path):
    ev = Views(spark, SF).events.withColumn("ts", F.col("ts").cast("timestamp"))
    ev.write.parquet(str(tmp_path / "ev"))
    src = spark.readStream.schema(ev.schema).parquet(str(tmp_path / "ev"))
    q = stream.windowed_totals(src).writeStream.outputMode("append").format("parquet").option("path", str(tmp_path / "o")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {tuple(r) for r in spark.read.parquet(str(tmp_path / "o")).collect()}
    batch = stream.windowed_totals(ev).collect()
    closed = max(r.window_end for r in batch) - dt.timedelta(days=2)
    assert {tuple(r) for r in batch if r.window_end <= closed} <= got <= {tuple(r) for r in batch}


def test_listing_batches_equal_one_batch(spark, tmp_path):
    v = Views(spark, SF)
    raw = v.raw.where("artist_id in (1, 2)").drop("artist_id", "show_date")
    t = {"artists": v.artists, "metrics": v.metrics, "concerts": v.concerts, "venues": v.venues, "demographics": v.demographics}
    half = F.pmod(F.xxhash64("source_event_id"), F.lit(2))
    out = {}
    for name, parts in (("one", [raw]), ("two", [raw.where(half == 0), raw.where(half == 1)])):
        for k, part in enumerate(parts):  # the second file arrives after the first batch
            part.coalesce(1).write.mode("append").parquet(str(tmp_path / name))
            src = spark.readStream.schema(raw.schema).parquet(str(tmp_path / name))
            q = stream_listings.stream_events(src, t, "2000-01-01", str(tmp_path / name / "_o"), str(tmp_path / name / "_c"))
            q.awaitTermination(300)
            assert q.exception() is None
        out[name] = spark.read.parquet(str(tmp_path / name / "_o/events"))
    assert out["one"].where("status is null").count() == 0
    keys = {n: {r[0] for r in df.select("canonical_key").distinct().collect()} for n, df in out.items()}
    assert keys["one"] == keys["two"] and out["one"].count() == out["two"].count()
    # an event that repeats a key of an earlier batch is not created again
    created = out["two"].where("action = 'created'").groupBy("canonical_key").count()
    assert created.where("count > 1").count() == 0
    plan = stream_listings.created_before(spark, str(tmp_path / "two/_o"), 1, raw.limit(3))._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(batch" in plan and "month" in plan.split("PartitionFilters: [")[1].split("]")[0]


def test_packed_rows_leave_no_shuffles(spark):
    """Rows of every kind come back as they were, from Parquet; the shuffle that made them is gone at once."""
    from backline.session import _DROP_SHUFFLES, cut_packed

    def shuffled():
        return str(spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString(",")).count("shuffle_")

    rows = [(k, None if k == 3 else f"v{k}", dt.date(2024, 1, k), {"a": k / 2}, [k, None]) for k in range(1, 6)]
    df = spark.createDataFrame(rows, "k long, v string, d date, m map<string,double>, a array<int>").repartition(3, "k")
    before, conf = shuffled(), spark.conf.get(_DROP_SHUFFLES)
    packed = cut_packed(df)
    assert shuffled() == before and spark.conf.get(_DROP_SHUFFLES) == conf
    assert sorted(map(tuple, packed.collect()), key=str) == sorted(rows, key=str) and packed.schema == df.schema
    assert "FileScan parquet" in packed._jdf.queryExecution().executedPlan().toString()


def test_the_flow_keeps_its_events_packed(spark):
    from backline.plans import event_flow

    v = Views(spark, SF)
    raw = v.raw.where("artist_id in (1, 2)").drop("artist_id", "show_date")
    flow = event_flow.run_event_flow(raw, v.artists, v.metrics, v.concerts, v.venues, v.demographics, "2000-01-01")
    for df in (flow.events, flow.predictions):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "FileScan parquet" in plan and "ExistingRDD" not in plan
    summary = flow.summary.first()
    assert summary.normalized == flow.events.count() > 0 and summary.created + summary.duplicates + summary.updated == summary.normalized


def test_model_stages_and_blend(spark, tmp_path):
    v = Views(spark, SF)
    frame = revenue.training_frame(v.concerts, v.metrics_long, v.artists, "2001-08-01").cache()
    model = revenue.retrain_if_ready(frame, str(tmp_path / "m"))
    assert len(model.stages[-1].trees) == revenue.SETTINGS[0]
    scored = revenue.score_concerts(revenue.load_model(str(tmp_path / "m")), frame).cache()
    assert scored.where("abs(prediction - last_stage) > 1e-6 * abs(prediction)").count() == 0
    assert scored.where("lower_bound > predicted_revenue or upper_bound < predicted_revenue").count() == 0
    assert scored.where("confidence not between 0.1 and 0.95").count() == 0
    assert sum(x for _, x in revenue.importances(model, 100)) == pytest.approx(1.0, abs=0.01)
    assert revenue.retrain_if_ready(frame.limit(9), str(tmp_path / "n")) is None
    assert revenue.evaluate(model.transform(frame)).first().mae > 0
    assert revenue.by_size(29) == (100, 3, 2) and revenue.by_size(99) == (200, 4, 3) and revenue.by_size(100) == revenue.SETTINGS


def test_cross_validate_fits_the_stored_models_settings(spark, monkeypatch):
    """The query fits every fold with as many trees as the stored model; the folds' rows and order stay."""
    from catalog import models

    rows = [(i, 1, *[float(i % (k + 3)) for k in range(len(revenue.NUMERIC))], *[f"c{i % 3}"] * len(revenue.CATEGORICAL), 100.0 * (i % 9)) for i in range(60)]
    columns = ["concert_id long", "artist_id long", *[f"{c} double" for c in revenue.NUMERIC], *[f"{c} string" for c in revenue.CATEGORICAL], "actual_revenue double"]
    frame = spark.createDataFrame(rows, ", ".join(columns))
    fits, train = [], revenue.train_revenue

    def few(rest, trees, depth, leaf):
        fits.append((trees, depth, leaf, rest.count()))
        return train(rest, 2, 2, 1)

    monkeypatch.setattr(revenue, "train_revenue", few)
    monkeypatch.setattr(models, "_frame", lambda v: frame)
    got = {r.fold: r.rows for r in entry.queries()["cross_validate"](spark, SF).collect()}
    assert len(fits) == 5 and {f[:3] for f in fits} == {revenue.SETTINGS}
    assert got[None] == 60 and sorted(60 - f[3] for f in fits) == sorted(n for k, n in got.items() if k is not None)


def test_ledger_and_csv(spark, tmp_path):
    path = str(tmp_path / "jobs")
    assert tables.log_job(spark, "sync", lambda: 7, path)["status"] == "COMPLETED"
    assert tables.log_job(spark, "sync", lambda: 1 // 0, path)["status"] == "FAILED"
    assert spark.read.parquet(path).count() == 2
    (tmp_path / "t.csv").write_text("venue_capacity,avg_ticket_price,price_range,max_revenue_naive,is_weekend,month,demand_score,best_rog_30d,cross_platform_score,season,city,country,artist_tier,actual_revenue\n5000,10,5,50000,1,7,50,1,50,summer,Pune,India,mid,40000\n")
    assert imports.read_training_csv(spark, str(tmp_path / "t.csv")).first().actual_revenue == 40000.0


def test_plans_keep_rules(spark):
    """Filters and columns reach the scan; no cartesian or nested-loop join in the core joins."""
    v = Views(spark, SF)
    plan = series.growth_windows(series.primary_metric(v.metrics_long))._jdf.queryExecution().executedPlan().toString()
    assert "l_extendedprice" not in plan and "NestedLoop" not in plan and "Cartesian" not in plan
    for name in ("demand_scores", "match_existing", "venue_lookup", "city_profitability", "enrich_venues"):
        plan = entry.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan, name


def test_summary_needs_four_days_of_a_made_history(spark):
    from backline.operators import revenue

    seeds = [0, 1, 7, 49, 130, 999, 10_001, 100_003, 540_000, 2_170_000, 3_000_001]
    rows = [(i, True, s, seeds[-1 - i], None, s * 3, 1) for i, s in enumerate(seeds)] + [(50, True, None, 0, None, None, 0), (51, False, 5, 5, 5, 5, 5)]
    artists = spark.createDataFrame(rows, "artist_id long, active boolean, spotify_listeners long, youtube_subscribers long, instagram_followers long, facebook_followers long, twitter_followers long")
    ddl = "artist_id long, platform string, date date, followers long, streams long, views long, likes long, comments long, shares long"
    none = spark.createDataFrame([], ddl)
    made = revenue.training_metrics(none, artists, "2024-03-01", revenue.SUMMARY_DAYS)
    assert made.groupBy("artist_id", "platform").count().agg({"count": "max"}).first()[0] == 4
    got = {tuple(r) for r in revenue.artist_summary(made).collect()}
    assert got == {tuple(r) for r in revenue.artist_summary(revenue.training_metrics(none, artists, "2024-03-01")).collect()} and len(got) == 12


def test_growth_report_agrees_with_its_parts(spark):
    pm = Views(spark, SF).metrics_long
    report = series.growth_report(pm, with_breakpoints=False)
    flat = report.select("artist_id", F.explode("platforms").alias("p")).select("artist_id", "p.platform", "p.rog_30d", "p.forecast_30d", "p.anomaly")
    s = series.primary_metric(pm)
    parts = series.growth_windows(s).where("points >= 3").join(series.forecast(s), ["artist_id", "platform"]).join(series.anomalies(s).drop("points"), ["artist_id", "platform"])
    want = parts.select("artist_id", "platform", "rog_30d", "forecast_30d", "anomaly")
    assert {tuple(r) for r in flat.collect()} == {tuple(r) for r in want.collect()}


def test_nightly_leaves_no_gaps(spark):
    from backline.plans.nightly import run_daily

    v = Views(spark, SF)
    out = run_daily(v.artists, v.metrics_long, v.concerts, "2001-08-01")["concerts"].cache()
    assert out.select("concert_id").distinct().count() == out.count() <= v.concerts.count()
    assert out.where("capacity > 0 and tickets_sold > capacity").count() == 0
    assert out.where("capacity > 0 and coalesce(tickets_sold, 0) = 0 and coalesce(total_revenue, 0) = 0").count() == 0


def test_new_concerts_survive_two_nights(spark):
    from backline.operators import pairs
    from backline.plans.nightly import run_daily

    v = Views(spark, SF)
    some = v.concerts.where("artist_id < 30")
    shows = [("Customer#000000001", "show", "Hall", "Pune", dt.date(2030, 1, k)) for k in range(1, 28, 6)]
    scraped = spark.createDataFrame([(*s, "India", 100.0, 200.0, "INR", "songkick", "") for s in shows],
        "artist_name string, event_name string, venue_name string, city string, concert_date date, country string, price_min double, price_max double, currency string, source string, source_url string")
    first = run_daily(v.artists, v.metrics_long, some, "2001-08-01", scraped, venues=v.venues)["concerts"]
    again = run_daily(v.artists, v.metrics_long, first, "2001-08-02", scraped, venues=v.venues)["concerts"]
    for out in (first, again):
        new = out.where("concert_date >= date '2030-01-01'").collect()
        assert len(new) == len(shows) and len({r.concert_id for r in new}) == len(shows)
    lone = some.limit(5).withColumn("concert_id", F.lit(None).cast("long"))
    assert pairs.dedup_concerts(lone).count() == 5


def test_event_flow_is_stored_once(spark, tmp_path):
    from backline.plans import event_flow as flow

    v = Views(spark, SF)
    raw = v.raw.where("artist_id < 12")
    f = flow.run_event_flow(raw, v.artists, v.metrics, v.concerts, v.venues, v.demographics, "2001-08-01")
    for _ in range(2):
        flow.store_event_flow(f, str(tmp_path), "night 1")
    flow.store_event_flow(f, str(tmp_path), "night 2")
    read = {t: spark.read.parquet(str(tmp_path / t)) for t in flow.STORED}
    one = {t: df.where("run = 'night 1'") for t, df in read.items()}
    assert all(df.count() == 2 * one[t].count() for t, df in read.items())
    canon = one["canonical_events"]
    assert canon.count() == f.events.select("canonical_key").distinct().count()
    merged = canon.where("validation_status = 'DUPLICATE'").count()
    assert merged > 0 and one["duplicate_group_members"].where("role = 'DUPLICATE'").count() == merged
    assert one["duplicate_group_members"].where("role = 'DUPLICATE' and (similarity_score < 0.86 or size(reasons) = 0)").count() == 0
    assert one["source_references"].select("target", "source_key").distinct().count() == one["source_references"].count() >= canon.count()
    assert one["validation_logs"].count() == f.events.count()
    done = f.summary.first()
    assert done.predicted == one["prediction_outputs"].where("expected_revenue is not null").count() > 0
    links = canon.where("event_id = target").select("event_id").limit(3).withColumn("concert_id", F.lit("c7"))
    logs = one["prediction_outputs"].drop("run")
    assert tables.attach_concerts(tables.attach_concerts(logs, links), links).where("concert_id = 'c7'").count() == logs.join(links.select("event_id"), "event_id").count()


def test_rates_by_date(spark):
    from backline.operators import money

    rates = spark.createDataFrame([("USD", 80.0, "a", "2024-01-01"), ("USD", 90.0, "b", "2024-06-01")], "currency string, rate_to_inr double, source string, as_of string")
    sales = spark.createDataFrame([(1, 10.0, "usd", dt.date(2024, 3, 1)), (2, 10.0, "USD", dt.date(2024, 7, 1)), (3, 10.0, "USD", dt.date(2023, 1, 1)), (4, 1.0, "XYZ", None)], "id int, amount double, currency string, day date")
    got = {r.id: r.converted for r in money.convert(sales, rates, "amount", "currency", day="day").collect()}
    assert got == {1: 800.0, 2: 900.0, 3: None, 4: None}
    assert {r.id: r.converted for r in money.convert(sales, rates, "amount", "currency").collect()}[1] == 900.0
