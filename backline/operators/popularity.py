"""Entropy-weighted popularity over artist snapshots and metric series.

With z = ln(1+x), column total S and T = sum(z ln z), the entropy of the shares z/S is
ln S - T/S, so one aggregation with map-side partials gives every weight.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, Window as W

from backline.functions.refdata import SNAPSHOT_COLUMNS
from backline.functions.rounding import clamp, half_even, half_up
from backline.operators import series as ts

FOUR = ["spotify", "youtube", "instagram", "facebook"]
FIVE = [*FOUR, "twitter"]


def _z(c: str) -> Column:
    return F.log1p(F.greatest(F.coalesce(F.col(c), F.lit(0)), F.lit(0)).cast("double"))


def _diversity(s: Column, t: Column, n: Column) -> Column:
    """1 minus the normalised entropy, floored at 0; 0 for an empty column or one row."""
    ok = (s > 0) & (n > 1)
    e = (F.ln(F.when(ok, s)) - t / F.when(ok, s)) / F.ln(F.when(ok, n.cast("double")))
    return F.when(ok, F.greatest(F.lit(0.0), F.lit(1.0) - e)).otherwise(F.lit(0.0))


def model(artists: DataFrame, platforms: list[str], floor: float | None = None) -> DataFrame:
    """One row: weight and largest log reach per platform over the given artists."""
    aggs = [F.count(F.lit(1)).alias("n")]
    for p in platforms:
        z = _z(SNAPSHOT_COLUMNS[p])
        aggs += [F.sum(z).alias(f"s_{p}"), F.sum(F.when(z > 0, z * F.ln(z))).alias(f"t_{p}"), F.max(z).alias(f"max_{p}")]
    df = artists.agg(*aggs)
    for p in platforms:
        df = df.withColumn(f"d_{p}", _diversity(F.col(f"s_{p}"), F.coalesce(f"t_{p}", F.lit(0.0)), F.col("n")))
    total = sum((F.col(f"d_{p}") for p in platforms[1:]), F.col(f"d_{platforms[0]}"))
    df = df.withColumn("d", total)
    for p in platforms:
        df = df.withColumn(f"w_{p}", F.when(F.col("d") > 0, F.col(f"d_{p}") / F.when(F.col("d") > 0, F.col("d"))).otherwise(F.lit(1.0 / len(platforms))))
    if floor is not None:
        df = _lift(df, "spotify", platforms, floor)
    return df.select("n", *[f"w_{p}" for p in platforms], *[f"max_{p}" for p in platforms])


def _lift(df: DataFrame, key: str, platforms: list[str], floor: float) -> DataFrame:
    """Raise one weight to the floor, take the deficit from the others in proportion, renormalise.

    Equal weights, used when no column tells artists apart, are left as they are.
    """
    lead, others = F.col(f"w_{key}"), [p for p in platforms if p != key]
    low = (F.col("d") > 0) & (lead < floor)
    rest = sum((F.col(f"w_{p}") for p in others[1:]), F.col(f"w_{others[0]}"))
    df = df.withColumn("short", F.when(low, F.lit(floor) - lead).otherwise(F.lit(0.0))).withColumn("rest", rest)
    for p in others:
        w = F.col(f"w_{p}")
        df = df.withColumn(f"w_{p}", F.when(F.col("rest") > 0, w - F.col("short") * (w / F.when(F.col("rest") > 0, F.col("rest")))).otherwise(w))
    df = df.withColumn(f"w_{key}", F.when(low, F.lit(floor)).otherwise(lead))
    total = sum((F.col(f"w_{p}") for p in platforms[1:]), F.col(f"w_{platforms[0]}"))
    df = df.withColumn("total", total)
    for p in platforms:
        df = df.withColumn(f"w_{p}", F.col(f"w_{p}") / F.col("total"))
    return df


def entropy_weights(artists: DataFrame, platforms: list[str] = FOUR, floor: float | None = None) -> DataFrame:
    """Weights as rows (platform, weight)."""
    stack = ", ".join(f"'{p}', w_{p}" for p in platforms)
    return model(artists, platforms, floor).selectExpr(f"stack({len(platforms)}, {stack}) as (platform, weight)")


def _with_model(artists: DataFrame, m: DataFrame) -> DataFrame:
    """Attach the one-row model; its size is one row whatever the input."""
    return artists.withColumn("one", F.lit(1)).join(F.broadcast(m.withColumn("one", F.lit(1))), "one").drop("one")


def _part(p: str) -> Column:
    z, top = _z(SNAPSHOT_COLUMNS[p]), F.col(f"max_{p}")
    return F.coalesce(z / F.when(top > 0, top), F.lit(0.0)) * F.col(f"w_{p}")


def popularity_all(artists: DataFrame, floor: float = 0.40) -> DataFrame:
    """Score of every active artist over four platforms, parts rounded to four digits first."""
    active = artists.where("active")
    df = _with_model(active, model(active, FOUR, floor))
    parts = {p: half_even(_part(p), 4) for p in FOUR}
    df = df.select("artist_id", *[parts[p].alias(f"c_{p}") for p in FOUR], *[half_even(F.col(f"w_{p}"), 4).alias(f"r_{p}") for p in FOUR])
    total = sum((F.col(f"c_{p}") for p in FOUR[1:]), F.col("c_spotify"))
    as_map = lambda k: F.create_map(*[x for p in FOUR for x in (F.lit(p), F.col(f"{k}_{p}"))])
    return df.select(
        "artist_id", half_even(clamp(F.lit(5.0) + F.lit(95.0) * total, 0, 100), 2).alias("popularity_score"),
        as_map("r").alias("platform_weights"), as_map("c").alias("platform_contributions"),
    )


def popularity_service(artists: DataFrame, fallback: float = 45.0) -> DataFrame:
    """Score over five platforms without a floor; artists with no reach get the fallback."""
    df = _with_model(artists, model(artists.where("active"), FIVE))
    total = sum((_part(p) for p in FIVE[1:]), _part("spotify"))
    reach = F.greatest(*[F.coalesce(F.col(SNAPSHOT_COLUMNS[p]), F.lit(0)) for p in FIVE]) > 0
    score = half_up(clamp(F.lit(5.0) + total * 95.0, 5, 100), 2)
    return df.select("artist_id", F.when(reach, score).otherwise(F.lit(fallback)).alias("popularity"))


def popularity_series(metrics: DataFrame, floor: float = 0.40) -> DataFrame:
    """Score from each artist's own history.

    A day without a platform counts as 0, which adds nothing to S or T, so only the number of
    days matters and no date-by-platform grid is built.
    """
    z = F.log1p(F.greatest("x", F.lit(0.0)))
    s = ts.primary_metric(metrics)
    per = s.groupBy("artist_id", "platform").agg(
        F.sum(z).alias("s"), F.coalesce(F.sum(F.when(z > 0, z * F.ln(z))), F.lit(0.0)).alias("t"), F.max(z).alias("top"),
        F.max("date").alias("day"), F.max_by(z, "date").alias("z_last"),
    )
    days = s.groupBy("artist_id").agg(F.count_distinct("date").alias("n"), F.max("date").alias("last_day"))
    w = W.partitionBy("artist_id")  # at most one row per platform
    df = per.join(days, "artist_id").withColumn("d", _diversity(F.col("s"), F.col("t"), F.col("n")))
    df = df.withColumn("total", F.sum("d").over(w)).withColumn("m", F.count(F.lit(1)).over(w))
    df = df.withColumn("w0", F.when(F.col("total") > 0, F.col("d") / F.when(F.col("total") > 0, F.col("total"))).otherwise(F.lit(1.0) / F.col("m")))
    lead = F.col("platform").contains("spotify")
    df = df.withColumn("short", F.coalesce(F.max(F.when(lead & (F.col("total") > 0) & (F.col("w0") < floor), F.lit(floor) - F.col("w0"))).over(w), F.lit(0.0)))
    df = df.withColumn("rest", F.sum(F.when(~lead, F.col("w0")).otherwise(0.0)).over(w))
    lifted = F.when(lead, F.col("w0") + F.col("short")).when(
        F.col("rest") > 0, F.col("w0") - F.col("short") * (F.col("w0") / F.when(F.col("rest") > 0, F.col("rest")))
    ).otherwise(F.col("w0"))
    df = df.withColumn("w1", lifted)
    df = df.withColumn("weight", F.col("w1") / F.sum("w1").over(w))
    rel = F.when((F.col("day") == F.col("last_day")) & (F.col("top") > 0), F.col("z_last") / F.when(F.col("top") > 0, F.col("top"))).otherwise(F.lit(0.0))
    df = df.withColumn("part", half_even(rel * F.col("weight"), 4))
    total = F.sum(F.col("part").cast("decimal(12,4)")).cast("double")
    return df.groupBy("artist_id").agg(
        half_even(clamp(F.lit(5.0) + F.lit(95.0) * total, 0, 100), 2).alias("popularity_score"),
        F.map_from_entries(F.collect_list(F.struct("platform", half_even(F.col("weight"), 4)))).alias("platform_weights"),
    )


def update_popularity(artists: DataFrame, scores: DataFrame) -> DataFrame:
    """Artists with the new score where there is one."""
    new = scores.select("artist_id", F.col("popularity_score").alias("new_score"))
    return artists.join(new, "artist_id", "left").withColumn("popularity", F.coalesce("new_score", "popularity")).select(*artists.columns)
