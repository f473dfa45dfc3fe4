"""Keyed joins that the reports share."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from backline.functions.rounding import half_up


def with_artist(concerts: DataFrame, artists: DataFrame, how: str = "inner") -> DataFrame:
    """Concerts with their artist's columns.

    No hint: AQE broadcasts the artist side when its measured size allows, else it runs a
    sort-merge join and splits the partitions of a hot artist.
    """
    return concerts.join(artists, "artist_id", how)


def latest_prediction(predictions: DataFrame) -> DataFrame:
    """Newest prediction per concert; the remaining columns break ties."""
    rest = [c for c in predictions.columns if c not in ("concert_id", "created_at", "prediction_id")]
    order = F.struct("created_at", "prediction_id", *rest)
    return predictions.groupBy("concert_id").agg(F.max(order).alias("p")).select("concert_id", "p.*")


def with_latest_prediction(concerts: DataFrame, predictions: DataFrame) -> DataFrame:
    latest = latest_prediction(predictions)
    renamed = latest.select("concert_id", *[F.col(c).alias(f"latest_{c}") for c in latest.columns if c != "concert_id"])
    return concerts.join(renamed, "concert_id", "left")


def resolve_concert_metrics(concerts: DataFrame, predictions: DataFrame) -> DataFrame:
    """Stored concert values completed from the newest prediction, then from each other."""
    df = with_latest_prediction(concerts, predictions)

    def num(c: str):
        return F.coalesce(F.col(c).cast("double"), F.lit(0.0))

    df = df.select(
        "*",
        num("tickets_sold").alias("t0"), num("avg_ticket_price").alias("p0"), num("total_revenue").alias("r0"),
        num("latest_expected_attendance").alias("pa"), num("latest_predicted_price").alias("pp"),
        num("latest_expected_revenue").alias("pr"),
        F.when(num("capacity") != 0, num("capacity")).otherwise(num("latest_predicted_capacity")).alias("c1"),
        F.when(num("demand_score") != 0, num("demand_score")).otherwise(num("latest_demand_score")).alias("d1"),
    )
    df = df.withColumn("t1", F.when((F.col("t0") <= 0) & (F.col("pa") > 0), half_up(F.col("pa"))).otherwise(F.col("t0")))
    df = df.withColumn("p1", F.when((F.col("p0") <= 0) & (F.col("pp") > 0), F.col("pp")).otherwise(F.col("p0")))
    df = df.withColumn(
        "r1",
        F.when(F.col("r0") > 0, F.col("r0"))
        .when((F.col("t1") > 0) & (F.col("p1") > 0), F.col("t1") * F.col("p1"))
        .when(F.col("pr") > 0, F.col("pr"))
        .otherwise(F.col("r0")),
    )
    df = df.withColumn(
        "t2",
        F.when((F.col("t1") <= 0) & (F.col("r1") > 0) & (F.col("p1") > 0), half_up(F.try_divide("r1", "p1"))).otherwise(F.col("t1")),
    )
    df = df.withColumn(
        "p2",
        F.when((F.col("p1") <= 0) & (F.col("r1") > 0) & (F.col("t2") > 0), F.try_divide("r1", "t2")).otherwise(F.col("p1")),
    )
    final = {
        "capacity": F.when(F.col("c1") > 0, half_up(F.col("c1")).cast("long")).otherwise(F.col("capacity")),
        "tickets_sold": F.when(F.col("t2") > 0, half_up(F.col("t2")).cast("long")).otherwise(F.lit(0)),
        "avg_ticket_price": F.when(F.col("p2") > 0, half_up(F.col("p2"), 2)).otherwise(F.col("avg_ticket_price")),
        "total_revenue": F.when(F.col("r1") > 0, half_up(F.col("r1"), 2)).otherwise(F.lit(0.0)),
        "demand_score": F.when(F.col("d1") > 0, half_up(F.col("d1"), 2)).otherwise(F.col("demand_score")),
    }
    return df.select(*[final.get(c, F.col(c)).alias(c) for c in concerts.columns])


def artists_with_genres(artists: DataFrame, artist_genres: DataFrame) -> DataFrame:
    """Artists with their sorted genre list."""
    lists = artist_genres.groupBy("artist_id").agg(F.array_sort(F.collect_set("genre")).alias("genres"))
    return artists.drop("genre").join(lists, "artist_id", "left").withColumn(
        "genres", F.coalesce("genres", F.array().cast("array<string>"))
    )


def lookup_venue(concerts: DataFrame, venues: DataFrame) -> DataFrame:
    """Stored venue by (name, city, country) ignoring case; capacity = mean, else max, else min."""

    def key(df: DataFrame, name: str) -> list:
        return [F.lower(F.trim(df[c])).alias(f"k_{c}") for c in (name, "city", "country")]

    def pos(c: str):
        return F.when(F.col(c) > 0, F.col(c))

    stored = (
        venues.select(
            *key(venues, "venue_name"), F.col("venue_id").alias("stored_venue_id"),
            F.coalesce(pos("avg_capacity"), pos("capacity_max"), pos("capacity_min")).alias("stored_capacity"),
            F.col("verified").alias("stored_verified"), F.col("avg_ticket_price").alias("stored_price"),
        )
        .groupBy("k_venue_name", "k_city", "k_country")
        .agg(F.min(F.struct("stored_venue_id", "stored_capacity", "stored_verified", "stored_price")).alias("v"))
        .select("k_venue_name", "k_city", "k_country", "v.*")
    )
    keyed = concerts.select("*", *key(concerts, "venue_name"))
    keys = ["k_venue_name", "k_city", "k_country"]
    return keyed.join(stored, keys, "left").drop(*keys)
