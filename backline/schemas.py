"""Table schemas, keys and the constraint rules of the data model."""

from __future__ import annotations

from pyspark.sql import types as T

S, L, I, D, B, DAY = T.StringType(), T.LongType(), T.IntegerType(), T.DoubleType(), T.BooleanType(), T.DateType()
MONEY, SCORE, GROWTH, COORD = T.DecimalType(14, 2), T.DecimalType(5, 2), T.DecimalType(8, 4), T.DecimalType(9, 6)


def table(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(n, t, True) for n, t in fields])


_COUNTS = [(c, L) for c in ("followers", "streams", "views", "likes", "comments", "shares")]

TABLES: dict[str, T.StructType] = {
    "artists": table(("artist_id", S), ("artist_name", S), ("nationality", S), ("active", B), ("popularity", SCORE),
                     ("spotify_listeners", L), ("youtube_subscribers", L), ("instagram_followers", L), ("facebook_followers", L), ("twitter_followers", L)),
    "genres": table(("genre_id", S), ("genre", S)),
    "artist_genres": table(("artist_id", S), ("genre", S)),
    "platform_metrics": table(("artist_id", S), ("platform", S), ("date", DAY), *_COUNTS, ("rog_daily", GROWTH), ("rog_weekly", GROWTH), ("rog_monthly", GROWTH)),
    "venues": table(("venue_id", S), ("venue_name", S), ("city", S), ("state", S), ("country", S), ("latitude", COORD), ("longitude", COORD), ("venue_type", S),
                    ("capacity_min", I), ("capacity_max", I), ("avg_capacity", I), ("avg_ticket_price", T.DecimalType(10, 2)), ("verified", B), ("source_url", S)),
    "concerts": table(("concert_id", S), ("artist_id", S), ("artist_name", S), ("concert_date", DAY), ("venue_name", S), ("city", S), ("state", S), ("country", S),
                      ("latitude", COORD), ("longitude", COORD), ("capacity", I), ("tickets_sold", I), ("avg_ticket_price", T.DecimalType(10, 2)), ("total_revenue", MONEY),
                      ("price_vip", T.DecimalType(10, 2)), ("price_tier1", T.DecimalType(10, 2)), ("price_tier2", T.DecimalType(10, 2)), ("price_tier3", T.DecimalType(10, 2)),
                      ("currency", S), ("demand_score", SCORE), ("source", S), ("source_url", S), ("source_event_id", S), ("verification_status", S), ("created_at", T.TimestampType())),
    "audience_demographics": table(("demo_id", S), ("artist_id", S), ("concert_id", S), ("dimension", S), ("dimension_value", S), ("percentage", SCORE), ("absolute_count", I), ("source_platform", S), ("metric_date", DAY)),
    "ingestion_jobs": table(("job_id", S), ("job_type", S), ("status", S), ("records", L), ("seconds", D), ("error", S), ("started_at", T.TimestampType())),
    "canonical_events": table(("event_id", S), ("artist_name", S), ("normalized_artist_name", S), ("event_name", S), ("venue_name", S), ("normalized_venue_name", S), ("city", S),
                              ("normalized_city", S), ("country", S), ("event_date", DAY), ("source_platform", S), ("source_url", S), ("confidence_score", T.DecimalType(5, 4)),
                              ("fraud_risk_score", T.DecimalType(5, 4)), ("validation_status", S), ("canonical_key", S)),
    "source_event_references": table(("event_id", S), ("source_platform", S), ("source_event_id", S), ("source_url", S), ("source_event_key", S), ("confidence_score", T.DecimalType(5, 4))),
    "duplicate_groups": table(("group_id", S), ("event_id", S), ("similarity_score", T.DecimalType(5, 4))),
    "duplicate_group_members": table(("group_id", S), ("event_id", S), ("role", S), ("similarity_score", T.DecimalType(5, 4)), ("reasons", T.ArrayType(S))),
    "validation_logs": table(("event_id", S), ("source_platform", S), ("confidence_score", T.DecimalType(5, 4)), ("fraud_risk_score", T.DecimalType(5, 4)), ("validation_status", S),
                             ("reasons", T.ArrayType(S)), ("rule_scores", T.MapType(S, D))),
    "prediction_outputs": table(("prediction_id", S), ("concert_id", S), ("model_version", S), ("expected_revenue", MONEY), ("expected_attendance", I), ("sellout_probability", T.DecimalType(5, 4)),
                                ("demand_score", SCORE), ("created_at", T.TimestampType())),
    "feature_snapshots": table(("event_id", S), ("artist_id", S), ("concert_id", S), ("feature_set_version", S), ("features", T.MapType(S, D))),
    "prediction_training_data": table(("concert_id", S), ("actual_revenue", MONEY), ("predicted_revenue", MONEY), ("accuracy", SCORE), ("model_version", S)),
    "prediction_models": table(("model_version", S), ("path", S), ("trained_at", T.TimestampType()), ("rows", L)),
    "artist_popularity_scores": table(("artist_id", S), ("popularity_score", D), ("platform_weights", T.MapType(S, D)), ("platform_contributions", T.MapType(S, D)), ("computed_at", T.TimestampType())),
    "venue_capacity_records": table(("venue_name", S), ("normalized_venue_name", S), ("city", S), ("normalized_city", S), ("country", S), ("normalized_country", S), ("venue_type", S),
                                    ("capacity", I), ("capacity_min", I), ("capacity_max", I), ("confidence", D), ("status", S), ("source", S), ("reasons", T.ArrayType(S)), ("inserted_at", T.TimestampType())),
}

# natural key of each upserted table
KEYS = {
    "platform_metrics": ["artist_id", "platform", "date"], "venues": ["venue_name", "city", "country"],
    "venue_capacity_records": ["normalized_venue_name", "normalized_city", "normalized_country"],
    "artist_popularity_scores": ["artist_id"], "source_event_references": ["source_event_key"],
    "prediction_outputs": ["concert_id", "model_version"], "canonical_events": ["canonical_key"],
}

TRAINING_ROW = table(
    ("venue_capacity", D), ("avg_ticket_price", D), ("price_range", D), ("max_revenue_naive", D), ("is_weekend", I), ("month", I),
    ("demand_score", D), ("best_rog_30d", D), ("cross_platform_score", D), ("season", S), ("city", S), ("country", S), ("artist_tier", S), ("actual_revenue", D),
)
