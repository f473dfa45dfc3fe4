"""Small tables with the cases every operator must stand: nulls, empty and long texts, ties, repeats, odd columns."""

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, rows, parts=3, extra=()):
    """Documents of (doc_id, text[, source]); ``extra`` adds columns whose names clash with the operators' own."""
    full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", 0) for r in rows]
    df = spark.createDataFrame(full, DOCS).repartition(parts)
    for name in extra:
        from pyspark.sql import functions as F

        df = df.withColumn(name, F.lit("x"))
    return df


ODD = [(None, None), (None, "one two"), (1, ""), (2, "   \n\t "), (3, "a"), (3, "a"), (4, "é ñ ß 漢字"), (5, "word " * 60000)]
