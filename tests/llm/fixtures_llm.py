"""Small tables with nulls, empty and very long texts, repeated rows and clashing column names."""

from __future__ import annotations

AWKWARD = [
    (0, "One line of plain words that ends well. " * 12, "en", "a", 1),
    (0, "One line of plain words that ends well. " * 12, "en", "a", 1),
    (1, None, None, None, None),
    (2, "", "en", "b", 0),
    (3, " \n\t ", None, "b", 4),
    (None, "A text without an id, but with some words.", "de", "a", 42),
    (4, "é" * 70_000 + " " + "word " * 30_000, "fr", "c", 7),
    (5, "123 456 !!!", "en", None, 11),
    (6, "One line of plain words that ends well. " * 11 + "Another end.", "en", "a", 1),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, rows=AWKWARD, extra=()):
    """``extra``: more columns, each a constant under a clashing name."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows, SCHEMA)
    return df.withColumns({name: F.lit("mine") for name in extra})
