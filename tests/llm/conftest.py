import pytest
from pyspark.sql import functions as F


@pytest.fixture
def documents(spark):
    """Documents from (doc_id, text) rows, with columns whose names clash with those the operators make."""

    def make(rows):
        made = spark.createDataFrame(rows, "doc_id long, text string")
        clashes = ("key", "route", "start", "stop", "prefix", "rep", "n", "words", "seed", "number", "units", "score", "row", "_start", "_STOP", "_key", "_hot", "_text", "__start")
        return made.select("*", *[F.lit(None).cast("string").alias(c) for c in clashes])

    return make
