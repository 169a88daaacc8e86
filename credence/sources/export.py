"""CSV export of the prepared tables and the manifest of their sizes."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from credence.functions.columns import json_text

# Output folder -> key of the prepared bundle, and the manifest's name for its row count.
EXPORTS = {
    "poc_company": ("company", "companies"),
    "poc_financial_report": ("financial_report", "reports"),
    "poc_company_features": ("company_features", None),
    "documents": ("documents", "documents"),
    "chunks": ("chunks", "chunks"),
    "graph_nodes": ("graph_nodes", "graph_nodes"),
    "graph_edges": ("graph_edges", "graph_edges"),
}
SORTED_BY = {"company": ["inn"], "financial_report": ["inn", "year"], "company_features": ["inn"]}


def demo_inn(company: DataFrame) -> DataFrame:
    """The least company key, as one row."""
    return company.agg(F.min("inn").alias("demo_inn"))


def manifest(tables: dict[str, DataFrame]) -> DataFrame:
    """One row: the demonstration key and the row count of each exported table."""
    named = {label: tables[key] for key, label in EXPORTS.values() if label}
    counts = reduce(
        DataFrame.unionAll,
        [df.agg(F.lit(label).alias("label"), F.count(F.lit(1)).alias("n")) for label, df in named.items()],
    )
    one_row = counts.agg(*[F.max(F.when(F.col("label") == n, F.col("n"))).alias(n) for n in named])
    return one_row.select(demo_inn(tables["company"]).scalar().alias("demo_inn"), *named)


def write_csv(df: DataFrame, path: str) -> None:
    json_text(df).write.mode("overwrite").option("header", True).csv(path)


def reread(spark: SparkSession, path: str) -> DataFrame:
    """Rows of a CSV export as text, with `file` (its number in the order they were written) and `place` in it from 1 on.

    A file is what one task wrote, and so is the window that numbers its rows.
    """
    at = ["_block", "_at"]
    rows = spark.read.option("header", True).csv(path).select(
        "*", F.regexp_extract(F.col("_metadata.file_name"), r"part-(\d+)", 1).cast("int").alias("file"),
        F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_at"),
    )
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("file").orderBy(*at)).cast("long")).drop(*at)


def ranges(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per file of re-read rows: first and last key in the order of the file, rows, and a checksum of all values."""
    columns = [c for c in rows.columns if c not in ("file", "place")]
    key = F.struct(*keys)
    value = F.concat_ws("\u0001", *[F.coalesce(c, F.lit("\u0002")) for c in columns])
    return rows.groupBy("file").agg(
        F.min_by(key, "place").alias("first"), F.max_by(key, "place").alias("last"), F.count(F.lit(1)).alias("rows"),
        F.bit_xor(F.xxhash64("place", value)).alias("checksum"),
    )


def write_sorted(df: DataFrame, path: str, keys: Sequence[str]) -> None:
    """CSV in the order of `keys`, which hold text or sort like it, and beside it `.ranges`: what each file holds."""
    write_csv(df.orderBy(*keys), path)
    ranges(reread(df.sparkSession, path), keys).write.mode("overwrite").json(f"{path}.ranges")


def order_violations(spark: SparkSession, path: str, keys: Sequence[str]) -> DataFrame:
    """(file, problem) of an export that no longer is what `write_sorted` left: rows out of order, files that overlap, other contents."""
    rows, kinds = reread(spark, path), ", ".join(f"{k}: string" for k in keys)
    listed = spark.read.schema(f"file int, first struct<{kinds}>, last struct<{kinds}>, rows long, checksum long").json(f"{path}.ranges")
    key = F.struct(*keys)
    before = F.lag(key).over(Window.partitionBy("file").orderBy("place"))
    unsorted = rows.select("file", (before > key).alias("wrong")).filter("wrong").select("file", F.lit("order").alias("problem")).distinct()
    # One row per file.
    overlapping = listed.select("file", (F.lag("last").over(Window.orderBy("file")) > F.col("first")).alias("wrong")).filter("wrong").select("file", F.lit("range").alias("problem"))
    found = ranges(rows, keys).select("file", F.struct("first", "last", "rows", "checksum").alias("found"))
    both = listed.select("file", F.struct("first", "last", "rows", "checksum").alias("listed")).join(found, "file", "full_outer")
    changed = both.filter(~F.col("listed").eqNullSafe(F.col("found"))).select("file", F.lit("contents").alias("problem"))
    return unsorted.unionAll(overlapping).unionAll(changed)


def export_tables(tables: dict[str, DataFrame], folder: str) -> None:
    """Header CSV of the seven tables, sorted where the order is part of the format, and manifest.json."""
    for name, (key, _) in EXPORTS.items():
        if key in SORTED_BY:
            write_sorted(tables[key], f"{folder}/{name}.csv", SORTED_BY[key])
        else:
            write_csv(tables[key], f"{folder}/{name}.csv")
    manifest(tables).coalesce(1).write.mode("overwrite").json(f"{folder}/manifest.json")
