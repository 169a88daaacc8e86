"""Yearly report files: discovery, schema-adaptive reading, cleaning, union."""

from __future__ import annotations

import logging
import re
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from credence.config import FINANCIAL_RENAMES, FLAG_COLUMNS, MEASURE_COLUMNS, META_COLUMNS, TEXT_COLUMNS, RiskSettings
from credence.functions.columns import lenient, stripped

logger = logging.getLogger(__name__)

# Where a row came from; decides which of two reports for one company and year is first.
ROW_ORDER = ["_file", "_row"]


def discover_years(spark: SparkSession, root: str) -> dict[int, list[str]]:
    """{year: folders} for all year=* folders under root, at any depth and however many per year.

    Found from the paths of the files below them, on any file system Spark reads.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path")
    # Below the root, whose scheme and slashes may be spelled otherwise in the paths of its files.
    below = re.escape("/" + re.sub(r"^[A-Za-z][A-Za-z0-9+.-]*:/*", "", root).strip("/"))
    pattern = f"^(.*?{below}/(?:.*?/)?year=([0-9]+))/"
    folders = files.select(
        F.regexp_extract("path", pattern, 1).alias("folder"), F.regexp_extract("path", pattern, 2).alias("year")
    )
    found: dict[int, list[str]] = {}
    # One row per folder, not per file.
    for row in folders.filter("folder <> ''").distinct().orderBy("folder").collect():
        found.setdefault(int(row["year"]), []).append(row["folder"])
    if not found:
        raise FileNotFoundError(f"no year=* folders under {root}")
    return dict(sorted(found.items()))


def clean_year(df: DataFrame, year: int, settings: RiskSettings = RiskSettings()) -> DataFrame:
    """One year's raw rows: wanted columns only, renamed, leniently cast, stamped with the year, filtered."""
    wanted = [c for c in META_COLUMNS if c != "year"] + list(FINANCIAL_RENAMES)
    missing = [c for c in wanted if c not in df.columns]
    if missing:
        logger.warning("year=%s: missing columns: %s", year, missing)
    carried = [c for c in ROW_ORDER if c in df.columns]
    out = df.select(*[c for c in wanted if c in df.columns], *carried).withColumnsRenamed(FINANCIAL_RENAMES)
    casts = {c: stripped(F.col(c)) for c in TEXT_COLUMNS if c in out.columns}
    casts |= {c: lenient(F.col(c), "double") for c in FLAG_COLUMNS + MEASURE_COLUMNS if c in out.columns}
    # Carried as they come; one declared type per column keeps the yearly union safe.
    casts |= {c: F.col(c).cast("string") for c in ("creation_date", "dissolution_date") if c in out.columns}
    casts |= {c: lenient(F.col(c), "int") for c in ("age",) if c in out.columns}
    # NULL tests on the raw columns reach the Parquet scan; the casts keep NULL as NULL.
    for key in ("inn", "ogrn"):
        if key in out.columns:
            out = out.filter(F.col(key).isNotNull())
    out = out.withColumns(casts).withColumn("year", F.lit(year).cast("int"))
    for column, allowed in (
        ("region_taxcode", settings.region_taxcodes),
        ("okved_section", settings.okved_sections),
    ):
        if column in out.columns and allowed:
            out = out.filter(F.col(column).isin(*allowed))
    return out


def schema_groups(spark: SparkSession, folder: str) -> list[list[str]]:
    """Paths below one folder in groups whose schemas Spark can merge, one group wherever it can.

    Spark reads the footers in tasks and merges them. Where types of a column clash, the folder's files are
    halved until they do not, and what has the same schema goes together again, so there are as many scans as
    schemas. Only then is a row per file fetched.
    """
    whole = _merged(spark, [folder])
    if whole is not None:
        return [[folder]]
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(folder).select("path")
    waiting, groups = [sorted(r["path"] for r in listed.collect())], {}
    while waiting:
        files = waiting.pop()
        schema = _merged(spark, files)
        if schema is not None:
            groups.setdefault(schema, []).extend(files)
        elif len(files) == 1:
            raise ValueError(f"no schema in {files[0]}")
        else:
            waiting += [files[: len(files) // 2], files[len(files) // 2 :]]
    return [sorted(files) for _, files in sorted(groups.items())]


def _merged(spark: SparkSession, paths: list[str]) -> str | None:
    """A fingerprint of the merged schema, None if the types clash."""
    try:
        schema = spark.read.option("mergeSchema", "true").parquet(*paths).schema
    except (PySparkException, Py4JJavaError) as error:
        if "CANNOT_MERGE" in str(error):
            return None
        raise
    return str(sorted((f.name, f.dataType.simpleString()) for f in schema))


def read_year(spark: SparkSession, year: int, paths: list[str], settings: RiskSettings = RiskSettings()) -> DataFrame:
    """All files of one year, from all its folders. Each row remembers its file and its place in it.

    One scan for each schema found in a folder, cleaned before the union, so columns and their types may differ.
    """
    parts = []
    for path in paths:
        for files in schema_groups(spark, path):
            raw = spark.read.option("mergeSchema", "true").parquet(*files)
            raw = raw.select(
                "*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row")
            )
            parts.append(clean_year(raw, year, settings))
    return union_years(parts)


def union_years(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def load_years(spark: SparkSession, root: str, settings: RiskSettings = RiskSettings()) -> DataFrame:
    folders = discover_years(spark, root)
    return union_years([read_year(spark, year, paths, settings) for year, paths in folders.items()])
