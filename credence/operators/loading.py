"""Keys, upserts and the row shapes of the stored tables."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from credence.config import RISK_COLUMNS, RISK_EXPLANATION_PREFIX, RISK_FLAG_TO_CODE
from credence.functions.columns import date_prefix, number_flag, with_external_id
from credence.operators.grouping import dense_ids, first_by, last_by, spread_join


def upsert(old: DataFrame, new: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """New rows replace old ones with the same key; among new rows the last by `order` wins."""
    latest = last_by(new, keys, order, drop_order=True)
    return latest.unionByName(old.join(latest.select(*keys), list(keys), "left_anti"), allowMissingColumns=True)


def update_or_insert(old: DataFrame, new: DataFrame, keys: Sequence[str], kept: Sequence[str]) -> DataFrame:
    """New rows, one per key, update old ones with the same key but for their `kept` columns, and join them otherwise."""
    columns, on = old.columns, list(keys)
    before = old.select(*on, F.struct(*[c for c in columns if c not in on]).alias("before"))
    after = new.select(*on, F.struct(*[c for c in columns if c not in on]).alias("after"))
    both = before.join(after, on, "full_outer")

    def value(c):
        first, second = ("before", "after") if c in kept else ("after", "before")
        return F.when(F.col(first).isNotNull(), F.col(first)[c]).otherwise(F.col(second)[c]).alias(c)

    return both.select(*[F.col(c) if c in on else value(c) for c in columns])


def with_arrival(rows: DataFrame) -> DataFrame:
    """Rows with `pos`, the order they arrive in: file and row where they come with both, else their content."""
    if {"_file", "_row"} <= set(rows.columns):
        return rows.withColumn("pos", F.struct("_file", "_row")).drop("_file", "_row")
    plain = [F.array_sort(F.map_entries(f.name)) if f.dataType.typeName() == "map" else F.col(f.name) for f in rows.schema]
    return rows.withColumn("pos", F.struct(*plain))


def insert_or_ignore(old: DataFrame, new: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Old rows stay; new keys are added once, with their first row by `order`."""
    first = first_by(new, keys, order, drop_order=True)
    return old.unionByName(first.join(old.select(*keys), list(keys), "left_anti"), allowMissingColumns=True)


def merge_nodes(old: DataFrame, new: DataFrame, order: Sequence[str]) -> DataFrame:
    """Node upsert: label and metadata take the last value, type and reference keep the first."""
    rank = F.struct(*order)
    first, last = ["node_type", "ref_table", "ref_id"], ["label", "metadata"]
    merged = new.groupBy("node_id").agg(
        F.min_by(F.struct(*first), rank).alias("f"), F.max_by(F.struct(*last), rank).alias("l")
    )
    before = old.select("node_id", F.struct(*first).alias("of"), F.struct(*last).alias("ol"))
    both = before.join(merged, "node_id", "full_outer")
    return both.select(
        "node_id",
        *[F.coalesce("of", "f")[c].alias(c) for c in first],
        *[F.coalesce("l", "ol")[c].alias(c) for c in last],
    ).select("node_id", "node_type", "label", "ref_table", "ref_id", "metadata")


# How the message of a failed look-up begins; `missing_key` finds it in Spark's errors.
NO_MATCH = "without a match, for example"


def known_or_fail(found: Column, key: Column, what: str) -> Column:
    """The id a left join found; where it found none, the job that needs it fails. No job of its own looks first."""
    text = F.concat(F.lit(f"{what} {NO_MATCH} '"), F.coalesce(key.cast("string"), F.lit("")), F.lit("'"))
    return F.when(found.isNotNull(), found).otherwise(F.raise_error(text).cast("long"))


def missing_key(error: Exception) -> str | None:
    """What `known_or_fail` said, if an error of Spark's has it."""
    said = re.search(rf"[\w ]+ {NO_MATCH} '[^'\n]*'", str(error))
    return said.group(0).strip() if said else None


def company_rows(company: DataFrame, start: int = 1) -> DataFrame:
    label = "company_label" if "company_label" in company.columns else "name"
    optional = lambda c: F.col(c) if c in company.columns else F.lit(None).cast("string")
    return dense_ids(company, "inn", "company_id", start).select(
        "company_id",
        "inn",
        optional("ogrn").alias("ogrn"),
        optional(label).alias("name"),
        optional("region").alias("region"),
        optional("okved").alias("okved"),
        optional("okved_section").alias("okved_section"),
        date_prefix(optional("creation_date")).alias("creation_date"),
        date_prefix(optional("dissolution_date")).alias("dissolution_date"),
    )


def report_rows(report: DataFrame, company: DataFrame, strict: bool = False) -> DataFrame:
    """Stored report shape: net_profit is called profit, year report_year; flags become BOOLEAN.

    Reports of unknown companies are left out, or, if `strict`, fail the job that reads the rows.
    """
    have = report.columns
    number = lambda c: F.col(c) if c in have else F.lit(None).cast("double")
    company_id = known_or_fail(F.col("company_id"), F.col("inn"), "report inn") if strict else F.col("company_id")
    return report.join(company.select("company_id", "inn"), "inn", "left" if strict else "inner").select(
        company_id.alias("company_id"),
        F.col("year").cast("int").alias("report_year"),
        number("revenue").alias("revenue"),
        number("net_profit").alias("profit"),
        number("assets").alias("assets"),
        *[number_flag(number(c)).alias(c) for c in ("filed", "imputed", "outlier")],
        *(["pos"] if "pos" in have else []),
    )


def raised_flags(features: DataFrame) -> DataFrame:
    """One row per raised flag: inn, flag, code, confidence, explanation."""
    flags = [c for c in RISK_COLUMNS if c in features.columns]
    long = features.unpivot(["inn"], flags, "flag", "raised").filter("raised").drop("raised")
    code = F.create_map(*[F.lit(x) for pair in RISK_FLAG_TO_CODE.items() for x in pair])[F.col("flag")]
    return long.select(
        "inn",
        "flag",
        code.alias("code"),
        F.lit(1.0).alias("confidence"),
        F.concat(F.lit(RISK_EXPLANATION_PREFIX), F.col("flag")).alias("explanation"),
    )


def company_risk_rows(features: DataFrame, company: DataFrame, risk_factor: DataFrame) -> DataFrame:
    """company_risk with looked-up ids of the company and of the risk factor."""
    return (
        raised_flags(features)
        .join(risk_factor.select("risk_factor_id", "code"), "code", "inner")
        .join(company.select("company_id", "inn"), "inn", "inner")
        .select("company_id", "risk_factor_id", "confidence", "explanation", "inn", "code")
    )


def document_rows(documents: DataFrame, start: int = 1) -> DataFrame:
    return dense_ids(documents, "external_id", "document_id", start).select(
        "document_id", "source", "doc_type", "title", "security_level",
        with_external_id(F.col("metadata"), F.col("external_id")).alias("metadata"),
    )


def chunk_rows(chunks: DataFrame, document: DataFrame, start: int = 1, strict: bool = False) -> DataFrame:
    """Chunks with document ids. One document may own a third of all chunks, hence the spread join.

    Chunks of unknown documents are left out, or, if `strict`, fail the job that reads the rows.
    """
    ids = document.select("document_id", F.col("metadata")["external_id"].alias("document_external_id"))
    joined = spread_join(chunks, ids, "document_external_id", ["external_id"], "left" if strict else "inner")
    if strict:
        joined = joined.withColumn("document_id", known_or_fail(F.col("document_id"), F.col("document_external_id"), "chunk document"))
    return dense_ids(joined, "external_id", "chunk_id", start).select(
        "chunk_id", "document_id", "chunk_text", F.col("chunk_order").cast("int").alias("chunk_order"),
        F.coalesce("allowed_roles", F.array().cast("array<string>")).alias("allowed_roles"),
        with_external_id(F.col("metadata"), F.col("external_id")).alias("metadata"),
    )


def edge_rows(edges: DataFrame, chunk: DataFrame, start: int = 1) -> DataFrame:
    """Edges with the id of the chunk they came from; an unknown or missing chunk gives NULL."""
    ids = chunk.select(
        F.col("chunk_id").alias("source_chunk_id"),
        F.col("metadata")["external_id"].alias("source_chunk_external_id"),
    )
    key = F.concat_ws("\u0001", "source_node_id", "target_node_id", "edge_type", "source_chunk_external_id")
    joined = spread_join(
        edges, ids, "source_chunk_external_id", ["source_node_id", "target_node_id", "edge_type"], "left"
    )
    return dense_ids(joined.withColumn("_key", key), "_key", "edge_id", start, unique=False).select(
        "edge_id", "source_node_id", "target_node_id", "edge_type",
        F.col("weight").cast("double").alias("weight"),
        F.col("confidence").cast("double").alias("confidence"),
        "source_chunk_id", "metadata",
    )
