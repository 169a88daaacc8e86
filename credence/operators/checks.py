"""Validation: each check is a table of violations; `check_results` counts them per rule and `validate` raises on any."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from credence.config import RiskSettings
from credence.operators.grouping import spread_join


class DataValidationError(Exception):
    pass


def year_violations(reports: DataFrame, settings: RiskSettings = RiskSettings()) -> DataFrame:
    """Companies whose number of distinct report years is not the required one."""
    pairs = reports.select("inn", "year").distinct()
    return (
        pairs.groupBy("inn")
        .agg(F.count("year").alias("years_count"))
        .filter(F.col("years_count") != len(settings.years))
    )


def unknown_edge_ends(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Node ids that edges name but the node table lacks, with how many edge ends name them.

    Edge ends are counted per id before the join, so a hub is one row there.
    """
    ends = edges.select(F.explode(F.array("source_node_id", "target_node_id")).alias("node_id"))
    counted = ends.groupBy("node_id").agg(F.count(F.lit(1)).alias("edge_ends"))
    return counted.join(nodes.select("node_id"), "node_id", "left_anti")


def acl_violations(documents: DataFrame, chunks: DataFrame, level: str = "secret") -> DataFrame:
    """Chunks of restricted documents that anyone but risk_manager may read.

    `documents` and `chunks` share document_id; chunks also have external_id.
    """
    restricted = documents.filter(F.col("security_level") == level).select("document_id")
    loose = ~F.coalesce(F.col("allowed_roles") == F.array(F.lit("risk_manager")), F.lit(False))
    return spread_join(
        chunks.filter(loose).select("document_id", "external_id", "allowed_roles"),
        restricted, "document_id", ["external_id"], "left_semi",
    )


def wrong_dimension(embeddings: DataFrame, dim: int) -> DataFrame:
    """How many vectors do not have the expected length."""
    return embeddings.agg(
        F.count_if(F.size("embedding") != dim).alias("wrong"), F.count(F.lit(1)).alias("total")
    )


RESTRICTED_CHUNK = "ch_003"


def check_results(
    tables: dict[str, DataFrame],
    settings: RiskSettings = RiskSettings(),
    restricted: str = RESTRICTED_CHUNK,
    min_nodes: int = 5,
    min_edges: int = 4,
) -> DataFrame:
    """(rule, violations): every rule over the tables given, 0 where it holds. One aggregate per table."""
    rows = F.count(F.lit(1))
    found: list[DataFrame] = []

    def measure(source: DataFrame, **rules: Column) -> None:
        counted = source.agg(*[v.cast("long").alias(rule) for rule, v in rules.items()])
        pairs = F.array(*[F.struct(F.lit(rule).alias("rule"), F.col(rule).alias("violations")) for rule in rules])
        found.append(counted.select(F.explode(pairs).alias("found")).select("found.*"))

    if "company" in tables:
        measure(tables["company"], company_rows_missing=(rows == 0))
    if "financial_report" in tables:
        reports = tables["financial_report"]
        of_target = F.count_if(F.col("year") == settings.target_year)
        measure(reports, report_rows_missing=(rows == 0), target_year_missing=(of_target == 0))
        measure(year_violations(reports, settings), company_years=rows)
    if "chunks" in tables:
        tight = F.coalesce(F.col("allowed_roles") == F.array(F.lit("risk_manager")), F.lit(False))
        measure(
            tables["chunks"].filter(F.col("external_id") == restricted),
            restricted_chunk_count=F.abs(rows - 1),
            restricted_chunk_readers=F.count_if(~tight),
        )
    if "graph_nodes" in tables and "graph_edges" in tables:
        nodes, edges = tables["graph_nodes"], tables["graph_edges"]
        measure(nodes, nodes_missing=F.greatest(F.lit(0), F.lit(min_nodes) - rows))
        measure(edges, edges_missing=F.greatest(F.lit(0), F.lit(min_edges) - rows))
        measure(unknown_edge_ends(nodes, edges), unknown_edge_ends=rows)
    return reduce(DataFrame.unionAll, found)


def validate(tables: dict[str, DataFrame], settings: RiskSettings = RiskSettings()) -> None:
    """Raises with every rule the tables break."""
    broken = check_results(tables, settings).filter("violations > 0").orderBy("rule").collect()
    if broken:
        raise DataValidationError(", ".join(f"{r['rule']}: {r['violations']}" for r in broken))
