"""Knowledge graph: building nodes and edges, bounded expansion from chunks, and scoring what it reaches."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from credence.config import EDGE_TYPES
from credence.functions.columns import chunk_node_id
from credence.operators.adjacency import Adjacency, reach_classes, reach_stored, store_adjacency
from credence.operators.grouping import product_join, spread_join
from credence.session import settle, settle_counted

CHUNK_SCORE = 1.0
DOCUMENT_SCORE = 0.8
# Pairs of walks and edges from which on an expansion over several hops goes by classes of nodes.
CLASSED_PAIRS = 100_000_000
# So many queries travel to every task, to be told apart there.
BROADCAST_QUERIES = 1_000_000


def build_nodes(
    documents: DataFrame,
    chunks: DataFrame,
    companies: DataFrame,
    legal_acts: DataFrame | None = None,
    risk_nodes: DataFrame | None = None,
) -> DataFrame:
    """Node table: one node per company (inn, name), document and chunk, plus ready-made act and factor nodes."""
    none = F.create_map().cast("map<string,string>")
    # Nodes may be tagged with more than the level; only the level is copied from documents.
    level = F.create_map(F.lit("security_level"), F.col("security_level"))

    def shape(df, prefix, kind, key, label, table, metadata):
        return df.select(
            F.concat(F.lit(prefix), F.col(key)).alias("node_id"),
            F.lit(kind).alias("node_type"),
            F.col(label).alias("label"),
            F.lit(table).alias("ref_table"),
            F.col(key).alias("ref_id"),
            metadata.alias("metadata"),
        )

    chunk_meta = F.coalesce("metadata", none) if "metadata" in chunks.columns else none
    parts = [
        shape(companies, "company:", "Company", "inn", "name", "company", none),
        shape(documents, "document:", "Document", "external_id", "title", "document", level),
        shape(chunks, "chunk:", "Chunk", "external_id", "external_id", "chunk", chunk_meta),
        *[df for df in (legal_acts, risk_nodes) if df is not None],
    ]
    return reduce(DataFrame.unionByName, parts)


def belongs_to_edges(chunks: DataFrame) -> DataFrame:
    """Chunk -> its document, from the chunk's own document key."""
    return chunks.select(
        chunk_node_id(F.col("external_id")).alias("source_node_id"),
        F.concat(F.lit("document:"), F.col("document_external_id")).alias("target_node_id"),
        F.lit("BELONGS_TO").alias("edge_type"),
        F.lit(1.0).alias("weight"),
        F.lit(1.0).alias("confidence"),
        F.col("external_id").alias("source_chunk_external_id"),
    )


def seed_nodes(seeds: DataFrame) -> DataFrame:
    """(query_id, node_id) of the retrieved chunks; chunks without an external id are no seeds."""
    return (
        seeds.filter(F.col("external_id").isNotNull() & (F.col("external_id") != ""))
        .select("query_id", chunk_node_id(F.col("external_id")).alias("node_id"))
        .distinct()
    )


def reach(
    seeds: DataFrame, edges: DataFrame | Adjacency, hops: int = 1, edge_types: Sequence[str] = tuple(EDGE_TYPES)
) -> DataFrame:
    """(query_id, node_id, depth): everything within `hops` undirected steps, seeds at depth 0.

    Breadth-first over all queries at once, a node once per query at its least depth. `edges` is an
    edge list, which is stored both ways first, or an adjacency stored before with the edge types wanted.
    """
    return _reach(seeds, edges, hops, edge_types)[0]


def _reach(seeds: DataFrame, edges: DataFrame | Adjacency, hops: int, edge_types: Sequence[str]) -> tuple[DataFrame, int]:
    if hops and not isinstance(edges, Adjacency):
        edges = store_adjacency(edges, edge_types)
    return reach_stored(seeds, edges, hops)


def expand(
    seeds: DataFrame,
    nodes: DataFrame,
    edges: DataFrame | Adjacency,
    hops: int = 1,
    edge_types: Sequence[str] = tuple(EDGE_TYPES),
) -> DataFrame:
    """Reached nodes with their attributes; ids the node table lacks are walked through but not returned.

    Queries with the same seeds are walked as one, and told apart at the end. Where several hops may give many rows, they
    go by classes of nodes; a row for each query and node is made in the last join only, and not shuffled.
    """
    columns = ["query_id", "node_id", "node_type", "label", "ref_table", "ref_id", "depth"]
    about = nodes.select("node_id", "node_type", "label", "ref_table", "ref_id")
    sets, queries = settle_counted(seeds.groupBy("query_id").agg(F.sort_array(F.collect_set("node_id")).alias("seeds")))
    # Numbers of any kind, but written once, so that they stay.
    walks, different = settle_counted(sets.select("seeds").distinct().withColumn("walk", F.monotonically_increasing_id()))
    if hops and not isinstance(edges, Adjacency):
        edges = store_adjacency(edges, edge_types)
    starts = walks.select("walk", F.explode("seeds").alias("node_id"))
    if hops > 1 and different * edges.rows > CLASSED_PAIRS:
        members = settle(sets.join(walks, "seeds").select("query_id", "walk"))
        return _expand_classes(starts, members, queries, about, edges, hops).select(*columns)
    if different == queries:
        found, rows = _reach(seeds, edges, hops, edge_types)
        return spread_join(found, about, "node_id", ["query_id"], rows=rows).select(*columns)
    found, rows = _reach(starts.withColumnRenamed("walk", "query_id"), edges, hops, edge_types)
    found = found.withColumnRenamed("query_id", "walk")
    named = spread_join(found, about, "node_id", ["walk"], rows=rows)
    members = sets.join(walks, "seeds").select("query_id", "walk")
    told_apart = spread_join(named, members, "walk", ["node_id"], small_id=["query_id"], weigh=found, rows=rows, small_rows=queries)
    return told_apart.select(*columns)


def _expand_classes(starts: DataFrame, members: DataFrame, queries: int, about: DataFrame, edges: Adjacency, hops: int) -> DataFrame:
    reached = reach_classes(starts, edges, hops)
    named = about.join(reached.nodes, "node_id")
    if queries > BROADCAST_QUERIES:
        depths = settle(product_join(reached.walks, members, "walk", ["class"], ["query_id"]))
        return product_join(named, depths, "class", ["node_id"], ["query_id"])
    sizes = F.broadcast(members.groupBy("walk").agg(F.count(F.lit(1)).alias("_queries")))
    weights = reached.walks.join(sizes, "walk").groupBy("class").agg(F.count(F.lit(1)).alias("_m"), F.sum("_queries").alias("_gives"))
    found = product_join(named, reached.walks, "class", ["node_id"], ["walk"], weights=weights)
    return found.join(F.broadcast(members), "walk")


def graph_chunks(
    reached: DataFrame, chunk: DataFrame, document: DataFrame, reached_rows: int | None = None, chunk_rows: int | None = None
) -> DataFrame:
    """(query_id, chunk_id, stage, graph_score) of the chunks behind reached nodes.

    Stage 1: the chunk of a Chunk node, score 1.0. Stage 2: every chunk of a Document
    node, score 0.8. Other node types lead to no chunk, even if they refer to a document.
    `chunk` has chunk_id, document_id, external_id; `document` has document_id, external_id. Row counts
    that are known need not be counted again.
    """
    reached_rows = reached.count() if reached_rows is None else reached_rows
    chunk_rows = chunk.count() if chunk_rows is None else chunk_rows
    has_ref = F.coalesce(F.col("ref_id") != "", F.lit(False))
    named = F.when((F.col("node_type") == "Chunk") & has_ref, F.col("ref_id")).when(
        F.col("node_id").startswith("chunk:"), F.expr("substring(node_id, 7)")
    )
    direct = reached.select("query_id", named.alias("external_id")).filter("external_id IS NOT NULL").distinct()
    of_chunks = spread_join(
        direct, chunk.select("chunk_id", "external_id"), "external_id", ["query_id"], rows=reached_rows
    )
    wanted = (
        reached.filter((F.col("node_type") == "Document") & has_ref)
        .select("query_id", F.col("ref_id").alias("external_id"))
        .distinct()
    )
    documents = spread_join(
        wanted, document.select("document_id", "external_id"), "external_id", ["query_id"], rows=reached_rows
    ).select("query_id", "document_id")
    of_documents = spread_join(
        chunk.select("chunk_id", "document_id"), documents, "document_id", ["chunk_id"],
        small_id=["query_id"], rows=chunk_rows, small_rows=reached_rows,
    )

    def scored(df, stage, score):
        return df.select("query_id", "chunk_id", F.lit(stage).alias("stage"), F.lit(score).alias("graph_score"))

    return scored(of_chunks, 1, CHUNK_SCORE).unionByName(scored(of_documents, 2, DOCUMENT_SCORE))
