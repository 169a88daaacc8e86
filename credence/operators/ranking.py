"""Merging, de-duplicating, filtering and ranking the chunks of each query."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from credence.operators.grouping import first_by, grouped_rank

# Ranks inside a query are computed in runs of at most this many chunk ids.
PLACE_RUN = 65_536
RRF_K = 60


def dedupe_chunks(chunks: DataFrame, order: Sequence[str] = ("stage", "place")) -> DataFrame:
    """First row per (query_id, chunk_id) in `order`; rows without a chunk id go."""
    return first_by(chunks.filter(F.col("chunk_id").isNotNull()), ["query_id", "chunk_id"], list(order))


def merge_context(hits: DataFrame, graph: DataFrame) -> DataFrame:
    """Vector hits before graph hits: a seed also reached by the graph keeps its vector row.

    `place` orders rows of one stage: the vector rank, or the chunk id for graph hits.
    """
    seeds = hits.select(
        "query_id", "chunk_id", F.lit(0).alias("stage"), F.col("rank").alias("place"),
        F.col("vector_score"), F.lit(0.0).alias("graph_score"), F.lit("vector").alias("source"),
    )
    found = graph.select(
        "query_id", "chunk_id", "stage", F.col("chunk_id").cast("long").alias("place"),
        F.lit(0.0).alias("vector_score"), F.col("graph_score"), F.lit("graph").alias("source"),
    )
    return dedupe_chunks(seeds.unionByName(found))


def final_score(vector: Column, graph: Column) -> Column:
    """vector + 0.5 * graph to six digits, half to even; NULL counts as 0."""
    return F.bround(F.coalesce(vector, F.lit(0.0)) + 0.5 * F.coalesce(graph, F.lit(0.0)), 6)


def rerank(chunks: DataFrame) -> DataFrame:
    """Adds final_score and the 1-based rank by it; equal scores keep their (stage, place) order."""
    scored = chunks.withColumn("final_score", final_score(F.col("vector_score"), F.col("graph_score")))
    down = -F.col("final_score")
    return grouped_rank(
        scored,
        ["query_id"],
        [down, F.col("stage"), F.col("place")],
        [down, F.col("stage"), F.floor(F.col("place") / F.lit(PLACE_RUN))],
        "rank",
    )


def accessible(chunks: DataFrame) -> DataFrame:
    """Rows whose allowed_roles hold the row's role; NULL or empty lists deny."""
    return chunks.filter(F.array_contains("allowed_roles", F.col("role")))


def rrf(*lists: DataFrame, k: int = RRF_K) -> DataFrame:
    """Reciprocal rank fusion of (query_id, chunk_id, rank) lists: the sum of 1 / (k + rank)."""
    stacked = lists[0].select("query_id", "chunk_id", "rank")
    for other in lists[1:]:
        stacked = stacked.unionByName(other.select("query_id", "chunk_id", "rank"))
    score = F.bround(F.sum(F.lit(1.0) / (F.lit(k) + F.col("rank"))), 9)
    fused = stacked.groupBy("query_id", "chunk_id").agg(score.alias("rrf_score"))
    down = -F.col("rrf_score")
    run = F.floor(F.col("chunk_id") / F.lit(PLACE_RUN))
    return grouped_rank(fused, ["query_id"], [down, F.col("chunk_id")], [down, run], "rank")
