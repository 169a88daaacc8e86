"""The knowledge graph's edges stored both ways, bucketed by node, and expansion over them.

`store_adjacency` writes each edge from both ends, cut into buckets by node and sorted inside. A hop then
deals only its frontier to the buckets: the edges stay where they are, whatever their number. Where a node has
more edges than one task should take, buckets are by node and part: its edges are cut into parts by neighbour, so a
hub lies in several buckets; the few such nodes are listed beside the table, and only they repeat in the frontier.

Where there are many edges, a hop first builds a Bloom filter of its frontier, of fixed size, and drops
edges that no query stands on before they are sorted for the join.

`reach_stored` keeps a row for every query and node. Where hubs lead most queries to most nodes, `reach_classes` keeps
nodes that the same queries reach at the same depths as one class, and a class's queries once for all its nodes.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from credence.config import EDGE_TYPES
from credence.operators import grouping
from credence.operators.grouping import product_join, spread_join
from credence.session import ensure_checkpoint_dir, forget_at_end, settle, settle_counted

ROWS_PER_BUCKET = 4_000_000
# Edges from which on a hop filters them by its frontier before the join.
FILTERED_ROWS = 20_000_000
# Words of 64 bits in a frontier's filter: at most one row each, 16 bytes, is broadcast.
FILTER_WORDS = 1 << 16


@dataclass(frozen=True)
class Adjacency:
    """Edges both ways: a table bucketed by node_id, or by (node_id, part) where some nodes have several parts."""

    spark: SparkSession
    table: str
    rows: int
    buckets: int
    hubs: DataFrame | None  # node_id, parts

    @property
    def keys(self) -> list[str]:
        return ["node_id"] if self.hubs is None else ["node_id", "part"]

    @property
    def edges(self) -> DataFrame:
        return self.spark.table(self.table)


def both_ways(edges: DataFrame, edge_types: Sequence[str] = tuple(EDGE_TYPES)) -> DataFrame:
    """Each allowed edge in both directions, so an undirected step is a plain equi-join."""
    ways = F.array(
        F.struct(F.col("source_node_id").alias("node_id"), F.col("target_node_id").alias("neighbour")),
        F.struct(F.col("target_node_id").alias("node_id"), F.col("source_node_id").alias("neighbour")),
    )
    return (
        edges.filter(F.col("edge_type").isin(*edge_types))
        .filter(F.col("source_node_id") != F.col("target_node_id"))
        .select(F.explode(ways).alias("w"))
        .select("w.*")
    )


def store_adjacency(
    edges: DataFrame,
    edge_types: Sequence[str] = tuple(EDGE_TYPES),
    path: str | None = None,
    buckets: int | None = None,
    rows_per_part: int | None = None,
) -> Adjacency:
    """Writes the two-way edges of the given types below `path`, or below the session's checkpoint folder.

    `edges` is read twice: once for the degrees, once to be written. Parallel edges are stored once.
    """
    spark, per_part = edges.sparkSession, rows_per_part or grouping.ROWS_PER_TASK
    ways = both_ways(edges, edge_types)
    degrees = ways.groupBy("node_id").agg(F.count(F.lit(1)).alias("degree"))
    rows, most = degrees.agg(F.coalesce(F.sum("degree"), F.lit(0)), F.coalesce(F.max("degree"), F.lit(0))).first()
    keys, hubs = ["node_id"], None
    if most > per_part:
        parts = F.ceil(F.col("degree") / F.lit(per_part)).cast("int").alias("parts")
        hubs = settle(degrees.filter(F.col("degree") > per_part).select("node_id", parts))
        keys = ["node_id", "part"]
        part = F.pmod(F.xxhash64("neighbour"), F.coalesce("parts", F.lit(1))).cast("int")
        ways = ways.join(hubs, "node_id", "left").select("node_id", part.alias("part"), "neighbour")
    count = buckets or max(1, -(-rows // ROWS_PER_BUCKET), min(edges.sparkSession.sparkContext.defaultParallelism, -(-rows // 50_000)))
    name = f"adjacency_{uuid.uuid4().hex}"
    folder = path or f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}"
    if path is None:
        forget_at_end(folder)
    placed = ways.repartition(count, *keys).distinct()
    # A table's buckets are files of one task each, as rows are already dealt the way Spark deals buckets.
    placed.write.format("parquet").bucketBy(count, *keys).sortBy("node_id").option("path", folder).saveAsTable(name)
    return Adjacency(spark, name, rows, count, hubs)


def open_adjacency(spark: SparkSession, path: str, buckets: int, rows: int, hubs: DataFrame | None = None) -> Adjacency:
    """The adjacency another session wrote at `path`."""
    name = f"adjacency_{uuid.uuid4().hex}"
    columns, keys = ("node_id string, neighbour string", "node_id") if hubs is None else ("node_id string, part int, neighbour string", "node_id, part")
    spark.sql(f"create table {name} ({columns}) using parquet clustered by ({keys}) sorted by (node_id) into {buckets} buckets location '{path}'")
    return Adjacency(spark, name, rows, buckets, hubs)


def frontier_filter(frontier: DataFrame, words: int = FILTER_WORDS) -> DataFrame:
    """A Bloom filter of node ids as (word, bits): at most `words` rows, two bits a node."""
    return frontier.select(_word(words).alias("word"), _mask().alias("mask")).groupBy("word").agg(F.bit_or("mask").alias("bits"))


def _word(words: int):
    return F.pmod(F.xxhash64("node_id"), F.lit(words)).cast("int")


def _mask():
    bit = lambda seed: F.expr(f"shiftleft(1L, cast(pmod(xxhash64(node_id, {seed}), 64) as int))")
    return bit(1).bitwiseOR(bit(2))


def filtered_edges(edges: DataFrame, frontier: DataFrame, words: int = FILTER_WORDS) -> DataFrame:
    """Edges whose node may be in the frontier. They stay in their buckets: the filter is broadcast."""
    known = F.broadcast(frontier_filter(frontier, words))
    kept = edges.withColumn("word", _word(words)).join(known, "word").filter(F.col("bits").bitwiseAND(_mask()) == _mask())
    return kept.select(*edges.columns)


def _step(frontier: DataFrame, adjacency: Adjacency, filtered: bool) -> DataFrame:
    """(query_id, neighbour) of every frontier row."""
    standing = frontier
    if adjacency.hubs is not None:
        numbers = F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)
        standing = frontier.join(adjacency.hubs, "node_id", "left").withColumn("part", F.explode(numbers)).drop("parts")
    edges = filtered_edges(adjacency.edges, frontier) if filtered else adjacency.edges
    return edges.join(standing.hint("merge"), adjacency.keys).select("query_id", "neighbour")


def reach_stored(
    seeds: DataFrame,
    adjacency: Adjacency,
    hops: int = 1,
    rows_per_task: int | None = None,
    filtered_rows: int | None = None,
) -> tuple[DataFrame, int]:
    """(query_id, node_id, depth) of everything within `hops` steps of the seeds, and a bound on its rows.

    One aggregate per hop keeps the least depth of what was known and what is new, so a node comes once
    per query. Each hop is written once. A node that more queries stand on than one task should take is
    joined apart, by cutting its queries and repeating only its own edges.
    """
    per_task = rows_per_task or grouping.ROWS_PER_TASK
    known = seeds.select("query_id", "node_id", F.lit(0).alias("depth")).distinct()
    known, rows = settle_counted(known)
    for depth in range(1, hops + 1):
        frontier = known.filter(F.col("depth") == depth - 1).select("query_id", "node_id")
        new = _hop(frontier, adjacency, rows > per_task, per_task, adjacency.rows >= (filtered_rows or FILTERED_ROWS))
        reached = new.select("query_id", F.col("neighbour").alias("node_id"), F.lit(depth).alias("depth"))
        known, rows = settle_counted(known.unionByName(reached).groupBy("query_id", "node_id").agg(F.min("depth").alias("depth")))
    return known, rows


def _hop(frontier: DataFrame, adjacency: Adjacency, may_be_heavy: bool, per_task: int, filtered: bool) -> DataFrame:
    if not may_be_heavy:
        return _step(frontier, adjacency, filtered)
    crowded = settle(frontier.groupBy("node_id").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > per_task).select("node_id"))
    rest = frontier.join(crowded, "node_id", "left_anti")
    own_edges = adjacency.edges.join(crowded, "node_id", "left_semi").select("node_id", "neighbour")
    crowds = spread_join(
        frontier.join(crowded, "node_id", "left_semi"), own_edges, "node_id", ["query_id"], small_id=["neighbour"], rows_per_task=per_task
    ).select("query_id", "neighbour")
    return _step(rest, adjacency, filtered).unionByName(crowds)


@dataclass(frozen=True)
class ReachedClasses:
    """Reached nodes by class: `nodes` (node_id, class) and, once for all nodes of a class, `walks` (class, walk, depth)."""

    nodes: DataFrame
    walks: DataFrame


def reach_classes(
    starts: DataFrame, adjacency: Adjacency, hops: int = 1, rows_per_task: int | None = None, filtered_rows: int | None = None
) -> ReachedClasses:
    """What `reach_stored` finds from `starts` (walk, node_id; walks are whole numbers), with nodes of equal walks and depths as one class.

    Who reaches a node in a hop follows from its own class and those of its neighbours before the hop. So a hop
    takes classes along the edges, not walks; nodes that are told the same classes become one class, whose walks
    are worked out once. Sets of classes are compared by their size and 128 bits of hashes.
    """
    own = starts.select("node_id", F.lit(0).alias("step"), F.col("walk").alias("class"))
    each = starts.select(F.col("walk").alias("class"), "walk", F.lit(0).alias("depth")).distinct()
    reached = _classed(own, each, rows_per_task)
    for _ in range(hops):
        own = reached.nodes.select("node_id", F.lit(0).alias("step"), "class")
        standing = reached.nodes.select(F.col("class").alias("query_id"), "node_id")
        near = _step(standing, adjacency, adjacency.rows >= (filtered_rows or FILTERED_ROWS))
        near = near.select(F.col("neighbour").alias("node_id"), F.lit(1).alias("step"), F.col("query_id").alias("class"))
        reached = _classed(own.unionByName(near), reached.walks, rows_per_task)
    return reached


def _classed(told: DataFrame, walks: DataFrame, rows_per_task: int | None) -> ReachedClasses:
    """Classes of the nodes told the same (step, class), with the walks of those classes that many steps further."""
    told = settle(told.distinct())
    # No set is gathered in a row: a hub may be told of very many classes.
    marks = [F.bit_xor(F.xxhash64("class", "step")).alias("mark"), F.bit_xor(F.xxhash64("step", "class")).alias("mark_2")]
    marked, count = settle_counted(told.groupBy("node_id").agg(F.count(F.lit(1)).alias("size"), *marks))
    same = ["size", "mark", "mark_2"]
    # Numbers of any kind, but written once, so that they stay.
    one_each = marked.groupBy(*same).agg(F.min("node_id").alias("node_id"))
    classes = settle(one_each.withColumn("number", F.monotonically_increasing_id()))
    nodes = spread_join(marked, classes.drop("node_id"), same, ["node_id"], rows=count, rows_per_task=rows_per_task)
    # What one node of a class is told stands for all of them.
    parts = told.join(classes.select("node_id", "number"), "node_id").drop("node_id")
    further = product_join(parts, walks, "class", ["number", "step"], ["walk"], rows_per_task=rows_per_task)
    depths = further.groupBy(F.col("number").alias("class"), "walk").agg(F.min(F.col("depth") + F.col("step")).alias("depth"))
    return ReachedClasses(nodes.select("node_id", F.col("number").alias("class")), settle(depths))
