import random

import pytest
from pyspark.sql import functions as F

from credence.operators import adjacency, graph, grouping
from credence.operators.adjacency import both_ways, frontier_filter, open_adjacency, reach_classes, reach_stored, store_adjacency
from credence.operators.graph import expand, graph_chunks, reach, seed_nodes
from credence.sources.seeds import demo_bundle

INN = "7700000001"


@pytest.fixture(scope="module")
def demo(spark):
    return {name: df.cache() for name, df in demo_bundle(spark, INN).items()}


def seeds(spark, *external):
    return seed_nodes(spark.createDataFrame([(1, e) for e in external], "query_id int, external_id string"))


def ids(df):
    return {r.node_id for r in df.collect()}


def corpus(demo):
    chunk = demo["chunks"].select(
        F.substring("external_id", 4, 3).cast("long").alias("chunk_id"), "external_id",
        F.col("document_external_id").alias("document_id"),
    )
    return chunk, demo["documents"].select(F.col("external_id").alias("document_id"), "external_id")


def test_demo_graph_links_company_and_chunks(demo):
    nodes = demo["graph_nodes"]
    assert nodes.count() == 9 and demo["graph_edges"].count() == 6
    assert nodes.filter("node_type = 'Company'").count() == 1
    policy = nodes.filter("node_id = 'document:policy_001'").first()
    assert policy.metadata == {"security_level": "internal"} and policy.label.startswith("Внутренняя")


def test_zero_hops_return_the_seed(spark, demo):
    found = expand(seeds(spark, "ch_002"), demo["graph_nodes"], demo["graph_edges"], hops=0)
    assert ids(found) == {"chunk:ch_002"}
    rows = graph_chunks(found, *corpus(demo)).collect()
    assert [(r.chunk_id, r.stage, r.graph_score) for r in rows] == [(2, 1, 1.0)]


def test_one_hop(spark, demo):
    found = expand(seeds(spark, "ch_002"), demo["graph_nodes"], demo["graph_edges"], hops=1)
    assert ids(found) == {"chunk:ch_002", "document:policy_001", "risk_factor:revenue_drop", f"company:{INN}"}
    rows = {(r.chunk_id, r.graph_score) for r in graph_chunks(found, *corpus(demo)).collect()}
    assert rows == {(2, 1.0), (2, 0.8)}


def test_two_hops_reach_the_linked_document(spark, demo):
    found = expand(seeds(spark, "ch_002"), demo["graph_nodes"], demo["graph_edges"], hops=2)
    assert "document:law_001" in ids(found)
    assert {r.node_id: r.depth for r in found.collect()}["document:law_001"] == 2


@pytest.mark.parametrize("rows_per_task", [2, 1_000_000])
def test_queries_with_equal_seeds_are_walked_once(spark, demo, monkeypatch, rows_per_task):
    monkeypatch.setattr(grouping, "ROWS_PER_TASK", rows_per_task)
    walked = []
    monkeypatch.setattr(graph, "reach_stored", lambda *args: walked.append(reach_stored(*args)) or walked[-1])
    rows = [(q, e) for q in (1, 2, 3, None) for e in ("ch_002", "ch_003")] + [(4, "ch_002"), (4, "ch_002")]
    several = seed_nodes(spark.createDataFrame(rows, "query_id int, external_id string"))
    found = expand(several, demo["graph_nodes"], demo["graph_edges"], 2).collect()
    nodes = lambda *external: {(r.node_id, r.label, r.depth) for r in expand(seeds(spark, *external), demo["graph_nodes"], demo["graph_edges"], 2).collect()}
    both, one = nodes("ch_002", "ch_003"), nodes("ch_002")
    assert sorted((str(r.query_id), r.node_id, r.label, r.depth) for r in found) == sorted(
        [(str(q), *n) for q in (1, 2, 3, None) for n in both] + [("4", *n) for n in one]
    )
    assert walked[0][0].count() == len(both) + len(one)


@pytest.mark.parametrize("hops, rows_per_task, broadcast, filtered_rows", [(2, 1_000_000, 1_000_000, 1_000_000), (3, 3, 1_000_000, 1), (3, 5, 0, 1_000_000)])
def test_expansion_by_classes_equals_the_walk(spark, monkeypatch, hops, rows_per_task, broadcast, filtered_rows):
    """Two hubs, cycles, several seeds, equal seeds, a null query, seeds without edges, and a node table with gaps and copies."""
    monkeypatch.setattr(adjacency, "FILTERED_ROWS", filtered_rows)
    random.seed(5)
    pairs = [("n0", f"n{i}") for i in range(2, 16)] + [("n1", f"n{i}") for i in range(10, 24)]
    pairs += [(f"n{random.randrange(40)}", f"n{random.randrange(40)}") for _ in range(20)]
    edges = spark.createDataFrame([(a, b, "MENTIONS") for a, b in pairs], SOME_EDGES)
    start = [(q, f"n{q}") for q in range(2, 20)] + [(30, "n0"), (31, "n3"), (32, "n3"), (32, "n11"), (33, "n11"), (33, "n3"), (None, "n12"), (34, "lost")]
    start = spark.createDataFrame(start, "query_id int, node_id string")
    nodes = spark.createDataFrame(
        [(f"n{i}", "Chunk", f"label {i}", "chunk", str(i)) for i in range(40) if i % 7 != 6] + [("n4", "Chunk", "again", "chunk", "4"), ("lost", None, None, None, None)],
        "node_id string, node_type string, label string, ref_table string, ref_id string",
    )
    want = sorted(map(str, expand(start, nodes, edges, hops).collect()))
    monkeypatch.setattr(grouping, "ROWS_PER_TASK", rows_per_task)
    monkeypatch.setattr(graph, "CLASSED_PAIRS", 0)
    monkeypatch.setattr(graph, "BROADCAST_QUERIES", broadcast)
    monkeypatch.setattr(graph, "reach_stored", None)
    assert sorted(map(str, expand(start, nodes, edges, hops).collect())) == want and len(want) > 200


def test_nodes_with_equal_walks_are_one_class(spark):
    """Many queries that meet at a hub: one row a query for all other nodes around it, not one for each of them."""
    star = spark.createDataFrame([("hub", f"m{i}", "MENTIONS") for i in range(200)], SOME_EDGES)
    starts = spark.createDataFrame([(q, f"m{q}") for q in range(20)], "walk long, node_id string")
    reached = reach_classes(starts, store_adjacency(star), 2)
    # The hub, the nodes where no query starts, and twenty where one does.
    assert reached.nodes.count() == 201 and reached.nodes.select("class").distinct().count() == 22
    assert reached.walks.count() == 22 * 20
    rows = reached.nodes.join(reached.walks, "class").groupBy("depth").count().collect()
    assert {r.depth: r["count"] for r in rows} == {0: 20, 1: 20, 2: 20 * 199}


def test_edge_types_limit_the_walk(spark, demo):
    found = expand(seeds(spark, "ch_002"), demo["graph_nodes"], demo["graph_edges"], 1, ["BELONGS_TO"])
    assert ids(found) == {"chunk:ch_002", "document:policy_001"}


def test_legal_acts_lead_to_no_chunks(spark, demo):
    found = expand(seeds(spark, "ch_001"), demo["graph_nodes"], demo["graph_edges"], 1)
    assert "legal_act:banking_law" in ids(found)
    assert {r.chunk_id for r in graph_chunks(found, *corpus(demo)).collect()} == {1}


def test_no_external_id_gives_nothing(spark, demo):
    none = seeds(spark, None, "")
    assert none.count() == 0
    assert expand(none, demo["graph_nodes"], demo["graph_edges"]).count() == 0


def test_unknown_seed_is_walked_but_not_returned(spark, demo):
    edges = demo["graph_edges"].limit(1).select(
        F.lit("chunk:lost").alias("source_node_id"), F.lit("document:law_001").alias("target_node_id"),
        F.lit("MENTIONS").alias("edge_type"),
    )
    assert ids(expand(seeds(spark, "lost"), demo["graph_nodes"], edges)) == {"document:law_001"}


@pytest.mark.parametrize("rows_per_task, filtered_rows", [(5, 1), (1, 1_000_000), (1_000_000, 1_000_000)])
def test_breadth_first_equals_path_search(spark, monkeypatch, rows_per_task, filtered_rows):
    """A hub graph with cycles, loops and double edges, against paths listed one by one; with hubs and frontiers cut, and edges filtered."""
    monkeypatch.setattr(grouping, "ROWS_PER_TASK", rows_per_task)
    monkeypatch.setattr(adjacency, "FILTERED_ROWS", filtered_rows)
    random.seed(11)
    pairs = [(0, i) for i in range(1, 20)] + [(random.randrange(30), random.randrange(30)) for _ in range(40)]
    pairs += [(5, 5), pairs[0], tuple(reversed(pairs[1]))]
    kinds = ["BELONGS_TO", "MENTIONS", "SUPERSEDES"]
    edges = [(f"n{a}", f"n{b}", kinds[i % 3]) for i, (a, b) in enumerate(pairs)]
    near = {}
    for a, b, kind in edges:
        if kind != "SUPERSEDES":
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    start = [(1, "n1"), (1, "n7"), (2, "n25"), (3, "n0")]
    want = {}
    for query, node in start:
        paths = [(node,)]
        for depth in range(4):
            for path in paths:
                key = (query, path[-1])
                want[key] = min(want.get(key, depth), depth)
            paths = [p + (n,) for p in paths for n in near.get(p[-1], ()) if n not in p]
    edge_df = spark.createDataFrame(edges, "source_node_id string, target_node_id string, edge_type string")
    got = reach(spark.createDataFrame(start, "query_id int, node_id string"), edge_df, 3)
    rows = got.collect()
    assert {(r.query_id, r.node_id): r.depth for r in rows} == want and len(rows) == len(want)


def test_neighbours_go_both_ways(spark):
    edges = spark.createDataFrame([("a", "b", "MENTIONS"), ("a", "c", "OTHER")], "source_node_id string, target_node_id string, edge_type string")
    assert {tuple(r) for r in both_ways(edges).collect()} == {("a", "b"), ("b", "a")}


SOME_EDGES = "source_node_id string, target_node_id string, edge_type string"


def ring(spark, size):
    return spark.range(size).selectExpr("concat('n', id) as source_node_id", f"concat('n', (id * 7 + 1) % {size}) as target_node_id", "'MENTIONS' as edge_type")


def test_a_hop_leaves_the_edges_in_place(spark):
    """Only rows that carry a query are shuffled; the edge table is read by its buckets."""
    frontier = spark.createDataFrame([(1, "n1"), (2, "n2999")], "query_id int, node_id string")
    hub = spark.createDataFrame([("n1", f"m{i}", "MENTIONS") for i in range(50)], SOME_EDGES)
    plain, cut = store_adjacency(ring(spark, 3000), buckets=4), store_adjacency(ring(spark, 3000).unionAll(hub), buckets=4, rows_per_part=20)
    assert (plain.rows, plain.edges.count(), cut.edges.count()) == (6000, 6000, 6100)
    assert cut.edges.filter("node_id = 'n1'").select("part").distinct().count() == cut.hubs.first()["parts"] == 3
    for stored, filtered in ((plain, False), (plain, True), (cut, False), (cut, True)):
        plan = adjacency._step(frontier, stored, filtered)._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("simple"))
        shuffles = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
        assert "Bucketed: true" in plan and "Bucketed: false (d" not in plan and len(shuffles) <= 2 + filtered
        assert not any("neighbour" in line for line in shuffles)


def test_two_hops_take_few_jobs(spark):
    stored = store_adjacency(ring(spark, 500), buckets=4)
    start = spark.createDataFrame([(q, f"n{q}") for q in range(20)], "query_id int, node_id string").distinct()
    spark.sparkContext.setJobGroup("hops", "two hops")
    found, rows = reach_stored(start, stored, 2)
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert rows == found.count()
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("hops")) <= 8  # two of them for the seeds


def test_frontier_filter_misses_nothing(spark):
    nodes = spark.range(2000).selectExpr("concat('n', id) as node_id")
    edges = spark.range(20_000).selectExpr("concat('n', id) as node_id", "0 as part", "'x' as neighbour")
    kept = {r.node_id for r in adjacency.filtered_edges(edges, nodes, 4096).collect()}
    assert {f"n{i}" for i in range(2000)} <= kept and len(kept) < 3000
    assert frontier_filter(nodes, 64).count() <= 64


def test_adjacency_of_another_session(spark, tmp_path):
    stored = store_adjacency(ring(spark, 100), path=str(tmp_path / "adjacency"), buckets=3)
    again = open_adjacency(spark, str(tmp_path / "adjacency"), 3, stored.rows)
    start = spark.createDataFrame([(1, "n5")], "query_id int, node_id string")
    assert sorted(reach_stored(start, again, 2)[0].collect()) == sorted(reach_stored(start, stored, 2)[0].collect())


def test_an_empty_graph(spark):
    none = spark.createDataFrame([], SOME_EDGES)
    start = spark.createDataFrame([(1, "n5"), (1, "n5")], "query_id int, node_id string")
    assert [tuple(r) for r in reach(start, none, 2).collect()] == [(1, "n5", 0)]
