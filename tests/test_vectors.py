import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from credence.config import RetrievalSettings
from credence.operators import vector_index, vector_kernels
from credence.operators import vectors as V

DIM = 8


def frame(spark, matrix, key):
    rows = [(i, [float(x) for x in row]) for i, row in enumerate(matrix)]
    return spark.createDataFrame(rows, f"{key} long, embedding array<float>").repartition(5)


def truth(queries, corpus, k):
    unit = lambda m: np.divide(m, np.linalg.norm(m, axis=1, keepdims=True), out=np.zeros_like(m), where=np.linalg.norm(m, axis=1, keepdims=True) > 0)
    scores = np.round(unit(queries.astype(np.float32).astype(float)) @ unit(corpus.astype(np.float32).astype(float)).T, 9)
    out = {}
    for q, row in enumerate(scores):
        order = sorted(range(len(row)), key=lambda i: (-row[i], i))[:k]
        for rank, i in enumerate(order, start=1):
            out[(q, rank)] = i
    return out


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(6, DIM))
    corpus = np.vstack([centres[i % 6] + 0.2 * rng.normal(size=DIM) for i in range(300)])
    corpus[100:200] = corpus[100]  # a third of the corpus is one copied vector
    corpus[7] = 0.0
    queries = np.vstack([corpus[[100, 3, 50]], rng.normal(size=(20, DIM)), np.zeros((1, DIM))])
    return queries, corpus


@pytest.mark.parametrize("limit", [64 * 1024 * 1024, 0])
def test_exact_search_in_both_forms(spark, data, limit, monkeypatch):
    monkeypatch.setattr(vector_index, "SLICE_ROWS", 40)
    monkeypatch.setattr(vector_index, "BLOCK_ROWS", 4)
    queries, corpus = data
    hits = V.nearest(frame(spark, queries, "vector_id"), frame(spark, corpus, "chunk_id"), 5, limit)
    assert {(r.vector_id, r["rank"]): r.chunk_id for r in hits.collect()} == truth(queries, corpus, 5)


@pytest.mark.parametrize("limit", [64 * 1024 * 1024, 0])
def test_fewer_rows_than_k(spark, data, limit):
    queries, corpus = data
    hits = V.nearest(frame(spark, queries[:3], "vector_id"), frame(spark, corpus[:2], "chunk_id"), 5, limit)
    assert {(r.vector_id, r["rank"]): r.chunk_id for r in hits.collect()} == truth(queries[:3], corpus[:2], 5)


@pytest.mark.parametrize("limit", [64 * 1024 * 1024, 0])
def test_empty_sides(spark, data, limit):
    queries, corpus = frame(spark, data[0], "vector_id"), frame(spark, data[1], "chunk_id")
    assert V.nearest(queries.limit(0), corpus, 3, limit).count() == 0
    assert V.nearest(queries, corpus.limit(0), 3, limit).count() == 0


def test_wrong_length_raises(spark, data):
    with pytest.raises(Exception, match="length 8"):
        V.nearest(frame(spark, data[0], "vector_id"), frame(spark, data[1][:, :5], "chunk_id"), 3).collect()


def test_probed_search_recall(spark, data):
    queries, corpus = frame(spark, data[0][:23], "vector_id"), frame(spark, data[1], "chunk_id")
    exact = V.nearest(queries, corpus, 5)
    all_cells = V.nearest_probed(queries, corpus, 5, probes=16, leaves=16)
    assert V.recall(all_cells, exact).first()["recall"] == 1.0
    some = V.recall(V.nearest_probed(queries, corpus, 5, probes=4, leaves=16), exact).first()
    assert some["expected"] == 115 and some["recall"] > 0.6


def test_hashing_encoder(spark):
    df = spark.createDataFrame([(1, "риск выручка риск"), (2, "риск выручка риск"), (3, "закон"), (4, None)], "id int, t string")
    rows = {r.id: r.e for r in V.hashing_encoder(384)(df, "t", "e").collect()}
    assert rows[1] == rows[2] != rows[3] and all(len(v) == 384 for v in rows.values())
    assert abs(np.linalg.norm(rows[1]) - 1) < 1e-6 and sorted(x for x in rows[1] if x)[-1] == pytest.approx(2 / 5**0.5)
    assert not any(rows[4])


def test_equal_queries_share_a_vector(spark, data):
    requests = spark.createDataFrame([(1, "a b"), (2, "a b"), (3, "c")], "query_id int, query string")
    keyed, vectors = V.encode_queries(requests, V.hashing_encoder(16))
    assert vectors.count() == 2 and keyed.select("vector_id").distinct().count() == 2


def test_search_per_request_and_by_role(spark, data):
    queries, corpus = data
    requests = spark.createDataFrame(
        [(10, 3, "analyst"), (11, 3, "risk_manager"), (12, 4, "analyst")], "query_id int, vector_id long, role string"
    )
    vectors, rows = frame(spark, queries, "vector_id"), frame(spark, corpus, "chunk_id")
    settings = RetrievalSettings(top_k=3)
    want = truth(queries, corpus, 3)
    hits = V.vector_search(requests, vectors, rows, settings).collect()
    assert {(r.query_id, r["rank"]): r.chunk_id for r in hits} == {
        (q, rank): want[(v, rank)] for q, v in ((10, 3), (11, 3), (12, 4)) for rank in (1, 2, 3)
    }
    best = want[(3, 1)]
    roles = rows.select(
        "chunk_id",
        F.when(F.col("chunk_id") == best, F.array(F.lit("risk_manager")))
        .otherwise(F.array(F.lit("analyst"), F.lit("risk_manager"))).alias("allowed_roles"),
    )
    first = V.vector_search(requests, vectors, rows, settings, roles).filter("rank = 1").collect()
    top = {r.query_id: r.chunk_id for r in first}
    assert top[11] == best and top[10] == want[(3, 2)]


@pytest.mark.parametrize("k", [1, 3, 10])
def test_near_copies_across_leaf_borders(spark, k):
    """Scores that tie to nine digits, on both sides of the borders between leaves: all forms agree."""
    rng = np.random.default_rng(11)
    base = rng.normal(size=(35, 3))
    corpus = np.repeat(base, 10, axis=0) + 3e-6 * rng.normal(size=(350, 3))
    corpus = corpus[rng.permutation(350)]
    queries = np.vstack([base + 1e-6 * rng.normal(size=base.shape), rng.normal(size=(65, 3))])
    asked, rows = frame(spark, queries, "vector_id"), frame(spark, corpus, "chunk_id")
    both = [
        {(r.vector_id, r["rank"]): r.chunk_id for r in V.nearest(asked, rows, k, limit).collect()}
        for limit in (64 * 1024 * 1024, 0)
    ]
    index = V.store_vectors(rows, leaves=60)
    assert both[0] == both[1] == {(r.vector_id, r["rank"]): r.chunk_id for r in V.nearest(asked, index, k).collect()}
    read = vector_index.share_read(asked, index, k).first()
    assert 0 < read["compared"] < 0.9 * read["scanned"] == 0.9 * 350 * 100


def test_a_search_leaves_the_corpus_in_place(spark, data):
    queries, corpus = frame(spark, data[0], "vector_id"), frame(spark, data[1], "chunk_id")
    index = V.store_vectors(corpus)
    assert len(index.pivots) == 17 and len(index.tops) == 4 and index.rows.sum() == 300
    visits = vector_index._visits(queries, index, lambda index, unit, _: (np.arange(len(unit)), vector_index._home(index, unit)))
    plan = vector_index._search(visits, index, 3)._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("simple"))
    assert "Bucketed: true" in plan and plan.count("Exchange hashpartitioning") == 1


def test_a_query_is_dealt_once_to_each_place(spark, data, monkeypatch):
    """Not once to each leaf: leaves share places."""
    monkeypatch.setattr(vector_index, "PENDING_HITS", 3)
    queries, corpus = frame(spark, data[0], "vector_id"), frame(spark, data[1], "chunk_id")
    index = V.store_vectors(corpus, leaves=60)
    everywhere = lambda index, unit, _: tuple(a.ravel() for a in np.indices((len(unit), len(index.pivots))))
    visits = vector_index._visits(queries, index, everywhere)
    places = index.corpus.select("place").distinct().count()
    assert visits.count() <= len(data[0]) * len(set(index.places.tolist())) and places <= 17 < 60
    hits = V.top_hits(vector_index._search(visits, index, 5), "vector_id", 5)
    assert {(r.vector_id, r["rank"]): r.chunk_id for r in hits.collect()} == truth(*data, 5)


def test_scans_take_few_queries_each(spark, data, monkeypatch):
    """A task holds no more than `SCAN_QUERIES` query vectors, however many there are."""
    monkeypatch.setattr(V, "SCAN_QUERIES", 5)
    held, scan = [], V._scan_with
    monkeypatch.setattr(V, "_scan_with", lambda queries, *rest: held.append(len(queries)) or scan(queries, *rest))
    queries, corpus = data
    hits = V.nearest(frame(spark, queries, "vector_id"), frame(spark, corpus, "chunk_id"), 5)
    assert {(r.vector_id, r["rank"]): r.chunk_id for r in hits.collect()} == truth(queries, corpus, 5)
    assert max(held) <= 5 and sum(held) == len(queries)


def test_scores_of_large_batches_are_bounded(data, monkeypatch):
    """More rows mean fewer queries at once, not more scores."""
    queries, corpus = (V.unit_matrix(pa.array(m.tolist(), pa.list_(pa.float64())), DIM) for m in data)
    sizes, partition = [], np.partition
    monkeypatch.setattr(np, "partition", lambda a, *args, **kwargs: sizes.append(a.size) or partition(a, *args, **kwargs))
    monkeypatch.setattr(vector_kernels, "SCORES", 1000)
    q, ids, _ = V.block_best(queries, corpus, np.arange(len(corpus)), 5)
    want = truth(*data, 5)
    assert max(sizes) <= 1000 and list(zip(q.tolist(), ids.tolist())) == [(i, want[(i, r)]) for i in range(len(queries)) for r in range(1, 6)]


def test_filter_first_serves_any_role(spark, data):
    queries, corpus = data
    vectors, rows = frame(spark, queries, "vector_id"), frame(spark, corpus, "chunk_id")
    requests = spark.createDataFrame(
        [(1, 3, "auditor"), (2, 3, None), (3, 4, "analyst")], "query_id int, vector_id long, role string"
    )
    roles = rows.select("chunk_id", F.array(F.lit("auditor")).alias("allowed_roles"))
    hits = V.vector_search(requests, vectors, rows, RetrievalSettings(top_k=3), roles).collect()
    assert sorted((r.query_id, r["rank"]) for r in hits) == [(1, 1), (1, 2), (1, 3)]
