import pytest
from pyspark.sql import functions as F

from credence.operators.documents import split_documents
from credence.operators.ranking import accessible, dedupe_chunks, final_score, merge_context, rerank, rrf


def test_dedupe_and_rerank(spark):
    rows = [(1, 1, 0, 1, 0.5, 0.0), (1, 1, 0, 2, 0.9, 0.0), (1, 2, 0, 3, 0.3, 1.0), (1, None, 0, 4, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "query_id int, chunk_id long, stage int, place long, vector_score double, graph_score double")
    ranked = rerank(dedupe_chunks(df)).orderBy("rank").collect()
    assert [(r.chunk_id, r.final_score) for r in ranked] == [(2, 0.8), (1, 0.5)]


def test_ties_keep_their_order(spark):
    rows = [(1, c, 1, c, 0.0, 1.0) for c in (200_000, 9, 70_000, 5)] + [(1, 1, 0, 1, 0.5, 0.0)]
    df = spark.createDataFrame(rows, "query_id int, chunk_id long, stage int, place long, vector_score double, graph_score double")
    assert [r.chunk_id for r in rerank(df).orderBy("rank").collect()] == [1, 5, 9, 70_000, 200_000]


def test_final_score_rounds_half_to_even_and_reads_null_as_zero(spark):
    df = spark.createDataFrame([(0.1234565, 0.0), (None, 0.8), (0.2, None)], "v double, g double")
    assert [r.s for r in df.select(final_score(F.col("v"), F.col("g")).alias("s")).collect()] == [0.123456, 0.4, 0.2]


def test_seeds_keep_their_vector_row(spark):
    hits = spark.createDataFrame([(1, 7, 0.9, 1)], "query_id int, chunk_id long, vector_score double, rank long")
    graph = spark.createDataFrame([(1, 7, 1, 1.0), (1, 8, 2, 0.8), (1, 8, 1, 1.0)], "query_id int, chunk_id long, stage int, graph_score double")
    rows = {r.chunk_id: (r.source, r.vector_score, r.graph_score) for r in merge_context(hits, graph).collect()}
    assert rows == {7: ("vector", 0.9, 0.0), 8: ("graph", 0.0, 1.0)}


def test_role_filter_denies_null_and_empty(spark):
    rows = [(1, "analyst", ["analyst", "risk_manager"]), (2, "analyst", ["risk_manager"]), (3, "analyst", []),
            (4, "analyst", None), (5, "risk_manager", ["risk_manager"])]
    df = spark.createDataFrame(rows, "chunk_id int, role string, allowed_roles array<string>")
    assert {r.chunk_id for r in accessible(df).collect()} == {1, 5}


def test_rank_fusion(spark):
    schema = "query_id int, chunk_id long, rank int"
    dense = spark.createDataFrame([(1, 10, 1), (1, 11, 2)], schema)
    graph = spark.createDataFrame([(1, 11, 1), (1, 12, 2)], schema)
    rows = [(r.chunk_id, r.rrf_score) for r in rrf(dense, graph).orderBy("rank").collect()]
    assert rows == [(11, round(1 / 62 + 1 / 61, 9)), (10, round(1 / 61, 9)), (12, round(1 / 62, 9))]


@pytest.mark.parametrize("size, overlap", [(10, 0), (10, 3), (7, 6), (50, 0)])
def test_split_documents(spark, size, overlap):
    texts = {1: "абвгдежзик" * 4 + "\nl", 2: "", 3: "x", 4: "😀y\n" * 13, 5: None, 6: "z" * 10}
    df = spark.createDataFrame(list(texts.items()), "id int, text string")
    got = {}
    for r in split_documents(df, size, overlap).collect():
        got.setdefault(r.id, {})[r.chunk_order] = r.chunk_text
    want = {}
    for key, text in texts.items():
        if not text:
            continue
        parts, at = [], 0
        while at == 0 or at + overlap < len(text):
            parts.append(text[at : at + size])
            at += size - overlap
        want[key] = dict(enumerate(parts))
    assert got == want


def test_split_rejects_full_overlap(spark):
    with pytest.raises(ValueError):
        split_documents(spark.range(1), 5, 5)
