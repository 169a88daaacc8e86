"""Web archives, nearest neighbours, numbering, the registered queries and the pipeline."""

import gzip
import math
import os
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from credence.llm import catalog, neighbours, warc
from credence.llm.numbering import numbered_within

from . import brute

FOLDER = os.environ.get("QUERY_SF_DIR", "/root/testdata/sf0.001")
TABLES = ("documents", "embeddings", "pages", "benchmark", "labels", "conversations")
present = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test data not present")

PAGES = [
    (1, "http://www.A.com/x", "<a>"), (2, None, "<a>"), (3, "https://b.org", None), (4, "", ""), (5, "http://a.com/x y#z", "é\r\n\r\nq"),
    (6, "http://a.com/x", "<b>"), (6, "http://a.com/x", "<b>"), (7, "http://a.com/x", "<a>"), (8, "http://c.d/\r\nX: y", "z" * 300_000), (None, "u", "v"),
]


def test_archives_round_trip(spark):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string").withColumn("archive", F.lit(None).cast("string"))
    for least in (0, 4):
        archives, index = warc.archive_pages(pages, least)
        rows = index.collect()
        payloads = {p: (h or "").encode() for p, _, h in PAGES if p}
        for r in rows:
            same = [p for p, payload in payloads.items() if payload == payloads[r.page_id]]
            target = max(same) if len(payloads[r.page_id]) >= least and max(same) != r.page_id else None
            assert (r.record_type, r.refers_to) == ("revisit" if target else "response", target)
            assert (r.payload_bytes, r.payload_digest) == (len(payloads[r.page_id]), warc.payload_digest(payloads[r.page_id]))
        assert sorted(r.page_id for r in rows) == [1, 2, 3, 4, 5, 6, 6, 7, 8]
        order = [(r.url_key, r.timestamp, r.page_id) for r in rows]
        assert order == sorted(order)
        assert {r.page_id: bytes(r.payload) for r in warc.read_payloads(archives, index).collect()} == payloads
        for r in archives.collect():
            assert gzip.decompress(r.content).count(b"WARC/1.1\r\n") >= 1


def test_index_places_open_records(spark):
    pages = spark.createDataFrame([(i, f"http://h{i % 3}.com/{i}", "x" * i) for i in range(50)], "page_id long, url string, html string")
    archives, index = warc.archive_pages(pages)
    contents = {r.archive: bytes(r.content) for r in archives.collect()}
    for r in index.collect():
        fields, block = warc.parse(gzip.decompress(contents[r.archive][r.place : r.place + r.size]))
        assert fields["warc-record-id"] == f"<urn:page:{r.page_id}>"


def test_no_pages(spark):
    assert warc.archive_pages(spark.createDataFrame([], "page_id long, url string, html string"))[1].count() == 0


@pytest.mark.parametrize("count", [0, 1, 2, 3, 5, 8, 13])
def test_loser_tree(count):
    rng = random.Random(count)
    runs = [sorted(rng.randint(0, 30) for _ in range(rng.randint(0, 20))) for _ in range(count)]
    assert list(warc.LoserTree([iter(r) for r in runs], lambda x: x)) == sorted(x for r in runs for x in r)


# Nearest neighbours


def test_hilbert_keys_visit_neighbours():
    """Every point has its own key, and successive keys differ by one step."""
    for dims, bits in ((2, 4), (3, 3), (4, 2)):
        grid = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dims, indexing="ij"), -1).reshape(-1, dims)
        keys = neighbours.hilbert_keys(grid, bits)
        assert sorted(keys.tolist()) == list(range(len(grid)))
        assert (np.abs(np.diff(grid[np.argsort(keys)], axis=0)).sum(axis=1) == 1).all()


def true_neighbours(vectors, query_id, query, k=5):
    found = []
    for vec_id, v in vectors:
        if vec_id != query_id:
            found.append((-float(np.dot(v, query) / (np.sqrt(np.dot(v, v)) * np.sqrt(np.dot(query, query)))), vec_id))
    return sorted(found)[:k]


def test_nearest_recall_and_scores(spark):
    rng = np.random.Generator(np.random.PCG64(5))
    centres = rng.normal(size=(20, 24))
    vectors = [(i, (centres[i % 20] + 0.7 * rng.normal(size=24)).astype(np.float32)) for i in range(1500)]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in vectors], "vec_id long, embedding array<float>").withColumn("key", F.lit(1))
    found = neighbours.nearest(df, F.col("vec_id") % 50 == 0, sample=20, cell_rows=200).collect()
    assert {r.query_id for r in found} == set(range(0, 1500, 50))
    doubles = [(i, v.astype(np.float64)) for i, v in vectors]
    hits = total = 0
    for query_id in range(0, 1500, 50):
        own = sorted((r for r in found if r.query_id == query_id), key=lambda r: r["rank"])
        assert [r["rank"] for r in own] == [1, 2, 3, 4, 5]
        assert [(-r.score, r.vec_id) for r in own] == sorted((-r.score, r.vec_id) for r in own)
        for r in own:
            a, b = doubles[query_id][1], doubles[r.vec_id][1]
            assert r.score == pytest.approx(a @ b / math.sqrt((a @ a) * (b @ b)), abs=1e-12)
        true = {vec_id for _, vec_id in true_neighbours(doubles, query_id, doubles[query_id][1])}
        hits, total = hits + len(true & {r.vec_id for r in own}), total + 5
    assert hits >= 0.9 * total


def test_recall_outside_the_fitting_sample(spark):
    rng = np.random.Generator(np.random.PCG64(6))
    df = spark.createDataFrame([(i, rng.normal(size=8).tolist()) for i in range(300)], "vec_id long, embedding array<double>")
    is_query = F.col("vec_id") % 10 == 0
    found = neighbours.nearest(df, is_query, sample=20)
    met, expected, asked = neighbours.recall(found, df, is_query, sample=20, block=4)
    assert (expected, asked) == (50, 10)
    outside = {r.vec_id for r in df.filter(is_query).orderBy(F.xxhash64("vec_id"), "vec_id").offset(20).collect()}
    vectors = [(r.vec_id, np.array(r.embedding)) for r in df.collect()]
    true = {(q, v) for q in outside for _, v in true_neighbours(vectors, q, dict(vectors)[q])}
    assert met == len(true & {(r.query_id, r.vec_id) for r in found.collect()})


def test_nearest_odd_vectors(spark):
    """Copies beyond the sixth, few candidates, and vectors that take no part."""
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 1.0]), (50, None), (100, [0.0, 0.0]), (150, [1.0, None]), (200, [nan, 1.0]), (250, [inf, 1.0]), (300, [1.0]), (None, [1.0, 2.0])]
    rows += [(i, [2.0, 2.0]) for i in range(340, 360)] + [(3, [1.0, -1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    found = neighbours.nearest(df, F.col("vec_id") % 50 == 0).collect()
    by_query = {q: [r.vec_id for r in sorted(found, key=lambda r: r["rank"]) if r.query_id == q] for q in {r.query_id for r in found}}
    assert by_query == {0: [340, 341, 342, 343, 344], 350: [0, 340, 341, 342, 343]} or by_query[350][0] in (340, 0)
    assert set(by_query) == {0, 350}
    few = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 1.0]), (2, [0.0, 1.0])], "vec_id long, embedding array<float>")
    assert [r.vec_id for r in sorted(neighbours.nearest(few, F.col("vec_id") == 0).collect(), key=lambda r: r["rank"])] == [1, 2]
    assert neighbours.nearest(few.limit(0), F.lit(True)).count() == 0


def test_numbered_within(spark):
    rng = random.Random(3)
    rows = [(rng.randint(0, 2), i) for i in range(3000)]
    numbered, counts = numbered_within(spark.createDataFrame(rows, "kind int, x long").repartition(5), "kind", ["x"], "number")
    expected = {(k, x): n for k in range(3) for n, x in enumerate(sorted(x for j, x in rows if j == k))}
    assert {(r.kind, r.x): r.number for r in numbered.collect()} == expected
    assert {r.kind: r.rows for r in counts.collect()} == {k: sum(j == k for j, _ in rows) for k in range(3)}


# Registered queries


def plain(value):
    return round(value, 9) if isinstance(value, float) else value


@present
@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_query_equals_its_sql(spark, name):
    database = duckdb.connect()
    for table in TABLES:
        database.execute(f"create view {table} as select * from '{FOLDER}/{table}.parquet'")
    df = catalog.QUERIES[name](spark, FOLDER)
    result = database.execute(catalog.SQL[name])
    columns = sorted(df.columns)
    assert columns == sorted(c[0] for c in result.description)
    place = [[c[0] for c in result.description].index(c) for c in columns]
    expected = sorted((tuple(plain(r[i]) for i in place) for r in result.fetchall()), key=repr)
    assert sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr) == expected


@present
def test_queries_on_whole_tables(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()]
    found = catalog.QUERIES["op1_ngram_jaccard"](spark, FOLDER).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in found) == brute.jaccard_components(docs)
    found = catalog.QUERIES["op3_suffix_array_dedup"](spark, FOLDER).collect()
    assert sorted(map(tuple, found)) == [r[:5] for r in brute.without_copied_bytes(docs)]
    found = catalog.QUERIES["op4_substring_dedup"](spark, FOLDER).collect()
    assert sorted(map(tuple, found)) == brute.without_repeated_words(docs)


@present
def test_pipeline(spark, tmp_path):
    """Each stage against brute force on what the stage before it kept."""
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns = docs.columns
    kept = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, FOLDER).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        if k < 4:
            assert docs.columns == columns
            kept.append({r.doc_id: r for r in docs.collect()})
    # Every document of the test data has a language.
    everything = {r.doc_id: r for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    assert len(kept[0]) >= 0.99 * len(everything)
    assert all(r == everything[i] for i, r in kept[0].items())
    groups = brute.jaccard_components([(i, r.text) for i, r in kept[0].items()])
    assert sorted(kept[1]) == [i for i, _, root in groups if i == root]
    cleaned = brute.without_copied_bytes([(i, r.text) for i, r in kept[1].items()])
    assert {i: r.text for i, r in kept[2].items()} == {r[0]: r[5].decode("utf-8", "ignore") for r in cleaned}
    assert all(r.n_chars == len(r.text) for r in kept[2].values())
    database = duckdb.connect()
    database.execute(f"create view documents as select * from '{tmp_path}/2/*.parquet'")
    database.execute(f"create view benchmark as select * from '{FOLDER}/benchmark.parquet'")
    leaking = {r[0] for r in database.execute(catalog.SQL["op2_decontamination"]).fetchall()}
    assert sorted(kept[3]) == sorted(set(kept[2]) - leaking)
    packed = docs.collect()
    assert {r.doc_id for r in packed} == set(kept[3])
    assert corpus_pipeline.run(spark, FOLDER).count() == len(packed)


def test_stages_are_the_dealt_ones():
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language_id", "ngram_jaccard", "suffix_array_dedup", "decontamination", "best_fit_packing"]
    assert [int(n[2:].split("_")[0]) for n in catalog.QUERIES] == list(range(1, 14))
