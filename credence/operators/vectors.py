"""Text encoding and cosine top-k over chunk embeddings.

Exact search has two physical forms with the same result. While the distinct query
vectors fit `broadcast_bytes` they travel to the corpus: a scan for each `SCAN_QUERIES` of
them, so that a task's memory does not grow with their number, and no shuffle of vectors;
each task sends on at most k rows per query. Beyond that the corpus is stored
by the leaves of a two-level tree of balls (see `vector_index`), and a query visits only
the leaves that the triangle inequality on angles cannot rule out.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from credence.config import RetrievalSettings
from credence.operators.grouping import spread_join
from credence.operators.vector_index import VectorIndex, by_leaves, probed, store_vectors
from credence.operators.vector_kernels import block_best, keep_best, no_hits, top_hits, unit_matrix
from credence.session import settle

# Query vectors that one scan of the corpus compares.
SCAN_QUERIES = 8_192

Encoder = Callable[[DataFrame, str, str], DataFrame]


def hashing_encoder(dim: int = RetrievalSettings.embedding_dim) -> Encoder:
    """Deterministic default encoder: hashed term counts, scaled to unit length.

    A model-backed encoder has the same shape: (rows, text column, output column) -> rows.
    """
    from pyspark.ml.feature import HashingTF, Normalizer, RegexTokenizer
    from pyspark.ml.functions import vector_to_array

    def encode(df: DataFrame, text: str, out: str) -> DataFrame:
        filled = df.withColumn("_text", F.coalesce(F.col(text), F.lit("")))
        words = RegexTokenizer(inputCol="_text", outputCol="_words", pattern=r"\s+").transform(filled)
        counts = HashingTF(inputCol="_words", outputCol="_tf", numFeatures=dim).transform(words)
        unit = Normalizer(inputCol="_tf", outputCol="_unit", p=2.0).transform(counts)
        return unit.withColumn(out, vector_to_array("_unit", "float32")).drop("_text", "_words", "_tf", "_unit")

    return encode


def encode_queries(requests: DataFrame, encoder: Encoder) -> tuple[DataFrame, DataFrame]:
    """Requests with a vector_id, and one embedding per distinct query text."""
    keyed = requests.withColumn("vector_id", F.md5(F.coalesce("query", F.lit(""))))
    texts = keyed.groupBy("vector_id").agg(F.min("query").alias("query"))
    return keyed, encoder(texts, "query", "embedding").select("vector_id", "embedding")


# --- exact search, queries broadcast -------------------------------------------


def _scan_with(queries: np.ndarray, spark, corpus: DataFrame, k: int, first: int = 0) -> DataFrame:
    """Top k of each task for every query; queries are numbered from `first` on."""
    shared, dim = spark.sparkContext.broadcast(queries), queries.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = None
        for batch in batches:
            if not batch.num_rows:
                continue
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            fresh = block_best(shared.value, unit_matrix(batch.column(1), dim), ids, k)
            if best is not None:
                fresh = keep_best(*[np.concatenate(pair) for pair in zip(best, fresh)], k)
            best = fresh
        if best is not None:
            yield pa.RecordBatch.from_arrays(
                [pa.array((best[0] + first).astype(np.int32)), pa.array(best[1].astype(np.int64)), pa.array(best[2])],
                names=["q", "chunk_id", "vector_score"],
            )

    return corpus.mapInArrow(run, "q int, chunk_id long, vector_score double")


def nearest(
    query_vectors: DataFrame,
    corpus: DataFrame | VectorIndex,
    k: int = RetrievalSettings.top_k,
    broadcast_bytes: int = RetrievalSettings.broadcast_bytes,
    dim: int | None = None,
) -> DataFrame:
    """(vector_id, chunk_id, vector_score, rank): the exact k most similar chunks of every query vector.

    A corpus given as an index is searched by its leaves. One given as rows is scanned if the query vectors fit
    `broadcast_bytes`, and indexed first if they do not. `dim` is their expected length; it saves a look at them.
    """
    vectors = query_vectors.select("vector_id", "embedding").filter("embedding IS NOT NULL")
    if isinstance(corpus, VectorIndex):
        return top_hits(by_leaves(vectors, corpus, k), "vector_id", k)
    spark = corpus.sparkSession
    rows = corpus.select(F.col("chunk_id").cast("long").alias("chunk_id"), "embedding").filter("embedding IS NOT NULL")
    dim = dim or _dimension(vectors)
    if dim is None:
        return no_hits(vectors)
    most = broadcast_bytes // (8 * dim)
    # One row past the bound shows that the vectors do not fit, without a separate count.
    head = vectors.limit(most + 1).toArrow()
    if not head.num_rows:
        return no_hits(vectors)
    # A dimension that was only expected bounds what was fetched, what was found bounds the rest.
    dim = len(head.column("embedding")[0])
    if head.num_rows > broadcast_bytes // (8 * dim):
        index = store_vectors(rows)
        return top_hits(by_leaves(vectors, index, k), "vector_id", k) if index else no_hits(vectors)
    matrix = unit_matrix(head.column("embedding"), dim)
    starts = range(0, len(matrix), SCAN_QUERIES)
    if len(starts) > 1:
        # Read once per scan.
        rows = settle(rows)
    scans = [_scan_with(matrix[at : at + SCAN_QUERIES], spark, rows, k, at) for at in starts]
    hits = top_hits(reduce(DataFrame.unionByName, scans), "q", k)
    names = pa.table({"q": pa.array(range(head.num_rows), pa.int32()), "vector_id": head.column("vector_id")})
    # As many rows as query vectors, and those were just bounded.
    return hits.join(F.broadcast(spark.createDataFrame(names)), "q").select(
        "vector_id", "chunk_id", "vector_score", "rank"
    )


def _dimension(rows: DataFrame) -> int | None:
    first = rows.select(F.size("embedding").alias("n")).take(1)
    return first[0]["n"] if first else None


def nearest_probed(
    query_vectors: DataFrame, corpus: DataFrame | VectorIndex, k: int = RetrievalSettings.top_k, probes: int = 8, leaves: int | None = None
) -> DataFrame:
    """Approximate top k: only the `probes` nearest leaves of each query. Quality is its recall against `nearest`."""
    vectors = query_vectors.select("vector_id", "embedding").filter("embedding IS NOT NULL")
    index = corpus if isinstance(corpus, VectorIndex) else store_vectors(corpus, leaves)
    return top_hits(probed(vectors, index, k, probes), "vector_id", k) if index else no_hits(vectors)


def recall(found: DataFrame, truth: DataFrame, keys: tuple[str, ...] = ("vector_id", "chunk_id")) -> DataFrame:
    """One row: how many of the true hits were found, of how many."""
    marked = truth.select(*keys).join(found.select(*keys, F.lit(1).alias("_hit")), list(keys), "left")
    return marked.agg(F.count("_hit").alias("found"), F.count(F.lit(1)).alias("expected")).withColumn(
        "recall", F.col("found") / F.col("expected")
    )


# --- search joined back to requests and documents ---------------------------------


def vector_search(
    requests: DataFrame,
    query_vectors: DataFrame,
    corpus: DataFrame,
    settings: RetrievalSettings = RetrievalSettings(),
    readable_by_role: DataFrame | None = None,
    rows: int | None = None,
) -> DataFrame:
    """(query_id, chunk_id, vector_score, rank) for requests (query_id, vector_id), at most `rows` of them if that is known.

    Only vectors someone asks for are searched, each once. By default the top k is taken before any role
    filter; `readable_by_role` (chunk_id, allowed_roles) asks for the filter first, in
    which case the requests also need their role; the corpus is then read once per role that asks.
    """
    if readable_by_role is None:
        asked = requests.select("query_id", "vector_id")
        wanted = query_vectors.join(asked.select("vector_id").distinct(), "vector_id", "left_semi")
        hits = nearest(wanted, corpus, settings.top_k, settings.broadcast_bytes, settings.embedding_dim)
        return spread_join(asked, hits, "vector_id", ["query_id"], rows=asked.count() if rows is None else rows).select(
            "query_id", "chunk_id", "vector_score", "rank"
        )
    parts = []
    # Whatever roles the requests name: a request without one may read nothing.
    roles = sorted(r["role"] for r in requests.select("role").distinct().collect() if r["role"] is not None)
    if not roles:
        return vector_search(requests.limit(0), query_vectors, corpus, settings, rows=0)
    for role in roles:
        open_chunks = readable_by_role.filter(F.array_contains("allowed_roles", F.lit(role))).select("chunk_id")
        asked = requests.filter(F.col("role") == role)
        readable = corpus.join(open_chunks, "chunk_id", "left_semi")
        parts.append(vector_search(asked, query_vectors, readable, settings, rows=rows))
    return reduce(DataFrame.unionByName, parts)
