"""Scores and top k of blocks of vectors, over Arrow batches."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Scores equal to this many digits count as ties; the lower chunk id goes first.
TIE_DIGITS = 9
QUERY_BLOCK = 512
# Scores computed at once: 4 MB of them, several times over while the best are picked.
SCORES = 1 << 19


def unit_matrix(column: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    """Rows scaled to unit length in float64; zero vectors stay zero."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    lengths = np.diff(column.offsets.to_numpy())
    if (lengths != dim).any():
        raise ValueError(f"expected vectors of length {dim}, found {sorted(set(lengths.tolist()))[:5]}")
    rows = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
    norms = np.linalg.norm(rows, axis=1, keepdims=True)
    return np.divide(rows, norms, out=np.zeros_like(rows), where=norms > 0)


def keep_best(q: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int):
    order = np.lexsort((ids, -np.round(scores, TIE_DIGITS), q))
    q, ids, scores = q[order], ids[order], scores[order]
    place = np.arange(len(q))
    starts = np.r_[True, q[1:] != q[:-1]] if len(q) else np.zeros(0, bool)
    keep = place - np.maximum.accumulate(np.where(starts, place, 0)) < k
    return q[keep], ids[keep], scores[keep]


def block_best(queries: np.ndarray, rows: np.ndarray, ids: np.ndarray, k: int):
    """Top k of `rows` for every query, a block of queries at a time."""
    found, step = [], max(1, min(QUERY_BLOCK, SCORES // max(1, len(rows))))
    for lo in range(0, len(queries), step):
        scores = queries[lo : lo + step] @ rows.T
        if scores.shape[1] > k:
            cut = np.partition(scores, -k, axis=1)[:, -k]
            q, c = np.nonzero(scores >= cut[:, None] - 10.0**-TIE_DIGITS)
        else:
            q, c = np.nonzero(np.ones_like(scores, bool))
        found.append(keep_best(q + lo, ids[c], scores[q, c], k))
    return [np.concatenate(part) for part in zip(*found)]

def angles(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(a @ b.T, -1.0, 1.0))


def top_hits(df: DataFrame, key: str, k: int) -> DataFrame:
    order = Window.partitionBy(key).orderBy(F.desc(F.round("vector_score", TIE_DIGITS)), "chunk_id")
    top = df.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return top.withColumn("rank", F.col("rank").cast("long"))


def no_hits(vectors: DataFrame, ranked: bool = True) -> DataFrame:
    kind = vectors.schema["vector_id"].dataType.simpleString()
    schema = f"vector_id {kind}, chunk_id long, vector_score double" + (", rank long" if ranked else "")
    return vectors.sparkSession.createDataFrame([], schema)
