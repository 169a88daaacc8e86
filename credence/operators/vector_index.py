"""Vectors stored by the leaves of a two-level tree of balls, and search over the leaves.

About √N leaves lie around pivot vectors, and the leaves around √√N of these. A vector belongs to the nearest
leaf of its nearest top, so placing it takes √√N + √√N comparisons or so, not √N. Leaves that lie side by side
make up places of up to `SLICE_ROWS` vectors (larger leaves are cut into slices, a place each), and the stored table
is bucketed and sorted by place. A search deals its query vectors to the places, each once with the leaves it visits
there, and moves the corpus only for places with very many visitors. Leaves and tops know the least and greatest angle of their vectors to
their pivot; the triangle inequality on angles rules out whole tops first, then leaves.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from credence.operators.vector_kernels import TIE_DIGITS, angles, block_best, keep_best, no_hits, top_hits, unit_matrix
from credence.session import ensure_checkpoint_dir, forget_at_end, settle

SLICE_ROWS = 50_000
# Queries that one task searches a place for.
BLOCK_ROWS = 20_000
# Hits that a task gathers over the leaves of a place before it keeps the best.
PENDING_HITS = 1 << 20
ANGLE_SLACK = 1e-6
# Pivots travel to every task: as many leaves as fit, √N of them if that is less.
PIVOT_BYTES = 32 * 1024 * 1024
# Queries whose angles to the leaves are computed at once.
ANGLE_ROWS = 256
# Places per core of the session, as long as they are below `SLICE_ROWS`.
PLACES_PER_CORE = 2


@dataclass(frozen=True)
class VectorIndex:
    spark: SparkSession
    table: str  # chunk_id, embedding, leaf, place, bucketed and sorted by place
    pivots: np.ndarray  # one unit vector per leaf
    tops: np.ndarray  # one per top
    top_of: np.ndarray  # the top each leaf lies in
    rows: np.ndarray  # vectors of each leaf, and the slices it is cut into
    slices: np.ndarray
    places: np.ndarray  # the place of each leaf, of a cut one that of its first slice
    near: np.ndarray  # least and greatest angle of a leaf's vectors to its pivot
    far: np.ndarray
    top_far: np.ndarray  # greatest angle of a top's vectors to it

    @property
    def corpus(self) -> DataFrame:
        return self.spark.table(self.table)

    @property
    def dim(self) -> int:
        return self.pivots.shape[1]


def store_vectors(corpus: DataFrame, leaves: int | None = None, path: str | None = None) -> VectorIndex | None:
    """Writes the vectors of (chunk_id, embedding) by leaf; None if there are none. Null vectors are left out."""
    spark = corpus.sparkSession
    rows = corpus.select(F.col("chunk_id").cast("long").alias("chunk_id"), F.col("embedding").cast("array<float>").alias("embedding")).filter("embedding IS NOT NULL")
    count, dim = rows.agg(F.count(F.lit(1)), F.first(F.size("embedding"))).first()
    if not count or not dim:
        return None
    most = max(1, PIVOT_BYTES // (8 * dim))
    wanted = max(1, min(most, leaves or round(count**0.5)))
    picked = rows.orderBy(F.xxhash64("chunk_id"), "chunk_id").limit(wanted).toArrow()  # PIVOT_BYTES at most
    pivots = unit_matrix(picked.column("embedding"), dim)
    tops = pivots[: max(1, round(len(pivots) ** 0.5))]
    top_of = (pivots @ tops.T).argmax(axis=1)
    placed = settle(_placed(rows, pivots, tops, top_of))
    stats = placed.groupBy("leaf").agg(
        F.count(F.lit(1)).alias("n"), F.min("away").alias("near"), F.max("away").alias("far"), F.max("top_away").alias("top_far")
    ).collect()  # one row per leaf
    sizes, near, far = np.zeros(len(pivots), np.int64), np.full(len(pivots), np.inf), np.full(len(pivots), -np.inf)
    top_far = np.full(len(tops), -np.inf)
    for r in stats:
        sizes[r["leaf"]], near[r["leaf"]], far[r["leaf"]] = r["n"], r["near"], r["far"]
        top_far[top_of[r["leaf"]]] = max(top_far[top_of[r["leaf"]]], r["top_far"])
    slices = np.maximum(1, -(-sizes // SLICE_ROWS))
    cores = spark.sparkContext.defaultParallelism
    places = _places(sizes, slices, np.argsort(top_of, kind="stable"), min(SLICE_ROWS, -(-count // (PLACES_PER_CORE * cores))))
    # One row per leaf.
    about = spark.createDataFrame([(leaf, int(slices[leaf]), int(places[leaf])) for leaf in range(len(sizes))], "leaf int, slices int, first long")
    stored = placed.join(F.broadcast(about), "leaf").select(
        "chunk_id", "embedding", "leaf", (F.col("first") + F.pmod(F.xxhash64("chunk_id"), "slices")).alias("place")
    )
    name = f"vectors_{uuid.uuid4().hex}"
    folder = path or f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}"
    if path is None:
        forget_at_end(folder)
    buckets = max(1, -(-count // SLICE_ROWS), min(cores, wanted))
    stored.repartition(buckets, "place").write.format("parquet").bucketBy(buckets, "place").sortBy("place").option("path", folder).saveAsTable(name)
    return VectorIndex(spark, name, pivots, tops, top_of, sizes, slices, places, near, far, top_far)


def _places(sizes: np.ndarray, slices: np.ndarray, order: np.ndarray, most: int) -> np.ndarray:
    """The place of each leaf: neighbours in `order` share one of up to `most` vectors, leaves in slices have their own."""
    places, at, filled = np.zeros(len(sizes), np.int64), 0, 0
    for leaf in order:
        if filled and (slices[leaf] > 1 or filled + sizes[leaf] > most):
            at, filled = at + 1, 0
        places[leaf], filled = at, filled + sizes[leaf]
        if slices[leaf] > 1:
            at, filled = at + int(slices[leaf]), 0
    return places


def _placed(rows: DataFrame, pivots: np.ndarray, tops: np.ndarray, top_of: np.ndarray) -> DataFrame:
    """Each vector with its leaf and the angles to its pivots."""
    shared, dim = rows.sparkSession.sparkContext.broadcast((pivots, tops, top_of)), pivots.shape[1]

    def run(batches):
        pivots, tops, top_of = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            unit = unit_matrix(batch.column(1), dim)
            to_tops = angles(unit, tops)
            own = to_tops.argmin(axis=1)
            leaf, away, top_away = np.empty(len(own), np.int32), np.empty(len(own)), to_tops[np.arange(len(own)), own]
            for top in np.unique(own):
                at, under = np.flatnonzero(own == top), np.flatnonzero(top_of == top)
                to_leaves = angles(unit[at], pivots[under])
                best = to_leaves.argmin(axis=1)
                leaf[at], away[at] = under[best], to_leaves[np.arange(len(at)), best]
            # A zero vector has no direction; the widest angle keeps its leaf from being ruled out.
            nowhere = ~unit.any(axis=1)
            away[nowhere], top_away[nowhere] = np.pi, np.pi
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(leaf), pa.array(away), pa.array(top_away)],
                names=["chunk_id", "embedding", "leaf", "away", "top_away"],
            )

    return rows.mapInArrow(run, "chunk_id long, embedding array<float>, leaf int, away double, top_away double")


def _visits(vectors: DataFrame, index: VectorIndex, choose: Callable) -> DataFrame:
    """Rows (vector_id, embedding, place, leaves): a query once for each place that holds some of the leaves that
    `choose(index, unit vectors, batch)` gives as pairs."""
    shared, dim = vectors.sparkSession.sparkContext.broadcast(_plain(index)), index.dim
    kind = vectors.schema["vector_id"].dataType.simpleString()

    def run(batches):
        index = VectorIndex(None, "", *shared.value)
        for batch in batches:
            for at in range(0, batch.num_rows, ANGLE_ROWS):
                some = batch.slice(at, ANGLE_ROWS)
                query, leaf = choose(index, unit_matrix(some.column(1), dim), some)
                slices = index.slices[leaf]
                place = np.repeat(index.places[leaf], slices) + np.arange(slices.sum()) - np.repeat(np.cumsum(slices) - slices, slices)
                query, leaf = np.repeat(query, slices), np.repeat(leaf, slices)
                order = np.lexsort((leaf, place, query))
                query, place, leaf = query[order], place[order], leaf[order].astype(np.int32)
                starts = np.flatnonzero(np.r_[True, (query[1:] != query[:-1]) | (place[1:] != place[:-1])][: len(query)])
                rows, ends = pa.array(query[starts]), np.r_[starts, len(leaf)].astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [some.column(0).take(rows), some.column(1).take(rows), pa.array(place[starts]), pa.ListArray.from_arrays(pa.array(ends), pa.array(leaf))],
                    names=["vector_id", "embedding", "place", "leaves"],
                )

    return vectors.mapInArrow(run, f"vector_id {kind}, embedding array<float>, place long, leaves array<int>")


def _plain(index: VectorIndex) -> tuple:
    return index.pivots, index.tops, index.top_of, index.rows, index.slices, index.places, index.near, index.far, index.top_far


def _search(visits: DataFrame, index: VectorIndex, k: int) -> DataFrame:
    """Top k per vector and place. The stored vectors stay in their buckets, but for places with very many visitors."""
    visits = settle(visits)
    kind, dim = visits.schema["vector_id"].dataType.simpleString(), index.dim
    visitors = {r["place"]: r["count"] for r in visits.groupBy("place").count().collect()}  # one row per place
    if not visitors:
        return no_hits(visits, ranked=False)
    crowded = {place: -(-n // BLOCK_ROWS) for place, n in visitors.items() if n > BLOCK_ROWS}

    def search(asked: pa.Table, stored: pa.Table) -> pa.Table:
        if not asked.num_rows or not stored.num_rows:
            return pa.table({"vector_id": asked.column("vector_id").slice(0, 0),
                             "chunk_id": pa.array([], pa.int64()), "vector_score": pa.array([], pa.float64())})
        q, ids, scores = _best_by_leaf(asked, stored, dim, k)
        return pa.table({"vector_id": asked.column("vector_id").take(pa.array(q)), "chunk_id": pa.array(ids), "vector_score": pa.array(scores)})

    def met(left: DataFrame, right: DataFrame, *keys: str) -> DataFrame:
        return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(search, f"vector_id {kind}, chunk_id long, vector_score double")

    places = visits.sparkSession.createDataFrame([(p, crowded.get(p, 0)) for p in visitors], "place long, blocks int")
    calm = F.broadcast(places.filter("blocks = 0").select("place"))
    found = met(visits.join(calm, "place", "left_semi"), index.corpus.join(calm, "place", "left_semi"), "place")
    if not crowded:
        return found
    busy = F.broadcast(places.filter("blocks > 0"))
    asked = visits.join(busy, "place").withColumn("block", F.pmod(F.xxhash64("vector_id"), "blocks").cast("int")).drop("blocks")
    copies = index.corpus.join(busy, "place").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")
    return found.unionByName(met(asked, copies, "place", "block"))


def _best_by_leaf(asked: pa.Table, stored: pa.Table, dim: int, k: int):
    """Top k of one place for every query, from the leaves it visits."""
    queries, lists = unit_matrix(asked.column("embedding"), dim), asked.column("leaves").combine_chunks()
    visited, asker = lists.flatten().to_numpy(), np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
    order = np.argsort(visited, kind="stable")
    visited, asker = visited[order], asker[order]
    vectors, ids, leaf = stored.column("embedding").combine_chunks(), stored.column("chunk_id").to_numpy(), stored.column("leaf").to_numpy()
    by_leaf = np.argsort(leaf, kind="stable")
    found, pending = [(np.empty(0, np.int64), ids[:0], np.empty(0))], 0
    for at in np.split(by_leaf, np.flatnonzero(np.diff(leaf[by_leaf])) + 1):
        who = asker[np.searchsorted(visited, leaf[at[0]]) : np.searchsorted(visited, leaf[at[0]], "right")]
        if not len(who):
            continue
        q, chunks, scores = block_best(queries[who], unit_matrix(vectors.take(pa.array(at)), dim), ids[at], k)
        found.append((who[q], chunks, scores))
        pending += len(q)
        if pending > PENDING_HITS:
            found, pending = [keep_best(*[np.concatenate(part) for part in zip(*found)], k)], 0
    return keep_best(*[np.concatenate(part) for part in zip(*found)], k)


def _home(index: VectorIndex, unit: np.ndarray) -> np.ndarray:
    """The nearest leaf that holds vectors, under the nearest top that holds any."""
    to_tops = np.where(np.isfinite(index.top_far), angles(unit, index.tops), np.inf)
    own, leaf = to_tops.argmin(axis=1), np.empty(len(unit), np.int64)
    for top in np.unique(own):
        at, under = np.flatnonzero(own == top), np.flatnonzero((index.top_of == top) & (index.rows > 0))
        leaf[at] = under[angles(unit[at], index.pivots[under]).argmin(axis=1)]
    return leaf


def _still_open(index: VectorIndex, unit: np.ndarray, reach: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of query and leaf, but for home leaves, that may hold something within the query's reach."""
    home, bound = _home(index, unit), reach + ANGLE_SLACK
    to_tops = angles(unit, index.tops)
    queries, leaves = [], []
    for top in np.flatnonzero(np.isfinite(index.top_far)):
        at = np.flatnonzero(to_tops[:, top] - index.top_far[top] <= bound)
        under = np.flatnonzero((index.top_of == top) & (index.rows > 0))
        to_leaves = angles(unit[at], index.pivots[under])
        least = np.maximum(to_leaves - index.far[under], index.near[under] - to_leaves)
        q, c = np.nonzero((least <= bound[at, None]) & (under != home[at, None]))
        queries.append(at[q])
        leaves.append(under[c])
    return np.concatenate(queries), np.concatenate(leaves)


def by_leaves(vectors: DataFrame, index: VectorIndex, k: int) -> DataFrame:
    """Exact: the home leaf first, then every leaf that could still hold something closer than the k-th hit."""
    return _first_and_later(vectors, index, k)[0]


def _first_and_later(vectors: DataFrame, index: VectorIndex, k: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    vectors = settle(vectors)
    at_home = _visits(vectors, index, lambda index, unit, _: (np.arange(len(unit)), _home(index, unit)))
    first = settle(_search(at_home, index, k))
    top = top_hits(first, "vector_id", k)
    # Anything that ties with the k-th score may still win by its id, so the angle belongs to the least such score.
    tied = F.round(F.min("vector_score"), TIE_DIGITS) - F.lit(10.0**-TIE_DIGITS)
    reach = top.groupBy("vector_id").agg(
        F.when(F.count(F.lit(1)) == k, F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), tied)))).otherwise(F.lit(np.pi)).alias("reach")
    )
    asked = vectors.join(reach, "vector_id", "left").select("vector_id", "embedding", F.coalesce("reach", F.lit(np.pi)).alias("reach"))
    later = _visits(asked, index, lambda index, unit, batch: _still_open(index, unit, batch.column(2).to_numpy()))
    return first.unionByName(_search(later, index, k)), at_home, later


def share_read(vectors: DataFrame, index: VectorIndex, k: int) -> DataFrame:
    """One row: vectors compared by an exact search, and those a scan for every query would compare."""
    _, at_home, later = _first_and_later(vectors.select("vector_id", "embedding").filter("embedding IS NOT NULL"), index, k)
    sizes = index.corpus.groupBy("place", "leaf").agg(F.count(F.lit(1)).alias("n"))
    visited = at_home.unionByName(later).select("vector_id", "place", F.explode("leaves").alias("leaf"))
    compared = visited.join(sizes, ["place", "leaf"]).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("compared"))
    return compared.crossJoin(at_home.agg((F.count_distinct("vector_id") * int(index.rows.sum())).alias("scanned")))


def probed(vectors: DataFrame, index: VectorIndex, k: int, probes: int) -> DataFrame:
    """The best of the `probes` leaves whose pivots are nearest."""

    def closest(index: VectorIndex, unit: np.ndarray, _) -> tuple[np.ndarray, np.ndarray]:
        filled = np.flatnonzero(index.rows > 0)
        order = filled[angles(unit, index.pivots[filled]).argsort(axis=1, kind="stable")[:, :probes]]
        return np.repeat(np.arange(len(unit)), order.shape[1]), order.ravel()

    return _search(_visits(vectors, index, closest), index, k)
