"""Approximate nearest neighbours along several shifted Hilbert curves.

Every vector of length one is projected at random to a few dimensions, shifted, and placed on a
Hilbert curve; another projection and shift give another curve. Vectors are numbered along each
curve by range-partitioned sorts. A query looks at the window of neighbouring numbers on every
curve; windows are merged and ranked by the cosine of the original vectors in double precision.

The window's width is fitted: for a sample of at most SAMPLE queries the true neighbours are
found by one scan, and the width is the least that covers TARGET of them on some curve. It
follows the data, not a fixed count: vectors without any structure need windows that grow with
their number. `recall` measures the outcome on queries the width was not fitted to.

Vectors that are null, zero, hold null or non-finite components, or differ in length from most take no part, as queries or
candidates. Of more than k + 1 equal vectors only the k + 1 of least id can be in any result, so
only these are candidates; all of them are queries. Ties go to the smaller id. Rows repeating an id
are one candidate each but never their own neighbour. Extra columns are left out. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from credence.llm.numbering import numbered_within
from credence.session import settle

K = 5
CURVES, DIMENSIONS, BITS = 16, 6, 10
SAMPLE, TARGET = 128, 0.96
CELL_ROWS = 4096
FOUND = "query_id long, vec_id long, score double"


def hilbert_keys(grid: np.ndarray, bits: int) -> np.ndarray:
    """Places on the Hilbert curve of integer points (one per row) with `bits` bits per dimension."""
    x = grid.astype(np.int64).copy()
    dims = x.shape[1]
    step = 1 << (bits - 1)
    while step > 1:
        low = step - 1
        for i in range(dims):
            upper = (x[:, i] & step) > 0
            swapped = np.where(upper, 0, (x[:, 0] ^ x[:, i]) & low)
            x[:, 0] ^= np.where(upper, low, swapped)
            if i:
                x[:, i] ^= swapped
        step >>= 1
    for i in range(1, dims):
        x[:, i] ^= x[:, i - 1]
    flips = np.zeros(x.shape[0], np.int64)
    step = 1 << (bits - 1)
    while step > 1:
        flips ^= np.where((x[:, -1] & step) > 0, step - 1, 0)
        step >>= 1
    x ^= flips[:, None]
    keys = np.zeros(x.shape[0], np.int64)
    for bit in range(bits - 1, -1, -1):
        for i in range(dims):
            keys = (keys << 1) | ((x[:, i] >> bit) & 1)
    return keys


def curve_keys(unit: np.ndarray, curves: int = CURVES, dimensions: int = DIMENSIONS, bits: int = BITS) -> np.ndarray:
    """The key of every unit vector (rows) on every curve (columns)."""
    rng = np.random.Generator(np.random.PCG64(271828))
    width = unit.shape[1]
    dims = min(dimensions, width)
    keys = np.empty((unit.shape[0], curves), np.int64)
    for c in range(curves):
        axes = np.linalg.qr(rng.normal(size=(width, width)))[0][:, :dims]
        shift = rng.uniform(0, 0.25, dims)
        # Coordinates lie in -1 … 1; spread over about two thirds of the grid, so that shifts stay inside.
        grid = ((unit @ axes + 1) / 2 * 0.75 + shift) * (1 << bits)
        keys[:, c] = hilbert_keys(np.clip(grid.astype(np.int64), 0, (1 << bits) - 1), bits)
    return keys


def _matrix(column: pa.Array) -> np.ndarray:
    """Vectors of one length as rows, in double precision."""
    values = column.flatten().to_numpy().astype(np.float64)
    return values.reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def _cosines(vectors: np.ndarray, norms: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Row by row, so that equal vectors score equally wherever they stand."""
    return (vectors * query).sum(axis=1) / (norms * np.sqrt((query * query).sum()))


def _norms(vectors: np.ndarray) -> np.ndarray:
    return np.sqrt((vectors * vectors).sum(axis=1))


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best scores, ties to the smaller id."""
    if scores.size > k:
        bound = np.partition(scores, scores.size - k)[scores.size - k]
        some = np.flatnonzero(scores >= bound)
    else:
        some = np.arange(scores.size)
    return some[np.lexsort((ids[some], -scores[some]))[:k]]


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id and embedding of the vectors that take part, single precision as it comes, anything else as doubles."""
    single = vectors.schema["embedding"].dataType.simpleString() == "array<float>"
    read = vectors.select("vec_id", F.col("embedding").cast("array<float>" if single else "array<double>").alias("embedding"))
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    filled = read.filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & finite & F.exists("embedding", lambda x: x != 0))
    sizes = filled.groupBy(F.size("embedding").alias("size")).agg(F.count(F.lit(1)).alias("rows")).orderBy(F.desc("rows"), "size").first()
    return filled.filter(F.size("embedding") == F.lit(sizes["size"] if sizes else 0))


def _top(found: DataFrame, k: int) -> DataFrame:
    """Each query's k best of the rows found, with their rank."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.distinct().withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def exact_neighbours(candidates: DataFrame, queries: np.ndarray, query_ids: np.ndarray, k: int = K) -> DataFrame:
    """The true neighbours of a bounded set of queries, by one scan."""
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors, ids = _matrix(batch.column(1)), batch.column(0).to_numpy()
            own = _norms(vectors)
            for query, query_id in zip(queries, query_ids.tolist(), strict=True):
                scores = _cosines(vectors, own, query)
                best = _best(np.where(ids == query_id, -np.inf, scores), ids, k)
                best = best[ids[best] != query_id]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(best.size, query_id)), pa.array(ids[best]), pa.array(scores[best])], names=["query_id", "vec_id", "score"])

    return _top(candidates.select("vec_id", "embedding").mapInArrow(scan, FOUND), k)


def nearest(
    vectors: DataFrame,
    is_query: Column,
    k: int = K,
    curves: int = CURVES,
    sample: int = SAMPLE,
    target: float = TARGET,
    cell_rows: int = CELL_ROWS,
) -> DataFrame:
    """query_id, rank, vec_id, score of the k nearest found for every vector with `is_query`."""
    copies = Window.partitionBy("embedding").orderBy("vec_id")
    known = usable(vectors)
    firsts = known.withColumn("copy", F.row_number().over(copies)).filter(F.col("copy") <= k + 1).select("vec_id", "embedding", F.lit(True).alias("candidate"))
    # Queries beyond the kept copies search too; they are placed on the curves as rows that nobody finds.
    asked = known.filter(is_query).select("vec_id", "embedding", F.lit(True).alias("query"))
    candidates = settle(firsts)
    queries = settle(asked)
    marked = candidates.join(queries.select("vec_id", "query").distinct(), "vec_id", "left").select("vec_id", "embedding", "candidate", F.coalesce("query", F.lit(False)).alias("query"))
    others = queries.join(candidates.select("vec_id").distinct(), "vec_id", "left_anti").select("vec_id", "embedding", F.lit(False).alias("candidate"), "query")
    placed = settle(_on_curves(marked.unionByName(others), curves))
    numbered = settle(numbered_within(placed, "curve", ["key", "vec_id"], "number")[0])
    reach = _fitted_reach(numbered, candidates, queries, k, sample, target)
    found = _in_cells(numbered, reach, k, cell_rows)
    return _top(found, k).select(F.col("query_id"), F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _on_curves(rows: DataFrame, curves: int) -> DataFrame:
    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                some = batch.slice(at, 2048)
                vectors = _matrix(some.column(1))
                keys = curve_keys(vectors / _norms(vectors)[:, None], curves)
                for c in range(curves):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(some.num_rows, c, np.int32)), pa.array(keys[:, c]), *some.columns], names=["curve", "key", *some.schema.names])

    kind = rows.schema["embedding"].dataType.simpleString()
    return rows.mapInArrow(place, f"curve int, key long, vec_id long, embedding {kind}, candidate boolean, query boolean")


def _fitting_order() -> list[Column]:
    """The first queries in this order are the fitting sample."""
    return [F.xxhash64("vec_id"), F.col("vec_id")]


def recall(found: DataFrame, vectors: DataFrame, is_query: Column, k: int = K, sample: int = SAMPLE, block: int = SAMPLE) -> tuple[int, int, int]:
    """Of the queries outside the fitting sample: true neighbours found, true neighbours, and queries.

    Every block of at most `block` queries is one scan of the vectors.
    """
    known, hits = settle(usable(vectors)), settle(found.select("query_id", "vec_id", F.lit(1).alias("hit")))
    ordered = settle(known.filter(is_query)).orderBy(*_fitting_order())
    met = expected = asked = 0
    while True:
        chosen = ordered.offset(sample + asked).limit(block).collect()  # at most `block` vectors
        if not chosen:
            return met, expected, asked
        ids = np.array([r["vec_id"] for r in chosen], np.int64)
        truth = exact_neighbours(known, np.array([r["embedding"] for r in chosen], np.float64), ids, k)
        row = truth.join(hits, ["query_id", "vec_id"], "left").agg(F.count("hit").alias("met"), F.count(F.lit(1)).alias("expected")).first()
        met, expected, asked = met + row["met"], expected + row["expected"], asked + len(chosen)


def _fitted_reach(numbered: DataFrame, candidates: DataFrame, queries: DataFrame, k: int, sample: int, target: float) -> int:
    """The least window that covers the target share of a sample's true neighbours on some curve."""
    chosen = queries.orderBy(*_fitting_order()).limit(sample).collect()  # at most `sample` vectors
    if not chosen:
        return 1
    ids = np.array([r["vec_id"] for r in chosen], np.int64)
    truth = exact_neighbours(candidates, np.array([r["embedding"] for r in chosen], np.float64), ids, k).select("query_id", "vec_id")
    places = numbered.select("curve", "vec_id", "number")
    of_query = truth.join(F.broadcast(places.withColumnRenamed("vec_id", "query_id").filter(F.col("query_id").isin(ids.tolist())).withColumnRenamed("number", "of_query")), "query_id")
    gaps = of_query.join(places, ["curve", "vec_id"]).groupBy("query_id", "vec_id").agg(F.min(F.abs(F.col("number") - F.col("of_query"))).alias("gap"))
    sorted_gaps = sorted(r["gap"] for r in gaps.collect())  # at most sample * k numbers
    if not sorted_gaps:
        return 1
    return max(2 * k, int(sorted_gaps[min(len(sorted_gaps) - 1, int(np.ceil(target * len(sorted_gaps))) - 1)]))


def _in_cells(numbered: DataFrame, reach: int, k: int, cell_rows: int) -> DataFrame:
    """The best of every query's window in each cell of `cell_rows` numbers it reaches into."""
    cell = F.floor(F.col("number") / F.lit(cell_rows)).cast("long")
    kept = ["curve", "cell", "role", "number", "vec_id", "embedding"]
    held = numbered.filter("candidate").select("*", cell.alias("cell"), F.lit(0).alias("role")).select(*kept)
    cells = F.sequence(F.floor(F.greatest(F.lit(0), F.col("number") - reach) / cell_rows), F.floor((F.col("number") + reach) / cell_rows))
    asking = numbered.filter("query").select("*", F.explode(cells).alias("cell"), F.lit(1).alias("role")).select(*kept)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come cell by cell, candidates before queries in order of number; holds one cell's candidates."""
        cell, parts, ready = None, [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            curve, cells, roles, numbers, ids = (batch.column(c).to_numpy() for c in range(5))
            vectors = _matrix(batch.column(5))
            heads = np.flatnonzero(np.concatenate([[True], (curve[1:] != curve[:-1]) | (cells[1:] != cells[:-1]) | (roles[1:] != roles[:-1])]))
            for a, b in zip(heads, np.append(heads[1:], curve.size), strict=True):
                key = (int(curve[a]), int(cells[a]))
                if key != cell:
                    cell, parts, ready = key, [], None
                if roles[a] == 0:
                    parts.append((numbers[a:b], ids[a:b], vectors[a:b]))
                    continue
                if not parts:
                    continue
                if ready is None:
                    own, own_ids, own_vectors = (np.concatenate(x) for x in zip(*parts, strict=True))
                    ready = own, own_ids, own_vectors, _norms(own_vectors)
                yield _search_cell(ready, numbers[a:b], ids[a:b], vectors[a:b], reach, k)

    dealt = held.unionByName(asking).repartition("curve", "cell").sortWithinPartitions("curve", "cell", "role", "number")
    return dealt.mapInArrow(search, FOUND)


def _search_cell(held, numbers: np.ndarray, ids: np.ndarray, vectors: np.ndarray, reach: int, k: int) -> pa.RecordBatch:
    own, own_ids, own_vectors, norms = held
    firsts, lasts = np.searchsorted(own, numbers - reach), np.searchsorted(own, numbers + reach, side="right")
    query_ids, found_ids, found_scores = [], [], []
    for query_id, query, a, b in zip(ids.tolist(), vectors, firsts.tolist(), lasts.tolist(), strict=True):
        other = own_ids[a:b] != query_id
        some = own_ids[a:b][other]
        scores = _cosines(own_vectors[a:b][other], norms[a:b][other], query)
        best = _best(scores, some, k)
        query_ids.append(np.full(best.size, query_id, np.int64))
        found_ids.append(some[best])
        found_scores.append(scores[best])
    columns = [pa.array(np.concatenate(x)) for x in (query_ids, found_ids, found_scores)]
    return pa.RecordBatch.from_arrays(columns, names=["query_id", "vec_id", "score"])
