"""Hard negatives by exact integer products of anchor and candidate tiles.

Vectors become integers: every component x is floor(256 * x). Scores are inner products of these,
computed tile by tile with Strassen's recursion on int64 matrices: seven half-size products in
place of eight, odd sides padded with a row or column of zeros. Sums in the recursion may wrap around;
as arithmetic modulo 2^64 is a ring, a score that fits a long comes out exact all the same. Products
at the bottom of the recursion go through doubles where their size proves them exact, otherwise
through int64.

Two rounds, each over a grid of cells. Candidates are dealt by ranges, a part is as much as a range
holds; anchors are dealt into blocks by hash, and a cell is a part and a block. A task holds a
block of anchors and streams the candidates of its part past them, keeping a small heap per anchor;
heaps of different parts merge, as the best k of a union are among the best k of each side.

1. Positives: parts are ranges of (label, vector id), so a cell only has the anchors whose label occurs
   in its part. The heap keeps the best `positives` of the anchor's own label.
2. Windows: every part meets every block. For each positive a heap keeps the best `negatives` of other
   labels whose score lies within the given percentages of the positive's score.

Anchors are a stated share of all rows, so the products grow with the square of the table; no pair of rows
is ever stored, only heaps are.

Rows with a null id, label or vector, or a null or non-finite component take no part. Nor do rows whose integer square sum
exceeds 2^62: without them no score can leave the range of a long. Shorter vectors count as
padded with zeros, empty ones are zero. Equal rows count once; rows that share an id but differ are rows of their own,
never each other's positive or negative. Ties go to the smaller id. Extra columns are left out. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from credence.session import settle

POSITIVES, NEGATIVES = 5, 3
# Bounds of a negative's score in hundredths of the positive's.
LOW, HIGH = 50, 95
SCALE = 256
# Anchors that a task holds, rows of one product, and the side below which Strassen's recursion ends.
BLOCK_ROWS, TILE_ROWS, LEAF = 8192, 1024, 32
# Candidates of one part, at least; fewer where there are not enough parts for all tasks.
PART_ROWS = 1 << 18
NOTHING = np.iinfo(np.int64).min
EXACT = 1 << 53


def _leaf(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A product in doubles if no sum in it can reach 2^53, else in int64."""
    if not a.size or not b.size:
        return np.zeros((a.shape[0], b.shape[1]), np.int64)
    most = [max(abs(int(x.min())), abs(int(x.max()))) for x in (a, b)]
    if most[0] * most[1] * a.shape[1] < EXACT:
        return (a.astype(np.float64) @ b.astype(np.float64)).astype(np.int64)
    return a @ b


def _padded(x: np.ndarray) -> np.ndarray:
    rows, columns = x.shape[0] & 1, x.shape[1] & 1
    return np.pad(x, ((0, rows), (0, columns))) if rows or columns else x


def strassen(a: np.ndarray, b: np.ndarray, leaf: int = LEAF) -> np.ndarray:
    """The product of two int64 matrices modulo 2^64."""
    rows, columns = a.shape[0], b.shape[1]
    if min(rows, a.shape[1], columns) <= leaf:
        return _leaf(a, b)
    a, b = _padded(a), _padded(b)
    m, k, n = a.shape[0] // 2, a.shape[1] // 2, b.shape[1] // 2
    a11, a12, a21, a22 = a[:m, :k], a[:m, k:], a[m:, :k], a[m:, k:]
    b11, b12, b21, b22 = b[:k, :n], b[:k, n:], b[k:, :n], b[k:, n:]
    p1 = strassen(a11 + a22, b11 + b22, leaf)
    p2 = strassen(a21 + a22, b11, leaf)
    p3 = strassen(a11, b12 - b22, leaf)
    p4 = strassen(a22, b21 - b11, leaf)
    p5 = strassen(a11 + a12, b22, leaf)
    p6 = strassen(a21 - a11, b11 + b12, leaf)
    p7 = strassen(a12 - a22, b21 + b22, leaf)
    out = np.empty((2 * m, 2 * n), np.int64)
    out[:m, :n] = p1 + p4 - p5 + p7
    out[:m, n:] = p3 + p5
    out[m:, :n] = p2 + p4
    out[m:, n:] = p1 - p2 + p3 + p6
    return out[:rows, :columns]


def integer_rows(vectors: DataFrame, label: Column, scale: int = SCALE) -> DataFrame:
    """row, vec_id, label and integer components of the rows that take part, each different row once."""
    doubles = F.col("embedding").cast("array<double>")
    finite = F.forall("doubles", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    size = F.aggregate("doubles", F.lit(0.0), lambda total, x: total + (F.lit(float(scale)) * x + 1) * (F.lit(float(scale)) * x + 1))
    known = vectors.select("vec_id", label.cast("long").alias("label"), doubles.alias("doubles")).filter("vec_id is not null and label is not null and doubles is not null")
    whole = known.filter(finite).filter(size < F.lit(float(1 << 62))).select("vec_id", "label", F.transform("doubles", lambda x: F.floor(F.lit(scale) * x)).alias("vector"))
    # Written once, so that a row keeps its number.
    return settle(whole.distinct().withColumn("row", F.monotonically_increasing_id()))


class Heaps:
    """The best `k` (score, id) of each of a number of anchors, best first, ties to the smaller id."""

    def __init__(self, size: int, k: int):
        self.scores, self.ids = np.full((size, k), NOTHING), np.zeros((size, k), np.int64)

    def take(self, scores: np.ndarray, ids: np.ndarray, first: int = 0) -> None:
        """Merges a matrix of scores, anchors from `first` on by candidates; NOTHING marks what does not count.

        Candidates come in rising order of id over all calls, so an equal score never displaces an earlier one.
        """
        k = self.scores.shape[1]
        better = np.flatnonzero(scores.max(axis=1, initial=NOTHING) > self.scores[first : first + scores.shape[0], -1])
        if not better.size:
            return
        left, line, some = scores[better], np.arange(better.size), better + first
        best, at = np.empty((some.size, k), np.int64), np.empty((some.size, k), np.int64)
        for i in range(k):
            # The first of equal scores has the smaller id.
            at[:, i] = left.argmax(axis=1)
            best[:, i] = left[line, at[:, i]]
            left[line, at[:, i]] = NOTHING
        all_scores, all_ids = (np.concatenate(x, axis=1) for x in ((self.scores[some], best), (self.ids[some], ids[at])))
        # The complement turns the order round and puts NOTHING last.
        order = np.lexsort((all_ids, ~all_scores), axis=1)[:, :k]
        self.scores[some], self.ids[some] = np.take_along_axis(all_scores, order, 1), np.take_along_axis(all_ids, order, 1)


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Vectors as rows of `width` integers, zeros behind shorter ones."""
    sizes = column.value_lengths().to_numpy()
    out = np.zeros((len(column), width), np.int64)
    out[np.arange(width) < sizes[:, None]] = column.flatten().to_numpy()
    return out


def _dealt(candidates: DataFrame, anchors: DataFrame, blocks: int, order: list[str]) -> DataFrame:
    """Both sides of all cells, anchors first, candidates in the given order; anchors already know part and block."""
    offered = candidates.select("*", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.lit(1).alias("role"))
    both = anchors.withColumn("role", F.lit(0)).unionByName(offered, allowMissingColumns=True)
    return both.repartition("part", "block").sortWithinPartitions("part", "block", "role", *order)


def _runs(batches: Iterator[pa.RecordBatch], keys: list[str], tile: int) -> Iterator[tuple[tuple, pa.RecordBatch]]:
    """Slices of at most `tile` rows that agree in the key columns."""
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(batch.schema.get_field_index(k)).to_numpy() for k in keys]
        changed = np.zeros(batch.num_rows, bool)
        changed[0] = True
        for c in columns:
            changed[1:] |= c[1:] != c[:-1]
        heads = np.flatnonzero(changed)
        for a, b in zip(heads.tolist(), np.append(heads[1:], batch.num_rows).tolist(), strict=True):
            for at in range(a, b, tile):
                yield tuple(int(c[a]) for c in columns), batch.slice(at, min(tile, b - at))


def _column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def _best_positives(dealt: DataFrame, width: int, k: int, tile: int, leaf: int) -> DataFrame:
    """The k best of an anchor's own label in every cell."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, held, ready = None, {}, {}

        def found() -> Iterator[pa.RecordBatch]:
            for rows, _, _, heaps in ready.values():
                line, at = np.nonzero(heaps.scores != NOTHING)
                yield pa.RecordBatch.from_arrays([pa.array(rows[line]), pa.array(heaps.ids[line, at]), pa.array(heaps.scores[line, at])], names=["row", "positive_id", "positive_score"])

        for (part, block, role, label), some in _runs(batches, ["part", "block", "role", "label"], tile):
            if (part, block) != cell:
                yield from found()
                cell, held, ready = (part, block), {}, {}
            ids, vectors = _column(some, "vec_id").to_numpy(), _matrix(_column(some, "vector"), width)
            if role == 0:
                held.setdefault(label, []).append((_column(some, "row").to_numpy(), ids, vectors))
                continue
            if label not in held:
                continue
            if label not in ready:
                rows, own, matrix = (np.concatenate(x) for x in zip(*held[label], strict=True))
                ready[label] = rows, own, matrix, Heaps(rows.size, k)
            _, own, matrix, heaps = ready[label]
            scores = strassen(matrix, np.ascontiguousarray(vectors.T), leaf)
            heaps.take(np.where(own[:, None] == ids, NOTHING, scores), ids)
        yield from found()

    return dealt.mapInArrow(search, "row long, positive_id long, positive_score long")


def _best_in_windows(dealt: DataFrame, width: int, k: int, low: int, high: int, tile: int, leaf: int) -> DataFrame:
    """For every anchor and positive, the k best of other labels inside the positive's window in every cell."""

    def bounds(scores: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        whole, rest = scores // 100, scores % 100
        return low * whole - (-low * rest) // 100, high * whole + (high * rest) // 100

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, held, ready = None, [], None

        def found() -> Iterator[pa.RecordBatch]:
            for place, heaps in enumerate(ready[5] if ready else []):
                line, at = np.nonzero(heaps.scores != NOTHING)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ready[0][line]), pa.array(np.full(line.size, place, np.int32)), pa.array(heaps.ids[line, at]), pa.array(heaps.scores[line, at])],
                    names=["row", "place", "negative_id", "negative_score"],
                )

        for (part, block, role), some in _runs(batches, ["part", "block", "role"], tile):
            if (part, block) != cell:
                yield from found()
                cell, held, ready = (part, block), [], None
            ids, labels, vectors = _column(some, "vec_id").to_numpy(), _column(some, "label").to_numpy(), _matrix(_column(some, "vector"), width)
            if role == 0:
                positives = _column(some, "positive_scores")
                counts = positives.value_lengths().to_numpy()
                scores = np.full((some.num_rows, int(counts.max())), NOTHING)
                scores[np.arange(scores.shape[1]) < counts[:, None]] = positives.flatten().to_numpy()
                held.append((_column(some, "row").to_numpy(), ids, labels, vectors, scores))
                continue
            if not held:
                continue
            if ready is None:
                most = max(h[4].shape[1] for h in held)
                wide = [np.pad(h[4], ((0, 0), (0, most - h[4].shape[1])), constant_values=NOTHING) for h in held]
                rows, own, own_labels, matrix = (np.concatenate(x) for x in list(zip(*held, strict=True))[:4])
                # An absent positive has an empty window.
                positive = np.concatenate(wide)
                lows, highs = bounds(np.where(positive == NOTHING, 0, positive))
                lows[positive == NOTHING] = 1
                highs[positive == NOTHING] = 0
                ready = rows, own, own_labels, matrix, (lows, highs), [Heaps(rows.size, k) for _ in range(most)]
            _, own, own_labels, matrix, (lows, highs), heaps = ready
            for at in range(0, own.size, tile):
                line = slice(at, at + tile)
                scores = strassen(matrix[line], np.ascontiguousarray(vectors.T), leaf)
                fit = (own_labels[line, None] != labels) & (own[line, None] != ids)
                for place, heap in enumerate(heaps):
                    inside = fit & (scores >= lows[line, place, None]) & (scores <= highs[line, place, None])
                    heap.take(np.where(inside, scores, NOTHING), ids, at)
        yield from found()

    return dealt.mapInArrow(search, "row long, place int, negative_id long, negative_score long")


def _ranked(found: DataFrame, group: list[str], score: str, own_id: str, k: int, name: str) -> DataFrame:
    """Merges the heaps of a group: its k best, with their place from 1 on."""
    order = Window.partitionBy(*group).orderBy(F.desc(score), own_id)
    return found.withColumn(name, F.row_number().over(order)).filter(F.col(name) <= k)


def hard_negatives(
    vectors: DataFrame,
    is_anchor: Column,
    label: Column,
    positives: int = POSITIVES,
    negatives: int = NEGATIVES,
    low: int = LOW,
    high: int = HIGH,
    scale: int = SCALE,
    block_rows: int = BLOCK_ROWS,
    part_rows: int = PART_ROWS,
    tile: int = TILE_ROWS,
    leaf: int = LEAF,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id and both scores; `is_anchor` and `label` are expressions of vec_id and label."""
    whole = integer_rows(vectors, label, scale)
    rows, asked, width = whole.agg(F.count(F.lit(1)), F.count_if(is_anchor), F.coalesce(F.max(F.size("vector")), F.lit(0))).first()
    blocks = max(1, -(-asked // block_rows))
    tasks = min(-(-rows // tile), whole.sparkSession.sparkContext.defaultParallelism)
    ranges = whole.repartitionByRange(max(1, tasks, -(-rows // part_rows)), "label", "vec_id", "row")
    candidates = settle(ranges.withColumn("part", F.spark_partition_id()))
    anchors = whole.filter(is_anchor).withColumn("block", F.pmod(F.xxhash64("row"), F.lit(blocks)).cast("int"))

    held_by = candidates.select("label", "part").distinct().select("*", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    # A block has about block_rows anchors, so a key is no heavier than that however common its label.
    own = anchors.join(held_by, ["label", "block"])
    first = _best_positives(_dealt(candidates, own, blocks, ["label", "vec_id"]), width, positives, tile, leaf)
    chosen = settle(_ranked(first, ["row"], "positive_score", "positive_id", positives, "place"))

    in_order = F.array_sort(F.collect_list(F.struct("place", "positive_score")))  # at most `positives`
    windows = chosen.groupBy("row").agg(F.transform(in_order, lambda p: p["positive_score"]).alias("positive_scores"))
    last = candidates.agg(F.coalesce(F.max("part"), F.lit(0))).first()[0]
    everywhere = anchors.join(windows, "row").select("*", F.explode(F.sequence(F.lit(0), F.lit(last))).alias("part"))
    second = _best_in_windows(_dealt(candidates, everywhere, blocks, ["vec_id"]), width, negatives, low, high, tile, leaf)
    best = _ranked(second.withColumn("place", F.col("place") + 1), ["row", "place"], "negative_score", "negative_id", negatives, "rank")
    named = best.join(chosen, ["row", "place"]).join(anchors.select("row", F.col("vec_id").alias("anchor_id")), "row")
    return named.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")


NEGATIVES_SQL = """
with usable as (
    select distinct vec_id, case when vec_id % 7 = 0 then (cast(label as bigint) + 1) % 10 else cast(label as bigint) end as label,
           list_transform(embedding, lambda x: floor(256 * cast(x as double))) as v
    from embeddings
    where vec_id is not null and label is not null and embedding is not null
      and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
),
scored as (
    select a.vec_id as anchor_id, b.vec_id as other_id, a.label = b.label as same, cast(list_inner_product(a.v, b.v) as bigint) as score
    from usable a join usable b on a.vec_id <> b.vec_id and a.vec_id % 50 = 0
),
positives as (
    select anchor_id, other_id as positive_id, score as positive_score from scored where same
    qualify row_number() over (partition by anchor_id order by score desc, other_id) <= 5
)
select p.anchor_id, p.positive_id, cast(row_number() over best as integer) as rank, s.other_id as negative_id, p.positive_score, s.score as negative_score
from positives p join scored s on s.anchor_id = p.anchor_id and not s.same
     and 50 * p.positive_score <= 100 * s.score and 100 * s.score <= 95 * p.positive_score
window best as (partition by p.anchor_id, p.positive_id order by s.score desc, s.other_id)
qualify row_number() over best <= 3
"""
