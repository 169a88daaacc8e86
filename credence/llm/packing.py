"""Best-fit packing into sequences of a fixed size, by patterns fitted with non-negative least squares.

Tokens of every document are cut into pieces of at most `size` ids. Only the histogram of piece
lengths is planned on the driver: it has `size` entries however many documents there are.
Patterns of up to three lengths that fill a sequence are enumerated in units of `unit` ids rounded
up, and their repeat counts fitted to the histogram by non-negative least squares, rounded down.
They are filled with exact lengths; what is left over is packed best-fit, longest first, into the
room they really leave and into further sequences, on counts of equal lengths. If best fit alone
takes fewer sequences, its plan is used. Spark numbers the pieces of each length across partitions
and looks the number up in the plan, so no length, however frequent, meets in one task.

Null and empty texts are documents of the closing id alone. Repeated rows are packed repeatedly;
they are told apart by nothing but their place. Extra columns are left out. An empty table gives
an empty result.
"""

from __future__ import annotations

import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from credence.llm.numbering import numbered_within
from credence.llm.pieces import TokenBook, load_tokenizer
from credence.llm.textkit import slices_by_bytes, text_bytes
from credence.session import settle

SIZE, CLOSING, UNIT, DEPTH = 4096, 1, 16, 3
PIECES = "doc_id {kind}, piece int, start long, length long, ids_crc32 long"


def token_pieces(docs: DataFrame, tokenizer_path: str, size: int = SIZE, closing: int = CLOSING) -> DataFrame:
    """Every document's ids with the closing one, cut into pieces of `size`, as lengths and checksums."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        book = TokenBook(load_tokenizer(tokenizer_path), keeps_spaces=False, with_ids=True)
        for batch in slices_by_bytes(batches, "text"):
            ids, bounds = book.encoded(*text_bytes(batch.column(1)))
            row, piece, start, length, crc = [], [], [], [], []
            for i in range(batch.num_rows):
                own = np.append(ids[bounds[i] : bounds[i + 1]], closing).astype("<u4")
                for k, at in enumerate(range(0, own.size, size)):
                    part = own[at : at + size]
                    row.append(i)
                    piece.append(k)
                    start.append(at)
                    length.append(part.size)
                    crc.append(zlib.crc32(part.tobytes()))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))],
                names=["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    return docs.select("doc_id", "text").mapInArrow(cut, PIECES.format(kind=kind))


def fit_non_negative(matrix: np.ndarray, target: np.ndarray, tolerance: float = 1e-7) -> np.ndarray:
    """x >= 0 with least |matrix x - target|, by active sets."""
    count = matrix.shape[1]
    x, active = np.zeros(count), np.zeros(count, bool)
    slope = matrix.T @ target
    limit = tolerance * max(1.0, float(np.abs(slope).max(initial=0.0)))
    for _ in range(3 * matrix.shape[0]):
        open_slope = np.where(active, -np.inf, slope)
        best = int(np.argmax(open_slope))
        if open_slope[best] <= limit:
            break
        active[best] = True
        while True:
            chosen = np.flatnonzero(active)
            some = matrix[:, chosen]
            solved = np.linalg.solve(some.T @ some + 1e-9 * np.eye(chosen.size), some.T @ target)
            if solved.min() > 0:
                break
            falling = solved <= 0
            step = float(np.min(x[chosen][falling] / np.maximum(x[chosen][falling] - solved[falling], 1e-300)))
            x[chosen] += min(1.0, step) * (solved - x[chosen])
            active[chosen[x[chosen] <= 1e-12]] = False
            x[~active] = 0
            if not active.any():
                return x
        x[:] = 0
        x[chosen] = solved
        slope = matrix.T @ (target - matrix @ x)
    return x


def patterns(units: int, present: np.ndarray, depth: int = DEPTH) -> list[tuple[int, ...]]:
    """Descending lengths, of those that occur, that together fill a sequence exactly."""
    found: list[tuple[int, ...]] = []

    def extend(chosen: tuple[int, ...], rest: int) -> None:
        if rest == 0:
            found.append(chosen)
        elif len(chosen) < depth:
            for length in range(min(rest, chosen[-1] if chosen else rest), 0, -1):
                if present[length]:
                    extend((*chosen, length), rest - length)

    extend((), units)
    return found


def fitted_patterns(histogram: np.ndarray, unit: int) -> list[tuple[tuple[int, ...], int]]:
    """Patterns of lengths rounded up to units, the most repeated first, and how often to use each."""
    size = histogram.size - 1
    in_units = np.zeros(-(-size // unit) + 1, np.int64)
    np.add.at(in_units, -(-np.arange(size + 1) // unit), histogram)
    in_units = in_units[: size // unit + 1]
    chosen = patterns(in_units.size - 1, in_units > 0)
    if not chosen:
        return []
    matrix = np.zeros((in_units.size, len(chosen)))
    for k, pattern in enumerate(chosen):
        for length in pattern:
            matrix[length, k] += 1
    scale = max(1.0, float(in_units.max()))
    repeats = np.floor(fit_non_negative(matrix, in_units / scale) * scale + 1e-6).astype(np.int64)
    return [(chosen[k], int(repeats[k])) for k in np.argsort(-repeats, kind="stable") if repeats[k]]


def filled_sequences(histogram: np.ndarray, fitted: list[tuple[tuple[int, ...], int]], unit: int) -> list[tuple[tuple[int, ...], int]]:
    """Sequences of the fitted patterns, each unit by the longest lengths there are of it, and of all lengths left over."""
    size = histogram.size - 1
    left = histogram.astype(np.int64).copy()
    by_room: dict[int, dict[tuple[int, ...], int]] = defaultdict(dict)
    rooms = np.zeros(size + 1, np.int64)

    def put(room: int, lengths: tuple[int, ...], times: int) -> None:
        by_room[room][lengths] = by_room[room].get(lengths, 0) + times
        rooms[room] += times

    for pattern, times in fitted:
        while times:
            needed: Counter[int] = Counter()
            for units in pattern:
                of_unit = range(units * unit, (units - 1) * unit, -1)
                needed[next((n for n in of_unit if left[n] > needed[n]), 0)] += 1
            if needed[0]:
                break
            used = min(times, *(int(left[n]) // count for n, count in needed.items() if count))
            lengths = tuple(sorted((+needed).elements(), reverse=True))
            put(size - sum(lengths), lengths, used)
            for length in lengths:
                left[length] -= used
            times -= used
    # The rest, longest first, each into the fullest sequence that still takes it; equal sequences move together.
    for length in range(size, 0, -1):
        waiting = int(left[length])
        while waiting:
            fitting = rooms[length:] > 0
            nearest = int(np.argmax(fitting))
            if not fitting[nearest]:
                fits = size // length
                if waiting >= fits:
                    put(size - fits * length, (length,) * fits, waiting // fits)
                    waiting %= fits
                if waiting:
                    put(size - waiting * length, (length,) * waiting, 1)
                break
            room = length + nearest
            lengths, times = next(iter(by_room[room].items()))
            fits = min(room // length, waiting)
            used = min(times, waiting // fits)
            by_room[room][lengths] -= used
            if not by_room[room][lengths]:
                del by_room[room][lengths]
            rooms[room] -= used
            put(room - fits * length, lengths + (length,) * fits, used)
            waiting -= used * fits
    return [(lengths, times) for group in by_room.values() for lengths, times in group.items()]


def plan_packing(histogram: np.ndarray, unit: int = 1) -> list[tuple[tuple[int, ...], int]]:
    """Which lengths share a sequence, and in how many sequences; uses up the histogram exactly.

    With fitted patterns or by best fit alone, whichever takes fewer sequences.
    """
    plans = [filled_sequences(histogram, fitted, unit) for fitted in (fitted_patterns(histogram, unit), [])]
    return min(plans, key=lambda plan: sum(times for _, times in plan))


def places_in_plan(plan: list[tuple[tuple[int, ...], int]], histogram: np.ndarray):
    """With pieces numbered by length: each length's first number, and from which number on pieces go to which sequence and slot."""
    firsts = np.cumsum(histogram) - histogram
    taken = firsts.copy()
    rows: list[tuple[int, int, int]] = []
    sequence = 0
    for lengths, times in plan:
        for slot, length in enumerate(lengths):
            rows.append((int(taken[length]), sequence, slot))
            taken[length] += times
        sequence += times
    return firsts, *np.array(sorted(rows), np.int64).reshape(-1, 3).T


def pack(pieces: DataFrame, size: int = SIZE, unit: int = UNIT) -> DataFrame:
    """Adds sequence_id and offset to pieces that have doc_id, piece and length (1 to `size`)."""
    numbered, counts = numbered_within(pieces, "length", ["doc_id", "piece", "start"], "number")
    histogram = np.zeros(size + 1, np.int64)
    for row in counts.collect():  # at most `size` rows
        histogram[row["length"]] = row["rows"]
    firsts, starts, bases, slots = places_in_plan(plan_packing(histogram, unit), histogram)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths, numbers = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("length", "number"))
            among_all = firsts[lengths] + numbers
            at = np.searchsorted(starts, among_all, side="right") - 1
            sequences = bases[at] + among_all - starts[at]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sequences), pa.array(slots[at])], names=[*batch.schema.names, "sequence_id", "slot"])

    schema = numbered.withColumn("sequence_id", F.lit(0).cast("long")).withColumn("slot", F.lit(0).cast("long")).schema
    sequence = Window.partitionBy("sequence_id").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    placed = numbered.mapInArrow(place, schema).withColumn("offset", F.coalesce(F.sum("length").over(sequence), F.lit(0)))
    return placed.select(*pieces.columns, "sequence_id", "offset")


def pack_documents(docs: DataFrame, tokenizer_path: str, size: int = SIZE, closing: int = CLOSING, unit: int = UNIT) -> DataFrame:
    """All documents as pieces, each with its sequence and its place there."""
    # Dealing by ranges looks at its input twice; the texts are encoded once.
    return pack(settle(token_pieces(docs, tokenizer_path, size, closing)), size, unit)
