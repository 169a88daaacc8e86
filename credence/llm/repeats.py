"""Rows whose key occurs more than once, and joins of small facts back to whole texts.

`repeated_rows` deals rows by key once. A key that is already repeated within a map task's rows
needs no further proof: its rows are dealt at random, and one witness per task tells the others.
However frequent a key, no task gets more of its rows than there are map tasks.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from credence.llm.textkit import U64

BUFFERED = 500_000
KEY_BITS = 48
OPEN, WITNESS, PROVEN = 0, 1, 2


def short_keys(hashes: np.ndarray) -> np.ndarray:
    """Keys for repeated_rows: 48 bits of a hash, so that a state fits beside it in one number."""
    return (hashes & U64((1 << KEY_BITS) - 1)).view(np.int64)


def repeated_rows(rows: DataFrame, key: str = "key") -> DataFrame:
    """The rows of a table whose 48-bit `key` another row has too. Rows come and go as they are."""
    at_key = rows.columns.index(key)

    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def flush() -> Iterator[pa.RecordBatch]:
            table = pa.Table.from_batches(held).combine_chunks()
            held.clear()
            keys = table.column(at_key).to_numpy()
            _, first, inverse, counts = np.unique(keys, return_index=True, return_inverse=True, return_counts=True)
            witnesses = first[counts > 1]
            tagged = keys * 4 + np.where(counts[inverse] > 1, PROVEN, OPEN)
            out = table.take(pa.array(np.concatenate([np.arange(keys.size), witnesses])))
            tags = pa.array(np.concatenate([tagged, keys[witnesses] * 4 + WITNESS]), pa.int64())
            yield from out.set_column(at_key, key, tags).combine_chunks().to_batches(max_chunksize=100_000)

        for batch in batches:
            if batch.num_rows:
                held.append(batch)
            if sum(b.num_rows for b in held) >= BUFFERED:
                yield from flush()
        if held:
            yield from flush()

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Streams rows sorted by proof and key; holds back at most one row."""
        pending: pa.RecordBatch | None = None
        last_key, last_weight = None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            tags = batch.column(at_key).to_numpy()
            keys, states = tags >> 2, tags & 3
            own = batch.set_column(at_key, key, pa.array(keys))
            proven = states == PROVEN
            weights = np.where(states == OPEN, 1, 2)
            starts = np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]) | (proven[1:] != proven[:-1])]))
            sums = np.add.reduceat(weights, starts)
            if last_key is not None and not proven[0] and int(keys[0]) == last_key:
                sums[0] += last_weight
                if pending is not None:
                    yield pending
            pending = None
            chosen = np.repeat(sums > 1, np.diff(np.append(starts, keys.size))) & (states != WITNESS)
            if chosen.any():
                yield own.filter(pa.array(chosen))
            last_key, last_weight = (None, 0) if proven[-1] else (int(keys[-1]), int(sums[-1]))
            if last_weight == 1:
                pending = own.slice(batch.num_rows - 1, 1)

    proven = F.col(key).bitwiseAND(3) == PROVEN
    plain = F.shiftright(key, 2)
    dealt = rows.mapInArrow(tell, rows.schema).repartition(F.when(proven, F.xxhash64(*rows.columns)).otherwise(plain))
    return dealt.sortWithinPartitions(proven, plain).mapInArrow(keep, rows.schema)


def merged_spans(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unions of overlapping or touching spans, in order."""
    if not starts.size:
        return starts, ends
    order = np.argsort(starts, kind="stable")
    starts, ends = starts[order], np.maximum.accumulate(ends[order])
    fresh = np.flatnonzero(np.concatenate([[True], starts[1:] > ends[:-1]]))
    return starts[fresh], np.append(ends[fresh[1:] - 1], ends[-1])


def several_texts(docs: DataFrame) -> DataFrame:
    """doc_id of the rows that share it but not their text."""
    text = F.xxhash64("text")
    return docs.groupBy("doc_id").agg(F.min(text).alias("low"), F.max(text).alias("high")).filter("low <> high").select("doc_id")


def text_key() -> Column:
    """Tells texts of one doc_id apart; never 0, which stands for any text."""
    own = F.xxhash64("text")
    return F.when(own == 0, F.lit(1).cast("long")).otherwise(own)


def per_document(docs: DataFrame, facts: DataFrame, columns: list[str], carried: tuple[str, ...] = ()) -> DataFrame:
    """Text, doc_id, text_key and its facts as lists (null without any) of every document row, then the carried columns.

    Read the result by place: doc_id, text, one list per name in `columns`, text_key, carried. Carried columns may
    have any name; the others get names that none of them has, in either case.
    A document has no more facts than its text has places, so a list is bounded by its own text.
    Always a left join of the same columns: a plan that joins texts twice deals them once.
    """
    mark = "_"
    while any(c.lower().startswith(mark) for c in carried):
        mark += "_"
    own = facts.groupBy("doc_id").agg(*[F.collect_list(c).alias(f"{mark}{c}") for c in columns])
    joined = docs.select("doc_id", "text", *carried).join(own, "doc_id", "left")
    return joined.select("doc_id", "text", *[f"{mark}{c}" for c in columns], text_key().alias(f"{mark}text"), *carried)


def own_facts(batch: pa.RecordBatch, row: int, places: Sequence[int], at_key: int, at_text: int) -> list[np.ndarray]:
    """The facts of one row of `per_document` in the list columns `places`, without those of another text of its doc_id."""
    if not batch.column(at_key)[row].is_valid:
        return [np.zeros(0, np.int64) for _ in places]
    keys = np.array(batch.column(at_key)[row].values, np.int64)
    mine = (keys == 0) | (keys == batch.column(at_text)[row].as_py())
    return [np.array(batch.column(k)[row].values, np.int64)[mine] for k in places]
