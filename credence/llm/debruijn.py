"""Removal of word runs that an earlier document has, by anchored runs of the k-mers of a word de Bruijn graph.

The edges of the graph are the k-mers (`width` successive words); an edge leads on to the k-mer
one word further. Only edges that may repeat are built: each stretch of k-mers with one anchor
(see `windows`) is kept if its anchor occurs elsewhere too. Such a stretch is a path, and one
row stands for all its k-mers, without a compaction of nonbranching paths by joins; equal paths are aggregated, and joins with the first document of
each path, and with the anchors that have more than one path, find where the graph branches.
Where it does not, a path is removed or kept as a whole. Where it does, the first occurrence of
each path is opened into its edges, read by its coordinates from the document's text, and each
edge is joined with the least document that has it. Coordinates of removed paths and edges meet
in the spans of their documents, which are taken out of the text itself.

Rows without a doc_id are left out. Null and empty texts have no words, nothing removed and the hash of no bytes. Texts shorter than
k words are kept whole. Rows that share a doc_id remove nothing from each other; where their texts differ they are told
apart by a hash of the text. Columns
beyond doc_id and text are left out. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from credence.llm.repeats import merged_spans, own_facts, per_document, repeated_rows, several_texts, short_keys
from credence.llm.textkit import PLACE, U64, mix, shingle_hashes, slices_by_bytes, text_bytes, word_runs, words_and_hashes
from credence.llm.windows import window_runs
from credence.session import settle

WIDTH, GRAM = 13, 5


def _runs(column: pa.Array, width: int, size: int):
    """Word hashes, first word per text, and the runs of windows of every text."""
    _, _, _, _, firsts, hashes = words_and_hashes(column, lower=False)
    grams = np.zeros(hashes.size, U64)
    own = shingle_hashes(hashes, size)
    grams[: own.size] = own
    return hashes, firsts, window_runs(grams, firsts, width, size)


def anchor_keys(docs: DataFrame, width: int = WIDTH, size: int = GRAM) -> DataFrame:
    """key, doc_id: every anchor of every document once."""

    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices_by_bytes(batches, "text"):
            _, _, (owner, _, _, keys) = _runs(batch.column(1), width, size)
            keys = short_keys(keys)
            order = np.lexsort((keys, owner))
            owner, keys = owner[order], keys[order]
            first = np.ones(owner.size, bool)
            first[1:] = (owner[1:] != owner[:-1]) | (keys[1:] != keys[:-1])
            yield pa.RecordBatch.from_arrays([pa.array(keys[first]), batch.column(0).take(pa.array(owner[first]))], names=["key", "doc_id"])

    return docs.select("doc_id", "text").mapInArrow(anchors, "key long, doc_id long")


def _paths(column: pa.Array, wanted: pa.Array, width: int, size: int):
    """Text, first word there, number of windows, anchor and hash of each path whose anchor its text's list has."""
    hashes, firsts, (owner, starts, counts, keys) = _runs(column, width, size)
    keys = short_keys(keys).view(U64)
    of_text = np.repeat(np.arange(len(wanted)), wanted.value_lengths().fill_null(0).to_numpy())
    known = mix(wanted.flatten().to_numpy().view(U64) + of_text.astype(U64) * PLACE[0])
    kept = np.isin(mix(keys + owner.astype(U64) * PLACE[0]), known)
    owner, starts, counts, keys = owner[kept], starts[kept], counts[kept], keys[kept]
    if not starts.size:
        return owner, starts, counts, keys, keys
    edges = shingle_hashes(hashes, width)
    inner = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    steps = mix(edges[np.repeat(starts, counts) + inner] + inner.astype(U64) * PLACE[1])
    path = mix(np.add.reduceat(steps, np.cumsum(counts) - counts) + counts.astype(U64))
    return owner, starts - firsts[owner], counts, keys, path


def repeated_paths(docs: DataFrame, shared: DataFrame, width: int = WIDTH, size: int = GRAM) -> DataFrame:
    """anchor, path, doc_id, text_key, start and edges (their number) of each stretch of k-mers whose anchor is shared."""
    # An id with several texts says so beside its keys, with a key that no anchor has.
    shared = shared.select("key", "doc_id").unionByName(several_texts(docs).select(F.lit(-1).cast("long").alias("key"), "doc_id"))

    def paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices_by_bytes(batches, "text"):
            owner, starts, counts, keys, path = _paths(batch.column(1), batch.column(2), width, size)
            ids = batch.column(0).take(pa.array(owner))
            lengths = batch.column(2).value_lengths().fill_null(0).to_numpy()
            several = np.zeros(batch.num_rows, bool)
            several[np.repeat(np.arange(batch.num_rows), lengths)[batch.column(2).flatten().to_numpy() == -1]] = True
            texts_of = np.where(several, batch.column(3).to_numpy(), 0)[owner]
            columns = [pa.array(keys.view(np.int64)), pa.array(path.view(np.int64)), ids, pa.array(texts_of), pa.array(starts.astype(np.int32)), pa.array(counts.astype(np.int32))]
            yield pa.RecordBatch.from_arrays(columns, names=["anchor", "path", "doc_id", "text_key", "start", "edges"])

    return per_document(docs, shared, ["key"]).mapInArrow(paths, "anchor long, path long, doc_id long, text_key long, start int, edges int")


def opened_paths(docs: DataFrame, paths: DataFrame, width: int = WIDTH) -> DataFrame:
    """edge, doc_id, text_key, start of every k-mer of the paths, read from the documents' texts."""

    def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices_by_bytes(batches, "text"):
            _, _, _, _, firsts, hashes = words_and_hashes(batch.column(1), lower=False)
            edges = shingle_hashes(hashes, width)
            lengths = batch.column(2).value_lengths().fill_null(0).to_numpy()
            row = np.repeat(np.arange(batch.num_rows), lengths)
            places, counts, texts_of = (batch.column(k).flatten().to_numpy().astype(np.int64) for k in (2, 3, 4))
            mine = (texts_of == 0) | (texts_of == batch.column(5).to_numpy()[row])
            row, places, counts, texts_of = row[mine], places[mine], counts[mine], texts_of[mine]
            inner = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
            owner = np.repeat(row, counts)
            starts = np.repeat(places, counts) + inner
            found = edges[starts + firsts[owner]] if starts.size else edges[:0]
            columns = [pa.array(found.view(np.int64)), batch.column(0).take(pa.array(owner)), pa.array(np.repeat(texts_of, counts)), pa.array(starts.astype(np.int32))]
            yield pa.RecordBatch.from_arrays(columns, names=["edge", "doc_id", "text_key", "start"])

    return per_document(docs, paths, ["start", "edges", "text_key"]).mapInArrow(opened, "edge long, doc_id long, text_key long, start int")


def removed_spans(docs: DataFrame, paths: DataFrame, width: int = WIDTH) -> DataFrame:
    """doc_id, text_key, start, stop (word places) of what an earlier document has."""
    # A node of the compacted graph is a path with the first document that has it.
    nodes = paths.groupBy("anchor", "path").agg(F.min("doc_id").alias("first_doc"))
    placed = paths.join(nodes, ["anchor", "path"])
    # All of a path is removed in later documents; in the first one, what it shares with other paths where the graph branches.
    later = placed.filter("doc_id > first_doc").select("doc_id", "text_key", "start", (F.col("start") + F.col("edges") + F.lit(width - 1)).alias("stop"))
    branching = nodes.groupBy("anchor").agg(F.count(F.lit(1)).alias("ways")).filter("ways > 1").select("anchor")
    first = placed.filter("doc_id = first_doc").join(branching, "anchor")
    opened = opened_paths(docs, first, width)
    least = opened.groupBy("edge").agg(F.min("doc_id").alias("least_doc"))
    earlier = opened.join(least, "edge").filter("least_doc < doc_id")
    return later.unionByName(earlier.select("doc_id", "text_key", "start", (F.col("start") + F.lit(width)).alias("stop")))


def remove_repeats(docs: DataFrame, width: int = WIDTH, size: int = GRAM) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every document."""

    def rest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices_by_bytes(batches, "text"):
            data, bounds = text_bytes(batch.column(1))
            starts, ends, firsts = word_runs(data, bounds)
            counts, removed, digests = np.diff(firsts), np.zeros(batch.num_rows, np.int64), []
            for i in range(batch.num_rows):
                a, b = int(firsts[i]), int(firsts[i + 1])
                kept = np.ones(b - a, bool)
                for start, stop in zip(*merged_spans(*own_facts(batch, i, (2, 3), 4, 5)), strict=True):
                    kept[start:stop] = False
                removed[i] = b - a - int(kept.sum())
                digests.append(_words_digest(data, starts[a:b][kept], ends[a:b][kept]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts), pa.array(removed), pa.array(digests, pa.string())],
                names=["doc_id", "n_words", "n_removed", "kept_sha256"],
            )

    docs = docs.filter("doc_id is not null")
    shared = settle(repeated_rows(anchor_keys(docs, width, size)))
    spans = removed_spans(docs, repeated_paths(docs, shared, width, size), width)
    joined = per_document(docs, spans, ["start", "stop", "text_key"])
    return joined.mapInArrow(rest, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def _words_digest(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> str:
    """SHA-256 of words joined by one space."""
    if not starts.size:
        return hashlib.sha256(b"").hexdigest()
    sizes = ends - starts + 1
    at = np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
    joined = data[np.minimum(at, data.size - 1)]
    joined[np.cumsum(sizes) - 1] = 0x20
    return hashlib.sha256(joined[:-1].tobytes()).hexdigest()
