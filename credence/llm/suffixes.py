"""Removal of long byte strings that start earlier too, by suffix sorting in blocks with a difference cover.

Every string of `width` bytes is a window. Runs of windows with one anchor (see `windows`) whose
anchor occurs again are dealt by anchor, so equal windows meet. A block is the text of the runs of
some anchors. Its windows are sorted one suffix bucket (by leading bytes) at a time: first by 16
bytes, then long ties by ranks of a cover sample. The sample holds places 0, 1 and 3 of every 7;
any two places have a common shift below 7 that takes both into the sample. Its ranks, to a depth
beyond `width`, are computed once per block by doubling, so a tie is settled by one look-up,
however long it is, and memory stays at a few words per byte of the block. Neighbours in suffix
order that agree in `width` bytes are copies; the earliest of them stays.

Before runs are dealt, equal runs within a map task shrink to their earliest, and again within a
block; the others are copies as a whole. An anchor with more than `HOT_ROWS` rows is opened into
its windows, dealt by their content, so no anchor gathers in one task.

Rows without a doc_id are left out. Null text is empty: no bytes, nothing removed. Texts shorter than `width` are kept whole. doc_id
names a document: repeated rows of it are the same document and remove nothing from each other. Rows
that share a doc_id but not their text are told apart by a hash of the text; among them, too, only a
string that starts at a smaller place is earlier.
Columns beyond doc_id and text are left out. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from credence.llm.repeats import merged_spans, own_facts, per_document, repeated_rows, several_texts, short_keys
from credence.llm.textkit import PLACE, U64, mix, run_hashes, slices_by_bytes, text_bytes
from credence.llm.windows import gram_hashes, window_runs
from credence.session import settle

WIDTH, GRAM = 100, 32
HOT_ROWS = 50_000
BLOCK_BYTES, BUCKET = 1 << 20, 1 << 16
PERIOD, COVER = 7, (0, 1, 3)

SHIFT = np.array([[next(d for d in range(PERIOD) if (i + d) % PERIOD in COVER and (j + d) % PERIOD in COVER) for j in range(PERIOD)] for i in range(PERIOD)])
SPAN, RUN = 0, 1


def cover_ranks(words: np.ndarray, depth: int) -> np.ndarray:
    """Ranks of the suffixes at cover places, equal only if they agree in `depth` bytes. words: 8 bytes from each place on."""
    size = words.size
    sample = np.flatnonzero(np.isin(np.arange(size) % PERIOD, COVER))
    ranks = np.zeros(size + PERIOD + depth * 2, np.int64)
    ranks[sample] = np.unique(words[sample], return_inverse=True)[1] + 1
    known, step = 8, PERIOD
    while known < depth:
        pairs = (ranks[sample].astype(U64) << U64(32)) | ranks[sample + step].astype(U64)
        ranks[sample] = np.unique(pairs, return_inverse=True)[1] + 1
        known, step = known + step, min(2 * step, (known + step) // PERIOD * PERIOD)
    return ranks


def _settle_ties(places: np.ndarray, groups: np.ndarray, ranks: np.ndarray) -> np.ndarray:
    """Sorts places within groups that tie in at least PERIOD bytes; all groups are split around a pivot at once."""
    open_at = np.flatnonzero(np.bincount(groups)[groups] > 1)
    tags = groups[open_at]
    while open_at.size:
        heads = np.flatnonzero(np.concatenate([[True], tags[1:] != tags[:-1]]))
        sizes = np.diff(np.append(heads, tags.size))
        own = places[open_at]
        pivot = np.repeat(own[heads + sizes // 2], sizes)
        shift = SHIFT[own % PERIOD, pivot % PERIOD]
        side = np.sign(ranks[own + shift] - ranks[pivot + shift]) + 1
        split = np.repeat(np.arange(heads.size), sizes) * 3 + side
        order = np.argsort(split, kind="stable")
        places[open_at], tags = own[order], split[order]
        left = (tags % 3 != 1) & (np.bincount(tags)[tags] > 1)
        open_at, tags = open_at[left], tags[left]
    return places


def window_classes(text: np.ndarray, places: np.ndarray, width: int = WIDTH, bucket: int = BUCKET) -> tuple[np.ndarray, np.ndarray]:
    """Places in suffix order, and a class for each: equal just for places with the same `width` bytes."""
    padded = np.concatenate([text, np.zeros(2 * width + 32, np.uint8)])
    words = np.ndarray((padded.size - 7,), ">u8", buffer=padded, strides=(1,)).astype(U64)
    ranks = cover_ranks(words, width + PERIOD)
    leading = (words[places] >> U64(48)).astype(np.int64)
    counts = np.bincount(leading, minlength=1 << 16)
    by_bucket = (np.cumsum(counts) - counts) // bucket  # leading bytes of one bucket are neighbours
    order = np.argsort(leading, kind="stable")
    edges = np.flatnonzero(np.diff(by_bucket[leading[order]], prepend=-1, append=1 << 62))
    found = []
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        own = places[order[a:b]]
        first, second = words[own], words[own + 8]
        within = np.lexsort((second, first))
        own, first, second = own[within], first[within], second[within]
        changes = np.concatenate([[0], (first[1:] != first[:-1]) | (second[1:] != second[:-1])])
        found.append(_settle_ties(own, np.cumsum(changes), ranks))
    ordered = np.concatenate(found) if found else places
    same = np.ones(max(0, ordered.size - 1), bool)
    for at in [*range(0, width - 7, 8), width - 8]:
        step = words[ordered + at]
        same &= step[1:] == step[:-1]
    return ordered, np.cumsum(np.concatenate([[0], ~same])) if ordered.size else np.zeros(0, np.int64)


def _runs(column: pa.Array, width: int, size: int):
    data, bounds = text_bytes(column)
    own = gram_hashes(data, size)
    grams = np.zeros(data.size, U64)
    grams[: own.size] = own
    return data, bounds, window_runs(grams, bounds, width, size)


def anchor_keys(docs: DataFrame, width: int = WIDTH, size: int = GRAM) -> DataFrame:
    """key, doc_id: one row per run of windows."""

    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices_by_bytes(batches, "text"):
            _, _, (owner, _, _, keys) = _runs(batch.column(1), width, size)
            yield pa.RecordBatch.from_arrays([pa.array(short_keys(keys)), batch.column(0).take(pa.array(owner))], names=["key", "doc_id"])

    return docs.select("doc_id", "text").mapInArrow(anchors, "key long, doc_id long")


DEALT = "route long, kind byte, anchor long, doc_id long, text_key long, start int, stop int, text binary"
DEALT_NAMES = [f.split()[0] for f in DEALT.split(", ")]


def dealt_runs(docs: DataFrame, width: int = WIDTH, size: int = GRAM, hot_rows: int = HOT_ROWS, carried: tuple[str, ...] = ()) -> DataFrame:
    """Runs with repeated anchors, and spans already known to be copies."""
    shared = settle(repeated_rows(anchor_keys(docs, width, size)))
    hot = shared.groupBy("key").agg(F.count(F.lit(1)).alias("rows")).filter(F.col("rows") > hot_rows).select("key", F.lit(True).alias("hot"))
    marked = shared.join(hot, "key", "left").select("key", "doc_id", F.coalesce("hot", F.lit(False)).alias("hot"), F.lit(False).alias("several"))
    # An id with several texts says so beside its keys; its own key is none of theirs.
    marked = marked.unionByName(several_texts(docs).select(F.lit(-1).cast("long").alias("key"), "doc_id", F.lit(False).alias("hot"), F.lit(True).alias("several")))

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices_by_bytes(batches, "text"):
            data, bounds, (owner, starts, counts, keys) = _runs(batch.column(1), width, size)
            keys = short_keys(keys).view(U64)
            of_text = np.repeat(np.arange(batch.num_rows), batch.column(2).value_lengths().fill_null(0).to_numpy())
            known = mix(batch.column(2).flatten().to_numpy().view(U64) + of_text.astype(U64) * PLACE[0])
            opened = known[batch.column(3).flatten().to_numpy(zero_copy_only=False)]
            own = mix(keys + owner.astype(U64) * PLACE[0])
            kept, split = np.isin(own, known), np.isin(own, opened)
            whole = kept & ~split
            inner = np.arange(counts[split].sum()) - np.repeat(np.cumsum(counts[split]) - counts[split], counts[split])
            heads = np.concatenate([starts[whole], np.repeat(starts[split], counts[split]) + inner])
            if not heads.size:
                continue
            owners = np.concatenate([owner[whole], np.repeat(owner[split], counts[split])])
            stops = heads + np.concatenate([counts[whole], np.ones(inner.size, np.int64)]) + (width - 1)
            hashes = run_hashes(data, heads, stops)
            anchors = np.concatenate([keys[whole], hashes[whole.sum() :]])
            ids = batch.column(0).to_numpy()[owners]
            places = heads - bounds[owners]
            several = np.zeros(batch.num_rows, bool)
            several[of_text[batch.column(4).flatten().to_numpy(zero_copy_only=False)]] = True
            texts_of = np.where(several, batch.column(5).to_numpy(), 0)[owners]
            # Equal runs: all but the earliest are copies, and need not travel with their text.
            order, first, drop = _standing(hashes, ids, places, texts_of)
            kinds = np.empty(order.size, np.int8)
            kinds[order] = np.where(first, RUN, SPAN)
            rows = np.flatnonzero(~drop)
            raw = data.tobytes()
            texts = [raw[a:b] if k == RUN else None for a, b, k in zip(heads[rows].tolist(), stops[rows].tolist(), kinds[rows].tolist(), strict=True)]
            routes = np.where(kinds == RUN, anchors, mix(hashes + heads.astype(U64)))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(routes[rows].view(np.int64)),
                    pa.array(kinds[rows]),
                    pa.array(anchors[rows].view(np.int64)),
                    pa.array(ids[rows], pa.int64()),
                    pa.array(texts_of[rows], pa.int64()),
                    pa.array(places[rows].astype(np.int32)),
                    pa.array((stops - bounds[owners])[rows].astype(np.int32)),
                    pa.array(texts, pa.binary()),
                ],
                names=DEALT_NAMES,
            )

    return per_document(docs, marked, ["key", "hot", "several"], carried).mapInArrow(runs, DEALT)


def _standing(hashes: np.ndarray, ids: np.ndarray, starts: np.ndarray, texts_of: np.ndarray):
    """Order of runs by content and place; which of them stand, and which, in their own order, are another's very same row.

    Of equal runs the earliest stands, once for every text of its doc_id that has it there.
    """
    order = np.lexsort((texts_of, starts, ids, hashes))
    fresh = np.ones(order.size, bool)
    fresh[1:] = hashes[order[1:]] != hashes[order[:-1]]
    lead = order[np.maximum.accumulate(np.where(fresh, np.arange(order.size), 0))]
    beside = ~fresh & (ids[order] == ids[lead]) & (starts[order] == starts[lead])
    other_text = np.zeros(order.size, bool)
    other_text[1:] = texts_of[order[1:]] != texts_of[order[:-1]]
    same = np.zeros(order.size, bool)
    same[order] = beside & ~other_text
    return order, fresh | (beside & other_text), same


def block_spans(anchors: np.ndarray, ids: np.ndarray, texts_of: np.ndarray, starts: np.ndarray, texts: list[bytes], width: int = WIDTH):
    """doc_id, text_key, start and stop of the copies among runs, all of whose anchors are here in full."""
    data = np.frombuffer(b"".join(texts), np.uint8)
    sizes = np.array([len(t) for t in texts], np.int64)
    ends = np.cumsum(sizes)
    heads = ends - sizes
    order, first, same = _standing(run_hashes(data, heads, ends), ids, starts, texts_of)
    copies = order[~first]
    copies = copies[~same[copies]]
    spans = [(ids[copies], texts_of[copies], starts[copies], starts[copies] + sizes[copies])]
    kept = order[first]
    # Only anchors with several different runs leave anything to sort.
    _, inverse, ways = np.unique(anchors[kept], return_inverse=True, return_counts=True)
    kept = kept[ways[inverse] > 1]
    if kept.size:
        lengths = sizes[kept]
        bases = np.cumsum(lengths) - lengths
        block = data[np.repeat(heads[kept] - bases, lengths) + np.arange(lengths.sum())]
        windows = lengths - (width - 1)
        row = np.repeat(np.arange(kept.size), windows)
        step = np.arange(windows.sum()) - np.repeat(np.cumsum(windows) - windows, windows)
        places = bases[row] + step
        owner = np.zeros(block.size, np.int64)
        owner[places] = np.arange(places.size)
        ordered, classes = window_classes(block, places, width)
        at = owner[ordered]
        doc, start = ids[kept][row[at]], starts[kept][row[at]] + step[at]
        by_class = np.lexsort((start, doc, classes))
        own = classes[by_class]
        later = np.zeros(by_class.size, bool)
        later[1:] = own[1:] == own[:-1]
        lead = np.maximum.accumulate(np.where(later, 0, np.arange(later.size)))
        later &= (doc[by_class] != doc[by_class[lead]]) | (start[by_class] != start[by_class[lead]])
        copied = np.sort(at[by_class[later]])
        if copied.size:
            fresh = np.ones(copied.size, bool)
            fresh[1:] = (copied[1:] != copied[:-1] + 1) | (row[copied[1:]] != row[copied[:-1]])
            a = np.flatnonzero(fresh)
            b = np.append(a[1:] - 1, copied.size - 1)
            of = kept[row[copied[a]]]
            spans.append((ids[of], texts_of[of], starts[of] + step[copied[a]], starts[of] + step[copied[b]] + width))
    return tuple(np.concatenate(x) for x in zip(*spans, strict=True))


def copied_spans(dealt: DataFrame, width: int = WIDTH) -> DataFrame:
    """doc_id, text_key, start, stop (bytes) of every string of `width` bytes or more that starts earlier too."""

    def spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        held_bytes = 0

        def out(doc, text_of, start, stop):
            columns = [pa.array(doc, pa.int64()), pa.array(text_of, pa.int64()), pa.array(start.astype(np.int32)), pa.array(stop.astype(np.int32))]
            return pa.RecordBatch.from_arrays(columns, names=["doc_id", "text_key", "start", "stop"])

        def block() -> Iterator[pa.RecordBatch]:
            if held:
                whole = pa.Table.from_batches(held).combine_chunks()
                anchors, ids, texts_of, starts = (whole.column(c).to_numpy() for c in ("anchor", "doc_id", "text_key", "start"))
                found = block_spans(anchors, ids, texts_of, starts.astype(np.int64), whole.column("text").to_pylist(), width)
                if found[0].size:
                    yield out(*found)
                held.clear()

        for batch in batches:
            if not batch.num_rows:
                continue
            kinds = batch.column(1).to_numpy()
            cut = int(np.searchsorted(kinds, RUN))  # sorted: spans come first
            if cut:
                yield batch.slice(0, cut).select(["doc_id", "text_key", "start", "stop"])
            rest = batch.slice(cut)
            anchors = rest.column(2).to_numpy()
            edges = [0, *(np.flatnonzero(anchors[1:] != anchors[:-1]) + 1).tolist(), anchors.size] if anchors.size else []
            bytes_to = np.cumsum((rest.column(6).to_numpy() - rest.column(5).to_numpy()).astype(np.int64)) if anchors.size else None
            begun = 0
            last = int(held[-1].column(2)[-1].as_py()) if held else None
            for a in edges[:-1]:
                size = held_bytes + int(bytes_to[a - 1] if a else 0) - int(bytes_to[begun - 1] if begun else 0)
                if size >= BLOCK_BYTES and int(anchors[a]) != last:
                    if a > begun:
                        held.append(rest.slice(begun, a - begun))
                    yield from block()
                    held_bytes, begun = 0, a
                last = int(anchors[a])
            if anchors.size > begun:
                held.append(rest.slice(begun))
                held_bytes += int(bytes_to[-1]) - int(bytes_to[begun - 1] if begun else 0)
        yield from block()

    return dealt.repartition("route").sortWithinPartitions("kind", "anchor").mapInArrow(spans, "doc_id long, text_key long, start int, stop int")


def kept_bytes(text: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    steps = np.zeros(text.size + 1, np.int32)
    steps[starts] += 1
    steps[stops] -= 1
    return text[np.cumsum(steps)[:-1] == 0]


def _without_copies(docs: DataFrame, carried: tuple[str, ...], width: int, size: int, hot_rows: int) -> DataFrame:
    """doc_id, text, lists of starts, stops and text keys of copied strings, the text's own key, and the carried columns."""
    docs = docs.filter("doc_id is not null")
    spans = copied_spans(dealt_runs(docs, width, size, hot_rows, carried), width)
    return per_document(docs, spans, ["start", "stop", "text_key"], carried)


def _spans(batch: pa.RecordBatch, row: int) -> tuple[np.ndarray, np.ndarray]:
    return merged_spans(*own_facts(batch, row, (2, 3), 4, 5))


def remove_copies(docs: DataFrame, width: int = WIDTH, size: int = GRAM, hot_rows: int = HOT_ROWS) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every document."""

    def rest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices_by_bytes(batches, "text"):
            data, bounds = text_bytes(batch.column(1))
            removed, spans, digests = [], [], []
            for i in range(batch.num_rows):
                starts, stops = _spans(batch, i)
                kept = kept_bytes(data[bounds[i] : bounds[i + 1]], starts, stops)
                removed.append(int(bounds[i + 1] - bounds[i]) - kept.size)
                spans.append(starts.size)
                digests.append(hashlib.sha256(kept.tobytes()).hexdigest())
            numbers = [pa.array(x, pa.int64()) for x in (np.diff(bounds), removed, spans)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *numbers, pa.array(digests, pa.string())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    return _without_copies(docs, (), width, size, hot_rows).mapInArrow(rest, schema)


def without_copies(docs: DataFrame, width: int = WIDTH, size: int = GRAM, hot_rows: int = HOT_ROWS) -> DataFrame:
    """The documents with the copied strings taken out of their texts, other columns as they are.

    A character of which some bytes were removed goes as a whole. Null texts stay null.
    """
    carried = tuple(c for c in docs.columns if c not in ("doc_id", "text"))

    def rest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices_by_bytes(batches, "text"):
            data, bounds = text_bytes(batch.column(1))
            texts = []
            for i, known in enumerate(batch.column(1).is_valid().to_pylist()):
                kept = kept_bytes(data[bounds[i] : bounds[i + 1]], *_spans(batch, i))
                texts.append(kept.tobytes().decode("utf-8", "ignore") if known else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), *batch.columns[6:]], names=["doc_id", "text", *carried])

    columns = ["doc_id", "text", *carried]
    cleaned = _without_copies(docs, carried, width, size, hot_rows).mapInArrow(rest, docs.select(*columns).schema)
    return cleaned.select(*docs.columns)
