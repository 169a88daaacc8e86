"""Language identification by a byte convolutional network.

A text is cut into windows of WINDOW bytes (the last one filled with zeros). Filters of several
widths slide over the one-hot bytes of a window, so a filter's answer is a sum of table entries;
the greatest answer of each filter over the window passes through a ramp, and a softmax layer gives
the languages' probabilities. A text's probabilities are the mean over its windows, weighted by
their bytes. The network is trained in numpy, in one Spark task, on at most WINDOWS_PER_LANGUAGE
windows of each language, taken from at most DOCS_PER_LANGUAGE labelled documents of least id
hash; some are shortened, so that short texts are known too. Only text and language are read.

Every window of a text is judged. Null texts and texts without a letter are `und` with score 0, and so is every text if there are no labels. Repeated
rows get equal answers. Extra columns are left out. An empty table gives an empty result.
"""

from __future__ import annotations

import io
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from credence.llm.textkit import LOWER, slices_by_bytes, text_bytes

WINDOW = 256
WIDTHS, FILTERS = (2, 3, 4), 16
DOCS_PER_LANGUAGE, WINDOWS_PER_LANGUAGE = 1500, 2500
EPOCHS, BATCH, RATE, DECAY = 12, 64, 0.01, 1e-4
UNDETERMINED = "und"
_ASCII_LETTER = re.compile(rb"[A-Za-z]")


class ByteNetwork:
    """Filter tables (width, byte, filter), their thresholds, and the softmax layer."""

    def __init__(self, languages: list[str], tables, offsets, weights, bias):
        self.languages, self.tables, self.offsets, self.weights, self.bias = languages, tables, offsets, weights, bias

    @classmethod
    def new(cls, languages: list[str], rng: np.random.Generator) -> ByteNetwork:
        tables = [rng.normal(0, 0.1, (w, 256, FILTERS)).astype(np.float32) for w in WIDTHS]
        count = FILTERS * len(WIDTHS)
        weights = rng.normal(0, 0.1, (count, len(languages))).astype(np.float32)
        return cls(languages, tables, np.zeros(count, np.float32), weights, np.zeros(len(languages), np.float32))

    def parameters(self) -> list[np.ndarray]:
        return [*self.tables, self.offsets, self.weights, self.bias]

    def pooled(self, windows: np.ndarray, places: list | None = None) -> np.ndarray:
        """The greatest answer of every filter in every window; `places` gets where."""
        found = []
        for table in self.tables:
            width = table.shape[0]
            count = windows.shape[1] - width + 1
            answers = table[0][windows[:, :count]]
            for k in range(1, width):
                answers += table[k][windows[:, k : k + count]]
            if places is not None:
                at = answers.argmax(axis=1)
                places.append(at)
                found.append(np.take_along_axis(answers, at[:, None], axis=1)[:, 0])
            else:
                found.append(answers.max(axis=1))
        return np.concatenate(found, axis=1) + self.offsets

    def probabilities(self, windows: np.ndarray) -> np.ndarray:
        return _softmax(np.maximum(self.pooled(windows), 0) @ self.weights + self.bias)

    def gradients(self, windows: np.ndarray, targets: np.ndarray) -> list[np.ndarray]:
        """Of the mean cross-entropy; through a maximum only the place it was taken from learns."""
        places: list[np.ndarray] = []
        pooled = self.pooled(windows, places)
        hidden = np.maximum(pooled, 0)
        error = _softmax(hidden @ self.weights + self.bias)
        error[np.arange(targets.size), targets] -= 1
        error /= targets.size
        back = (error @ self.weights.T) * (pooled > 0)
        tables = []
        rows = np.arange(targets.size)[:, None]
        filters = np.arange(FILTERS)[None]
        for k, (table, at) in enumerate(zip(self.tables, places, strict=True)):
            own = back[:, k * FILTERS : (k + 1) * FILTERS]
            grad = np.zeros_like(table)
            for step in range(table.shape[0]):
                np.add.at(grad[step], (windows[rows, at + step], np.broadcast_to(filters, at.shape)), own)
            tables.append(grad)
        return [*tables, back.sum(axis=0), hidden.T @ error + DECAY * self.weights, error.sum(axis=0)]

    def dump(self) -> bytes:
        out = io.BytesIO()
        np.savez_compressed(out, *self.parameters())
        return out.getvalue()

    @classmethod
    def load(cls, languages: list[str], raw: bytes) -> ByteNetwork:
        with np.load(io.BytesIO(raw)) as stored:
            *tables, offsets, weights, bias = (stored[f"arr_{k}"] for k in range(len(WIDTHS) + 3))
        return cls(languages, tables, offsets, weights, bias)


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def fit(windows: np.ndarray, targets: np.ndarray, languages: list[str], epochs: int = EPOCHS) -> ByteNetwork:
    """Adam over shuffled batches; the same input gives the same network."""
    rng = np.random.Generator(np.random.PCG64(1618))
    network = ByteNetwork.new(languages, rng)
    means = [np.zeros_like(p) for p in network.parameters()]
    squares = [np.zeros_like(p) for p in network.parameters()]
    step = 0
    for epoch in range(epochs):
        order = rng.permutation(targets.size)
        for at in range(0, order.size, BATCH):
            step += 1
            own = order[at : at + BATCH]
            rate = RATE * (1 - epoch / epochs) * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
            for p, g, m, s in zip(network.parameters(), network.gradients(windows[own], targets[own]), means, squares, strict=True):
                m += 0.1 * (g - m)
                s += 0.001 * (g * g - s)
                p -= (rate * m / (np.sqrt(s) + 1e-8)).astype(np.float32)
    return network


def windows_of(data: np.ndarray, bounds: np.ndarray, size: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased windows of every text, the text each belongs to, and how many bytes it holds."""
    lengths = np.diff(bounds)
    counts = -(-lengths // size)
    owner = np.repeat(np.arange(lengths.size), counts)
    inner = np.arange(owner.size) - np.repeat(np.cumsum(counts) - counts, counts)
    starts = bounds[owner] + inner * size
    held = np.minimum(size, bounds[owner + 1] - starts)
    if not owner.size:
        return np.zeros((0, size), np.uint8), owner, held
    at = starts[:, None] + np.arange(size)
    windows = LOWER[data[np.minimum(at, data.size - 1)]]
    windows[np.arange(size) >= held[:, None]] = 0
    return windows, owner, held


def train(docs: DataFrame, learn_from: Column, epochs: int = EPOCHS) -> tuple[list[str], bytes]:
    """Languages and network, learned from documents with a language for which `learn_from` holds."""
    labelled = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & learn_from)
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    ids = labelled.select("doc_id", "lang").withColumn("place", F.row_number().over(order)).filter(F.col("place") <= DOCS_PER_LANGUAGE)
    # Bounded: DOCS_PER_LANGUAGE ids for each language.
    chosen = labelled.select("doc_id", "lang", "text").join(F.broadcast(ids.select("doc_id", "lang").distinct()), ["doc_id", "lang"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """At most four windows a document, evenly spaced, every third shortened."""
        for batch in slices_by_bytes(batches, "text"):
            data, bounds = text_bytes(batch.column(2))
            windows, owner, held = windows_of(data, bounds)
            counts = np.bincount(owner, minlength=batch.num_rows)
            inner = np.arange(owner.size) - np.repeat(np.cumsum(counts) - counts, counts)
            stride = np.maximum(1, -(-counts // 4))[owner]
            some = np.flatnonzero((inner % stride == 0) & (held >= 8))
            short = some[::3]
            cuts = 16 + (windows[short].astype(np.int64).sum(axis=1) % (WINDOW - 16))
            windows[short] = np.where(np.arange(WINDOW) < cuts[:, None], windows[short], 0)
            ids, langs = batch.column(0).take(pa.array(owner[some])), batch.column(1).take(pa.array(owner[some]))
            yield pa.RecordBatch.from_arrays([ids, langs, pa.array(inner[some]), pa.array([w.tobytes() for w in windows[some]], pa.binary())], names=["doc_id", "lang", "place", "window"])

    spread = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id", "place"), "doc_id", "place", "window")
    cuts = chosen.mapInArrow(cut, "doc_id long, lang string, place long, window binary")
    sample = cuts.withColumn("rank", F.row_number().over(spread)).filter(F.col("rank") <= WINDOWS_PER_LANGUAGE)

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if held:
            whole = pa.Table.from_batches(held)
            names = whole.column("lang").to_pylist()
            languages = sorted(set(names))
            windows = np.frombuffer(b"".join(whole.column("window").to_pylist()), np.uint8).reshape(-1, WINDOW)
            network = fit(windows, np.searchsorted(languages, names), languages, epochs)
            yield pa.RecordBatch.from_arrays([pa.array([languages]), pa.array([network.dump()], pa.binary())], names=["languages", "network"])

    # One task learns from the bounded sample; another can take over if it is lost.
    learned = sample.select("lang", "rank", "window").repartition(1).sortWithinPartitions("lang", "rank").mapInArrow(learn, "languages array<string>, network binary").collect()
    return (list(learned[0]["languages"]), bytes(learned[0]["network"])) if learned else ([], b"")


def has_letter(raw: bytes) -> bool:
    return bool(_ASCII_LETTER.search(raw)) or any(c.isalpha() for c in raw.decode("utf-8", "replace"))


def judgements(texts: pa.Array, model: ByteNetwork | None) -> tuple[np.ndarray, np.ndarray]:
    """Language and score of every text."""
    data, bounds = text_bytes(texts)
    raw = data.tobytes()
    known = np.array([model is not None and has_letter(raw[a:b]) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)], bool)
    langs, scores = np.full(len(texts), UNDETERMINED, object), np.zeros(len(texts))
    if known.any():
        windows, owner, held = windows_of(data, bounds)
        sums = np.zeros((len(texts), len(model.languages)))
        for at in range(0, owner.size, 256):
            part = slice(at, at + 256)
            np.add.at(sums, owner[part], model.probabilities(windows[part]) * held[part, None])
        langs[known] = np.array(model.languages, object)[sums.argmax(axis=1)[known]]
        scores[known] = np.clip(sums.max(axis=1)[known] / sums.sum(axis=1)[known], 0, 1)
    return langs, scores


def identify(docs: DataFrame, languages: list[str], network: bytes) -> DataFrame:
    """doc_id, lang_pred and score of every document."""

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = ByteNetwork.load(languages, network) if languages else None
        for batch in slices_by_bytes(batches, "text"):
            langs, scores = judgements(batch.column(1), model)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(langs.tolist(), pa.string()), pa.array(scores)], names=["doc_id", "lang_pred", "score"])

    return docs.select("doc_id", "text").mapInArrow(judge, "doc_id long, lang_pred string, score double")


def accepted(docs: DataFrame, languages: list[str], network: bytes, least_score: float) -> DataFrame:
    """The documents, as they are, that have a language with at least that score."""

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = ByteNetwork.load(languages, network) if languages else None
        for batch in slices_by_bytes(batches, "text"):
            langs, scores = judgements(batch.column(batch.schema.get_field_index("text")), model)
            yield batch.filter(pa.array((langs != UNDETERMINED) & (scores >= least_score)))

    return docs.mapInArrow(keep, docs.schema)
