"""Toxicity scores by a logistic classifier that is indifferent to which group is mentioned.

A document's evidence is which words and word beginnings occur anywhere in it, so one insult in a
long text counts as in a short one. Beginnings cover inflected and compound forms. Features are
those significantly more frequent in toxic documents of the sample, and the identity terms
themselves. The classifier minimises the logistic loss plus a counterfactual term: in every
sentence of the sample that mentions an identity term, the term is swapped for others, and the squared change of the
sentence's score is penalised. So neutral mentions do not raise a score merely because some group
is mentioned more often by toxic documents.

The sample has at most DOCS_PER_LABEL labelled documents of each label, those of least id hash; class
weights restore the labels' frequencies. Only texts are inputs of a score. Null and empty texts
get the score of a text without evidence. Without labels of both kinds every score is 0.
Repeated rows get equal scores, conflicting labels of a document count as toxic. Extra columns
are left out. An empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from credence.llm.textkit import LOWER, PLACE, SPACES, U64, lists, mix, run_hashes, slices_by_bytes, text_bytes, word_runs

BEGINNINGS = (4, 5, 6)
DOCS_PER_LABEL, MAX_FEATURES = 6000, 1024
LEAST_DOCS, LEAST_Z, LEAST_RATIO = 6, 5.0, 10
ROUNDS, RIDGE, FAIRNESS = 400, 1e-4, 5.0
# Neutral mentions of groups of people, in lower case.
IDENTITY_TERMS = (
    "women", "men", "girls", "boys", "gay", "lesbian", "straight", "transgender", "black", "white", "asian", "african",
    "european", "american", "mexican", "christian", "muslim", "jewish", "hindu", "buddhist", "atheist", "immigrant",
    "refugee", "disabled", "blind", "deaf", "young", "old",
)

_BREAKS = SPACES.copy()
_BREAKS[[c for c in range(128) if not chr(c).isalnum()]] = True


def evidence(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Text and feature hash of every word and word beginning; equal features of a text may repeat."""
    data = LOWER[data]
    starts, ends, firsts = word_runs(data, bounds, _BREAKS)
    owner = np.repeat(np.arange(bounds.size - 1), np.diff(firsts))
    if not starts.size:
        return owner, np.zeros(0, U64)
    owners, found = [owner], [run_hashes(data, starts, ends)]
    for k, size in enumerate(BEGINNINGS):
        long = ends - starts >= size
        owners.append(owner[long])
        found.append(mix(run_hashes(data, starts[long], starts[long] + size) + PLACE[40 + k]))
    return np.concatenate(owners), np.concatenate(found)


def _of_strings(texts: list[str]) -> list[np.ndarray]:
    owner, found = evidence(*text_bytes(pa.array(texts, pa.string())))
    return [np.unique(found[owner == k]) for k in range(len(texts))]


def _labelled(docs: DataFrame, labels: DataFrame, learn_from: Column) -> tuple[DataFrame, dict[int, int]]:
    """doc_id, text, toxic of the sample, and how many labelled documents there are of each label."""
    usable = labels.filter(F.col("toxic").isin(0, 1) & learn_from).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    order = Window.partitionBy("toxic").orderBy(F.xxhash64("doc_id"), "doc_id")
    ids = usable.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= DOCS_PER_LABEL).select("doc_id", "toxic")
    counts = {r["toxic"]: r["rows"] for r in usable.groupBy("toxic").agg(F.count(F.lit(1)).alias("rows")).collect()}
    # Bounded: at most 2 * DOCS_PER_LABEL ids.
    return docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id"), counts


def select_features(sample: DataFrame) -> list[int]:
    """Hashes of at most MAX_FEATURES features by how significantly they mark toxic documents."""

    def occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices_by_bytes(batches, "text"):
            owner, found = evidence(*text_bytes(batch.column(0)))
            toxic = batch.column(1).to_numpy()[owner]
            _, once = np.unique(mix(found) + owner.astype(U64) * PLACE[0], return_index=True)
            keys, inverse = np.unique(found[once], return_inverse=True)
            pos = np.bincount(inverse, weights=toxic[once], minlength=keys.size).astype(np.int64)
            every = np.bincount(inverse, minlength=keys.size)
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(pos), pa.array(every - pos)], names=["feature", "pos", "neg"])

    totals = sample.agg(F.sum("toxic").alias("pos"), F.sum(1 - F.col("toxic")).alias("neg")).first()
    pos, neg = float(totals["pos"] or 0), float(totals["neg"] or 0)
    if not pos or not neg:
        return []
    # Copies of a text are one piece of evidence.
    distinct = sample.groupBy(F.xxhash64("text")).agg(F.first("text").alias("text"), F.max("toxic").alias("toxic")).select("text", "toxic")
    counted = distinct.mapInArrow(occurrences, "feature long, pos long, neg long").groupBy("feature").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    share = (F.col("pos") + F.col("neg")) / F.lit(pos + neg)
    spread = F.sqrt(share * (1 - share) * F.lit(1 / pos + 1 / neg) + F.lit(1e-12))
    z = (F.col("pos") / F.lit(pos) - F.col("neg") / F.lit(neg)) / spread
    # Evidence, not topics: a feature must be many times as frequent in toxic documents.
    marked = counted.filter(F.col("pos") >= LEAST_DOCS).filter(F.col("pos") / pos > LEAST_RATIO * F.col("neg") / neg).withColumn("z", z).filter(F.col("z") >= LEAST_Z)
    return [r["feature"] for r in marked.orderBy(F.desc("z"), "feature").limit(MAX_FEATURES).collect()]


def swapped_sentences(text: str, terms: tuple[str, ...]) -> list[tuple[str, str]]:
    """Each sentence that mentions a term, beside the same with the term swapped for two others."""
    pairs = []
    place = {t: k for k, t in enumerate(terms)}
    for sentence in re.split(r"[.!?\n]+", text.lower()):
        for term in sorted(set(re.findall(r"[^\W_]+", sentence)) & place.keys()):
            for step in (1, len(terms) // 2):
                other = terms[(place[term] + step) % len(terms)]
                if other != term:
                    pairs.append((sentence, re.sub(rf"(?<![^\W_]){re.escape(term)}(?![^\W_])", other, sentence)))
    return pairs


def fit(rows: np.ndarray, toxic: np.ndarray, weights: np.ndarray, one: np.ndarray, two: np.ndarray, fairness: float = FAIRNESS, rounds: int = ROUNDS) -> np.ndarray:
    """Coefficients (the last is the constant) of the weighted logistic loss with the counterfactual term over pairs one, two."""
    rows = np.hstack([rows, np.ones((rows.shape[0], 1), rows.dtype)])
    one, two = (np.hstack([x, np.ones((x.shape[0], 1), x.dtype)]) for x in (one, two))
    w = np.zeros(rows.shape[1])
    mean, square = np.zeros_like(w), np.zeros_like(w)
    total = weights.sum()
    for step in range(1, rounds + 1):
        grad = rows.T @ (weights * (_sigmoid(rows @ w) - toxic)) / total
        grad[:-1] += RIDGE * w[:-1]
        if one.shape[0]:
            a, b = _sigmoid(one @ w), _sigmoid(two @ w)
            change = 2 * fairness * (a - b) / one.shape[0]
            grad += one.T @ (change * a * (1 - a)) - two.T @ (change * b * (1 - b))
        mean += 0.1 * (grad - mean)
        square += 0.01 * (grad * grad - square)
        w -= 0.1 * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-8)
    return w


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def train(docs: DataFrame, labels: DataFrame, learn_from: Column, terms: tuple[str, ...] = IDENTITY_TERMS, fairness: float = FAIRNESS) -> tuple[list[int], list[float]]:
    """Feature hashes and coefficients (one more, the constant); nothing if labels of a kind are missing."""
    sample, counts = _labelled(docs, labels, learn_from)
    if len(counts) < 2:
        return [], []
    features = {*select_features(sample)}
    features |= {int(h) for found in _of_strings(list(terms)) for h in found.view(np.int64)}
    names = np.array(sorted(features), np.int64)
    order = np.argsort(names.view(U64))
    keys = names.view(U64)[order]

    def present(owner: np.ndarray, found: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
        at = np.minimum(np.searchsorted(keys, found), keys.size - 1)
        hit = keys[at] == found
        pairs = np.unique(owner[hit] * keys.size + at[hit])
        return pairs // keys.size, pairs % keys.size

    def described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row per document, and per sentence with a swapped term (kind 1) with the features of both forms."""
        for batch in slices_by_bytes(batches, "text"):
            pairs = [p for t in batch.column(1).to_pylist() if t for p in swapped_sentences(t, terms)]
            found = []
            for column in (batch.column(1), *(pa.array([p[k] for p in pairs], pa.string()) for k in (0, 1))):
                own, at = present(*evidence(*text_bytes(column)), len(column))
                found.append(lists(at, np.bincount(own, minlength=len(column)), pa.int64()))
            documents, one, two = found
            none = pa.array([None] * batch.num_rows, pa.list_(pa.int64()))
            for kind, toxic, own, other in ((0, batch.column(2), documents, none), (1, pa.array(np.zeros(len(pairs), np.int32)), one, two)):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), kind, np.int32)), toxic, own, other], names=["kind", "toxic", "features", "swapped"])

    def matrix(column: pa.Array) -> np.ndarray:
        out = np.zeros((len(column), keys.size), np.float32)
        out[np.repeat(np.arange(len(column)), column.value_lengths().fill_null(0).to_numpy()), column.flatten().to_numpy()] = 1
        return out

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = []
        for batch in batches:
            kinds = batch.column(0).to_numpy()
            own, other = matrix(batch.column(2)), matrix(batch.column(3))
            parts.append((own[kinds == 0], batch.column(1).to_numpy()[kinds == 0], own[kinds == 1], other[kinds == 1]))
        if not parts:
            return
        documents, toxic, one, two = (np.concatenate(x) for x in zip(*parts, strict=True))
        weights = np.array([counts[k] / max(1, (toxic == k).sum()) for k in (0, 1)])[toxic]
        w = fit(documents, toxic, weights, one, two, fairness)
        yield pa.RecordBatch.from_arrays([pa.array([w.tolist()])], names=["coefficients"])

    # Texts become short lists of features where they are; one task learns from the lists of the bounded sample.
    rows = sample.select("doc_id", "text", "toxic").mapInArrow(described, "kind int, toxic int, features array<long>, swapped array<long>")
    ordered = rows.repartition(1).sortWithinPartitions("kind", "toxic", "features", "swapped")
    learned = ordered.mapInArrow(learn, "coefficients array<double>").collect()
    return (keys.view(np.int64).tolist(), list(learned[0]["coefficients"])) if learned else ([], [])


def score(docs: DataFrame, features: list[int], coefficients: list[float]) -> DataFrame:
    """doc_id, score and predicted of every document."""
    keys, w = np.array(features, np.int64).view(U64), np.array(coefficients)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices_by_bytes(batches, "text"):
            scores = np.zeros(batch.num_rows)
            if keys.size:
                owner, found = evidence(*text_bytes(batch.column(1)))
                at = np.minimum(np.searchsorted(keys, found), keys.size - 1)
                hit = keys[at] == found
                pairs = np.unique(owner[hit] * keys.size + at[hit])
                sums = np.bincount(pairs // keys.size, weights=w[:-1][pairs % keys.size], minlength=batch.num_rows)
                scores = _sigmoid(sums + w[-1])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores), pa.array((scores >= 0.5).astype(np.int32))], names=["doc_id", "score", "predicted"])

    return docs.select("doc_id", "text").mapInArrow(judge, "doc_id long, score double, predicted int")
