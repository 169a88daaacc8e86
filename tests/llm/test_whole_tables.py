"""The registered queries without SQL, over the whole smallest tables: their contracts row by row."""

import math
import os
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from credence.llm import catalog

FOLDER = os.environ.get("QUERY_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test data not present")


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}


def rows(spark, name):
    return catalog.QUERIES[name](spark, FOLDER).collect()


def test_nearest_neighbours(spark):
    stored = {r.vec_id: np.array(r.embedding, np.float64) for r in spark.read.parquet(f"{FOLDER}/embeddings.parquet").collect()}
    found = defaultdict(list)
    for r in rows(spark, "op5_nearest_neighbours"):
        found[r.query_id].append((r["rank"], r.vec_id, r.score))
    assert set(found) == {i for i in stored if i % 50 == 0}
    hits = 0
    for query, own in found.items():
        own.sort()
        assert [rank for rank, _, _ in own] == [1, 2, 3, 4, 5] and query not in {i for _, i, _ in own}
        cosine = lambda i: stored[query] @ stored[i] / math.sqrt((stored[query] @ stored[query]) * (stored[i] @ stored[i]))  # noqa: E731, B023
        assert all(math.isclose(score, cosine(i), abs_tol=1e-9) for _, i, score in own)
        assert [(-s, i) for _, i, s in own] == sorted((-s, i) for _, i, s in own)
        hits += len({i for _, i, _ in own} & set(sorted((j for j in stored if j != query), key=lambda j: -cosine(j))[:5]))
    assert hits >= 0.9 * 5 * len(found)


def test_token_counts(spark, texts):
    whole = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    found = rows(spark, "op6_token_counts")
    assert len(found) == len(texts)
    for r in found:
        tokens = len(whole.encode(texts[r.doc_id] or "", add_special_tokens=False))
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len((texts[r.doc_id] or "").encode()), tokens, tokens > 512)


def test_languages(spark, texts):
    known = {r.doc_id: r.lang for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    found = rows(spark, "op7_language_id")
    assert sorted(r.doc_id for r in found) == sorted(texts)
    learned = {known[i] for i in known if known[i] is not None and zlib.crc32(str(i).encode()) % 3 != 1}
    for r in found:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1
        has_letter = any(c.isalpha() for c in texts[r.doc_id] or "")
        assert r.lang_pred in learned if has_letter else r.lang_pred == "und"
    unseen = [r for r in found if r.held_out and known[r.doc_id] is not None and r.lang_pred != "und"]
    assert sum(r.lang_pred == known[r.doc_id] for r in unseen) >= 0.9 * len(unseen)


def test_packing(spark, texts):
    whole = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    ids = {i: [*whole.encode(t or "", add_special_tokens=False).ids, 1] for i, t in texts.items()}
    pieces, filled = defaultdict(list), defaultdict(list)
    for r in rows(spark, "op8_best_fit_packing"):
        pieces[r.doc_id].append((r.piece, r.start, r.length, r.ids_crc32))
        filled[r.sequence_id].append((r.offset, r.length))
    assert set(pieces) == set(ids)
    for i, own in pieces.items():
        expected = [(p, a, len(ids[i][a : a + 4096]), zlib.crc32(np.array(ids[i][a : a + 4096], "<u4").tobytes())) for p, a in enumerate(range(0, len(ids[i]), 4096))]
        assert sorted(own) == expected
    for own in filled.values():
        own.sort()
        assert [o for o, _ in own] == [0, *np.cumsum([n for _, n in own])[:-1].tolist()] and sum(n for _, n in own) <= 4096
    least = -(-sum(map(len, ids.values())) // 4096)
    assert len(filled) <= 1.1 * least + 1


def test_toxicity(spark, texts):
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect()}
    found = rows(spark, "op9_toxicity")
    assert sorted(r.doc_id for r in found) == sorted(texts)
    for r in found:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
    marked = Counter((labels.get(r.doc_id), r.predicted) for r in found)
    assert marked[(0, 1)] <= 0.05 * max(1, marked[(0, 0)] + marked[(0, 1)])
