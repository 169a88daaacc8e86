"""Decontamination, tokens, packing, languages and toxicity."""

import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from credence.llm import decontamination, languages, packing, toxicity
from credence.llm.pieces import TokenBook, load_tokenizer
from credence.llm.textkit import text_bytes, text_crc
from credence.llm.token_counts import count_tokens

BYTES, WORDS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
SIGNS = ["a", " ", "\n", "é", "'s", "1", "<|endoftext|>", "　", "\x1c", "!", " ", "b", "\t", "ß", "\xa0", ".", ",", "\n", "Σ", "İ", "A", "́", "'", "\0", "\x85"]


def strange_texts(count, seed=1):
    rng = random.Random(seed)
    return ["".join(rng.choices(SIGNS, k=rng.randint(0, 14))) for _ in range(count)]


# Decontamination


def test_leaks_tolerate_two_substitutions(spark, documents):
    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(400)]
    items = [(i, " ".join(rng.choices(vocabulary, k=n))) for i, n in enumerate([12, 13, 20, 40])] + [(9, None), (10, "")]
    benchmark = spark.createDataFrame([*items, items[2]], "item_id long, text string").withColumn("words", F.lit(1))
    rows, expected = [(900, None), (901, ""), (None, "x")], set()
    for doc_id in range(200):
        item_id, text = rng.choice(items[:4])
        own = text.split()
        changes = rng.randint(0, 5)
        for at in rng.sample(range(len(own)), changes):
            own[at] = "changed"
        joined = rng.choices(vocabulary, k=rng.randint(0, 30)) + own + rng.choices(vocabulary, k=rng.randint(0, 30))
        rows.append((doc_id, rng.choice([" ", ", ", "\n"]).join(joined).upper()))
        windows = range(len(own) - 12)
        if any(sum(w == "changed" for w in own[s : s + 13]) <= 2 for s in windows):
            expected.add((doc_id, item_id))
    for limit in (decontamination.BROADCAST_SEEDS, 3):
        found = decontamination.leaks(documents([*rows, rows[5]]), benchmark, broadcast_seeds=limit).collect()
        assert {(r.doc_id, r.item_id) for r in found} == expected
        assert len(found) == len(expected)
    kept = decontamination.without_leaks(documents(rows), benchmark).collect()
    assert {r.doc_id for r in kept} == {d for d, _ in rows} - {d for d, _ in expected}


def test_masks_are_lossless():
    shown = [[k for k, s in enumerate(m) if s == "1"] for m in decontamination.MASKS]
    for a in range(13):
        for b in range(13):
            assert any(not {a, b} & {s + k for k in m} for m in shown for s in range(13 - m[-1]))


# Tokens


@pytest.mark.parametrize("path, keeps_spaces", [(BYTES, True), (WORDS, False)])
def test_pieces_give_the_tokens_of_whole_texts(path, keeps_spaces):
    whole = Tokenizer.from_file(path)
    texts = strange_texts(4000)
    book = TokenBook(load_tokenizer(path), keeps_spaces, with_ids=True, remembered=500)
    for at in range(0, len(texts), 400):
        some = texts[at : at + 400]
        ids, bounds = book.encoded(*text_bytes(pa.array(some)))
        expected = [e.ids for e in whole.encode_batch(some, add_special_tokens=False)]
        assert [ids[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:], strict=True)] == expected


def test_special_strings_in_capitals_are_ordinary_text():
    whole = Tokenizer.from_file(WORDS)
    texts = ["A <|ENDOFTEXT|> b", "x<|EndOfText|>Y <|endoftext|>Z", "<|StartOfText|>", "A,<|ENDOFTEXT|>.B Plain"]
    ids, bounds = TokenBook(load_tokenizer(WORDS), False, with_ids=True).encoded(*text_bytes(pa.array(texts)))
    expected = [whole.encode(t, add_special_tokens=False).ids for t in texts]
    assert [ids[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:], strict=True)] == expected


def test_texts_that_collide_modulo_powers_of_two(documents):
    """Thue-Morse texts and their mirrors, which a polynomial modulo 2^64 cannot tell apart."""
    pairs = [("".join((x, y)[i.bit_count() % 2] for i in range(2048)), "".join((y, x)[i.bit_count() % 2] for i in range(2048))) for x, y in ("ab", "th", "in", "er", "on")]
    texts = [t for pair in pairs for t in pair]
    whole = Tokenizer.from_file(BYTES)
    expected = [len(whole.encode(t, add_special_tokens=False)) for t in texts]
    assert expected[::2] != expected[1::2]
    found = count_tokens(documents(list(enumerate(texts))), BYTES).orderBy("doc_id").collect()
    assert [r.n_tokens for r in found] == expected


def test_token_counts(documents):
    texts = [None, "", "word " * 3000, "x" * 5000, *strange_texts(200, 2)]
    found = {r.doc_id: r for r in count_tokens(documents(list(enumerate(texts))), BYTES).collect()}
    whole = Tokenizer.from_file(BYTES)
    for doc_id, text in enumerate(texts):
        tokens = len(whole.encode(text or "", add_special_tokens=False))
        assert tuple(found[doc_id]) == (doc_id, len((text or "").encode()), tokens, tokens > 512)
    assert count_tokens(documents([]), BYTES).count() == 0


# Packing


def check_packing(rows, size):
    by_sequence = {}
    for r in rows:
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for held in by_sequence.values():
        held.sort()
        assert [o for o, _ in held] == [sum(n for _, n in held[:k]) for k in range(len(held))]
        assert sum(n for _, n in held) <= size
    return len(by_sequence)


def test_pack_documents(documents):
    rng = random.Random(6)
    texts = [None, "", "word " * 9000, *(" ".join(rng.choices(["some", "other", "Words"], k=rng.randint(1, 900))) for _ in range(150))]
    found = packing.pack_documents(documents([*enumerate(texts), (3, texts[3])]), WORDS).collect()
    used = check_packing(found, 4096)
    assert used <= 1.05 * sum(r.length for r in found) / 4096 + 2
    whole = Tokenizer.from_file(WORDS)
    expected = []
    for doc_id, text in [*enumerate(texts), (3, texts[3])]:
        ids = np.array([*whole.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        for k, at in enumerate(range(0, ids.size, 4096)):
            expected.append((doc_id, k, at, ids[at : at + 4096].size, zlib.crc32(ids[at : at + 4096].tobytes())))
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in found) == sorted(expected)
    assert packing.pack_documents(documents([]), WORDS).count() == 0


@pytest.mark.parametrize(
    "lengths, sequences",
    [
        ([1] * 8192, 2),
        ([17] * 480, 2),
        ([4095, 4079] * 20 + [1] * 20 + [17] * 20, 40),
        (np.clip(np.random.Generator(np.random.PCG64(7)).lognormal(5.5, 1, 3000).astype(int), 1, 4096).tolist(), None),
    ],
)
def test_packing_leaves_no_room_by_rounding(spark, lengths, sequences):
    pieces = spark.createDataFrame([(i, 0, 0, int(n)) for i, n in enumerate(lengths)], "doc_id long, piece int, start long, length long")
    found = packing.pack(pieces).collect()
    assert sorted((r.doc_id, r.length) for r in found) == [*enumerate(lengths)]
    assert check_packing(found, 4096) == (sequences or -(-sum(lengths) // 4096))


@pytest.mark.parametrize("seed", range(4))
def test_plan_uses_every_length_once(seed):
    rng = np.random.Generator(np.random.PCG64(seed))
    lengths = np.clip(rng.lognormal(3, 1, int(10 ** (seed + 1))).astype(int), 1, 64)
    histogram = np.bincount(lengths, minlength=65)
    plan = packing.plan_packing(histogram)
    used = np.zeros(65, np.int64)
    for pattern, times in plan:
        assert sum(pattern) <= 64
        assert times > 0
        for length in pattern:
            used[length] += times
    assert (used == histogram).all()
    assert sum(t for _, t in plan) <= 1.1 * lengths.sum() / 64 + 2


def test_least_squares_is_non_negative():
    rng = np.random.Generator(np.random.PCG64(1))
    matrix = rng.random((12, 8))
    x = packing.fit_non_negative(matrix, matrix @ np.array([0, 2, 0, 1, 0, 0, 3, 0.5]))
    assert np.allclose(x, [0, 2, 0, 1, 0, 0, 3, 0.5], atol=1e-3)
    assert (packing.fit_non_negative(matrix, -np.ones(12)) == 0).all()


# Languages

SYLLABLES = {"xx": ["tha", "ing", "er"], "yy": ["sch", "ung", "ü"], "zz": ["ción", "os", "ñ"]}


def labelled_texts(count, seed=8):
    rng = random.Random(seed)
    rows = []
    for i in range(count):
        lang = rng.choice(sorted(SYLLABLES))
        text = " ".join("".join(rng.choices(SYLLABLES[lang], k=rng.randint(1, 4))) for _ in range(rng.randint(5, 120)))
        rows.append((i, text, lang))
    return rows


def test_languages(spark):
    odd = [(1000, None, "xx"), (1001, "", None), (1002, "12 !?", "yy"), (1003, "schungü " * 4000, None), (None, "thaing", None)]
    docs = spark.createDataFrame([*labelled_texts(240), *odd], "doc_id long, text string, lang string")
    held_out = text_crc("doc_id") % 3 == 1
    learned, network = languages.train(docs, ~held_out, epochs=6)
    assert learned == ["xx", "yy", "zz"]
    found = languages.identify(docs, learned, network).join(docs.withColumn("held_out", held_out), "doc_id").collect()
    judged = [r for r in found if r.held_out and r.doc_id < 1000]
    assert sum(r.lang == r.lang_pred for r in judged) >= 0.97 * len(judged)
    by_id = {r.doc_id: r for r in found}
    assert [(by_id[i].lang_pred, by_id[i].score) for i in (1000, 1001, 1002)] == [("und", 0.0)] * 3
    assert by_id[1003].lang_pred == "yy"
    assert all(0 <= r.score <= 1 for r in found)
    kept = languages.accepted(docs, learned, network, 0.5)
    assert kept.columns == docs.columns
    assert not {1000, 1001, 1002} & {r.doc_id for r in kept.collect()}
    assert languages.train(docs, ~held_out, epochs=6)[1] == network


def test_languages_without_labels(spark):
    docs = spark.createDataFrame([(1, "some text", None)], "doc_id long, text string, lang string")
    learned = languages.train(docs, F.lit(True))
    assert [tuple(r) for r in languages.identify(docs, *learned).collect()] == [(1, "und", 0.0)]


def test_gradients_are_those_of_the_loss():
    rng = np.random.Generator(np.random.PCG64(3))
    network = languages.ByteNetwork.new(["a", "b"], rng)
    windows, targets = rng.integers(0, 256, (6, 40)).astype(np.uint8), np.array([0, 1, 0, 1, 1, 0])

    def loss():
        return -np.log(network.probabilities(windows)[np.arange(6), targets]).mean()

    for parameter, gradient in zip(network.parameters(), network.gradients(windows, targets), strict=True):
        at = np.unravel_index(np.argmax(np.abs(gradient)), gradient.shape)
        before, step = parameter[at], 1e-2
        parameter[at] = before + step
        high = loss()
        parameter[at] = before - step
        low = loss()
        parameter[at] = before
        assert (high - low) / (2 * step) == pytest.approx(gradient[at], rel=0.1, abs=2e-3)


# Toxicity


def toxic_corpus(count=400, seed=12):
    """Insults are toxic; a group is mentioned by most toxic texts, yet harmless."""
    rng = random.Random(seed)
    docs, labels = [], []
    for i in range(count):
        toxic = i % 4 == 0
        own = [f"w{rng.randint(0, 300)}" for _ in range(rng.randint(5, 200))]
        if toxic:
            own.insert(rng.randrange(len(own)), rng.choice(["moron", "stupid", "trashig"]))
        if rng.random() < (0.9 if toxic else 0.05):
            own.append("women")
        docs.append((i, " ".join(own)))
        labels.append((i, int(toxic)))
    return docs, labels


def test_toxicity(spark):
    docs, labels = toxic_corpus()
    docs += [(2000, None), (2001, ""), (2002, "a neutral text on women"), (2003, "w1 " * 40000 + "moron"), (None, "x")]
    texts = spark.createDataFrame(docs, "doc_id long, text string")
    marks = spark.createDataFrame([*labels, (1, None), (None, 1), (5, 0), (777777, 1)], "doc_id long, toxic int")
    held_out = text_crc("doc_id") % 5 == 0
    scores = {}
    for fairness in (0.0, toxicity.FAIRNESS):
        features, coefficients = toxicity.train(texts, marks, ~held_out, fairness=fairness)
        found = {r.doc_id: r for r in toxicity.score(texts, features, coefficients).collect()}
        scores[fairness] = found[2002].score
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in found.values())
    known = dict(labels)
    assert sum(found[i].predicted == known[i] for i in known) >= 0.95 * len(known)
    assert found[2003].predicted == 1
    assert found[2000].score == found[2001].score < 0.5
    assert scores[toxicity.FAIRNESS] < 0.5
    assert scores[toxicity.FAIRNESS] < scores[0.0]


def test_swapped_sentences():
    pairs = toxicity.swapped_sentences("Old women. No group! menace", ("women", "men", "old"))
    assert ("old women", "old men") in pairs
    assert all("group" not in one and "menace" not in one for one, _ in pairs)


def test_toxicity_without_labels(spark):
    texts = spark.createDataFrame([(1, "x")], "doc_id long, text string")
    marks = spark.createDataFrame([], "doc_id long, toxic int")
    learned = toxicity.train(texts, marks, F.lit(True))
    assert [tuple(r) for r in toxicity.score(texts, *learned).collect()] == [(1, 0.0, 0)]
