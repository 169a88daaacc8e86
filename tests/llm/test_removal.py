"""Jaccard join, suffix sorting and de Bruijn removal against brute force."""

import random
import string

import numpy as np
import pytest
from pyspark.sql import functions as F

from credence.llm import debruijn, jaccard, suffixes, textkit, windows
from credence.llm.components import components
from credence.llm.repeats import merged_spans, repeated_rows

from . import brute

LONG = "".join(random.Random(1).choices(["lorem ", "ipsum ", "dolor ", "é", "sit\n"], k=400))
ODD = [(1, None), (2, ""), (3, " \n\t"), (4, "A b"), (5, "a B"), (6, "a" * 500), (7, "x" * 99), (8, "x" * 100), (9, "x" * 101)]


def passages():
    rng = random.Random(3)
    rows = list(ODD)
    for i in range(10, 45):
        at = rng.randint(0, 900)
        noise = ["".join(rng.choices("abcdefghij kl", k=rng.randint(0, 200))) for _ in range(2)]
        rows.append((i, noise[0] + LONG[at : at + rng.randint(0, 900)] + noise[1] + LONG[rng.randint(0, 700) :]))
    return [*rows, rows[20]]


def near_copies():
    rng = random.Random(5)
    bases = [[f"w{rng.randint(0, 400)}" for _ in range(n)] for n in (3, 5, 6, 30, 80, 200)]
    rows = list(ODD)
    for i in range(10, 240):
        own = list(rng.choice(bases))
        for _ in range(rng.choice([0, 0, 1, 2, 3, 6])):
            own[rng.randrange(len(own))] = f"z{rng.randint(0, 99)}"
        rows.append((i, " ".join(own)))
    return [*rows, rows[30]]


@pytest.mark.parametrize("group_rows, block_shingles", [(4096, 2_000_000), (30, 2_000)])
def test_jaccard_components(documents, monkeypatch, group_rows, block_shingles):
    """Also when groups and blocks are cut into parts."""
    monkeypatch.setattr(jaccard, "GROUP_ROWS", group_rows)
    monkeypatch.setattr(jaccard, "BLOCK_SHINGLES", block_shingles)
    rows = near_copies()
    found = jaccard.jaccard_components(documents(rows)).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in found) == brute.jaccard_components(rows)


def test_jaccard_components_of_doubled_rows(documents):
    """Every row twice, mostly in other tasks."""
    rows = near_copies()
    doubled = documents(rows).unionByName(documents(rows)).repartition(7)
    found = jaccard.jaccard_components(doubled).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in found) == brute.jaccard_components(rows + rows)


def test_jaccard_components_of_an_id_with_several_texts(documents):
    rows = near_copies()
    rows += [(301, rows[40][1]), (301, rows[60][1]), (302, "w1 " + rows[50][1]), (302, rows[70][1] + " w2")]
    found = jaccard.jaccard_components(documents(rows).coalesce(1)).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in found) == brute.jaccard_components(rows)


def test_one_of_each_group(documents):
    rows = [(1, "a b c d e f g"), (2, "A b c d e f g"), (3, None), (4, ""), (4, ""), (5, "other words are here to stay"), (None, "x")]
    assert sorted(r.doc_id for r in jaccard.one_of_each_group(documents(rows)).collect()) == [1, 3, 4, 5]


def test_tree_bound_never_misses():
    rng = np.random.Generator(np.random.PCG64(2))
    sets = []
    for _ in range(12):
        base = rng.integers(0, 1 << 63, rng.integers(5, 300), dtype=np.uint64)
        for _ in range(8):
            own = base.copy()
            changed = rng.integers(0, max(1, own.size // 8) + 1)
            own[:changed] = rng.integers(0, 1 << 63, changed, dtype=np.uint64)
            sets.append(np.unique(own))
    members = jaccard.Members(np.array([s.size for s in sets]), [jaccard.bitmap(s).tobytes() for s in sets])
    left, right = np.triu_indices(len(sets), 1)
    possible = members.possible(left, right, 80, 100)
    for a, b, may in zip(left, right, possible, strict=True):
        common = np.intersect1d(sets[a], sets[b]).size
        assert may or 100 * common < 80 * (sets[a].size + sets[b].size - common)
    # Different bases share nothing: nearly all of their pairs are ruled out.
    assert possible.mean() < 0.25


def test_components(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 101), (101, 102), (200, 200), (102, 100)]
    found = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {**dict.fromkeys(range(1, 61), 0), 101: 100, 102: 100}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_window_classes():
    rng = random.Random(7)
    for round_ in range(12):
        raw = bytes(rng.choices(rng.choice([b"a", b"ab", b"abcdefgh"]), k=rng.randint(120, 1500)))
        raw = raw + raw[: len(raw) // 2] if round_ % 2 else raw
        text = np.frombuffer(raw, np.uint8)
        ordered, classes = suffixes.window_classes(text, np.arange(text.size - 99), 100, bucket=200)
        windows = [raw[p : p + 100] for p in ordered.tolist()]
        assert windows == sorted(windows)
        assert (np.diff(classes) == 0).tolist() == [a == b for a, b in zip(windows, windows[1:], strict=False)]


@pytest.mark.parametrize("hot_rows", [suffixes.HOT_ROWS, 3])
def test_copied_bytes(documents, hot_rows):
    """Also when frequent anchors are opened into windows."""
    rows = passages()
    found = {tuple(r) for r in suffixes.remove_copies(documents(rows), hot_rows=hot_rows).collect()}
    assert sorted(found) == [r[:5] for r in brute.without_copied_bytes(rows)]


def test_texts_without_copies(documents):
    rows = [r for r in passages() if r[0] != 30]
    cleaned = suffixes.without_copies(documents(rows))
    expected = {r[0]: r[5].decode("utf-8", "ignore") for r in brute.without_copied_bytes(rows)}
    assert cleaned.columns == documents(rows).columns
    assert {r.doc_id: r.text for r in cleaned.collect()} == {**expected, 1: None}


def test_repeated_words(documents):
    rows = passages()
    found = sorted(map(tuple, debruijn.remove_repeats(documents(rows)).collect()))
    assert found == brute.without_repeated_words(rows)


def shared_ids():
    """Ids with several texts: long and short ones, equal parts at equal and other places, copies of and for other ids."""
    rng = random.Random(11)
    parts = [" ".join(rng.choices(string.ascii_lowercase, k=90)) for _ in range(6)]
    words = lambda *p: " ".join(parts[i] for i in p)
    return [
        (1, words(0, 1)), (2, words(2, 0)), (2, "only few words"), (2, words(1, 3)), (2, words(2, 0)), (3, words(3)), (3, words(3, 4)), (3, words(5, 3)),
        (4, words(4)), (4, None), (4, ""), (5, words(5, 5)), (5, words(0, 5)),
    ]


def test_ids_with_several_texts(documents):
    rows = shared_ids()
    for hot_rows in (suffixes.HOT_ROWS, 3):
        found = sorted(set(map(tuple, suffixes.remove_copies(documents(rows), hot_rows=hot_rows).collect())))
        assert found == sorted({r[:5] for r in brute.without_copied_bytes(rows)})
    assert sorted(map(tuple, debruijn.remove_repeats(documents(rows)).collect())) == brute.without_repeated_words(rows)
    expected = {(r[0], r[1], r[5].decode("utf-8", "ignore")) for r in brute.without_copied_bytes([r for r in rows if r[1]])}
    cleaned = suffixes.without_copies(documents([r for r in rows if r[1]]).withColumn("n", F.octet_length("text").cast("string"))).collect()
    assert {(r.doc_id, int(r.n), r.text) for r in cleaned} == expected


def test_one_row_of_an_id_with_several_texts(documents):
    rows = [(7, f"text number {i} of the same document") for i in range(40)]
    kept = {jaccard.one_of_each_group(documents(r).repartition(n)).collect()[0].text for r, n in ((rows, 3), (rows[::-1], 7), (rows * 2, 5))}
    assert len(kept) == 1


def test_words_that_collide_modulo_powers_of_two(documents):
    """Thue-Morse words: any polynomial modulo 2^64 gives both the same hash."""
    word = "".join("ab"[i.bit_count() % 2] for i in range(1024))
    other = word.translate(str.maketrans("ab", "ba"))
    lead = " ".join(f"w{i}" for i in range(12))
    rows = [(1, f"{lead} {word}"), (2, f"{lead} {other}")]
    assert [(r.doc_id, r.component_id) for r in jaccard.jaccard_components(documents([(1, word), (2, other)])).orderBy("doc_id").collect()] == [(1, 1), (2, 2)]
    assert sorted(map(tuple, debruijn.remove_repeats(documents(rows)).collect())) == brute.without_repeated_words(rows)


def test_run_hashes_in_stretches(monkeypatch):
    """Sums over stretches and over the whole give the same hashes."""
    rng = np.random.default_rng(12)
    data = rng.integers(0, 256, 20_000).astype(np.uint8)
    data[15_000:16_000] = data[50:1050]
    starts = np.append(np.sort(rng.integers(0, 20_000, 500)), [50, 15_000])
    ends = np.append(np.minimum(20_000, starts[:-2] + rng.integers(0, 9_000, 500)), [1050, 16_000])
    whole = textkit.run_hashes(data, starts, ends)
    grams = windows.gram_hashes(data, 32)
    assert whole[-1] == whole[-2]
    assert np.unique(whole).size == np.unique([data[a:b].tobytes() for a, b in zip(starts, ends)]).size
    monkeypatch.setattr(textkit, "CHAINED", 100)
    whole = textkit.run_hashes(data, starts, ends)
    monkeypatch.setattr(textkit, "STRETCH", 512)
    monkeypatch.setattr(windows, "STRETCH", 512)
    textkit.powers.cache_clear()
    assert (textkit.run_hashes(data, starts, ends) == whole).all()
    assert (windows.gram_hashes(data, 32) == grams).all()
    textkit.powers.cache_clear()


def test_rows_without_id_are_left_out(documents):
    rows = [(None, LONG), (1, LONG), (2, LONG)]
    assert sorted(r.n_removed for r in suffixes.remove_copies(documents(rows)).collect()) == [0, len(LONG.encode())]
    assert debruijn.remove_repeats(documents(rows)).count() == 2
    assert jaccard.jaccard_components(documents(rows)).count() == 2


def test_empty_tables(documents):
    empty = documents([])
    assert jaccard.jaccard_components(empty).count() == 0
    assert suffixes.remove_copies(empty).count() == 0
    assert debruijn.remove_repeats(empty).count() == 0


def test_repeated_rows(spark):
    rng = random.Random(9)
    rows = [(rng.randint(0, 400), i) for i in range(500)] + [(1000, i) for i in range(300)]
    counts = {k: sum(r[0] == k for r in rows) for k, _ in rows}
    found = repeated_rows(spark.createDataFrame(rows, "key long, doc_id long").repartition(7)).collect()
    assert sorted(map(tuple, found)) == sorted(r for r in rows if counts[r[0]] > 1)


def test_merged_spans():
    starts, stops = merged_spans(np.array([5, 0, 2, 30]), np.array([8, 3, 5, 31]))
    assert (starts.tolist(), stops.tolist()) == ([0, 30], [8, 31])
    assert merged_spans(np.zeros(0, np.int64), np.zeros(0, np.int64))[0].size == 0
