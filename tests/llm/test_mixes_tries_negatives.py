"""The curriculum mix, the prefix trie and hard negatives against plain Python."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from credence.llm import curriculum, negatives, tries
from credence.llm.running import running_totals
from credence.llm.textkit import word_count

BLANKS = " \t\n\x0b\x0c\r"


def words(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def test_word_count(spark):
    rng = random.Random(4)
    texts = [None, "", " ", BLANKS, "a", " a", "a ", "   x\u0085", " " * 200_000, "a " * 200_000] + ["".join(rng.choice("aä 😀" + BLANKS) for _ in range(rng.randint(1, 40))) for _ in range(200)]
    found = spark.createDataFrame(list(enumerate(texts)), "i int, text string").select("i", word_count(F.col("text")).alias("n")).collect()
    assert {r.i: r.n for r in found} == {i: words(t) for i, t in enumerate(texts)}


@pytest.fixture
def many_parts(spark):
    """Small ranges stay apart, so groups reach over several partitions."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_running_totals(spark, many_parts):
    rng = random.Random(5)
    rows = [(rng.choice("aab"), i, rng.randint(0, 9)) for i in range(4000)]
    found = running_totals(spark.createDataFrame(rows, "kind string, i int, n long").repartition(5), ["kind"], ["i"], {"n": "before"})
    ahead, expected = Counter(), {}
    for kind, i, n in sorted(rows, key=lambda r: r[1]):
        expected[i] = ahead[kind]
        ahead[kind] += n
    assert {r.i: r.before for r in found.collect()} == expected
    assert found.select("_part").distinct().count() > 1


# Curriculum mix


def true_targets(sizes, weights=(5, 2, 1), most=3):
    """Shares by rounds of resharing, as exact fractions."""
    total, full = sum(sizes), set()
    while True:
        left = sum(weights[i % len(weights)] for i in range(len(sizes)) if i not in full)
        rest = total - sum(most * sizes[i] for i in full)
        shares = {i: Fraction(weights[i % len(weights)] * rest, left) for i in range(len(sizes)) if i not in full}
        above = {i for i, s in shares.items() if s > most * sizes[i]}
        if not above:
            return [most * s if i in full else shares[i] for i, s in enumerate(sizes)]
        full |= above


MIXED = (
    [(i, "w " * (i % 37), "b") for i in range(300)] + [(1000 + i, "u v w", "a") for i in range(20)]
    + [(2000, "x " * 5000, "c"), (2001, None, "c"), (2002, "", "d"), (2003, " ", "é"), (2004, "y", "Z"), (None, "one two", "b"), (2005, "n m", None), (2005, "n m k", None), (2006, "q", ""), (2006, "q", "")]
)


def mixture(spark, rows=MIXED):
    made = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(7)
    return made.select("*", *[F.lit("x").alias(c) for c in ("size", "target", "row", "_part", "source_key", "copies", "words", "label")])


def test_mix_reaches_its_targets(spark, many_parts):
    found = curriculum.mixed_documents(mixture(spark)).collect()
    assert len(found) == len(MIXED)
    sources = sorted({s for _, _, s in MIXED}, key=lambda s: (s is None, (s or "").encode()))
    sizes = [sum(words(t) for _, t, s in MIXED if s == source) for source in sources]
    targets = dict(zip(sources, true_targets(sizes), strict=True))
    size_of = dict(zip(sources, sizes, strict=True))
    by_id = defaultdict(set)
    for i, t, s in MIXED:
        by_id[i].add((words(t), s))
    taken = Counter()
    for r in found:
        source = next(s for n, s in by_id[r.doc_id] if n == r["size"])
        assert r.source_size == size_of[source]
        assert math.isclose(r.target, targets[source], abs_tol=1e-9)
        assert 0 <= r.taken <= 3 * r["size"]
        assert (r.taken > 0) == (r.copies > 0) == (r.first_word is not None)
        taken[source] += r.taken
    assert all(abs(taken[s] - targets[s]) <= 0.5 for s in sources)
    again = curriculum.mixed_documents(mixture(spark, MIXED[::-1])).collect()
    assert sorted(map(tuple, again), key=repr) == sorted(map(tuple, found), key=repr)


def test_mix_of_sources_beyond_their_limit(spark):
    rows = [(i, "w " * n, s) for i, (n, s) in enumerate([(10, "a"), (1, "b"), (500, "c"), (3, "d"), (2, "e"), (40, "f")])]
    found = {r.doc_id: r for r in curriculum.mixed_documents(mixture(spark, rows)).collect()}
    expected = true_targets([10, 1, 500, 3, 2, 40])
    assert [found[i].target for i in range(6)] == [float(t) for t in expected]
    assert sum(r.taken for r in found.values()) == 556


def integral(schedule, t):
    """The area under a piecewise linear schedule up to t, by plain trapezoids."""
    area = 0.0
    for (x0, y0), (x1, y1) in zip(schedule, schedule[1:]):
        if t > x0:
            end = min(t, x1)
            y = y0 + (y1 - y0) * (end - x0) / (x1 - x0)
            area += (end - x0) * (y0 + y) / 2
    return area


def test_positions_follow_the_schedules(spark):
    schedules = (((0.0, 0.0), (0.25, 2.0), (0.5, 0.0), (0.75, 0.0), (1.0, 1.0)), ((0.0, 1.0), (1.0, 1.0)))
    rows = [(i, "w " * (1 + i % 9), "ab"[i % 2]) for i in range(600)]
    plan, ordered = curriculum.mix(mixture(spark, rows), (1, 1), schedules)
    copies = ordered.orderBy("first_word").collect()
    assert [r.position for r in copies] == sorted(r.position for r in copies)
    assert [r.first_word for r in copies] == [0, *np.cumsum([r.words for r in copies]).tolist()[:-1]]
    ahead = Counter()
    targets = {r.source_key: math.floor(r.target + 0.5) for r in plan.collect()}
    for r in copies:
        schedule = schedules["sa sb".split().index(r.source_key)]
        share = (ahead[r.source_key] + r.words / 2) / targets[r.source_key]
        assert math.isclose(integral(schedule, r.position) / integral(schedule, 1.0), share, abs_tol=1e-9)
        ahead[r.source_key] += r.words
    assert dict(ahead) == targets
    texts = curriculum.training_texts(mixture(spark, rows), ordered).collect()
    assert [r.doc_id for r in sorted(texts, key=lambda r: r.first_word)] == [r.doc_id for r in copies]
    assert all(words(r.text) == r.words for r in texts)
    with pytest.raises(ValueError):
        curriculum.mix(mixture(spark, rows), (1,), (((0.0, 1.0), (0.9, 1.0)),))


def test_mix_of_nothing(spark):
    assert curriculum.mixed_documents(mixture(spark, MIXED).limit(0)).count() == 0
    wordless = curriculum.mixed_documents(mixture(spark, [(1, None, None), (2, "", "a")])).collect()
    assert sorted((r.doc_id, r["size"], r.target, r.taken) for r in wordless) == [(1, 0, 0.0, 0), (2, 0, 0.0, 0)]


# Prefix trie


def rebuilt(rows):
    turns = defaultdict(list)
    for conv_id, turn, role, text in rows:
        if conv_id is not None:
            turns[conv_id].append((turn is not None, turn, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(ts, key=lambda t: (t[0], t[1] or 0))] for c, ts in turns.items()}
    found = {}
    for c, ts in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        found[c] = own.get(c - int(math.fmod(c, 20)), [])[:h] + ts[h:]
    return found


def brute_trie(sequences):
    members = defaultdict(list)
    for c, seq in sequences.items():
        for d in range(len(seq) + 1):
            members[tuple(seq[:d])].append(c)
    children = Counter(p[:-1] for p in members if p)
    saved, leaves = Counter(), Counter()
    for p, own in members.items():
        for d in range(len(p) + 1):
            saved[p[:d]] += (len(own) - 1) * (words(p[-1][1]) if p else 0)
            leaves[p[:d]] += not children[p]
    return sorted(
        (min(own), len(p), min(members[p[:-1]]) if p else -1, len(own), children[p], leaves[p], saved[p],
         hashlib.sha256(",".join(map(str, sorted(c for c in own if len(sequences[c]) == len(p)))).encode()).hexdigest())
        for p, own in members.items()
    )


def found_trie(spark, rows, **options):
    made = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(6)
    made = made.select("*", *[F.lit("x").alias(c) for c in ("place", "block", "node", "key", "t0", "level", "words", "length", "_part")])
    found = tries.rebuilt_trie(made, **options).collect()
    fields = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
    return sorted(tuple(-1 if r[f] is None else r[f] for f in fields) for r in found)


def conversations(count, longest, seed=6):
    rng = random.Random(seed)
    rows = []
    for c in range(-count // 4, count):
        for t in range(rng.randint(1, longest)):
            text = rng.choice(["yes", "no no", "x y z"]) if rng.random() < 0.7 else f"only {rng.randint(0, 99)}"
            rows.append((c, t, rng.choice(["user", "assistant"]) if rng.random() < 0.2 else "user", text))
    return rows


ODD = [
    (40, None, "user", "first"), (40, 0, None, None), (40, 1, "", ""), (41, 5, "ab", "c"), (42, 5, "a", "bc"), (43, 0, "user", "hi"), (None, 0, "user", "lost"),
    (65, 0, "user", "alone"), (66, 0, "user", "alone"), (9_000_000_000, 0, "user", "hi"), (-7, 0, "user", "first"), (45, 0, "u", "same"), (45, 1, "u", "same"), (46, 0, "u", "same"),
]


@pytest.mark.parametrize("block, longest", [(8, 5), (2, 9), (3, 26)])
def test_trie(spark, many_parts, block, longest):
    rows = conversations(60, longest) + ODD[:7]
    # The added rows share ids with others; give those ids only once.
    known = {r[0] for r in ODD[:7]}
    rows = [r for r in rows[: -len(ODD[:7])] if r[0] not in known] + ODD[:7]
    assert found_trie(spark, rows, block=block) == brute_trie(rebuilt(rows))


def test_trie_of_odd_rows(spark):
    assert found_trie(spark, ODD) == brute_trie(rebuilt(ODD))
    turnless = [r for r in range(1, 400) if zlib.crc32(str(r).encode()) % 4 == 3 and r % 20][0]
    rows = [(turnless, 0, "user", "gone")]
    assert found_trie(spark, rows) == [(turnless, 0, -1, 1, 0, 1, 0, hashlib.sha256(str(turnless).encode()).hexdigest())]
    assert found_trie(spark, [(None, 0, "a", "b")]) == []


def test_trie_of_a_long_conversation(spark):
    """Two conversations that share 700 turns, one repeats them and goes on."""
    same = [(c, t, "user", f"turn {t % 5}") for c in (100, 120) for t in range(700)] + [(120, 700 + t, "user", "more") for t in range(90)]
    assert found_trie(spark, same) == brute_trie(rebuilt(same))


def test_digest_of_many_ids(spark):
    ends = spark.range(5000).select((F.col("id") % 2).cast("string").alias("key"), F.col("id").alias("conv_id")).repartition(9)
    found = {r.key: r.ends_sha256 for r in tries.end_digests(ends, 16).collect()}
    assert found == {str(k): hashlib.sha256(",".join(map(str, range(k, 5000, 2))).encode()).hexdigest() for k in (0, 1)}


# Hard negatives


@pytest.mark.parametrize("shape", [(1, 1, 1), (9, 6, 7), (33, 64, 65), (7, 0, 5), (100, 50, 3), (130, 131, 129)])
def test_strassen(shape):
    rng = np.random.default_rng(7)
    for most in (1 << 8, 1 << 31, 1 << 62):
        a, b = rng.integers(-most, most, shape[:2]), rng.integers(-most, most, shape[1:])
        for leaf in (8, 32) if max(shape) > 20 else (1, 2):
            with np.errstate(over="ignore"):
                assert (negatives.strassen(a, b, leaf) == a @ b).all()


def true_negatives(rows):
    usable = set()
    for i, vector, label in rows:
        if None in (i, vector, label) or any(x is None or not math.isfinite(x) for x in vector):
            continue
        usable.add((i, tuple(math.floor(256 * x) for x in vector), (label + 1) % 10 if i % 7 == 0 else label))
    found = []
    for i, own, label in usable:
        if i % 50:
            continue
        scored = sorted((-sum(x * y for x, y in zip(own, v)), j, other) for j, v, other in usable if j != i)
        for score, j, _ in [s for s in scored if s[2] == label][:5]:
            fit = [(-s, k) for s, k, other in scored if other != label and 50 * -score <= 100 * -s <= 95 * -score]
            found += [(i, j, rank, k, -score, s) for rank, (s, k) in enumerate(fit[:3], 1)]
    return sorted(found)


def vectors(count, width, seed):
    rng = random.Random(seed)
    # Few different components, so that scores tie.
    return [(i, [rng.choice([0.0, 0.25, -0.25, 0.5, 0.013]) for _ in range(width)], 3 if rng.random() < 0.4 else rng.randint(0, 9)) for i in range(count)]


@pytest.mark.parametrize("options", [{}, {"block_rows": 2, "part_rows": 40, "tile": 16, "leaf": 2}])
def test_hard_negatives(spark, options):
    rows = vectors(600, 13, 8) + [
        (1000, None, 1), (1001, [float("nan")] * 13, 1), (1050, [float("inf")] * 13, 1), (1002, [None] * 13, 1), (None, [1.0] * 13, 1), (1003, [1.0] * 13, None),
        (1100, [1.0] * 3, 3), (1101, [], 3), (1102, [0.5] * 20, 4), (7, [0.5] * 13, 3), (50, [0.25] * 13, 2), (1150, [1e18] * 13, 2),
    ]
    rows += rows[40:60]
    made = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(5)
    made = made.select("*", *[F.lit("x").alias(c) for c in ("row", "part", "block", "role", "vector", "place", "rank")])
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    found = negatives.hard_negatives(made, F.col("vec_id") % 50 == 0, label, **options).collect()
    single = [(i, v if v is None else [None if x is None else float(np.float32(x)) for x in v], y) for i, v, y in rows if i != 1150]
    assert sorted(map(tuple, found)) == true_negatives(single)
    assert len(found) > 50


def test_large_components(spark):
    rows = [(0, [2.0**20, -(2.0**20)], 1), (1, [2.0**20 + 1, 0.0], 1), (2, [2.0**20, 2.0**18], 2), (3, [2.0**19, 3.0], 2)]
    made = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    found = negatives.hard_negatives(made, F.col("vec_id") == 0, F.col("label")).collect()
    assert [tuple(r) for r in found] == [(0, 1, 1, 2, 2**28 * (2**28 + 256), 2**56 - 2**54)]


def test_negatives_of_nothing(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert negatives.hard_negatives(empty, F.lit(True), F.col("label")).count() == 0
