import random
from collections import Counter
from statistics import mean

from pyspark.sql import functions as F

from credence.operators.evaluation import compare_runs, drawn_weight, judged

KINDS = "query_id int, chunk_id long, rank int"


def runs(spark):
    rng = random.Random(2)
    golden = [(q, c) for q in range(40) for c in rng.sample(range(12), rng.randint(1, 4))] + [(99, 1)]
    one = [(q, c, r) for q in range(40) for r, c in enumerate(rng.sample(range(12), 6), 1)]
    two = [(q, c, r) for q in range(0, 50, 2) for r, c in enumerate(rng.sample(range(12), 6), 1)]
    frames = [spark.createDataFrame(golden, "query_id int, chunk_id long"), spark.createDataFrame(one, KINDS), spark.createDataFrame(two, KINDS)]
    return golden, one, two, frames


def test_recall_and_overlap_per_query(spark):
    golden, one, two, frames = runs(spark)
    top = lambda run, q: {c for p, c, r in run if p == q and r <= 3}
    wanted = {q: {c for p, c in golden if p == q} for q, _ in golden}
    expected = {q: (len(w & top(one, q)) / len(w), len(w & top(two, q)) / len(w), len(top(one, q) & top(two, q)) / 3) for q, w in wanted.items()}
    assert {r.query_id: (r.recall_one, r.recall_two, r.overlap) for r in judged(*frames, 3).collect()} == expected


def test_paired_bootstrap(spark):
    *_, frames = runs(spark)
    row = compare_runs(*frames, 3, draws=400).first()
    again = compare_runs(*[f.repartition(7) for f in frames], 3, draws=400).first()
    assert [round(x, 9) for x in row] == [round(x, 9) for x in again]
    gains = [r.recall_one - r.recall_two for r in judged(*frames, 3).collect()]
    assert row.queries == 41 and abs(row.gain - mean(gains)) < 1e-9 and row.low < row.gain < row.high
    rng = random.Random(3)
    plain = sorted(mean(rng.choices(gains, k=41)) for _ in range(4000))
    assert abs(row.low - plain[100]) < 0.06 and abs(row.high - plain[3900]) < 0.06
    same = compare_runs(frames[0], frames[1], frames[1], 3, draws=50).first()
    assert (same.gain, same.low, same.high, same.ahead) == (0.0, 0.0, 0.0, 0.0)


def test_nothing_judged(spark):
    *_, frames = runs(spark)
    row = compare_runs(frames[0].limit(0), frames[1], frames[2], 3).first()
    assert row.queries == 0 and row.gain is None and row.low is None


def test_weights_are_poisson_numbers(spark):
    drawn = spark.range(20_000).select(drawn_weight(F.col("id"), F.lit(7), 0).alias("w")).collect()
    counts = Counter(r.w for r in drawn)
    assert abs(counts[0] / 20_000 - 0.3679) < 0.015 and abs(counts[2] / 20_000 - 0.1839) < 0.015 and abs(sum(w * n for w, n in counts.items()) / 20_000 - 1) < 0.03
