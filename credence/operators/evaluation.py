"""Comparing two search runs over the same judged queries."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DRAWS = 200
LEVEL = 0.95
# Weights above this have a chance below 10^-10 in a draw.
MOST_WEIGHT = 13


def poisson_steps(most: int = MOST_WEIGHT) -> list[float]:
    """Chances of a Poisson number of mean 1 to be at most 0, 1, 2, …"""
    steps, total = [], 0.0
    for k in range(most):
        total += math.exp(-1.0) / math.factorial(k)
        steps.append(total)
    return steps


def drawn_weight(key: Column, draw: Column, seed: int) -> Column:
    """How often a bootstrap draw takes a query: a Poisson number from a digest of both, the same wherever it is computed."""
    digest = F.md5(F.concat_ws(":", key.cast("string"), draw.cast("string"), F.lit(str(seed))).cast("binary"))
    chance = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(float(1 << 32))
    return sum((F.when(chance >= F.lit(step), 1).otherwise(0) for step in poisson_steps()), F.lit(0))


def judged(golden: DataFrame, one: DataFrame, two: DataFrame, k: int) -> DataFrame:
    """Per judged query: recall@k of both runs and overlap@k, the share of k they have in common.

    `golden` has (query_id, chunk_id), runs (query_id, chunk_id, rank). Queries without a judgement are left out; one that
    a run does not answer counts as missed. Hits of one query meet in one aggregate of at most 2k rows and its judgements.
    """
    kind = lambda df, name: df.select("query_id", "chunk_id", F.lit(name).alias("kind")).distinct()
    top = lambda df: df.filter(F.col("rank") <= k)
    stacked = kind(golden, "golden").unionAll(kind(top(one), "one")).unionAll(kind(top(two), "two"))
    is_in = lambda name: F.max((F.col("kind") == name).cast("int")).alias(name)
    by_chunk = stacked.groupBy("query_id", "chunk_id").agg(is_in("golden"), is_in("one"), is_in("two"))
    sums = by_chunk.groupBy("query_id").agg(
        F.sum("golden").alias("expected"), F.sum(F.col("golden") * F.col("one")).alias("one"),
        F.sum(F.col("golden") * F.col("two")).alias("two"), F.sum(F.col("one") * F.col("two")).alias("both"),
    )
    return sums.filter("expected > 0").select(
        "query_id", (F.col("one") / F.col("expected")).alias("recall_one"), (F.col("two") / F.col("expected")).alias("recall_two"),
        (F.col("both") / F.lit(k)).alias("overlap"),
    )


def compare_runs(golden: DataFrame, one: DataFrame, two: DataFrame, k: int, draws: int = DRAWS, level: float = LEVEL, seed: int = 0) -> DataFrame:
    """One row: mean recalls and overlap, their difference with its paired bootstrap interval, and the share of draws in which `one` is ahead.

    Every draw weighs each query by a Poisson number, so all draws are one pass of partial sums over the judged
    queries; no query is drawn on the driver and only a sum per draw is gathered.
    """
    queries = judged(golden, one, two, k).withColumn("gain", F.col("recall_one") - F.col("recall_two"))
    means = queries.agg(
        F.count(F.lit(1)).alias("queries"), F.avg("recall_one").alias("recall_one"), F.avg("recall_two").alias("recall_two"),
        F.avg("overlap").alias("overlap"), F.avg("gain").alias("gain"),
    )
    drawn = queries.select("query_id", "gain", F.explode(F.sequence(F.lit(1), F.lit(draws))).alias("draw"))
    weighed = drawn.withColumn("weight", drawn_weight(F.col("query_id"), F.col("draw"), seed))
    by_draw = weighed.groupBy("draw").agg((F.sum(F.col("weight") * F.col("gain")) / F.nullif(F.sum("weight"), F.lit(0))).alias("gain"))
    tail = (1 - level) / 2
    bounds = by_draw.agg(
        F.percentile("gain", F.lit(tail)).alias("low"), F.percentile("gain", F.lit(1 - tail)).alias("high"),
        F.avg((F.col("gain") > 0).cast("double")).alias("ahead"),
    )
    return means.join(bounds, F.lit(True))
