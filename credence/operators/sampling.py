"""Seeded bounded samples and the stratified, mutually exclusive company sample."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from credence.config import RISK_COLUMNS, RISK_FLAG_TO_CODE, RiskSettings
from credence.functions.risk import holds

BUCKETS = ["normal", "revenue_drop_gt_30", "negative_profit", "assets_drop_gt_25", "data_quality_issue"]


def draw(key: str, seed: int) -> Column:
    """Pseudo-random, repeatable sort key of a row; independent of partitioning."""
    return F.md5(F.concat(F.col(key), F.lit(f":{seed}")))


def bounded_sample(df: DataFrame, n: int, seed: int, key: str = "inn") -> DataFrame:
    """min(n, rows) rows. orderBy + limit keeps n rows per task and merges them, without a full sort."""
    return df.orderBy(draw(key, seed), key).limit(n)


def bucket_conditions(columns: list[str], settings: RiskSettings) -> dict[str, Column]:
    year, code_to_flag = settings.target_year, {v: k for k, v in RISK_FLAG_TO_CODE.items()}
    parts = [F.col(f"{m}_{year}") > 0 for m in ("revenue", "net_profit") if f"{m}_{year}" in columns]
    parts += [~F.col(c) for c in RISK_COLUMNS if c in columns]
    out = {}
    if parts:
        normal = parts[0]
        for part in parts[1:]:
            normal = normal & part
        out["normal"] = normal
    for name in BUCKETS[1:]:
        if code_to_flag[name] in columns:
            out[name] = F.col(code_to_flag[name])
    return out


def sample_keys(features: DataFrame, settings: RiskSettings = RiskSettings()) -> DataFrame:
    """(inn, sample_bucket) of the stratified sample: buckets in order, each without the earlier picks.

    A bucket can lose at most as many rows as the earlier buckets take, so its first
    size + sum(earlier sizes) draws decide it. Those few rows come out of one pass
    over the features (a per-bucket top-n whose partial limit runs before the shuffle);
    only they go through the sequential exclusion.
    """
    conditions = bucket_conditions(features.columns, settings)
    sizes = [settings.bucket_sizes.get(b, 30 if b == "normal" else 15) for b in BUCKETS]
    enough = [sum(sizes[: i + 1]) for i in range(len(BUCKETS))]
    entries = [
        F.when(holds(conditions[b]), F.struct(F.lit(i).alias("b"), draw("inn", settings.seed + i).alias("h")))
        for i, b in enumerate(BUCKETS)
        if b in conditions
    ]
    member = F.explode(F.filter(F.array(*entries), lambda e: e.isNotNull())).alias("e")
    entered = features.select("inn", member).select("inn", "e.b", "e.h")
    turn = F.row_number().over(Window.partitionBy("b").orderBy("h", "inn"))
    drawn = entered.withColumn("turn", turn).filter(F.col("turn") <= max(enough))

    def resolve(rows: pd.DataFrame) -> pd.DataFrame:
        taken: dict[str, str] = {}
        for i, bucket in enumerate(BUCKETS):
            pool = rows[(rows.b == i) & ~rows.inn.isin(taken.keys())].sort_values("turn")
            taken.update({inn: bucket for inn in pool.inn.head(sizes[i])})
        return pd.DataFrame({"inn": list(taken.keys()), "sample_bucket": list(taken.values())})

    # At most len(BUCKETS) * max(enough) rows reach this one group, whatever the input size.
    return drawn.withColumn("all", F.lit(0)).groupBy("all").applyInPandas(resolve, "inn string, sample_bucket string")


def stratified_sample(features: DataFrame, settings: RiskSettings = RiskSettings()) -> DataFrame:
    """The sampled companies' feature rows with their bucket."""
    return features.join(F.broadcast(sample_keys(features, settings)), "inn", "inner")
