"""Running totals per group along an order, without gathering a group in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from credence.session import settle

PART = "_part"


def running_totals(rows: DataFrame, group: Sequence[str], order: Sequence[str | Column], sums: dict[str, str]) -> DataFrame:
    """Rows with, for each `{column: name}`, the sum of the column over the rows before in the group.

    Rows are dealt by ranges of (group, order), so a large group lies in many partitions, and
    written. A window sums within the piece of a group that one partition holds; what the pieces
    before it hold is joined, one row per group and partition. Group columns must not be null. Rows
    keep the number of their partition as `_part`, for `attached`.
    """
    dealt = settle(rows.repartitionByRange(*group, *order).withColumn(PART, F.spark_partition_id()))
    piece = [*group, PART]
    totals = dealt.groupBy(*piece).agg(*[F.sum(c).alias(f"_{name}") for c, name in sums.items()])
    earlier = Window.partitionBy(*group).orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select(*piece, *[F.coalesce(F.sum(f"_{name}").over(earlier), F.lit(0)).alias(f"_{name}") for name in sums.values()])
    inside = Window.partitionBy(*piece).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    local = dealt.select("*", *[F.coalesce(F.sum(c).over(inside), F.lit(0)).alias(name) for c, name in sums.items()])
    return local.join(before, piece).select(*rows.columns, PART, *[(F.col(name) + F.col(f"_{name}")).alias(name) for name in sums.values()])


def attached(rows: DataFrame, facts: DataFrame, group: str) -> DataFrame:
    """Rows of `running_totals` with the columns of `facts`, which has one row per group.

    The facts go to every partition that holds a piece of the group and are joined there, so the
    join's keys are no heavier than a partition. `rows` is read twice.
    """
    pieces = rows.select(group, PART).distinct().join(facts, group)
    return rows.join(pieces, [group, PART])
