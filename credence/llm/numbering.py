"""Dense numbers 0, 1, … along an order, per group, without gathering a group."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from credence.session import settle


def numbered_within(rows: DataFrame, group: str, order: list[str], name: str) -> tuple[DataFrame, DataFrame]:
    """Rows with their number within an integer `group` along `order`, and a table of group, rows.

    Rows are dealt by ranges of (group, order), so a large group lies in many partitions. Each
    partition counts on its own; what the partitions before it hold is added by a join with one
    row per partition and group there. `rows` is read twice: settle what is costly.
    """
    ranged = rows.repartitionByRange(group, *order).sortWithinPartitions(group, *order)
    at = rows.columns.index(group)

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, seen = None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            groups = batch.column(at).to_numpy()
            heads = np.flatnonzero(np.concatenate([[True], groups[1:] != groups[:-1]]))
            places = np.arange(groups.size) - np.repeat(heads, np.diff(np.append(heads, groups.size)))
            if last == int(groups[0]):
                places[: heads[1] if heads.size > 1 else groups.size] += seen
            last, seen = int(groups[-1]), int(places[-1]) + 1
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(places.astype(np.int64))], names=[*batch.schema.names, "_local"])

    schema = T.StructType([*rows.schema.fields, T.StructField("_local", T.LongType())])
    local = settle(ranged.mapInArrow(number, schema).withColumn("_part", F.spark_partition_id()))
    counts = local.groupBy(group, "_part").agg(F.count(F.lit(1)).alias("_rows"))
    earlier = Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select(group, "_part", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_before"))
    numbered = local.join(before, [group, "_part"]).select(*rows.columns, (F.col("_local") + F.col("_before")).alias(name))
    return numbered, counts.groupBy(group).agg(F.sum("_rows").alias("rows"))
