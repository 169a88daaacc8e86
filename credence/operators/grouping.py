"""Grouping helpers that stay safe when one key holds a large share of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from credence.session import settle

# Keys heavier than this are split over several tasks by spread_join.
ROWS_PER_TASK = 2_000_000
# So many heavy keys travel to every task; more of them are joined like any table.
BROADCAST_HOT_KEYS = 10_000
# Tasks of one product_join at most.
MOST_TASKS = 20_000


def first_by(df: DataFrame, keys: Sequence[str], order: Sequence[str], drop_order: bool = False) -> DataFrame:
    """One whole row per key, the least by `order`.

    An aggregate, not a window: the map side already reduces each key to one row,
    so a key holding a third of the table never gathers in one task.
    """
    return _pick(df, keys, order, F.min_by, drop_order)


def last_by(df: DataFrame, keys: Sequence[str], order: Sequence[str], drop_order: bool = False) -> DataFrame:
    """One whole row per key, the greatest by `order`."""
    return _pick(df, keys, order, F.max_by, drop_order)


def _pick(df, keys, order, chooser, drop_order):
    dropped = set(order) if drop_order else set()
    kept = [c for c in df.columns if c not in dropped]
    payload = [c for c in kept if c not in keys]
    ranked = F.struct(*order)
    picked = df.groupBy(*keys).agg(chooser(F.struct(*payload), ranked).alias("_row"))
    return picked.select(*[F.col(c) if c in keys else F.col(f"_row.{c}").alias(c) for c in kept])


def hot_keys(big: DataFrame, on: Sequence[str], rows_per_task: int | None = None) -> DataFrame:
    """Keys heavier than one task should take, with the number of parts each needs."""
    rows_per_task = rows_per_task or ROWS_PER_TASK
    weights = big.groupBy(*on).agg(F.count(F.lit(1)).alias("_n"))
    return (
        weights.filter(F.col("_n") > F.lit(rows_per_task))
        .select(*on, F.ceil(F.col("_n") / F.lit(rows_per_task)).cast("int").alias("_parts"))
    )


def spread_join(
    big: DataFrame,
    small: DataFrame,
    on: str | Sequence[str],
    row_id: Sequence[str],
    how: str = "inner",
    small_id: Sequence[str] | None = None,
    weigh: DataFrame | None = None,
    rows: int | None = None,
    rows_per_task: int | None = None,
    small_rows: int | None = None,
) -> DataFrame:
    """Equi-join where single keys may be very heavy.

    The keys of `big` are weighed first (one aggregate over the key columns). Without a
    heavy key this is a plain join. Otherwise heavy keys are cut into parts by a hash of
    `row_id`, and only those keys of `small` are repeated, once per part. With `small_id`
    the other side is treated the same way, for joins where a key may be heavy on both
    (inner joins only). Every heavy key is cut: up to `BROADCAST_HOT_KEYS` of them travel to
    the tasks, more are written once and joined.

    `weigh` is a cheaper frame with the same keys, for a `big` that is costly to compute
    twice; `rows` its known size, which settles the question if it is small: a key cannot
    hold more rows than the table. `small_rows` is the same for the other side. `how` is inner, left, left_semi or left_anti.
    """
    on = [on] if isinstance(on, str) else list(on)
    if small_id and how != "inner":
        raise ValueError("only an inner join may repeat rows of its left side")
    rows_per_task = rows_per_task or ROWS_PER_TASK
    heavy = small_heavy = None
    if rows is None or rows > rows_per_task:
        heavy = _collected(hot_keys(weigh if weigh is not None else big, on, rows_per_task))
    if small_id and (small_rows is None or small_rows > rows_per_task):
        small_heavy = _collected(hot_keys(small, on, rows_per_task))
    if heavy is None and small_heavy is None:
        return big.join(small, on, how)
    left = _cut(big, heavy, on, row_id, "_part")
    right = _repeat(small, heavy, on, "_part")
    parts = ["_part"]
    if small_heavy is not None:
        left, right = _repeat(left, small_heavy, on, "_other"), _cut(right, small_heavy, on, small_id, "_other")
        parts.append("_other")
    return left.join(right, [*on, *parts], how).drop(*parts)


def product_join(
    left: DataFrame,
    right: DataFrame,
    on: str | Sequence[str],
    left_id: Sequence[str],
    right_id: Sequence[str],
    weights: DataFrame | None = None,
    rows_per_task: int | None = None,
) -> DataFrame:
    """Inner equi-join that may give far more rows than its sides have, as keys repeat on both.

    A key is weighed by the rows it gives. A heavy one is cut into parts on the side that has more rows of it,
    by a hash of that side's row id; the rows of the other side are repeated, once per part. `weights` (the
    key, `_m` rows of `right`, `_gives` rows for each row of `left`) serves where a further join multiplies them.
    """
    on = [on] if isinstance(on, str) else list(on)
    rows_per_task = rows_per_task or ROWS_PER_TASK
    if weights is None:
        weights = right.groupBy(*on).agg(F.count(F.lit(1)).alias("_m")).withColumn("_gives", F.col("_m"))
    # Floating point, as the product of two counts may not fit a long.
    gives = F.col("_n").cast("double") * F.col("_gives")
    sizes = settle(left.groupBy(*on).agg(F.count(F.lit(1)).alias("_n")).join(weights, on).withColumn("_gives", gives))
    total = sizes.agg(F.sum("_gives")).first()[0] or 0
    if total <= rows_per_task:
        return left.join(right.hint("merge"), on)
    # Sized by the rows that come out: those that go in may be too few to be dealt to more than one task.
    tasks = int(min(MOST_TASKS, max(left.sparkSession.sparkContext.defaultParallelism, -(-total // rows_per_task))))
    parts = F.least(F.ceil(F.col("_gives") / F.lit(rows_per_task)), F.greatest("_n", "_m"), F.lit(1 << 30)).cast("int")
    of_left = F.col("_n") >= F.col("_m")
    heavy = _collected(
        sizes.filter(F.col("_gives") > F.lit(rows_per_task))
        .select(*on, F.when(of_left, parts).otherwise(1).alias("_left"), F.when(of_left, 1).otherwise(parts).alias("_right"))
    )
    keys = on
    if heavy is not None:
        keys = [*on, "_part", "_other"]
        lefts, rights = (heavy.select(*on, F.col(side).alias("_parts")) for side in ("_left", "_right"))
        left = _repeat(_cut(left, lefts, on, left_id, "_part"), rights, on, "_other")
        right = _cut(_repeat(right, lefts, on, "_part"), rights, on, right_id, "_other")
    return left.repartition(tasks, *keys).join(right.repartition(tasks, *keys).hint("merge"), keys).drop("_part", "_other")


def _collected(keys: DataFrame) -> DataFrame | None:
    """The heavy keys, broadcast if they are few, None if there are none."""
    found = keys.limit(BROADCAST_HOT_KEYS + 1).collect()
    if len(found) > BROADCAST_HOT_KEYS:
        return settle(keys)
    return F.broadcast(keys.sparkSession.createDataFrame(found, keys.schema)) if found else None


def _cut(df: DataFrame, heavy: DataFrame | None, on: Sequence[str], row_id: Sequence[str], part: str) -> DataFrame:
    if heavy is None:
        return df.withColumn(part, F.lit(0))
    has_null = F.lit(False)
    for key in on:
        has_null = has_null | F.col(key).isNull()
    spread = F.xxhash64(*row_id)
    # NULL keys match nothing; scatter them so they do not pile up in one task.
    number = F.when(has_null, F.pmod(spread, F.lit(4096))).otherwise(
        F.pmod(spread, F.coalesce(F.col("_parts"), F.lit(1)))
    )
    return df.join(heavy, list(on), "left").withColumn(part, number.cast("int")).drop("_parts")


def _repeat(df: DataFrame, heavy: DataFrame | None, on: Sequence[str], part: str) -> DataFrame:
    if heavy is None:
        return df.withColumn(part, F.lit(0))
    numbers = F.sequence(F.lit(0), F.coalesce(F.col("_parts"), F.lit(1)) - 1)
    return df.join(heavy, list(on), "left").withColumn(part, F.explode(numbers)).drop("_parts")


def grouped_rank(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    coarse: Sequence[Column],
    name: str,
) -> DataFrame:
    """Exact 1-based rank within `keys`, without sorting a whole group in one task.

    `coarse` must be non-decreasing in `order` (a prefix of it, or a rounded-down
    value). Rows are ranked inside (keys, coarse) and shifted by the number of rows
    in the lower coarse groups, which is a sum over a much smaller table. `df` is read
    twice, so it should be stored or cheap.
    """
    marks = [f"_c{i}" for i in range(len(coarse))]
    marked = df
    for mark, expr in zip(marks, coarse):
        marked = marked.withColumn(mark, expr)
    groups = [*keys, *marks]
    sizes = marked.groupBy(*groups).agg(F.count(F.lit(1)).alias("_size"))
    below = Window.partitionBy(*keys).orderBy(*marks).rowsBetween(Window.unboundedPreceding, -1)
    shifts = sizes.select(*groups, F.coalesce(F.sum("_size").over(below), F.lit(0)).alias("_shift"))
    inside = Window.partitionBy(*groups).orderBy(*order)
    # Null keys and null coarse values are groups of their own.
    renamed = shifts.select(*[F.col(g).alias(f"_g_{g}") for g in groups], "_shift")
    same = [marked[g].eqNullSafe(renamed[f"_g_{g}"]) for g in groups]
    return (
        marked.join(renamed, same).drop(*[f"_g_{g}" for g in groups])
        .withColumn(name, F.row_number().over(inside) + F.col("_shift"))
        .drop("_shift", *marks)
    )


def dense_ids(df: DataFrame, key: str, name: str, start: int = 1, unique: bool = True) -> DataFrame:
    """Dense numbers from `start` on, in the order of `key`.

    Rows are range-partitioned by key, numbered inside each partition and written once;
    each partition's numbers are then shifted by the sizes of the ones before it. One
    shuffle, no global sort in one task, and a re-run task cannot change a number.
    Copies of one key may be many unless `unique`; a random second key then lets the
    ranges cut through them, as their order among themselves means nothing.
    """
    ranges = [F.col(key)] if unique else [F.col(key), F.rand(7)]
    local = F.monotonically_increasing_id()
    placed = settle(df.repartitionByRange(*ranges).sortWithinPartitions(key).withColumn("_at", local))
    # The id is the partition number above 33 bits of row number.
    partition, row = F.shiftright("_at", 33), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = placed.groupBy(partition.alias("_partition")).agg(F.count(F.lit(1)).alias("_size"))
    # One row per partition of the range shuffle.
    below = Window.orderBy("_partition").rowsBetween(Window.unboundedPreceding, -1)
    shifts = sizes.select("_partition", F.coalesce(F.sum("_size").over(below), F.lit(0)).alias("_shift"))
    return (
        placed.withColumn("_partition", partition)
        .join(F.broadcast(shifts), "_partition")
        .withColumn(name, row + F.col("_shift") + F.lit(start))
        .drop("_at", "_partition", "_shift")
    )
