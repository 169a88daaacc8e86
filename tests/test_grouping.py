import random

import pytest
from pyspark.sql import functions as F

from credence.operators.grouping import dense_ids, first_by, grouped_rank, hot_keys, last_by, product_join, spread_join
from credence.session import settle_counted


def test_first_and_last_by(spark):
    df = spark.createDataFrame(
        [("a", 2, "x"), ("a", 1, "y"), ("b", 5, None), (None, 1, "z")], "k string, pos int, v string"
    )
    assert {(r.k, r.v) for r in first_by(df, ["k"], ["pos"]).collect()} == {("a", "y"), ("b", None), (None, "z")}
    assert {(r.k, r.v) for r in last_by(df, ["k"], ["pos"]).collect()} == {("a", "x"), ("b", None), (None, "z")}
    assert last_by(df, ["k"], ["pos"], drop_order=True).columns == ["k", "v"]


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
@pytest.mark.parametrize("limit", [7, 10_000])
def test_spread_join_equals_a_plain_join(spark, how, limit):
    key = F.when(F.col("id") < 60, F.lit(1)).when(F.col("id") < 90, F.lit(None)).otherwise(F.col("id"))
    big = spark.range(130).select("id", key.cast("long").alias("k"))
    small = spark.range(110).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    got = spread_join(big, small, "k", ["id"], how, rows_per_task=limit)
    want = big.join(small, "k", how)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_both_sides_may_be_heavy(spark):
    key = lambda n: F.when(F.col("id") < n, F.lit(1)).otherwise(F.col("id")).cast("long").alias("k")
    big = spark.range(60).select(F.col("id").alias("a"), key(40))
    small = spark.range(50).select(F.col("id").alias("b"), key(30))
    got = spread_join(big, small, "k", ["a"], small_id=["b"], rows_per_task=6).collect()
    want = big.join(small, "k").collect()
    assert len(got) == 40 * 30 + 10 and sorted(map(str, got)) == sorted(map(str, want))
    only_small = spread_join(big, small, "k", ["a"], small_id=["b"], rows=5, rows_per_task=6).collect()
    assert sorted(map(str, only_small)) == sorted(map(str, want))
    with pytest.raises(ValueError):
        spread_join(big, small, "k", ["a"], "left", small_id=["b"])


@pytest.mark.parametrize("limit", [20, 1_000_000])
def test_product_join_deals_keys_by_the_rows_they_give(spark, limit):
    key = lambda *sizes: F.expr(f"case when id < {sizes[0]} then 1 when id < {sizes[1]} then 2 when id < {sizes[2]} then null else id end").cast("long").alias("k")
    left, right = spark.range(60).select(F.col("id").alias("a"), key(30, 35, 38)), spark.range(60).select(F.col("id").alias("b"), key(5, 40, 44))
    got = product_join(left, right, "k", ["a"], ["b"], rows_per_task=limit)
    rows = got.collect()
    assert len(rows) == 30 * 5 + 5 * 35 + 16 and sorted(map(str, rows)) == sorted(map(str, left.join(right, "k").collect()))
    # No key's rows come out of one task, and none of them out of far more than the limit.
    each = got.groupBy(F.spark_partition_id().alias("task"), "k").count().collect()
    assert max(r["count"] for r in each) == 175 if limit > 20 else all(r["count"] < 90 for r in each)
    assert product_join(left.limit(0), right, "k", ["a"], ["b"], rows_per_task=limit).count() == 0


def test_product_join_weighs_by_what_follows(spark):
    one = "case when id >= 0 then 1L end as k"
    left, right = spark.range(40).selectExpr("id as a", one), spark.range(2).selectExpr("id as b", one)
    weights = spark.createDataFrame([(1, 2, 1000)], "k long, _m long, _gives long")
    got = product_join(left, right, "k", ["a"], ["b"], weights, rows_per_task=4000)
    each = got.groupBy(F.spark_partition_id()).count().collect()
    assert sum(r["count"] for r in each) == 80 and len(each) > 1


def test_heavy_keys_are_cut_into_enough_parts(spark):
    big = spark.range(100).select(F.when(F.col("id") < 60, 1).otherwise(F.col("id")).alias("k"))
    assert [(r.k, r._parts) for r in hot_keys(big, ["k"], 7).collect()] == [(1, 9)]


def test_known_size_skips_weighing(spark):
    big, rows = settle_counted(spark.range(10).withColumn("k", F.lit(1)))
    assert rows == 10
    assert spread_join(big, spark.range(2).withColumnRenamed("id", "k"), "k", ["id"], rows=rows).count() == 10


def test_grouped_rank_equals_row_number(spark):
    random.seed(3)
    rows = [(random.randrange(3), random.randrange(5), i) for i in range(500)]
    df = spark.createDataFrame(rows, "g int, score int, id int")
    ranked = grouped_rank(
        df, ["g"], [-F.col("score"), F.col("id")], [-F.col("score"), F.floor(F.col("id") / 16)], "rank"
    )
    want = {}
    for g in range(3):
        for rank, row in enumerate(sorted((r for r in rows if r[0] == g), key=lambda r: (-r[1], r[2])), start=1):
            want[row[2]] = rank
    assert {r["id"]: r["rank"] for r in ranked.collect()} == want


def test_dense_ids_follow_the_key_order(spark):
    df = spark.range(1000).repartition(7).select(F.concat(F.lit("k"), F.col("id")).alias("k"))
    got = sorted((r.n, r.k) for r in dense_ids(df, "k", "n", start=5).collect())
    assert got == list(enumerate(sorted(f"k{i}" for i in range(1000)), start=5))
    assert dense_ids(df.limit(0), "k", "n").count() == 0
    copies = spark.range(300).select(F.when(F.col("id") < 200, "same").otherwise(F.col("id").cast("string")).alias("k"))
    numbered = sorted((r.n, r.k) for r in dense_ids(copies, "k", "n", unique=False).collect())
    assert [n for n, _ in numbered] == list(range(1, 301)) and [k for _, k in numbered] == sorted(r.k for r in copies.collect())


def test_every_heavy_key_is_cut(spark, monkeypatch):
    big = spark.range(12_000).select("id", (F.col("id") % 3000).alias("k"))
    small = spark.range(3000).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    assert hot_keys(big, ["k"], 3).count() == 3000
    for limit in (10_000, 100):
        monkeypatch.setattr("credence.operators.grouping.BROADCAST_HOT_KEYS", limit)
        joined = spread_join(big, small, "k", ["id"], rows_per_task=3)
        assert joined.count() == 12_000 and joined.filter("v <> 2 * k").count() == 0


def test_grouped_rank_keeps_null_keys(spark):
    df = spark.createDataFrame([(1, 5, 1), (1, None, 2), (None, 5, 3)], "g int, score int, id int")
    ranked = grouped_rank(df, ["g"], [F.col("score"), F.col("id")], [F.col("score")], "rank")
    assert sorted((r["id"], r["rank"]) for r in ranked.collect()) == [(1, 2), (2, 1), (3, 1)]
