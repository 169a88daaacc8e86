"""Connected components of an edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from credence.session import settle, settle_counted


def components(edges: DataFrame) -> DataFrame:
    """node, root (its component's least node) of every node but the roots, for edges with columns a, b.

    Each step keeps the components and shortens paths. Nodes with many neighbours only ever meet
    one aggregated row per node, in joins that can be split. Ends when a step changes nothing.
    """
    ends = edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    current, rows = settle_counted(ends)
    sign = _sign(current)
    while rows:
        both = current.select(F.col("u").alias("x"), F.col("v").alias("y")).unionByName(current.select(F.col("v").alias("x"), F.col("u").alias("y")))
        least = both.groupBy("x").agg(F.min("y").alias("m")).select("x", F.least("x", "m").alias("m"))
        large = settle(both.join(least, "x").filter("y > x").select(F.col("y").alias("u"), F.col("m").alias("v")).distinct())
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lowest, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        after, after_rows = settle_counted(small.unionByName(lowest.select("u", F.col("m").alias("v"))).distinct())
        after_sign = _sign(after)
        same = (rows, sign) == (after_rows, after_sign)
        current, rows, sign = after, after_rows, after_sign
        if same:
            break
    return current.select(F.col("u").alias("node"), F.col("v").alias("root"))


def _sign(edges: DataFrame):
    """A sum of hashes that tells edge tables of one size apart."""
    return edges.agg(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()[0]


class Forest:
    """Union-find over 0 … n-1, the root of a tree being its least member."""

    def __init__(self, size: int):
        self.parent = np.arange(size)

    def root(self, x: int) -> int:
        parent = self.parent
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = int(parent[x])
        return x

    def unite(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        if a == b:
            return False
        self.parent[max(a, b)] = min(a, b)
        return True

    def roots(self) -> np.ndarray:
        """The root of every member."""
        while True:
            up = self.parent[self.parent]
            if np.array_equal(up, self.parent):
                return up
            self.parent = up
