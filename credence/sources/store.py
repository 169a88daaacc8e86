"""Stored tables as Parquet folders under one root, changed partition by partition and switched at once.

A table is cut into partitions by ranges of an id (graph nodes by a hash of theirs). Where ids are sparse the
ranges are widened, so that partitions are either few or well filled. What a change writes lies
in folders of its own; which folders make up a table is listed, for all tables together, under a version
number in `versions`. A change reads and rewrites only the partitions its rows fall into, and all of it
counts from the moment its version is listed: until then, or if it fails, every reader sees the version
before. One writer at a time.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from credence import schemas
from credence.session import delete_folder

# Ids of one partition, and partitions of a table whose key is no number.
IDS_PER_PART = 1_000_000
HASH_PARTS = 64
# Ranges are widened, four times a step, while a table has more partitions than this and fewer rows in each than that.
FEW_PARTS = 256
ROWS_PER_PART = 50_000
# Doublings of a range that are tried; the last makes some twenty ranges of all 64-bit ids.
LEVELS = range(0, 42, 2)
VERSIONS = "version long, table string, part long, folder string, top long, level int, rows long"


class TableStore:
    """Reads and changes the tables of `schemas.STORED_TABLES` below a root folder."""

    def __init__(self, spark: SparkSession, root: str, ids_per_part: int = IDS_PER_PART, hash_parts: int = HASH_PARTS):
        self.spark, self.root = spark, root.rstrip("/")
        self.ids_per_part, self.hash_parts = ids_per_part, hash_parts
        self._state: tuple[int, dict[str, dict[int, list[str]]], dict[str, int]] | None = None
        # How often the ranges of each table were doubled, and the rows of each folder.
        self.levels, self.sizes = dict.fromkeys(schemas.STORED_TABLES, 0), {}

    def state(self) -> tuple[int, dict[str, dict[int, list[str]]], dict[str, int]]:
        """The newest version: its number, folders per table and partition, greatest id per table. One row per partition."""
        if self._state is None:
            folders: dict[str, dict[int, list[str]]] = {name: {} for name in schemas.STORED_TABLES}
            tops, version = dict.fromkeys(schemas.STORED_TABLES, 0), 0
            self.levels, self.sizes = dict.fromkeys(schemas.STORED_TABLES, 0), {}
            for row in self._newest():
                version = row["version"]
                if row["folder"] is None:
                    tops[row["table"]] = row["top"]
                    self.levels[row["table"]] = row["level"] or 0
                else:
                    folders[row["table"]].setdefault(row["part"], []).append(row["folder"])
                    # Versions from before rows were listed: taken for full.
                    self.sizes[row["folder"]] = self.ids_per_part if row["rows"] is None else row["rows"]
            self._state = version, folders, tops
        return self._state

    def _newest(self) -> list:
        try:
            versions = self.spark.read.schema(VERSIONS).parquet(f"{self.root}/versions")
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return []
        newest = versions.agg(F.max("version")).first()[0]
        return versions.filter(F.col("version") == newest).collect() if newest is not None else []

    def refresh(self) -> None:
        """Forgets the version seen last, so that the next read looks for a newer one."""
        self._state = None

    def read(self, name: str) -> DataFrame:
        return self._rows(name, self.state()[1][name])

    def _rows(self, name: str, parts: dict[int, list[str]]) -> DataFrame:
        paths = [f"{self.root}/{folder}" for _, folders in sorted(parts.items()) for folder in folders]
        schema = self.schema(name)
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def schema(self, name: str) -> StructType:
        return StructType.fromDDL(schemas.STORED_TABLES[name])

    def part(self, name: str, level: int = 0) -> Column:
        """The partition of a row, where the table's ranges were doubled so often."""
        key = F.col(schemas.PARTITIONED_BY[name])
        if self.by_hash(name):
            return F.pmod(F.xxhash64(key), F.lit(self.hash_parts)).cast("long")
        return F.shiftright(F.floor(key / F.lit(self.ids_per_part)).cast("long"), level)

    def by_hash(self, name: str) -> bool:
        return schemas.PARTITIONED_BY[name].endswith("node_id")

    def replace(self, name: str, rows: DataFrame) -> None:
        """Puts rows in place of one table's. They may come from the table itself."""
        with self.change() as change:
            change.clear(name)
            change.append(name, rows)

    def truncate_all(self) -> None:
        with self.change() as change:
            for name in schemas.STORED_TABLES:
                change.clear(name)

    @contextmanager
    def change(self) -> Iterator[Change]:
        """A set of changes to any tables that takes effect at the end, if nothing fails."""
        change = Change(self)
        yield change
        self._state = change.commit()
        self.levels, self.sizes = change.levels, change.sizes

    def vacuum(self) -> list[str]:
        """Deletes and returns folders that no table needs any more: older versions, failed changes."""
        used = {folder.rsplit("/", 1)[0] for parts in self.state()[1].values() for folders in parts.values() for folder in folders}
        found = (
            self.spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(self.root)
            .select(F.regexp_extract("path", r"/data/([^/]+/[^/]+)/part_no=", 1).alias("folder")).filter("folder <> ''").distinct()
        )
        left = sorted({f"data/{row['folder']}" for row in found.collect()} - used)
        for folder in left:
            delete_folder(self.spark, f"{self.root}/{folder}")
        return left


class Change:
    """Tables as they will be: read and changed here, seen by others once committed."""

    def __init__(self, store: TableStore):
        self.store = store
        version, folders, tops = store.state()
        self.version = version + 1
        self.folders = {name: dict(parts) for name, parts in folders.items()}
        self.tops = dict(tops)
        self.levels, self.sizes = dict(store.levels), dict(store.sizes)

    def read(self, name: str, parts: list[int] | None = None) -> DataFrame:
        own = self.folders[name]
        return self.store._rows(name, own if parts is None else {p: own[p] for p in parts if p in own})

    def next_id(self, name: str) -> int:
        return self.tops[name] + 1

    def clear(self, name: str) -> None:
        self.folders[name], self.tops[name], self.levels[name] = {}, 0, 0

    def append(self, name: str, rows: DataFrame) -> None:
        """Adds rows in folders beside those their partitions have. Their ids are looked at first, then they are written."""
        self._widen(name, rows)
        for part, folder in self._written(name, rows).items():
            self.folders[name][part] = [*self.folders[name].get(part, []), folder]

    def merge(self, name: str, rows: DataFrame, combine: Callable[[DataFrame, DataFrame], DataFrame]) -> list[int]:
        """Puts `combine(stored, rows)` in place of the partitions that rows fall into; returns these.

        `rows` need the partition's key and are read three times. `combine` must leave every row in its partition.
        """
        self._widen(name, rows)
        # As many numbers as there are partitions.
        touched = sorted(r["part_no"] for r in rows.select(self._part(name).alias("part_no")).distinct().collect())
        written = self._written(name, combine(self.read(name, touched), rows))
        for part in touched:
            self.folders[name].pop(part, None)
        self.folders[name] |= {part: [folder] for part, folder in written.items()}
        return touched

    def _part(self, name: str) -> Column:
        return self.store.part(name, self.levels[name])

    def _widen(self, name: str, rows: DataFrame) -> None:
        """Doubles the table's ranges where it would else have many small partitions with these rows.

        Folders of ranges that become one are listed together; nothing is rewritten for it.
        """
        if self.store.by_hash(name):
            return
        now = self.levels[name]
        levels = [level for level in LEVELS if level >= now]
        parts = rows.select(self._part(name).alias("part_no")).filter("part_no is not null").groupBy("part_no").agg(F.count(F.lit(1)).alias("n"))
        each = parts.select("n", "part_no", F.explode(F.array(*[F.lit(level) for level in levels])).alias("level"))
        wide = each.groupBy("level", F.expr(f"shiftright(part_no, level - {now})").alias("part_no")).agg(F.sum("n").alias("n"))
        found = {r["level"]: r for r in wide.groupBy("level").agg(F.count(F.lit(1)).alias("parts"), F.sum("n").alias("n")).collect()}  # one row per level
        stored = sum(self.sizes[folder] for folders in self.folders[name].values() for folder in folders)
        for level, row in sorted(found.items()):
            self.levels[name], count = level, row["parts"] + len({part >> (level - now) for part in self.folders[name]})
            if count <= FEW_PARTS or stored + row["n"] >= count * ROWS_PER_PART:
                break
        wider: dict[int, list[str]] = {}
        for part, folders in sorted(self.folders[name].items()):
            wider.setdefault(part >> (self.levels[name] - now), []).extend(folders)
        self.folders[name] = wider

    def _written(self, name: str, rows: DataFrame) -> dict[int, str]:
        folder, spark = f"data/{name}/{self.version:08d}-{uuid.uuid4().hex}", self.store.spark
        path, key = f"{self.store.root}/{folder}", schemas.IDS.get(name)
        placed = rows.to(self.store.schema(name)).withColumn("part_no", self._part(name))
        # Large partitions are written by several tasks, small ones by one.
        placed.hint("rebalance", "part_no").write.partitionBy("part_no").parquet(path)
        written = spark.read.schema(f"{schemas.STORED_TABLES[name]}, part_no long").parquet(path)
        found = written.groupBy("part_no").agg((F.max(key) if key else F.lit(0)).alias("top"), F.count(F.lit(1)).alias("n")).collect()  # one row per partition
        self.tops[name] = max([self.tops[name], *(r["top"] for r in found)])
        placed_in = {r["part_no"]: f"{folder}/part_no={r['part_no']}" for r in found}
        self.sizes |= {placed_in[r["part_no"]]: r["n"] for r in found}
        return placed_in

    def commit(self) -> tuple[int, dict[str, dict[int, list[str]]], dict[str, int]]:
        rows = [(self.version, name, None, None, top, self.levels[name], None) for name, top in self.tops.items()]
        listed = [(name, part, folder) for name, parts in self.folders.items() for part, folders in parts.items() for folder in folders]
        self.sizes = {folder: self.sizes[folder] for _, _, folder in listed}
        rows += [(self.version, name, part, folder, None, None, self.sizes[folder]) for name, part, folder in listed]
        listed = self.store.spark.createDataFrame(rows, VERSIONS)
        listed.coalesce(1).write.mode("append").parquet(f"{self.store.root}/versions")
        return self.version, self.folders, self.tops


def arrivals(spark: SparkSession, path: str) -> DataFrame:
    """Parquet rows with `_file` and `_row`: the order in which a load takes them."""
    return spark.read.parquet(path).select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row"))
