"""Session defaults and the shared checkpoint folder."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def build_session(app_name: str = "credence", master: str | None = None, **conf: str) -> SparkSession:
    builder = (
        SparkSession.builder.appName(app_name)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.forceOptimizeSkewedJoin", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The folder the session names in spark.checkpoint.dir; a temporary one on local masters only."""
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        named = tempfile.mkdtemp(prefix="credence-checkpoint-")
        atexit.register(shutil.rmtree, named, ignore_errors=True)
    context.setCheckpointDir(named)
    return named


# Folders settled within the scopes that are open, innermost last.
_SCOPES: list[list[str]] = []


@contextmanager
def settled_scope(spark: SparkSession) -> Iterator[None]:
    """Deletes what is settled inside, at the end. For jobs whose results are written elsewhere by then."""
    made: list[str] = []
    _SCOPES.append(made)
    try:
        yield
    finally:
        _SCOPES.remove(made)
        for folder in made:
            delete_folder(spark, folder)


def delete_folder(spark: SparkSession, folder: str) -> None:
    """Through Hadoop's file systems, as Spark's own interface deletes no files."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def forget_at_end(folder: str) -> None:
    """Has the innermost open scope delete a folder, too."""
    if _SCOPES:
        _SCOPES[-1].append(folder)


def settle(df: DataFrame) -> DataFrame:
    """Write the rows once to the shared checkpoint folder and go on from the files.

    Later steps neither recompute the rows nor lose them with an executor. Unlike an
    RDD checkpoint the files are columnar, so later steps read only the columns they
    use, and their size is known when Spark chooses between broadcast and shuffle.
    """
    return settle_counted(df)[0]


def settle_counted(df: DataFrame) -> tuple[DataFrame, int]:
    """`settle`, and the number of rows, which the write counts in passing."""
    spark, seen = df.sparkSession, Observation()
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/settled-{uuid.uuid4().hex}"
    forget_at_end(path)
    df.observe(seen, F.count(F.lit(1)).alias("rows")).write.option("compression", "zstd").parquet(path)
    settled, rows = spark.read.schema(df.schema).parquet(path), seen.get["rows"]
    # A folder that executors do not share would lose rows without an error.
    if path.startswith(("file:", "/")) and not spark.sparkContext.master.startswith("local["):
        back = settled.count()
        if back != rows:
            raise OSError(f"{rows} rows were written below {path} and {back} are there: executors do not share it")
    return settled, rows
