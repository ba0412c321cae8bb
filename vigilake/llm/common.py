"""Helpers shared by the operators: stored intermediate rows, global positions, text columns."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vigilake.functions.bitmaps import bitmap, in_bitmap
from vigilake.session import materialize

__all__ = [
    "NOT_SPACES", "SPACES", "bitmap", "ensure_checkpoint_dir", "fresh", "in_bitmap", "keep", "partitions", "ranked", "small_batches", "store",
    "text_of",
]

SPACES = r"[\x20\x09-\x0D]"
NOT_SPACES = r"[^\x20\x09-\x0D]"
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """The folder named by ``spark.checkpoint.dir``; only local sessions that name none get their own."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    if sc.getCheckpointDir():
        return
    if not named:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="checkpoints-")
    sc.setCheckpointDir(named)


@contextmanager
def _tidy(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of what runs inside go when it has run: its rows are stored, nothing reads the files again."""
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEANUP, before)


def small_batches(spark: SparkSession) -> SparkSession:
    """Rows travel to Python in batches of a few MB; a longer text travels alone."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "8m")
    return spark


def keep(df: DataFrame) -> DataFrame:
    """The rows in the shared checkpoint folder: lineage is cut and a lost executor loses none of them."""
    ensure_checkpoint_dir(df.sparkSession)
    with _tidy(df.sparkSession):
        return df.checkpoint(eager=True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def fresh(docs: DataFrame, name: str) -> str:
    """A column name that ``docs`` does not have."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name += "_"
    return name


def text_of(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def ranked(df: DataFrame, order: list[Column | str], name: str = "rank") -> DataFrame:
    """Adds the global position (from 0) of each row in ``order``, without one task that sees all rows.

    Range partitioning with sampled splitters, a sort in each partition, then the number of rows in the
    partitions before it.  What is broadcast has one row per partition.
    """
    spark = df.sparkSession
    at = F.monotonically_increasing_id()
    placed = keep(df.repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order).withColumn("_at", at))
    part = F.shiftright("_at", 33)
    counts = sorted(placed.groupBy(part.alias("p")).count().collect())
    before, total = [], 0
    for p, n in counts:
        before.append((p, total))
        total += n
    starts = spark.createDataFrame(before, "_p long, _before long")
    joined = placed.withColumn("_p", part).join(F.broadcast(starts), "_p")
    return joined.withColumn(name, F.col("_before") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))).drop("_p", "_before", "_at")


def store(df: DataFrame) -> DataFrame:
    """The rows as compressed Parquet in the shared checkpoint folder; the files go when the session ends."""
    ensure_checkpoint_dir(df.sparkSession)
    with _tidy(df.sparkSession):
        return materialize(df)
