"""Files as tables: a layout that lets scans prune by language and by repository."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigilake.operators.files import CONTROL, classify


def write_files(files: DataFrame, path: str) -> None:
    """Writes (repo, path, content) partitioned by language.

    The Python rules, environment files and control files (git and ignore files) then read
    their own partitions only.  Rows are spread by a hash of repository and path, so neither a
    large repository nor a frequent language ends up in one task.
    """
    control = F.rlike("path", F.lit(r"(?:^|/)\.git(?:/|$)|(?:^|/)\.gitignore$|(?:^|/)\.scanignore$"))
    rows = classify(files.drop("language")).withColumn("language", F.when(control, F.lit(CONTROL)).otherwise(F.col("language")))
    (
        rows.repartition("repo", "path").sortWithinPartitions("language", "repo", "path")
        .select("repo", "path", "content", "language")
        .write.mode("overwrite").partitionBy("language").parquet(path)
    )


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """(repo, path, content) written by ``write_files``; the stored language is kept for pruning."""
    return spark.read.schema("repo string, path string, content string, language string").parquet(path)


def control_files(files: DataFrame) -> DataFrame:
    """The partition with git and ignore files."""
    return files.filter(F.col("language") == CONTROL).select("repo", "path", "content")
