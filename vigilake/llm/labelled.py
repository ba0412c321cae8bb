"""Labelled rows for the classifiers: a bounded sample by hash order, with a held-out share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigilake.llm.common import keep


def fold(id_col: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo the number of folds; null for a null id."""
    return F.crc32(id_col.cast("string").cast("binary")) % folds


def held_out(id_col: Column, folds: int, fold_out: int) -> Column:
    return F.coalesce(fold(id_col, folds) == fold_out, F.lit(False))


def training_rows(
    docs: DataFrame, labels: DataFrame, label: str, folds: int, fold_out: int, most: int,
    id_col: str = "doc_id", text_col: str = "text", label_id_col: str = "doc_id",
) -> DataFrame:
    """(id, text, y) of at most ``most`` labelled documents outside the held-out fold, stored.

    Labels of one id are merged by the larger one, and of several texts of one id the one with the smallest hash is taken.
    Rows are chosen by the hash of their id, so reruns agree; the chosen ids are at most ``most`` and are broadcast,
    other texts stay where they are read.
    """
    known = labels.select(F.col(label_id_col).alias("_id"), F.col(label).cast("int").alias("_y")).dropna()
    known = known.filter(~held_out(F.col("_id"), folds, fold_out)).groupBy("_id").agg(F.max("_y").alias("_y"))
    present = known.join(docs.select(F.col(id_col).alias("_id")).distinct(), "_id", "left_semi")
    chosen = present.orderBy(F.xxhash64("_id"), "_id").limit(most)
    rows = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).join(F.broadcast(chosen), "_id")
    # combined before the shuffle: a task sends one text of an id
    one = rows.groupBy("_id").agg(F.min_by("text", F.xxhash64("text")).alias("text"), F.first("_y").alias("_y"))
    return keep(one.select(F.col("_id").alias("id"), "text", F.col("_y").alias("y")))
