"""Schemas of the relations the engine reads and writes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FINDINGS = (
    "repo string, path string, name string, check_name string, severity string, rank int, line int, "
    "column int, message string, snippet string, fix_hint string, rule_ord int"
)

FINDING_COLUMNS = [f.split()[0] for f in FINDINGS.split(", ")]


def result_order() -> list[Column]:
    """The scanner's result order; rule_ord and column make it total within a line, repo across repositories."""
    return [F.desc("rank"), F.asc("path"), F.asc("line"), F.asc("rule_ord"), F.asc("column"), F.asc("repo")]


def is_small(df: DataFrame, max_rows: int = 200_000, max_bytes: int = 64 << 20) -> bool:
    """Measured, never guessed: an aggregation on the executors that returns two numbers."""
    text = [F.coalesce(F.octet_length(c), F.lit(0)) for c, t in df.dtypes if t == "string"]
    size = sum(text, F.lit(0).cast("long")) + 16 * len(df.columns)
    rows, size = df.agg(F.count(F.lit(1)), F.coalesce(F.sum(size), F.lit(0))).first()
    return rows <= max_rows and size <= max_bytes


def broadcast_if_small(df: DataFrame, max_rows: int = 200_000, max_bytes: int = 64 << 20) -> DataFrame:
    """Broadcast hint only after measuring the side; otherwise Spark picks the join at run time."""
    return F.broadcast(df) if is_small(df, max_rows, max_bytes) else df
