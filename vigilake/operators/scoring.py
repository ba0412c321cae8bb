"""Detection scorecard against ground truth keyed by file name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigilake import fixed_values as fv
from vigilake.functions import severity


def label_join(labels: DataFrame, findings: DataFrame, floor: str = fv.NOISE_FLOOR) -> DataFrame:
    """One row per labelled file, with its findings; files without findings stay (top rank -1).

    Findings shrink to one row per file name before the join.
    """
    per_name = findings.groupBy("name").agg(F.max("rank").alias("top"), F.count(F.lit(1)).alias("n"))
    joined = labels.join(per_name, "name", "left").na.fill({"top": -1, "n": 0})
    bad = F.col("kind") == "vulnerable"
    return joined.withColumns({
        "hit": bad & (F.col("top") >= severity.rank(F.col("min_severity"))),
        "false_positive": ~bad & (F.col("top") >= fv.SEVERITY_RANK[floor]),
    })


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def scorecard(judged: DataFrame) -> DataFrame:
    """Recall, false-positive rate, precision and F1 at file level, three decimals."""
    counts = judged.agg(
        F.count(F.when(F.col("kind") == "vulnerable", 1)).alias("n_vulnerable"),
        F.count(F.when(F.col("kind") != "vulnerable", 1)).alias("n_clean"),
        F.count(F.when(F.col("hit"), 1)).alias("detected"),
        F.count(F.when(F.col("false_positive"), 1)).alias("fp_files"))
    tp, fp = F.col("detected"), F.col("fp_files")
    rates = counts.withColumns({
        "r": _ratio(tp, F.col("n_vulnerable")), "fpr": _ratio(fp, F.col("n_clean")), "p": _ratio(tp, tp + fp)})
    f1 = _ratio(2 * F.col("p") * F.col("r"), F.col("p") + F.col("r"))
    return rates.select(
        F.round("r", 3).alias("recall"), F.round("fpr", 3).alias("fp_rate"), F.round("p", 3).alias("precision"),
        F.round(f1, 3).alias("f1"), "detected", "n_vulnerable", "fp_files", "n_clean")


def category_recall(judged: DataFrame) -> DataFrame:
    return judged.filter(F.col("kind") == "vulnerable").groupBy("category").agg(
        F.count(F.when(F.col("hit"), 1)).alias("hits"), F.count(F.lit(1)).alias("total"))


def alarming_findings(labels: DataFrame, findings: DataFrame, floor: str = fv.NOISE_FLOOR) -> DataFrame:
    """Findings at or above the floor on files labelled clean, one row each.

    Many files may share a name, so the list of a name is left as rows.
    """
    clean = labels.filter(F.col("kind") == "clean").select("name", "category")
    loud = findings.filter(F.col("rank") >= fv.SEVERITY_RANK[floor])
    return loud.join(clean, "name").select("name", "category", "repo", "path", "check_name", "severity", "line", "column")
