"""Result algebra: severity filter, summaries, gates, per-file and per-rule counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vigilake import fixed_values as fv
from vigilake.functions import severity
from vigilake.model import result_order

COUNTED = ["critical", "high", "medium", "low"]


def at_least(findings: DataFrame, min_severity: str) -> DataFrame:
    return findings.filter(F.col("rank") >= fv.SEVERITY_RANK[min_severity])


def _count_if(cond: Column) -> Column:
    return F.count(F.when(cond, 1))


def severity_summary(findings: DataFrame, files: DataFrame) -> DataFrame:
    """Per repository: files scanned, counts by severity, total (which includes info).

    Both sides shrink to one row per repository before they meet; clean repositories stay.
    """
    counts = findings.groupBy("repo").agg(
        *[_count_if(F.col("severity") == s).alias(s) for s in COUNTED], F.count(F.lit(1)).alias("total"))
    scanned = files.groupBy("repo").agg(F.count(F.lit(1)).alias("files_scanned"))
    zero = {c: 0 for c in [*COUNTED, "total", "files_scanned"]}
    return scanned.join(counts, "repo", "full_outer").na.fill(zero)


def exit_gate(findings: DataFrame, files: DataFrame) -> DataFrame:
    """1 where a critical or high finding remains by the scanner's own severity; reviews do not count."""
    worst = findings.groupBy("repo").agg(F.max("rank").alias("worst"))
    return files.select("repo").distinct().join(worst, "repo", "left").select(
        "repo", F.when(F.col("worst") >= fv.SEVERITY_RANK["high"], 1).otherwise(0).alias("exit_code"))


def fail_on_gate(summary: DataFrame, fail_on: str) -> DataFrame:
    """Threshold gate over ``severity_summary``; medium and low both fail on any finding."""
    return summary.select("repo", F.lit(fail_on).alias("fail_on"), _should_fail(fail_on).alias("should_fail"))


def _should_fail(fail_on: str) -> Column:
    bad = {
        "critical": F.col("critical") > 0,
        "high": (F.col("critical") > 0) | (F.col("high") > 0),
        "medium": F.col("total") > 0,
        "low": F.col("total") > 0,
        "none": F.lit(False),
    }[fail_on]
    return F.when(bad, 1).otherwise(0)


def fail_on_gates(summary: DataFrame, levels: list[str]) -> DataFrame:
    """The gate at several thresholds, in one pass over the summary."""
    gates = [F.struct(F.lit(x).alias("fail_on"), _should_fail(x).alias("should_fail")) for x in levels]
    return summary.select("repo", F.inline(F.array(*gates)))


def findings_by_file(findings: DataFrame) -> DataFrame:
    """Per file: number of findings, worst rank and its checks in result order (names only, for the findings of one file)."""
    entry = F.struct((-F.col("rank")).alias("r"), "line", "rule_ord", "column", "check_name")
    grouped = findings.groupBy("repo", "path").agg(
        F.count(F.lit(1)).alias("n"), F.max("rank").alias("worst"), F.sort_array(F.collect_list(entry)).alias("e"))
    return grouped.select("repo", "path", "n", "worst", F.array_join("e.check_name", ",").alias("checks"))


def rule_counts(findings: DataFrame) -> DataFrame:
    """Per rule: findings and files with findings; two aggregations instead of a distinct count."""
    per_file = findings.groupBy("check_name", "repo", "path").agg(F.count(F.lit(1)).alias("n"))
    return per_file.groupBy("check_name").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("n_files"))


def finding_index(findings: DataFrame) -> DataFrame:
    """Adds the 0-based position of each finding within its file."""
    w = Window.partitionBy("repo", "path").orderBy(*result_order())
    return findings.withColumn("idx", F.row_number().over(w) - 1)


def top_n_per_file(findings: DataFrame, n: int = fv.WATCH_TOP) -> DataFrame:
    """The first n findings of each file, with the number of findings left out."""
    per_file = Window.partitionBy("repo", "path")
    ranked = findings.withColumns({
        "pos": F.row_number().over(per_file.orderBy(*result_order())),
        "more": F.greatest(F.count(F.lit(1)).over(per_file) - n, F.lit(0)),
    })
    return ranked.filter(F.col("pos") <= n)


def repo_severity_pivot(findings: DataFrame) -> DataFrame:
    """Repository by severity, with a grand total in the row whose repository is null."""
    levels = list(fv.SEVERITY_RANK)
    # cells first (combined map-side), so the pivot and the total see one row per repository and level
    cells = findings.groupBy("repo", "severity").agg(F.count(F.lit(1)).alias("n"))
    wide = [F.coalesce(F.sum(F.when(F.col("severity") == s, F.col("n"))), F.lit(0)).alias(s) for s in levels]
    return cells.rollup("repo").agg(*wide, F.sum("n").alias("total"))


def before_after(before: DataFrame, after: DataFrame) -> DataFrame:
    """Critical and high counts of two scans and the share that went away."""
    both = before.select("rank", F.lit("before").alias("run")).unionByName(after.select("rank", F.lit("after").alias("run")))
    c = lambda run, rank: _count_if((F.col("run") == run) & (F.col("rank") == rank))
    counts = both.agg(
        c("before", 4).alias("critical_before"), c("before", 3).alias("high_before"),
        c("after", 4).alias("critical_after"), c("after", 3).alias("high_after"))
    was, now = F.col("critical_before") + F.col("high_before"), F.col("critical_after") + F.col("high_after")
    return counts.withColumns({"both_before": was, "both_after": now}).withColumn(
        "pct_cut",
        F.when(F.col("both_before") > 0, F.round(
            100 * (F.col("both_before") - F.col("both_after")) / F.col("both_before"), 1)).otherwise(F.lit(0.0)))


def severity_levels(findings: DataFrame) -> DataFrame:
    """Adds SARIF level and score and the editor level of each finding."""
    s = F.col("severity")
    return findings.withColumns({
        "sarif_level": severity.sarif_level(s), "sarif_score": severity.sarif_score(s),
        "editor_level": severity.editor_level(s)})
