"""Exports: JSON and SARIF documents per repository, and fix prompts.

A repository can hold any share of all findings, so its document is never built in one group.
It is a set of rows (repo, section, ord, path, line, rule_ord, column, text) whose texts, in the order
of these columns, are the document.  Every finding is one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigilake import __version__, fixed_values as fv
from vigilake.functions import severity
from vigilake.model import broadcast_if_small

DOCUMENT_ORDER = ["section", "ord", "path", "line", "rule_ord", "column"]


def finding_json(reviewed: bool = False) -> Column:
    """One finding as a JSON object; ``ai`` only where there is a verdict, with its nulls kept."""
    base = [
        F.col("check_name").alias("check"), F.col("severity"), F.col("path").alias("file"), F.col("line"),
        F.col("column"), F.col("message"), F.col("snippet"), F.col("fix_hint").alias("fix")]
    plain = F.to_json(F.struct(*base))
    if not reviewed:
        return plain
    full = F.to_json(F.struct(*base, F.struct(
        "ai.verdict", "ai.confidence", "ai.explanation", "ai.fix", "ai.severity").alias("ai")), {"ignoreNullFields": "false"})
    return F.when(F.col("ai.verdict").isNotNull(), full).otherwise(plain)


def sarif_result() -> Column:
    region = F.struct(F.col("line").alias("startLine"), F.greatest(F.lit(1), F.col("column")).alias("startColumn"))
    place = F.struct(F.struct(F.struct(F.col("path").alias("uri")).alias("artifactLocation"), region.alias("region"))
                     .alias("physicalLocation"))
    return F.to_json(F.struct(
        F.col("check_name").alias("ruleId"), severity.sarif_level(F.col("severity")).alias("level"),
        F.struct(F.col("message").alias("text")).alias("message"), F.array(place).alias("locations")))


def _items(findings: DataFrame, item: Column, section: int) -> DataFrame:
    """Findings as rows with a leading comma; only the first row of a repository has none.

    Findings at the very same place share a row.
    """
    place = ["ord", "path", "line", "rule_ord", "column"]
    rows = findings.select("repo", (-F.col("rank")).alias("ord"), *place[1:], item.alias("item"))
    rows = rows.groupBy("repo", *place).agg(F.listagg("item", F.lit(",")).alias("text"))
    first = findings.groupBy("repo").agg(F.min(F.struct((-F.col("rank")).alias("ord"), *place[1:])).alias("first"))
    joined = rows.join(broadcast_if_small(first), "repo")
    return joined.select(
        "repo", F.lit(section).alias("section"), *place,
        F.when(F.struct(*place) == F.col("first"), F.col("text")).otherwise(F.concat(F.lit(","), F.col("text"))).alias("text"))


def _section(repos: DataFrame, section: int, body: Column) -> DataFrame:
    nothing = {c: F.lit(0).alias(c) for c in ("line", "rule_ord", "column")}
    return repos.select(
        "repo", F.lit(section).alias("section"), F.lit(0).alias("ord"), F.lit("").alias("path"), *nothing.values(), body.alias("text"))


def json_document(findings: DataFrame, summary: DataFrame, reviewed: DataFrame | None = None) -> DataFrame:
    """Rows of ``{"findings": [...], "summary": {...}[, "ai": {...}]}`` per repository.

    ``summary`` is ``severity_summary``, ``reviewed`` the ``verdict_stats`` of a reviewed scan.
    """
    totals = F.to_json(F.struct("files_scanned", "critical", "high", "medium", "low", "total"))
    tail = F.concat(F.lit('],"summary":'), totals)
    repos = summary
    if reviewed is not None:
        repos = summary.join(reviewed, "repo", "left").na.fill(0, ["confirmed", "false_positives", "needs_review"])
        stats = F.to_json(F.struct("confirmed", "false_positives", "needs_review"))
        tail = F.concat(tail, F.lit(',"ai":'), stats)
    items = _items(findings, finding_json(reviewed is not None), 1)
    return (
        _section(summary, 0, F.lit('{"findings":['))
        .unionByName(items)
        .unionByName(_section(repos, 2, F.concat(tail, F.lit("}"))))
    )


def sarif_rules(findings: DataFrame) -> DataFrame:
    """Per repository and rule: what its first finding in result order says, and that position."""
    at = F.struct((-F.col("rank")).alias("r"), "path", "line", "rule_ord", "column")
    return findings.groupBy("repo", "check_name").agg(
        F.min(at).alias("first"), F.min_by(F.struct("message", "fix_hint", "severity"), at).alias("seen"))


def sarif_rule_json() -> Column:
    text = lambda c: F.struct(c.alias("text"))
    props = F.struct(severity.sarif_score(F.col("seen.severity")).alias("security-severity"))
    shared = [F.col("check_name").alias("id"), text(F.col("seen.message")).alias("shortDescription"), props.alias("properties")]
    return F.when(F.col("seen.fix_hint") != "", F.to_json(F.struct(*shared, text(F.col("seen.fix_hint")).alias("help")))).otherwise(
        F.to_json(F.struct(*shared)))


def sarif_document(findings: DataFrame, repos: DataFrame, tool: str = "vigilake") -> DataFrame:
    """Rows of a SARIF 2.1.0 log per repository.

    The rules of a repository are at most as many as the scan has, so they form one row.
    """
    head = (f'{{"$schema":"{fv.SARIF_SCHEMA}","version":"{fv.SARIF_VERSION}","runs":[{{"tool":{{"driver":{{'
            f'"name":"{tool}","version":"{__version__}","rules":[')
    rules = sarif_rules(findings).groupBy("repo").agg(
        F.array_join(F.sort_array(F.collect_list(F.struct("first", sarif_rule_json().alias("json"))))["json"], ",").alias("text"))
    repos = repos.select("repo").distinct()
    return (
        _section(repos, 0, F.lit(head))
        .unionByName(_section(rules, 1, F.col("text")))
        .unionByName(_section(repos, 2, F.lit(']}},"results":[')))
        .unionByName(_items(findings, sarif_result(), 3))
        .unionByName(_section(repos, 4, F.lit("]}]}")))
    )


def write_documents(document: DataFrame, path: str) -> None:
    """Text files per repository; in file-name order their lines are the document."""
    (
        document.repartitionByRange("repo", *DOCUMENT_ORDER)
        .sortWithinPartitions("repo", *DOCUMENT_ORDER)
        .select("repo", "text")
        .write.mode("overwrite").partitionBy("repo").text(path)
    )


def fix_prompt() -> Column:
    """A prompt that asks for a fix; snippet and hint sections only where there is one."""
    has_code, has_hint = F.col("snippet") != "", F.col("fix_hint") != ""
    head = F.replace(F.replace(F.lit(fv.FIX_PROMPT_HEAD), F.lit("{line}"), F.col("line").cast("string")), F.lit("{path}"), F.col("path"))
    code = F.concat(F.lit("\n\n**Vulnerable code:**\n```\n"), F.col("snippet"), F.lit("\n```"))
    hint = F.concat(F.lit("\n\n**Suggested approach:** "), F.col("fix_hint"))
    return F.concat(
        head, F.lit("\n\n**Issue:** "), F.col("message"), F.when(has_code, code).otherwise(""),
        F.when(has_hint, hint).otherwise(""), F.lit("\n\n" + fv.FIX_PROMPT_TAIL))


def fix_prompts(findings: DataFrame) -> DataFrame:
    return findings.select("repo", "path", "line", "column", "rule_ord", "check_name", fix_prompt().alias("prompt"))
