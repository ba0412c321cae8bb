"""Review loop: prompts out, verdicts in."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigilake import fixed_values as fv
from vigilake.functions import severity
from vigilake.functions.bitmaps import bitmap, in_bitmap
from vigilake.operators.results import finding_index

VERDICT = "index int, verdict string, confidence int, explanation string, severity string, fix string"


def random_nonce() -> Column:
    """16 hexadecimal digits that a file cannot know."""
    return F.substring(F.replace(F.uuid(), F.lit("-"), F.lit("")), 1, 16)


def _parts(max_chars: int, columns: list[str]):
    """Splits each file once, in time linear in its length, and puts every finding into the part in which its line begins."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                repo, path, nonce, content = (batch.column(c)[i].as_py() for c in range(4))
                items = batch.column(4)[i].as_py()
                parts = max(1, -(-len(content) // max_chars))
                own: list[list[str]] = [[] for _ in range(parts)]
                line, begin = 1, 0
                # the lines in which findings begin, in order
                for at, item in sorted(((x["line"], n) for n, x in enumerate(items))):
                    while line < at and (end := content.find("\n", begin)) >= 0:
                        line, begin = line + 1, end + 1
                    beyond = line < at
                    own[parts - 1 if beyond else min(begin // max_chars, parts - 1)].append(item)
                rows = [(repo, path, nonce, p, parts, len(own[p]), content[p * max_chars:(p + 1) * max_chars],
                         "\n".join(items[n]["item"] for n in sorted(own[p]))) for p in range(parts)]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], columns)

    kinds = [pa.string(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.string(), pa.string()]
    return run


def _item() -> Column:
    first = F.concat(
        F.lit("\n"), F.col("idx").cast("string"), F.lit(". ["), F.upper("severity"), F.lit("] Line "),
        F.col("line").cast("string"), F.lit(": "), F.col("check_name"))
    code = F.when(F.col("snippet") != "", F.concat(F.lit("   Code: "), F.col("snippet")))
    hint = F.when(F.col("fix_hint") != "", F.concat(F.lit("   Scanner suggestion: "), F.col("fix_hint")))
    return F.array_join(
        F.array_compact(F.array(first, F.concat(F.lit("   Message: "), F.col("message")), code, hint)), "\n")


def review_batches(
    findings: DataFrame, files: DataFrame, nonce: Column | None = None, max_chars: int = fv.REVIEW_MAX_CHARS,
) -> DataFrame:
    """Prompts (repo, path, part, parts, n_findings, prompt): fenced, untrusted content and numbered findings.

    A file of more than ``max_chars`` characters makes several prompts, which together hold all its text; a
    finding goes with the part in which its line begins.  Only files with findings (and the few that a bitmap of
    their keys lets through) take part in the join.  ``nonce`` may be an expression over repo, path and content; it
    is replaced where the file happens to contain it.
    """
    items = finding_index(findings).groupBy("repo", "path").agg(
        F.sort_array(F.collect_list(F.struct("idx", "line", _item().alias("item")))).alias("items"))
    keys = findings.select(F.xxhash64("repo", "path").alias("key"))
    chosen = random_nonce() if nonce is None else nonce
    sent = files.filter(in_bitmap(bitmap(keys, "key"), F.xxhash64("repo", "path"))).select(
        "repo", "path", "content", chosen.alias("n0")).withColumn(
        "nonce", F.when(F.contains("content", F.col("n0")), F.substring(F.md5(F.concat("n0", "content")), 1, 16))
        .otherwise(F.col("n0"))).drop("n0")
    joined = items.join(sent, ["repo", "path"], "left").withColumn(
        "content", F.coalesce("content", F.lit("(file not readable)")))
    columns = ["repo", "path", "nonce", "part", "parts", "n_findings", "body", "own"]
    each = joined.select("repo", "path", "nonce", "content", "items").mapInArrow(
        _parts(max_chars, columns), "repo string, path string, nonce string, part int, parts int, n_findings long, body string, own string")
    mark = lambda form: F.replace(F.lit(form), F.lit("{nonce}"), F.col("nonce"))
    note = F.replace(F.replace(F.lit(fv.REVIEW_NOTE), F.lit("{open}"), mark(fv.REVIEW_OPEN)), F.lit("{close}"), mark(fv.REVIEW_CLOSE))
    head = F.concat(
        F.lit("FINDINGS ("), F.col("n_findings").cast("string"), F.lit(" issues flagged by static scanner):"))
    which = F.when(F.col("parts") > 1, F.concat(
        F.lit(" (part "), (F.col("part") + 1).cast("string"), F.lit(" of "), F.col("parts").cast("string"), F.lit(")"))).otherwise("")
    prompt = F.concat_ws(
        "\n", F.concat(F.lit("FILE: "), F.col("path"), which), note, mark(fv.REVIEW_OPEN), F.col("body"),
        mark(fv.REVIEW_CLOSE), F.lit(""), head, F.col("own"))
    return each.select("repo", "path", "part", "parts", "n_findings", prompt.alias("prompt"))


def parse_verdicts(responses: DataFrame) -> DataFrame:
    """(repo, path, idx, ai) from one JSON response per file; the last entry of an index wins.

    Malformed responses yield no rows.  An absent verdict means ``needs_review``, a null one
    stays null.
    """
    raw = responses.select(
        "repo", "path",
        F.posexplode(F.from_json("response", "findings array<string>")["findings"]).alias("pos", "entry"))
    one = raw.select("repo", "path", "pos", F.from_json("entry", VERDICT).alias("v"),
                     F.array_contains(F.json_object_keys("entry"), "verdict").alias("has_verdict"))
    ai = F.struct(
        F.when(F.col("has_verdict"), F.col("v.verdict")).otherwise(F.lit("needs_review")).alias("verdict"),
        F.col("v.confidence").alias("confidence"), F.col("v.explanation").alias("explanation"),
        F.col("v.fix").alias("fix"), F.col("v.severity").alias("severity"))
    return (
        one.filter("v.index is not null")
        .groupBy("repo", "path", F.col("v.index").alias("idx"))
        .agg(F.max_by(ai, "pos").alias("ai"))
    )


def join_verdicts(findings: DataFrame, responses: DataFrame) -> DataFrame:
    """Findings with ``ai``; a severity counts only if it is valid and differs."""
    joined = finding_index(findings).join(parse_verdicts(responses), ["repo", "path", "idx"], "left")
    adjusted = F.when(severity.is_severity(F.col("ai.severity")) & (F.col("ai.severity") != F.col("severity")), F.col("ai.severity"))
    return joined.withColumn("ai", F.when(F.col("ai").isNotNull(), F.struct(
        "ai.verdict", "ai.confidence", "ai.explanation", "ai.fix", adjusted.alias("severity"))))


def effective_severity(reviewed: DataFrame) -> DataFrame:
    return reviewed.withColumn("effective_severity", severity.effective(F.col("severity"), F.col("ai.severity")))


def is_false_positive(reviewed: DataFrame) -> DataFrame:
    return reviewed.withColumn(
        "is_false_positive", F.coalesce(F.col("ai.verdict") == "false_positive", F.lit(False)))


def verdict_stats(reviewed: DataFrame) -> DataFrame:
    """Per repository: confirmed, false positives, and all the rest as needing review."""
    count = lambda v: F.count(F.when(F.col("ai.verdict") == v, 1))
    return reviewed.groupBy("repo").agg(
        count("confirmed").alias("confirmed"), count("false_positive").alias("false_positives"),
        (F.count(F.lit(1)) - count("confirmed") - count("false_positive")).alias("needs_review"))
