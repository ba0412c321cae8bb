"""Rules that belong to repositories: each one's own rule pack, as rows keyed by repository.

Thousands of rules are met by an index: every rule has literals of which each match contains one.  One pass over the files
finds the literals of all rules at once (an automaton, in blocks of a bounded number of literals), and the few
lines with a literal meet the rules of their repository with that literal in an equi-join.  So the work grows with
those candidates and not with lines times rules, and file text does not cross an exchange.  Rules that have no such literal
run on every line of their repository.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vigilake import fixed_values as fv
from vigilake.functions import severity, text
from vigilake.functions.anchors import required_literals
from vigilake.functions.text import JAVA_FLAGS, has_back_reference, java_body
from vigilake.model import FINDING_COLUMNS, broadcast_if_small
from vigilake.operators.custom_rules import FIRST_CUSTOM_ORD
from vigilake.operators.files import numbered_lines
from vigilake.operators.line_rules import comment_test
from vigilake.plans.scan import prepare
from vigilake.session import materialize
from vigilake.sources.rule_packs import packs_in

__all__ = ["packs_in", "repo_rules", "scan_repo_rules"]

#: literals of one automaton, which is broadcast
LITERALS_PER_BLOCK = 50_000


_COMPILED = T.StructType([
    T.StructField("body", T.StringType()), T.StructField("back", T.BooleanType()), T.StructField("literals", T.ArrayType(T.StringType()))])


@F.pandas_udf(_COMPILED)
def _compiled(patterns: pd.Series) -> pd.DataFrame:
    return pd.DataFrame(
        [(java_body(p), has_back_reference(p), list(required_literals(p))) for p in patterns], columns=["body", "back", "literals"])


def repo_rules(checked: DataFrame) -> DataFrame:
    """A row per valid rule of ``custom_rules.validate``'s rows: repo, rule_ord (in load order), its fields, body and literals."""
    by = Window.partitionBy("repo").orderBy("source", "ord", "pos", "id")
    valid = checked.filter("valid").withColumn("rule", _compiled("pattern"))
    return valid.select(
        "repo", (F.row_number().over(by) - 1 + FIRST_CUSTOM_ORD).alias("rule_ord"), "id", F.col("severity").alias("rule_severity"),
        "languages", F.col("message").alias("rule_message"), "fix", "rule.*")


def _lines_with(files: DataFrame, words: list[str]) -> DataFrame:
    """(repo, path, name, language, line, text, found): lines that contain some of the words, whatever their case."""
    shared = files.sparkSession.sparkContext.broadcast(words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        automaton = ahocorasick.Automaton()
        for w in shared.value:
            automaton.add_word(w, w)
        automaton.make_automaton()
        for batch in batches:
            for i in range(batch.num_rows):
                content = batch.column(4)[i].as_py()
                if not content:
                    continue
                own, lines, lowered = content.split("\n"), {}, content.lower()
                line = at = 0
                for end, word in automaton.iter(lowered):
                    # matches come in the order of their ends
                    line += lowered.count("\n", at, end)
                    at = end
                    lines.setdefault(line, set()).add(word)
                if lines:
                    picked = sorted(lines)
                    same = [batch.column(c).slice(i, 1).take(pa.array([0] * len(picked))) for c in range(4)]
                    yield pa.RecordBatch.from_arrays(
                        [*same, pa.array([n + 1 for n in picked], pa.int64()), pa.array([own[n] for n in picked], pa.string()),
                         pa.array([sorted(lines[n]) for n in picked], pa.list_(pa.string()))],
                        ["repo", "path", "name", "language", "line", "text", "found"])

    return files.select("repo", "path", "name", "language", "content").mapInArrow(
        run, "repo string, path string, name string, language string, line long, text string, found array<string>")


def _matched(candidates: DataFrame) -> DataFrame:
    """Findings of lines that have met a rule (columns of ``repo_rules``)."""
    pattern = F.concat(F.lit(JAVA_FLAGS), F.col("body"))
    speaks = F.array_contains("languages", "*") | F.array_contains(F.col("languages"), F.col("language"))
    found = candidates.withColumn("stripped", text.lstrip(F.col("text"))).filter(
        speaks & ~F.expr(comment_test("stripped", fv.ALL_COMMENTS)) & F.rlike("text", pattern))
    # a group in front would renumber the groups that back-references name
    before: Column = F.length(F.call_function(
        "regexp_extract", F.col("text"), F.concat(F.lit(JAVA_FLAGS + "^(.*?)(?:"), F.col("body"), F.lit(")")), F.lit(1)))
    at_start = F.rlike("text", F.concat(F.lit(JAVA_FLAGS + "^(?:"), F.col("body"), F.lit(")")))
    cut = F.when(at_start, 0).otherwise(F.length(F.element_at(F.split(F.col("text"), pattern, F.lit(2)), 1)))
    return found.select(
        "repo", "path", "name", F.col("id").alias("check_name"), F.col("rule_severity").alias("severity"),
        severity.rank(F.col("rule_severity")).alias("rank"), F.col("line").cast("int").alias("line"),
        F.when(F.col("back"), cut).otherwise(before).alias("column"), F.col("rule_message").alias("message"),
        text.rstrip(F.col("text")).alias("snippet"), F.col("fix").alias("fix_hint"), "rule_ord").select(*FINDING_COLUMNS)


def scan_repo_rules(files: DataFrame, checked: DataFrame, **options) -> DataFrame:
    """Findings of every repository's own rules over its files."""
    ready = prepare(files, **options)
    rules = materialize(repo_rules(checked))
    words = rules.select(F.explode("literals").alias("word")).distinct().count()
    blocks = max(1, -(-words // LITERALS_PER_BLOCK))
    # all literals of a rule are in one block, so no rule is met twice
    rules = rules.withColumn("block", F.pmod(F.xxhash64("literals"), F.lit(blocks)))
    free = rules.filter(F.size("literals") == 0)
    out = None
    for b in range(blocks if words else 0):
        own = rules.filter(F.col("block") == b).withColumn("word", F.explode("literals"))
        lines = _lines_with(ready, [r["word"] for r in own.select("word").distinct().collect()]).withColumn("word", F.explode("found"))
        met = lines.join(broadcast_if_small(own), ["repo", "word"])
        # a rule that several literals lead to counts once
        first = F.element_at(F.array_intersect("literals", "found"), 1) == F.col("word")
        part = _matched(met.filter(first))
        out = part if out is None else out.unionByName(part)
    if out is None or not free.isEmpty():
        names = [c for c in rules.columns if c != "repo"]
        grouped = free.groupBy("repo").agg(F.collect_list(F.struct(*names)).alias("rules"))
        lines = numbered_lines(ready.join(broadcast_if_small(grouped), "repo"))
        part = _matched(lines.withColumn("rule", F.explode("rules")).select("*", "rule.*"))
        out = part if out is None else out.unionByName(part)
    return out
