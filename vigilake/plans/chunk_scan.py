"""Scans of files that are longer than a task: read in splits, cut at line ends, numbered by prefix sums.

Spark's text source splits files at line ends whatever their length.  A chunk is what one split holds of one file.  One
pass counts the lines of each chunk and finds which words that file conditions ask for occur in it; per file they are summed and
or-ed.  A second pass runs the line rules; only hits meet their file's conditions and their chunk's first line number.  No
text is moved.

Lines end at ``\\n``, ``\\r`` or both.  The empty line behind a final line end is not a row, so only a pattern that matches the empty
string can tell the difference to ``plans.scan``.  Python facts need whole files and are left to that scan; so are git lookups and
files whose names begin with a dot or an underscore, which the text source does not list.
"""

from __future__ import annotations

import re
from collections.abc import Collection

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vigilake import fixed_values as fv
from vigilake.model import FINDING_COLUMNS
from vigilake.operators.file_gates import FILE_RULE_CONDITIONS, GATES
from vigilake.operators.line_rules import builtin_line_rules, line_hits, with_rule_attributes
from vigilake.plans.scan import prepare
from vigilake.session import materialize

_JS = "language in ('javascript', 'typescript')"
_JS_JSON = "language in ('javascript', 'typescript', 'json')"
_WORD = re.compile(r"contains\((content|lowered), ('(?:[^'\\]|\\.)*')\)")


def chunk_lines(spark: SparkSession, root: str) -> DataFrame:
    """(path, begin, at, text): the lines of all files below a folder, ``begin`` being the offset of their chunk.

    ``at`` rises within a chunk by one per line.
    """
    lines = spark.read.option("recursiveFileLookup", "true").text(root)
    base = root.rstrip("/") + "/"
    path = F.col("_metadata.file_path")
    # the listing may name the file system where the caller did not
    inside = F.substring_index(path, base.removeprefix("file://").removeprefix("file:"), -1)
    return lines.select(
        F.url_decode(F.replace(inside, F.lit("+"), F.lit("%2B"))).alias("path"), F.col("_metadata.file_block_start").alias("begin"),
        F.monotonically_increasing_id().alias("at"), F.col("value").alias("text"))


def _words(conditions: list[str]) -> dict[str, str]:
    """Name of a flag for each word test of the conditions."""
    found = {m.group(0): None for c in conditions for m in _WORD.finditer(c)}
    return {test: f"w{i}" for i, test in enumerate(found)}


def _by_flags(condition: str, words: dict[str, str]) -> str:
    return _WORD.sub(lambda m: f"flags.{words[m.group(0)]}", condition)


def chunk_table(lines: DataFrame, words: dict[str, str]) -> tuple[DataFrame, DataFrame]:
    """Per chunk (repo, path, begin): the first row and the lines before it; per file: what its conditions ask for."""
    text = lines.withColumn("content", F.when(F.expr(_JS_JSON), F.col("text"))).withColumn("lowered", F.when(F.expr(_JS), F.lower("text")))
    flags = F.struct(F.lit(True).alias("any"), *[F.coalesce(F.bool_or(F.expr(t)), F.lit(False)).alias(n) for t, n in words.items()])
    chunks = materialize(text.groupBy("repo", "path", "name", "language", "begin").agg(
        F.min("at").alias("first"), F.count(F.lit(1)).alias("n"), flags.alias("flags")))
    before = Window.partitionBy("repo", "path").orderBy("begin").rowsBetween(Window.unboundedPreceding, -1)
    numbered = chunks.select("repo", "path", "begin", "first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    whole = F.struct(F.lit(True).alias("any"), *[F.bool_or(f"flags.{n}").alias(n) for n in words.values()])
    return numbered, chunks.groupBy("repo", "path", "name", "language").agg(whole.alias("flags"))


def scan_chunks(
    lines: DataFrame, *, min_severity: str = "info", only: Collection[str] | None = None, custom_rules: Collection[fv.LineRule] = (), **options,
) -> DataFrame:
    """Findings of line, file and environment rules over lines (repo, path, begin, at, text) of ``chunk_lines``."""
    floor = fv.SEVERITY_RANK[min_severity]

    def wanted(rule) -> bool:
        return fv.SEVERITY_RANK[rule.severity] >= floor and (only is None or rule.rule_id in only)

    line_rules = [r for r in [*builtin_line_rules(), *custom_rules] if wanted(r)]
    file_rules = {k: r for k, r in fv.FILE_RULES.items() if wanted(r)}
    env_rules = [r for r in (fv.ENV_SECRET, fv.ENV_EXAMPLE_SECRET) if wanted(r)]
    gates = sorted({r.gate for r in line_rules if r.gate})
    words = _words([*[GATES[g] for g in gates], *[FILE_RULE_CONDITIONS[k] for k in file_rules]])
    ready = prepare(lines, **options)
    chunks, files = chunk_table(ready, words)
    rooted = files.withColumn("rooted", F.concat(F.lit("/"), F.lower("path")))
    spoken = {g: _JS_JSON if g == "firebase_rules" else _JS for g in gates}
    holds = [F.expr(f"{spoken[g]} and {_by_flags(GATES[g], words)}").alias(g) for g in gates]
    facts = rooted.select("repo", "path", F.struct(F.lit(True).alias("open"), *holds).alias("gates"))
    parts = []
    if line_rules or env_rules:
        # gates are open until a hit meets its file
        open_gates = F.expr("named_struct('open', true" + "".join(f", '{g}', true" for g in gates) + ")")
        hits = line_hits(
            ready.withColumns({"gates": open_gates, "file_hits": F.lit(None).cast("array<int>"), "pos": F.lit(0)}),
            line_rules, (), env_rules, carry=("begin", "at"))
        gate_of = {r.ord: r.gate for r in line_rules if r.gate}
        closed = "case rule_ord " + " ".join(f"when {o} then gates.{g}" for o, g in gate_of.items()) + " else true end" if gate_of else "true"
        met = hits.drop("line").join(chunks, ["repo", "path", "begin"]).join(facts, ["repo", "path"]).filter(F.expr(closed))
        parts.append(met.withColumn("line", F.col("before") + F.col("at") - F.col("first") + 1).drop("begin", "at", "first", "before", "gates"))
    for k, r in file_rules.items():
        none: Column = F.lit("")
        found = rooted.filter(F.expr(f"{_JS} and {_by_flags(FILE_RULE_CONDITIONS[k], words)}"))
        parts.append(found.select("repo", "path", "name", F.lit(r.ord).alias("rule_ord"), F.lit(0).alias("column"), none.alias("arg"),
                                  none.alias("snippet"), F.lit(1).cast("long").alias("line")))
    if not parts:
        raise ValueError("no rules selected")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    rules = [*line_rules, *file_rules.values(), *env_rules]
    return with_rule_attributes(out, rules).filter(F.col("rank") >= floor).select(*FINDING_COLUMNS)
