"""Line rules compiled into one pass over the files.

The rule table is turned into literal column expressions when the plan is built, so every
pattern is compiled once per task and the work stays in the JVM:

    files -> gates -> prefilter file -> split into lines -> prefilter line -> rules -> findings

The prefilters look for literals that every match must contain; the exact rules then run on
the few surviving lines only.  Rules decided by the whole file ride on line 1.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vigilake import fixed_values as fv
from vigilake.functions import env_values, severity, text
from vigilake.functions.anchors import anchor_pattern
from vigilake.operators.file_gates import with_gates

TEST_FILE_GLOBS = ["*.test.*", "*.spec.*", "*.setup.*", "conftest.py"]
SECRET_PLACEHOLDER = (
    r"(?i)['\"](?:\[[^\]]*\]|<[^>]*>|\{\{[^}]*\}\}|\$\{[^}]*\}|__\w*__|your[_-][^'\"]*)['\"]"
)
RULES_PER_PREFILTER = 200


def builtin_line_rules() -> list[fv.LineRule]:
    secrets = [
        r._replace(unless=fv.ENV_PLACEHOLDER_URL) if r.rule_id == "database-url"
        else r._replace(unless=SECRET_PLACEHOLDER) if r.rule_id.startswith("generic-")
        else r
        for r in fv.SECRET_RULES
    ]
    return [*secrets, *fv.INJECTION_JS_RULES, fv.EXPRESS_RULE, *fv.CONFIG_RULES, *fv.FRAMEWORK_LINE_RULES]


def rule_dimension(spark: SparkSession, rules: Iterable) -> DataFrame:
    """One row per rule; its size is the number of rules in the plan, so it may be broadcast."""
    rows = [(r.ord, r.rule_id, r.family, r.severity, r.message, r.fix) for r in rules]
    return spark.createDataFrame(
        pd.DataFrame(rows, columns=["rule_ord", "check_name", "family", "base_severity", "template", "fix_hint"]),
        "rule_ord int, check_name string, family string, base_severity string, template string, fix_hint string")


def comment_test(column: str, marks: Sequence[str]) -> str:
    """SQL: the stripped line starts with one of the comment marks."""
    return "(" + " or ".join(f"startswith({column}, {text.sql_string(m)})" for m in marks) + ")"


def _speaks(languages: Sequence[str]) -> str:
    return "true" if "*" in languages else f"language in ({', '.join(map(text.sql_string, languages))})"


# Commas at depth 1 before the parenthesis opened by the match is closed
_COMMAS = """aggregate(split({rest}, ''), named_struct('depth', 1, 'commas', 0), (a, ch) -> named_struct(
    'depth', a.depth + case when a.depth > 0 and ch = '(' then 1 when a.depth > 0 and ch = ')' then -1 else 0 end,
    'commas', a.commas + if(a.depth = 1 and ch = ',', 1, 0))).commas"""


def rule_condition(rule: fv.LineRule) -> str:
    """SQL over language, gates, text and stripped: the rule holds on the line."""
    terms = [_speaks(rule.languages)]
    if rule.gate:
        terms.append(f"gates.{rule.gate}")
    if rule.comments:
        terms.append("not " + comment_test("stripped", rule.comments))
    terms.append(text.sql_matches("text", rule.linear or rule.pattern))
    if rule.also:
        terms.append(text.sql_matches("text", rule.also))
    if rule.unless:
        terms.append("not " + text.sql_matches("text", rule.unless))
    if rule.rule_id == fv.EXPRESS_RULE.rule_id:
        terms.append(_COMMAS.format(rest=text.sql_after_match("text", rule.pattern)) + " = 0")
    return " and ".join(terms)


def _column(rule: fv.LineRule) -> str:
    if rule.column_at == "zero":
        return "0"
    if rule.column_at != "match":
        return f"instr(text, {text.sql_string(rule.column_at)}) - 1"
    return text.sql_match_offset("text", rule.pattern)


def _hit(condition: str, rule_ord: int, column: str = "0", arg: str = "cast(null as string)") -> str:
    return f"case when {condition} then named_struct('rule_ord', {rule_ord}, 'column', {column}, 'arg', {arg}) end"


def _env_hits(rules: Sequence[fv.FileRule]) -> list[str]:
    marks = text.sql_any_of("lower(name)", fv.ENV_EXAMPLE_MARKS)
    return [
        _hit(f"env_key is not null and {'' if r.rule_id == 'env-example-real-secret' else 'not '}{marks}", r.ord, "0", "env_key")
        for r in rules
    ]


def _env_key() -> Column:
    """The key of an environment line that assigns a real-looking secret, else null."""
    stripped = text.strip(F.col("text"))
    key = env_values.env_key(stripped)
    value = env_values.clean_value(env_values.env_raw_value(stripped))
    secret = (
        (F.col("language") == "dotenv")
        & F.contains(stripped, F.lit("="))
        & ~F.startswith(stripped, F.lit("#"))
        & (F.length(value) >= env_values.MIN_VALUE_CHARS)
        & env_values.is_secret_key(key)
        & ~env_values.is_placeholder(value)
    )
    return F.when(secret, key)


def with_rule_attributes(hits: DataFrame, rules: Iterable) -> DataFrame:
    """Findings from hits (repo, path, name, line, column, rule_ord, arg, snippet).

    ``arg`` fills the placeholder of the message; findings of secrets in test files are demoted.
    """
    joined = hits.join(F.broadcast(rule_dimension(hits.sparkSession, rules)), "rule_ord")
    is_test = F.rlike("name", F.lit("|".join(text.glob_regex(g) for g in TEST_FILE_GLOBS)))
    return joined.withColumn(
        "severity", F.when((F.col("family") == "secrets") & is_test, F.lit("low")).otherwise(F.col("base_severity"))
    ).select(
        "repo", "path", "name", "check_name", "severity", severity.rank(F.col("severity")).alias("rank"),
        F.col("line").cast("int").alias("line"), F.col("column").cast("int").alias("column"),
        F.when(F.col("arg").isNull() | (F.col("arg") == ""), F.col("template")).otherwise(
            F.concat(
                F.substring_index("template", "{", 1), F.col("arg"), F.substring_index("template", "}", -1))
        ).alias("message"),
        "snippet", "fix_hint", "rule_ord")


def _anchor_test(column: str, rules: Sequence[fv.LineRule], whole_file: bool) -> str:
    """SQL: a superset of the lines (or files) on which one of the rules can match."""
    terms = []
    plain = sorted({a for r in rules if not r.gate for a in r.anchors})
    for at in range(0, len(plain), RULES_PER_PREFILTER):
        terms.append(f"rlike({column}, {text.sql_string(anchor_pattern(plain[at:at + RULES_PER_PREFILTER]))})")
    for gate in sorted({r.gate for r in rules if r.gate}):
        words = sorted({a for r in rules if r.gate == gate for a in r.anchors})
        look = "true" if whole_file else f"rlike({column}, {text.sql_string(anchor_pattern(words))})"
        terms.append(f"(gates.{gate} and {look})")
    free = [r for r in rules if not r.anchors]
    if free and whole_file:
        return "true"
    joined = [text.java_pattern(r.pattern, named=False) for r in free if not text.has_back_reference(r.pattern)]
    for at in range(0, len(joined), RULES_PER_PREFILTER):
        union = "|".join(f"(?:{p})" for p in joined[at:at + RULES_PER_PREFILTER])
        terms.append(f"rlike({column}, {text.sql_string(union)})")
    terms += [text.sql_matches(column, r.pattern) for r in free if text.has_back_reference(r.pattern)]
    return " or ".join(terms) or "false"


def text_findings(
    files: DataFrame, line_rules: Sequence[fv.LineRule], file_rules: Sequence[str] = (),
    env_rules: Sequence[fv.FileRule] = (), max_chars: int | None = None,
) -> DataFrame:
    """Findings of line, file and environment rules over classified files, in one pass.

    ``files`` needs repo, path, name, language and content.  Nothing is shuffled.
    """
    if not (line_rules or file_rules or env_rules):
        raise ValueError("no rules selected")
    gated = with_gates(files, {r.gate for r in line_rules if r.gate}, list(file_rules))
    env = "language = 'dotenv'" if env_rules else "false"
    file_hit = "coalesce(size(file_hits) > 0, false)" if file_rules else "false"
    live = (
        f"{'true' if max_chars is None else f'length(content) <= {max_chars}'} and ({file_hit} or ({env} and contains(content, '=')) "
        f"or {_anchor_test('content', line_rules, True)})")
    # The test sits inside the generator: as a filter it would be pushed through whatever
    # computes the content (decoding, a join) and would repeat that work for every literal.
    lines = gated.select(
        "repo", "path", "name", "language", "gates", "file_hits",
        F.posexplode(F.when(F.expr(live), text.lines_of(F.col("content")))).alias("pos", "text"))
    hits = line_hits(lines, line_rules, file_rules, env_rules)
    rules = [*line_rules, *(fv.FILE_RULES[r] for r in file_rules), *env_rules]
    return with_rule_attributes(hits, rules)


def line_hits(
    lines: DataFrame, line_rules: Sequence[fv.LineRule], file_rules: Sequence[str], env_rules: Sequence[fv.FileRule], carry: Sequence[str] = (),
) -> DataFrame:
    """Hits (repo, path, name, line, rule_ord, column, arg, snippet and ``carry``) of lines (repo, path, name, language, gates, file_hits, pos, text)."""
    env = "language = 'dotenv'" if env_rules else "false"
    file_hit = "coalesce(size(file_hits) > 0, false)" if file_rules else "false"
    survivors = lines.filter(
        f"({file_hit} and pos = 0) or ({env} and contains(text, '=')) or {_anchor_test('text', line_rules, False)}"
    ).withColumns({
        "stripped": text.lstrip(F.col("text")),
        "env_key": _env_key() if env_rules else F.lit(None).cast("string"),
    })
    hits = [_hit(rule_condition(r), r.ord, _column(r)) for r in line_rules]
    hits += [
        _hit(f"pos = 0 and array_contains(file_hits, {fv.FILE_RULES[r].ord})", fv.FILE_RULES[r].ord, "0", "''")
        for r in file_rules]
    hits += _env_hits(env_rules)
    found = survivors.select(
        "repo", "path", "name", "text", (F.col("pos") + 1).alias("line"), *carry,
        F.expr(f"inline(array_compact(array({', '.join(hits)})))"))
    cut = text.rstrip(F.col("text"))
    snippet = (
        F.when(F.col("arg") == "", F.lit(""))
        .when(F.col("arg").isNotNull(), F.concat("arg", F.lit("=****")))
        .otherwise(cut))
    return found.withColumn("snippet", snippet).drop("text")
