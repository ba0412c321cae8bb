"""User rules: validation, catalogue, compilation to line rules."""

from __future__ import annotations

import re
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vigilake import fixed_values as fv
from vigilake.functions.anchors import required_literals
from vigilake.functions.text import executed_forms, unsupported

FIRST_CUSTOM_ORD = 1000
RULE_DOC = "id string, severity string, languages array<string>, message string, pattern string, fix string"


FORMS = 4


@F.pandas_udf(T.StructType([T.StructField(f, T.StringType()) for f in ("reason", *(f"form{i}" for i in range(FORMS)))]))
def _dialect(pattern: pd.Series) -> pd.DataFrame:
    """Why a pattern is refused before the engine sees it, or the forms in which the engine runs it."""

    def check(p):
        nothing = [None] * FORMS
        if p is None:
            return None, *nothing
        try:
            re.compile(p)
        except (re.error, OverflowError, RecursionError):
            return "invalid regex", *nothing
        missing = unsupported(p)
        if missing:
            return f"not supported by the scan engine: {missing}", *nothing
        return None, *(executed_forms(p) + nothing)[:FORMS]

    return pd.DataFrame([check(p) for p in pattern], columns=["reason", *[f"form{i}" for i in range(FORMS)]], dtype=object)


def _refused() -> Column:
    """The engine does not compile one of the forms; it is asked where the row is, not on the driver."""
    out = F.lit(False)
    for i in range(FORMS):
        form = F.col(f"_dialect.form{i}")
        compiled = F.try_reflect(F.lit("java.util.regex.Pattern"), F.lit("compile"), form)
        out = out | (form.isNotNull() & compiled.isNull())
    return out


def validate(docs: DataFrame) -> DataFrame:
    """Adds ``valid`` and ``reason``; normalises severity, languages and fix.

    ``docs`` has the fields of a rule document, null where a field is absent.  A rule is valid if its fields are there, its
    pattern compiles in Python and every form of it that a scan runs compiles in the JVM.
    """
    lowered = F.lower("severity")
    missing = F.array_compact(F.array(*[
        F.when(F.col(c).isNull(), F.lit(c)) for c in ("id", "severity", "pattern", "message")]))
    checked = docs.withColumn("_dialect", _dialect("pattern")).withColumn("_refused", _refused())
    reason = (
        F.when(F.size(missing) > 0, F.concat(F.lit("missing fields: "), F.array_join(missing, ", ")))
        .when(~lowered.isin(list(fv.SEVERITY_RANK)), F.concat(F.lit("invalid severity: "), lowered))
        .when(F.col("_dialect.reason").isNotNull(), F.col("_dialect.reason"))
        .when(F.col("_refused"), F.lit("not supported by the scan engine: the pattern does not compile"))
    )
    if "unreadable" in docs.columns:
        reason = F.coalesce("unreadable", reason)
    return checked.withColumns({
        "reason": reason,
        "valid": reason.isNull(),
        "severity": lowered,
        "languages": F.coalesce("languages", F.array(F.lit("*"))),
        "fix": F.coalesce("fix", F.lit("")),
    }).drop("_dialect", "_refused", "unreadable")


def refused_rules(checked: DataFrame) -> DataFrame:
    """(repo, source, id, reason) of the rules and pack files that no scan runs, of ``validate``'s rows."""
    return checked.filter("not valid").select("repo", "source", "id", "reason")


def validation_counts(checked: DataFrame) -> DataFrame:
    return checked.groupBy("valid").agg(F.count(F.lit(1)).alias("n"))


def parse_docs(packs: DataFrame) -> DataFrame:
    """Rule documents from (source, ord, doc) rows, ``doc`` holding one JSON rule or a list of them.

    Rows of ``sources.rule_packs`` also say why a file or document could not be read; ``validate`` goes on with it.
    """
    is_list = F.rlike("doc", F.lit(r"^\s*\["))
    one = F.array(F.from_json("doc", RULE_DOC))
    many = F.from_json("doc", f"array<struct<{RULE_DOC.replace(' array', ':array').replace(' string', ':string')}>>")
    place = [c for c in ("repo", "source", "ord") if c in packs.columns]
    parsed = "reason" in packs.columns
    rules = F.when(is_list, many).otherwise(one)
    if parsed:
        place, packs = [*place, "unreadable"], packs.withColumnRenamed("reason", "unreadable")
        # what could not be parsed stays as a row without fields
        rules = F.when(F.col("unreadable").isNotNull(), F.array(F.from_json(F.lit("{}"), RULE_DOC))).otherwise(rules)
    return packs.select(*place, F.posexplode(rules).alias("pos", "rule")).select(*place, "pos", "rule.*")


def compile_rules(rows: Iterable, family: str = "custom") -> list[fv.LineRule]:
    """Line rules from valid rule rows, in order."""
    out = []
    for i, r in enumerate(rows):
        out.append(fv.LineRule(
            FIRST_CUSTOM_ORD + i, r["id"], family, r["severity"].lower(), tuple(r["languages"] or ("*",)),
            fv.ALL_COMMENTS, r["pattern"], r["message"], r["fix"] or "", required_literals(r["pattern"])))
    return out


def load_rules(docs: DataFrame, rejected: list | None = None) -> list[fv.LineRule]:
    """Valid rules as line rules; they become literals of the plan, in as many passes as they need.

    ``rejected`` gets (id, reason) of every rule that is left out.
    """
    checked = validate(docs)
    order = [c for c in ("source", "ord", "pos", "id") if c in checked.columns]
    rows, kept = checked.orderBy(*order).collect(), []
    for r in rows:
        if r["valid"]:
            kept.append(r)
        elif rejected is not None:
            rejected.append((r["id"], r["reason"]))
    return compile_rules(kept)


def catalog(spark: SparkSession, custom: list[fv.LineRule] = ()) -> DataFrame:
    """Built-in checks by name, then custom rules in load order."""
    built_in = [(0, i, n, s, list(langs)) for i, (n, s, langs, _) in enumerate(sorted(fv.CHECKS))]
    extra = [(1, i, r.rule_id, r.severity, list(r.languages)) for i, r in enumerate(custom)]
    return spark.createDataFrame(
        built_in + extra, "is_custom int, ord int, name string, severity string, languages array<string>")
