"""Python files: facts extracted once per file, rules as relational filters over the facts."""

from __future__ import annotations

import ast
import functools
import unicodedata
import warnings
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vigilake import fixed_values as fv
from vigilake.functions.text import any_of
from vigilake.operators.line_rules import with_rule_attributes

_STRINGS = T.ArrayType(T.StringType())
FACT = T.StructType([
    T.StructField("kind", T.StringType()),
    T.StructField("line", T.IntegerType()),
    T.StructField("col", T.IntegerType()),
    T.StructField("text", T.StringType()),
    T.StructField("name", T.StringType()),
    T.StructField("is_bare", T.BooleanType()),
    T.StructField("receiver", T.StringType()),
    T.StructField("arg0_kind", T.StringType()),
    T.StructField("arg0_op", T.StringType()),
    T.StructField("shell_true", T.IntegerType()),
    T.StructField("decorators", _STRINGS),
    T.StructField("param_names", _STRINGS),
    T.StructField("annotation_names", _STRINGS),
    T.StructField("default_calls", _STRINGS),
    T.StructField("has_dependencies", T.BooleanType()),
])
FACTS = T.StructType([T.StructField("facts", T.ArrayType(FACT)), T.StructField("imports", _STRINGS)])
CALLEES = ["eval", "exec", "system", "execute", *fv.SHELL_CALLS]


@functools.cache
def compatibility_letters() -> str:
    """Java class of the characters that the Python parser folds to ASCII letters inside identifiers."""
    ranges: list[list[int]] = []
    for c in range(0x80, 0x110000):
        if any(ch.isascii() and ch.isalpha() for ch in unicodedata.normalize("NFKC", chr(c))) and not 0xD800 <= c <= 0xDFFF:
            if ranges and ranges[-1][1] == c - 1:
                ranges[-1][1] = c
            else:
                ranges.append([c, c])
    return "[" + "".join(f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in ranges) + "]"


def _called(func: ast.expr) -> str | None:
    if isinstance(func, ast.Name):
        return func.id
    return func.attr if isinstance(func, ast.Attribute) else None


def _call_fact(node: ast.Call) -> dict | None:
    name = _called(node.func)
    if name not in CALLEES:
        return None
    owner = getattr(node.func, "value", None)
    first = node.args[0] if node.args else None
    return {
        "kind": "call",
        "name": name,
        "is_bare": isinstance(node.func, ast.Name),
        "receiver": owner.id if isinstance(owner, ast.Name) else None,
        "arg0_kind": type(first).__name__ if first is not None else None,
        "arg0_op": type(first.op).__name__ if isinstance(first, ast.BinOp) else None,
        "shell_true": sum(
            k.arg == "shell" and isinstance(k.value, ast.Constant) and k.value.value is True
            for k in node.keywords),
    }


def _route_fact(node: ast.FunctionDef | ast.AsyncFunctionDef) -> dict | None:
    calls = [d for d in node.decorator_list if isinstance(d, ast.Call)]
    targets = [d.func if isinstance(d, ast.Call) else d for d in node.decorator_list]
    names = [t.attr for t in targets if isinstance(t, ast.Attribute)]
    if not names:
        return None
    args = node.args
    params = [*args.posonlyargs, *args.args, *args.kwonlyargs]
    inside = [n for p in params if p.annotation is not None for n in ast.walk(p.annotation)]
    return {
        "kind": "route",
        "name": node.name,
        "decorators": names,
        "param_names": [p.arg for p in params],
        "annotation_names": [
            n.id if isinstance(n, ast.Name) else n.attr for n in inside if isinstance(n, (ast.Name, ast.Attribute))],
        "default_calls": [
            c for d in args.defaults if isinstance(d, ast.Call) and (c := _called(d.func)) is not None],
        "has_dependencies": any(k.arg == "dependencies" for c in calls for k in c.keywords),
    }


def file_facts(source: str) -> tuple[list[dict], list[str]]:
    """Calls, decorated functions and imported names of one file; none if it does not parse."""
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            nodes = list(ast.walk(ast.parse(source)))
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return [], []
    lines, facts, imports = source.split("\n"), [], []
    for node in nodes:
        fact = None
        if isinstance(node, ast.Call):
            fact = _call_fact(node)
        elif isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)):
            fact = _route_fact(node)
        elif isinstance(node, (ast.Import, ast.ImportFrom)):
            imports += [a.name for a in node.names]
        if fact:
            in_file = node.lineno <= len(lines)
            fact.update(line=node.lineno, col=node.col_offset, text=lines[node.lineno - 1].rstrip() if in_file else "")
            facts.append(fact)
    return facts, imports


@F.pandas_udf(FACTS)
def _extract(content: pd.Series) -> pd.DataFrame:
    rows = [file_facts(c) if c is not None else ([], []) for c in content]
    return pd.DataFrame({
        "facts": [[{k: f.get(k) for k in FACT.names} for f in facts] for facts, _ in rows],
        "imports": [imports for _, imports in rows],
    })


# Not marked deterministic: a filter on the facts must not be pushed below and parse files twice.
extract_facts = _extract.asNondeterministic()


def worth_parsing(content: Column) -> Column:
    """Files that can yield a finding: decided in the JVM before any text goes to Python."""
    calls = any_of(content, ["eval", "exec", "system", "shell"])
    routes = F.contains(content, F.lit("@")) & any_of(content, fv.AUTH_INDICATORS)
    return calls | routes | F.rlike(content, F.lit(compatibility_letters()))


def python_facts(files: DataFrame, every_file: bool = False, max_chars: int | None = None) -> DataFrame:
    """(repo, path, name, facts, imports) of the Python files among classified files.

    Files that cannot yield a finding reach the Python worker as null.
    """
    content = F.col("content")
    wanted = content.isNotNull() if max_chars is None else F.length(content) <= max_chars
    if not every_file:
        wanted = wanted & worth_parsing(content)
    python = files.filter(F.col("language") == "python")
    return python.select(
        "repo", "path", "name", extract_facts(F.when(wanted, content)).alias("_f")
    ).select("repo", "path", "name", "_f.facts", "_f.imports")


def py_calls(facts: DataFrame) -> DataFrame:
    one = facts.select("repo", "path", F.explode("facts").alias("f")).filter("f.kind = 'call'")
    return one.select(
        "repo", "path", "f.line", "f.col", F.col("f.name").alias("callee"), "f.is_bare", "f.receiver",
        "f.arg0_kind", "f.arg0_op", F.col("f.shell_true").alias("shell_true_kw"))


def py_routes(facts: DataFrame) -> DataFrame:
    one = facts.select("repo", "path", F.explode("facts").alias("f")).filter("f.kind = 'route'")
    return one.select(
        "repo", "path", "f.line", "f.col", F.col("f.name").alias("func"), "f.decorators", "f.param_names",
        "f.annotation_names", "f.default_calls", F.col("f.has_dependencies").alias("has_dependencies_kw"))


def py_imports(facts: DataFrame) -> DataFrame:
    return facts.select("repo", "path", F.explode("imports").alias("name"))


def _list(words: Sequence[str]) -> str:
    return ", ".join(f"'{w}'" for w in words)


_INDICATORS = f"array({_list(fv.AUTH_INDICATORS)})"
_PUBLIC = "^(?:" + "|".join(fv.PUBLIC_ROUTE_STEMS) + ")(?:_|$)"

# SQL over one fact ``f`` and the file-level flag ``auth_import``
FACT_CONDITIONS = {
    "eval-usage": "f.kind = 'call' and f.is_bare and f.name = 'eval'",
    "exec-usage": "f.kind = 'call' and f.is_bare and f.name = 'exec'",
    "os-system": "f.kind = 'call' and not f.is_bare and f.name = 'system' and f.receiver = 'os'",
    "subprocess-shell":
        f"f.kind = 'call' and not f.is_bare and f.name in ({_list(fv.SHELL_CALLS)}) and f.shell_true > 0",
    "sql-fstring": "f.kind = 'call' and not f.is_bare and f.name = 'execute' and f.arg0_kind = 'JoinedStr'",
    "sql-string-concat":
        "f.kind = 'call' and not f.is_bare and f.name = 'execute' and f.arg0_kind = 'BinOp' "
        "and f.arg0_op in ('Add', 'Mod')",
    "route-no-auth": f"""f.kind = 'route' and auth_import
        and arrays_overlap(f.decorators, array({_list(fv.ROUTE_DECORATORS)}))
        and not rlike(lower(f.name), '{_PUBLIC}')
        and not arrays_overlap(f.param_names, {_INDICATORS})
        and not arrays_overlap(f.annotation_names, {_INDICATORS})
        and not arrays_overlap(f.default_calls, {_INDICATORS})
        and not f.has_dependencies""",
}


def fact_findings(facts: DataFrame, rule_ids: Sequence[str]) -> DataFrame:
    """Findings of the Python rules; facts are exploded and filtered in place, no shuffle."""
    one = facts.select(
        "repo", "path", "name", F.expr(f"arrays_overlap(imports, {_INDICATORS})").alias("auth_import"),
        F.explode("facts").alias("f"))
    hits = []
    for rule_id in rule_ids:
        arg = "f.name" if rule_id == "route-no-auth" else "cast(null as string)"
        times = "f.shell_true" if rule_id == "subprocess-shell" else "1"
        hits.append(
            f"case when {FACT_CONDITIONS[rule_id]} then array_repeat(named_struct("
            f"'rule_ord', {fv.FACT_RULES[rule_id].ord}, 'arg', {arg}), {times}) end")
    found = one.select(
        "repo", "path", "name", "f.line", F.col("f.col").alias("column"), F.col("f.text").alias("snippet"),
        F.expr(f"inline(flatten(array_compact(array({', '.join(hits)}))))"))
    return with_rule_attributes(found, [fv.FACT_RULES[r] for r in rule_ids])
