"""Checks that parse a file, as table functions that SQL calls by name.

A check is a plain function over one file; registered, it is called with LATERAL from any query, and ``findings`` gives its rows the
columns of a scan.  ``analyze`` looks at the call when it is planned, so a wrong number or type of arguments fails before anything runs.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import udtf
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from vigilake import fixed_values as fv
from vigilake.functions import paths, severity
from vigilake.model import FINDING_COLUMNS

RESULT = T.StructType([
    T.StructField("line", T.IntegerType()), T.StructField("column", T.IntegerType()), T.StructField("message", T.StringType()),
    T.StructField("snippet", T.StringType())])


def register_check(spark: SparkSession, name: str, check: Callable[[str, str, str], Iterable[tuple]]) -> None:
    """``name(path, language, content)`` in SQL; ``check`` yields (line, column, message, snippet).

    A file on which the check itself fails gives no rows; the scan goes on.
    """
    if not re.fullmatch(r"[A-Za-z_]\w*", name):
        raise ValueError(f"not a function name: {name}")

    @udtf
    class Check:
        @staticmethod
        def analyze(path: AnalyzeArgument, language: AnalyzeArgument, content: AnalyzeArgument) -> AnalyzeResult:
            for arg in (path, language, content):
                if not isinstance(arg.dataType, (T.StringType, T.NullType)):
                    raise ValueError(f"{name} takes strings, not {arg.dataType.simpleString()}")
            return AnalyzeResult(RESULT)

        def eval(self, path: str, language: str, content: str):
            if content is None:
                return
            try:
                found = list(check(path, language, content))
            except (SyntaxError, ValueError, RecursionError):  # what parsers raise on text that is none of theirs
                return
            yield from found

    spark.udtf.register(name, Check)


def findings(files: DataFrame, name: str, level: str, rule_ord: int, fix: str = "", languages: Iterable[str] = ("*",)) -> DataFrame:
    """Findings of a registered check over classified files (repo, path, name, language, content)."""
    languages = list(languages)
    if level not in fv.SEVERITY_RANK:
        raise ValueError(f"invalid severity: {level}")
    spoken = files if "*" in languages else files.filter(F.col("language").isin(languages))
    found = files.sparkSession.sql(
        f"select f.repo, f.path, c.* from {{files}} f, lateral {name}(f.path, f.language, f.content) c", files=spoken)
    return found.withColumns({
        "name": paths.basename(F.col("path")), "check_name": F.lit(name), "severity": F.lit(level),
        "rank": severity.rank(F.lit(level)), "fix_hint": F.lit(fix), "rule_ord": F.lit(rule_ord)}).select(*FINDING_COLUMNS)
