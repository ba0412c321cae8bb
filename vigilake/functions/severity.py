"""Severity helpers.  Severities are ordered by rank, never by name."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from vigilake import fixed_values as fv


def lookup(c: Column, table: dict, default) -> Column:
    out = None
    for k, v in table.items():
        out = F.when(c == k, F.lit(v)) if out is None else out.when(c == k, F.lit(v))
    return out.otherwise(default if isinstance(default, Column) else F.lit(default))


def rank(severity: Column) -> Column:
    return lookup(severity, fv.SEVERITY_RANK, F.lit(None).cast("int"))


def is_severity(c: Column) -> Column:
    return F.coalesce(c.isin(list(fv.SEVERITY_RANK)), F.lit(False))


def effective(severity: Column, ai_severity: Column) -> Column:
    """The reviewer's severity when it names one, else the scanner's."""
    return F.when(is_severity(ai_severity), ai_severity).otherwise(severity)


def sarif_level(severity: Column) -> Column:
    return lookup(severity, fv.SARIF_LEVEL, "warning")


def sarif_score(severity: Column) -> Column:
    return lookup(severity, fv.SARIF_SCORE, "5.0")


def editor_level(severity: Column) -> Column:
    return lookup(severity, fv.EDITOR_LEVEL, "warning")
