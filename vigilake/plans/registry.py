"""Extension points: user rules and user checks next to the built-in ones."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigilake import fixed_values as fv
from vigilake.functions import paths, severity
from vigilake.model import FINDING_COLUMNS
from vigilake.operators.custom_rules import RULE_DOC, compile_rules, validate
from vigilake.plans.scan import prepare, scan

FIRST_CHECK_ORD = 100_000


def spark_session() -> SparkSession:
    return SparkSession.getActiveSession() or SparkSession.builder.getOrCreate()


class Checks:
    """A set of user rules (one regex each) and user checks (files in, findings out)."""

    def __init__(self) -> None:
        self._rules: list[dict] = []
        self._checks: list[tuple[str, Callable[[DataFrame], DataFrame]]] = []

    def register_rule(self, rule: dict) -> None:
        """``rule``: id, severity, pattern, message and optionally languages and fix.

        A rule that ``custom_rules.validate`` refuses is refused here, with its reason: it would end a scan.
        """
        fields = ("id", "severity", "languages", "message", "pattern", "fix")
        row = spark_session().createDataFrame([tuple(rule.get(f) for f in fields)], RULE_DOC)
        reason = validate(row).first()["reason"]
        if reason:
            raise ValueError(reason)
        self._rules.append({"languages": ["*"], "fix": "", **rule})

    def register_check(self, name: str, fn: Callable[[DataFrame], DataFrame]) -> None:
        """``fn`` gets classified files (repo, path, name, language, content) and returns
        (repo, path, severity, line, column, message, snippet, fix_hint)."""
        self._checks.append((name, fn))

    def rules(self) -> list[fv.LineRule]:
        return compile_rules(self._rules)

    def scan(self, files: DataFrame, *, min_severity: str = "info", **options) -> DataFrame:
        """The built-in scan plus everything registered here."""
        out = scan(files, min_severity=min_severity, custom_rules=self.rules(), **options)
        ready = prepare(files, **{k: options[k] for k in ("ignores", "extra_ignores", "ignore_rules") if k in options})
        for i, (name, fn) in enumerate(self._checks):
            found = fn(ready).withColumns({
                "name": paths.basename(F.col("path")), "check_name": F.lit(name),
                "rank": severity.rank(F.col("severity")), "rule_ord": F.lit(FIRST_CHECK_ORD + i)})
            found = found.withColumns({c: F.col(c).cast("int") for c in ("line", "column", "rank")})
            out = out.unionByName(found.select(*FINDING_COLUMNS).filter(F.col("rank") >= fv.SEVERITY_RANK[min_severity]))
        return out


def with_verdicts(batches: DataFrame, reviewer: Callable, schema: str = "repo string, path string, response string") -> DataFrame:
    """Responses of a user-supplied reviewer over review batches (``mapInPandas``).

    ``reviewer`` gets an iterator of pandas frames (repo, path, n_findings, prompt) and yields
    frames (repo, path, response); retries and rate limits are its own business.
    """
    return batches.mapInPandas(reviewer, schema)


