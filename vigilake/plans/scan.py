"""The scan: files in, findings out, as one lazy plan.

Two passes over the file text (JVM rules; Python facts for the files that need them) and a
path-only lookup for environment files.  No stage shuffles file contents.
"""

from __future__ import annotations

from collections.abc import Collection, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigilake import fixed_values as fv
from vigilake.model import FINDING_COLUMNS, FINDINGS, is_small, result_order
from vigilake.operators import files as file_ops
from vigilake.operators.git import env_gitignore_findings
from vigilake.operators.line_rules import builtin_line_rules, text_findings
from vigilake.operators.python_facts import fact_findings, python_facts
from vigilake.sources.tables import CONTROL


#: rules compiled into one pass over the text; more of them make more passes
RULES_PER_PASS = 1_000


def prepare(
    files: DataFrame, *, ignores: DataFrame | None = None, extra_ignores: list[str] | None = None,
    ignore_rules: bool = True,
) -> DataFrame:
    """Scannable files with name and language; decided by paths alone."""
    kept = file_ops.ignore_filter(files, ignores, extra_ignores) if ignore_rules else files
    return file_ops.classify(kept)


def rule_ids() -> list[str]:
    return [
        *(r.rule_id for r in builtin_line_rules()), *fv.FACT_RULES, *fv.FILE_RULES,
        fv.ENV_NOT_GITIGNORED.rule_id, fv.ENV_NO_GITIGNORE.rule_id, fv.ENV_SECRET.rule_id, fv.ENV_EXAMPLE_SECRET.rule_id,
    ]


def scan(
    files: DataFrame, *, min_severity: str = "info", custom_rules: Sequence[fv.LineRule] = (),
    only: Collection[str] | None = None, ignores: DataFrame | None = None, extra_ignores: list[str] | None = None,
    ignore_rules: bool = True, git_roots: DataFrame | None = None, git_lookup: bool = True,
    max_chars: int | None = None,
) -> DataFrame:
    """Findings of all rules at or above ``min_severity``.

    Lazy but for ``ignores``: the regexes of the repositories are stored and measured while the plan is built.
    Where they are too many to broadcast, files are scanned first and ignored findings dropped, so that no
    text meets them in an exchange.

    ``files`` holds (repo, path, content).  Rules whose severity is fixed below the threshold
    are left out of the plan; severities that depend on data are filtered afterwards.
    ``only`` restricts the scan to some rule ids.
    """
    floor = fv.SEVERITY_RANK[min_severity]

    def wanted(rule) -> bool:
        return fv.SEVERITY_RANK[rule.severity] >= floor and (only is None or rule.rule_id in only)

    regexes = file_ops.ignore_regexes(ignores) if ignores is not None and ignore_rules else None
    early = regexes is not None and is_small(regexes)
    ready = prepare(files, extra_ignores=extra_ignores, ignore_rules=ignore_rules)
    if early:
        ready = file_ops.drop_ignored(ready, regexes)
    line_rules = [r for r in [*builtin_line_rules(), *custom_rules] if wanted(r)]
    file_rules = [k for k, r in fv.FILE_RULES.items() if wanted(r)]
    env_rules = [r for r in (fv.ENV_SECRET, fv.ENV_EXAMPLE_SECRET) if wanted(r)]
    fact_rules = [k for k, r in fv.FACT_RULES.items() if wanted(r)]
    git_rules = [r.rule_id for r in (fv.ENV_NOT_GITIGNORED, fv.ENV_NO_GITIGNORE) if wanted(r)]
    parts = []
    if line_rules or file_rules or env_rules:
        parts.append(text_findings(ready, line_rules[:RULES_PER_PASS], file_rules, env_rules, max_chars))
    for at in range(RULES_PER_PASS, len(line_rules), RULES_PER_PASS):
        parts.append(text_findings(ready, line_rules[at:at + RULES_PER_PASS], max_chars=max_chars))
    if fact_rules:
        parts.append(fact_findings(python_facts(ready, max_chars=max_chars), fact_rules))
    if git_rules and git_lookup:
        envs = file_ops.readable(ready.filter(F.col("name") == ".env"), max_chars)
        control = files.filter(F.col("language") == CONTROL) if "language" in files.columns else files
        found = env_gitignore_findings(control, git_roots, envs)
        parts.append(found.filter(F.col("check_name").isin(git_rules)))
    if not parts:
        return files.sparkSession.createDataFrame([], FINDINGS)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    out = out.filter(F.col("rank") >= floor).select(*FINDING_COLUMNS)
    return out if regexes is None or early else file_ops.drop_ignored(out, regexes).select(*FINDING_COLUMNS)


def sort_findings(findings: DataFrame) -> DataFrame:
    """Total result order: rank, path, line, then registration order and column."""
    return findings.orderBy(*result_order())
