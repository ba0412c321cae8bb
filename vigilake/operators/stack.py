"""Stack profile of a repository: frameworks, relevant checks, suggested ignore rules."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigilake import fixed_values as fv
from vigilake.functions.text import sql_string

NODE_MANIFEST, PYTHON_MANIFESTS = "package.json", ["pyproject.toml", "requirements.txt"]


def _signals() -> list[tuple[str, str, str]]:
    """(SQL condition, framework, category) in detection order."""
    out = [(f"path = {sql_string(p)}", fw, cat) for p, fw, cat in fv.STACK_FILES]
    node = f"path = '{NODE_MANIFEST}'"
    out.append((node, *fv.STACK_NODE))
    out += [(f"{node} and array_contains({section}, {sql_string(dep)})", fw, cat)
            for section, dep, fw, cat in fv.STACK_NODE_DEPS]
    for m in PYTHON_MANIFESTS:
        out.append((f"path = '{m}'", *fv.STACK_PYTHON))
        out += [(f"path = '{m}' and contains(lowered, {sql_string(dep)})", fw, cat) for dep, fw, cat in fv.STACK_PYTHON_DEPS]
    return out


def detect_stack(files: DataFrame) -> DataFrame:
    """(repo, ord, framework, category): each framework once, at its first signal.

    Only files at a handful of root paths are read (an IN filter on the path).
    """
    signals = _signals()
    paths = sorted({p for p, _, _ in fv.STACK_FILES} | {NODE_MANIFEST, *PYTHON_MANIFESTS})
    cases = [f"case when {c} then named_struct('ord', {i}, 'framework', {sql_string(fw)}, 'category', {sql_string(cat)}) end"
             for i, (c, fw, cat) in enumerate(signals)]
    manifest = F.when(F.col("path") == NODE_MANIFEST, F.from_json("content", "dependencies string, devDependencies string"))
    read = files.filter(F.col("path").isin(paths)).withColumn("manifest", manifest).select(
        "repo", "path", F.lower("content").alias("lowered"),
        *[F.json_object_keys(f"manifest.{s}").alias(s) for s in ("dependencies", "devDependencies")])
    hits = read.select(
        "repo", F.expr(f"inline(array_compact(array({', '.join(cases)})))"))
    return hits.groupBy("repo", "framework").agg(F.min("ord").alias("ord"), F.min_by("category", "ord").alias("category"))


def stack_by_category(stack: DataFrame) -> DataFrame:
    """Frameworks of each category in detection order (a repository has at most a few dozen)."""
    return stack.groupBy("repo", "category").agg(
        F.min("ord").alias("first_ord"),
        F.array_join(F.sort_array(F.collect_list(F.struct("ord", "framework")))["framework"], ", ").alias("frameworks"))


def recommended_checks(stack: DataFrame) -> DataFrame:
    """(repo, ord, text): checks that matter for the detected frameworks."""
    cases = [
        f"case when framework in ({', '.join(map(sql_string, fws))}) then named_struct('ord', {i}, 'text', {sql_string(t)}) end"
        for i, (t, fws) in enumerate(fv.STACK_CHECKS)]
    return stack.select("repo", F.expr(f"inline(array_compact(array({', '.join(cases)})))")).distinct()


def suggested_ignores(repos: DataFrame, stack: DataFrame) -> DataFrame:
    """(repo, ord, text): lines of an ignore file, the base list and then framework lists."""
    base = repos.select("repo").distinct().select(
        "repo", F.posexplode(F.array(*[F.lit(x) for x in fv.BASE_IGNORES])).alias("ord", "text"))
    rows, at = [], len(fv.BASE_IGNORES)
    for fw, lines in fv.FRAMEWORK_IGNORES:
        rows += [f"case when framework = {sql_string(fw)} then named_struct('ord', {at + i}, 'text', {sql_string(x)}) end"
                 for i, x in enumerate(lines)]
        at += len(lines)
    extra = stack.select("repo", F.expr(f"inline(array_compact(array({', '.join(rows)})))"))
    return base.unionByName(extra)
