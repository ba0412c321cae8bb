"""Ancestor lookups: which git root holds an environment file, and does it ignore it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigilake import fixed_values as fv
from vigilake.functions import paths
from vigilake.operators.line_rules import with_rule_attributes


def git_roots(files: DataFrame) -> DataFrame:
    """(repo, dir) of directories that hold ``.git``; needs paths only."""
    parts = F.split("path", "/")
    hits = F.filter(F.sequence(F.lit(1), F.size(parts)), lambda i: F.element_at(parts, i) == ".git")
    dirs = F.transform(hits, lambda i: F.array_join(F.slice(parts, 1, i - 1), "/"))
    return (
        files.filter(F.rlike("path", F.lit(r"(?:^|/)\.git(?:/|$)")))
        .select("repo", F.explode(dirs).alias("dir"))
        .distinct()
    )


def env_files(files: DataFrame) -> DataFrame:
    """Files named exactly ``.env`` that the default ignore rules let through."""
    name = paths.basename(F.col("path"))
    return files.select("repo", "path", name.alias("name")).filter(
        (F.col("name") == ".env") & ~paths.in_skipped_dir(F.col("path")))


def nearest_git_root(envs: DataFrame, roots: DataFrame, max_levels: int | None = None) -> DataFrame:
    """(repo, path, dir): nearest ancestor with ``.git``, at any depth unless ``max_levels`` says otherwise.

    Each file yields a row for each of its ancestors, which meet the roots in an equi-join.
    """
    parts = F.split("path", "/")
    above = F.size(parts) - 1
    depth = F.sequence(F.lit(0), above if max_levels is None else F.least(F.lit(max_levels - 1), above))
    climbed = envs.select("repo", "path", F.posexplode(
        F.transform(depth, lambda k: F.array_join(F.slice(parts, 1, above - k), "/"))).alias("depth", "dir"))
    return (
        climbed.join(roots.select("repo", "dir"), ["repo", "dir"])
        .groupBy("repo", "path").agg(F.min_by("dir", "depth").alias("dir"), F.min("depth").alias("depth"))
    )


def gitignores(files: DataFrame) -> DataFrame:
    """(repo, dir, mentions_env) of every ``.gitignore``."""
    rows = files.filter(paths.basename(F.col("path")) == ".gitignore")
    return rows.select(
        "repo", F.regexp_replace("path", r"(?:^|/)\.gitignore$", "").alias("dir"),
        F.contains("content", F.lit(".env")).alias("mentions_env"))


def env_gitignore_findings(files: DataFrame, roots: DataFrame | None = None, envs: DataFrame | None = None) -> DataFrame:
    """Findings on ``.env`` files whose git root does not ignore them."""
    envs = env_files(files) if envs is None else envs
    nearest = nearest_git_root(envs, git_roots(files) if roots is None else roots)
    joined = nearest.join(gitignores(files), ["repo", "dir"], "left")
    ord_ = F.when(F.col("mentions_env").isNull(), F.lit(fv.ENV_NO_GITIGNORE.ord)).when(
        ~F.col("mentions_env"), F.lit(fv.ENV_NOT_GITIGNORED.ord))
    hits = joined.select(
        "repo", "path", paths.basename(F.col("path")).alias("name"), F.lit(1).alias("line"), F.lit(0).alias("column"),
        ord_.alias("rule_ord"), F.lit(None).cast("string").alias("arg"), F.lit("").alias("snippet"))
    return with_rule_attributes(hits.filter("rule_ord is not null"), [fv.ENV_NOT_GITIGNORED, fv.ENV_NO_GITIGNORE])
