"""What has changed between two states of a tree: listings compared by path and content digest."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigilake.operators.files import changed_files

#: kinds of changes whose files are worth a scan
SCANNED = ("added", "copied", "modified")


def listing(files: DataFrame) -> DataFrame:
    """(repo, path, digest) of a state; text stays where it is read."""
    return files.select("repo", "path", F.sha2(F.coalesce("content", F.lit("")).cast("binary"), 256).alias("digest"))


def snapshot_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """(repo, path, status, origin) of every path of two listings (repo, path, digest).

    ``status``: unchanged, modified, deleted, renamed (new, with the content of a path that is gone), copied (new, with the content
    of a path that was there before) or added.  ``origin`` is the smallest such path.  Paths of a listing are distinct.
    """
    old, new = before.alias("old"), after.alias("new")
    both = old.join(new, ["repo", "path"], "full_outer").select(
        "repo", "path", F.col("old.digest").alias("was"), F.col("new.digest").alias("now"))
    # one row per content, whatever the number of its files
    sources = both.filter("was is not null").groupBy("repo", F.col("was").alias("now")).agg(
        F.min("path").alias("kept_from"), F.min(F.when(F.col("now").isNull(), F.col("path"))).alias("gone_from"))
    known = both.filter("now is not null and was is null").join(sources, ["repo", "now"], "left").select(
        "repo", "path",
        F.when(F.col("gone_from").isNotNull(), "renamed").when(F.col("kept_from").isNotNull(), "copied").otherwise("added").alias("status"),
        F.coalesce("gone_from", "kept_from").alias("origin"))
    status = F.when(F.col("now").isNull(), "deleted").when(F.col("was") == F.col("now"), "unchanged").otherwise("modified")
    rest = both.filter("was is not null").select("repo", "path", status.alias("status"), F.lit(None).cast("string").alias("origin"))
    return known.unionByName(rest)


def changed_since(before: DataFrame, files: DataFrame, kinds: tuple[str, ...] = SCANNED) -> DataFrame:
    """The files (repo, path, content) that have changed since the state ``before`` (repo, path, digest)."""
    diff = snapshot_diff(before, listing(files)).filter(F.col("status").isin(list(kinds)))
    return changed_files(files, diff)
