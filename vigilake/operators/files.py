"""Files: classification, size guard, ignore rules, change subsets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigilake.functions import paths, text
from vigilake.functions.bitmaps import bitmap, in_bitmap
from vigilake.model import broadcast_if_small, is_small
from vigilake.session import materialize

IGNORE_FILE = ".scanignore"
CONTROL = "control"


def classify(files: DataFrame) -> DataFrame:
    """Adds ``name`` and ``language``; reads the path only.

    A stored ``language`` is kept: filters on it then prune partitions.
    """
    name = paths.basename(F.col("path"))
    added = {"name": name}
    if "language" not in files.columns:
        added["language"] = paths.language(name)
    return files.withColumns(added)


def readable(files: DataFrame, max_chars: int | None = None) -> DataFrame:
    """All files, or those up to a cap (characters, after decoding) where one is asked for."""
    return files if max_chars is None else files.filter(F.length("content") <= max_chars)


def not_scanned(files: DataFrame, max_chars: int | None = None) -> DataFrame:
    """(repo, path, reason) of files that a scan with the same cap leaves out, or that have no content."""
    reason = F.when(F.col("content").isNull(), F.lit("not readable"))
    if max_chars is not None:
        reason = reason.when(F.length("content") > max_chars, F.lit(f"longer than {max_chars} characters"))
    return files.select("repo", "path", reason.alias("reason")).filter("reason is not null")


def decode(files: DataFrame, max_chars: int | None = None) -> DataFrame:
    """``content`` from a binary column ``raw``: decoded, newlines normalised, capped only on request."""
    return readable(files.withColumn("content", text.decode_utf8(F.col("raw"))).drop("raw"), max_chars)


def ignore_globs(files: DataFrame, ignore_file: str = IGNORE_FILE) -> DataFrame:
    """(repo, glob) from the ignore file at the root of each repository.

    Of a table stored by ``sources.tables`` only the partition of control files is read.
    """
    if "language" in files.columns:
        files = files.filter(F.col("language") == CONTROL)
    return (
        files.filter(F.col("path") == ignore_file)
        .select("repo", F.explode(text.lines_of("content")).alias("glob"))
        .select("repo", text.strip(F.col("glob")).alias("glob"))
        .filter((F.col("glob") != "") & ~F.startswith("glob", F.lit("#")))
    )


def globs_match(globs: list[str], path: Column, name: Column) -> Column:
    """The path or the file name matches one of the literal globs."""
    regex = F.lit("|".join(f"(?:{text.glob_regex(g)})" for g in globs))
    return F.rlike(path, regex) | F.rlike(name, regex)


def ignore_filter(files: DataFrame, ignores: DataFrame | None = None, extra: list[str] | None = None) -> DataFrame:
    """Files that the ignore rules let through.

    ``ignores`` holds (repo, glob) rows.  The globs of a repository (the lines of one ignore
    file) become one regex, and files meet it in an equi-join on ``repo`` with at most one row
    per repository: no theta join, no fan-out.
    """
    path, name = F.col("path"), paths.basename(F.col("path"))
    kept = files.filter(paths.default_keep(path, name))
    if extra:
        kept = kept.filter(~globs_match(extra, path, name))
    if ignores is None:
        return kept
    return drop_ignored(kept, ignore_regexes(ignores))


def ignore_regexes(ignores: DataFrame) -> DataFrame:
    """(repo, _ignored): one regex per repository, stored: its size is measured, and every pass of a scan reads it."""
    one = F.concat(F.lit("(?:"), text.glob_regex_column(F.col("glob")), F.lit(")"))
    regexes = ignores.select("repo", one.alias("regex")).groupBy("repo").agg(
        F.array_join(F.sort_array(F.collect_set("regex")), "|").alias("_ignored"))
    return materialize(regexes)


def drop_ignored(rows: DataFrame, regexes: DataFrame) -> DataFrame:
    """Rows (repo, path, ...) whose path and file name match no regex of their repository."""
    path, name = F.col("path"), paths.basename(F.col("path"))
    joined = rows.join(broadcast_if_small(regexes), "repo", "left")
    hit = F.rlike(path, F.col("_ignored")) | F.rlike(name, F.col("_ignored"))
    return joined.filter(F.col("_ignored").isNull() | ~hit).drop("_ignored")


def single_file(files: DataFrame, repo: str, path: str) -> DataFrame:
    """One named file; ignore rules do not apply to it."""
    return files.filter((F.col("repo") == repo) & (F.col("path") == path))


def changed_files(files: DataFrame, changed: DataFrame) -> DataFrame:
    """Files named in ``changed`` (repo, path): a semi-join, broadcast only when measured small.

    A longer list is met behind a bitmap of fixed size, so that few other files' text moves.
    """
    wanted = changed.select("repo", "path").distinct()
    if not is_small(wanted):
        wanted = wanted.withColumn("_key", F.xxhash64("repo", "path"))
        files = files.filter(in_bitmap(bitmap(wanted, "_key"), F.xxhash64("repo", "path")))
        return files.join(wanted.drop("_key"), ["repo", "path"], "left_semi")
    return files.join(F.broadcast(wanted), ["repo", "path"], "left_semi")


def numbered_lines(files: DataFrame) -> DataFrame:
    """One row per line with its 1-based number; no shuffle."""
    return files.select(
        *[c for c in files.columns if c != "content"], F.posexplode(text.lines_of(F.col("content"))).alias("pos", "text")
    ).withColumn("line", F.col("pos") + 1).drop("pos")
