"""Path helpers and file classification, on path columns only (no file content is read)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from vigilake import fixed_values as fv
from vigilake.functions.text import glob_regex


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def suffix(name: Column) -> Column:
    """Text from the last dot on; empty for a leading dot only or a trailing dot."""
    inner_dot = F.call_function("locate", F.lit("."), name, F.lit(2)) > 0
    return F.when(
        inner_dot & ~F.endswith(name, F.lit(".")), F.concat(F.lit("."), F.substring_index(name, ".", -1))
    ).otherwise(F.lit(""))


def is_env_name(name: Column) -> Column:
    return F.startswith(F.lower(name), F.lit(".env"))


def language(name: Column) -> Column:
    known = F.create_map(*[F.lit(x) for kv in fv.LANGUAGE_BY_SUFFIX.items() for x in kv])
    return F.when(is_env_name(name), F.lit("dotenv")).otherwise(
        F.coalesce(F.element_at(known, F.lower(suffix(name))), F.lit("unknown"))
    )


def in_skipped_dir(path: Column) -> Column:
    """A parent directory of the path is on the skip list."""
    parts = F.split(path, "/")
    named = F.array(*[F.lit(d) for d in fv.SKIPPED_DIRS if _is_plain(d)])
    globs = "|".join(_one_part(d) for d in fv.SKIPPED_DIRS if not _is_plain(d))
    return F.arrays_overlap(F.slice(parts, 1, F.size(parts) - 1), named) | F.rlike(path, F.lit(f"(?s)(?:^|/)(?:{globs})/"))


def _is_plain(glob: str) -> bool:
    return not any(ch in glob for ch in "*?[")


def matches_any_glob(name: Column, globs: list[str]) -> Column:
    """The name matches one of the globs; plain names and ``*tail`` need no regex."""
    names = [g for g in globs if _is_plain(g)]
    tails = [g[1:] for g in globs if g.startswith("*") and _is_plain(g[1:])]
    last = [t for t in tails if t.startswith(".") and "." not in t[1:]]
    other = [g for g in globs if g not in names and g[1:] not in tails]
    tests = [name.isin(names)] if names else []
    if last:
        tests.append(F.contains(name, F.lit(".")) & F.concat(F.lit("."), F.substring_index(name, ".", -1)).isin(last))
    tests += [F.endswith(name, F.lit(t)) for t in tails if t not in last]
    if other:
        tests.append(F.rlike(name, F.lit("|".join(f"(?:{glob_regex(g)})" for g in other))))
    return reduce(Column.__or__, tests)


def is_skipped_name(name: Column) -> Column:
    return matches_any_glob(name, fv.SKIPPED_FILES)


def is_scannable_name(name: Column) -> Column:
    return F.lower(suffix(name)).isin(fv.SCANNED_SUFFIXES) | is_env_name(name)


def default_keep(path: Column, name: Column) -> Column:
    """The built-in ignore rules: directories, file globs and suffixes."""
    return is_scannable_name(name) & ~is_skipped_name(name) & ~in_skipped_dir(path)


def _one_part(glob: str) -> str:
    body = glob_regex(glob)[len("(?s)^(?:"):-len(r")\z")]
    return body.replace(".*", "[^/]*")
