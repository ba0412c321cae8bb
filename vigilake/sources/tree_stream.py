"""A directory tree as a stream of file changes.

An offset is a listing of the tree (path and modification time); a batch is what differs between two listings.  Offsets are stored by the
query's checkpoint, so a restarted watcher reports what has changed meanwhile, and nothing twice.
"""

from __future__ import annotations

import os
from dataclasses import dataclass
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from vigilake import fixed_values as fv
from vigilake.functions import text

SCHEMA = "repo string, path string, kind string, mtime timestamp, event_id long, raw binary"
FILES_PER_TASK = 500


@dataclass
class Changed(InputPartition):
    files: list


def listing(root: str) -> dict[str, int]:
    """Modification times (ns) of the watched files below a folder."""
    out = {}
    for folder, dirs, names in os.walk(root):
        dirs[:] = [d for d in dirs if d not in fv.SKIPPED_DIRS]
        for n in names:
            if os.path.splitext(n)[1] in fv.WATCHED_SUFFIXES:
                full = os.path.join(folder, n)
                try:
                    out[os.path.relpath(full, root).replace(os.sep, "/")] = os.stat(full).st_mtime_ns
                except OSError:  # gone meanwhile
                    continue
    return out


def differences(before: dict[str, int], after: dict[str, int]) -> list[tuple[str, str, int]]:
    """(path, kind, time) of what was added, modified or deleted."""
    out = [(p, "modified" if p in before else "added", t) for p, t in after.items() if before.get(p) != t]
    return sorted(out + [(p, "deleted", t) for p, t in before.items() if p not in after])


class _Reader(DataSourceStreamReader):
    def __init__(self, options):
        self.root = options["path"]
        self.repo = options.get("repo") or os.path.basename(os.path.abspath(self.root))
        #: whether the files that are there at the start count as added
        self.whole = options.get("startWithAll", "false").lower() == "true"

    def initialOffset(self) -> dict:
        return {"files": {} if self.whole else listing(self.root)}

    def latestOffset(self) -> dict:
        return {"files": listing(self.root)}

    def partitions(self, start: dict, end: dict) -> list[Changed]:
        found = differences(start["files"], end["files"])
        return [Changed(found[i:i + FILES_PER_TASK]) for i in range(0, len(found), FILES_PER_TASK)] or [Changed([])]

    def read(self, partition: Changed):
        for path, kind, ns in partition.files:
            raw = None
            if kind != "deleted":
                try:
                    with open(os.path.join(self.root, path), "rb") as f:
                        raw = f.read()
                except OSError:  # gone again: the next listing says so
                    continue
            yield (self.repo, path, kind, datetime.fromtimestamp(ns / 1e9, timezone.utc), ns, raw)


class TreeChanges(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tree_changes"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> _Reader:
        return _Reader(self.options)


def tree_changes(spark: SparkSession, root: str, repo: str | None = None, start_with_all: bool = False) -> DataFrame:
    """The stream (repo, path, kind, mtime, event_id, content) of changes below a folder that all executors share.

    ``event_id`` is the file's modification time in nanoseconds; deleted files have no content.
    """
    spark.dataSource.register(TreeChanges)
    reader = spark.readStream.format("tree_changes").option("startWithAll", str(start_with_all).lower())
    if repo is not None:
        reader = reader.option("repo", repo)
    rows = reader.load(root)
    return rows.withColumn("content", text.decode_utf8(F.col("raw"))).drop("raw")
