"""A Spark data source for source trees on a file system that all executors share.

Spark's own file sources skip names that start with ``.`` or ``_``, which would lose ``.env``
and ``.gitignore``.  ``read_tree`` lists a tree level by level in tasks and reads its files in tasks.  The data
source below does the same for small trees that the driver can list:

    spark.dataSource.register(SourceTree)
    spark.read.format("source_tree").option("repo", "shop").load("/data/shop")

yields (repo, path, raw): paths relative to the root, contents as bytes for
``operators.files.decode``.  ``.git`` directories appear as one empty row each, which is what
the git-root lookup needs; their contents are never read.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from itertools import islice

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from vigilake.operators.files import decode
from vigilake.session import materialize

BYTES_PER_TASK = 64 << 20
FILES_PER_TASK = 10_000
#: what a task holds at once and hands on: entries of directories, bytes of files (one file at least)
ENTRIES_PER_BATCH = 10_000
BYTES_PER_BATCH = 4 << 20
DIRECTORIES_PER_TASK = 1_000


class FileBatch(InputPartition):
    def __init__(self, root: str, names: list[str]):
        self.root, self.names = root, names


def list_tree(root: str) -> list[tuple[str, int]]:
    """(relative path, size) of the regular files, sorted; ``.git`` directories as empty entries."""
    out = []
    for here, dirs, names in os.walk(root):
        rel = os.path.relpath(here, root)
        join = (lambda n: n) if rel == "." else (lambda n, rel=rel: f"{rel}/{n}".replace(os.sep, "/"))
        if ".git" in dirs:
            dirs.remove(".git")
            out.append((join(".git"), -1))
        for n in names:
            full = os.path.join(here, n)
            if os.path.isfile(full):
                out.append((join(n), os.path.getsize(full)))
    return sorted(out)


class SourceTreeReader(DataSourceReader):
    def __init__(self, options: dict):
        self.root = options.get("path")
        if not self.root:
            raise ValueError("source_tree needs a path")
        self.repo = options.get("repo", os.path.basename(os.path.abspath(self.root)))

    def partitions(self):
        if os.path.isfile(self.root):
            return [FileBatch(os.path.dirname(self.root), [os.path.basename(self.root)])]
        if not os.path.isdir(self.root):
            raise FileNotFoundError(self.root)
        out, names, size = [], [], 0
        for name, n_bytes in list_tree(self.root):
            if names and (size + n_bytes > BYTES_PER_TASK or len(names) >= FILES_PER_TASK):
                out.append(FileBatch(self.root, names))
                names, size = [], 0
            names.append(name)
            size += max(n_bytes, 0)
        return out + [FileBatch(self.root, names)]

    def read(self, partition: FileBatch):
        for name in partition.names:
            full = os.path.join(partition.root, name)
            if os.path.isdir(full):
                yield (self.repo, name, b"")
                continue
            try:
                with open(full, "rb") as f:
                    yield (self.repo, name, f.read())
            except OSError:  # a row without content; ``files.not_scanned`` lists it
                yield (self.repo, name, None)


class SourceTree(DataSource):
    @classmethod
    def name(cls) -> str:
        return "source_tree"

    def schema(self) -> str:
        return "repo string, path string, raw binary"

    def reader(self, schema) -> SourceTreeReader:
        return SourceTreeReader(self.options)


def _entries(root: str, here: str) -> Iterator[tuple]:
    """One level below a directory: directories to go on with, files, and ``.git`` as an empty file."""
    try:
        with os.scandir(os.path.join(root, here) if here else root) as found:
            for e in found:
                name = f"{here}/{e.name}" if here else e.name
                if e.is_dir(follow_symlinks=False):
                    yield root, name, "git" if e.name == ".git" else "dir", 0
                elif e.is_file():
                    try:
                        size = e.stat().st_size
                    except OSError:  # gone meanwhile: it is read as a file without content
                        size = 0
                    yield root, name, "file", size
    except OSError:
        yield root, here, "unreadable", 0


def _listed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The entries of directories, a bounded number at a time: a directory of any size passes through."""
    for batch in batches:
        entries = (e for root, here in zip(batch["root"], batch["path"]) for e in _entries(root, here))
        while rows := list(islice(entries, ENTRIES_PER_BATCH)):
            yield pd.DataFrame(rows, columns=["root", "path", "kind", "size"])


LISTING = "root string, path string, kind string, size long"


def tree_listing(spark: SparkSession, root: str) -> DataFrame:
    """(root, path, kind, size) of everything below a folder that all executors share.

    A round per level: the directories of a level are listed by tasks, and only their number comes to the driver.
    """
    level, n = spark.createDataFrame([(root, "")], "root string, path string"), 1
    cores = spark.sparkContext.defaultParallelism
    out = None
    while True:
        # a number of tasks of our own: the few bytes of the names would else be put together into one task
        tasks = max(min(n, 2 * cores), n // DIRECTORIES_PER_TASK)
        found = materialize(level.repartition(tasks, "path").mapInPandas(_listed, LISTING))
        out = found if out is None else out.unionByName(found)
        level = found.filter("kind = 'dir'").select("root", "path")
        n = level.count()
        if not n:
            return out.filter("kind <> 'dir'")


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The files of a listing, some small ones or one large one at a time."""
    def batch_of(paths: list, raws: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(raws, pa.binary())], ["path", "raw"])

    for batch in batches:
        paths, raws, size = [], [], 0
        for root, path, kind in zip(*(batch.column(c).to_pylist() for c in ("root", "path", "kind"))):
            raw = b"" if kind == "git" else None
            if kind == "file":
                try:
                    with open(os.path.join(root, path), "rb") as f:
                        raw = f.read()
                except OSError:  # a row without content; ``files.not_scanned`` lists it
                    raw = None
            if paths and size + len(raw or b"") > BYTES_PER_BATCH:
                yield batch_of(paths, raws)
                paths, raws, size = [], [], 0
            paths.append(path)
            raws.append(raw)
            size += len(raw or b"")
        if paths:
            yield batch_of(paths, raws)


def read_tree(spark: SparkSession, path: str, repo: str | None = None) -> DataFrame:
    """(repo, path, content) of a tree on disk, listed and read by tasks; a single file works too."""
    if os.path.isfile(path):
        spark.dataSource.register(SourceTree)
        reader = spark.read.format("source_tree")
        return decode((reader if repo is None else reader.option("repo", repo)).load(path))
    if not os.path.isdir(path):
        raise FileNotFoundError(path)
    listing = tree_listing(spark, path)
    size = listing.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count(F.lit(1))).first()
    tasks = max(size[0] // BYTES_PER_TASK, size[1] // FILES_PER_TASK, 1)
    raw = listing.repartition(int(tasks), "path").mapInArrow(_read, "path string, raw binary")
    return decode(raw.select(F.lit(repo or os.path.basename(os.path.abspath(path))).alias("repo"), "path", "raw"))


def write_tree(files: DataFrame, root: str) -> int:
    """Files (path, content) as a tree below a folder that all executors share; returns their number."""
    root = root.removeprefix("file:")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column("path"), batch.column("content")):
                full = os.path.join(root, name.as_py())
                os.makedirs(os.path.dirname(full), exist_ok=True)
                with open(full, "wb") as f:
                    f.write(content.as_buffer() or b"")  # the bytes of the batch, not copied into a string
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], ["n"])

    return files.select("path", "content").mapInArrow(write, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
