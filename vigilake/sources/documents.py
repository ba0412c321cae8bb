"""Documents as real files: one valid file per repository, all of them or none.

The ordered rows of all documents are written as parts, sorted by range, so that a document of any size is spread over tasks.  Then
a task per document joins its parts into a file of a staging folder, as a stream of bytes.  Committing moves the finished files to their
places; a failed write leaves none.  The folder has to be one that the driver and all executors share.
"""

from __future__ import annotations

import os
import shutil
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from vigilake.model import broadcast_if_small

COPY_BYTES = 1 << 20


@dataclass
class Written(WriterCommitMessage):
    names: list


class _Writer(DataSourceWriter):
    def __init__(self, options):
        self.folder, self.staging, self.parts = (options[k] for k in ("path", "staging", "parts"))

    def write(self, iterator) -> Written:
        names = []
        for row in iterator:
            part_dir = os.path.join(self.parts, f"document={row.document}")
            # another attempt of this task may be writing the same document
            scratch = os.path.join(self.staging, f"{row.document}.{uuid.uuid4().hex}")
            with open(scratch, "wb") as out:
                for part in sorted(f for f in os.listdir(part_dir) if f.startswith("part-")):
                    with open(os.path.join(part_dir, part), "rb") as f:
                        shutil.copyfileobj(f, out, COPY_BYTES)
            names.append((scratch, row.name))
        return Written(names)

    def commit(self, messages) -> None:
        for m in messages:
            for scratch, name in m.names if m else []:
                os.replace(scratch, os.path.join(self.folder, name))
        self._clear()

    def abort(self, messages) -> None:
        self._clear()

    def _clear(self) -> None:
        for folder in (self.staging, self.parts):
            shutil.rmtree(folder, ignore_errors=True)


class DocumentFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "document_files"

    def schema(self) -> str:
        return "document string, name string"

    def writer(self, schema, overwrite: bool) -> _Writer:
        return _Writer(self.options)


def write_files(rows: DataFrame, order: list[str], folder: str, suffix: str = ".json") -> DataFrame:
    """Writes ``folder/<repo><suffix>`` for every repository of the rows (repo, text and ``order``); returns (repo, name).

    Characters that a file name cannot hold are written as %XX.  Files of earlier runs are replaced.
    """
    spark = rows.sparkSession
    folder = os.path.abspath(folder.removeprefix("file://").removeprefix("file:"))
    run = uuid.uuid4().hex
    parts, staging = os.path.join(folder, f".parts-{run}"), os.path.join(folder, f".staging-{run}")
    os.makedirs(staging)
    name = F.concat(F.coalesce(F.replace(F.url_encode("repo"), F.lit("*"), F.lit("%2A")), F.lit("%00")), F.lit(suffix))
    listed = rows.select("repo").distinct().select(
        "repo", F.sha2(F.coalesce("repo", F.lit("\0")).cast("binary"), 256).alias("document"), name.alias("name"))
    keyed = rows.join(broadcast_if_small(listed.select(F.col("repo").alias("of"), "document")), F.col("repo").eqNullSafe(F.col("of")))
    place = ["document", *order]
    keyed.repartitionByRange(*place).sortWithinPartitions(*place).select("document", "text").write.partitionBy("document").text(
        f"file://{parts}")
    spark.dataSource.register(DocumentFiles)
    listed.select("document", "name").write.format("document_files").option("staging", staging).option("parts", parts).mode("append").save(folder)
    return listed.select("repo", "name")
