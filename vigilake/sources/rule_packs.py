"""Rule packs: YAML streams and JSON documents that lie in scanned repositories or in a folder.

Packs are rows like any other file; they are parsed by the tasks that hold them.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

try:
    import yaml
except ImportError:  # optional
    yaml = None

RULES_DIR = ".scan/rules"
PACK = "repo string, source string, ord long, doc string, reason string"


def _documents(name: str, text: str) -> list:
    if name.endswith(".json"):
        return [json.loads(text)]
    if yaml is None:
        raise ValueError("YAML rule packs need PyYAML")
    try:
        return list(yaml.safe_load_all(text))
    except (yaml.YAMLError, RecursionError) as e:
        raise ValueError(f"invalid YAML: {getattr(e, 'problem', None) or e}") from None


def _rule(doc):
    """``languages: python`` means a list of one; scalars that YAML reads as numbers or dates become text."""
    text = {k: v if v is None or isinstance(v, (str, list, dict)) else str(v) for k, v in doc.items()}
    if isinstance(text.get("languages"), str):
        text["languages"] = [text["languages"]]
    return text


def _parsed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for repo, source, content in zip(batch["repo"], batch["source"], batch["content"]):
            try:
                if content is None:
                    raise ValueError("not readable")
                documents = [d for d in _documents(source, content) if d is not None]
            except ValueError as e:
                reason = "invalid JSON" if isinstance(e, json.JSONDecodeError) else str(e).split("\n")[0]
                rows.append((repo, source, 0, None, reason))
                continue
            for i, d in enumerate(documents):
                if isinstance(d, dict):
                    rows.append((repo, source, i, json.dumps(_rule(d)), None))
                elif isinstance(d, list) and all(isinstance(x, dict) for x in d):
                    rows.append((repo, source, i, json.dumps([_rule(x) for x in d]), None))
                else:
                    rows.append((repo, source, i, None, "no rule"))
        yield pd.DataFrame(rows, columns=["repo", "source", "ord", "doc", "reason"])


def pack_documents(packs: DataFrame) -> DataFrame:
    """(repo, source, ord, doc, reason) from pack files (repo, source, content).

    A document of a YAML stream is a row, in order.  A file that cannot be parsed, or a document that is no rule, gives a
    row with the reason and no document; the other files and documents still load.
    """
    return packs.select("repo", "source", "content").mapInPandas(_parsed, PACK)


def is_pack(path, folder: str = RULES_DIR):
    """The path is a pack directly below the rule folder."""
    inside = F.startswith(path, F.lit(f"{folder}/")) & (F.size(F.split(path, "/")) == folder.count("/") + 2)
    return inside & F.rlike(path, F.lit(r"\.(?:ya?ml|json)$"))


def packs_in(files: DataFrame, folder: str = RULES_DIR) -> DataFrame:
    """(repo, source, ord, doc, reason) of the rule packs that lie in the repositories."""
    inside = files.filter(is_pack(F.col("path"), folder))
    return pack_documents(inside.select("repo", F.col("path").alias("source"), "content"))


def read_rule_packs(spark: SparkSession, root: str, folder: str = RULES_DIR) -> DataFrame:
    """(source, ord, doc, reason) of the packs below one folder, read by tasks through Spark's own file systems."""
    where = os.path.join(root, folder)
    # an absent folder holds no packs
    path = spark._jvm.org.apache.hadoop.fs.Path(where)
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], PACK).drop("repo")
    raw = spark.read.format("binaryFile").option("pathGlobFilter", "*.{yml,yaml,json}").load(where)
    name = F.element_at(F.split("path", "/"), -1)
    return pack_documents(raw.select(
        F.lit("").alias("repo"), name.alias("source"), F.decode("content", "UTF-8").alias("content"))).drop("repo")
