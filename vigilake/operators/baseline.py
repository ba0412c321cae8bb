"""Baselines: fingerprints, saving, anti-join filtering."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigilake.functions.text import strip
from vigilake.model import broadcast_if_small
from vigilake.session import materialize


def fingerprint(path_scope: str = "name") -> Column:
    """``check|file|hash``: the snippet's hash, or the line where there is no snippet.

    The file is its base name, so a moved file keeps its fingerprints and files of the same
    name share them; ``path_scope='full'`` uses the whole path instead.
    """
    file = F.col("path" if path_scope == "full" else "name")
    tail = F.when(F.col("snippet") != "", F.substring(F.md5(strip(F.col("snippet")).cast("binary")), 1, 12))
    return F.concat_ws("|", F.col("check_name"), file, F.coalesce(tail, F.col("line").cast("string")))


def with_fingerprint(findings: DataFrame, path_scope: str = "name") -> DataFrame:
    return findings.withColumn("fingerprint", fingerprint(path_scope))


def baseline_rows(findings: DataFrame) -> DataFrame:
    """The rows to save: distinct (repo, fingerprint)."""
    return with_fingerprint(findings).select("repo", "fingerprint").distinct()


def baseline_header(findings: DataFrame) -> DataFrame:
    """Per repository: version, findings before de-duplication, distinct fingerprints."""
    per_print = with_fingerprint(findings).groupBy("repo", "fingerprint").agg(F.count(F.lit(1)).alias("n"))
    return per_print.groupBy("repo").agg(
        F.lit(1).alias("version"), F.sum("n").alias("count"), F.count(F.lit(1)).alias("distinct_count"))


def save_baseline(findings: DataFrame, path: str) -> None:
    """Writes the fingerprints as a table clustered by repository; a rerun replaces it."""
    baseline_rows(findings).write.mode("overwrite").parquet(path)


def baseline_document(findings: DataFrame) -> DataFrame:
    """Rows (repo, section, fingerprint, text) of a JSON document per repository, in document order.

    ``{"version": 1, "count": n, "fingerprints": [...]}`` with the count before de-duplication.
    """
    counted = with_fingerprint(findings).groupBy("repo", "fingerprint").agg(F.count(F.lit(1)).alias("n"))
    heads = counted.groupBy("repo").agg(F.sum("n").alias("n"), F.min("fingerprint").alias("first"))
    quoted = F.regexp_extract(F.to_json(F.struct(F.col("fingerprint").alias("f"))), r"(?s)^\{\"f\":(.*)\}$", 1)
    comma = F.when(F.col("fingerprint") == F.col("first"), F.lit("")).otherwise(F.lit(","))
    items = counted.join(broadcast_if_small(heads.select("repo", "first")), "repo").select(
        "repo", F.lit(1).alias("section"), "fingerprint", F.concat(comma, quoted).alias("text"))
    head = F.concat(F.lit('{"version":1,"count":'), F.col("n").cast("string"), F.lit(',"fingerprints":['))
    edge = lambda n, text: heads.select("repo", F.lit(n).alias("section"), F.lit("").alias("fingerprint"), text.alias("text"))
    return edge(0, head).unionByName(items).unionByName(edge(2, F.lit("]}")))


def save_documents(findings: DataFrame, path: str) -> None:
    """The JSON documents of all repositories, one folder ``repo=...`` each; a rerun replaces them.

    A fingerprint is a line, and the lines of a folder's files in the order of their names are the document,
    so a repository of any size is spread over tasks and files.
    """
    order = ["repo", "section", "fingerprint"]
    # materialized, so that the sampling of ranges does not compute the findings twice
    rows = materialize(baseline_document(findings).select(*order, "text"))
    rows.repartitionByRange(*order).sortWithinPartitions(*order).select("repo", "text").write.mode("overwrite").partitionBy("repo").text(path)


def load_documents(spark, path: str) -> DataFrame | None:
    """Rows (repo, fingerprint) of the documents that ``save_documents`` wrote, or None where none can be read.

    Lines are read as they are split, so no document is one value.  A repository whose document has no beginning
    or no end is left out as unreadable.
    """
    from pyspark.errors import AnalysisException

    try:
        found = spark.read.text(path)
    except AnalysisException:
        return None
    if "repo" not in found.columns:  # no folder of a repository
        return spark.createDataFrame([], "repo string, fingerprint string") if found.isEmpty() else None
    lines = spark.read.schema("value string, repo string").text(path)
    edge = F.when(F.startswith("value", F.lit('{"version":')), 1).when(F.col("value") == "]}", 2)
    whole = lines.groupBy("repo").agg(F.bit_or(edge).alias("edges")).filter("edges = 3").select(F.col("repo").alias("of"))
    if whole.isEmpty():
        return None
    text = F.from_json(F.concat(F.lit('{"f":'), F.regexp_replace("value", "^,", ""), F.lit("}")), "f string")["f"]
    items = lines.filter(F.col("value").rlike('^,?"')).select("repo", text.alias("fingerprint"))
    return items.join(broadcast_if_small(whole), F.col("repo").eqNullSafe(F.col("of")), "left_semi").distinct()


def load_baseline(spark, path: str, repo: str | None = None) -> DataFrame | None:
    """Saved fingerprints, or None (not an empty set) where there is no readable baseline.

    ``path`` is a table written by ``save_baseline`` or a JSON document with ``fingerprints``;
    ``repo`` names the repository of a document that does not.
    """
    from pyspark.errors import AnalysisException

    try:
        if path.endswith(".json"):
            doc = spark.read.schema("repo string, version int, fingerprints array<string>").json(path, multiLine=True)
            kept = doc.filter("fingerprints is not null")
            if kept.isEmpty():
                return None
            return kept.select(F.coalesce("repo", F.lit(repo)).alias("repo"), F.explode("fingerprints").alias("fingerprint")).distinct()
        return spark.read.parquet(path).select("repo", "fingerprint")
    except AnalysisException:
        return None


def _matched(findings: DataFrame, baseline: DataFrame, how: str) -> DataFrame:
    known = broadcast_if_small(baseline.select("repo", "fingerprint").distinct())
    return with_fingerprint(findings).join(known, ["repo", "fingerprint"], how)


def filter_baseline(findings: DataFrame, baseline: DataFrame | None) -> DataFrame:
    """Findings that are not in the baseline; every duplicate of a known one goes."""
    if baseline is None:
        return with_fingerprint(findings)
    return _matched(findings, baseline, "left_anti")


def removed_by_baseline(findings: DataFrame, baseline: DataFrame) -> DataFrame:
    """Per repository, how many findings the baseline removes."""
    return _matched(findings, baseline, "left_semi").groupBy("repo").agg(F.count(F.lit(1)).alias("removed"))


def duplicate_fingerprints(findings: DataFrame) -> DataFrame:
    """Fingerprints shared by several findings: counts and extreme paths, not path lists."""
    per_path = with_fingerprint(findings).groupBy("repo", "fingerprint", "path").agg(F.count(F.lit(1)).alias("n"))
    return (
        per_path.groupBy("repo", "fingerprint")
        .agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("n_paths"),
             F.min("path").alias("first_path"), F.max("path").alias("last_path"))
        .filter("n > 1")
    )
