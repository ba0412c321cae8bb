"""Exact duplicates with a heavy-hitter split.

Frequent digests are found by Misra-Gries summaries, one per partition, merged in Spark.  The exact size
and first row of each candidate are counted (partial sums before the shuffle), and these winners, at most
``counters`` rows whatever the input, are broadcast: copies of frequent texts are settled on the map side
and never meet in one task.  The digests that are left go through an ordinary shuffle: counted with partial sums,
and of their rows only those of repeated digests meet the counts, in a join whose large keys can be split.

Defined cases: null text is empty text; a null doc_id comes after all others, and is the keep_id only if
the group has no other; of several rows with the smallest doc_id one stays; an empty table gives no rows;
columns besides the two that are named are not read, but by ``deduplicate`` to choose one of several rows of
equal doc_id and text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigilake.llm.common import SPACES, bitmap, fresh, in_bitmap, keep, text_of

COUNTERS = 1024


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(tag, doc_id, digest): SHA-256 of the text with each run of white space as one space."""
    normal = F.regexp_replace(text_of(text_col), SPACES + "+", " ")
    return docs.select(
        F.col(id_col).alias("doc_id"), F.unhex(F.sha2(normal, 256)).alias("digest")
    ).withColumn("tag", F.monotonically_increasing_id())


def _reduce(counts: dict[bytes, int], counters: int) -> dict[bytes, int]:
    """At most ``counters`` entries: the next largest count is taken off all."""
    if len(counts) <= counters:
        return counts
    values = np.fromiter(counts.values(), np.int64, len(counts))
    off = int(np.partition(values, len(values) - counters - 1)[len(values) - counters - 1])
    return {k: v - off for k, v in counts.items() if v > off}


def frequent(rows: DataFrame, counters: int = COUNTERS) -> list[bytes]:
    """Every digest with more than rows / (counters + 1) rows, and perhaps others; at most ``counters``."""

    def summary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[bytes, int] = {}
        for batch in batches:
            for x in batch.column(0).value_counts().to_pylist():
                counts[x["values"]] = counts.get(x["values"], 0) + x["counts"]
            counts = _reduce(counts, counters)
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], ["digest", "seen"])

    merged = (
        rows.select("digest").mapInArrow(summary, "digest binary, seen long")
        .groupBy("digest").agg(F.sum("seen").alias("seen")).filter("seen > 1"))
    top = merged.orderBy(F.desc("seen"), "digest").limit(counters + 1).collect()
    off = top[counters]["seen"] if len(top) > counters else 0
    return [bytes(r["digest"]) for r in top if r["seen"] > off]


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", counters: int = COUNTERS) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256."""
    spark = docs.sparkSession
    rows = keep(digests(docs, id_col, text_col))
    first = F.struct(F.isnull("doc_id").alias("nul"), F.col("doc_id").alias("doc_id"), F.col("tag").alias("tag"))
    hot = spark.createDataFrame([(x,) for x in frequent(rows, counters)], "digest binary")
    counted = (
        rows.join(F.broadcast(hot), "digest")
        .groupBy("digest").agg(F.min(first).alias("first"), F.count(F.lit(1)).alias("group_size")))
    winners = spark.createDataFrame(counted.collect(), counted.schema)
    settled = rows.join(F.broadcast(winners), "digest")
    rest = rows.join(F.broadcast(winners.select("digest")), "digest", "left_anti")
    repeated = keep(rest.groupBy("digest").agg(F.min(first).alias("first"), F.count(F.lit(1)).alias("group_size")).filter("group_size > 1"))
    maybe = in_bitmap(bitmap(repeated.select(F.xxhash64("digest").alias("k")), "k"), F.xxhash64("digest"))
    alone = rest.filter(~maybe).select("digest", "doc_id", "tag", first.alias("first"), F.lit(1).cast("long").alias("group_size"))
    met = rest.filter(maybe).join(repeated, "digest", "left").withColumns(
        {"first": F.coalesce("first", first), "group_size": F.coalesce("group_size", F.lit(1).cast("long"))})
    return settled.unionByName(alone).unionByName(met).select(
        "doc_id", F.col("first.doc_id").alias("keep_id"), "group_size", (F.col("tag") == F.col("first.tag")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"))


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Of each group of equal texts one row, all columns kept: the smallest doc_id, nulls last.

    Rows of equal doc_id and text are told apart by their other columns.  Documents move only where a bitmap of the
    (doc_id, text) that change cannot tell that they stay.
    """
    gid, gsha, gkey, gone = (fresh(docs, c) for c in ("gone_id", "gone_sha", "gone_key", "gone"))
    found = exact_duplicates(docs, id_col, text_col).filter("group_size > 1")
    changed = keep(
        found.groupBy(F.col("doc_id").alias(gid), F.col("text_sha256").alias(gsha))
        .agg(F.first(F.expr("doc_id is distinct from keep_id")).alias(gone), F.count(F.lit(1)).alias("rows"))
        .filter(F.col(gone) | (F.col("rows") > 1)).withColumn(gkey, F.xxhash64(gid, gsha)).drop("rows"))
    own_id = F.col(f"`{id_col}`")
    own_sha = F.sha2(F.regexp_replace(text_of(f"`{text_col}`"), SPACES + "+", " "), 256)
    maybe = in_bitmap(bitmap(changed, gkey), F.xxhash64(own_id, own_sha))
    met = docs.filter(maybe).withColumn(gkey, own_sha).join(
        changed.drop(gkey), own_id.eqNullSafe(F.col(gid)) & (F.col(gkey) == F.col(gsha)), "left")
    stay = docs.filter(~maybe).unionByName(met.filter(F.col(gsha).isNull()).select(*[f"`{c}`" for c in docs.columns]))
    hashed = [F.col(f"`{f.name}`") for f in docs.schema if "map<" not in f.dataType.simpleString()]
    one = met.filter(~F.col(gone)).groupBy(gid, gsha).agg(
        F.min_by(F.struct(*[F.col(f"`{c}`") for c in docs.columns]), F.xxhash64(*hashed)).alias(gone))
    return stay.unionByName(one.select(*[F.col(gone).getField(c).alias(c) for c in docs.columns]))
