"""Shards along a Hilbert curve over several metadata dimensions.

Each dimension is quantised to ``BITS`` bits: strings by the share of rows before their value in code
point order (so that frequent values get more of the range), sizes by half powers of two.  Rows are put
in the order of their curve index, and shards are cut as runs of it, so that a shard covers a compact box in
every dimension and readers can skip files by any of them.

Law ``rows``: counts of shards differ by one at most.  Rows of one cell are ordered by the checksum of the
text, so equal texts of a cell lie together, then by doc_id; a cell or group of any size is cut where the
order says, by doc_id at last.

Defined cases: null text has size 1 and checksum 0; null values of a dimension come after all others; an
empty table gives no rows; repeated rows get places next to each other; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vigilake.llm.common import keep, partitions, ranked, text_of
from vigilake.model import broadcast_if_small

BITS = 6
SHARDS = 16


def hilbert_index(axes: list[np.ndarray], bits: int) -> np.ndarray:
    """Position on the Hilbert curve of points with ``bits`` bits in each axis (Skilling's transform)."""
    x = [np.array(a, np.int64) for a in axes]
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        low = q - 1
        for i in range(n):
            high = (x[i] & q) != 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & low)
            x[0] = np.where(high, x[0] ^ low, x[0]) ^ swap
            x[i] = x[i] ^ swap if i else x[0]
        q >>= 1
    for i in range(1, n):
        x[i] = x[i] ^ x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t = np.where((x[n - 1] & q) != 0, t ^ (q - 1), t)
        q >>= 1
    x = [a ^ t for a in x]
    index = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for a in x:
            index = (index << 1) | ((a >> b) & 1)
    return index


def _with_index(rows: DataFrame, axes: list[str], bits: int) -> DataFrame:
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + ", curve long"

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            index = hilbert_index([batch.column(a).to_numpy(zero_copy_only=False) for a in axes], bits)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(index, pa.int64())], [*batch.schema.names, "curve"])

    return rows.mapInArrow(add, schema)


def _quantised(rows: DataFrame, column: str, total: int, bits: int) -> DataFrame:
    """(value, level): the share of rows with a smaller value, in 2**bits levels."""
    counts = rows.groupBy(F.col(column).alias("_value")).agg(F.count(F.lit(1)).alias("_n"))
    order = [F.asc_nulls_last("_value")]
    placed = keep(counts.repartitionByRange(8, *order).withColumn("_p", F.spark_partition_id()))
    before, sums = 0, {}
    for p, n in sorted(placed.groupBy("_p").agg(F.sum("_n")).collect()):
        sums[p] = before
        before += n
    starts = rows.sparkSession.createDataFrame(list(sums.items()), "_p int, _start long")
    inside = Window.partitionBy("_p").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    level = (F.coalesce(F.sum("_n").over(inside), F.lit(0)) + F.col("_start")) * (1 << bits)
    return placed.join(F.broadcast(starts), "_p").select("_value", F.floor(level / F.lit(max(total, 1))).cast("int").alias(f"_{column}"))


def size_level(size: Column, bits: int) -> Column:
    return F.least(F.floor(2 * F.log2(size.cast("double"))), F.lit((1 << bits) - 1)).cast("int")


def hilbert_shards(
    docs: DataFrame, dimensions: tuple[str, ...] = ("source", "lang"), shards: int = SHARDS, bits: int = BITS,
    id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = (),
) -> DataFrame:
    """doc_id, size, text_crc32, curve, rank, shard, slot, and the columns named in ``carry``."""
    text = text_of(text_col)
    own = [F.col(d).alias(f"d{i}") for i, d in enumerate(dimensions)]
    rows = docs.select(
        F.col(id_col).alias("doc_id"), (F.octet_length(text) + F.lit(1)).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"), *own, *[F.col(c).alias(f"carry_{c}") for c in carry])
    rows = rows if carry else keep(rows)
    total = rows.count()
    axes = []
    for i in range(len(dimensions)):
        levels = broadcast_if_small(_quantised(rows.select(f"d{i}"), f"d{i}", total, bits))
        rows = rows.join(levels, F.col(f"d{i}").eqNullSafe(F.col("_value")), "left").drop("_value")
        axes.append(f"_d{i}")
    rows = rows.withColumn("_size", size_level(F.col("size"), bits)).drop(*[f"d{i}" for i in range(len(dimensions))])
    indexed = _with_index(rows, [*axes, "_size"], bits).drop(*axes, "_size")
    order = ["curve", "text_crc32", F.asc_nulls_last("doc_id"), "size"]
    placed = ranked(indexed, order)
    shard = F.expr(f"cast(rank * {shards} div {max(total, 1)} as int)")
    out = placed.withColumn("shard", shard).withColumn(
        "slot", F.expr(f"rank - (shard * cast({total} as bigint) + {shards - 1}) div {shards}"))
    return out.select("doc_id", "size", "text_crc32", "curve", "rank", "shard", "slot", *[F.col(f"carry_{c}").alias(c) for c in carry])


def write_shards(docs: DataFrame, path: str, **options) -> None:
    """Documents as Parquet, one folder per shard, its files and their rows in curve order.

    Tasks take ranges of (shard, slot), as many as there are shuffle partitions and several for a shard, so no task holds a
    whole shard.  A null doc_id is written as null.
    """
    placed = hilbert_shards(docs, carry=tuple(c for c in docs.columns if c != options.get("id_col", "doc_id")), **options)
    ranges = max(partitions(docs.sparkSession), 4 * options.get("shards", SHARDS))
    placed.repartitionByRange(ranges, "shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
