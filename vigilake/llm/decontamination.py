"""Benchmark decontamination: windows of benchmark words looked up in every training text.

The fingerprints of all windows (``n`` consecutive words of an item; a shorter item is one window) are
broadcast; a bitmap over fingerprint bits passes few positions of a text, the sorted fingerprints fewer, and
the words themselves decide.  Texts are not shuffled.  The broadcast is bounded: a benchmark of more than
``BLOCK_WINDOWS`` windows or ``BLOCK_BYTES`` of text is cut into blocks, items of any size into pieces that overlap by
n - 1 words; each block is one pass over the documents whose hits are stored, and the hits of the passes are merged.  Spans are cut
after the last pass, so no cut hides or makes a hit.

Defined cases: null or empty text has no words and no hits; an item without words has no windows; items
that share an id are one item; an item with null id is left out; an empty table or benchmark gives no hits;
repeated documents are reported each; other columns are not read by ``contamination`` and kept by the two
removal functions.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from vigilake.llm import textarrays as ta
from vigilake.llm.common import bitmap, fresh, in_bitmap, keep

WINDOW = 10
BLOCK_BYTES = 32 << 20
#: windows of a block, each about 35 bytes with its words, in the driver and in every Python worker
BLOCK_WINDOWS = 1 << 20
PIECE_WINDOWS = 1 << 12
BITMAP_BITS = 22
SPAN = ("lo", "hi", "first", "last")
SPANS = f"array<struct<{', '.join(f'{c}: bigint' for c in SPAN)}>>"


class Windows:
    """Windows of one block of items as sorted fingerprints, with the place of each window in the block's words."""

    def __init__(self, items: list[tuple[str, bytes]], n: int):
        self.ids = sorted({item_id for item_id, _ in items})
        number = {item_id: i for i, item_id in enumerate(self.ids)}
        owner = np.array([number[item_id] for item_id, _ in items], np.int32)
        low = ta.LOWER[np.frombuffer(b"\0".join([*[text for _, text in items], b""]), np.uint8)]
        ends = np.cumsum([len(text) + 1 for _, text in items], dtype=np.int64)
        _, last, row = ta.words(low, np.append(0, ends), ta.LETTERS)
        # the words in lower case, one space after each: a window is a slice
        inside = ta.LETTERS[low]
        low = np.where(inside, low, np.uint8(32))
        inside[last] = True
        low = low[inside]
        self.joined = low.tobytes()
        start, end, _ = ta.words(low, np.array([0, len(low)]), ta.LETTERS)
        self.start, self.end = start.astype(np.int32), end.astype(np.int32)
        hashes = ta.word_hashes(low, start, end)
        count = np.bincount(row, minlength=len(items))
        base = np.cumsum(count) - count
        self.prints: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = {}
        for size in np.unique(np.minimum(count[count > 0], n)).tolist():
            if size == n:
                at = np.flatnonzero(row[:len(row) - n + 1] == row[n - 1:])
            else:
                at = base[count == size]
            prints = ta.window_hashes(hashes, size)[at]
            item = owner[row[at]]
            order = np.lexsort((item, prints))
            at, prints, item = at[order].astype(np.int32), prints[order], item[order]
            again = 1 + np.flatnonzero((prints[1:] == prints[:-1]) & (item[1:] == item[:-1]))
            again = again[[self.words(at[i], size) == self.words(at[i - 1], size) for i in again.tolist()]] if len(again) else again
            at, prints, item = (np.delete(x, again) for x in (at, prints, item))
            bitmap = np.zeros(1 << BITMAP_BITS, bool)
            bitmap[prints >> np.uint64(64 - BITMAP_BITS)] = True
            self.prints[size] = (prints, bitmap, at, item)

    def words(self, at: int, size: int) -> bytes:
        return self.joined[self.start[at]:self.end[at + size - 1]]

    @property
    def items(self) -> dict[bytes, set[str]]:
        """Item ids by the words of a window."""
        found: dict[bytes, set[str]] = {}
        for size, (prints, *_) in self.prints.items():
            found |= self._items(0, len(prints), size)
        return found

    def _items(self, lo: int, hi: int, size: int) -> dict[bytes, set[str]]:
        """Items by words, of the windows that share a fingerprint."""
        _, _, at, item = self.prints[size]
        found: dict[bytes, set[str]] = {}
        for i in range(lo, hi):
            found.setdefault(self.words(at[i], size), set()).add(self.ids[item[i]])
        return found

    def hits(self, raw: bytes, start: np.ndarray, end: np.ndarray, row: np.ndarray, hashes: np.ndarray):
        """(word index, words, item ids) of every verified window."""
        for size, (prints, bitmap, *_) in self.prints.items():
            seen = ta.window_hashes(hashes, size)
            if not len(seen):
                continue
            at = np.flatnonzero(bitmap[seen >> np.uint64(64 - BITMAP_BITS)])
            at = at[row[at] == row[at + size - 1]]
            lo = np.searchsorted(prints, seen[at])
            same = prints[np.minimum(lo, len(prints) - 1)] == seen[at]
            at, lo = at[same], lo[same]
            hi = np.searchsorted(prints, seen[at], "right")
            known: dict[int, dict[bytes, set[str]]] = {}
            for i, a, b in zip(at.tolist(), lo.tolist(), hi.tolist()):
                if a not in known:
                    known[a] = self._items(a, b, size)
                key = b" ".join([raw[s:e] for s, e in zip(start[i:i + size].tolist(), end[i:i + size].tolist())])
                ids = known[a].get(key)
                if ids:
                    yield i, size, ids


def scan_text(texts: pa.Array, windows: Windows) -> Iterator[tuple[int, list[tuple[int, int]], set[str], list[tuple[int, int]]]]:
    """Per text: number of words, merged spans of hit words, items, and the spans in bytes."""
    for lo, hi, data, offsets in ta.slices(texts):
        low = ta.LOWER[data]
        start, end, row = ta.words(low, offsets, ta.LETTERS)
        bounds = np.searchsorted(row, np.arange(hi - lo + 1), "left").tolist()
        found: dict[int, list] = {}
        if len(start):
            for i, size, ids in windows.hits(low.tobytes(), start, end, row, ta.word_hashes(low, start, end)):
                found.setdefault(int(row[i]), []).append((i, i + size, ids))
        for r in range(hi - lo):
            first, spans, items = bounds[r], [], set()
            for a, b, ids in sorted(found.get(r, []), key=lambda x: x[:2]):
                items |= ids
                if spans and a <= spans[-1][1]:
                    spans[-1] = (spans[-1][0], max(b, spans[-1][1]))
                else:
                    spans.append((a, b))
            yield (
                bounds[r + 1] - first, [(a - first, b - first) for a, b in spans], items,
                [(int(start[a]) - int(offsets[r]), int(end[b - 1]) - int(offsets[r])) for a, b in spans])


def pieces(items: DataFrame, n: int, piece_windows: int = PIECE_WINDOWS) -> DataFrame:
    """(item, words, windows): the words of items (item, text), a bounded number of windows a row.

    Pieces of one item overlap by n - 1 words, so each window is in one of them; an item of fewer words is whole.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, text in zip(batch.column(0), batch.column(1)):
                data = np.frombuffer(text.as_buffer() or b"", np.uint8)
                start, end, _ = ta.words(ta.LOWER[data], np.array([0, len(data)]), ta.LETTERS)
                count = max(len(start) - n + 1, min(len(start), 1))
                for a in range(0, count, piece_windows):
                    some = min(piece_windows, count - a)
                    own = data[start[a]:end[min(a + some + n - 1, len(start)) - 1]].tobytes()
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([item.as_py()], pa.string()), pa.array([own], pa.binary()), pa.array([some], pa.int64())],
                        ["item", "words", "windows"])

    return items.select("item", "text").mapInArrow(run, "item string, words binary, windows long")


def blocks(
    benchmark: DataFrame, item_col: str, text_col: str, n: int, block_bytes: int, block_windows: int = BLOCK_WINDOWS,
) -> Iterator[Windows]:
    """Windows of the items, a bounded number of windows and of text bytes at a time, but one piece at least."""
    items = benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(text_col).alias("text")).dropna()
    size = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    # the driver fetches a partition at a time
    parts = -(-size // block_bytes) or 1
    rows = pieces(items, n)
    block, windows, length, made = [], 0, 0, False
    for r in (rows.repartition(parts) if parts > 1 else rows).toLocalIterator():
        if block and (windows + r["windows"] > block_windows or length + len(r["words"]) > block_bytes):
            yield Windows(block, n)
            block, windows, length, made = [], 0, 0, True
        block.append((r["item"], bytes(r["words"])))
        windows, length = windows + r["windows"], length + len(r["words"])
    if block or not made:
        yield Windows(block, n)


def _each_block(found: Iterator[Windows], one: Callable, stored: Callable[[Windows], DataFrame]):
    """``one`` of a single block, or a list with the rows of ``stored`` for each of several.

    Each of several blocks is a job whose rows are stored, so that a worker holds one block at a time and the driver two.
    """
    block, following = next(found), next(found, None)
    if following is None:
        return one(block)
    out = []
    while block is not None:
        out.append(keep(stored(block)))
        block, following = following, next(found, None)
    return out


def _scan_block(docs: DataFrame, windows: Windows) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(windows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, spans, items = [], [], []
            for words, found, ids, _ in scan_text(batch.column(1), shared.value):
                n.append(words)
                spans.append([{"lo": a, "hi": b} for a, b in found])
                items.append(sorted(ids))
            yield pa.RecordBatch.from_arrays([
                batch.column(0), batch.column(2), pa.array(n, pa.int64()),
                pa.array(spans, pa.list_(pa.struct([("lo", pa.int64()), ("hi", pa.int64())]))),
                pa.array(items, pa.list_(pa.string()))], ["doc_id", "text_hash", "n_words", "spans", "items"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(run, f"doc_id {kind}, text_hash long, n_words long, spans array<struct<lo: bigint, hi: bigint>>, items array<string>")


def contamination(
    docs: DataFrame, benchmark: DataFrame, n: int = WINDOW, id_col: str = "doc_id", text_col: str = "text",
    item_col: str = "item_id", item_text_col: str = "text", block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """One row per document: doc_id, n_words, spans of hit words [lo, hi), sorted item ids."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("text_hash"))
    scan = lambda w: _scan_block(rows, w)
    passes = _each_block(blocks(benchmark, item_col, item_text_col, n, block_bytes), scan, scan)
    if isinstance(passes, DataFrame):
        return passes.drop("text_hash")
    # every pass has each row once; repeated rows stay repeated by their number of rows in one pass
    together = reduce(DataFrame.unionByName, passes).groupBy("doc_id", "text_hash").agg(
        F.first("n_words").alias("n_words"), F.flatten(F.collect_set("spans")).alias("s"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"),
        (F.count(F.lit(1)) / len(passes)).cast("int").alias("copies"))
    merged = F.expr("""
        aggregate(array_sort(s), cast(array() as array<struct<lo: bigint, hi: bigint>>), (acc, x) ->
            if(size(acc) > 0 and x.lo <= acc[size(acc) - 1].hi,
               concat(slice(acc, 1, size(acc) - 1),
                      array(named_struct('lo', acc[size(acc) - 1].lo, 'hi', greatest(acc[size(acc) - 1].hi, x.hi)))),
               concat(acc, array(x))))""")
    return together.withColumn("spans", merged).withColumn("copy", F.explode(F.sequence(F.lit(1), "copies"))).select(
        "doc_id", "n_words", "spans", "items")


def items_digest(items: list[str]) -> str:
    return hashlib.sha256(",".join(items).encode()).hexdigest()


def _without_hits(docs: DataFrame, windows: Windows, text_col: str) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(windows)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [spans for *_, spans in scan_text(batch.column(at), shared.value)]
            yield batch.filter(pa.array([not x for x in found], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def _text_key(text_col: str) -> Column:
    return F.sha2(F.col(f"`{text_col}`"), 256)


def _hit_texts(docs: DataFrame, windows: Windows, text_col: str) -> DataFrame:
    """(hit_key, spans): the hits of a block in the texts that have some, known by the SHA-256 of the text."""
    shared = docs.sparkSession.sparkContext.broadcast(windows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [[dict(zip(SPAN, (*w, *p))) for w, p in zip(words, places)]
                     for _, words, _, places in scan_text(batch.column(0), shared.value)]
            some = [i for i, x in enumerate(found) if x]
            yield pa.RecordBatch.from_arrays(
                [batch.column(1).take(pa.array(some, pa.int64())), pa.array([found[i] for i in some], spans)], ["hit_key", "spans"])

    spans = pa.list_(pa.struct([(c, pa.int64()) for c in SPAN]))
    rows = docs.select(F.col(f"`{text_col}`").alias("text"), _text_key(text_col).alias("hit_key"))
    return rows.mapInArrow(run, f"hit_key string, spans {SPANS}").groupBy("hit_key").agg(F.any_value("spans").alias("spans"))


def merged(spans: list[tuple[int, ...]]) -> list[tuple[int, ...]]:
    """Spans (lo, hi, first byte, last byte) with those joined that overlap or touch in words."""
    out: list[tuple[int, ...]] = []
    for x in sorted(spans):
        if out and x[0] <= out[-1][1]:
            a = out[-1]
            out[-1] = (a[0], max(a[1], x[1]), a[2], max(a[3], x[3]))
        else:
            out.append(x)
    return out


def _with_spans(docs: DataFrame, windows: Windows, at: int, name: str) -> DataFrame:
    """Adds a last column with the spans of a block."""
    shared = docs.sparkSession.sparkContext.broadcast(windows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [[dict(zip(SPAN, (*w, *p))) for w, p in zip(words, places)]
                     for _, words, _, places in scan_text(batch.column(at), shared.value)]
            spans = pa.array(found, pa.list_(pa.struct([(c, pa.int64()) for c in SPAN])))
            yield pa.RecordBatch.from_arrays([*batch.columns, spans], [*batch.schema.names, name])

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField(name, ArrayType(StructType([StructField(c, LongType()) for c in SPAN])))]))


def _cut(rows: DataFrame, docs: DataFrame, at: int) -> DataFrame:
    """The columns of ``docs``, with the spans in the last column of ``rows`` cut out of the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, clean = batch.column(at), []
            for text, spans in zip(texts, batch.column(batch.num_columns - 1).to_pylist()):
                raw, last, parts = (text.as_py() or "").encode(), 0, []
                for *_, first, after in merged([tuple(x.values()) for x in spans]):
                    parts.append(raw[last:first])
                    last = after
                clean.append(b"".join([*parts, raw[last:]]).decode() if spans else text.as_py())
            columns = list(batch.columns[:-1])
            columns[at] = pa.array(clean, texts.type)
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names[:-1])

    return rows.mapInArrow(run, docs.schema)


def _maybe(docs: DataFrame, hits: DataFrame, text_col: str) -> Column:
    """False for texts that are surely not among the hits (first column: their key); never null."""
    keys = hits.select(F.xxhash64(hits.columns[0]).alias("k"))
    return in_bitmap(bitmap(keys, "k"), F.xxhash64(_text_key(text_col))) & F.col(f"`{text_col}`").isNotNull()


def remove_documents(
    docs: DataFrame, benchmark: DataFrame, n: int = WINDOW, text_col: str = "text", item_col: str = "item_id",
    item_text_col: str = "text", block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """The documents without a hit, all columns kept.

    With one block, one pass that moves nothing.  With more, the texts that have hits are stored per block, and documents move
    only where a bitmap of those texts cannot tell that they stay.
    """
    found = _each_block(
        blocks(benchmark, item_col, item_text_col, n, block_bytes), lambda w: w, lambda w: _hit_texts(docs, w, text_col))
    if isinstance(found, Windows):
        return _without_hits(docs, found, text_col)
    gone = reduce(DataFrame.unionByName, found).select(F.col("hit_key").alias(fresh(docs, "hit_key"))).distinct()
    key, maybe = gone.columns[0], _maybe(docs, gone, text_col)
    return docs.filter(~maybe).unionByName(docs.filter(maybe).join(gone, _text_key(text_col) == F.col(key), "left_anti"))


def remove_spans(
    docs: DataFrame, benchmark: DataFrame, n: int = WINDOW, text_col: str = "text", item_col: str = "item_id",
    item_text_col: str = "text", block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """All documents, hit words and what stands between them cut out, once all blocks are looked up."""
    at, name = docs.columns.index(text_col), fresh(docs, "spans")
    found = _each_block(
        blocks(benchmark, item_col, item_text_col, n, block_bytes), lambda w: w, lambda w: _hit_texts(docs, w, text_col))
    if isinstance(found, Windows):
        return _cut(_with_spans(docs, found, at, name), docs, at)
    key = fresh(docs, "hit_key")
    hits = keep(reduce(DataFrame.unionByName, found).groupBy(F.col("hit_key").alias(key)).agg(F.flatten(F.collect_list("spans")).alias(name)))
    maybe = _maybe(docs, hits, text_col)
    met = docs.filter(maybe).join(hits, _text_key(text_col) == F.col(key), "left").drop(key).withColumn(name, F.coalesce(name, F.array()))
    return docs.filter(~maybe).unionByName(_cut(met, docs, at))
