"""Repeated byte strings removed with a sparse, range-partitioned suffix array.

Every byte that a string of ``LENGTH`` bytes covers which also starts in a document with a smaller doc_id is
removed.  A suffix is sorted not for each byte but for each anchor: in every window of ``LENGTH`` bytes the
``GRAM``-byte string with the smallest hash (the leftmost of equal ones).  Equal windows have the same anchor at the same
place, so windows need only be compared with windows of equal anchors, and there is one anchor for about 17
bytes.  Windows that follow each other with one anchor form a chunk.

1. Splitters are quantiles of the leading bytes of sampled suffixes.  Fingerprints of all anchors and chunks are
   range-partitioned by leading bytes.  Leading bytes that span several splitters are spread over the buckets between
   them by anchor; an anchor that is itself that frequent is spread by document.
2. In a bucket, chunks that are equal are settled at once: all but those of the smallest doc_id are removed.
   Where an anchor has different chunks in different documents, the smallest document of each chunk is asked for.
   So it is for anchors that were spread, which compares them across the boundaries of buckets.
3. What was asked for is looked up in the texts, the suffixes themselves are range-partitioned by the same
   splitters and sorted by multikey quicksort over 8-byte words.  Neighbours' common prefixes give the groups of
   equal right parts for each place of the anchor in a window; the left parts decide within them.  Windows of
   anchors that were spread are compared by an aggregation that finds the smallest document of each.
4. Spans are merged per document and cut out.

Texts move only for documents that step 3 or 4 needs.  Fingerprints of anchors and chunks have 48 bits each,
besides the bucket.

Defined cases: null text is empty; a null doc_id counts as larger than any other; rows of one doc_id are never
compared with each other; texts shorter than ``LENGTH`` lose nothing; an empty table gives no rows; doc_id must be
an integer; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigilake.llm import textarrays as ta
from vigilake.llm.common import bitmap, in_bitmap, keep, partitions, store

LENGTH = 50
GRAM = 16
SAMPLE = 16
#: anchors that are packed together on the map side
PACK = 400_000
#: what a bucket says of chunks: to be removed, to be looked at, and to be looked at although they were spread
SPAN, LOOK, SPREAD = 0, 1, 2
_HIGH = np.uint64(0xFFFFFFFF00000000)
_TOP = np.uint64(1 << 63)
_BASE = np.uint64(0x9E3779B97F4A7C15)
#: chunks that a bucket should hold, which bounds the memory of a task
BUCKET = 400_000


def anchors(data: np.ndarray, offsets: np.ndarray, length: int, gram: int) -> dict[str, np.ndarray]:
    """Chunks of a slice of texts: row, first and last window (positions in the slice), anchor and hashes."""
    width = length - gram + 1
    if len(data) < length:
        none = np.zeros(0, np.int64)
        return {"row": none, "lo": none, "hi": none, "at": none, "key": none.astype(np.uint64), "chunk": none.astype(np.uint64), "lead": none.astype(np.uint64)}
    prefix = ta.prefix_hash(data)
    i = np.arange(len(data) - gram + 1)
    hashes = ta.span_hash(prefix, i, i + gram)
    least = (hashes & _HIGH) | i.astype(np.uint64)
    span = 1
    while span * 2 <= width:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    if span < width:
        least = np.minimum(least[:len(least) - (width - span)], least[width - span:])
    at = (least & ~_HIGH).astype(np.int64)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[:len(at)]
    window = np.flatnonzero(np.arange(len(at)) + length <= offsets[row + 1])
    at, row = at[window], row[window]
    first = np.flatnonzero(np.append(True, at[1:] != at[:-1]))[:len(at)]
    last = np.append(first[1:], len(at))[:len(first)] - 1
    lo, hi, at, row = window[first], window[last], at[first], row[first]
    lead = np.zeros(len(at), np.uint64)
    for j in range(8):
        lead = (lead << np.uint64(8)) | data[at + j].astype(np.uint64)
    return {"row": row, "lo": lo, "hi": hi, "at": at, "key": hashes[at], "chunk": ta.span_hash(prefix, lo, hi + length), "lead": lead}


class Buckets:
    """Where suffixes go: ranges of leading bytes; spread values are those that span several splitters."""

    def __init__(self, splitters: list[int], hot: list[int], count: int):
        self.splitters = np.sort(np.array(splitters, np.int64).view(np.uint64) ^ _TOP)
        self.hot = np.sort(np.array(hot, np.int64).view(np.uint64))
        self.count = count

    def ranges(self, lead: np.ndarray, key: np.ndarray) -> np.ndarray:
        left, right = np.searchsorted(self.splitters, lead, "left"), np.searchsorted(self.splitters, lead, "right")
        return left + (key % (right - left + 1).astype(np.uint64)).astype(np.int64)

    def frequent(self, key: np.ndarray) -> np.ndarray:
        if not len(self.hot):
            return np.zeros(len(key), bool)
        return self.hot[np.minimum(np.searchsorted(self.hot, key), len(self.hot) - 1)] == key


def planes(x: np.ndarray, width: int) -> bytes:
    """The low ``width`` bytes of each number, byte by byte, which compresses well."""
    raw = np.ascontiguousarray(x.astype("<u8")).view(np.uint8).reshape(-1, 8)
    return np.ascontiguousarray(raw[:, :width].T).tobytes()


def unplanes(raw: bytes, width: int) -> np.ndarray:
    parts = np.frombuffer(raw, np.uint8).reshape(width, -1)
    out = np.zeros((parts.shape[1], 8), np.uint8)
    out[:, :width] = parts.T
    return out.reshape(-1).view("<u8")


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(
        F.col(id_col).cast("long").alias("doc_id"), text.alias("text"),
        F.xxhash64(text).bitwiseAND(F.lit(0x7FFFFFFF)).cast("long").alias("th"))


def _splitters(rows: DataFrame, least: int, length: int, gram: int) -> Buckets:
    """Ranges of about ``BUCKET`` chunks, ``least`` at least, from a sample of the documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, data, offsets in ta.slices(batch.column(0)):
                got = anchors(data, offsets, length, gram)
                yield pa.RecordBatch.from_arrays(
                    [pa.array((got["lead"] ^ _TOP).view(np.int64)), pa.array(got["key"].view(np.int64))], ["lead", "key"])

    some = rows.filter(F.pmod(F.xxhash64("doc_id", "th"), F.lit(SAMPLE)) == 0)
    sample = keep(some.select("text").mapInArrow(run, "lead long, key long"))
    total = sample.count()
    count = max(least, -(-total * SAMPLE // BUCKET))
    shares = [i / count for i in range(1, count)]
    quantiles = sample.agg(F.percentile_approx("lead", shares or [0.5], 10_000)).first()[0]
    hot = sample.groupBy("key").count().filter(F.col("count") > max(total // (4 * count), 50)).collect()
    return Buckets(list(quantiles or []) if shares else [], [r["key"] for r in hot], count)


def _fingerprints(rows: DataFrame, buckets: Buckets, length: int, gram: int) -> DataFrame:
    """One row per batch, bucket and kind: the packed fingerprints of the anchors that go there."""
    shared = rows.sparkSession.sparkContext.broadcast(buckets)

    def packed(parts: list[tuple], ids: np.ndarray, ths: np.ndarray) -> pa.RecordBatch:
        where, row, lo, more, off, key, chunk = (np.concatenate(x) for x in zip(*parts))
        order = np.argsort(where, kind="stable")
        edges = np.flatnonzero(np.append(True, where[order][1:] != where[order][:-1]))[:len(order)]
        out = []
        for s, e in zip(edges, np.append(edges[1:], len(order))):
            pick = order[s:e]
            r, p = row[pick], lo[pick].astype(np.int64)
            new = np.append(True, r[1:] != r[:-1])
            heads = np.flatnonzero(new)
            step = np.where(new, p, p - np.append(0, p[:-1]))
            own = ids[r[heads]]
            out.append((
                int(where[pick[0]]) // 2, bool(where[pick[0]] % 2), planes(own - np.append(0, own[:-1]), 8), planes(ths[r[heads]], 4),
                planes(np.diff(np.append(heads, len(r))), 4), planes(step, 4), planes(more[pick], 1), planes(off[pick], 1),
                planes(key[pick] >> np.uint64(16), 6), planes(chunk[pick] >> np.uint64(16), 6)))
        columns = list(zip(*out)) if out else [()] * 10
        return pa.RecordBatch.from_arrays(
            [pa.array(columns[0], pa.int32()), pa.array(columns[1], pa.bool_()), *[pa.array(c, pa.binary()) for c in columns[2:]]], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b = shared.value
        for batch in batches:
            ids = batch.column(0).fill_null(np.iinfo(np.int64).max).to_numpy()
            ths = batch.column(2).to_numpy()
            parts, held = [], 0
            for first, _, data, offsets in ta.slices(batch.column(1)):
                got = anchors(data, offsets, length, gram)
                where = b.ranges(got["lead"], got["key"])
                open_ = b.frequent(got["key"])
                if open_.any():
                    spread = ta.mix(ids[got["row"][open_] + first].view(np.uint64)) % np.uint64(b.count)
                    where[open_] = spread.astype(np.int64)
                start = offsets[got["row"]]
                parts.append((
                    (where * 2 + open_).astype(np.int32), (got["row"] + first).astype(np.int32), (got["lo"] - start).astype(np.int32),
                    (got["hi"] - got["lo"]).astype(np.uint8), (got["at"] - got["lo"]).astype(np.uint8), got["key"], got["chunk"]))
                held += len(where)
                if held >= PACK:
                    yield packed(parts, ids, ths)
                    parts, held = [], 0
            if parts:
                yield packed(parts, ids, ths)

    names = ["bucket", "open", "ids", "ths", "counts", "step", "more", "off", "key", "chunk"]
    return rows.mapInArrow(run, "bucket int, open boolean, " + ", ".join(f"{n} binary" for n in names[2:]))


def _settle(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Spans of chunks that are repeated as a whole, and places to look at; a row per document of the bucket."""
    parts = []
    for batch in batches:
        for i in range(batch.num_rows):
            r = {name: batch.column(name)[i].as_py() for name in ("open", "ids", "ths", "counts", "step", "more", "off", "key", "chunk")}
            own = np.cumsum(unplanes(r["ids"], 8).view(np.int64))
            counts, step = unplanes(r["counts"], 4).astype(np.int64), unplanes(r["step"], 4).astype(np.int64)
            heads = np.cumsum(counts) - counts
            total = np.cumsum(step)
            base = np.repeat(total[heads] - step[heads], counts)
            parts.append((
                np.repeat(own, counts), np.repeat(unplanes(r["ths"], 4).astype(np.int64), counts), (total - base).astype(np.int32),
                unplanes(r["more"], 1).astype(np.uint8), unplanes(r["off"], 1).astype(np.uint8), unplanes(r["key"], 6),
                unplanes(r["chunk"], 6), np.full(len(step), r["open"])))
    if not parts:
        return
    doc, th, lo, more, off, key, chunk, open_ = (np.concatenate(x) for x in zip(*parts))
    del parts
    order = np.lexsort((doc, chunk, key))
    k, c, d = key[order], chunk[order], doc[order]
    new_key = np.append(True, k[1:] != k[:-1])
    new_chunk = new_key | np.append(True, c[1:] != c[:-1])
    key_heads, chunk_heads = np.flatnonzero(new_key), np.flatnonzero(new_chunk)
    smallest = d[chunk_heads][np.cumsum(new_chunk) - 1]
    repeated = d > smallest
    group = np.cumsum(new_key) - 1
    kinds = np.add.reduceat(new_chunk.astype(np.int64), key_heads)
    several = (kinds > 1) & (np.minimum.reduceat(d, key_heads) < np.maximum.reduceat(d, key_heads))
    ask = ~repeated & (several[group] | open_[order])
    spread = open_[order]
    for kind, chosen in ((SPAN, order[repeated]), (LOOK, order[ask & ~spread]), (SPREAD, order[ask & spread])):
        chosen = chosen[np.lexsort((lo[chosen], th[chosen], doc[chosen]))]
        if not len(chosen):
            continue
        x, y = doc[chosen], th[chosen]
        heads = np.flatnonzero(np.append(True, (x[1:] != x[:-1]) | (y[1:] != y[:-1])))
        ends = np.append(heads[1:], len(chosen))
        starts, widths, offs = lo[chosen], more[chosen], off[chosen]
        for at in range(0, len(heads), 20_000):
            pick = range(at, min(at + 20_000, len(heads)))
            yield pa.RecordBatch.from_arrays([
                pa.array([kind] * len(pick), pa.int32()), pa.array(x[heads[at:at + 20_000]]), pa.array(y[heads[at:at + 20_000]]),
                pa.array([starts[heads[i]:ends[i]].tobytes() for i in pick], pa.binary()),
                pa.array([widths[heads[i]:ends[i]].tobytes() for i in pick], pa.binary()),
                pa.array([offs[heads[i]:ends[i]].tobytes() for i in pick], pa.binary())], ["kind", "doc_id", "th", "lo", "more", "off"])


def _asked(rows: DataFrame, settled: DataFrame, kind: int) -> DataFrame:
    """The texts in which chunks are to be looked at, with their places; other texts are not moved."""
    wanted = settled.filter(F.col("kind") == kind).groupBy("doc_id", "th").agg(*[F.collect_list(c).alias(c) for c in ("lo", "more", "off")])
    ids = settled.filter(F.col("kind") == kind).select("th")
    near = rows.filter(in_bitmap(bitmap(ids, "th"), F.col("th"))).withColumn("doc_id", F.coalesce("doc_id", F.lit(2**63 - 1)))
    # rows that are repeated ask for the same chunks, which changes nothing
    return near.join(wanted, ["doc_id", "th"]).select("doc_id", "th", "text", "lo", "more", "off")


def _places(batch: pa.RecordBatch, length: int) -> Iterator[tuple]:
    for doc, th, text, los, mores, offs in zip(*(batch.column(i).to_pylist() for i in range(6))):
        lo = np.frombuffer(b"".join(los), np.int32).astype(np.int64)
        end = lo + np.frombuffer(b"".join(mores), np.uint8) + length
        yield doc, th, np.frombuffer(text.encode(), np.uint8), lo, end, np.frombuffer(b"".join(offs), np.uint8).astype(np.int64)


def _cut_out(asked: DataFrame, buckets: Buckets, length: int, gram: int) -> DataFrame:
    """The chunks that were asked for, with the bucket of their suffix."""
    shared = asked.sparkSession.sparkContext.broadcast(buckets)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [
                (np.full(len(lo), doc), np.full(len(lo), th), lo, off, data[(lo + off)[:, None] + np.arange(gram)],
                 [data[a:b].tobytes() for a, b in zip(lo.tolist(), end.tolist())])
                for doc, th, data, lo, end, off in _places(batch, length)]
            if not out:
                continue
            doc, th, lo, off, grams = (np.concatenate([x[i] for x in out]) for i in range(5))
            lead = np.zeros(len(lo), np.uint64)
            for j in range(8):
                lead = (lead << np.uint64(8)) | grams[:, j].astype(np.uint64)
            flat = np.ascontiguousarray(grams).reshape(-1)
            starts = np.arange(0, len(flat), gram)
            key = ta.span_hash(ta.prefix_hash(flat), starts, starts + gram)
            chunks = pa.array([c for x in out for c in x[5]], pa.binary())
            yield pa.RecordBatch.from_arrays([
                pa.array(shared.value.ranges(lead, key), pa.int32()), pa.array(doc, pa.int64()), pa.array(th, pa.int64()),
                pa.array(lo, pa.int32()), pa.array(off, pa.int32()), chunks], ["bucket", "doc_id", "th", "lo", "off", "chunk"])

    return asked.mapInArrow(run, "bucket int, doc_id long, th long, lo int, off int, chunk binary")


def _spread_spans(asked: DataFrame, length: int) -> DataFrame:
    """Spans of windows whose anchors were spread over buckets: the smallest document of each window, by its hashes.

    Minima are combined before the shuffle, so a window that is in a third of all documents is not gathered.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc, th, data, lo, end, _ in _places(batch, length):
                at = np.unique(np.concatenate([np.arange(a, b - length + 1) for a, b in zip(lo.tolist(), end.tolist())]))
                hashes = [ta.span_hash(ta.prefix_hash(x), at, at + length).view(np.int64) for x in (data, data ^ np.uint8(0x5A))]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(at), doc)), pa.array(np.full(len(at), th)), pa.array(at, pa.int32()), *map(pa.array, hashes)],
                    ["doc_id", "th", "at", "h1", "h2"])

    windows = store(asked.mapInArrow(run, "doc_id long, th long, at int, h1 long, h2 long"))
    least = windows.groupBy("h1", "h2").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).filter("least < most").drop("most")
    hit = windows.join(least, ["h1", "h2"]).filter("doc_id > least").select("doc_id", "th", "at")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.column(2).to_numpy().astype(np.int32)
            yield pa.RecordBatch.from_arrays([
                batch.column(0), batch.column(1), pa.array([x.tobytes() for x in at], pa.binary()),
                pa.array([b"\0"] * len(at), pa.binary())], ["doc_id", "th", "lo", "more"])

    return hit.mapInArrow(pack, "doc_id long, th long, lo binary, more binary")


def multikey_order(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, number of leading words shared with the one before): later words are only looked at in ties."""
    n, depth = words.shape
    order = np.arange(n)
    shared = np.zeros(n, np.int64)
    group = np.zeros(n, np.int64)
    tied = np.arange(n)
    for w in range(depth):
        if not len(tied):
            break
        inside = np.lexsort((words[order[tied], w], group[tied]))
        order[tied] = order[tied][inside]
        value, g = words[order[tied], w], group[tied]
        same = np.append(False, (g[1:] == g[:-1]) & (value[1:] == value[:-1]))
        shared[tied[same]] = w + 1
        new = np.cumsum(~same)
        group[tied] = new
        tied = tied[same | np.append(same[1:], False)]
    return order, shared


def _compare(batches: Iterator[pa.RecordBatch], length: int, gram: int) -> Iterator[pa.RecordBatch]:
    """Spans of the windows of a bucket's chunks that start in a smaller document too."""
    tables = [b for b in batches if b.num_rows]
    if not tables:
        return
    table = pa.Table.from_batches(tables).combine_chunks()
    doc, th = table.column("doc_id").to_numpy(), table.column("th").to_numpy()
    lo, off = table.column("lo").to_numpy().astype(np.int64), table.column("off").to_numpy().astype(np.int64)
    raw = table.column("chunk").combine_chunks() if isinstance(table.column("chunk"), pa.ChunkedArray) else table.column("chunk")
    raw = raw.chunk(0) if isinstance(raw, pa.ChunkedArray) else raw
    begin = np.frombuffer(raw.buffers()[1], np.int32)[raw.offset:raw.offset + len(raw) + 1].astype(np.int64)
    data = np.frombuffer(raw.buffers()[2], np.uint8)[begin[0]:begin[-1]]
    begin = begin - begin[0]
    at, end = begin[:-1] + off, begin[1:]
    size = np.minimum(end - at, length)
    depth = -(-length // 8)
    padded = np.append(data, np.zeros(depth * 8, np.uint8))
    suffix = np.zeros((len(at), depth * 8), np.uint8)
    for j in range(length):
        suffix[:, j] = np.where(j < size, padded[at + j] + np.uint8(1), 0)  # no byte of UTF-8 is 255
    words = suffix.view(">u8").astype(np.uint64)
    order, shared = multikey_order(words)
    common = np.minimum(shared * 8, length)
    part = np.flatnonzero((shared < depth) & (np.arange(len(order)) > 0))
    a, b = suffix[order[part]], suffix[order[part - 1]]
    common[part] = np.argmax(np.append(a != b, np.ones((len(part), 1), bool), axis=1), axis=1)
    if len(order):
        common[0] = 0
    common[1:] = np.minimum(common[1:], np.minimum(size[order[1:]], size[order[:-1]]))
    del suffix, words
    first, last = np.full(len(doc), np.iinfo(np.int64).max), np.full(len(doc), -1)
    reach = end - begin[:-1] - length  # windows of the chunk start at 0 .. reach
    lefts = np.zeros(len(doc), np.uint64)  # hash of the o bytes before the anchor
    for o in range(length - gram + 1):
        run_id = np.cumsum(common < length - o)
        if o:
            lefts = lefts * _BASE + padded[np.maximum(at - o, 0)] + np.uint64(1)
        here = np.flatnonzero((o <= off[order]) & (off[order] - o <= reach[order]))
        if not len(here):
            continue
        who = order[here]
        left = ta.mix(lefts[who])
        by = np.lexsort((doc[who], left, run_id[here]))
        r, h, d = run_id[here][by], left[by], doc[who][by]
        new = np.append(True, (r[1:] != r[:-1]) | (h[1:] != h[:-1]))
        smallest = d[np.flatnonzero(new)][np.cumsum(new) - 1]
        hit = who[by][d > smallest]
        start = lo[hit] + off[hit] - o
        first[hit], last[hit] = np.minimum(first[hit], start), np.maximum(last[hit], start)
    hit = np.flatnonzero(last >= 0)
    # windows of one chunk overlap, so their union is one span
    yield pa.RecordBatch.from_arrays([
        pa.array(doc[hit]), pa.array(th[hit]), pa.array([x.tobytes() for x in first[hit].astype(np.int32)], pa.binary()),
        pa.array([x.tobytes() for x in (last[hit] - first[hit]).astype(np.uint8)], pa.binary())], ["doc_id", "th", "lo", "more"])


def merged_spans(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(lo):
        return lo, hi
    order = np.argsort(lo, kind="stable")
    lo, hi = lo[order], np.maximum.accumulate(hi[order])
    new = np.append(True, lo[1:] > hi[:-1])
    heads = np.flatnonzero(new)
    return lo[heads], hi[np.append(heads[1:], len(lo)) - 1]


def repeated_bytes(
    docs: DataFrame, length: int = LENGTH, gram: int = GRAM, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False,
) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256.

    With ``with_text`` also ``kept``, the remaining bytes (binary, as a cut may split a character).
    """
    spark = docs.sparkSession
    rows = _rows(docs, id_col, text_col)
    buckets = _splitters(rows, partitions(spark), length, gram)
    count = buckets.count
    packed = _fingerprints(rows, buckets, length, gram).repartitionById(count, "bucket")
    settled = store(packed.mapInArrow(
        lambda b: _settle(b, length), "kind int, doc_id long, th long, lo binary, more binary, off binary"))
    chunks = _cut_out(_asked(rows, settled, LOOK), buckets, length, gram).repartitionById(count, "bucket")
    compared = store(chunks.mapInArrow(lambda b: _compare(b, length, gram), "doc_id long, th long, lo binary, more binary"))
    every = settled.filter(F.col("kind") == SPAN).select("doc_id", "th", "lo", "more").unionByName(compared)
    if len(buckets.hot):
        every = every.unionByName(store(_spread_spans(_asked(rows, settled, SPREAD), length)))
    spans = every.groupBy("doc_id", "th").agg(F.collect_list("lo").alias("lo"), F.collect_list("more").alias("more"))
    ids = every.select("th")
    touched = in_bitmap(bitmap(ids, "th"), F.col("th"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            removed, n_spans, sha, kept = [], [], [], []
            for text, los, mores in zip(batch.column(1), batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                raw = text.as_py().encode()
                lo = np.frombuffer(b"".join(los or []), np.int32).astype(np.int64)
                hi = lo + np.frombuffer(b"".join(mores or []), np.uint8) + length
                lo, hi = merged_spans(lo, hi)
                stay = b"".join(raw[a:b] for a, b in zip([0, *hi.tolist()], [*lo.tolist(), len(raw)]))
                removed.append(len(raw) - len(stay))
                n_spans.append(len(lo))
                sha.append(hashlib.sha256(stay).hexdigest())
                kept.append(stay)
            out = [batch.column(0), batch.column(4), pa.array(removed, pa.int64()), pa.array(n_spans, pa.int64()), pa.array(sha, pa.string())]
            yield pa.RecordBatch.from_arrays([*out, pa.array(kept, pa.binary())] if with_text else out, names)

    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", *(["kept"] if with_text else [])]
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", kept binary" if with_text else "")
    rows = rows.withColumn("n_bytes", F.octet_length("text").cast("long"))
    spans = spans.withColumnRenamed("doc_id", "_id").withColumnRenamed("th", "_th")
    joined = rows.filter(touched).join(
        spans, (F.coalesce("doc_id", F.lit(2**63 - 1)) == F.col("_id")) & (F.col("th") == F.col("_th")), "left")
    changed = joined.select("doc_id", "text", "lo", "more", "n_bytes").mapInArrow(cut, schema)
    raw = F.col("text").cast("binary")
    whole = rows.filter(~touched).select(
        "doc_id", "n_bytes", F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"),
        F.sha2(raw, 256).alias("kept_sha256"), *([raw.alias("kept")] if with_text else []))
    return changed.unionByName(whole)
