"""Near duplicates by an n-gram Jaccard join with several global token orders.

A document is the set of its word shingles.  Documents with equal sets are one class; only classes are joined.

Orders.  A global order puts rare shingles first; how rare one is comes from a table of counts over all documents
(``SKETCH_BITS`` bits of the shingle's hash, so its size does not depend on the data), ties go by hash.  Two such
orders with different tables and hashes, and ``STARS`` purely random ones, are used.

1. The first shingle of a class in each random order puts it into ``STARS`` groups; it is compared with the
   most central class of each group, the one whose shingles are the most frequent.  Verified links give
   components, in which nearly all copies of a text meet without comparing them pair by pair.
2. Two sets of the wanted similarity share a shingle among the first n - ceil(t n) + 1 of either set in every
   order.  Classes of *different* components that share a prefix shingle in the first rarity order are
   candidates; those that share none in the second are dropped; the rest are verified.  So no link between
   components is lost, and the pairs inside a component are never listed.

A shingle whose classes are all in one component yields nothing, whatever their number.  Of the others, the
classes outside the shingle's largest component are paired with all whose parities allow the similarity: two sets
differ in at least as many shingles as their parities differ in bits.

Defined cases: null, empty and blank texts have no shingles, are linked with nothing and are their own
component; a text of fewer words is one shingle; a null doc_id counts in links but is no component_id unless
the component has no other; repeated rows fall into one class; an empty table gives no rows; other columns are
kept by ``keep_first`` and only read to choose one of several rows of equal doc_id and text.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigilake.llm import textarrays as ta
from vigilake.llm.common import bitmap, fresh, in_bitmap, keep, store
from vigilake.llm.components import components

STARS = 4
SKETCH_BITS = 16
SKETCH_PARTS = 64
#: parities of a set: how often its shingles fall on each of so many places, modulo 2
SIGN_BITS = 512
#: shingles before each prefix shingle that travel with it, so that a pair is made at few of its common shingles
EARLIER = 6
#: members that one copy of a star's centre is compared with
PER_CENTRE = 512
_SALTS = [np.uint64(x) for x in (0x243F6A8885A308D3, 0x13198A2E03707344, 0xA4093822299F31D0, 0x082EFA98EC4E6C89, 0x452821E638D01377)]


def _other(s: np.ndarray) -> np.ndarray:
    """The hash of the second rarity order."""
    return ta.mix(s ^ _SALTS[4])


def _node(s: np.ndarray) -> bytes:
    """128 bits that stand for a set."""
    return np.array([s.sum(dtype=np.uint64), ta.mix(s ^ _SALTS[0]).sum(dtype=np.uint64)], np.uint64).tobytes()


def _sign(s: np.ndarray) -> np.ndarray:
    """Parities of a set.  Those of two sets differ where those of their symmetric difference are odd."""
    places = np.bincount((s & np.uint64(SIGN_BITS - 1)).astype(np.int64), minlength=SIGN_BITS)
    return np.packbits((places & 1).astype(np.uint8)).view(np.int64)


def prefix_length(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1


def _profile(rows: DataFrame, k: int) -> DataFrame:
    """A row per document (n, node, first shingles of the random orders), and the tables of counts in parts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = np.zeros((2, 1 << SKETCH_BITS), np.int64)
        kind = None
        for batch in batches:
            kind = batch.column(0).type
            n, nodes, stars = [], [], []
            for _, _, data, offsets in ta.slices(batch.column(1)):
                sets = ta.shingle_sets(data, offsets, k)
                every = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
                sketch[0] += np.bincount((every >> np.uint64(64 - SKETCH_BITS)).astype(np.int64), minlength=1 << SKETCH_BITS)
                sketch[1] += np.bincount((_other(every) >> np.uint64(64 - SKETCH_BITS)).astype(np.int64), minlength=1 << SKETCH_BITS)
                lengths = np.array([len(s) for s in sets])
                filled = np.flatnonzero(lengths)
                starts = (np.cumsum(lengths) - lengths)[filled]
                first = np.zeros((len(sets), STARS), np.uint64)
                for j in range(STARS if len(filled) else 0):
                    first[filled, j] = np.minimum.reduceat(ta.mix(every ^ _SALTS[j]), starts)
                n += lengths.tolist()
                nodes += [_node(s) if len(s) else None for s in sets]
                stars += [first[i].view(np.int64) if lengths[i] else None for i in range(len(sets))]
            yield pa.RecordBatch.from_arrays([
                batch.column(0), batch.column(2), pa.array(n, pa.int64()), pa.array(nodes, pa.binary()),
                pa.array(stars, pa.list_(pa.int64())), pa.nulls(len(n), pa.int32()), pa.nulls(len(n), pa.list_(pa.int64()))], names)
        if kind is not None:
            parts = sketch.reshape(SKETCH_PARTS, -1)
            size = len(parts)
            yield pa.RecordBatch.from_arrays([
                pa.nulls(size, kind), pa.nulls(size, pa.int64()), pa.nulls(size, pa.int64()), pa.nulls(size, pa.binary()),
                pa.nulls(size, pa.list_(pa.int64())), pa.array(range(size), pa.int32()), pa.array(list(parts), pa.list_(pa.int64()))], names)

    names = ["doc_id", "text_hash", "n", "node", "stars", "part", "counts"]
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, text_hash long, n long, node binary, stars array<long>, part int, counts array<long>")


def _sketch(profile: DataFrame) -> np.ndarray:
    """Both tables of counts, summed over all tasks: a fixed number of numbers."""

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, counts in zip(batch.column(0).to_pylist(), batch.column(1)):
                x = counts.values.to_numpy()
                sums[part] = sums[part] + x if part in sums else x.copy()
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(sums), pa.int32()), pa.array(list(sums.values()), pa.list_(pa.int64()))], ["part", "counts"])

    rows = profile.filter("part is not null").select("part", "counts").repartition(SKETCH_PARTS, "part").mapInArrow(
        total, "part int, counts array<long>").collect()
    out = np.zeros((SKETCH_PARTS, (2 << SKETCH_BITS) // SKETCH_PARTS), np.int64)
    for r in rows:
        out[r["part"]] += np.array(r["counts"], np.int64)
    return np.minimum(out.reshape(2, -1), 2**31 - 1).astype(np.int32)


def _prefixes(rows: DataFrame, k: int, percent: int, sketch: np.ndarray) -> DataFrame:
    """(node, first, last, second, central, sign): prefix shingles in the two rarity orders, the rank of the last of
    the first, how frequent the shingles are, and the set's parities.

    A set is sent once per task.
    """
    shared = rows.sparkSession.sparkContext.broadcast(sketch)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, seen = shared.value, set()
        for batch in batches:
            nodes, first, last, second, central, sign = [], [], [], [], [], []
            for _, _, data, offsets in ta.slices(batch.column(0)):
                for s in ta.shingle_sets(data, offsets, k):
                    if not len(s) or (node := _node(s)) in seen:
                        continue
                    seen.add(node)
                    size = prefix_length(len(s), percent)
                    t = _other(s)
                    nodes.append(node)
                    sign.append(_sign(s))
                    rank = counts[0][(s >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)]
                    central.append(float(np.log(rank).mean()))
                    order = np.lexsort((s, rank))[:size]
                    first.append(s[order].view(np.int64))
                    last.append(int(rank[order[-1]]).to_bytes(4, "big") + int(s[order[-1]]).to_bytes(8, "big"))
                    order = np.lexsort((t, counts[1][(t >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)]))[:size]
                    second.append((t[order] & np.uint64(0x7FFFFFFF)).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [pa.array(nodes, pa.binary()), pa.array(first, pa.list_(pa.int64())), pa.array(last, pa.binary()),
                 pa.array(second, pa.list_(pa.int32())), pa.array(central, pa.float64()), pa.array(sign, pa.list_(pa.int64()))],
                ["node", "first", "last", "second", "central", "sign"])

    return rows.select("text").mapInArrow(run, "node binary, first array<long>, last binary, second array<int>, central double, sign array<long>")


def _sets(rows: DataFrame, k: int, wanted: DataFrame) -> DataFrame:
    """(cid, left, right, items): the sets of the wanted classes (cid, node, text_hash, left, right).

    48 bits of each shingle's hash, so that two sets of 100,000 shingles share one by chance once in 28,000 pairs.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()
        for batch in batches:
            for _, _, data, offsets in ta.slices(batch.column(0)):
                got = {}
                for s in ta.shingle_sets(data, offsets, k):
                    if len(s) and (node := _node(s)) not in seen:
                        seen.add(node)
                        got[node] = (s >> np.uint64(16)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()
                yield pa.RecordBatch.from_arrays([pa.array(list(got), pa.binary()), pa.array(list(got.values()), pa.binary())], ["node", "items"])

    near = rows.filter(in_bitmap(bitmap(wanted, "text_hash"), F.col("text_hash"))).select("text")
    sets = near.mapInArrow(run, "node binary, items binary")
    return sets.join(wanted.select("cid", "node", "left", "right"), "node").groupBy("cid", "left", "right").agg(F.first("items").alias("items"))


def _unpacked(raw) -> np.ndarray:
    out = np.zeros((len(raw) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(raw, np.uint8).reshape(-1, 6)
    return out.reshape(-1).view("<u8")


def _verified(rows: DataFrame, classes: DataFrame, pairs: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets have the wanted similarity."""
    spark = rows.sparkSession
    pairs = keep(pairs)
    ends = pairs.select(F.explode(F.array(F.struct(F.col("a").alias("cid"), F.lit(True).alias("l")), F.struct(F.col("b").alias("cid"), F.lit(False).alias("l")))).alias("e"))
    ends = ends.groupBy("e.cid").agg(F.bool_or("e.l").alias("left"), F.bool_or(~F.col("e.l")).alias("right"))
    wanted = keep(classes.select("cid", "node", "text_hash").join(ends, "cid"))
    sets = keep(_sets(rows, k, wanted))
    # a class with many partners is sent in several copies, each for some of them
    slots = pairs.groupBy("a").agg((F.floor(F.count(F.lit(1)) / PER_CENTRE) + 1).alias("slots"))
    salted = pairs.join(slots, "a").withColumn("slot", F.pmod(F.xxhash64("b"), F.col("slots"))).drop("slots")
    centres = slots.join(sets.filter("left").select(F.col("cid").alias("a"), F.col("items").alias("x")), "a").withColumn(
        "slot", F.explode(F.sequence(F.lit(0).cast("long"), F.col("slots") - 1))).drop("slots")
    members = sets.filter("right").select(F.col("cid").alias("b"), F.col("items").alias("y"))
    both = salted.join(centres, ["a", "slot"]).join(members, "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for x, y in zip(batch.column(2), batch.column(3)):
                x, y = _unpacked(x.as_buffer()), _unpacked(y.as_buffer())
                common = len(np.intersect1d(x, y, assume_unique=True))
                good.append(100 * common >= percent * (len(x) + len(y) - common))
            yield batch.select([0, 1]).filter(pa.array(good, pa.bool_()))

    return both.select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def _alike(left: Column, right: Column, percent: int) -> Column:
    """Sizes that allow the similarity."""
    return F.least(left, right) * 100 >= F.greatest(left, right) * percent


def _star_pairs(classes: DataFrame, percent: int) -> DataFrame:
    """Every class with the most central one of each of its groups: the text that the others are edits of, if it is there."""
    groups = classes.select("cid", "n", "central", F.posexplode("stars").alias("j", "key"))
    centre = groups.groupBy("j", "key").agg(
        F.max(F.struct("central", "cid", "n")).alias("c"), F.count(F.lit(1)).alias("size")).filter("size > 1")
    met = groups.join(centre, ["j", "key"]).filter((F.col("cid") != F.col("c.cid")) & _alike(F.col("n"), F.col("c.n"), percent))
    return met.select(F.col("c.cid").alias("a"), F.col("cid").alias("b")).distinct()


def _prefix_pairs(prefixes: DataFrame, percent: int) -> DataFrame:
    """Pairs of classes of different components that pass the filters of both rarity orders.

    A pair is made at its first common shingle in the first order: what comes before it in either set is not in the
    other, which bounds the overlap by the two positions.  Of two prefixes, the one whose last shingle comes first
    in the order lies wholly within the range of the other: what it does not share with the other prefix is not in
    the other set at all, which bounds the overlap again.
    """
    # the few shingles before each one: where two sets share one of them too, their pair is made there and not again
    before = F.transform("first", lambda t, i: F.struct(t.alias("token"), F.slice(
        "first", F.greatest(i - EARLIER, F.lit(0)) + 1, F.least(i, F.lit(EARLIER))).alias("prev")))
    keyed = prefixes.select(F.posexplode(before).alias("pos", "at"), "cid", "comp", "n").select("pos", "at.token", "at.prev", "cid", "comp", "n")
    # the most that may come before the first common shingle, whatever the partner's size
    keyed = keyed.filter(F.col("pos") <= F.col("n") - F.ceil(F.col("n") * percent / F.lit(100)))
    several = keep(keyed.groupBy("token").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo < hi").select("token"))
    # most shingles are in one component only: their rows are not moved
    near = keyed.filter(in_bitmap(bitmap(several, "token"), F.col("token")))
    mixed = keep(near.join(several, "token").join(prefixes.select("cid", "sign"), "cid"))
    largest = mixed.groupBy("token", "comp").agg(F.count(F.lit(1)).alias("c")).groupBy("token").agg(F.max_by("comp", F.struct("c", "comp")).alias("top"))
    outside = mixed.join(largest, "token").filter("comp <> top").select("token", *[F.col(c).alias(f"x_{c}") for c in ("cid", "comp", "n", "pos", "sign", "prev")])
    need = F.ceil((F.col("x_n") + F.col("n")) * percent / F.lit(100 + percent))
    odd = reduce(add, [F.bit_count(F.col("x_sign")[i].bitwiseXOR(F.col("sign")[i])) for i in range(SIGN_BITS // 64)])
    met = outside.join(mixed, "token").filter(
        (F.col("x_comp") != F.col("comp")) & _alike(F.col("x_n"), F.col("n"), percent)
        & (F.col("x_pos") <= F.col("x_n") - need) & (F.col("pos") <= F.col("n") - need)
        & (odd <= F.col("x_n") + F.col("n") - 2 * need) & ~F.arrays_overlap("x_prev", "prev"))
    pairs = met.select(F.least("x_cid", "cid").alias("a"), F.greatest("x_cid", "cid").alias("b")).distinct()
    facts = prefixes.select("cid", "n", "first", "last", "second")
    for side in ("a", "b"):
        pairs = pairs.join(facts.select(*[F.col(c).alias(side if c == "cid" else f"{side}_{c}") for c in facts.columns]), side)
    overlap = F.ceil((F.col("a_n") + F.col("b_n")) * percent / F.lit(100 + percent))
    shared = F.size(F.array_intersect("a_first", "b_first"))
    missing = [F.size(f"{s}_first") - shared <= F.col(f"{s}_n") - overlap for s in ("a", "b")]
    bound = F.when(F.col("a_last") <= F.col("b_last"), missing[0]).otherwise(missing[1])
    return pairs.filter(bound & F.arrays_overlap("a_second", "b_second")).select("a", "b")


def _classes(docs: DataFrame, k: int, percent: int, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """(profile of the documents, (cid, comp) of classes that are linked)."""
    spark = docs.sparkSession
    rows = docs.select(
        F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("text_hash", F.xxhash64("text"))
    profile = store(_profile(rows, k))
    documents = profile.filter("part is null").select("doc_id", "text_hash", "n", "node", "stars")
    classes = keep(documents.filter("n > 0").groupBy("node").agg(
        *[F.first(c).alias(c) for c in ("n", "stars")], F.min("text_hash").alias("text_hash")).withColumn(
        "cid", F.monotonically_increasing_id()))
    prefixes = keep(_prefixes(rows, k, percent, _sketch(profile)).groupBy("node").agg(
        *[F.first(c).alias(c) for c in ("first", "last", "second", "central", "sign")]).join(
        classes.select("cid", "node", "n", "stars"), "node").drop("node"))
    links = keep(_verified(rows, classes, _star_pairs(prefixes, percent), k, percent))
    joined = components(links.select(F.col("a").alias("u"), F.col("b").alias("v")))
    known = prefixes.drop("stars").join(
        joined.select(F.col("u").alias("cid"), F.col("v").alias("comp")), "cid", "left").withColumn("comp", F.coalesce("comp", "cid"))
    more = keep(_verified(rows, classes, _prefix_pairs(known, percent), k, percent))
    every = joined.unionByName(more.select(F.col("a").alias("u"), F.col("b").alias("v")))
    final = components(every)
    return documents, classes.select("cid", "node").join(
        final.select(F.col("u").alias("cid"), F.col("v").alias("comp")), "cid", "left").withColumn("comp", F.coalesce("comp", "cid"))


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (smallest doc_id that links reach), component_size."""
    documents, member = _classes(docs, words, percent, id_col, text_col)
    linked = documents.filter("n > 0").select("doc_id", "n", "node").groupBy("node").agg(
        F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("rows")).join(member, "node")
    total = linked.groupBy("comp").agg(F.min("least").alias("component_id"), F.sum("rows").alias("component_size"))
    named = keep(linked.select("node", "comp").join(total, "comp").drop("comp"))
    return documents.join(named, "node", "left").select(
        "doc_id", F.col("n").alias("n_shingles"),
        F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"),
        F.coalesce("component_size", F.lit(1)).cast("long").alias("component_size"))


def keep_first(docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Of each component one row, all columns kept: the smallest doc_id, nulls last, then the smallest hash of the text.

    Rows that agree in both are told apart by their other columns.  Rows without shingles all stay.  Documents move
    only where a bitmap of the (doc_id, text) that change cannot tell that they stay.
    """
    documents, member = _classes(docs, words, percent, id_col, text_col)
    linked = documents.filter("n > 0").select("doc_id", "text_hash", "node")
    place = F.struct(F.col("doc_id").isNull().alias("nul"), "doc_id", "text_hash")
    least = linked.groupBy("node").agg(F.min(place).alias("least"), F.count(F.lit(1)).alias("rows")).join(member, "node")
    first = least.groupBy("comp").agg(F.min("least").alias("first"), F.sum("rows").alias("size")).filter("size > 1")
    named = keep(least.select("node", "comp").join(first, "comp").select("node", "first"))
    same = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("text_hash") == F.col("first.text_hash"))
    gid, ghash, gkey = (fresh(docs, c) for c in ("gone_id", "gone_hash", "gone_key"))
    changed = keep(
        linked.join(named, "node").groupBy(F.col("doc_id").alias(gid), F.col("text_hash").alias(ghash), same.alias("first"))
        .agg(F.count(F.lit(1)).alias("rows")).filter("not first or rows > 1").withColumn(gkey, F.xxhash64(gid, ghash)))
    own_id, own_hash = F.col(f"`{id_col}`"), F.xxhash64(F.coalesce(F.col(f"`{text_col}`"), F.lit("")))
    own_key = F.xxhash64(own_id, own_hash)
    met = own_id.eqNullSafe(F.col(gid)) & (own_hash == F.col(ghash))
    maybe = in_bitmap(bitmap(changed, gkey), own_key)
    out = docs.filter(~maybe).unionByName(docs.filter(maybe).join(changed.select(gid, ghash), met, "left_anti"))
    repeated = changed.filter("first").select(gid, ghash, gkey)
    if repeated.isEmpty():
        return out
    rows = docs.filter(in_bitmap(bitmap(repeated, gkey), own_key)).join(repeated.select(gid, ghash), met, "left_semi")
    hashed = [F.col(f"`{f.name}`") for f in docs.schema if "map<" not in f.dataType.simpleString()]
    one = rows.groupBy(own_id.alias(gid), own_hash.alias(ghash)).agg(
        F.min_by(F.struct(*[F.col(f"`{c}`") for c in docs.columns]), F.xxhash64(*hashed)).alias("row"))
    return out.unionByName(one.select(*[F.col("row").getField(c).alias(c) for c in docs.columns]))
