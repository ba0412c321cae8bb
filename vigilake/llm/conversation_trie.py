"""The prefix trie of conversations: who shares which turns, and what sharing them saves.

A conversation begins with the first h turns of its base conversation and goes on with its own turns after its first h.
Every distinct sequence of first d turns is a node.

1. Texts are hashed where they are read and never moved.  The turns of all conversations, base turns among them, are sorted
   by range; running counts and an exclusive-or of (depth, turn) hashes give each turn its node.  A conversation
   may lie in several partitions: what a partition hands on to the next is a few numbers, gathered per partition.
2. Nodes are aggregated by hash.  Nodes of one conversation only form tails, of which just the top goes into the trie.
3. Of a node's children the one with most conversations is heavy, the others light.  A path has at most log2 light nodes, and
   the list of those orders all nodes in preorder: the heavy path top down, then its light children, deepest first.
4. That order is cut into shards.  A shard is a sequence of balanced parentheses (``Parentheses``): the path above its
   first node, the spine, is opened in front, what is open in the end is closed.  ``find_close`` delimits subtrees, the
   rank of pairs "()" counts leaves, cumulative arrays give what a subtree saves.
5. Nodes that are open at the end of a shard go on as spines of later shards; their sums are merged by node.
6. Ids of the conversations that end at a node are sorted by range, joined in runs and hashed run by run.

Defined cases: rows without conv_id belong to no conversation; null role or text is empty; turns of equal number are ordered by the
hashes of role and text; repeated rows are turns of their own; a conversation whose base is absent has only its own
turns after the first h; conversations without turns are members of the root; no conversations, no nodes; conv_id and
turn must be integers; other columns are not read.  Nodes are told apart by 128 bits of hashes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vigilake.llm import textarrays as ta
from vigilake.llm.common import bitmap, in_bitmap, keep, partitions, store
from vigilake.llm.parentheses import Parentheses

#: conversations of a family have the base with the same id divided by FAMILY; they take fewer than HEADS turns of it
FAMILY, HEADS = 5, 9
#: nodes of a shard
SHARD = 250_000
#: bytes of a run of ids
RUN = 1 << 16
_K1, _K2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_NOTHING = hashlib.sha256(b"").hexdigest()


def shared_turns(conv_id: Column) -> Column:
    """How many turns a conversation takes from its base, at most."""
    return F.crc32(conv_id.cast("string").cast("binary")) % HEADS


def _turns(conversations: DataFrame) -> DataFrame:
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    return conversations.filter("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("c"), F.col("turn").cast("long").alias("turn"), F.xxhash64(role, text).alias("t1"),
        F.xxhash64(F.lit(1), text, role).alias("t2"), F.octet_length(text).cast("long").alias("nb"))


def _laid_out(turns: DataFrame) -> DataFrame:
    """(c, kind, turn, t1, t2, nb): a row of kind -1 per conversation, base turns as kind 0, its own as kind 1."""
    ids = turns.select("c").distinct()
    based = ids.filter(F.col("c") % FAMILY != 0).withColumn("h", shared_turns(F.col("c"))).filter("h > 0").withColumn(
        "b", F.col("c") - F.col("c") % FAMILY)
    by = Window.partitionBy("c").orderBy("turn", "t1", "t2")
    # the limit is applied before the rows are moved
    first = turns.filter(F.col("c") % FAMILY == 0).withColumn("j", F.row_number().over(by)).filter(F.col("j") < HEADS)
    heads = based.join(first.select(F.col("c").alias("b"), "j", "t1", "t2", "nb"), "b").filter("j <= h").select(
        "c", F.lit(0).alias("kind"), F.col("j").cast("long").alias("turn"), "t1", "t2", "nb")
    none = F.lit(0).cast("long")
    roots = ids.select("c", F.lit(-1).alias("kind"), none.alias("turn"), none.alias("t1"), none.alias("t2"), none.alias("nb"))
    own = turns.select("c", F.lit(1).alias("kind"), "turn", "t1", "t2", "nb")
    return roots.unionByName(heads).unionByName(own)


class _Running:
    """Counts and exclusive-ors along a sorted run of turns; goes on from batch to batch."""

    def __init__(self, conv: int | None, base: int, own: int):
        self.conv, self.base, self.own, self.x, self.open, self.began = conv, base, own, [np.uint64(0)] * 2, False, False

    def take(self, batch: pa.RecordBatch) -> dict[str, np.ndarray]:
        """The rows that belong to rebuilt conversations, with depth and hashes of the node and its parent.

        ``open``: the conversation began in an earlier partition, whose part of the hashes is still missing.
        """
        c, kind, t1, t2, nb, skip = (batch.column(i).to_numpy() for i in range(6))
        new = np.append(self.conv is None or c[0] != self.conv, c[1:] != c[:-1])
        if not self.began:
            self.open, self.began = not new[0], True
        part = np.cumsum(new)
        starts = np.flatnonzero(new)

        def counted(flags: np.ndarray, before: int) -> np.ndarray:
            total = np.cumsum(flags)
            return total - np.append(-before, total[starts] - flags[starts])[part]

        base, own = counted((kind == 0).astype(np.int64), self.base), counted((kind == 1).astype(np.int64), self.own)
        stays = (kind < 1) | (own > skip)
        depth = np.where(kind < 0, 0, np.where(kind == 0, base, base + own - skip))
        place = ta.mix(depth.astype(np.uint64) * _K1 + _K2)
        out = {"c": c, "d": depth, "nb": nb, "open": (part == 0) & self.open}
        for i, t in enumerate((t1, t2)):
            mine = np.where(stays & (kind >= 0), ta.mix(t.view(np.uint64) ^ place ^ (_K1 if i else _K2)), np.uint64(0))
            total = np.bitwise_xor.accumulate(mine)
            x = total ^ np.append(self.x[i], total[starts] ^ mine[starts])[part]
            out[f"x{i + 1}"], out[f"p{i + 1}"] = x.view(np.int64), (x ^ mine).view(np.int64)
            self.x[i] = x[-1]
        self.conv, self.base, self.own = c[-1], int(base[-1]), int(own[-1])
        self.open = self.open and part[-1] == 0
        return {k: v[stays] for k, v in out.items()}


_MEMBER = "pid int, c long, d long, nb long, x1 long, x2 long, p1 long, p2 long, open boolean, head boolean, tail boolean, last boolean"


def _members(conversations: DataFrame) -> DataFrame:
    """A row per conversation and node on its path: c, d, nb, (x1, x2), its parent (p1, p2), and whether it is the last."""
    spark = conversations.sparkSession
    # the hashes, not the texts, are what all that follows reads
    turns = store(_turns(conversations))
    order = ["c", "kind", "turn", "t1", "t2"]
    skip = F.when((F.col("kind") == 1) & (F.col("c") % FAMILY != 0), shared_turns(F.col("c"))).otherwise(0).cast("long")
    placed = keep(_laid_out(turns).repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order).select(
        "c", F.col("kind").cast("long").alias("kind"), "t1", "t2", "nb", skip.alias("skip"), F.spark_partition_id().alias("pid")))

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = last = pid = None
        base = own = 0
        for batch in batches:
            c, kind = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            if not len(c):
                continue
            first, pid = (int(c[0]), batch.column(6)[0].as_py()) if first is None else (first, pid)
            since = np.flatnonzero(c == c[-1])
            if last != c[-1]:
                base = own = 0
            last = int(c[-1])
            base, own = base + int((kind[since] == 0).sum()), own + int((kind[since] == 1).sum())
        if first is not None:
            yield pa.RecordBatch.from_pylist([{"pid": pid, "first": first, "last": last, "base": base, "own": own}])

    carried, at = {}, (None, 0, 0)
    for r in sorted(placed.mapInArrow(ends, "pid long, first long, last long, base long, own long").collect()):
        carried[r.pid] = at
        goes_on = r.first == at[0] == r.last
        at = (r.last, r.base + at[1] * goes_on, r.own + at[2] * goes_on)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, held, pid, first = None, None, 0, True
        names = ["c", "d", "nb", "x1", "x2", "p1", "p2", "open"]

        def rows(got: dict[str, np.ndarray], tail: bool) -> pa.RecordBatch:
            nonlocal first
            n = len(got["c"])
            head = np.zeros(n, bool)
            head[:1] = first
            first = False
            last = np.append(got["c"][1:] != got["c"][:-1], False)
            return pa.RecordBatch.from_arrays(
                [pa.array(np.full(n, pid, np.int32)), *[pa.array(got[k]) for k in names], pa.array(head),
                 pa.array(np.append(np.zeros(n - 1, bool), tail)), pa.array(last)], ["pid", *names, "head", "tail", "last"])

        for batch in batches:
            if not batch.num_rows:
                continue
            if state is None:
                pid = batch.column(6)[0].as_py()
                state = _Running(*carried[pid])
            got = state.take(batch)
            # the last row waits for the next one, which tells whether its conversation goes on
            got = {k: np.append(held[k], v) for k, v in got.items()} if held else got
            if not len(got["c"]):
                continue
            held = {k: v[-1:] for k, v in got.items()}
            if len(got["c"]) > 1:
                out = rows(got, False)
                yield out.slice(0, out.num_rows - 1)
        if held:
            yield rows(held, True)

    local = store(placed.mapInArrow(run, _MEMBER))
    edges = sorted(local.filter("head or tail").select("pid", "head", "tail", "c", "x1", "x2", "open").collect())
    heads, tails = [r for r in edges if r.head], [r for r in edges if r.tail]
    after, x1, x2 = [], 0, 0
    for i, r in enumerate(tails):
        after.append((r.pid, x1, x2, i + 1 == len(tails) or heads[i + 1].c != r.c))
        x1, x2 = (x1 ^ r.x1, x2 ^ r.x2) if r.open else (r.x1, r.x2)
    carry = spark.createDataFrame(after, "pid int, y1 long, y2 long, ends boolean")
    fixed = [F.when(F.col("open"), F.col(f"{k}{i}").bitwiseXOR(F.col(f"y{i}"))).otherwise(F.col(f"{k}{i}")).alias(f"{k}{i}")
             for k in ("x", "p") for i in (1, 2)]
    # one row per partition
    return local.join(F.broadcast(carry), "pid").select(
        "c", "d", "nb", *fixed, F.when(F.col("tail"), F.col("ends")).otherwise(F.col("last")).alias("last"))


def _ends(members: DataFrame, nodes: DataFrame) -> DataFrame:
    """(x1, x2, sha) of nodes at which several conversations end: their ids, ascending, go through the hash run by run."""
    several = nodes.filter("n_ends > 1").select("x1", "x2")
    n = partitions(members.sparkSession)
    ids = members.filter("last").join(several, ["x1", "x2"], "left_semi").select("x1", "x2", "c")

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, held, size = [], [], 0
        at = None
        for batch in batches:
            for x1, x2, c in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if held and ((x1, x2) != at or size > RUN):
                    out.append((*at, held[0], ",".join(map(str, held))))
                    held, size = [], 0
                if len(out) >= 1000:
                    yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out), kinds)], names)
                    out = []
                at = (x1, x2)
                held.append(c)
                size += len(str(c)) + 1
        if held:
            out.append((*at, held[0], ",".join(map(str, held))))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out), kinds)], names)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, state, out = None, None, []
        for batch in batches:
            for x1, x2, ids in zip(*(batch.column(i).to_pylist() for i in (0, 1, 3))):
                if (x1, x2) == at:
                    state.update(b"," + ids.encode())
                    continue
                if at:
                    out.append((*at, state.hexdigest()))
                at, state = (x1, x2), hashlib.sha256(ids.encode())
        if at:
            out.append((*at, state.hexdigest()))
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*out)], ["x1", "x2", "sha"])

    names, kinds = ["x1", "x2", "least", "ids"], [pa.int64(), pa.int64(), pa.int64(), pa.string()]
    packed = ids.repartitionByRange(n, "x1", "x2", "c").sortWithinPartitions("x1", "x2", "c").mapInArrow(
        runs, "x1 long, x2 long, least long, ids string")
    return packed.repartition(n, "x1", "x2").sortWithinPartitions("x1", "x2", "least").mapInArrow(hashed, "x1 long, x2 long, sha string")


_ENTRY = "pid int, depth long, conv_id long, n_convs long, nb long, n_children long, n_ends long, end_c long, x1 long, x2 long"
_SHARD = "kind string, " + _ENTRY + ", parent_conv_id long, n_leaves long, saved long, open boolean"


def _shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Subtree sums of a shard's nodes, as far as they lie in it, and those of its spine (kind ``spine``)."""
    tables = [b for b in batches if b.num_rows]
    if not tables:
        return
    table = pa.Table.from_batches(tables).combine_chunks()
    depth, conv, convs, nb, children = (table.column(c).to_numpy() for c in ("depth", "conv_id", "n_convs", "nb", "n_children"))
    n, spine = len(depth), int(depth[0])
    closes = np.append(0, depth[:-1] - depth[1:] + 1)
    opens = np.arange(n) + np.cumsum(closes) + spine
    natural = int(opens[-1]) + 1
    bits = np.zeros(2 * (spine + n), bool)
    bits[:spine] = True
    bits[opens] = True
    tree = Parentheses(bits)
    every = np.append(np.arange(spine), opens)
    close = tree.find_close(every)
    # the top of a tail stands for its leaf; pairs that are no leaves are nodes whose children lie in another shard
    leaf = np.append(np.zeros(spine, bool), (children == 0) | ((convs == 1) & (depth > 0)))
    untrue = np.sort(every[~bits[every + 1] & ~leaf])
    leaves = tree.pairs[close] - tree.pairs[every] - (np.searchsorted(untrue, close) - np.searchsorted(untrue, every))
    weight = np.append(0, np.cumsum((convs - 1) * nb))
    saved = weight[np.searchsorted(opens, close)] - weight[np.searchsorted(opens, every)]
    # the parent is the latest node before that lies one level higher; there is none if it is on the spine
    place = depth * (n + 1) + np.arange(n)
    ordered = np.argsort(place, kind="stable")
    above = np.searchsorted(place[ordered], (depth - 1) * (n + 1) + np.arange(n)) - 1
    parent = ordered[np.maximum(above, 0)]
    known = (above >= 0) & (depth[parent] == depth - 1)
    entry = {c: table.column(c) for c in table.column_names}
    nodes = {
        "kind": pa.array(["node"] * n), **entry, "parent_conv_id": pa.array(conv[parent], mask=~known),
        "n_leaves": pa.array(leaves[spine:]), "saved": pa.array(saved[spine:]), "open": pa.array(close[spine:] >= natural)}
    above_first = {
        "kind": pa.array(["spine"] * spine), **{c: pa.nulls(spine, x.type) for c, x in entry.items()},
        "pid": pa.array(np.full(spine, entry["pid"][0].as_py(), np.int32)), "depth": pa.array(np.arange(spine)),
        "parent_conv_id": pa.nulls(spine, pa.int64()), "n_leaves": pa.array(leaves[:spine]), "saved": pa.array(saved[:spine]),
        "open": pa.nulls(spine, pa.bool_())}
    for part in (nodes, above_first):
        yield from pa.table(part).to_batches(max_chunksize=50_000)


def conversation_trie(conversations: DataFrame) -> DataFrame:
    """A row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    spark = conversations.sparkSession
    members = _members(conversations)
    key = F.struct("x1", "x2")
    nodes = store(members.groupBy("x1", "x2").agg(
        F.min("c").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), *[F.first(k).alias(k) for k in ("d", "nb", "p1", "p2")],
        F.count_if("last").alias("n_ends"), F.min(F.when(F.col("last"), F.col("c"))).alias("end_c")))
    alone = (F.col("n_convs") == 1) & (F.col("d") > 0)
    tails, shared = nodes.filter(alone), nodes.filter(~alone)
    tops = tails.groupBy("conv_id").agg(F.min_by(F.struct(*[c for c in nodes.columns if c != "conv_id"]), "d").alias("t")).select("conv_id", "t.*")
    in_trie = store(shared.unionByName(tops))
    children = in_trie.filter("d > 0").groupBy("p1", "p2").agg(
        F.count(F.lit(1)).alias("n_children"), F.max_by(key, F.struct("n_convs", "x1", "x2")).alias("heavy"))
    children = store(children)
    light = in_trie.filter("d > 0").join(children.select("heavy.*"), ["x1", "x2"], "left_anti").select("x1", "x2", "conv_id", "d", "n_convs")
    light = store(light)
    # the light nodes on the path of each conversation, at most log2 of their number
    met = light.filter("n_convs > 1").select("x1", "x2", F.xxhash64("x1", "x2").alias("key"))
    near = members.filter("d > 0").filter(in_bitmap(bitmap(met, "key"), F.xxhash64("x1", "x2")))
    on_path = near.join(met.select("x1", "x2"), ["x1", "x2"], "left_semi").select("c", "d", "x1", "x2").unionByName(
        light.filter("n_convs = 1").select(F.col("conv_id").alias("c"), "d", "x1", "x2"))
    step = F.struct((-F.col("d")).alias("nd"), F.col("x1").alias("k1"), F.col("x2").alias("k2"))
    paths = on_path.groupBy(F.col("c").alias("conv_id")).agg(F.collect_list(step).alias("steps"))
    taken = F.filter(F.coalesce("steps", F.array().cast("array<struct<nd:bigint,k1:bigint,k2:bigint>>")), lambda s: s["nd"] >= -F.col("d"))
    end = F.struct(F.lit(-(2**62)).alias("nd"), F.col("d").alias("k1"), F.lit(0).cast("long").alias("k2"))
    order = F.array_append(F.sort_array(taken, False), end)
    # deepest first among siblings of a heavy path, but from the root down along a path
    counted = in_trie.join(children.select(F.col("p1").alias("x1"), F.col("p2").alias("x2"), "n_children"), ["x1", "x2"], "left").withColumn(
        "n_children", F.when(alone, 1 - F.col("n_ends")).otherwise(F.coalesce("n_children", F.lit(0))).cast("long"))
    entries = store(counted.join(paths, "conv_id", "left").withColumn("path", order))
    shards = max(partitions(spark), -(-entries.count() // SHARD))
    row = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    placed = keep(entries.repartitionByRange(shards, "path").sortWithinPartitions("path").select(
        F.spark_partition_id().alias("pid"), F.col("d").alias("depth"), "conv_id", "n_convs", "nb", "n_children", "n_ends", "end_c", "x1", "x2",
        row.alias("row")))
    firsts = placed.filter("row = 0 and depth > 0").select("pid", F.col("conv_id").alias("c"), F.col("depth").alias("below"))
    # one row per shard
    above = members.join(F.broadcast(spark.createDataFrame(firsts.collect(), firsts.schema)), "c").filter("d < below")
    spines = store(above.select("pid", "d", "x1", "x2").join(shared.select("x1", "x2", F.col("conv_id").alias("spine_conv")), ["x1", "x2"]))
    summed = store(placed.drop("row").mapInArrow(_shard, _SHARD))
    partial = summed.filter("kind = 'spine'").select("pid", F.col("depth").alias("d"), "n_leaves", "saved").join(spines, ["pid", "d"]).groupBy(
        "x1", "x2").agg(F.sum("n_leaves").alias("more_leaves"), F.sum("saved").alias("more_saved"))
    found = summed.filter("kind = 'node'")
    whole = found.filter("open").join(partial, ["x1", "x2"], "left").withColumns({
        "n_leaves": F.col("n_leaves") + F.coalesce("more_leaves", F.lit(0)), "saved": F.col("saved") + F.coalesce("more_saved", F.lit(0))})
    whole = whole.select(found.columns).unionByName(found.filter("not open"))
    parents = spines.select("pid", (F.col("d") + 1).alias("depth"), "spine_conv")
    orphans = whole.filter("parent_conv_id is null and depth > 0").join(parents, ["pid", "depth"], "left").withColumn(
        "parent_conv_id", F.col("spine_conv"))
    columns = ["x1", "x2", "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved", "n_ends", "end_c"]
    one = F.lit(1).cast("long")
    rest = tails.join(tops.select("x1", "x2"), ["x1", "x2"], "left_anti").select(
        "x1", "x2", "conv_id", F.col("d").alias("depth"), F.col("conv_id").alias("parent_conv_id"), "n_convs", (1 - F.col("n_ends")).alias("n_children"),
        one.alias("n_leaves"), (one - 1).alias("saved"), "n_ends", "end_c")
    every = whole.filter("parent_conv_id is not null or depth = 0").select(columns).unionByName(orphans.select(columns)).unionByName(rest.select(columns))
    few = every.filter("n_ends < 2").withColumn("sha", F.when(F.col("n_ends") == 0, F.lit(_NOTHING)).otherwise(
        F.sha2(F.col("end_c").cast("string").cast("binary"), 256)))
    many = every.filter("n_ends > 1").join(_ends(members, nodes), ["x1", "x2"], "left")
    return few.unionByName(many).select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", F.col("saved").alias("saved_tokens"), F.col("sha").alias("ends_sha256"))
