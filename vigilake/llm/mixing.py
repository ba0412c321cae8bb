"""Mixing sources to target weights, with DataFrame operations only.

Every source gets a share of all words by weight, at most ``max_epochs`` times its own size; what is above
that is shared again by weight among the others.  Documents get hash-random keys and are range-sorted by
(source, key); distributed prefix sums of their sizes find the key at which each source's budget is used up.
The result of the search is one small row per source, so a corpus is mixed by a filter on the map side and
text never moves.  A source of any size is spread over range partitions by its keys.

Defined cases: null text has no words; null sources form one source, ordered last; rows with one doc_id and
text in one source share a key and are cut alike (the words left at the cut are split evenly, rounded down); empty
texts are taken with 0 words; an empty table gives no rows; sources are ordered by code point; columns
besides the three that are named are only passed through by ``mix``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vigilake.llm.common import NOT_SPACES, SPACES, keep, partitions, ranked, text_of
from vigilake.model import broadcast_if_small

WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3
SEED = "mix-1"


@dataclass(frozen=True)
class Mixture:
    weights: tuple[int, ...] = WEIGHTS
    max_epochs: int = MAX_EPOCHS
    seed: str = SEED


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(NOT_SPACES + "+")).cast("long")


def random_key(doc_id: Column, seed: str) -> Column:
    return F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":" + seed)).cast("binary"))


def place(doc_id: Column, text: Column, seed: str) -> Column:
    """The random key, then a hash of the text, so that only rows of equal doc_id and text tie."""
    return F.concat(F.unhex(random_key(doc_id, seed)), F.unhex(F.md5(text.cast("binary"))))


def _keyed(docs: DataFrame, m: Mixture, id_col: str, text_col: str, source_col: str) -> DataFrame:
    source = F.col(source_col)
    return docs.select(
        F.col(id_col).alias("doc_id"), source.isNull().alias("nul"), F.coalesce(source.cast("string"), F.lit("")).alias("src"),
        word_count(text_of(text_col)).alias("size"), place(F.col(id_col), text_of(text_col), m.seed).alias("key"))


def targets(sizes: DataFrame, m: Mixture) -> DataFrame:
    """(nul, src, source_size, target) from one row per source with its size."""
    n = len(m.weights)
    weight = F.element_at(F.array(*[F.lit(w) for w in m.weights]), (F.col("rank") % n + 1).cast("int"))
    rows = keep(ranked(sizes, ["nul", "src"]).withColumn("weight", weight.cast("long")).drop("rank"))
    top = F.col("source_size") * m.max_epochs
    total = rows.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0]
    level, capped = 0.0, -1
    while True:
        over = top < F.col("weight") * F.lit(level)
        state = rows.agg(
            F.coalesce(F.sum(F.when(over, top)), F.lit(0)), F.coalesce(F.sum(F.when(~over, F.col("weight"))), F.lit(0)),
            F.count(F.when(over, 1))).first()
        if state[2] == capped or not state[1]:
            break
        capped, level = state[2], (total - state[0]) / state[1]
    return rows.select("nul", "src", "source_size", F.least(top.cast("double"), F.col("weight") * F.lit(float(level))).alias("target"))


def plan(keyed: DataFrame, m: Mixture) -> DataFrame:
    """One row per source: target, whole epochs, and the key and words at which the last epoch ends."""
    spark = keyed.sparkSession
    group = ["nul", "src"]
    goals = targets(keyed.groupBy(*group).agg(F.sum("size").alias("source_size")), m)
    budget = F.floor(F.col("target") + F.lit(0.5)).cast("long")
    goals = goals.withColumn("epochs", F.when(F.col("source_size") > 0, F.expr("floor(target + 0.5D) div source_size")).otherwise(F.lit(0)))
    goals = keep(goals.withColumn("left", budget - F.col("epochs") * F.col("source_size")))
    by_key = keyed.groupBy(*group, "key").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("rows"))
    placed = keep(by_key.repartitionByRange(partitions(spark), *group, "key").withColumn("part", F.spark_partition_id()))
    blocks = placed.groupBy(*group, "part").agg(F.sum("size").alias("block"))
    earlier = Window.partitionBy(*group).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("start", F.coalesce(F.sum("block").over(earlier), F.lit(0)))
    cut_block = blocks.join(broadcast_if_small(goals.select(*group, "left")), group).filter(
        "left >= start and left < start + block").select(*group, "part", "start", "left")
    inside = Window.partitionBy(*group, "part").orderBy("key").rowsBetween(Window.unboundedPreceding, -1)
    cut = (
        placed.join(broadcast_if_small(cut_block), [*group, "part"])
        .withColumn("before", F.col("start") + F.coalesce(F.sum("size").over(inside), F.lit(0)))
        .filter("before <= left and left < before + size")
        .select(*group, F.col("key").alias("cut_key"), F.expr("(left - before) div rows").alias("cut_words")))
    return goals.join(broadcast_if_small(cut), group, "left").drop("left")


def _partly() -> Column:
    """Words taken in the last, cut epoch."""
    return F.when(F.col("key") < F.col("cut_key"), F.col("size")).when(
        F.col("key") == F.col("cut_key"), F.least("size", "cut_words")).otherwise(F.lit(0)).cast("long")


def _taken() -> Column:
    return F.col("epochs") * F.col("size") + _partly()


def mixture_report(docs: DataFrame, m: Mixture = Mixture(), id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken."""
    keyed = keep(_keyed(docs, m, id_col, text_col, source_col))
    goals = keep(plan(keyed, m))
    return keyed.join(broadcast_if_small(goals), ["nul", "src"]).select(
        "doc_id", "size", "source_size", "target", _taken().cast("long").alias("taken"))


def mix(docs: DataFrame, m: Mixture = Mixture(), id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mixed corpus, with the columns of ``docs``: a row per epoch, the last one cut to the words that are left.

    Texts are whole but for the one at the cut of each source, which keeps its first words and the white space
    before them.  A text without words is taken once.
    """
    keyed = keep(_keyed(docs, m, id_col, text_col, source_col))
    goals = keep(plan(keyed, m))
    source, text = F.col(source_col), text_of(text_col)
    # the row travels as one struct, so that no column of it can clash with those of the plan
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), source.isNull().alias("nul"),
        F.coalesce(source.cast("string"), F.lit("")).alias("src"), text.alias("text"), word_count(text).alias("size"),
        place(F.col(id_col), text, m.seed).alias("key"))
    rows = rows.join(broadcast_if_small(goals), ["nul", "src"])
    copies = F.concat(
        F.when(F.col("size") == 0, F.array(F.lit(0).cast("long"))).otherwise(F.array_repeat(F.col("size"), F.col("epochs").cast("int"))),
        F.when(_partly() > 0, F.array(_partly())).otherwise(F.array().cast("array<bigint>")))
    rows = rows.withColumn("take", F.explode(copies)).withColumn("whole", F.col("take") >= F.col("size"))
    # pieces end where a word ends, so the first n of them are the first n words as they stand
    pieces = F.split("text", f"(?<={NOT_SPACES})(?={SPACES})", -1)
    cut = F.array_join(F.slice(pieces, 1, F.col("take").cast("int")), "")
    kept = {c: F.col("row").getField(c) for c in docs.columns}
    kept[text_col] = F.when(F.col("whole"), kept[text_col]).otherwise(cut)
    if "n_chars" in kept:
        kept["n_chars"] = F.when(F.col("whole"), kept["n_chars"]).otherwise(F.length(cut).cast("long"))
    return rows.select(*[c.alias(n) for n, c in kept.items()])
