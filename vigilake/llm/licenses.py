"""License scan with ordered signature rules, DataFrame functions only.

A text becomes its words (lower-cased A-Z, digits, non-ASCII), each between two blanks, so that signatures
are plain regexes over words.  Texts that have none of the gate words are done after one cheap test.  In the
others a rule's keyword must occur before its regex runs.  Detections are positions in the word text;
one that lies inside another of at least its priority is dropped (longer first, then rule order), which
takes one pass over the detections in order of start for each priority.

Text is read once and never shuffled: what leaves that pass is, per row, the lengths of matches and of the gaps
between them.

Defined cases: null text is empty; a text without detections has empty labels, score 0 and null positions;
rows that are repeated are reported each; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vigilake.llm.common import keep, text_of
from vigilake.llm.fixed_values import BASE_PHRASES, LICENSE_MARKS, LICENSES

#: on text as it is, so A-Z are word characters here
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"
GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"
#: every signature holds one of these
GATE = rf"(?i)licen[cs]e|spdx|creative|domain|rights|confidential|permission|redistribution|openrail|cc0|mozilla|eclipse|cc{GAP}+by"


@dataclass(frozen=True)
class Signature:
    order: int
    label: str
    priority: int
    confidence: float
    keyword: str
    pattern: str


def over_words(regex: str) -> str:
    """Regex over the word text; blanks of ``regex`` are gaps between words."""
    return " (?:" + regex.replace("(", "(?:").replace(" ?", "\0").replace(" ", "  ").replace("\0", "(?:  )?") + ") "


def signatures() -> list[Signature]:
    """Identifiers, marks, notices, names: from most to least certain."""
    under = "(released|licensed|distributed|available|published|covered|provided|used) under( the)?( terms of)?( the)? "
    kinds = [
        [(label, "spdx", f"spdx license identifier {ident}", 1.0) for label, _, _, ident in LICENSES],
        [(label, word, regex, 0.95) for label, word, regex in LICENSE_MARKS],
        [(label, word, f"{under}({name})", 0.9) for label, word, name, _ in LICENSES],
        [(label, word, name, 0.7) for label, word, name, _ in LICENSES],
    ]
    out = []
    for level, rules in zip((4, 3, 2, 1), kinds):
        out += [Signature(len(out) + i, r[0], level, r[3], r[1], over_words(r[2])) for i, r in enumerate(rules)]
    return out


BASE = "|".join(over_words(p) for p, _ in BASE_PHRASES)


def word_text(text: Column) -> Column:
    return F.lower(F.regexp_replace(text, f"{GAP}*({WORD}+){GAP}*", " $1 "))


def words_in(part: Column) -> Column:
    return ((F.length(part) - F.length(F.replace(part, F.lit(" "), F.lit("")))) / 2).cast("long")


def _pass(docs: DataFrame, rules: list[Signature], id_col: str, text_col: str) -> DataFrame:
    """One compact row per document: counts of base phrases and the lengths of detections and gaps."""
    text = text_of(text_col)
    table = F.array(*[F.struct(F.lit(r.order).alias("o"), F.lit(f" {r.keyword} ").alias("k"), F.lit(r.pattern).alias("p")) for r in rules])
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("_t")).select(
        "doc_id", F.regexp_count("_t", F.lit(WORD + "+")).cast("long").alias("n_words"),
        F.when(F.col("_t").rlike(GATE), word_text(F.col("_t"))).alias("w"))
    rows = rows.withColumns({"parts": F.split("w", BASE, -1), "base": F.regexp_extract_all("w", F.lit(BASE), F.lit(0))})
    found = F.transform(
        F.filter(table, lambda r: F.contains(F.col("w"), r["k"])),
        lambda r: F.struct(
            r["o"].alias("o"), F.transform(F.split(F.col("w"), r["p"], -1), F.length).alias("gaps"),
            F.transform(F.regexp_extract_all(F.col("w"), r["p"], F.lit(0)), F.length).alias("lens")))
    seen = F.size("base") > 0
    labels = F.array_compact(F.array(*[
        F.when(F.array_contains("base", F.lit(f" {p.replace(' ', '  ')} ")), F.lit(label)) for p, label in BASE_PHRASES]))
    return rows.select(
        "doc_id", "n_words", F.greatest(F.size("base"), F.lit(0)).cast("long").alias("n_base"),
        F.when(seen, words_in(F.element_at("parts", 1))).alias("first_word"),
        F.when(seen, F.col("n_words") - words_in(F.element_at("parts", -1)) - words_in(F.element_at("base", -1))).alias("last_word"),
        F.when(seen, F.array_sort(labels)).otherwise(F.array().cast("array<string>")).alias("base_labels"),
        F.when(F.col("w").isNotNull(), F.filter(found, lambda d: F.size(d["lens"]) > 0)).alias("found"),
        F.monotonically_increasing_id().alias("tag"))


def detections(rows: DataFrame, rules: list[Signature]) -> DataFrame:
    """(tag, o, start, end, priority, kept) of the compact rows; positions in the word text."""
    each = rows.select("tag", F.explode("found").alias("d")).select(
        "tag", F.col("d.o").alias("o"), F.posexplode(F.arrays_zip("d.gaps", "d.lens")).alias("i", "x")).select(
        "tag", "o", "i", F.col("x.gaps").alias("gap"), F.coalesce("x.lens", F.lit(0)).alias("len"))
    upto = Window.partitionBy("tag", "o").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    placed = each.withColumn("end", F.sum(F.col("gap") + F.col("len")).over(upto)).filter("len > 0")
    levels = F.array(*[F.lit(r.priority) for r in rules])
    placed = placed.select(
        "tag", "o", (F.col("end") - F.col("len")).alias("start"), "end", F.element_at(levels, F.col("o") + 1).alias("priority"))
    before = Window.partitionBy("tag").orderBy("start", F.desc("end"), F.desc("priority"), "o").rowsBetween(Window.unboundedPreceding, -1)
    hidden = F.lit(False)
    for level in sorted({r.priority for r in rules}):
        furthest = F.max(F.when(F.col("priority") >= level, F.col("end"))).over(before)
        hidden = hidden | ((F.col("priority") == level) & F.coalesce(furthest >= F.col("end"), F.lit(False)))
    return placed.withColumn("kept", ~hidden)


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: list[Signature] | None = None) -> DataFrame:
    """One row per document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, n_detections."""
    rules = signatures() if rules is None else rules
    rows = keep(_pass(docs, rules, id_col, text_col))
    names, sure = F.array(*[F.lit(r.label) for r in rules]), F.array(*[F.lit(r.confidence) for r in rules])
    best = detections(rows.filter(F.size("found") > 0), rules).filter("kept").groupBy("tag").agg(
        F.collect_set(F.element_at(names, F.col("o") + 1)).alias("own"), F.max(F.element_at(sure, F.col("o") + 1)).alias("sure"),
        F.count(F.lit(1)).alias("n_detections"))
    none = F.array().cast("array<string>")
    return rows.join(best, "tag", "left").select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("base_labels", ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_distinct(F.concat("base_labels", F.coalesce("own", none)))), ",").alias("labels"),
        F.coalesce("sure", F.when(F.col("n_base") > 0, F.lit(0.5)), F.lit(0.0)).alias("score"),
        F.coalesce("n_detections", F.lit(0)).alias("n_detections"))
