"""Secret scan with a trigram inverted index, DataFrame functions only.

From each rule's regex a Boolean query over trigrams is derived: every literal stretch that each match
contains gives the alternatives of its spelling, each an AND of trigrams.  One pass over the text, by a single
expression made of all of them, notes which of the rules' trigrams (lower-cased) a document holds, however many
rules there are; the rules that have no mandatory trigram run over the whole text.  Postings are lists of document keys per (block, trigram), with blocks of a
bounded number of documents, so that a trigram that is in every document has no list longer than a block.  Queries
are unions and intersections of postings, and only candidates are verified by the regex itself.

Text does not cross an exchange except for candidates: a bitmap of fixed size, made of the candidates' keys, passes few
others, and the join that follows is exact.  Documents are known by doc_id and a 64-bit hash of it and the text; the
postings have the hash alone, where a collision only adds a candidate that the regex refuses.

Defined cases: null text is empty; rows with equal doc_id and text are one in the index and get the same
result each; an empty table gives no rows; a document without findings has zeros, empty spans and the
SHA-256 of the empty string; offsets are in code points; other columns are not read.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass
from itertools import product

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vigilake.llm.common import bitmap, in_bitmap, keep, text_of
from vigilake.llm.fixed_values import SECRETS

BLOCK_ROWS = 1 << 13
#: characters of a text whose trigrams are collected at a time
CHUNK = 1 << 18
CLASS_SIZE = 6
#: trigrams that an alternative of a query has at most; those with fewer letters are rarer in text
_GRAMS = 4
_MOST = 24


@dataclass(frozen=True)
class Rule:
    order: int
    kind: str
    pattern: str
    group: int
    least: int

    @property
    def tail(self) -> bool:
        """The span is that of the group, which ends the match: what precedes it only says where a match may begin."""
        return self.pattern.startswith("(?:^|")

    @property
    def query(self) -> list[list[list[str]]]:
        return trigram_query(self.pattern)


def default_rules() -> list[Rule]:
    return [Rule(i, kind, f"(?{flags}){p}" if flags else p, group, least) for i, (kind, p, flags, group, least) in enumerate(SECRETS)]


def _spellings(node) -> set[str] | None:
    """All strings that a parsed item matches, lower-cased, if they are few."""
    op, arg = str(node[0]), node[1]
    if op == "LITERAL":
        return {chr(arg).lower()}
    if op == "IN":
        out: set[str] = set()
        for kind, value in arg:
            if str(kind) == "LITERAL":
                out.add(chr(value).lower())
            elif str(kind) == "RANGE" and value[1] - value[0] < 4:
                out |= {chr(c).lower() for c in range(value[0], value[1] + 1)}
            else:
                return None
        return out if len(out) <= 6 else None
    if op == "SUBPATTERN":
        return _sequence(arg[3])
    if op == "BRANCH":
        parts = [_sequence(x) for x in arg[1]]
        return None if any(p is None for p in parts) else set().union(*parts)
    if op in ("MAX_REPEAT", "MIN_REPEAT") and arg[1] <= 3:
        inner = _sequence(arg[2])
        if inner is None:
            return None
        return {"".join(x) for n in range(arg[0], int(arg[1]) + 1) for x in product(inner, repeat=n)}
    return None


def _sequence(items) -> set[str] | None:
    out = {""}
    for item in items:
        part = _spellings(item)
        if part is None or len(out) * len(part) > _MOST:
            return None
        out = {a + b for a in out for b in part}
    return out


def trigram_query(pattern: str) -> list[list[list[str]]]:
    """AND of clauses; a clause is an OR of alternatives; an alternative an AND of trigrams.  Empty: no mandatory trigram."""
    clauses, run = [], {""}

    def rarest(x: str) -> list[str]:
        grams = {x[i:i + 3] for i in range(len(x) - 2)}
        return sorted(sorted(grams, key=lambda g: (sum(c.isalpha() for c in g), g))[:_GRAMS])

    def close() -> None:
        if min(map(len, run)) >= 3:
            clauses.append(sorted(map(rarest, run)))

    for item in re._parser.parse(pattern):
        part = _spellings(item)
        if part is not None and len(run) * len(part) <= _MOST:
            run = {a + b for a in run for b in part}
            continue
        close()
        run = {""}
        if part is not None:
            run = part
        elif str(item[0]) in ("SUBPATTERN",):  # the part before the first item of any spelling
            head = {""}
            for x in item[1][3]:
                more = _spellings(x)
                if more is None or len(head) * len(more) > _MOST:
                    break
                head = {a + b for a in head for b in more}
            run = head
            close()
            run = {""}
    close()
    return clauses


def needed(rules: list[Rule]) -> list[str]:
    return sorted({t for r in rules for clause in r.query for alt in clause for t in alt})


def any_of(words: list[str]) -> str:
    """A regex for any of the words, which share their beginnings; many beginnings are told apart by classes first."""
    heads: dict[str, list[str]] = {}
    for w in sorted(words):
        heads.setdefault(w[:1], []).append(w[1:])
    if "" in heads:
        return ""
    if all(rest == [""] for rest in heads.values()):
        return "[" + "".join(map(re.escape, heads)) + "]"
    each = [(c, re.escape(c) + any_of(rest)) for c, rest in heads.items()]
    if len(each) > CLASS_SIZE:
        parts = [each[i:i + CLASS_SIZE] for i in range(0, len(each), CLASS_SIZE)]
        each = [("", f"(?=[{''.join(re.escape(c) for c, _ in part)}])(?:{'|'.join(x for _, x in part)})") for part in parts]
    return "(?:" + "|".join(x for _, x in each) + ")"


def grams_of(text: Column, wanted: list[str]) -> Column:
    """Which of the wanted trigrams a text holds; a long text is read in pieces that overlap by two characters."""
    if not wanted:
        return F.array().cast("array<string>")
    pattern = F.lit(f"(?=({any_of(wanted)}))")

    def of_piece(t: Column, i: Column) -> Column:
        return F.array_distinct(F.regexp_extract_all(F.substring(t, (i * CHUNK + 1).cast("int"), F.lit(CHUNK + 2)), pattern, F.lit(1)))

    def of_text(t: Column) -> Column:
        return F.flatten(F.transform(F.sequence(F.lit(0), F.floor(F.length(t) / CHUNK).cast("int")), lambda i: of_piece(t, i)))

    return F.array_distinct(F.flatten(F.transform(F.array(text), of_text)))


def key_of(id_col: Column, text: Column) -> Column:
    return F.xxhash64(id_col, text)


def _lengths(text: Column, r) -> Column:
    return F.struct(
        r["o"].alias("o"), F.transform(F.split(text, r["p"], -1), F.length).alias("gaps"),
        F.transform(F.regexp_extract_all(text, r["p"], F.lit(0)), F.length).alias("lens"),
        F.transform(F.regexp_extract_all(text, r["p"], r["g"]), F.length).alias("counts"))


def _constant(rows: list, schema: str) -> Column:
    """Rows as one constant of the plan, however many they are."""
    return F.from_json(F.lit(json.dumps(rows)), schema)


def _table(rules: list[Rule]) -> Column:
    return _constant([{"o": r.order, "p": r.pattern, "g": r.group} for r in rules], "array<struct<o: int, p: string, g: int>>")


def trigram_index(docs: DataFrame, rules: list[Rule], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, key, grams, found): trigrams of the rules in each document, and the findings of rules without trigrams."""
    text = F.col("_t")
    grams = grams_of(F.lower(text), needed(rules))
    full = [r for r in rules if not r.query]
    # a repetition needs its least length somewhere, which is cheaper to test than the rule
    some = F.lit(False)
    for r in full:
        simple = re.fullmatch(r"(\[[^\]]+\])\+", r.pattern)
        some = some | text.rlike(f"{simple[1]}{{{r.least}}}" if simple and not r.group else r.pattern)
    none = F.array().cast("array<struct<o: int, gaps: array<int>, lens: array<int>, counts: array<int>>>")
    found = F.when(some, F.transform(_table(full), lambda r: _lengths(text, r))).otherwise(none) if full else none
    return docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("_t")).select(
        "doc_id", key_of(F.col("doc_id"), text).alias("key"), grams.alias("grams"), found.alias("found"))


def postings(index: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(block, lists): a map from trigram to the keys of the block's documents that hold it."""
    blocks = index.count() // block_rows + 1
    lists = index.select("key", F.explode("grams").alias("gram")).withColumn("block", F.pmod("key", F.lit(blocks))).groupBy(
        "block", "gram").agg(F.collect_set("key").alias("keys"))
    return lists.groupBy("block").agg(F.map_from_entries(F.collect_list(F.struct("gram", "keys"))).alias("lists"))


def candidates(lists: DataFrame, rules: list[Rule]) -> DataFrame:
    """(key, rules): documents whose trigrams satisfy a rule's query, with the numbers of those rules."""
    none = F.array().cast("array<bigint>")

    def fold(parts: Column, join) -> Column:
        return F.aggregate(F.slice(parts, 2, F.size(parts)), F.element_at(parts, 1), join)

    def alternative(grams: Column) -> Column:
        return fold(F.transform(grams, lambda t: F.coalesce(F.element_at("lists", t), none)), F.array_intersect)

    def clause(alternatives: Column) -> Column:
        return fold(F.transform(alternatives, alternative), F.array_union)

    queries = _constant([{"o": r.order, "q": r.query} for r in rules if r.query], "array<struct<o: int, q: array<array<array<string>>>>>")
    hits = F.transform(queries, lambda r: F.struct(r["o"].alias("o"), fold(F.transform(r["q"], clause), F.array_intersect).alias("keys")))
    return lists.select(F.inline(hits)).select("o", F.explode("keys").alias("key")).groupBy("key").agg(
        F.collect_set("o").alias("rules"))


def secret_spans(docs: DataFrame, rules: list[Rule] | None = None, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """The index with one row per document, and (doc_id, key, o, kind, start, end) of all findings, once per doc_id and text."""
    rules = default_rules() if rules is None else rules
    index = keep(trigram_index(docs, rules, id_col, text_col))
    wanted = keep(candidates(postings(index), rules))
    text = F.col("_t")
    rows = docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("_t")).withColumn("key", key_of(F.col("doc_id"), text))
    rows = rows.filter(in_bitmap(bitmap(wanted, "key"), F.col("key"))).join(wanted, "key")
    verified = rows.select("doc_id", "key", F.transform(
        F.filter(_table([r for r in rules if r.query]), lambda r: F.array_contains("rules", r["o"])), lambda r: _lengths(text, r)).alias("found"))
    known = _constant([{"kind": r.kind, "least": r.least, "tail": r.tail} for r in rules], "array<struct<kind: string, least: int, tail: boolean>>")
    each = verified.unionByName(index.select("doc_id", "key", "found")).select("doc_id", "key", F.explode("found").alias("d"))
    each = each.filter(F.exists("d.counts", lambda n: n >= F.element_at(known, F.col("d.o") + 1)["least"]))
    each = keep(each.dropDuplicates(["doc_id", "key", "d"]))
    part = each.select("doc_id", "key", F.col("d.o").alias("o"), F.posexplode(F.arrays_zip("d.gaps", "d.lens", "d.counts")).alias("i", "x")).select(
        "doc_id", "key", "o", "i", F.col("x.gaps").alias("gap"), F.coalesce("x.lens", F.lit(0)).alias("len"), F.col("x.counts").alias("count"))
    upto = Window.partitionBy("doc_id", "key", "o").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    rule = F.element_at(known, F.col("o") + 1)
    own = F.when(rule["tail"], F.col("count")).otherwise(F.col("len"))
    spans = part.withColumn("end", F.sum(F.col("gap") + F.col("len")).over(upto)).filter(
        F.col("count") >= rule["least"]).select(
        "doc_id", "key", "o", rule["kind"].alias("kind"), (F.col("end") - own).alias("start"), "end")
    return index, spans


def secret_scan(docs: DataFrame, rules: list[Rule] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_spans."""
    index, found = secret_spans(docs, rules, id_col, text_col)
    shown = F.concat_ws(":", "kind", "start", "end")
    base = F.col("o") < 3
    lists = found.groupBy(F.col("doc_id").alias("_id"), F.col("key").alias("_key")).agg(
        *[F.count(F.when(F.col("o") == i, 1)).alias(f"n_{k}") for i, k in enumerate(("assign", "access", "hex"))],
        F.array_sort(F.collect_list(F.when(base, F.struct("start", "o", shown.alias("s"))))).alias("b"),
        F.array_sort(F.collect_list(F.struct("start", "o", shown.alias("s")))).alias("a"))
    text = F.coalesce(F.array_join("b.s", ","), F.lit(""))
    own = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("key") == F.col("_key"))
    return index.select("doc_id", "key").join(lists, own, "left").select(
        "doc_id", *[F.coalesce(f"n_{k}", F.lit(0)).alias(f"n_{k}") for k in ("assign", "access", "hex")],
        F.sha2(text, 256).alias("base_sha256"), F.coalesce(F.array_join("a.s", ","), F.lit("")).alias("spans"),
        F.greatest(F.size("a"), F.lit(0)).cast("long").alias("n_spans"))
