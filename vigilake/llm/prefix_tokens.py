"""Token counts of every prefix of a text under a byte-level BPE vocabulary.

Dynamic programming over prefixes: the encoding of a prefix ends with the one token t for which the encoding of what
comes before it ends with a token s such that the merges leave the pair (s, t) as it is.  So the count of a prefix is one
more than that of a shorter prefix, found by looking at the vocabulary entries that end there (an automaton lists
them).  Texts are cut into the pieces that the merges never cross; counts of pieces are remembered.

The count of a prefix is that of the prefix *as a text of its own*.  What follows a piece can change where it is cut, so
two kinds of prefixes are mended: those that end inside an English contraction, and those that end with a run of
white space, which is one piece there and two where a word follows.  A prefix that ends inside the string of a special
token holds that string's beginning as ordinary text.

Spark stores the counts as an array per document (``prefix_table``), which then answers questions without another
look at the text: ``count_at`` and ``longest_within`` are expressions over it.

Defined cases: null text is empty and has no tokens; special strings inside a text are one token each, as the library
has it; repeated rows give equal rows; an empty table gives no rows; other columns are not read, so their names
cannot clash.  Texts of any length are counted whole, in blocks that are cut where white space begins.
"""

from __future__ import annotations

import json
from array import array
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

LIMIT = 512
#: characters that are looked at together
BLOCK = 1 << 20
#: remembered pieces, and pairs of tokens, of a worker
REMEMBERED = 300_000

# FIXED VALUES: the pattern of pieces of this family of vocabularies, and a character of each of its classes
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
CLASSES = {"letter": "a", "number": "1", "other": "!", "space": "\n"}


def _byte_letters() -> list[str]:
    """The printable character that stands for each byte in the vocabulary's entries."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    hidden = [b for b in range(256) if b not in shown]
    out = [""] * 256
    for b in shown:
        out[b] = chr(b)
    for i, b in enumerate(hidden):
        out[b] = chr(256 + i)
    return out


class PrefixCounter:
    """Counts for the prefixes of texts; made from the content of a vocabulary file."""

    def __init__(self, vocabulary: str):
        spec = json.loads(vocabulary)
        model, before = spec["model"], spec.get("pre_tokenizer") or {}
        plain = model.get("type") == "BPE" and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix"))
        if not plain or spec.get("normalizer") or before.get("type") != "ByteLevel" or before.get("add_prefix_space") or not before.get("use_regex", True):
            raise ValueError("only byte-level BPE without a normalizer is supported")
        if any(t[k] for t in spec["added_tokens"] for k in ("lstrip", "rstrip", "single_word")):
            raise ValueError("special tokens that take their surroundings are not supported")
        library = Tokenizer.from_str(vocabulary)
        self.tokenize, self.pieces_of = library.model.tokenize, library.pre_tokenizer.pre_tokenize_str
        special = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, special))) if special else None
        self.pattern, self.run = regex.compile(PIECES), regex.compile(r"\s{2,}(?=\S)")
        self.cut = regex.compile(r"(?<=\S)\s")
        self.letters = {b: c for b, c in enumerate(_byte_letters())}
        skip = set(special)
        self.entries = [e for e in model["vocab"] if e not in skip]
        self.width = len(self.entries)
        self.automaton = ahocorasick.Automaton()
        for i, e in enumerate(self.entries):
            # an entry that its own merges do not make is never produced
            if len(e) == 1 or [t.value for t in self.tokenize(e)] == [e]:
                self.automaton.add_word(e, (i, len(e)))
        self.automaton.make_automaton()
        self.known: dict[str, bytes] = {}
        self.pairs: dict[int, bool] = {}
        self.checked: set[str] = set()
        self.moved: dict[int, str] = {}

    def _stays(self, s: int, t: int) -> bool:
        """Whether the merges leave a pair of entries as it is; remembered."""
        if len(self.pairs) >= REMEMBERED:
            self.pairs.clear()
        a, b = self.entries[s], self.entries[t]
        got = self.pairs[s * self.width + t] = [x.value for x in self.tokenize(a + b)] == [a, b]
        return got

    def _counted(self, piece: str) -> array:
        """Counts of the prefixes of a piece, by characters."""
        raw = piece.encode()
        mapped = raw.decode("latin-1").translate(self.letters)
        n = len(mapped) + 1
        count, last = (array("i", bytes(4 * n)), array("i", bytes(4 * n))) if n > 10_000 else ([0] * n, [0] * n)
        known, width, stays = self.pairs.get, self.width, self._stays
        for at, (t, size) in self.automaton.iter(mapped):
            at += 1
            if count[at]:
                continue
            start = at - size
            if start:
                s = last[start]
                fits = known(s * width + t)
                if fits is None:
                    fits = stays(s, t)
                if not fits:
                    continue
            count[at], last[at] = count[start] + 1, t
        if n - 1 == len(piece):
            return array("i", count[1:])
        return array("i", [c for c, b in zip(count[1:], raw[1:] + b"a") if b & 0xC0 != 0x80])

    def _piece(self, piece: str) -> bytes:
        """Counts as bytes, remembered for short pieces; ``_block`` asks only for those that are not."""
        counts = self._counted(piece)
        if piece[0] == "'" and len(piece) > 1 and piece[1].isalpha():
            # shorter than the whole, a contraction is an apostrophe and a word
            for i in range(len(piece) - 1):
                counts[i] = self._counted("'")[-1] + (self._counted(piece[1:i + 1])[-1] if i else 0)
        got = counts.tobytes()
        if len(piece) <= 200:
            if len(self.known) >= REMEMBERED:
                self.known.clear()
            self.known[piece] = got
        return got

    def _usual(self, text: str) -> str:
        """The text with characters that the library's classes place otherwise replaced by one of their class."""
        new = set(text) - self.checked
        for ch in new:
            here = next((k for k in ("letter", "number", "other") if len(self.pieces_of(CLASSES[k] + ch)) == 1), "space") if ch != "'" else "other"
            ours = "letter" if regex.match(r"\p{L}", ch) else "number" if regex.match(r"\p{N}", ch) else "space" if regex.match(r"\s", ch) else "other"
            if here != ours:
                self.moved[ord(ch)] = CLASSES[here]
        self.checked |= new
        return text.translate(self.moved) if self.moved else text

    def _block(self, text: str) -> np.ndarray:
        """Counts of the prefixes of 1, 2, ... characters; nothing before or behind matters."""
        usual = self._usual(text)
        found = self.pattern.findall(usual)
        lengths = np.fromiter(map(len, found), np.int64, len(found))
        ends = np.cumsum(lengths)
        if usual is not text:
            found = [text[e - n:e] for e, n in zip(ends.tolist(), lengths.tolist())]
        known, piece = self.known.get, self._piece
        counts = np.frombuffer(b"".join([known(x) or piece(x) for x in found]), np.int32).astype(np.int64)
        totals = counts[ends - 1]
        counts += np.repeat(np.cumsum(totals) - totals, lengths)
        for m in self.run.finditer(usual):
            before = counts[m.start() - 1] if m.start() else 0
            counts[m.end() - 1] = before + np.frombuffer(self._piece(text[m.start():m.end()]), np.int32)[-1]
        return counts

    def _ordinary(self, text: str) -> Iterator[np.ndarray]:
        at, base = 0, 0
        while at < len(text):
            cut = self.cut.search(text, at + BLOCK) if len(text) - at > BLOCK else None
            end = cut.start() if cut else len(text)
            counts = self._block(text[at:end]) + base
            yield counts
            at, base = end, int(counts[-1])

    def counts(self, text: str) -> Iterator[np.ndarray]:
        """Counts of the prefixes of 1, 2, ... characters, block by block."""
        at, base = 0, 0
        for m in self.special.finditer(text) if self.special else ():
            whole = m.start() - at
            done = 0
            # the string of the special token is ordinary text as long as it is not complete
            for block in self._ordinary(text[at:m.end() - 1]):
                yield block + base
                if done < whole <= done + len(block):
                    total = int(block[whole - done - 1])
                done += len(block)
            base += (total if whole else 0) + 1
            yield np.array([base])
            at = m.end()
        for block in self._ordinary(text[at:]):
            yield block + base


_counters: dict[str, PrefixCounter] = {}


def _counter(vocabulary: str) -> PrefixCounter:
    """One counter for each vocabulary and worker."""
    if vocabulary not in _counters:
        _counters.clear()
        _counters[vocabulary] = PrefixCounter(vocabulary)
    return _counters[vocabulary]


def vocabulary_file(path: str | None = None) -> str:
    """The content of a vocabulary file; without a path, that of the installed byte-level BPE of 50,257 entries."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_50k.json")
    with open(path, encoding="utf-8") as f:
        return f.read()


def _rows(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, str]:
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), text.alias("text"), F.octet_length(text).cast("long").alias("n_bytes"))
    return rows, rows.schema["doc_id"].dataType.simpleString()


def prefix_table(docs: DataFrame, vocabulary: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, counts: tokens of the prefixes of 0, 1, 2, ... characters of the text.

    ``vocabulary`` is the path of a file that the driver can read; its content is broadcast (some MB, whatever the data).
    """
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary_file(vocabulary))
    rows, kind = _rows(docs, id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(shared.value)
        for batch in batches:
            for i in range(batch.num_rows):
                blocks = [x.astype(np.int32) for x in counter.counts(batch.column(1)[i].as_py())]
                counts = np.concatenate([np.zeros(1, np.int32), *blocks])
                listed = pa.ListArray.from_arrays(pa.array([0, len(counts)], pa.int32()), pa.array(counts, pa.int32()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, 1), batch.column(2).slice(i, 1), listed], ["doc_id", "n_bytes", "counts"])

    return rows.mapInArrow(run, f"doc_id {kind}, n_bytes long, counts array<int>")


def count_at(counts: Column | str, characters: Column | int) -> Column:
    """Tokens of the prefix of so many characters; null beyond the text."""
    at = F.lit(characters) if isinstance(characters, int) else characters
    return F.try_element_at(counts if isinstance(counts, Column) else F.col(counts), (at + 1).cast("int"))


def longest_within(counts: Column | str, limit: int) -> Column:
    """Characters of the longest prefix of at most ``limit`` tokens."""
    column = counts if isinstance(counts, Column) else F.col(counts)
    fits = F.transform(F.reverse(column), lambda c: c <= limit)
    return F.size(column) - F.array_position(fits, F.lit(True)).cast("int")


def token_counts(
    docs: DataFrame, limit: int = LIMIT, vocabulary: str | None = None, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit, fit_chars (the longest prefix of at most ``limit`` tokens).

    The same counts as those of ``prefix_table``, answered block by block without storing them.
    """
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary_file(vocabulary))
    rows, kind = _rows(docs, id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(shared.value)
        for batch in batches:
            tokens, fit = [], []
            for text in batch.column(1):
                total = longest = at = 0
                for block in counter.counts(text.as_py()):
                    within = np.flatnonzero(block <= limit)
                    if len(within):
                        longest = at + int(within[-1]) + 1
                    total, at = int(block[-1]), at + len(block)
                tokens.append(total)
                fit.append(longest)
            n = pa.array(tokens, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), n, pa.array([t > limit for t in tokens], pa.bool_()), pa.array(fit, pa.int64())],
                ["doc_id", "n_bytes", "n_tokens", "over_limit", "fit_chars"])

    return rows.mapInArrow(run, f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean, fit_chars long")
