"""Fill-in-the-middle transformation with a learned rank index.

A text is cut into n tokens; two cut points, drawn from a hash of the id, split it at token boundaries into prefix,
middle and suffix, which are put in the order suffix first or prefix first.  Where a cut falls is a lookup from
the rank of a boundary to its offset: the boundaries of all texts of a slice form one increasing sequence, over which
``RankIndex`` fits straight pieces of bounded error, predicts each cut and corrects it exactly by a stored residual.

One pass over the text, no shuffle.  Draws need only the id, so reruns and lost executors give the same rows.

Defined cases: null text is empty; empty texts and texts that contain a marker stay plain (a marker in the text
could not be told from one that was put there); a null id draws as the empty string does; repeated rows give equal
rows; an empty table gives no rows; other columns are not read, so their names cannot clash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigilake.llm import textarrays as ta
from vigilake.llm.rank_index import RankIndex

P, S, M = b"<P>", b"<S>", b"<M>"
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True


def draws(id_col: Column, seed: int = 1) -> list[Column]:
    """Four unsigned 32-bit numbers from the SHA-256 of ``seed:id``."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]


def token_starts(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(byte offsets at which tokens begin, rank of the first token of each text and of the end).

    A token is a run of letters A-Z, a-z or any other single character.
    """
    letter = _LETTER[data]
    begins = (data & 0xC0) != 0x80
    begins[1:] &= ~(letter[1:] & letter[:-1])
    begins[offsets[:-1][offsets[:-1] < len(data)]] = True
    # an empty text adds its own offset, where the next text begins with a token anyway
    starts = np.flatnonzero(begins)
    return starts, np.searchsorted(starts, offsets)


def _characters(data: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Code points in data[lo:hi] for each pair; the pairs do not overlap and rise."""
    edges = np.stack([lo, hi], 1).reshape(-1)
    begins = np.append((data & 0xC0) != 0x80, False)
    total = np.add.reduceat(begins, edges, dtype=np.int64)[::2] if len(edges) else np.zeros(0, np.int64)
    return np.where(lo < hi, total, 0)


def transformed(texts: pa.Array, h: list[np.ndarray], plain_percent: int, spm_percent: int) -> Iterator[tuple]:
    """(n, form, prefix characters, middle characters, output) for each text."""
    for first, end, data, offsets in ta.slices(texts):
        starts, rank = token_starts(data, offsets)
        n = np.diff(rank)
        index = RankIndex(np.append(starts, len(data)))
        one, two = (h[i][first:end] % (n + 1) for i in (0, 1))
        cuts = [index.lookup(rank[:-1] + np.minimum(one, two)), index.lookup(rank[:-1] + np.maximum(one, two))]
        chars = [_characters(data, lo, hi) for lo, hi in ((offsets[:-1], cuts[0]), (cuts[0], cuts[1]))]
        for i in range(end - first):
            lo, a, b, hi = int(offsets[i]), int(cuts[0][i]), int(cuts[1][i]), int(offsets[i + 1])
            raw = data[lo:hi].tobytes()
            if not raw or h[2][first + i] % 100 >= plain_percent or any(mark in raw for mark in (P, S, M)):
                yield int(n[i]), "plain", None, None, raw
                continue
            prefix, middle, suffix = raw[:a - lo], raw[a - lo:b - lo], raw[b - lo:]
            if h[3][first + i] % 100 < spm_percent:
                form, out = "spm", S + suffix + P + prefix + M + middle
            else:
                form, out = "psm", P + prefix + S + suffix + M + middle
            yield int(n[i]), form, int(chars[0][i]), int(chars[1][i]), out


def restored(output: bytes, form: str) -> bytes:
    """The text that a transformed one was made of."""
    if form == "plain":
        return output
    order = (P, S, M) if form == "psm" else (S, P, M)
    first, rest = output[len(order[0]):].split(order[1], 1)
    second, middle = rest.split(order[2], 1)
    prefix, suffix = (first, second) if form == "psm" else (second, first)
    return prefix + middle + suffix


def fill_in_middle(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 1, plain_percent: int = 90, spm_percent: int = 20,
    digests: bool = False,
) -> DataFrame:
    """A row per document: doc_id, n, form, prefix_chars, middle_chars, output.

    ``digests`` gives output_sha256 and restored_sha256 (of the text that is put together again from the output and the
    form alone) in place of the output itself.  ``plain_percent``: draws from this value on stay plain.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"),
                       *[c.alias(f"h{i}") for i, c in enumerate(draws(F.col(f"`{id_col}`"), seed))])
    results = ["output_sha256", "restored_sha256"] if digests else ["output"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h = [batch.column(2 + i).to_numpy() for i in range(4)]
            out: list[tuple] = []
            for n, form, prefix, middle, raw in transformed(batch.column(1), h, plain_percent, spm_percent):
                if digests:
                    both = (hashlib.sha256(raw).hexdigest(), hashlib.sha256(restored(raw, form)).hexdigest())
                else:
                    both = (raw.decode(),)
                out.append((n, form, prefix, middle, *both))
            columns = list(zip(*out)) if out else [()] * (4 + len(results))
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), *[pa.string()] * len(results)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[pa.array(c, k) for c, k in zip(columns, kinds)]],
                ["doc_id", "n", "form", "prefix_chars", "middle_chars", *results])

    return rows.mapInArrow(run, f"doc_id {kind}, n long, form string, prefix_chars long, middle_chars long, " + ", ".join(f"{r} string" for r in results))
