"""Quality classifier: votes of the nearest labelled documents in a latent-semantic space.

A document is a vector of hashed words, word shapes and repetition counts, weighted by inverse document
frequency.  The truncated singular vectors of at most ``FIT_ROWS`` labelled rows (a parameter) span the latent space;
those rows, projected and normalised, are broadcast: ``FIT_ROWS`` x ``RANK`` numbers, whatever the input.
Every document is projected where it is read, compared with all labelled vectors by exact blocked cosine
products, and its ``NEIGHBOURS`` nearest vote with weights that grow with similarity.

Defined cases: null and empty text have a vector of their own (the one of no words) and get a vote like any
other; without labels the score is 1, as nothing speaks against a document; a null id is not held out; repeated
rows get equal scores; other columns are kept by ``accept`` and not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigilake.llm import textarrays as ta
from vigilake.llm.labelled import held_out, training_rows

FIT_ROWS = 4000
RANK = 48
NEIGHBOURS = 15
SHARPNESS = 8
HASHED = 1024
SHAPES = 256
MEASURES = 6
LEVELS = 16
WIDTH = HASHED + SHAPES + MEASURES * LEVELS
THRESHOLD = 0.3
FOLDS, FOLD_OUT = 5, 0
BLOCK = 512

_UPPER = (np.arange(256) >= 65) & (np.arange(256) <= 90)
_MARK = ~ta.LETTERS & ta.NOT_SPACE & ~_UPPER


def vectors(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A row per text: counts of hashed words and of word shapes, and levels of measures (one of each is 1)."""
    n = len(offsets) - 1
    out = np.zeros((n, WIDTH), np.float32)
    start, end, row = ta.words(data, offsets, ta.NOT_SPACE)
    count = np.bincount(row, minlength=n).astype(np.float64)
    safe = np.maximum(count, 1)
    if len(start):
        hashes = ta.word_hashes(ta.LOWER[data], start, end)
        out[:, :HASHED] = np.bincount(row * HASHED + (hashes >> np.uint64(54)).astype(np.int64), minlength=n * HASHED).reshape(n, -1)

        def per_word(mask: np.ndarray) -> np.ndarray:
            total = np.append(0, np.cumsum(mask[data]))
            return total[end] - total[start]

        upper, marks, size = per_word(_UPPER), per_word(_MARK), end - start
        last = data[end - 1]
        shape = (
            np.minimum(size, 15) + 16 * np.minimum(marks, 3) + 64 * (upper == size - marks) * (size > marks) + 128 * _MARK[last])
        out[:, HASHED:HASHED + SHAPES] = np.bincount(row * SHAPES + shape, minlength=n * SHAPES).reshape(n, -1)
        same = np.append(False, (hashes[1:] == hashes[:-1]) & (row[1:] == row[:-1]))
        pair = hashes + np.append(hashes[1:], 0).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
        order = np.lexsort((pair, row))
        again = np.zeros(len(pair), bool)
        again[order[1:]] = (pair[order][1:] == pair[order][:-1]) & (row[order][1:] == row[order][:-1])
        measures = [np.bincount(row, x, minlength=n) / safe for x in (
            same, again, upper > 1, marks > 1, (marks == size))] + [np.log2(safe) / 16]
    else:
        measures = [np.zeros(n)] * MEASURES
    for i, x in enumerate(measures):
        level = np.minimum((np.sqrt(x) if i < 5 else x) * LEVELS, LEVELS - 1).astype(int)
        out[np.arange(n), HASHED + SHAPES + i * LEVELS + level] = 1
    return out


def weighted(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Each of the three parts at length 1 (measures at length 2), so that none drowns the others."""
    x = np.log1p(counts) * idf
    for lo, hi, length in ((0, HASHED, 0.5), (HASHED, HASHED + SHAPES, 1.0), (HASHED + SHAPES, WIDTH, 2.0)):
        norm = np.sqrt((x[:, lo:hi] ** 2).sum(1, keepdims=True))
        x[:, lo:hi] *= length / np.maximum(norm, 1e-9)
    return x


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.sqrt((x * x).sum(1, keepdims=True)), 1e-9)


@dataclass
class Model:
    idf: np.ndarray
    basis: np.ndarray
    points: np.ndarray
    y: np.ndarray
    neighbours: int = NEIGHBOURS

    def votes(self, counts: np.ndarray) -> np.ndarray:
        latent = unit(weighted(counts, self.idf) @ self.basis).astype(np.float32)
        out = np.ones(len(latent))
        k = min(self.neighbours, len(self.y))
        for lo in range(0, len(latent) if k else 0, BLOCK):
            best = np.zeros((min(BLOCK, len(latent) - lo), 0), np.float32)
            vote = np.zeros_like(best)
            for at in range(0, len(self.y), BLOCK * 4):
                cosine = latent[lo:lo + BLOCK] @ self.points[at:at + BLOCK * 4].T
                best = np.concatenate([best, cosine], 1)
                vote = np.concatenate([vote, np.broadcast_to(self.y[at:at + BLOCK * 4], cosine.shape)], 1)
                if best.shape[1] > k:
                    top = np.argpartition(-best, k - 1, axis=1)[:, :k]
                    best, vote = np.take_along_axis(best, top, 1), np.take_along_axis(vote, top, 1)
            weight = np.maximum(best, 1e-3).astype(np.float64) ** SHARPNESS
            out[lo:lo + BLOCK] = (weight * vote).sum(1) / weight.sum(1)
        return np.clip(out, 0.0, 1.0)


def singular_vectors(x: np.ndarray, rank: int) -> np.ndarray:
    """The leading right singular vectors, by a randomised range finder with power steps."""
    rank = min(rank, *x.shape)
    q = x.T @ np.random.default_rng(7).standard_normal((x.shape[0], min(rank + 16, min(x.shape)))).astype(np.float32)
    for _ in range(4):
        q, _ = np.linalg.qr(x.T @ (x @ np.linalg.qr(q)[0]))
    _, _, vt = np.linalg.svd(x @ q, full_matrices=False)
    return (q @ vt.T[:, :rank]).astype(np.float32)


def fit(counts: np.ndarray, y: np.ndarray, rank: int = RANK, neighbours: int = NEIGHBOURS) -> Model:
    if not len(y):
        return Model(np.ones(WIDTH, np.float32), np.zeros((WIDTH, 1), np.float32), np.zeros((0, 1), np.float32), y)
    idf = np.log((1 + len(y)) / (1 + (counts > 0).sum(0))).astype(np.float32) + 0.1
    idf[HASHED + SHAPES:] = 1
    x = weighted(counts, idf).astype(np.float32)
    basis = singular_vectors(x, rank)
    return Model(idf, basis, unit(x @ basis).astype(np.float32), y.astype(np.float32), neighbours)


def train(rows: DataFrame, rank: int = RANK, neighbours: int = NEIGHBOURS) -> Model:
    """The model from stored (id, text, y) rows of a bounded number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in ta.slices(batch.column(0)):
                x = vectors(data, offsets)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(1).slice(lo, hi - lo), pa.array([r.tobytes() for r in x], pa.binary()), batch.column(2).slice(lo, hi - lo)],
                    ["y", "x", "id"])

    kind = rows.schema["id"].dataType.simpleString()
    got = rows.select("text", "y", "id").mapInArrow(run, f"y int, x binary, id {kind}").toPandas().sort_values("id", kind="stable")
    counts = np.stack([np.frombuffer(x, np.float32) for x in got["x"]]) if len(got) else np.zeros((0, WIDTH), np.float32)
    return fit(counts, got["y"].to_numpy(), rank, neighbours)


def _scores(texts: pa.Array, model: Model) -> np.ndarray:
    parts = []
    for _, _, data, offsets in ta.slices(texts):
        for lo in range(0, len(offsets) - 1, BLOCK):
            own = offsets[lo:lo + BLOCK + 1]
            parts.append(model.votes(vectors(data[own[0]:own[-1]], own - own[0])))
    return np.concatenate(parts) if parts else np.zeros(0)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score) of every document's whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(_scores(batch.column(1), shared.value), pa.float64())], ["doc_id", "score"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, score double")


def quality(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted."""
    model = train(training_rows(docs, labels, "quality", FOLDS, FOLD_OUT, fit_rows))
    return score(docs, model).select(
        "doc_id", held_out(F.col("doc_id"), FOLDS, FOLD_OUT).alias("held_out"), "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def accept(docs: DataFrame, labels: DataFrame, text_col: str = "text", threshold: float = THRESHOLD, fit_rows: int = FIT_ROWS) -> DataFrame:
    """The documents whose score reaches the threshold, all columns kept."""
    model = train(training_rows(docs, labels, "quality", FOLDS, FOLD_OUT, fit_rows, text_col=text_col))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(_scores(batch.column(at), shared.value) >= threshold, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
