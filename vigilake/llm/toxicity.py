"""Toxicity classifier with a counterfactual penalty.

A logistic model over words and word beginnings.  In every labelled sentence that names people, each identity
term is swapped for every other of its group, and the squared change of the sentence's score is penalised in
training, so that a neutral mention of a group moves a score as little as a mention of any other.

Training sees at most ``FIT_ROWS`` labelled rows and ``FIT_PAIRS`` pairs of a sentence and its swapped copy
(parameters; pairs are taken by the hash of their text).  Features are counted in Spark, the ``FEATURES`` most
telling ones and those of identity terms are kept, and the model is fitted on that bounded matrix.  Every document
is scored as a whole where it is read; what is broadcast is the model.

Defined cases: null and empty text get the score of the intercept; without labels, or with labels of one
class, the score is the share of that class (0 without labels); a null id is not held out; repeated rows get
equal scores; other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import batched

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigilake.llm import textarrays as ta
from vigilake.llm.common import keep
from vigilake.llm.fixed_values import IDENTITY_GROUPS
from vigilake.llm.labelled import held_out, training_rows

FIT_ROWS = 6000
FIT_PAIRS = 4000
FEATURES = 4096
PREFIXES = (4, 6, 8)
PENALTY = 4.0
THRESHOLD = 0.3
FOLDS, FOLD_OUT = 4, 2
#: an identity term, and all others of its groups
TERMS = {t: sorted({o for g in IDENTITY_GROUPS if t in g for o in g} - {t}) for group in IDENTITY_GROUPS for t in group}
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_LOWER = str.maketrans({c: chr(c + 32) for c in range(65, 91)})


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, feature hash) of every word and word beginning, and the number of words per text."""
    low = ta.LOWER[data]
    start, end, row = ta.words(low, offsets, ta.LETTERS)
    n_words = np.bincount(row, minlength=len(offsets) - 1)
    if not len(start):
        return row, np.zeros(0, np.uint64), n_words
    prefix = ta.prefix_hash(low)
    rows, hashes = [row], [ta.span_hash(prefix, start, end)]
    for size in PREFIXES:
        long = end - start > size
        rows.append(row[long])
        hashes.append(ta.span_hash(prefix, start[long], start[long] + size) ^ np.uint64(size))
    return np.concatenate(rows), np.concatenate(hashes), n_words


def feature_of(word: str) -> np.ndarray:
    raw = np.frombuffer(word.encode(), np.uint8)
    return features(raw, np.array([0, len(raw)]))[1]


def weight_of(count: np.ndarray, n_words: np.ndarray) -> np.ndarray:
    """Grows with the share of the words, from 1 for a word that is there at all."""
    return 1.0 + np.log1p(100.0 * count / np.maximum(n_words, 20))


def counted(rows: np.ndarray, columns: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    both, count = np.unique(rows * width + columns, return_counts=True)
    return both // width, both % width, count


@dataclass
class Model:
    hashes: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    bias: float = -50.0

    def columns(self, rows: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The occurrences whose feature is in the model, with its column."""
        if not len(self.hashes) or not len(hashes):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        bitmap = np.zeros(1 << 18, bool)
        bitmap[self.hashes >> np.uint64(46)] = True
        maybe = np.flatnonzero(bitmap[hashes >> np.uint64(46)])
        at = np.minimum(np.searchsorted(self.hashes, hashes[maybe]), len(self.hashes) - 1)
        good = self.hashes[at] == hashes[maybe]
        return rows[maybe][good], at[good]

    def vectors(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, column, value) of the features of each text that are in the model."""
        rows, hashes, n_words = features(data, offsets)
        r, c, n = counted(*self.columns(rows, hashes), max(len(self.hashes), 1))
        return r, c, weight_of(n, n_words[r])

    def scores(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        r, c, x = self.vectors(data, offsets)
        z = np.full(len(offsets) - 1, self.bias)
        if len(r):
            z += np.bincount(r, self.weights[c] * x, minlength=len(z))
        return logistic(z)


def swapped(sentence: str) -> Iterator[str]:
    """Copies of a lower-case sentence: all places of one identity term taken by one other of its group."""
    for term in sorted(set(_WORD.findall(sentence)) & TERMS.keys()):
        for other in TERMS[term]:
            yield _WORD.sub(lambda m: other if m[0] == term else m[0], sentence)


def counterfactuals(text: str) -> Iterator[tuple[str, str]]:
    """(sentence, swapped copy) of all sentences that name people, ASCII letters lower-cased."""
    for sentence in re.split(r"[.!?\n]+", text):
        low = sentence.strip().translate(_LOWER)
        for copy in swapped(low):
            yield low, copy


@dataclass
class Vectors:
    """Rows of a sparse matrix."""

    rows: np.ndarray
    columns: np.ndarray
    values: np.ndarray
    n: int

    def times(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.rows, self.values * w[self.columns], minlength=self.n)

    def sums(self, factors: np.ndarray, width: int) -> np.ndarray:
        return np.bincount(self.columns, self.values * factors[self.rows], minlength=width)


def logistic(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -50, 50)))


def fit_logistic(
    x: Vectors, y: np.ndarray, width: int, before: Vectors, after: Vectors, times: np.ndarray, penalty: float,
    ridge: float = 1e-3, steps: int = 300,
) -> tuple[np.ndarray, float]:
    """Adam on the mean log loss, a ridge, and the mean squared change of the score from a sentence to its swapped copy.

    The change is taken 16 times: a score moves by a quarter of what its logit moves, at most.
    """
    w, b, n = np.zeros(width), float(np.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3))), len(y)
    m, v, rate = np.zeros(width + 1), np.zeros(width + 1), 0.05
    share = 32 * penalty * times / max(times.sum(), 1)
    for step in range(1, steps + 1):
        error = (logistic(x.times(w) + b) - y) / n
        g, g0 = x.sums(error, width) + ridge * w, error.sum()
        if before.n:
            p, q = logistic(before.times(w) + b), logistic(after.times(w) + b)
            down, up = share * (q - p) * p * (1 - p), share * (q - p) * q * (1 - q)
            g += after.sums(up, width) - before.sums(down, width)
            g0 += (up - down).sum()
        g = np.append(g, g0)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        move = rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        w, b = w - move[:-1], b - move[-1]
    return w, b


def _vectors(rows: DataFrame, texts: list[str], carried: str, model: Model) -> pa.Table:
    """A column of the rows, and for each text column the model's columns and values of each text; to the driver."""
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [batch.column(0)]
            for at in range(1, batch.num_columns):
                columns, values = [], []
                for _, _, data, offsets in ta.slices(batch.column(at)):
                    r, c, x = shared.value.vectors(data, offsets)
                    bounds = np.searchsorted(r, np.arange(len(offsets)))
                    columns += [c[a:b].astype(np.int32) for a, b in zip(bounds[:-1], bounds[1:])]
                    values += [x[a:b] for a, b in zip(bounds[:-1], bounds[1:])]
                out += [pa.array(columns, pa.list_(pa.int32())), pa.array(values, pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays(out, names)

    names = [carried, *[f"{kind}{i}" for i in range(len(texts)) for kind in "cx"]]
    parts = ", ".join(f"c{i} array<int>, x{i} array<double>" for i in range(len(texts)))
    return rows.select(carried, *texts).mapInArrow(run, f"{carried} {rows.schema[carried].dataType.simpleString()}, {parts}").toArrow()


def _matrix(got: pa.Table, i: int) -> Vectors:
    columns, values = (got.column(f"{kind}{i}").combine_chunks() for kind in "cx")
    n = got.num_rows
    if not n:
        return Vectors(np.zeros(0, int), np.zeros(0, int), np.zeros(0), 0)
    lengths = np.diff(columns.offsets.to_numpy())
    return Vectors(np.repeat(np.arange(n), lengths), columns.flatten().to_numpy(), values.flatten().to_numpy(), n)


def train(rows: DataFrame, n_features: int = FEATURES, penalty: float = PENALTY, fit_pairs: int = FIT_PAIRS) -> Model:
    """The model from stored (id, text, y) rows of a bounded number."""
    total, positive = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum("y"), F.lit(0))).first()
    if not total:
        return Model()
    if positive in (0, total):
        return Model(bias=50.0 if positive else -50.0)

    def present(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            y = batch.column(1).to_numpy(zero_copy_only=False)
            for lo, hi, data, offsets in ta.slices(batch.column(0)):
                r, h, _ = features(data, offsets)
                order = np.lexsort((r, h))
                r, h = r[order], h[order]
                first = np.append(True, (h[1:] != h[:-1]) | (r[1:] != r[:-1])) if len(h) else np.zeros(0, bool)
                hashes, start = np.unique(h[first], return_index=True)
                toxic = np.add.reduceat(y[lo:hi][r[first]], start) if len(start) else start
                yield pa.RecordBatch.from_arrays([
                    pa.array(hashes.view(np.int64)), pa.array(np.diff(np.append(start, first.sum())), pa.int64()),
                    pa.array(toxic, pa.int64())], ["h", "n", "pos"])

    counts = rows.select("text", F.col("y").cast("long")).mapInArrow(present, "h long, n long, pos long").groupBy("h").agg(
        F.sum("n").alias("n"), F.sum("pos").alias("pos")).filter("n >= 3")
    # G-like gain of a feature: squared difference of log odds, by how often it is there
    share = positive / total
    gain = F.pow(F.log((F.col("pos") + share) / (F.col("n") - F.col("pos") + 1 - share)) - float(np.log(share / (1 - share))), 2) * F.sqrt("n")
    chosen = [r["h"] for r in counts.orderBy(F.desc(gain), "h").limit(n_features).collect()]
    hashes = np.unique(np.concatenate([np.array(chosen, np.int64).view(np.uint64), *[feature_of(t) for t in TERMS]]))
    model = Model(hashes, np.zeros(len(hashes)), 0.0)

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text in batch.column(0):
                for some in batched(counterfactuals(text.as_py()), 500):
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.string()) for x in zip(*some)], ["a", "b"])

    # a pair counts as often as it is there
    found = rows.select("text").mapInArrow(pairs, "a string, b string").groupBy("a", "b").agg(F.count(F.lit(1)).cast("double").alias("times"))
    chosen_pairs = keep(found.orderBy(F.xxhash64("a", "b"), "a", "b").limit(fit_pairs))
    changed = _vectors(chosen_pairs, ["a", "b"], "times", model)
    got = _vectors(rows, ["text"], "y", model)
    model.weights, model.bias = fit_logistic(
        _matrix(got, 0), got.column("y").to_numpy().astype(float), len(hashes), _matrix(changed, 0), _matrix(changed, 1),
        changed.column("times").to_numpy(), penalty)
    return model


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score) of every document's whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [shared.value.scores(data, offsets) for _, _, data, offsets in ta.slices(batch.column(1))]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.concatenate(parts) if parts else np.zeros(0), pa.float64())], ["doc_id", "score"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, score double")


def toxicity(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, penalty: float = PENALTY) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted."""
    model = train(training_rows(docs, labels, "toxic", FOLDS, FOLD_OUT, fit_rows), penalty=penalty)
    return score(docs, model).select(
        "doc_id", held_out(F.col("doc_id"), FOLDS, FOLD_OUT).alias("held_out"), "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
