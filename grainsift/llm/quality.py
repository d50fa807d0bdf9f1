"""Text quality by a Naive Bayes support vector machine.

The features of a text are indicators of n-grams: of its words (one and two) and of the
shapes of its words (one to three), where a shape keeps kinds of characters and marks and
says whether a word repeats the one before. Each indicator is scaled by the log ratio of its
smoothed counts in the two classes, each text to length one, and a linear model with hinge
loss is fitted to that by dual coordinate descent. A logistic curve, fitted to texts that
the model has not seen, turns margins into scores from 0 to 1.

Only the model is fitted on a bounded number of labelled rows (``MAX_LABELLED``, those with
the least hash of their id); scoring reads all texts whole, in one pass without a shuffle.

Null and empty texts have no n-gram and get the score of the intercept. Without labels of
both classes every text gets the share of label 1 (or 0.5 without labels). Labels that are
null are left out; an id with several labels or texts gives a row for each combination.
Repeated rows give equal scores. Only id and text columns are read, others pass through.
"""

from __future__ import annotations

import functools
import math
import re
from dataclasses import dataclass
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from .common import CACHE_ENTRIES, at_release, few_hashes, free_name, map_arrow, refuse_clash, small_batches
from .fingerprints import mixed

BITS = 18
MAX_LABELLED = 8_000
THRESHOLD = 0.3


def shape_of(word: str) -> str:
    """Kinds of characters, runs as one: a, A, 0 and marks as they are."""
    kinds = "".join("0" if c.isdigit() else "A" if c.isupper() else "a" if c.isalpha() else c for c in word)
    return re.sub(r"(.)\1+", r"\1", kinds)


class Words(dict):
    """48 bits of a word and, in the lowest 16, of its shape."""

    def __missing__(self, word: str) -> int:
        part = lambda text, size: int.from_bytes(blake2b(text.encode(), digest_size=size).digest(), "little")
        value = part(word.lower(), 6) << 16 | part(shape_of(word), 2)
        if len(word) <= 64:
            if len(self) >= CACHE_ENTRIES:
                self.clear()
            self[word] = value
        return value


_WORDS = Words()
at_release(_WORDS.clear)


def features(text: str | None) -> np.ndarray:
    """Distinct numbers below 2**BITS of the n-grams of a whole text."""
    words = text.split() if text else []
    if not words:
        return np.zeros(0, np.int64)
    both = np.fromiter(map(_WORDS.__getitem__, words), np.uint64, len(words))
    word, shape = both >> np.uint64(16), both & np.uint64(0xFFFF)
    shape[1:] += np.uint64(1 << 16) * (word[1:] == word[:-1])
    with np.errstate(over="ignore"):
        step = lambda x, y: mixed(x * np.uint64(0x9E3779B97F4A7C15) + y)
        one, pair = step(shape, np.uint64(1)), step(word, np.uint64(2))
        two = step(one[:-1], shape[1:])
        grams = [one, two, step(two[:-1], shape[2:]), pair, step(pair[:-1], word[1:])]
    return np.unique(np.concatenate(grams) >> np.uint64(64 - BITS)).astype(np.int64)


@dataclass
class Model:
    weights: np.ndarray  # of indicators, the class ratios included
    ratios: np.ndarray
    bias: float
    slope: float
    shift: float

    def margin(self, found: np.ndarray) -> float:
        length = math.sqrt(float(np.sum(self.ratios[found] ** 2))) or 1.0
        return float(self.weights[found].sum()) / length + self.bias

    def score(self, text: str | None) -> float:
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, self.slope * self.margin(features(text)) + self.shift))))


def descend(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, c: float, epochs: int, size: int, seed: int):
    """Dual coordinate descent for the hinge loss; rows: positions and values, y: -1 or 1."""
    rng = np.random.default_rng(seed)
    w, bias, alpha = np.zeros(size), 0.0, np.zeros(len(rows))
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            at, x = rows[i]
            gradient = y[i] * (w[at] @ x + bias) - 1
            new = min(max(alpha[i] - gradient / (x @ x + 1), 0.0), c)
            if new != alpha[i]:
                step = (new - alpha[i]) * y[i]
                w[at] += step * x
                bias += step
                alpha[i] = new
    return w, bias


def logistic_curve(margins: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the curve that fits the labels best, by Newton steps."""
    a, b = 1.0, 0.0
    n1, n0 = labels.sum(), len(labels) - labels.sum()
    goal = np.where(labels == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * margins + b, -30, 30)))
        g, h = p - goal, p * (1 - p) + 1e-9
        m = np.array([[h @ margins**2 + 1e-6, h @ margins], [h @ margins, h.sum() + 1e-6]])
        step = np.linalg.solve(m, [g @ margins, g.sum()])
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-8:
            break
    return (a, b) if a > 0 else (1.0, 0.0)


def fit(found: list[np.ndarray], labels: np.ndarray, c: float = 1.0, epochs: int = 12, seed: int = 7) -> Model:
    """The model of lists of features and their labels (0 or 1)."""
    size = 1 << BITS
    if len(set(labels.tolist())) < 2:
        share = float(labels.mean()) if len(labels) else 0.5
        shift = math.log(min(max(share, 1e-3), 1 - 1e-3) / (1 - min(max(share, 1e-3), 1 - 1e-3)))
        return Model(np.zeros(size), np.zeros(size), 0.0, 1.0, shift)
    apart = np.random.default_rng(seed).random(len(labels)) < 0.2  # for the curve
    if len(set(labels[~apart].tolist())) < 2 or not apart.any():
        apart[:] = False
    counts = np.ones((2, size))
    for f, label in zip(found, labels):
        counts[label, f] += 1
    ratios = np.log(counts[1] / counts[1].sum()) - np.log(counts[0] / counts[0].sum())
    ratios[counts.sum(0) < 5] = 0.0  # seen fewer than three times
    rows = []
    for f in found:
        x = ratios[f]
        rows.append((f, (x / (math.sqrt(float(x @ x)) or 1.0)).astype(np.float32)))  # the driver holds all of them
    y = np.where(labels == 1, 1.0, -1.0)
    learn = np.flatnonzero(~apart)
    w, bias = descend([rows[i] for i in learn], y[learn], c, epochs, size, seed)
    model = Model(w * ratios, ratios, bias, 1.0, 0.0)
    seen = np.flatnonzero(apart) if apart.any() else learn
    model.slope, model.shift = logistic_curve(np.array([model.margin(found[i]) for i in seen]), labels[seen])
    return model


def _feature_batches(batches):
    for batch in small_batches(batches):
        found = [features(t).astype(np.int32) for t in batch.column(2).to_pylist()]
        marks = [int.from_bytes(blake2b(f.tobytes(), digest_size=8).digest(), "little", signed=True) for f in found]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(marks, pa.int64()), pa.array(found, pa.list_(pa.int32()))],
            ["id", "label", "mark", "found"])


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", id_column: str = "doc_id", text_column: str = "text",
          limit: int = MAX_LABELLED) -> Model:
    """Fit on at most ``limit`` labelled documents; labels: the id column and ``label``."""
    given = (labels.filter(F.col(label).isNotNull() & F.col(id_column).isNotNull())
             .select(F.col(id_column).cast("bigint").alias("id"), F.col(label).cast("int").alias("label")).distinct())
    few = F.broadcast(few_hashes(given, "id", limit))  # ``limit`` rows at most
    some = given.join(few, F.xxhash64("id") == F.col("h")).select("id", "label").orderBy(F.xxhash64("id"), "label").limit(limit)
    rows = docs.select(F.col(id_column).cast("bigint").alias("id"), F.col(text_column).cast("string").alias("text"))
    known = rows.join(F.broadcast(some), "id").select("id", "label", "text")  # at most ``limit`` rows are broadcast
    found = map_arrow(known, _feature_batches, "id bigint, label int, mark bigint, found array<int>")
    table = found.orderBy(F.xxhash64("id"), "id", "label", "mark").limit(limit).toArrow().combine_chunks()
    lists = [x.values.to_numpy(zero_copy_only=False) for x in table["found"]]  # views of one buffer
    return fit(lists, table["label"].to_numpy().astype(np.int64))


def _score_batches(batches, shared, text_at, drop_text, column):
    for batch in small_batches(batches):
        model = shared.value
        scores = [model.score(t) for t in batch.column(text_at).to_pylist()]
        columns = dict(zip(batch.schema.names, batch.columns))
        if drop_text:
            del columns[batch.schema.names[text_at]]
        yield pa.RecordBatch.from_arrays([*columns.values(), pa.array(scores, pa.float64())], [*columns, column])


def score(docs: DataFrame, model: Model, column: str = "score", text_column: str = "text", drop_text: bool = False) -> DataFrame:
    """The documents with a column of scores; a name that one of theirs has is refused."""
    spark = docs.sparkSession
    refuse_clash(docs.columns, column)
    text_at = docs.columns.index(text_column)
    fields = [f for f in docs.schema.fields if not (drop_text and f.name == text_column)]
    work = functools.partial(_score_batches, shared=spark.sparkContext.broadcast(model), text_at=text_at,
                             drop_text=drop_text, column=column)
    return map_arrow(docs, work, T.StructType([*fields, T.StructField(column, T.DoubleType())]))


def held_out(id_column: str = "doc_id"):
    """Rows that are never learned from: a fifth, by the CRC of the id as text."""
    return F.coalesce(F.crc32(F.col(id_column).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, text_column: str = "text") -> DataFrame:
    """The documents with a score of at least ``threshold``, with their own columns."""
    model = train(docs, labels.filter(~held_out()), text_column=text_column)
    column = free_name(docs.columns, "score")
    return score(docs, model, column, text_column).filter(F.col(column) >= threshold).drop(column)
