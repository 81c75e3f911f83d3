"""Quality classifier: hashed word n-grams, logistic regression trained by follow-the-regularised-leader.

A text becomes a sparse vector: its words and marks, and the pairs of neighbours, hashed into a fixed number of
slots (pairs of equal words share one more), with the square root of each count, scaled to length one. Training is the FTRL-proximal update with an L1
and an L2 term, one document at a time in a fixed order; a score is the logistic function of the sparse dot
product. Only the text is ever an input.

The training set is a sample of labelled rows, bounded by ``max_rows`` and ``max_chars`` (documented parameters),
taken by smallest hash of the id, so it is the same on every run. What the driver holds is that sample's
sparse vectors and one weight a slot.

Cases: null counts as empty; the empty text has the bias alone; labels that are null are left out; with no labels
at all every score is 0.5; repeated rows are scored each.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Memo, map_batches, release, text_of

SLOTS = 1 << 18
#: Words, or runs of marks.
TOKEN = re.compile(r"\w+|[^\w\s]+")
MEMO_WORDS = 300_000
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def _word_hash(word: str) -> int:
    return zlib.crc32(word.encode("utf-8", "surrogatepass"))


class Features:
    """Sparse vectors of texts."""

    def __init__(self, slots: int = SLOTS):
        self.slots = slots
        self.memo = Memo(_word_hash, MEMO_WORDS)

    def vector(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Slots (sorted, distinct; slot 0 is the bias, the last one any word that follows itself) and values."""
        memo = self.memo
        words = np.fromiter((memo[w] for w in TOKEN.findall(text)), np.uint64)
        if not len(words):
            return np.zeros(1, np.int64), np.ones(1)
        pairs = words[:-1] * np.uint64(31) + words[1:] + np.uint64(1 << 33)
        mixed = np.concatenate([words, pairs]) * MULTIPLIER
        slot = (mixed >> np.uint64(40)) % np.uint64(self.slots - 2) + np.uint64(1)
        slot, count = np.unique(slot.astype(np.int64), return_counts=True)
        twice = int((words[1:] == words[:-1]).sum())
        if twice:
            slot, count = np.append(slot, self.slots - 1), np.append(count, twice)
        value = np.sqrt(count)
        value /= np.sqrt((value * value).sum())
        return np.concatenate([[0], slot]), np.concatenate([[1.0], value])


@dataclass(frozen=True)
class Ftrl:
    """Parameters of the FTRL-proximal update (defaults chosen on a fold of the training rows)."""

    alpha: float = 2.0
    beta: float = 1.0
    l1: float = 0.005
    l2: float = 0.01
    epochs: int = 12

    def fit(self, vectors: list[tuple[np.ndarray, np.ndarray]], labels: list[int], slots: int = SLOTS) -> np.ndarray:
        """Weights after ``epochs`` passes in the given order."""
        z, n = np.zeros(slots), np.zeros(slots)
        for _ in range(self.epochs):
            for (at, x), y in zip(vectors, labels, strict=True):
                w = self._weights(z[at], n[at])
                g = (_logistic(float(w @ x)) - y) * x
                sigma = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / self.alpha
                z[at] += g - sigma * w
                n[at] += g * g
        return self._weights(z, n)

    def _weights(self, z: np.ndarray, n: np.ndarray) -> np.ndarray:
        w = (np.sign(z) * self.l1 - z) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)
        return np.where(np.abs(z) <= self.l1, 0.0, w)


def _logistic(x: float) -> float:
    return float(1 / (1 + np.exp(-np.clip(x, -35, 35))))


def fold(id_col: Column) -> Column:
    """crc32 of the id as text, modulo 5."""
    return F.crc32(id_col.cast("string").cast("binary")) % 5


def train(docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text", max_rows: int = 4000, max_chars: int = 40_000_000, ftrl: Ftrl = Ftrl(), slots: int = SLOTS) -> np.ndarray:
    """Weights from a bounded sample of ``labels`` rows joined to ``docs``.

    Rows with the smallest hash of the id come first; ``max_chars`` bounds their texts' total length.
    """
    chosen = labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
    chosen = chosen.groupBy(id_col).agg(F.max(label_col).cast("int").alias("__label"))
    order = F.xxhash64(F.col(id_col).cast("string"))
    few = chosen.select(F.col(id_col).alias("__id"), "__label", order.alias("__order")).orderBy("__order", "__id").limit(max_rows)
    sample = docs.select(F.col(id_col).alias("__id"), text_of(text_col).alias("__text")).join(F.broadcast(few), "__id")  # few has max_rows rows at most

    def make():
        features = Features(slots)

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            found = [features.vector(t) for t in batch.column(3).to_pylist()]
            return pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), batch.column(2), pa.array([len(t) for t in batch.column(3).to_pylist()], pa.int64()), pa.array([a.astype("<i4").tobytes() for a, _ in found], pa.binary()), pa.array([v.astype("<f4").tobytes() for _, v in found], pa.binary())],
                ["ord", "key", "label", "chars", "slots", "vals"],
            )

        return step

    key = F.col("__id").cast("string")
    rows = map_batches(sample.select("__order", key.alias("key"), "__label", "__text"), make, "ord long, key string, label int, chars long, slots binary, vals binary")
    held = sorted(rows.orderBy("ord", "key").limit(max_rows).collect(), key=lambda r: (r["ord"], r["key"], bytes(r["slots"])))
    vectors, ys, total = [], [], 0
    for r in held:
        total += r["chars"]
        if total > max_chars and vectors:
            break
        vectors.append((np.frombuffer(r["slots"], "<i4").astype(np.int64), np.frombuffer(r["vals"], "<f4").astype(float)))
        ys.append(int(r["label"] > 0))
    return ftrl.fit(vectors, ys, slots)


def score_column(weights: np.ndarray, slots: int = SLOTS):
    """A function of a text column: the probability of label 1 (double from 0 to 1; null counts as empty)."""
    held = weights.astype(np.float32)

    @F.pandas_udf("double")
    def scored(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        features, w = Features(slots), held.astype(np.float64)
        for texts in parts:
            found = (features.vector(t or "") for t in texts)
            yield pd.Series([_logistic(float(w[at] @ x)) for at, x in found], dtype="float64")
        texts = found = features = w = None
        release()

    return scored
