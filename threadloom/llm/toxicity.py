"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

A text's features are its distinct words, pairs of neighbours and pairs with one word between them, hashed to 2**BITS
places. The learner keeps a rate of its own for each place and an L1 penalty, so few places end with a weight; those are
all that scoring needs, 2**BITS entries at most.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import poly_hash
from .common import held_out, slices

BITS = 20
#: Labelled rows that the learner sees at most.
TRAIN_ROWS = 6000
ALPHA, BETA, L1, L2, EPOCHS = 0.5, 1.0, 12.0, 1.0, 6
THRESHOLD = 0.3
BYTES = poly_hash.values(70)
WORD = np.array([b >= 128 or chr(b).isalnum() for b in range(256)])
MARK = np.uint64(0xA5A5A5A55A5A5A5A)


def features(text: str | None) -> np.ndarray:
    """Sorted distinct places of a text's words, word pairs and skip pairs; none for a text without words."""
    raw = np.frombuffer((text or "").lower().encode(), np.uint8)
    inside = WORD[raw]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    start = (np.cumsum(inside) - 1)[first]
    if not len(start):
        return np.empty(0, np.int32)
    prefix = poly_hash.prefixes(BYTES[raw[inside]])
    w = poly_hash.spans(prefix, start, np.append(start[1:], len(prefix) - 1))
    near = poly_hash.mix(w[:-1] * np.uint64(3) + w[1:] + MARK)
    skip = poly_hash.mix(w[:-2] * np.uint64(5) + w[2:] - MARK)
    return np.unique(np.concatenate([w, near, skip]) >> np.uint64(64 - BITS)).astype(np.int32)


def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, y, text) to (doc_id, y, places)."""
    for b in slices(batches):
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([features(t.as_py()) for t in b.column(2)], pa.list_(pa.int32()))], ["doc_id", "y", "places"])


def ftrl(rows: list[tuple[int, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, float]:
    """Places with a weight, their weights and the bias, from (label, places) rows in order."""
    z, n, z0, n0 = np.zeros(1 << BITS), np.zeros(1 << BITS), 0.0, 0.0

    def weights(zi, ni):
        return np.where(np.abs(zi) > L1, -(zi - np.sign(zi) * L1) / ((BETA + np.sqrt(ni)) / ALPHA + L2), 0.0)

    for _ in range(EPOCHS):
        for y, at in rows:
            w, b = weights(z[at], n[at]), -z0 / ((BETA + n0**0.5) / ALPHA)
            p = 1 / (1 + np.exp(-np.clip(w.sum() + b, -35, 35)))
            g = p - y
            sigma = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / ALPHA
            z[at] += g - sigma * w
            n[at] += g * g
            z0 += g - ((n0 + g * g) ** 0.5 - n0**0.5) / ALPHA * b
            n0 += g * g
    w = weights(z, n)
    kept = np.flatnonzero(w)
    return kept.astype(np.int32), w[kept].astype(np.float32), -z0 / ((BETA + n0**0.5) / ALPHA)


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> tuple[np.ndarray, np.ndarray, float]:
    """A model of labels.toxic over the texts of docs, from rows of which held_out() is false.

    The TRAIN_ROWS labels with the least hash of their id are learned from, or all if there are fewer. Null labels and ids
    are left out; a repeated id counts as toxic if any of its labels does, and each text with that id is learned from. Texts are
    taken whole, however long; extra columns are ignored. Without labels, or without texts, every score is that of a bias.
    """
    known = labels.filter("toxic IN (0, 1) AND doc_id IS NOT NULL").filter(~held_out()).groupBy("doc_id").agg(F.max("toxic").alias("y"))
    sample = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    texts = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")  # rows ids at most
    found = texts.select("doc_id", "y", "text").mapInArrow(extract, "doc_id long, y int, places array<int>").toArrow()
    data = list(zip(found.column(0).to_pylist(), found.column(1).to_pylist(), (x.values.to_numpy() for x in found.column(2)), strict=True))
    if not data:
        return np.empty(0, np.int32), np.empty(0, np.float32), -5.0
    data.sort(key=lambda r: (r[0] * 2654435761 % 2**32, r[0], r[2].tobytes()))  # the same order however rows lie, repeated ids included
    return ftrl([(y, at) for _, y, at in data])


def score(docs: DataFrame, model: tuple[np.ndarray, np.ndarray, float], threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row of docs; texts without words, null ones among them, score
    as the bias says, very long ones are read whole, repeated rows score alike, and an empty table gives no rows."""
    places, weights, bias = model
    shared = docs.sparkSession.sparkContext.broadcast((places, weights))  # 2**BITS entries at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dense = np.zeros(1 << BITS, np.float32)
        dense[shared.value[0]] = shared.value[1]
        for b in batches:
            total = np.array([dense[features(t.as_py())].sum(dtype=np.float64) for t in b.column(2)])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(1 / (1 + np.exp(-np.clip(total + bias, -35, 35))))], ["doc_id", "held_out", "score"])

    out = docs.select(F.col("doc_id"), held_out().alias("held_out"), "text").mapInArrow(run, "doc_id long, held_out boolean, score double")
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
