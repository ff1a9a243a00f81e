"""Language identification: averaged hashed subword embeddings with a linear softmax, trained by SGD in numpy.

A text is the mean of the embeddings of its character 1- to 4-grams, hashed to 2**BITS places; a linear layer and softmax
follow. Scoring counts a text's places once and multiplies the counts with the embeddings, so that its memory is bounded
however long the text is and however many languages there are. Probabilities are calibrated by one temperature, and a text
whose best probability lies below what all but a few correctly judged calibration texts reach is not accepted.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import poly_hash
from .common import held_out, slices, stage

BITS, DIM, GRAMS = 15, 16, (1, 2, 3, 4)
#: Labelled rows that training sees at most, of one language and of all; with more languages than that, one row of each.
TRAIN_ROWS, ALL_ROWS = 600, 6000
#: Characters beyond which a text is learned from only if its language has too few shorter ones.
LONG = 50_000
EPOCHS, RATE = 8, 4.0
#: Share of correct calibration texts that rejection may cost.
COST = 0.01


def places(text: str | None) -> np.ndarray:
    """Places of all 1- to 4-grams of the lower-cased text between spaces, digits and marks left out."""
    code = np.frombuffer(f" {(text or '').lower()} ".encode("utf-32-le"), np.uint32).astype(np.uint64)
    code = np.where((code < 65) | ((code > 90) & (code < 97)) | ((code > 122) & (code < 192)), np.uint64(32), code)
    keep = np.ones(len(code), bool)
    keep[1:] = (code[1:] != 32) | (code[:-1] != 32)
    code = code[keep]
    out, h = [], np.zeros(len(code), np.uint64)
    for n in range(1, max(GRAMS) + 1):
        h = h[: len(code) - n + 1] * np.uint64(0x100000001B3) + code[n - 1 :]
        if n in GRAMS:
            out.append(poly_hash.mix(h + np.uint64(n << 56)) >> np.uint64(64 - BITS))
    return np.concatenate(out).astype(np.int32)


def has_letter(text: str | None) -> bool:
    return any(map(str.isalpha, text or ""))


def sample_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, lang, text) to (doc_id, lang, at, share): the distinct places of a text and their shares, once for the whole text and once for a few words of it."""
    for b in slices(batches):
        rows = []
        for d, lang, t in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
            words = t.split()
            i = hash(d * 2654435761 % 2**32) % max(1, len(words))
            for part in (t, " ".join(words[i : i + 6])):
                at, k = np.unique(places(part), return_counts=True)
                rows.append((d, lang, at, (k / k.sum()).astype(np.float32)))
        d, lang, at, share = zip(*rows, strict=True) if rows else ((),) * 4
        yield pa.RecordBatch.from_arrays([pa.array(d, pa.int64()), pa.array(lang, pa.string()), pa.array(at, pa.list_(pa.int32())), pa.array(share, pa.list_(pa.float32()))], ["doc_id", "lang", "at", "share"])


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


class Model:
    def __init__(self, languages: list[str], embedding: np.ndarray, layer: np.ndarray, bias: np.ndarray, temperature: float, least: float):
        self.languages, self.embedding, self.layer, self.bias, self.temperature, self.least = languages, embedding, layer, bias, temperature, least

    def probabilities(self, text: str | None) -> np.ndarray:
        at = places(text)
        counts = np.bincount(at, minlength=len(self.embedding)).astype(np.float32)
        return softmax(((counts @ self.embedding).astype(np.float64) / len(at) @ self.layer + self.bias) / self.temperature)


def fit(rows: list[tuple[str, np.ndarray, np.ndarray]], seed: int = 5) -> Model:
    """A model from (language, places, shares) rows; every fifth pair of rows only calibrates."""
    languages = sorted({r[0] for r in rows})
    if not languages:
        return Model(["und"], np.zeros((1 << BITS, 1), np.float32), np.zeros((1, 1), np.float32), np.zeros(1), 1.0, 0.0)
    y = np.array([languages.index(r[0]) for r in rows])
    aside = (np.arange(len(rows)) // 2) % 5 == 4
    rng = np.random.default_rng(seed)
    e = rng.normal(0, 0.1, (1 << BITS, DIM)).astype(np.float32)
    w, bias = np.zeros((DIM, len(languages)), np.float32), np.zeros(len(languages), np.float32)
    w += rng.normal(0, 0.1, w.shape).astype(np.float32)
    for epoch in range(EPOCHS):
        rate = RATE * (1 - epoch / EPOCHS)
        for i in rng.permutation(np.flatnonzero(~aside)):
            _, at, share = rows[i]
            x = share @ e[at]
            g = softmax(x @ w + bias)
            g[y[i]] -= 1
            back = w @ g
            w -= rate * 0.1 * np.outer(x, g)
            bias -= rate * 0.01 * g
            e[at] -= rate * np.outer(share, back)
    check = np.flatnonzero(aside)
    if not len(check):
        return Model(languages, e, w, bias, 1.0, 0.0)
    logits = np.array([rows[i][2] @ e[rows[i][1]] @ w + bias for i in check])
    loss = lambda t: -np.log(softmax(logits / t)[np.arange(len(check)), y[check]] + 1e-12).mean()
    temperature = min(np.geomspace(0.1, 10, 41), key=loss)
    p = softmax(logits / temperature)
    right = p.max(axis=1)[p.argmax(axis=1) == y[check]]
    return Model(languages, e, w, bias, float(temperature), float(np.quantile(right, COST)) if len(right) else 0.0)


def train(docs: DataFrame, rows: int = TRAIN_ROWS, all_rows: int = ALL_ROWS) -> Model:
    """A model of lang over the texts of docs of which held_out() is false; null languages, ids and texts are left out.

    Of each language the rows with the least hash of their id are taken: of a number that follows from how many it has, and
    among those, the ones of up to LONG characters first. Ties of repeated ids are broken by text, so the model does not
    depend on how rows lie. Texts are learned from whole. Without labelled rows every text is `und`.
    """
    known = docs.filter("lang IS NOT NULL AND doc_id IS NOT NULL AND text IS NOT NULL").filter(~held_out()).select("doc_id", "lang", "text")
    counts = stage(known.groupBy("lang").agg(F.count("*").alias("k")))
    languages = counts.count()
    if not languages:
        return fit([])
    each = max(1, min(rows, all_rows // languages))
    wide = each + 8 * int(each**0.5) + 8  # more than each, nearly surely
    limit = F.when(F.col("k") <= 2 * wide, F.lit(2.0**63)).otherwise(F.lit(2.0**63) * (2.0 * wide / F.col("k") - 1.0)).alias("limit")
    limits = counts.select(F.col("lang").alias("l"), limit)
    limits = F.broadcast(limits) if languages <= 100_000 else limits
    some = known.withColumn("h", F.xxhash64("doc_id")).join(limits, F.col("lang") == F.col("l")).filter("h < limit OR limit >= 9.2e18")
    order = Window.partitionBy("lang").orderBy(F.length("text") > LONG, "h", "doc_id", F.xxhash64("text"), "text")
    texts = some.withColumn("i", F.row_number().over(order)).filter(F.col("i") <= each)
    found = texts.select("doc_id", "lang", "text").mapInArrow(sample_features, "doc_id long, lang string, at array<int>, share array<float>").toArrow()  # 2 * max(all_rows, languages) rows at most
    data = zip(found.column(0).to_pylist(), found.column(1).to_pylist(), (x.values.to_numpy() for x in found.column(2)), (x.values.to_numpy() for x in found.column(3)), strict=True)
    pairs = [(x, y) for x, y in itertools.batched(data, 2, strict=True)]  # the whole text and a few words of it
    pairs.sort(key=lambda p: (p[0][0], p[0][1], p[0][2].tobytes(), p[0][3].tobytes()))
    return fit([r[1:] for p in pairs for r in p])


def identify(docs: DataFrame, model: Model, reject: bool = False) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, accepted) for each row of docs.

    Texts that are null or have no letter are `und` with score 0. accepted: the score reaches what calibration asks for;
    with reject, what does not is `und` too. Very long texts are read whole; repeated rows, null ids and extra columns make no
    difference; an empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast((model.languages, model.embedding, model.layer, model.bias, model.temperature, model.least))  # 2**BITS rows of DIM, and DIM a language

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Model(*shared.value)
        for b in batches:
            lang, score, accepted = [], [], []
            for t in b.column(2):
                text = t.as_py()
                p = m.probabilities(text) if has_letter(text) else np.zeros(1)
                best = int(p.argmax())
                accepted.append(bool(p[best] >= max(m.least, 1e-9)))
                lang.append(m.languages[best] if p[best] > 0 and (accepted[-1] or not reject) else "und")
                score.append(float(p[best]))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(accepted, pa.bool_())], ["doc_id", "held_out", "lang_pred", "score", "accepted"])

    return docs.select("doc_id", held_out().alias("held_out"), "text").mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double, accepted boolean")
