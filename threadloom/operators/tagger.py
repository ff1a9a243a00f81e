"""A second annotator: an averaged structured perceptron over tokens, decoded by Viterbi, trained in shards that are mixed."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import seeded
from ..sources.shared import cut, lean
from .spans import LABELS, SPANS, bio_labels, decode_tags

PLACES, SHARDS, EPOCHS = 1 << 16, 4, 4
#: Examples of a shard, about, where there are more than SHARDS such.
EACH = 2_000
#: Characters of the texts that are read at a time, about, and of those that are learned from; texts that are tagged ahead, at most.
READ, TAUGHT, AHEAD = 1 << 22, 1 << 20, 512
_TOKEN = re.compile(r"\w+|[^\w\s]")
_SHAPES = ((re.compile(r"[^\W\d_]+"), lambda m: "X" if m.group(0)[0].isupper() else "x"), (re.compile(r"\d"), lambda m: "9"))


class Tags:
    """The tags, and which may follow which: an I- only comes after a tag of its label."""

    def __init__(self, labels: tuple[str, ...]):
        self.names = bio_labels(labels)
        self.index = {t: i for i, t in enumerate(self.names)}
        n = len(self.names)
        self.barred = np.zeros((n, n))
        self.first = np.zeros(n)
        for j, after in enumerate(self.names):
            if after.startswith("I-"):
                self.first[j] = -np.inf
                self.barred[[i for i, before in enumerate(self.names) if before[2:] != after[2:]], j] = -np.inf


def features(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """How many tokens each text has, their offsets, and the numbers of the features of each: the token, its ends and shape, its
    neighbours. A feature is numbered once for all tokens that have it."""
    seen: dict[str, int] = {}
    sizes, begins, codes = [], [], []
    for text in texts:
        found = _TOKEN.findall(text)
        sizes.append(len(found))
        begins += [m.start() for m in _TOKEN.finditer(text)]
        codes += [seen.setdefault(w, len(seen)) for w in found]
    lows, shapes = {"": 0}, {"": 0}
    of_low, of_shape = np.empty(len(seen), dtype=np.int64), np.empty(len(seen), dtype=np.int64)
    for i, w in enumerate(seen):
        of_low[i] = lows.setdefault(w.lower(), len(lows))
        for pattern, short in _SHAPES:
            w = pattern.sub(short, w)
        of_shape[i] = shapes.setdefault(w[:24], len(shapes))
    codes, sizes, begins = (np.array(x, dtype=np.int64) for x in (codes, sizes, begins))
    ends = begins + np.array([len(w) for w in seen], dtype=np.int64)[codes]
    low, shape, words, forms = of_low[codes], of_shape[codes], list(lows), list(shapes)
    at = np.arange(len(codes)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    left = np.repeat(sizes, sizes) - at

    def beside(of: np.ndarray, by: int) -> np.ndarray:
        """The neighbour's number, 0 beyond the text."""
        return np.where(at + by >= 0, np.roll(of, -by), 0) if by < 0 else np.where(left > by, np.roll(of, -by), 0)

    def number(names: list[str], of: np.ndarray) -> np.ndarray:
        return np.array([zlib.crc32(s.encode("utf-8", "surrogatepass")) % PLACES for s in names], dtype=np.int32)[of]

    def pairs(prefix: str, a: np.ndarray, of_a: list[str], b: np.ndarray, of_b: list[str]) -> np.ndarray:
        both, of = np.unique(a * len(of_b) + b, return_inverse=True)
        return number([f"{prefix}{of_a[x // len(of_b)]}|{of_b[x % len(of_b)]}" for x in both.tolist()], of)

    before, after = beside(low, -1), beside(low, 1)
    ids = np.stack([
        number(["b"], np.zeros(len(codes), dtype=np.int64)), number(["w" + w for w in words], low), number(["p" + w[:3] for w in words], low), number(["s" + w[-3:] for w in words], low),
        number(["f" + x for x in forms], shape), number(["-1" + w for w in words], before), number(["-2" + w for w in words], beside(low, -2)), number(["+1" + w for w in words], after),
        number(["+2" + w for w in words], beside(low, 2)), pairs("-f", beside(shape, -1), forms, shape, forms), pairs("+f", shape, forms, beside(shape, 1), forms), pairs("-w", before, words, shape, forms),
    ], axis=1) if len(codes) else np.empty((0, 12), dtype=np.int32)
    return sizes, np.stack([begins, ends], axis=1), ids


def parts(texts: list[str], size: int = READ) -> Iterator[slice]:
    """Runs of texts of about size characters."""
    first, n = 0, 0
    for i, t in enumerate(texts):
        n += len(t)
        if n >= size or i == len(texts) - 1:
            yield slice(first, i + 1)
            first, n = i + 1, 0


def places(text: str) -> tuple[list[tuple[int, int]], np.ndarray]:
    """Offsets of a text's tokens, and the numbers of the features of each."""
    _, offsets, ids = features([text])
    return [tuple(x) for x in offsets.tolist()], ids


def scores(weights: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """What the features of each token say for each tag, in blocks of tokens."""
    return np.concatenate([weights[ids[i : i + 4096]].sum(axis=1) for i in range(0, len(ids), 4096)])


def best_path(emit: np.ndarray, moves: np.ndarray, tags: Tags) -> np.ndarray:
    back, at = np.zeros(emit.shape, dtype=np.int64), emit[0] + tags.first
    step = moves + tags.barred
    for i in range(1, len(emit)):
        through = at[:, None] + step
        back[i] = through.argmax(axis=0)
        at = through.max(axis=0) + emit[i]
    path = np.empty(len(emit), dtype=np.int64)
    path[-1] = at.argmax()
    for i in range(len(emit) - 1, 0, -1):
        path[i - 1] = back[i][path[i]]
    return path


def certain(emit: np.ndarray, sizes: np.ndarray, moves: np.ndarray, tags: Tags) -> np.ndarray:
    """Tokens that are outside spans on the best path, told without it. A run of tokens in spans, made one outside them, gains at each what
    outside is ahead by, and loses at each, and once more at its end, what its moves are ahead by at most; where that is a gain for all runs
    over a token, the token is in none."""
    ahead = float(np.max(moves[~np.isinf(tags.barred)]) - moves[0, 0])
    gain = emit[:, 0].astype(float) - emit[:, 1:].max(axis=1) - ahead
    far = np.abs(gain).sum() + ahead + 1.0
    sizes = sizes[sizes > 0]
    ends = np.cumsum(sizes)
    sums = np.cumsum(gain) + np.repeat(np.arange(len(sizes)), sizes) * far  # runs do not reach over the ends of texts
    before = np.maximum.accumulate(np.concatenate([[0.0], sums + np.isin(np.arange(1, len(emit) + 1), ends) * far])[:-1])
    return np.minimum.accumulate(sums[::-1])[::-1] - before > ahead + 1e-6 + 1e-12 * far * len(sizes)


def best_paths(emit: np.ndarray, sizes: np.ndarray, moves: np.ndarray, tags: Tags) -> np.ndarray:
    """best_path() of several texts, of which sizes tells how many tokens each has. What lies between certain() tokens is a text of its
    own; step by step all are followed that are as long."""
    path = np.zeros(len(emit), dtype=np.int64)
    if not len(emit):
        return path
    unsure, ends = ~certain(emit, sizes, moves, tags), np.cumsum(sizes)
    head, tail = np.zeros(len(emit), dtype=bool), np.zeros(len(emit), dtype=bool)
    some = np.flatnonzero(sizes)
    head[(ends - sizes)[some]], tail[ends[some] - 1] = True, True
    own = np.flatnonzero(unsure)
    begins = own[head[own] | ~unsure[own - 1]]
    stops = own[tail[own] | ~unsure[np.minimum(own + 1, len(emit) - 1)]]
    order = np.argsort(begins - stops, kind="stable")
    starts, stops = begins[order], stops[order]
    long = stops - starts + 1
    step = (moves + tags.barred).T
    after = np.where(tail[stops][:, None], 0.0, moves[:, 0])  # what follows outside
    back = np.zeros(emit.shape, dtype=np.int8)
    going = np.searchsorted(-long, -np.arange(long[0] if len(long) else 0), side="left")  # runs of more than i tokens
    at = emit[starts] + np.where(head[starts][:, None], tags.first, step[:, 0])
    for i in range(1, len(going)):
        n, here = going[i], starts[: going[i]] + i
        through = at[:n, None, :] + step
        best = through.argmax(axis=2)
        back[here] = best
        at[:n] = np.take_along_axis(through, best[:, :, None], 2)[:, :, 0] + emit[here]
    now = (at + after).argmax(axis=1)
    for i in range(len(going) - 1, -1, -1):
        n = going[i]
        here = starts[:n] + i
        path[here] = now[:n]
        now[:n] = back[here, now[:n]]
    return path


def gold_tags(offsets: list[tuple[int, int]], spans, tags: Tags) -> np.ndarray:
    """B- on the first token that overlaps a span, I- on the others."""
    out, at = np.zeros(len(offsets), dtype=np.int64), 0
    for s in sorted(spans if spans is not None else (), key=lambda s: (s["start"], s["end"])):
        if "B-" + s["label"] not in tags.index:
            continue
        begun = False
        while at < len(offsets) and offsets[at][0] < s["end"]:
            if offsets[at][1] > s["start"]:
                out[at] = tags.index[("I-" if begun else "B-") + s["label"]]
                begun = True
            at += 1
    return out


def _pass(rows: pd.DataFrame, start: np.ndarray, tags: Tags) -> pd.DataFrame:
    """One pass over a shard: by how much it moves each weight, at its end and in the mean of its steps.

    A text that is tagged right moves nothing, so the texts after one may be tagged with it; what follows the first wrong one is tagged anew."""
    n, end, late, steps, look = len(tags.names), start.copy(), np.zeros_like(start), 1, 1
    texts, gold = [t or "" for t in rows["text"]], list(rows["entities"])
    for part in parts(texts, TAUGHT):
        sizes, offsets, ids = features(texts[part])
        ends = np.cumsum(sizes)
        all_want = [gold_tags(offsets[a:b], s, tags) for s, a, b in zip(gold[part], ends - sizes, ends, strict=True)]
        want, some = np.concatenate(all_want), np.flatnonzero(sizes)
        sizes, ends, at = sizes[some], ends[some], 0
        while at < len(sizes):
            last = min(at + look, len(sizes))
            a, b = ends[at] - sizes[at], ends[last - 1]
            got = best_paths(scores(end, ids[a:b]), sizes[at:last], end[PLACES:], tags)
            wrong = np.flatnonzero(got != want[a:b])
            if not len(wrong):
                steps, at, look = steps + last - at, last, min(2 * look, AHEAD)
                continue
            bad = int(np.searchsorted(ends, a + wrong[0], side="right"))
            first = ends[bad] - sizes[bad]
            own, said, is_said = ids[first : ends[bad]], want[first : ends[bad]], got[first - a : ends[bad] - a]
            steps, look = steps + bad - at, max(1, bad - at)
            wrong, moved = np.flatnonzero(said != is_said), np.flatnonzero((said[1:] != is_said[1:]) | (said[:-1] != is_said[:-1]))
            for sign, path in ((1.0, said), (-1.0, is_said)):
                for table, by in ((end, sign), (late, sign * steps)):
                    np.add.at(table, (own[wrong], path[wrong][:, None]), by)
                    np.add.at(table, (PLACES + path[moved], path[moved + 1]), by)
            steps, at = steps + 1, bad + 1
    mean = end - late / steps - start
    last = end - start
    f, t = np.nonzero((last != 0) | (mean != 0))
    return pd.DataFrame({"cell": f * n + t, "last": last[f, t], "mean": mean[f, t]})


def _passes(shared, tags: Tags):
    """Rows in order of shard to what each shard moves; a task holds one shard at a time."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for batch in batches:
            for shard, rows in batch.groupby("shard", sort=False):
                if held and held[0]["shard"].iloc[0] != shard:
                    yield _pass(pd.concat(held, ignore_index=True), shared.value, tags)
                    held = []
                held.append(rows)
        if held:
            yield _pass(pd.concat(held, ignore_index=True), shared.value, tags)

    return lean(run)


def train(examples: DataFrame, labels: tuple[str, ...] = LABELS, most: int | None = None, epochs: int = EPOCHS) -> np.ndarray:
    """Weights (features and one row a tag for what follows it, by tags) learned from all examples (id, text, entities).

    Examples are dealt by a hash of the id to SHARDS groups, or to as many as have EACH examples. Each round, every shard passes over its
    own rows, in an order by hash, from the same weights, and Spark adds up how far they moved; the weights of the result are the mean over
    all steps of all rounds. Only with `most` do no more than that number of examples teach, those of the least hashes.
    The driver sees weights only, 2**16 places for each tag at most. Null and empty texts teach nothing; without examples all weights are 0.
    """
    tags = Tags(labels)
    n, context = len(tags.names), examples.sparkSession.sparkContext
    rows = examples.select("id", "text", "entities", seeded(F.col("id"), "tagger").alias("_o"))
    if most is not None:
        rows = rows.orderBy("_o", "id").limit(most)
    shards = max(SHARDS, -(-rows.count() // EACH))
    tasks = min(shards, max(SHARDS, int(examples.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    rows = rows.withColumn("shard", F.pmod(F.xxhash64("id"), F.lit(shards)))
    rows = cut(rows.repartitionById(tasks, F.pmod("shard", F.lit(tasks)).cast("int")).sortWithinPartitions("shard", "_o", "text").select("shard", "text", "entities"))
    weights, total = np.zeros((PLACES + n, n)), np.zeros((PLACES + n, n))
    for turn in range(epochs):
        shared = context.broadcast(weights)
        moved = rows.mapInPandas(_passes(shared, tags), "cell long, last double, mean double").groupBy("cell").agg(F.round(F.sum("last"), 6).alias("last"), F.round(F.sum("mean"), 6).alias("mean")).toPandas()
        cells = moved["cell"].to_numpy(dtype=np.int64)
        if not len(cells):  # all is tagged right, and would be in all rounds to come
            total += weights * (epochs - turn)
            break
        total += weights
        total.ravel()[cells] += moved["mean"].to_numpy() / shards
        weights.ravel()[cells] += moved["last"].to_numpy() / shards
        shared.unpersist()
    return (total / epochs).astype(np.float32)


def tagged(texts: DataFrame, weights: np.ndarray, labels: tuple[str, ...] = LABELS, most: int | None = None) -> DataFrame:
    """(doc_id, pos, start, end, tag, score, truncated): the tokens of (id, text) that are in a span; score is in (0.5, 1).

    Whole texts are read, unless most bounds the tokens of a text; then truncated tells of those that had more, by a row with a null
    tag if they have no span. Null and empty texts give no row.
    """
    tags = Tags(labels)
    shared = texts.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        w = shared.value
        for batch in batches:
            for part in parts([t or "" for t in batch["text"]]):
                idents = batch["id"].iloc[part].reset_index(drop=True)
                sizes, offsets, ids = features([t or "" for t in batch["text"].iloc[part]])
                over = sizes > most if most is not None else np.zeros(len(sizes), dtype=bool)
                if over.any():
                    kept = np.arange(len(ids)) - np.repeat(np.cumsum(sizes) - sizes, sizes) < most
                    sizes, offsets, ids = np.minimum(sizes, most), offsets[kept], ids[kept]
                if not len(ids):
                    continue
                emit = scores(w, ids)
                path = best_paths(emit, sizes, w[PLACES:], tags)
                found = np.flatnonzero(path)
                text = np.repeat(np.arange(len(sizes)), sizes)[found]
                own, others, row = emit[found, path[found]], emit[found], np.arange(len(found))
                others[row, path[found]] = -np.inf
                sure = 0.5 + 0.5 * (1 / (1 + np.exp(-np.maximum(own - others.max(axis=1), 0)))).astype(float)
                yield pd.DataFrame({"doc_id": idents[text].array, "pos": found - (np.cumsum(sizes) - sizes)[text], "start": offsets[found, 0], "end": offsets[found, 1], "tag": np.array(tags.names, dtype=object)[path[found]], "score": sure, "truncated": over[text]})
                none = np.setdiff1d(np.flatnonzero(over), text)
                if len(none):
                    yield pd.DataFrame({"doc_id": idents[none].array, "pos": -1, "start": 0, "end": 0, "tag": None, "score": None, "truncated": True})

    kind = texts.schema["id"].dataType.simpleString()
    return texts.select("id", "text").mapInPandas(lean(run), f"doc_id {kind}, pos int, start int, end int, tag string, score double, truncated boolean")


def annotated(texts: DataFrame, weights: np.ndarray, labels: tuple[str, ...] = LABELS, most: int | None = None) -> DataFrame:
    """texts (id, text, ...) with model, the spans of tagged() in order, and truncated; ids are unique."""
    tokens = tagged(texts, weights, labels, most)
    found = decode_tags(tokens.filter("tag IS NOT NULL")).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("start", "end", "label", "score"))).alias("_found"))
    out = texts.join(found, F.col("id") == F.col("doc_id"), "left").drop("doc_id")
    if most is None:
        out = out.withColumn("truncated", F.lit(False))
    else:
        cut = tokens.filter("truncated").select(F.col("doc_id").alias("_cut")).distinct()
        out = out.join(cut, F.col("id") == F.col("_cut"), "left").withColumn("truncated", F.col("_cut").isNotNull()).drop("_cut")
    said = lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["label"].alias("label"), F.substring(F.col("text"), s["start"] + 1, s["end"] - s["start"]).alias("text"), s["score"].alias("score"))
    return out.withColumn("model", F.coalesce(F.transform("_found", said), F.array()).cast(SPANS)).drop("_found")
