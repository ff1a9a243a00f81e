"""Suffix-array dedup: removes what lies in a string of `length` units, bytes or words, that starts anywhere else too.

1. Anchors. In each window of `length` units the run of half as many with the least hash (the rightmost of equals) is its
   anchor: equal windows have equal anchors at equal offsets, whatever surrounds them.
2. Only anchors whose run occurs twice go on. Each then stands for the windows it anchors, with the text that they span,
   its context. Contexts are counted by digest: one that occurs twice repeats whole, and where all contexts of a run do, or
   there is one only, nothing is left to find. Of other runs each different context is fetched once, as text.
3. The contexts of one anchor run are sorted as suffixes from the anchor on, by a merge sort whose comparisons find the
   common extension with prefix polynomial hashes and binary search; so are their reversed left parts. The extensions of
   neighbours bound which windows can repeat; those are matched by rank to the right and hash to the left, and each match is
   verified unit by unit. Runs with very many different contexts are no task's work: their windows are dealt out by hash, and each match is verified with the context that it was found in.
4. The repeated windows go back to their documents, where their union is removed.

Texts are shuffled once, into a table bucketed by row; what is joined with it later comes to it. Two lengths, such as 400 bytes
and 51 words, can be searched for at a time: layers, told apart by the lowest bit of a run's hash, that share each shuffle.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import poly_hash
from .common import bucketed, discard, lean, row_key, slices, stage, tabled

#: The contract's length, in bytes.
LENGTH = 400
#: Words of a passage that counts as repeated: over 50.
PASSAGE = 51
#: Different contexts of one anchor run that one task sorts at most; where there are more, windows are dealt out instead.
MOST = 4096
#: Windows of a text whose anchors are worked out at once.
STEP = 1 << 22
BYTES, WORDS = poly_hash.values(20), poly_hash.values(22)
SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
WORD_MARK = np.uint64(0x1234567887654321)
PLACE = np.uint64((1 << 28) - 1)
#: (length, unit) of what is searched for, one or two.
Layers = list[tuple[int, str]]


def units(raw: bytes, unit: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(value, start, end) of each byte of raw, or of each word: what stands between spaces."""
    code = np.frombuffer(raw, np.uint8)
    if unit == "bytes":
        edges = np.arange(len(code) + 1)
        return BYTES[code], edges[:-1], edges[1:]
    solid = ~SPACE[code]
    edge = np.diff(solid.astype(np.int8), prepend=0, append=0)
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    prefix = poly_hash.prefixes(WORDS[code])
    return poly_hash.spans(prefix, start, end) ^ WORD_MARK | np.uint64(1), start, end


def anchors(values: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash of the run, place, first window, last window) of each anchor of a text; none if it is shorter than length."""
    found = [_anchors(values[a : a + STEP + length - 1], length, a) for a in range(0, max(1, len(values) - length + 1), STEP)]
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _anchors(values: np.ndarray, length: int, offset: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    gram = length // 2
    t = length - gram + 1
    n = len(values) - gram + 1
    if n < t:
        return (np.empty(0, np.int64),) * 4
    prefix = poly_hash.prefixes(values)
    h = poly_hash.mix((prefix[gram:] - prefix[:n]) * poly_hash.powers(n, "down"))
    rank = (h & ~PLACE) | (PLACE - np.arange(n, dtype=np.uint64))
    rows = -(-n // t) + 1
    padded = np.full(rows * t, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = rank
    grid = padded.reshape(rows, t)
    ahead = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    back = np.minimum.accumulate(grid, axis=1).ravel()
    least = np.minimum(ahead[: n - t + 1], back[t - 1 : n])
    place = (PLACE - (least & PLACE)).astype(np.int64)
    new = np.ones(len(place), bool)
    new[1:] = place[1:] != place[:-1]
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(place)) - 1
    return h[place[first]].astype(np.int64), place[first] + offset, first + offset, last + offset


def _batch(rows: list[tuple], types: dict[str, pa.DataType]) -> pa.RecordBatch:
    cols = zip(*rows, strict=True) if rows else [()] * len(types)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types.values(), strict=True)], list(types))


def text_anchors(layers: Layers):
    """(k1, k2, text) to one row an anchor: (k1, k2, run, place, first, last), the layer in the lowest bit of run."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            raws = b.column(2).cast(pa.binary()).to_pylist()
            for layer, (length, unit) in enumerate(layers):
                parts = [anchors(units(raw, unit)[0], length) for raw in raws]
                n = np.array([len(p[0]) for p in parts])
                keys = [pa.array(np.repeat(b.column(i).to_numpy(zero_copy_only=False), n), pa.int64()) for i in (0, 1)]
                cols = [np.concatenate([p[i] for p in parts]) for i in range(4)]
                yield pa.RecordBatch.from_arrays([*keys, pa.array(cols[0] & -2 | layer), *[pa.array(c.astype(np.int32)) for c in cols[1:]]], ["k1", "k2", "run", "place", "first", "last"])

    return run


def digest(context: bytes) -> bytes:
    return hashlib.blake2b(context, digest_size=16).digest()


def spaced(raw: bytes) -> tuple[bytes, list[int]]:
    """The words of raw joined by one space, and where each starts; one place more for the end."""
    joined = b" ".join(raw.split()) + b" "
    return joined, [0, *(np.flatnonzero(np.frombuffer(joined, np.uint8) == 32) + 1).tolist()]


def cuts(texts: pa.Array, anchors: pa.Array, layers: Layers) -> Iterator[tuple[int, tuple, bytes]]:
    """(number of its text, values, context) of each anchor (run, place, first, last, any more) of the texts: the context is the
    text its windows span, words joined by one space."""
    rows = zip(*(x.to_pylist() for x in anchors.flatten().flatten()), strict=True)
    for i, (raw, n) in enumerate(zip(texts.cast(pa.binary()).to_pylist(), pc.list_value_length(anchors).to_pylist(), strict=True)):
        words, at = None, []
        for a in islice(rows, n):
            length, unit = layers[a[0] & 1]
            if unit == "bytes":
                yield i, a, raw[a[2] : a[3] + length]
            else:
                if words is None:
                    words, at = spaced(raw)
                yield i, a, words[at[a[2]] : at[a[3] + length] - 1]


def contexts(layers: Layers):
    """(text, anchors (run, place, first, last, digest, n)) to (run, left, digest, context, n), left the units before the anchor."""
    types = {"run": pa.int64(), "left": pa.int32(), "digest": pa.binary(), "context": pa.binary(), "n": pa.int64()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            yield _batch([(a[0], a[1] - a[2], a[4], c, a[5]) for _, a, c in cuts(b.column("text"), b.column("anchors"), layers)], types)

    return run


def extension(prefix: np.ndarray, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Lengths of the common extensions of the suffixes at a and b, most at most, by binary search on prefix hashes."""
    lo, hi = np.zeros(len(a), np.int64), most.copy()
    while len(live := np.flatnonzero(lo < hi)):
        mid = (lo[live] + hi[live] + 1) // 2
        x, y = a[live], b[live]
        same = poly_hash.spans(prefix, x, x + mid) == poly_hash.spans(prefix, y, y + mid)
        lo[live] = np.where(same, mid, lo[live])
        hi[live] = np.where(same, hi[live], mid - 1)
    return lo


def suffix_sort(raw: np.ndarray, prefix: np.ndarray, group: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the suffixes raw[start:end] inside each group (a sorted array), and the extension each shares with the one before it.

    Bottom-up merge sort, all runs of one width at once: an element's place is its place in its own run and, by binary
    search with hash-compared suffixes, its rank in the neighbouring run.
    """
    n = len(group)
    order = np.arange(n)
    opens = np.searchsorted(group, group)
    size = np.searchsorted(group, group, "right") - opens
    width = 1
    while width < size.max(initial=0):
        live = np.flatnonzero(size > width)
        within = live - opens[live]
        mine = within // width
        lo = (mine ^ 1) * width
        hi = np.minimum(lo + width, size[live])
        lo = np.minimum(lo, size[live])
        first = lo.copy()
        left_run = mine % 2 == 0
        while len(busy := np.flatnonzero(lo < hi)):
            mid = (lo[busy] + hi[busy]) // 2
            x, y = order[live[busy]], order[opens[live[busy]] + mid]
            room = np.minimum(end[x] - start[x], end[y] - start[y])
            e = extension(prefix, start[x], start[y], room)
            cx = np.where(start[x] + e < end[x], raw[np.minimum(start[x] + e, len(raw) - 1)].astype(np.int64), -1)
            cy = np.where(start[y] + e < end[y], raw[np.minimum(start[y] + e, len(raw) - 1)].astype(np.int64), -1)
            before = np.where(left_run[busy], cy < cx, cy <= cx)  # equal suffixes of the left run stay first
            lo[busy] = np.where(before, mid + 1, lo[busy])
            hi[busy] = np.where(before, hi[busy], mid)
        to = opens[live] + (mine & ~1) * width + within % width + (lo - first)
        moved = order[live]
        order = order.copy()
        order[to] = moved
        width *= 2
    x, y = order[1:], order[:-1]
    shared = np.zeros(n, np.int64)
    near = np.flatnonzero(group[1:] == group[:-1])
    room = np.minimum(end[x[near]] - start[x[near]], end[y[near]] - start[y[near]])
    shared[near + 1] = extension(prefix, start[x[near]], start[y[near]], room)
    return order, shared


def symbols(texts: list[bytes], unit: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(symbol, value, size): the units of all texts, equal symbols for equal ones, with hash values, and the number of each text."""
    if unit == "bytes":
        code = np.frombuffer(b"".join(texts), np.uint8)
        return code, BYTES[code], np.array([len(t) for t in texts], np.int64)
    known: dict[bytes, int] = {}
    words = [t.split() for t in texts]
    code = np.array([known.setdefault(w, len(known)) for ws in words for w in ws], np.int64)
    return code, poly_hash.mix(code.astype(np.uint64) + WORD_MARK) | np.uint64(1), np.array([len(ws) for ws in words], np.int64)


def repeated_windows(run: np.ndarray, left: np.ndarray, count: np.ndarray, texts: list[bytes], length: int = LENGTH, unit: str = "bytes") -> list[list[tuple[int, int]]]:
    """For each context the intervals [first, last] of window starts, from the context's start, that occur twice.

    run is sorted. count > 1: the context itself occurs twice, and so does each of its windows.
    """
    n = len(texts)
    raw, values, size = symbols(texts, unit)
    base = np.cumsum(size) - size
    prefix = poly_hash.prefixes(values)
    order, shared = suffix_sort(raw, prefix, run, base + left, base + size)
    back = poly_hash.prefixes(values[::-1])
    turn = len(raw) - base - left  # where a context's left part starts in the mirrored text
    border, same = suffix_sort(raw[::-1], back, run, turn, turn + left)
    right_most, left_most = np.zeros(n, np.int64), np.zeros(n, np.int64)
    for o, s, most in ((order, shared, right_most), (border, same, left_most)):
        most[o] = np.maximum(s, np.append(s[1:], 0))
    # a window d units before the anchor needs d units to the left and length - d to the right in common with another
    windows = size - length + 1
    d_hi = np.minimum(left, left_most)
    d_lo = np.maximum(left - windows + 1, length - right_most)
    todo = np.flatnonzero((count == 1) & (d_lo <= d_hi))
    full = count > 1
    out: list[list[tuple[int, int]]] = [[(0, int(w) - 1)] if f else [] for f, w in zip(full, windows, strict=True)]
    if len(todo):
        # the partners of those are all contexts of the same runs that reach as far
        lively = np.isin(run, run[todo])
        lo = np.where(full, np.maximum(left - windows + 1, length - right_most), d_lo)
        use = np.flatnonzero(lively & (lo <= d_hi))
        many = d_hi[use] - lo[use] + 1
        who = np.repeat(use, many)
        d = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(lo[use], many)
        at = base[who] + left[who] - d
        key = poly_hash.spans(prefix, at, at + length)
        by = np.lexsort((key, run[who]))
        who, d, at, key = who[by], d[by], at[by], key[by]
        pair = np.flatnonzero((key[1:] == key[:-1]) & (run[who[1:]] == run[who[:-1]]))
        real = _equal(raw, at[pair], at[pair + 1], length)
        hit = np.zeros(len(who), bool)
        hit[pair[real]] = hit[pair[real] + 1] = True
        hit &= ~full[who]
        who, first = who[hit], (left[who] - d)[hit]
        by = np.lexsort((first, who))
        for i, a, b in intervals(who[by], first[by]):
            out[i].append((a, b))
    return out


def intervals(who: np.ndarray, first: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(who, a, b) for each maximal run a, a + 1 ... b of first that belongs to one who; both are sorted."""
    if not len(who):
        return
    new = np.ones(len(who), bool)
    new[1:] = (who[1:] != who[:-1]) | (first[1:] != first[:-1] + 1)
    opens = np.flatnonzero(new)
    for i, j in zip(opens, np.append(opens[1:], len(who)) - 1, strict=True):
        yield int(who[i]), int(first[i]), int(first[j])


def _equal(raw: np.ndarray, a: np.ndarray, b: np.ndarray, length: int) -> np.ndarray:
    """Whether the units at a and b agree over length, compared in blocks."""
    if not len(a):
        return np.zeros(0, bool)
    view = np.lib.stride_tricks.sliding_window_view(raw, length)
    return np.concatenate([(view[a[i : i + 4096]] == view[b[i : i + 4096]]).all(axis=1) for i in range(0, len(a), 4096)])


PASSAGES = ("n_repeated_words", "n_passages")
SPANS = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())]))
VERDICT = {"run": pa.int64(), "left": pa.int32(), "digest": pa.binary(), "spans": SPANS}
VERDICT_SHAPE = "run long, left int, digest binary, spans array<struct<first:int,last:int>>"
CONTEXT_SHAPE = "run long, left int, digest binary, context binary, n long"


def sorter(layers: Layers):
    """Rows (run, left, digest, context, n) sorted by run, to (run, left, digest, spans) for contexts of n = 1 that repeat something."""

    def solve(groups: list[tuple[int, dict]]) -> pa.RecordBatch:
        out = []
        for layer, (length, unit) in enumerate(layers):
            rows = [(run, *k, *v) for run, held in groups if run & 1 == layer for k, v in held.items()]
            found = repeated_windows(np.array([r[0] for r in rows], np.int64), np.array([r[1] for r in rows], np.int64), np.array([r[4] for r in rows], np.int64), [r[3] for r in rows], length, unit) if rows else []
            out += [(*r[:3], [{"first": a, "last": b} for a, b in s]) for r, s in zip(rows, found, strict=True) if s and r[4] == 1]
        return _batch(out, VERDICT)

    def alone(held: dict) -> bool:
        return len(held) == 1 and next(iter(held.values()))[1] == 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups, held, at, size = [], {}, None, 0
        for b in slices(batches):
            for key, left, dig, context, n in zip(*(b.column(i).to_pylist() for i in range(5)), strict=True):
                if key != at:
                    if held and not alone(held):
                        groups.append((at, held))
                        size += sum(len(v[0]) for v in held.values())
                    held, at = {}, key
                    if size > 2_000_000:
                        yield solve(groups)
                        groups, size = [], 0
                if (left, dig) in held:
                    held[left, dig][1] += n
                else:
                    held[left, dig] = [context, n]
        if held and not alone(held):
            groups.append((at, held))
        if groups:
            yield solve(groups)

    return run


def window_hash(code: np.ndarray, values: np.ndarray, length: int) -> np.ndarray:
    """Signed hashes of all windows of a context."""
    at = np.arange(len(code) - length + 1)
    return poly_hash.spans(poly_hash.prefixes(values), at, at + length).astype(np.int64)


def windows(length: int, unit: str, hashed=window_hash):
    """(run, left, digest, context, n) to one row a window: (run, left, digest, n, at, w), w a hash of it."""
    types = {"run": pa.int64(), "left": pa.int32(), "digest": pa.binary(), "n": pa.int64(), "at": pa.int32(), "w": pa.int64()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 100):
            out = []
            for run, left, dig, context, n in zip(*(b.column(i).to_pylist() for i in range(5)), strict=True):
                values = units(context, unit)[0]
                w = hashed(values, values, length).tolist()
                out += [(run, left, dig, n, at, x) for at, x in enumerate(w)]
            yield _batch(out, types)

    return run


def window_texts(length: int, unit: str):
    """(run, left, digest, n, context, at: some window starts) to (run, left, digest, n, at, w), w the window itself."""
    types = {"run": pa.int64(), "left": pa.int32(), "digest": pa.binary(), "n": pa.int64(), "at": pa.int32(), "w": pa.binary()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 100):
            out = []
            for run, left, dig, n, context, starts in zip(*(b.column(i).to_pylist() for i in range(6)), strict=True):
                _, start, end = units(context, unit)
                out += [(run, left, dig, n, a, context[start[a] : end[a + length - 1]]) for a in starts]
            yield _batch(out, types)

    return run


def verified(length: int, unit: str):
    """(run, left, digest, context, other, pairs (at, to)) to (run, left, digest, spans, wrong): the windows of context at `at` that
    stand in other at `to`, and those that do not, for all that their hashes are equal."""
    types = VERDICT | {"wrong": pa.list_(pa.int32())}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 100):
            out = []
            for run, left, dig, context, other, pairs in zip(*(b.column(i).to_pylist() for i in range(6)), strict=True):
                (_, s, e), (_, so, eo) = units(context, unit), units(other, unit)
                good, wrong = [], []
                for p in pairs:
                    a, c = p["at"], p["to"]
                    (good if context[s[a] : e[a + length - 1]] == other[so[c] : eo[c + length - 1]] else wrong).append(a)
                spans = [{"first": x, "last": y} for _, x, y in intervals(np.zeros(len(good), int), np.array(sorted(good), int))]
                out.append((run, left, dig, spans, wrong))
            yield _batch(out, types)

    return run


def dealt_windows(crowded: DataFrame, length: int, unit: str, hashed=window_hash) -> DataFrame:
    """(run, left, digest, spans) for the contexts of runs that have too many for one task.

    Windows are counted by hash, combined before the shuffle. One context with each repeated hash is its holder, and every
    other's windows are compared with the holder's text. Hashes under which windows prove different are set aside, and their
    windows are counted by text.
    """
    key = ["run", "left", "digest"]
    each = stage(crowded.select(*key, "context", "n").mapInArrow(lean(windows(length, unit, hashed)), "run long, left int, digest binary, n long, at int, w long"))
    other = crowded.select("run", F.col("left").alias("hl"), F.col("digest").alias("hd"), F.col("context").alias("other"))

    def tried(each: DataFrame) -> DataFrame:
        held = stage(each.groupBy("run", "w").agg(F.sum("n").alias("k"), F.min(F.struct("left", "digest", "at")).alias("h")).filter("k > 1").select("run", "w", "h"))
        pairs = each.join(held, ["run", "w"]).groupBy(*key, F.col("h.left").alias("hl"), F.col("h.digest").alias("hd")).agg(F.collect_list(F.struct("at", F.col("h.at").alias("to"))).alias("pairs"))
        pairs = pairs.join(crowded.select(*key, "context"), key).join(other, ["run", "hl", "hd"]).select(*key, "context", "other", "pairs")
        return stage(pairs.mapInArrow(lean(verified(length, unit)), VERDICT_SHAPE + ", wrong array<int>"))

    found = tried(each)
    wrong = found.select(*key, F.explode("wrong").alias("at"))
    if wrong.isEmpty():
        return found.filter("size(spans) > 0").select(*key, "spans")
    aside = stage(each.join(wrong, [*key, "at"]).select("run", "w").distinct())
    found = tried(each.join(aside, ["run", "w"], "left_anti").select(each.columns)).filter("size(spans) > 0").select(*key, "spans")
    doubtful = each.join(aside, ["run", "w"]).groupBy(*key).agg(F.first("n").alias("n"), F.collect_list("at").alias("at"))
    texts = doubtful.join(crowded.select(*key, "context"), key).select(*key, "n", "context", "at").mapInArrow(lean(window_texts(length, unit)), "run long, left int, digest binary, n long, at int, w binary")
    again = texts.groupBy("run", "w").agg(F.sum("n").alias("k")).filter("k > 1").select("run", "w")
    span = F.struct(F.col("at").alias("first"), F.col("at").alias("last"))
    return found.unionByName(texts.join(again, ["run", "w"]).groupBy(*key).agg(F.collect_list(span).alias("spans")))


def marks(layers: Layers):
    """(k1, k2, text, anchors (run, place, first, last)) to one row an anchor: (k1, k2, run, left, digest, first, last)."""
    types = {"k1": pa.int64(), "k2": pa.int64(), "run": pa.int64(), "left": pa.int32(), "digest": pa.binary(), "first": pa.int32(), "last": pa.int32()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            k1, k2 = b.column("k1").to_pylist(), b.column("k2").to_pylist()
            yield _batch([(k1[i], k2[i], a[0], a[1] - a[2], digest(c), a[2], a[3]) for i, a, c in cuts(b.column("text"), b.column("anchors"), layers)], types)

    return run


def removed(raw: bytes, starts: list[tuple[int, int]], length: int = LENGTH, unit: str = "bytes") -> tuple[bytes, list[tuple[int, int]]]:
    """What stays of raw, and the maximal removed runs, if the windows that start in the intervals [first, last] go; a word
    takes the spaces after it along."""
    if not starts:
        return raw, []
    _, start, _ = units(raw, unit)
    stop = np.append(start[1:], len(raw))
    runs: list[list[int]] = []
    for a, b in sorted(starts):
        x, y = int(start[a]), int(stop[b + length - 1])
        if runs and x <= runs[-1][1]:
            runs[-1][1] = max(runs[-1][1], y)
        else:
            runs.append([x, y])
    kept, at = [], 0
    for a, b in runs:
        kept.append(raw[at:a])
        at = b
    return b"".join([*kept, raw[at:]]), [(a, b) for a, b in runs]


def covered(starts: list[tuple[int, int]], length: int) -> tuple[int, int]:
    """Units in the windows that start in the intervals [first, last], and the number of maximal runs of such units."""
    n, runs, end = 0, 0, -1
    for a, b in sorted(starts):
        runs += a > end
        n += max(0, b + length - max(a, end))
        end = max(end, b + length)
    return n, runs


def cleaned(layers: Layers, as_text: bool = False):
    """(row, text, starts0, maybe starts1) to (row, kept, n_bytes, n_removed, n_spans), cut by the first layer, and for the second
    (n_repeated_words, n_passages); kept as text has no halves of characters that a cut leaves."""
    types = {"kept": pa.string() if as_text else pa.binary()} | dict.fromkeys(("n_bytes", "n_removed", "n_spans", *PASSAGES[: 2 * len(layers) - 2]), pa.int64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            out = []
            for text, *found in zip(*(b.column(i).to_pylist() for i in range(1, b.num_columns)), strict=True):
                raw = text.encode()
                starts, *others = ([(s["first"], s["last"]) for s in x or ()] for x in found)
                kept, runs = removed(raw, starts, *layers[0])
                more = [n for x, (length, _) in zip(others, layers[1:], strict=True) for n in covered(x, length)]
                out.append((kept.decode("utf-8", "ignore") if as_text else kept, len(raw), len(raw) - len(kept), len(runs), *more))
            new = _batch(out, types)
            yield pa.RecordBatch.from_arrays([b.column("row"), *new.columns], ["row", *new.schema.names])

    return run


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, unit: str = "bytes", most: int = MOST, hashed=window_hash, as_text: bool = False, passage: int | None = None) -> DataFrame:
    """(row, kept, n_bytes, n_removed, n_spans), one row for each row of docs: row a struct of all its columns, kept the bytes left,
    or, as_text, the whole characters among them.

    A byte goes if a string of `length` units over it also starts anywhere else, in the same text or another; strings are
    judged on the input, and every copy goes, the first too. unit "bytes", or "words": what stands between spaces, compared
    without the spaces. Null texts count as empty; shorter texts stay whole; very long ones are treated whole, in blocks of
    STEP windows; repeated rows are copies and go whole if long enough. An empty table gives no rows. Columns of any name may
    come along. most and hashed serve tests. With passage, two columns follow: n_repeated_words, the words in strings of so many
    words that start anywhere else too, and n_passages, the runs of such words; what is removed stays the same.
    """
    layers = [(length, unit)] + ([(passage, "words")] if passage else [])
    layer = F.col("run").bitwiseAND(1)
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    docs = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != text_col]).alias("row"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.col(id_col).alias("id"))
    docs, _ = bucketed(docs.select("row", *row_key("id"), "text"), "k1", "k2")
    found, name = tabled(docs.select("k1", "k2", "text").mapInArrow(lean(text_anchors(layers)), "k1 long, k2 long, run long, place int, first int, last int"))
    twice = stage(found.groupBy("run").agg(F.count("*").alias("k")).filter("k > 1").select("run"))  # a table, so that the join can split hot runs
    live = stage(found.join(twice, "run").groupBy("k1", "k2").agg(F.collect_set(F.struct("run", "place", "first", "last")).alias("anchors")))
    discard(docs.sparkSession, name)

    def around(anchors: DataFrame) -> DataFrame:
        return docs.select("k1", "k2", "text").join(anchors.hint("shuffle_hash"), ["k1", "k2"]).select("k1", "k2", "text", "anchors")

    key = ["run", "left", "digest"]
    marked = stage(around(live).mapInArrow(lean(marks(layers)), "k1 long, k2 long, run long, left int, digest binary, first int, last int"))
    counted = stage(marked.groupBy(*key).agg(F.count("*").alias("n"), F.min(F.struct("k1", "k2", "first", "last")).alias("at")))
    unsure = stage(counted.groupBy("run").agg(F.count("*").alias("k"), F.min("n").alias("least")).filter("k > 1 AND least = 1").select("run", (F.col("k") > most).alias("busy")))

    def texts(busy: bool) -> DataFrame:
        some = counted.join(unsure.filter(F.col("busy") == busy), "run")
        anchor = F.struct("run", (F.col("at.first") + F.col("left")).alias("place"), "at.first", "at.last", "digest", "n")
        some = some.groupBy("at.k1", "at.k2").agg(F.collect_list(anchor).alias("anchors"))
        return around(some).mapInArrow(lean(contexts(layers)), CONTEXT_SHAPE)

    verdict = texts(False).repartition(parts, "run").sortWithinPartitions("run").mapInArrow(lean(sorter(layers)), VERDICT_SHAPE)
    dealt = []
    for i, what in enumerate(layers):
        if not unsure.filter(F.col("busy") & (layer == i)).isEmpty():
            crowded = texts(True).filter(layer == i).groupBy(*key).agg(F.first("context").alias("context"), F.first("n").alias("n"))
            dealt.append(dealt_windows(stage(crowded), *what, hashed))
    whole = counted.filter("n > 1").select(*key, F.lit(None).cast(verdict.schema["spans"].dataType).alias("spans"))
    verdict = stage(reduce(DataFrame.unionByName, dealt, verdict)).unionByName(whole)
    full = F.array(F.struct(F.lit(0).alias("first"), (F.col("last") - F.col("first")).alias("last")))
    starts = marked.join(verdict, key).withColumn("spans", F.coalesce("spans", full))
    moved = F.transform("spans", lambda x: F.struct((F.col("first") + x["first"]).alias("first"), (F.col("first") + x["last"]).alias("last")))
    names = [f"starts{i}" for i in range(len(layers))]
    starts = starts.select("k1", "k2", layer.alias("layer"), moved.alias("spans")).groupBy("k1", "k2").agg(*[F.flatten(F.collect_list(F.when(F.col("layer") == i, F.col("spans")))).alias(c) for i, c in enumerate(names)])
    row = docs.schema["row"].dataType.simpleString()
    return docs.join(starts.hint("shuffle_hash"), ["k1", "k2"], "left").select("row", "text", *names).mapInArrow(lean(cleaned(layers, as_text)), f"row {row}, kept {'string' if as_text else 'binary'}, n_bytes long, n_removed long, n_spans long" + "".join(f", {c} long" for c in PASSAGES if passage))


def repeat_report(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, n_repeated_words, n_passages) for each row of docs. Strings of 400 bytes
    are cut; passages of over 50 words, many of which are shorter than that, are counted beside them and cut nothing."""
    out = remove_repeats(docs.select("doc_id", "text"), passage=PASSAGE)
    return out.select("row.doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"), *PASSAGES)


def without_repeats(docs: DataFrame, length: int = LENGTH, unit: str = "bytes") -> DataFrame:
    """docs with its columns, the text cut as remove_repeats() says; broken characters at the cuts go, n_chars follows, and rows
    left without text, or that never had one, go. No copy of a repeated string stays, so a document that is all repeats goes."""
    out = remove_repeats(docs, length=length, unit=unit, as_text=True).withColumnRenamed("kept", "text")
    cols = [F.col("text") if c == "text" else F.length("text").cast("long").alias(c) if c == "n_chars" else F.col(f"row.`{c}`") for c in docs.columns]
    return out.filter(F.trim("text") != "").select(*cols)
