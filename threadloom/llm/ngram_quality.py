"""Quality classifier: an interpolated modified Kneser-Ney model of trusted text, and perplexity cuts by language.

Texts become sequences of symbols, and the model has order 4. Latin letters, digits and marks share 63 symbols; every other
code point is a symbol of its own, so that there is no bound on the number of n-grams. Documents are dealt to chunks by hash
of their id, in compressed packs, into a table bucketed by chunk: the only time that text is shuffled. One pass over it counts
the distinct n-grams of each chunk, those of trusted text with their counts. Counts are summed by n-gram in shards, over all trusted text,
and stay tables: nothing of the model is gathered or broadcast. The n-grams of all chunks are joined with the counts of all
orders, and what comes back to a chunk scores each of its documents symbol by symbol, whole. The cut of a language is a
quantile of its trusted documents' perplexities, with a margin; those texts are also the ones learned from, so the margin
stands for what the model gains on its own text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from . import poly_hash
from .common import bucketed, cut, discard, lean, lean_cogroup, row_key, slices, stage

ORDER, BITS = 4, 6
SYMBOLS = 1 << BITS
#: Symbols of a text of one's language's mean perplexity that each document is taken to have besides its own.
PRIOR = 30.0
QUANTILE, MARGIN = 0.99, 1.25
CHUNK = 1_000_000
#: Characters of a chunk of documents, whose distinct n-grams are joined with the counts once.
DEALT = 8_000_000
#: Bytes of rows that one task packs at once.
PACKED = 16_000_000
#: Bits of a symbol in an n-gram of any script.
WIDE = 21


def symbol_table() -> np.ndarray:
    """Symbol of each code point below 512; 0 a space, 1-26 small letters, 27 capitals, 28 digits, then marks and accented letters; 63 what else there is."""
    t = np.full(512, 63, np.uint8)
    t[[9, 10, 11, 12, 13, 32]] = 0
    t[97:123] = np.arange(1, 27)
    t[65:91] = 27
    t[48:58] = 28
    for i, marks in enumerate((".", ",", "!?", ";:", "'´`", "-_", "()[]{}", '"')):
        t[[ord(c) for c in marks]] = 29 + i
    t[[ord(c) for c in "#$%&*+/<=>@\\^|~"]] = 37
    t[0xC0:0xDF] = 27
    t[0xDF:0x100] = 38 + np.minimum(np.arange(33), 24)
    return t


TABLE = symbol_table()


def symbols(text: str | None) -> np.ndarray:
    """Symbols of a text; runs of spaces are one, none at the ends. A code point above 511 is a symbol of its own, from 64 on."""
    code = np.frombuffer((text or "").encode("utf-32-le"), np.uint32)
    s = TABLE[np.minimum(code, 511)].astype(np.uint32)
    other = code > 511
    s[other] = code[other] - 512 + SYMBOLS
    blank = s == 0
    keep = ~blank
    keep[1:] |= ~blank[:-1]
    s = s[keep]
    return s[(1 if len(s) and s[0] == 0 else 0) : (len(s) - 1 if len(s) > 1 and s[-1] == 0 else len(s))]


def ngrams(s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(h, g) for each symbol: the third symbol before it, and it with the two before, as if spaces stood before the text."""
    p = np.concatenate([np.zeros(ORDER - 1, np.int64), s.astype(np.int64)])
    n = len(s)
    return p[:n], (p[1 : n + 1] << 2 * WIDE) | (p[2 : n + 2] << WIDE) | p[3:]


def keys(h: np.ndarray, g: np.ndarray, wide: bool) -> np.ndarray:
    """A 64-bit number for each 4-gram: its four symbols where none is wide (16 bits or more), a hash otherwise."""
    if wide:
        return poly_hash.mix(g.astype(np.uint64) ^ poly_hash.mix(h.astype(np.uint64)))
    low = (1 << WIDE) - 1
    return ((h << 48) | ((g >> 2 * WIDE) << 32) | (((g >> WIDE) & low) << 16) | (g & low)).astype(np.uint64)


def is_wide(h: np.ndarray, g: np.ndarray) -> bool:
    high = ((1 << WIDE) - 1) ^ 0xFFFF
    return bool(len(g) and (np.bitwise_or.reduce(h) & high or np.bitwise_or.reduce(g) & (high | high << WIDE | high << 2 * WIDE)))


def distinct(held: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct (h, g), and how often each is there."""
    h, g = (np.concatenate(x) for x in zip(*held, strict=True))
    _, at, k = np.unique(keys(h, g, is_wide(h, g)), return_index=True, return_counts=True)
    return h[at], g[at], k


def packer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(chunk, id, k1, k2, text) to (chunk, pack): the rows of a part of the task that are dealt to a chunk, as compressed Arrow."""

    def packs(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        rows = pa.Table.from_batches(held)
        chunk = rows.column(0).to_numpy()
        order = np.argsort(chunk, kind="stable")
        rows, chunk = rows.take(pa.array(order)).combine_chunks(), chunk[order]
        opens = np.flatnonzero(np.append(True, chunk[1:] != chunk[:-1]))
        out = []
        for a, b in zip(opens, np.append(opens[1:], len(chunk)), strict=True):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, rows.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
                w.write_table(rows.slice(a, b - a))
            out.append((int(chunk[a]), sink.getvalue().to_pybytes()))
        return pa.RecordBatch.from_arrays([pa.array([c for c, _ in out], pa.int64()), pa.array([p for _, p in out], pa.binary())], ["chunk", "pack"])

    held, size = [], 0
    for b in slices(batches):
        held.append(b)
        size += b.nbytes
        if size > PACKED:
            yield packs(held)
            held, size = [], 0
    if sum(map(len, held)):
        yield packs(held)


def unpacked(chunk: pa.Table) -> Iterator[pa.RecordBatch]:
    """The rows (chunk, id, k1, k2, text) of a chunk's packs."""
    for pack in chunk.column("pack"):
        yield from pa.ipc.open_stream(pack.as_py())


def chunk_ngrams(docs: pa.Table, trusted: pa.Table) -> pa.Table:
    """The (chunk, h, g, k) of all texts of a chunk: its distinct 4-grams, and how often trusted texts have each."""
    ids = trusted.column("id").combine_chunks()
    total: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None
    held: dict[bool, list] = {True: [], False: []}
    size = {True: 0, False: 0}
    for rows in unpacked(docs):
        for t, own in zip(rows.column("text"), pc.is_in(rows.column("id"), value_set=ids).to_pylist(), strict=True):
            held[own].append(ngrams(symbols(t.as_py())))
            size[own] += len(held[own][-1][0])
            if size[own] >= CHUNK:
                total = merged(total, distinct(held[own]), own)
                held[own], size[own] = [], 0
    for own in (True, False):
        if size[own]:
            total = merged(total, distinct(held[own]), own)
    h, g, k = total if total else (np.empty(0, np.int64),) * 3
    chunk = np.full(len(g), docs.column("chunk")[0].as_py() if len(docs) else 0, np.int64)
    return pa.table({"chunk": chunk, "h": h.astype(np.int32), "g": g.astype(np.int64), "k": k.astype(np.int64)})


def merged(total: tuple | None, new: tuple, counted: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct n-grams of both, counts added; those of new are 0 unless counted."""
    h, g, k = new
    k = k if counted else np.zeros_like(k)
    if total is None:
        return h, g, k
    h, g, k = (np.concatenate([x, y]) for x, y in zip(total, (h, g, k), strict=True))
    _, at, back = np.unique(keys(h, g, is_wide(h, g)), return_index=True, return_inverse=True)
    return h[at], g[at], np.bincount(back, weights=k, minlength=len(at)).astype(np.int64)


def discounts(ones: list[float]) -> np.ndarray:
    """What counts of 0, 1, 2 and more are lowered by, from how often the counts 1 to 4 occur."""
    n = [max(1.0, float(x)) for x in ones]
    y = n[0] / (n[0] + 2 * n[1])
    return np.array([0.0, *(min(max(i - (i + 1) * y * n[i] / n[i - 1], 0.05), i - 0.05) for i in (1, 2, 3))], np.float32)


def interpolated(c: np.ndarray, d: np.ndarray, lower: np.ndarray) -> np.ndarray:
    """Probabilities from counts c, a context a row: lowered counts, and what that frees spread as lower says."""
    low = d[np.minimum(c, 3).astype(np.intp)]
    total = c.sum(axis=1, keepdims=True)
    spread = np.divide(low.sum(axis=1, keepdims=True), total, out=np.ones_like(total), where=total > 0)
    return (c - low) / np.maximum(total, 1) + spread * lower


def kneser_ney(g: np.ndarray, k: np.ndarray) -> np.ndarray:
    """log p(last symbol | the three before) of every 4-gram over 64 symbols, as a dense table, from the counts k of the
    distinct 4-grams g: the model of log_p() in small, by which tests see that probabilities sum to 1.

    Interpolated, with modified discounts: at each order the counts 1, 2 and more are lowered by their own discount, and
    what that frees in a context is spread by the next lower order, whose counts are numbers of distinct predecessors; the
    lowest order is spread evenly over all symbols. The highest order is worked out for one leading symbol at a time.
    """
    g = g.astype(np.int64)
    tables, left = [], g
    for order in range(ORDER - 1, 0, -1):
        left = np.unique(left) & (SYMBOLS**order - 1)
        tables.append(np.bincount(left, minlength=SYMBOLS**order).astype(np.float32).reshape(-1, SYMBOLS))
    p = np.full((1, SYMBOLS), 1.0 / SYMBOLS, np.float32)
    for c in reversed(tables):
        lower = p if len(p) in (1, len(c)) else np.tile(p, (len(c) // len(p), 1))  # the context less its first symbol
        p = interpolated(c, discounts([(c == i).sum() for i in range(1, 5)]), lower).astype(np.float32)
    d = discounts([(k == i).sum() for i in range(1, 5)])
    out = np.empty(SYMBOLS**ORDER, np.float16)
    block = SYMBOLS ** (ORDER - 1)
    for a in range(SYMBOLS):
        mine = (g >> (BITS * (ORDER - 1))) == a
        c = np.zeros(block, np.float32)
        c[g[mine] & (block - 1)] = k[mine]
        out[a * block : (a + 1) * block] = np.log(interpolated(c.reshape(-1, SYMBOLS), d, p)).ravel()
    return out


def log_p(wanted: DataFrame, counts: DataFrame) -> DataFrame:
    """(h, g, lp): log p(last symbol | the three before) of the distinct 4-grams wanted (h, g), as kneser_ney() says it.

    At each order n-grams meet their own counts, the sums of their contexts, and the probabilities of the next lower order,
    all by joins. A symbol that trusted text lacks has 1/64 of what the lowest order spreads.
    """
    low_bits = lambda n: F.col("g").bitwiseAND(F.lit((1 << WIDE * n) - 1))
    tables, want = {ORDER: counts}, {ORDER: wanted}
    for n in range(ORDER - 1, 0, -1):
        tables[n] = cut(tables[n + 1].groupBy(low_bits(n).alias("g")).agg(F.count("*").alias("c")))
        want[n] = want[n + 1].select(low_bits(n).alias("g")).distinct()
    lower = None
    for n in range(1, ORDER + 1):
        key = ["h", "g"] if n == ORDER else ["g"]
        context = [F.col("h"), F.shiftright("g", WIDE).alias("x")] if n == ORDER else [F.shiftright("g", WIDE).alias("x")]
        ones = tables[n].agg(*[F.count_if(F.col("c") == i) for i in range(1, 5)]).first()
        d = [float(x) for x in discounts(list(ones))]
        less = lambda c, d=d: F.when(c >= 3, d[3]).when(c == 2, d[2]).when(c == 1, d[1]).otherwise(0.0)
        sums = tables[n].groupBy(*context).agg(F.sum("c").alias("total"), F.sum(less(F.col("c"))).alias("less"))
        rows = want[n].join(tables[n], key, "left").withColumn("x", F.shiftright("g", WIDE))
        rows = rows.join(F.broadcast(sums) if n == 1 else sums, ["h", "x"] if n == ORDER else ["x"], "left")  # one row at order 1
        if lower is None:
            below: Column = F.lit(1.0 / SYMBOLS)
        else:
            rows, below = rows.withColumn("y", low_bits(n - 1)).join(lower.select(F.col("g").alias("y"), F.col("p").alias("below")), "y"), F.col("below")
        c = F.coalesce("c", F.lit(0))
        p = F.when(F.col("total") > 0, (c - less(c)) / F.col("total") + F.col("less") / F.col("total") * below).otherwise(below)
        lower = rows.select(*key, p.alias("p"))
        if n < ORDER:
            lower = cut(lower)
    return lower.select("h", "g", F.log("p").alias("lp"))


def score_chunk(docs: pa.Table, model: pa.Table) -> pa.Table:
    """(k1, k2, n, nll) of the texts of a chunk: symbols, and the negative log probability of all."""
    h, g, lp = model.column("h").to_numpy().astype(np.int64), model.column("g").to_numpy(), model.column("lp").to_numpy()
    wide = is_wide(h, g)
    known = keys(h, g, wide)
    order = np.argsort(known)
    known, lp = known[order], lp[order]
    n, nll = [], []
    k1, k2 = [], []
    for rows in unpacked(docs):
        k1 += rows.column("k1").to_pylist()
        k2 += rows.column("k2").to_pylist()
        for t in rows.column("text"):
            want = keys(*ngrams(symbols(t.as_py())), wide)
            at = np.searchsorted(known, want)
            if len(want) and (not len(known) or (known[np.minimum(at, len(known) - 1)] != want).any()):
                raise ValueError("an n-gram of a document is not in its chunk")
            n.append(len(want))
            nll.append(-float(lp[at].sum(dtype=np.float64)) if len(want) else 0.0)
    return pa.table({"k1": pa.array(k1, pa.int64()), "k2": pa.array(k2, pa.int64()), "n": pa.array(n, pa.int64()), "nll": pa.array(nll, pa.float64())})


def dealt(docs: DataFrame, chunks: int) -> tuple[DataFrame, str]:
    """(chunk, pack), bucketed by chunk, and the table's name: the rows of docs (doc_id, text) with text; null ids are dealt by text."""
    chunk = F.pmod(F.when(F.col("doc_id").isNotNull(), F.xxhash64("doc_id")).otherwise(F.xxhash64("text")), F.lit(chunks)).alias("chunk")
    rows = docs.filter("text IS NOT NULL").select(chunk, F.col("doc_id").cast("long").alias("id"), *row_key(), "text")
    return bucketed(rows.mapInArrow(lean(packer), "chunk long, pack binary"), "chunk")


def scores(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """(k1, k2, n, nll) of each row of docs (doc_id, text) that has text, by a model of the texts of ids (doc_id, distinct, no null)."""
    total = docs.agg(F.sum(F.length("text"))).first()[0] or 0
    chunks = -(-total // DEALT) or 1
    texts, name = dealt(docs, chunks)
    marked = ids.select(F.pmod(F.xxhash64("doc_id"), F.lit(chunks)).alias("chunk"), F.col("doc_id").cast("long").alias("id"))
    grams = stage(texts.groupBy("chunk").cogroup(marked.groupBy("chunk")).applyInArrow(lean_cogroup(chunk_ngrams), "chunk long, h int, g long, k long"))
    every = stage(grams.groupBy("h", "g").agg(F.sum("k").alias("c")))
    lp = stage(log_p(every.select("h", "g"), every.filter("c > 0")).withColumn("lp", F.col("lp").cast("float")))
    models = grams.select("chunk", "h", "g").join(lp, ["h", "g"])
    scored = stage(texts.groupBy("chunk").cogroup(models.groupBy("chunk")).applyInArrow(lean_cogroup(score_chunk), "k1 long, k2 long, n long, nll double"))
    discard(docs.sparkSession, name)
    return scored


def fluency(docs: DataFrame, trusted_ids: DataFrame, quantile: float = QUANTILE, margin: float = MARGIN) -> DataFrame:
    """(row, n_symbols, perplexity, cut, kept): every row of docs (doc_id, text, lang and any more) with its verdict; row is a
    struct of its columns.

    trusted_ids: the doc_id of texts to learn from and to set the cuts by, repeats allowed. A document is kept if its
    perplexity a symbol, drawn towards its language's mean by PRIOR symbols, is at most margin times the quantile of that of
    the trusted ones of its language, or of all trusted ones where it has none; null is a language. Null, empty and blank
    texts have no perplexity and are not kept. Without any trusted text, all others are. Very long texts are scored whole.
    Repeated rows, and null ids, are scored like others; a null id is never trusted. Empty tables give no rows.
    """
    ids = trusted_ids.select("doc_id").filter("doc_id IS NOT NULL").distinct()
    scored = scores(docs.select("doc_id", "text"), ids)
    once = scored.groupBy("k1", "k2").agg(F.first("n").alias("n"), F.first("nll").alias("nll"))  # repeated rows have one score
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *row_key()).join(once, ["k1", "k2"], "left")
    thin = docs.select("doc_id", "lang", *row_key()).join(once.filter("n > 0"), ["k1", "k2"])
    thin = stage(thin.join(ids.hint("merge"), "doc_id", "left_semi").select("lang", "n", "nll"))
    mean = thin.groupBy("lang").agg((F.sum("nll") / F.sum("n")).alias("mean"))
    drawn = (F.col("nll") + PRIOR * F.col("mean")) / (F.col("n") + PRIOR)
    near = thin.withColumnRenamed("lang", "l").join(mean.withColumnRenamed("lang", "m"), F.col("l").eqNullSafe(F.col("m"))).select("l", "mean", drawn.alias("drawn"))
    cuts = near.groupBy("l").agg(F.first("mean").alias("mean"), F.percentile_approx("drawn", quantile, 10000).alias("q"))
    mean_all = thin.agg((F.sum("nll") / F.sum("n")).alias("mean_all")).first()[0]
    q_all = thin.agg(F.percentile_approx((F.col("nll") + PRIOR * F.lit(mean_all)) / (F.col("n") + PRIOR), quantile, 10000)).first()[0]
    mean, q = F.coalesce("mean", F.lit(mean_all).cast("double")), F.coalesce("q", F.lit(q_all).cast("double")) + F.log(F.lit(margin))
    drawn = (F.col("nll") + PRIOR * mean) / (F.col("n") + PRIOR)
    out = rows.join(cut(cuts), F.col("row.lang").eqNullSafe(F.col("l")), "left")
    n = F.coalesce("n", F.lit(0).cast("long"))
    return out.select(
        "row", n.alias("n_symbols"), F.when(n > 0, F.exp(F.col("nll") / n)).alias("perplexity"), F.exp(q).alias("cut"),
        ((n > 0) & F.coalesce(drawn <= q, F.lit(True))).alias("kept"),
    )


def trusted_of(labels: DataFrame) -> DataFrame:
    return labels.filter("quality = 1").select("doc_id")


def keep_fluent(docs: DataFrame, trusted_ids: DataFrame) -> DataFrame:
    """The rows of docs that are kept, all columns."""
    return fluency(docs, trusted_ids).filter("kept").select(*[F.col(f"row.`{c}`") for c in docs.columns])


def quality_report(docs: DataFrame, trusted_ids: DataFrame) -> DataFrame:
    """(doc_id, lang, n_symbols, perplexity, cut, kept) for each row of docs; no text is carried along."""
    return fluency(docs.select("doc_id", "lang", "text"), trusted_ids).select("row.doc_id", "row.lang", "n_symbols", "perplexity", "cut", "kept")
