"""N-gram Jaccard join: components of documents whose word-shingle sets have a Jaccard similarity of 0.75 or more.

1. Documents with equal sets form one class, known by a digest of 128 bits; all later steps see a class once. Shingles are
   known by hashes of 64 bits.
2. Different texts, compressed, are dealt to tasks by hash, which number their classes. (shingle, class) pairs, packed in sorted
   arrays, go to shards by hash range; a class is a place in its batch there, whatever the number of shards. A shard keeps the
   shingles of two or more classes and their frequency. A class stays a candidate only if 3/4 of its shingles are so shared.
   Texts that differ and have equal sets may be numbered apart; they are linked as any equal sets are.
3. Two linked sets meet in their prefixes: with shingles ordered by frequency, then hash, the first n - ceil(0.75 n) + 1.
   Classes that share a prefix shingle are joined, as stars round the least class of that shingle, into pools.
4. Each pool is searched for links by T-occurrence search (DivideSkip): a set asks for those in which at least T of its
   shingles occur; the shortest inverted lists are merged on a heap, which skips what cannot reach the lowered threshold,
   and what reaches it is probed in the longest lists by binary search.
5. A pool too large for one task is cut into blocks by hash. Links are found inside blocks, then among one representative of
   each part that is already linked; last, everything outside the largest part is searched against all blocks of the pool.
   Pairs inside the largest part need no search, so a pool of near copies costs a multiple of its size.
"""

from __future__ import annotations

import heapq
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from math import log2

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import poly_hash
from .common import cut, freed, lean, lean_group, row_key, slices
from .components import components

SHINGLE = 5
#: Shingles a packed batch, a shard and a block hold at about most.
BATCH, SHARD, BLOCK = 600_000, 1_500_000, 32_000
#: Bytes of different texts that are dealt out at a time.
DEAL = 1 << 23
BYTES = poly_hash.values(10)
SPACE = np.isin(np.arange(256), [32, 9, 10, 11, 12, 13])
WORD_MARK = np.uint64(0x5555AAAA5555AAAA)


def shingles(text: str | bytes | None, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles of a text, or of its UTF-8; a text of fewer words is one shingle."""
    raw = np.frombuffer((text if isinstance(text, bytes) else (text or "").encode()).lower(), np.uint8)  # bytes.lower() changes A-Z only
    solid = ~SPACE[raw]
    first = solid.copy()
    first[1:] &= ~solid[:-1]
    start = (np.cumsum(solid) - 1)[first]
    if not len(start):
        return np.empty(0, np.uint64)
    vals = BYTES[raw[solid]]
    vals[start] ^= WORD_MARK
    prefix = poly_hash.prefixes(vals)
    k = min(size, len(start))
    end = np.append(start[1:], len(vals))
    return np.unique(poly_hash.spans(prefix, start[: len(start) - k + 1], end[k - 1 :]))


def digest(s: np.ndarray) -> tuple[int, int]:
    """Two signed 64-bit digests of a set of hashes."""
    n = np.array([len(s)], np.uint64)
    both = np.array([np.sum(poly_hash.mix(s ^ n)), np.sum(poly_hash.mix(s * np.uint64(3) + np.uint64(77)))], np.uint64)
    both = poly_hash.mix(both + n * np.uint64(0x9E3779B97F4A7C15))
    return tuple(both.astype(np.int64).tolist())


def set_sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, k2, text) to (doc_id, k2, n, c1, c2): set size and class."""
    for b in slices(batches):
        sets = [shingles(t.as_py()) for t in b.column(2)]
        c1, c2 = zip(*map(digest, sets), strict=True)
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([len(s) for s in sets], pa.int64()), pa.array(c1, pa.int64()), pa.array(c2, pa.int64())], ["doc_id", "k2", "n", "c1", "c2"])


def dealer(parts: int):
    """(h, text), h a hash of the text, to (part, source, at, texts): different texts of a task, dealt to parts by hash, compressed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        source, codec, seen, held, n, at = TaskContext.get().partitionId(), pa.Codec("zstd", compression_level=3), set(), {}, 0, 0

        def dealt() -> pa.RecordBatch:
            rows = []
            for part, texts in held.items():
                raw = np.array([len(t) for t in texts], np.int64).tobytes() + b"".join(texts)
                rows.append((part, len(texts), len(raw), codec.compress(raw, asbytes=True)))
            part, count, size, packed = zip(*rows, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array([source] * len(rows), pa.int32()), pa.array([at] * len(rows), pa.int32()), pa.array(count, pa.int32()), pa.array(size, pa.int64()), pa.array(packed, pa.binary())], DEALT.names)

        for b in slices(batches):
            for h, t in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                if t.is_valid and (key := (h, len(text := t.as_py().encode()))) not in seen:
                    seen.add(key)
                    held.setdefault(h % parts, []).append(text)
                    n += len(text)
                    if n >= DEAL:
                        yield dealt()
                        held, n, at = {}, 0, at + 1
        if held:
            yield dealt()

    return run


def packer(shards: int):
    """Parts of dealer(), one a task, to (shard, first, n, low, high): the n sorted shingles of a batch of classes that fall to a shard,
    as differences, and for each the place of its class among those from number first on; lower bytes, and upper ones, compressed. Rows
    of n 0 tell of the classes first, first + 1, ...: sizes and digests, in low."""

    def pack(sets: dict[tuple[int, int], np.ndarray], first: int) -> pa.RecordBatch:
        tok = np.concatenate(list(sets.values()))
        sizes = np.array([len(s) for s in sets.values()], np.int64)
        own = np.repeat(np.arange(len(sets), dtype=np.uint32), sizes)
        order = np.argsort(tok)
        tok, own = tok[order], own[order]
        cuts = np.searchsorted(tok, np.array([i * 2**64 // shards for i in range(shards)], np.uint64))
        rows = [(first % shards, first, 0, np.column_stack([sizes, np.array(list(sets), np.int64)]).tobytes(), b"")]
        for s, (a, b) in enumerate(zip(cuts, np.append(cuts[1:], len(tok)), strict=True)):
            if a < b:
                step, at = (x.view(np.uint8).reshape(b - a, -1).T for x in (np.diff(tok[a:b], prepend=np.uint64(0)), own[a:b]))
                low, high = (np.concatenate(x).tobytes() for x in ((step[:LOW], at[:1]), (step[LOW:], at[1:])))
                rows.append((s, first, b - a, low, pa.compress(high, "zstd", asbytes=True)))
        return pa.RecordBatch.from_pylist([dict(zip(PACKED.names, r, strict=True)) for r in rows], PACKED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec, sets, seen, n, first = pa.Codec("zstd"), {}, set(), 0, None
        for b in batches:
            for part, count, size, packed in zip(*(b.column(i) for i in (0, 3, 4, 5)), strict=True):
                if first is None:
                    first = part.as_py() << 32
                raw = codec.decompress(packed.as_buffer(), decompressed_size=size.as_py(), asbytes=True)
                ends = np.cumsum(np.frombuffer(raw, np.int64, count.as_py())).tolist()
                for i, j in zip([0, *ends], ends, strict=False):
                    s = shingles(raw[8 * len(ends) + i : 8 * len(ends) + j])
                    if len(s) and (c := digest(s)) not in seen:
                        seen.add(c)
                        sets[c] = s
                        n += len(s)
                        if n >= BATCH:
                            yield pack(sets, first)
                            first, sets, n = first + len(sets), {}, 0
        if sets:
            yield pack(sets, first)

    return run


DEALT = pa.schema([("part", pa.int32()), ("source", pa.int32()), ("at", pa.int32()), ("n", pa.int32()), ("size", pa.int64()), ("texts", pa.binary())])
#: Lower bytes of a difference of shingles, which do not compress.
LOW = 5
PACKED = pa.schema([("shard", pa.int32()), ("first", pa.int64()), ("n", pa.int32()), ("low", pa.binary()), ("high", pa.binary())])
#: In place of a frequency: what a row tells of its class, in order of its digests and size.
ABOUT = (-3, -2, -1)


def shared_shingles(shard: pa.Table) -> pa.Table:
    """The (c, tok, df) of a shard's shingles that two or more classes have, and ABOUT the classes of which the shard tells."""
    toks, own, about = [], [], []
    codec = pa.Codec("zstd")
    for first, n, low, high in zip(*(shard.column(k) for k in PACKED.names[1:]), strict=True):
        first, n, low = first.as_py(), n.as_py(), low.as_buffer()
        if not n:
            told = np.frombuffer(low, np.int64).reshape(-1, 3)
            about.append((first + np.arange(len(told)), told))
            continue
        low = np.frombuffer(low, np.uint8).reshape(LOW + 1, n)
        high = np.frombuffer(codec.decompress(high.as_buffer(), decompressed_size=n * (11 - LOW)), np.uint8).reshape(-1, n)
        toks.append(np.cumsum(np.concatenate([low[:LOW], high[: 8 - LOW]]).T.copy().view(np.uint64).ravel(), dtype=np.uint64))
        own.append(np.concatenate([low[LOW:], high[8 - LOW :]]).T.copy().view(np.uint32).ravel().astype(np.int64) + first)
    tok, own = np.concatenate([np.empty(0, np.uint64), *toks]), np.concatenate([np.empty(0, np.int64), *own])
    del toks
    order = np.argsort(tok)
    tok, own = tok[order], own[order]
    new = np.ones(len(tok), bool)
    new[1:] = tok[1:] != tok[:-1]
    begin = np.flatnonzero(new)
    df = np.repeat(np.diff(np.append(begin, len(tok))), np.diff(np.append(begin, len(tok))))
    tok, own, df = tok[df > 1].astype(np.int64), own[df > 1], df[df > 1]
    for c, told in about:
        for mark, value in zip(ABOUT, told.T[[1, 2, 0]], strict=True):
            own, tok, df = np.append(own, c), np.append(tok, value), np.append(df, np.full(len(c), mark))
    return pa.table({"c": own, "tok": tok, "df": df.astype(np.int32)})


def merge_skip(own: list[int], lo: list[int], hi: list[int], need: int, after: int = -1) -> tuple[list[int], list[int]]:
    """The values over `after` that are in `need` or more of the sorted lists own[lo:hi], and in how many; need is 1 at least.

    Lists are merged on a heap of their heads. A head that is in too few lists is popped together with so many others that
    fewer than need are left below the new head, to which all of them skip.
    """
    k = len(lo)
    at = [bisect_right(own, after, a, b) for a, b in zip(lo, hi, strict=True)] if after >= 0 else list(lo)
    heap = [own[a] * k + j for j, (a, b) in enumerate(zip(at, hi, strict=True)) if a < b]
    heapq.heapify(heap)
    values, counts = [], []
    while len(heap) >= need:
        head = heap[0] // k
        popped = []
        while heap and heap[0] < (head + 1) * k:
            j = heap[0] % k
            at[j] += 1
            popped.append(j)
            if at[j] < hi[j]:
                heapq.heapreplace(heap, own[at[j]] * k + j)
            else:
                heapq.heappop(heap)
        if len(popped) >= need:
            values.append(head)
            counts.append(len(popped))
        elif len(heap) >= need > 1:
            ahead = [heapq.heappop(heap) % k for _ in range(need - 1)]
            to = heap[0] // k
            for j in ahead:
                at[j] = bisect_left(own, to, at[j], hi[j])
                if at[j] < hi[j]:
                    heapq.heappush(heap, own[at[j]] * k + j)
    return values, counts


def links(query: list[tuple[int, int, np.ndarray]], index: list[tuple[int, int, np.ndarray]] | None = None) -> list[tuple[int, int]]:
    """Links (a, b) that connect what the sets (class, size, shared shingles) of query and index link to: a spanning forest.

    Without an index, the query's sets are searched against each other. 7 * overlap >= 3 * (n + m) is a similarity of 0.75.
    """
    sets = query if index is None else index
    sizes = np.array([n for _, n, _ in sets], np.int64)
    tok = np.concatenate([t for _, _, t in sets])
    own = np.repeat(np.arange(len(sets)), [len(t) for _, _, t in sets])
    order = np.argsort(tok, kind="stable")
    lists, own = tok[order], own[order]
    flat = own.tolist()
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = x = parent[parent[x]]
        return x

    out = []
    for q, (c, n, t) in enumerate(query):
        lo, hi = np.searchsorted(lists, t), np.searchsorted(lists, t, "right")
        size = hi - lo
        by = np.argsort(size)
        lo, hi = lo[by], hi[by]
        least = -(-3 * n // 4)
        longest = int(size.max(initial=0))
        long = min(least - 1, int(least / (0.01 * log2(max(2, longest)) + 1))) if longest > 8 else 0  # DivideSkip's number of lists that are probed
        short = len(t) - long
        if short < least - long:
            continue
        found, count = merge_skip(flat, lo[:short].tolist(), hi[:short].tolist(), least - long, q if index is None else -1)
        found, count = np.array(found, np.int64), np.array(count, np.int64)
        for i, (a, b) in enumerate(zip(lo[short:], hi[short:], strict=True)):
            keep = count + (long - i) >= least  # what can still get there
            found, count = found[keep], count[keep]
            if not len(found):
                break
            if a < b:
                run = own[a:b]
                count = count + (run[np.minimum(np.searchsorted(run, found), len(run) - 1)] == found)
        for j in found[7 * count >= 3 * (n + sizes[found])]:
            d = sets[j][0]
            if c != d and (x := root(c)) != (y := root(d)):
                parent[x] = y
                out.append((c, d))
    return out


def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (pool, block), of (pool, block, side, c, n, toks): links of each block, of side 1 against side 0 if there is a side 1."""
    key, group = None, ([], [])

    def flush() -> pa.RecordBatch:
        index, query = group
        pairs = links(query, index) if query and index else links(index) if len(index) > 1 else []
        return pa.RecordBatch.from_arrays([pa.array([p[0] for p in pairs], pa.int64()), pa.array([p[1] for p in pairs], pa.int64())], ["a", "b"])

    for b in batches:
        cols = [b.column(i).to_pylist() for i in range(5)]
        toks = b.column(5)
        flat, ends = toks.values.to_numpy(), toks.offsets.to_numpy()
        for i, (pool, block, side, c, n) in enumerate(zip(*cols, strict=True)):
            if (pool, block) != key:
                if len(group[0]) + len(group[1]) > 1:
                    yield flush()
                key, group = (pool, block), ([], [])
            group[side].append((c, n, np.sort(flat[ends[i] : ends[i + 1]])))
    if key is not None:
        yield flush()


def find_links(members: DataFrame) -> DataFrame:
    """Links (a, b) inside the blocks of (pool, block, side, c, n, toks)."""
    parts = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = members.select("pool", "block", "side", "c", "n", "toks").repartition(parts, "pool", "block").sortWithinPartitions("pool", "block")
    return rows.mapInArrow(lean(search), "a long, b long")


def link_classes(candidates: DataFrame) -> DataFrame:
    """Links that connect what is linked among candidates (c, n, toks by frequency, prefix: the number of toks in the prefix)."""
    posts = candidates.select("c", F.explode(F.slice("toks", 1, F.col("prefix"))).alias("tok"))
    hubs = posts.groupBy("tok").agg(F.min("c").alias("hub"), F.count("*").alias("k")).filter("k > 1").select("tok", "hub")
    stars = posts.join(hubs, "tok").filter("c <> hub").select(F.col("hub").alias("a"), F.col("c").alias("b"))
    pools = components(stars).withColumnsRenamed({"node": "c", "label": "pool"})
    members = candidates.join(pools, "c")
    weight = members.groupBy("pool").agg(F.ceil(F.sum(F.size("toks")) / BLOCK).alias("blocks"))
    members = cut(members.join(weight, "pool").select("pool", "blocks", "c", "n", "toks", F.pmod(F.xxhash64("c"), F.col("blocks")).alias("block"), F.lit(0).alias("side")))
    found = cut(find_links(members))
    large = members.filter("blocks > 1")
    if large.isEmpty():
        return found

    def labelled(edges: DataFrame) -> DataFrame:
        return large.join(components(edges).withColumnRenamed("node", "c"), "c", "left").withColumn("label", F.coalesce("label", "c"))

    heads = labelled(found)
    heads = heads.join(heads.groupBy("pool", "label").agg(F.min("c").alias("c")).select("c"), "c", "left_semi")
    weight = heads.groupBy("pool").agg(F.ceil(F.sum(F.size("toks")) / BLOCK).alias("blocks"))
    heads = heads.drop("blocks").join(weight, "pool").withColumn("block", F.pmod(F.xxhash64("c", F.lit(2)), F.col("blocks")))
    found = cut(found.unionByName(find_links(heads)))

    parts = labelled(found).withColumn("weight", F.size("toks"))
    sums = parts.groupBy("pool", "label").agg(F.sum("weight").alias("w"))
    largest = sums.groupBy("pool").agg(F.max(F.struct("w", "label")).alias("m"), F.sum("w").alias("all")).select("pool", F.col("m.label").alias("main"), F.ceil((F.col("all") - F.col("m.w")) / BLOCK).alias("rest"))
    parts = parts.join(largest.filter("rest > 0"), "pool")
    pair = lambda i, j: (i * F.col("rest") + j).alias("block")  # noqa: E731  block i of the pool with block j of what is outside its largest part
    own = F.pmod(F.xxhash64("c", F.lit(3)), F.col("rest"))
    index = parts.select("pool", "c", "n", "toks", F.lit(0).alias("side"), "block", "rest", F.explode(F.sequence(F.lit(0).cast("long"), F.col("rest") - 1)).alias("j")).withColumn("block", pair(F.col("block"), F.col("j"))).drop("rest", "j")
    query = parts.filter("label <> main").select("pool", "c", "n", "toks", F.lit(1).alias("side"), "rest", own.alias("j"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("i")).withColumn("block", pair(F.col("i"), F.col("j"))).drop("rest", "j", "i")
    return cut(found.unionByName(find_links(index.unionByName(query))))


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id), one row for each row of docs.

    Null, empty and blank texts: n_shingles 0, linked with nothing, component_id their own doc_id. Null ids take part, and
    get the least id of their component, null if none has one. Repeated rows are copies like any other. Very long texts take
    part whole. An empty table gives no rows. Other columns of docs are ignored.
    """
    return members(docs, id_col, text_col).select("doc_id", F.col("n").alias("n_shingles"), "component_id")


def members(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, k2 of row_key(), n, component_id, label), one row for each row of docs; label tells components apart, with ids or without."""
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), row_key(id_col, text_col)[1], F.col(text_col).alias("text"))
    sizes = cut(docs.mapInArrow(lean(set_sizes), "doc_id long, k2 long, n long, c1 long, c2 long"))
    total = sizes.agg(F.sum("n")).first()[0] or 0
    shards = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), total // SHARD)
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = docs.select(F.xxhash64("text").alias("h"), "text").mapInArrow(lean(dealer(parts)), "part int, source int, at int, n int, size long, texts binary")
    packed = dealt.repartitionById(parts, "part").sortWithinPartitions("source", "at").mapInArrow(lean(packer(shards)), "shard int, first long, n int, low binary, high binary")
    shared = packed.groupBy("shard").applyInArrow(lean_group(shared_shingles), "c long, tok long, df int")
    classes = sizes.filter("n > 0").groupBy("c1", "c2").agg(F.max("n").alias("n"), F.min("doc_id").alias("least"))
    found = shared.groupBy("c").agg(F.array_sort(F.collect_list(F.struct("df", "tok"))).alias("all"))
    about = [F.col("all")[i]["tok"].alias(name) for i, name in enumerate(("c1", "c2", "n"))]  # as ABOUT has it
    least = -F.floor(-F.col("n") * 3 / 4)
    candidates = found.select("c", *about, F.transform(F.slice("all", 4, F.greatest(F.size("all") - 3, F.lit(1))), lambda x: x["tok"]).alias("toks")).filter(F.size("toks") >= least)
    del dealt, packed, shared, found
    candidates = cut(candidates.select("c1", "c2", "c", "n", "toks", (F.size("toks") - least + 1).cast("int").alias("prefix")))
    freed(docs.sparkSession)
    linked = components(link_classes(candidates.select("c", "n", "toks", "prefix"))).withColumnRenamed("node", "c")
    owner = candidates.select("c", "c1", "c2").join(linked, "c").select("c1", "c2", "label").dropDuplicates(["c1", "c2"])  # texts of equal sets have one label
    owner = owner.join(classes.select("c1", "c2", "least"), ["c1", "c2"])
    first = owner.groupBy("label").agg(F.min("least").alias("first"))
    owner = owner.join(first, "label").select("c1", "c2", "first", F.concat_ws(" ", F.lit("part"), "label").alias("label"))
    owner = classes.select("c1", "c2", "least").join(owner, ["c1", "c2"], "left").select("c1", "c2", F.coalesce("first", "least").alias("component_id"), F.coalesce("label", F.concat_ws(" ", "c1", "c2")).alias("label"))
    out = sizes.join(cut(owner), ["c1", "c2"], "left")  # a table, so that the join can split the rows of a class of many copies
    return out.select("doc_id", "k2", "n", F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"), "label")


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of docs, all columns, that stay: of each component one row, that with the least id, null ids last; among rows of
    one id the text with the least hash, among equal rows any. Rows without words are linked with nothing and stay."""
    rows = cut(members(docs).select(F.coalesce("doc_id", F.lit(-1)).alias("k1"), "k2", "doc_id", "n", "label"))
    least = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "k1", "k2")).alias("m")
    one = rows.filter("n > 0").groupBy("label").agg(least).select("m.k1", "m.k2", F.lit(True).alias("once"))
    blank = rows.filter("n = 0").select("k1", "k2").distinct().withColumn("once", F.lit(False))
    kept = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *row_key()).join(one.unionByName(blank), ["k1", "k2"])
    own = F.when(F.col("once"), F.lit(-1)).otherwise(F.monotonically_increasing_id()).alias("own")
    return kept.select("row", "k1", "k2", own).dropDuplicates(["k1", "k2", "own"]).select(*[F.col(f"row.`{c}`") for c in docs.columns])


ORACLE = r"""
WITH RECURSIVE t AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS MATERIALIZED (
  SELECT DISTINCT doc_id, list_aggregate(w[i:i + k - 1], 'string_agg', ' ') AS g
  FROM (SELECT doc_id, w, least(5, len(w)) AS k, unnest(range(1, len(w) - least(5, len(w)) + 2)) AS i FROM t WHERE len(w) > 0)),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pairs AS MATERIALIZED (
  SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS i FROM s x JOIN s y USING (g) WHERE x.doc_id <> y.doc_id GROUP BY ALL)
  JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * i >= 75 * (p.n + q.n - i)),
r AS (SELECT doc_id AS d, doc_id AS c FROM t UNION SELECT r.d, pairs.b FROM r JOIN pairs ON pairs.a = r.c)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id
FROM t LEFT JOIN n USING (doc_id) JOIN (SELECT d AS doc_id, min(c) AS component_id FROM r GROUP BY d) USING (doc_id)
"""
