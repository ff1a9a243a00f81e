"""Near duplicates by fast similarity sketching: components of documents whose word-shingle sets have a Jaccard similarity of 0.85
or more.

1. Where a text is read, its shingles are hashed and its sketch is filled: in each round every shingle falls into one of WIDTH
   bins with a value that grows with the round, and bins keep their least. Rounds end when all bins are full; from round WIDTH
   on, a round fills one bin with all shingles, so that no bin stays empty. Two sketches agree in a bin with the probability of
   the sets' similarity, and the number of agreements is concentrated at least as well as with independent bins.
2. Documents with equal sets are one class, known by a digest of 128 bits. BANDS bands of ROWS bins are the keys of classes;
   classes that share a key are candidates. A pair at the threshold shares none with probability 6e-9. Keys of one class go.
3. Classes joined by keys are pools. The texts of a pool come together in one task, which compares candidates on the words
   themselves, not on hashes, until what links is connected.
4. A pool too large for a task is searched in three rounds. First each class asks one other, that with most candidates of all that it
   shares a key with, a copy's original as a rule. What is then under a key with a part that it is not connected to is dealt to
   blocks, each class once, and searched inside them. Last, what is so still meets in blocks: those outside the pool's largest part
   against all. Overlaps of one class with a block are counted together, from the
   block's inverted lists. No link is lost: two classes under a key are in one part or are compared.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import poly_hash
from .common import cut, lean, row_key, slices, stage
from .components import components
from .jaccard_join import digest, shingles

SHINGLE = 3
#: A link: 100 * intersection >= PERCENT * union.
PERCENT = 85
BANDS, ROWS = 40, 6
WIDTH = BANDS * ROWS
#: A pool for one task, or one side of a block: the shingles of its classes, and OVERHEAD for each class, sum to about no more.
BLOCK, OVERHEAD = 200_000, 200
U = np.uint64
SEEDS = poly_hash.mix(np.arange(1, 2 * WIDTH + 1, dtype=np.uint64) * U(0x9E3779B97F4A7C15))
FULL = U(2**64 - 1)


def linked(a: int, b: int, both: int) -> bool:
    return 100 * both >= PERCENT * (a + b - both)


def sketches(sets: list[np.ndarray]) -> np.ndarray:
    """One row of WIDTH bins for each set of hashes; sets are not empty."""
    bins = np.full((len(sets), WIDTH), FULL)
    flat = bins.reshape(-1)
    items = np.concatenate(sets)
    own = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    for turn, seed in enumerate(SEEDS):
        h = poly_hash.mix(items ^ seed)
        at = ((h >> U(32)) * U(WIDTH) >> U(32)).astype(np.int64) if turn < WIDTH else turn - WIDTH
        np.minimum.at(flat, own * WIDTH + at, U(turn << 55) | (poly_hash.mix(h + seed) >> U(9)))
        short = (bins == FULL).any(axis=1)[own]
        if not short.any():
            break
        if not short.all():
            items, own = items[short], own[short]
    return bins


def band_keys(bins: np.ndarray) -> np.ndarray:
    """A key for each band of each row, the band's number in it."""
    rows = bins.reshape(len(bins), BANDS, ROWS)
    key = np.broadcast_to(np.arange(BANDS, dtype=np.uint64) * U(0xD1342543DE82EF95), rows.shape[:2])
    for k in range(ROWS):
        key = poly_hash.mix(key * U(3) + rows[:, :, k])
    return key.view(np.int64)


def sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, k2, text) to (doc_id, k2, n, c1, c2, bands): set size, class and keys. A set so small that no other set reaches the threshold has no keys."""
    for b in slices(batches):
        sets = [shingles(t.as_py(), SHINGLE) for t in b.column(2)]
        c1, c2 = zip(*map(digest, sets), strict=True)
        some = [i for i, s in enumerate(sets) if linked(len(s), len(s) + 1, len(s)) and len(s)]
        keys = iter(band_keys(sketches([sets[i] for i in some])).tolist() if some else [])
        bands, some = [], set(some)
        for i in range(len(sets)):
            bands.append(next(keys) if i in some else [])
        yield pa.RecordBatch.from_arrays(
            [b.column(0), b.column(1), pa.array([len(s) for s in sets], pa.int64()), pa.array(c1, pa.int64()), pa.array(c2, pa.int64()), pa.array(bands, pa.list_(pa.int64()))], ["doc_id", "k2", "n", "c1", "c2", "bands"]
        )


def word_sets(texts: list[str]) -> list[np.ndarray]:
    """The shingle set of each text, shingles numbered within these texts: equal numbers are equal words. Texts have SHINGLE words or more."""
    ids: dict[bytes, int] = {}
    words = [[ids.setdefault(w, len(ids)) for w in t.encode().lower().split()] for t in texts]  # bytes: A-Z only, ASCII white space
    lengths = np.array([len(w) for w in words])
    flat = np.concatenate([np.array(w, np.int64) for w in words])
    code = flat
    for k in range(1, SHINGLE):
        code = np.unique(code[:-1] * len(ids) + flat[k:], return_inverse=True)[1]
    ends = np.cumsum(lengths)
    return [np.unique(code[e - n : e - SHINGLE + 1]) for e, n in zip(ends.tolist(), lengths.tolist(), strict=True)]


def links(index: list[tuple], query: list[tuple]) -> list[tuple[int, int]]:
    """Links (a, b) among members (c, label, keys, text) that connect what links under a common key: members of query to those of
    index, or, without a query, those of index to each other. Equal labels are connected before."""
    members = index + query
    sets = word_sets([m[3] for m in members])
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = x = parent[parent[x]]
        return x

    under: dict[int, dict[int, list[int]]] = {}
    out = []
    sizes = np.array([len(x) for x in sets])
    tok = np.concatenate(sets)
    order = np.argsort(tok, kind="stable")
    owners = np.repeat(np.arange(len(sets)), sizes)[order]
    starts = np.searchsorted(tok[order], np.arange(int(tok.max()) + 2))

    def overlaps(i: int) -> np.ndarray:
        """How much each member shares with member i: its inverted lists, counted."""
        first, n = starts[sets[i]], starts[sets[i] + 1] - starts[sets[i]]
        skip = np.repeat(first - np.cumsum(n) + n, n)
        return np.bincount(owners[skip + np.arange(len(skip))], minlength=len(sets))

    def ask(i: int) -> None:
        c, label, keys, _ = members[i]
        fits = None
        for key in keys:
            for part, others in under.get(key, {}).items():  # a part as it was called when it came
                if root(part) == root(label):
                    continue
                if fits is None:
                    both = overlaps(i)
                    fits = linked(sizes[i], sizes, both)
                if (j := next((j for j in others if fits[j]), None)) is not None:
                    out.append((c, members[j][0]))
                    parent[root(label)] = root(part)

    for i, (_, label, keys, _) in enumerate(index):
        if not query:
            ask(i)
        for key in keys:
            under.setdefault(key, {}).setdefault(root(label), []).append(i)
    for i in range(len(index), len(members)):
        ask(i)
    return out


def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (at, block), of (at, block, side, c, label, keys, text), to the links (a, b) of each (at, block)."""
    now, sides = None, ([], [])

    def flush() -> pa.RecordBatch:
        found = links(*sides) if len(sides[0]) + len(sides[1]) > 1 and sides[0] else []
        return pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], ["a", "b"])

    for b in batches:
        for at, block, side, *member in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if (at, block) != now:
                if now is not None:
                    yield flush()
                now, sides = (at, block), ([], [])
            sides[side].append(tuple(member))
    if now is not None:
        yield flush()


def found_in(groups: DataFrame) -> DataFrame:
    """Links (a, b) of (at, block, side, c, label, keys, text), computed once."""
    parts = int(groups.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = groups.select("at", "block", "side", "c", "label", "keys", "text").repartition(parts, "at", "block").sortWithinPartitions("at", "block")
    return cut(rows.mapInArrow(lean(search), "a long, b long"))


def dealt(rows: DataFrame) -> DataFrame:
    """Members (at, c, n, label, keys, asks, asked) in blocks: those that ask meet all of their at that are asked."""
    blocks = lambda who: F.greatest(F.lit(1), F.ceil(F.sum(F.when(F.col(who), F.col("n") + OVERHEAD)) / BLOCK)).alias(f"{who}_in")
    rows = rows.join(rows.groupBy("at").agg(blocks("asks"), blocks("asked")), "at")
    own = lambda n: F.pmod(F.xxhash64("c", F.col("at")), F.col(n))
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    index = rows.filter("asked").select("*", own("asked_in").alias("i"), each("asks_in").alias("j"), F.lit(0).alias("side"))
    query = rows.filter("asks").select("*", own("asks_in").alias("j"), each("asked_in").alias("i"), F.lit(1).alias("side"))
    return index.unionByName(query).withColumn("block", F.col("i") * F.col("asks_in") + F.col("j"))


def relabelled(members: DataFrame, links: DataFrame) -> DataFrame:
    """members (c, label, others) with the labels that links between classes now lead to; parts, not classes, are contracted."""
    ends = [members.select(F.col("c").alias(x), F.col("label").alias(y)) for x, y in (("a", "la"), ("b", "lb"))]
    parts = links.join(ends[0], "a").join(ends[1], "b").select(F.col("la").alias("a"), F.col("lb").alias("b"))
    return members.join(components(parts).toDF("label", "to"), "label", "left").withColumn("label", F.coalesce("to", "label")).drop("to")


def links_of_large(members: DataFrame) -> DataFrame:
    """Links of the members (at, c, n, bands, text) of large pools, as point 4 says."""
    texts, parts = members.select("c", "text"), members.select("at", "c", "n", "bands", F.col("c").alias("label"))
    posts = parts.select("c", "n", F.explode("bands").alias("key"))
    score = posts.join(posts.groupBy("key").agg(F.count("*").alias("k")).filter("k > 1"), "key").groupBy("c").agg(F.sum("k").alias("score"))
    posts = parts.join(score, "c").select("c", "n", "score", F.explode("bands").alias("key"))
    best = posts.groupBy("key").agg(F.max(F.struct("score", "c", "n")).alias("best"))
    stars = cut(posts.join(best, "key").groupBy("c", "n").agg(F.max("best").alias("best")).filter("c <> best.c").select(F.col("best.c").alias("at"), "c", "n", F.col("best.n").alias("hub_n")))
    hubs = stars.select("at", F.col("at").alias("c"), F.col("hub_n").alias("n")).distinct().withColumns({"asks": F.lit(False), "asked": F.lit(True)})
    rows = stars.drop("hub_n").withColumns({"asks": F.lit(True), "asked": F.lit(False)}).unionByName(hubs)
    found = found_in(dealt(rows.withColumns({"label": F.col("c"), "keys": F.array(F.lit(0).cast("long"))})).join(texts, "c"))

    def still_open(parts: DataFrame) -> DataFrame:
        """Those under a key with a class of another label."""
        posts = parts.select("c", "label", F.explode("bands").alias("key"))
        mixed = posts.groupBy("key").agg(F.min("label").alias("least"), F.max("label").alias("most")).filter("least <> most").select("key")
        return parts.join(posts.join(mixed, "key", "left_semi").select("c").distinct(), "c")

    parts = cut(still_open(cut(relabelled(parts, found))))
    blocks = parts.groupBy("at").agg(F.ceil(F.sum(F.col("n") + OVERHEAD) / BLOCK).alias("blocks"))
    once = parts.join(blocks, "at").select("at", F.pmod(F.xxhash64("c"), F.col("blocks")).alias("block"), F.lit(0).alias("side"), "c", "label", F.col("bands").alias("keys"))
    inside = found_in(once.join(texts, "c"))
    found = found.unionByName(inside)

    open_ = cut(still_open(relabelled(parts, inside)))
    main = open_.groupBy("at", "label").agg(F.count("*").alias("k")).groupBy("at").agg(F.max(F.struct("k", "label"))["label"].alias("main"))
    rows = open_.join(main, "at").select("at", "c", "n", "label", F.col("bands").alias("keys"), (F.col("label") != F.col("main")).alias("asks"), F.lit(True).alias("asked"))
    return found.unionByName(found_in(dealt(rows).join(texts, "c")))


def link_classes(classes: DataFrame, texts: DataFrame) -> DataFrame:
    """Links that connect what is linked among classes (c, k1, k2, n, bands), k1 and k2 the key of a row in texts (k1, k2, text)."""
    posts = classes.select("c", F.explode("bands").alias("key"))
    hubs = posts.groupBy("key").agg(F.min("c").alias("hub"), F.count("*").alias("k")).filter("k > 1").select("key", "hub")
    stars = posts.join(hubs, "key").filter("c <> hub").select(F.col("hub").alias("a"), F.col("c").alias("b"))
    pools = components(stars).withColumnsRenamed({"node": "c", "label": "at"})
    members = classes.join(pools, "c")
    weight = members.groupBy("at").agg((F.sum(F.col("n") + OVERHEAD) > BLOCK).alias("large"))
    members = cut(members.join(weight, "at").select("at", "large", "c", "n", "k1", "k2", "bands"))
    texts = texts.groupBy("k1", "k2").agg(F.first("text").alias("text"))  # repeated rows once, before they travel
    members = stage(texts.join(members, ["k1", "k2"]).drop("k1", "k2"))
    small = members.filter("NOT large").select("at", F.lit(0).alias("block"), F.lit(0).alias("side"), "c", F.col("c").alias("label"), F.col("bands").alias("keys"), "text")
    found, large = found_in(small), members.filter("large").select("at", "c", "n", "bands", "text")
    return found if large.isEmpty() else found.unionByName(links_of_large(large))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept), one row for each row of docs; kept where the id is its component's least.

    Null, empty and blank texts: n_shingles 0, linked with nothing, component_id their own id. Null ids take part, get the least
    id of their component, null if none has one, and are never kept. Repeated rows are copies like any other, and kept together. Very
    long texts take part whole. An empty table gives no rows. Other columns of docs are ignored.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), *row_key(id_col, text_col), F.col(text_col).alias("text"))
    sizes = stage(rows.select("doc_id", "k2", "text").mapInArrow(lean(sketched), "doc_id long, k2 long, n long, c1 long, c2 long, bands array<long>"))
    least = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "k2")).alias("m")
    classes = sizes.filter("n > 0").groupBy("c1", "c2").agg(F.max("n").alias("n"), least, F.first("bands").alias("bands"))
    classes = stage(classes.select(F.monotonically_increasing_id().alias("c"), "c1", "c2", "n", F.col("m.doc_id").alias("least"), F.coalesce("m.doc_id", F.lit(-1)).alias("k1"), F.col("m.k2").alias("k2"), "bands"))
    found = components(link_classes(classes.select("c", "k1", "k2", "n", "bands"), rows.select("k1", "k2", "text"))).withColumnRenamed("node", "c")
    owner = classes.select("c", "c1", "c2", "least").join(found, "c", "left").withColumn("label", F.coalesce("label", "c"))
    owner = cut(owner.join(owner.groupBy("label").agg(F.min("least").alias("component_id")), "label").select("c1", "c2", "component_id"))
    out = sizes.select("doc_id", "n", "c1", "c2").join(owner, ["c1", "c2"], "left")  # a table, so that the join can split the rows of a class of many copies
    component = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(False)).alias("kept"))


ORACLE = r"""
WITH RECURSIVE t AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS MATERIALIZED (
  SELECT DISTINCT doc_id, list_aggregate(w[i:i + k - 1], 'string_agg', ' ') AS g
  FROM (SELECT doc_id, w, least(3, len(w)) AS k, unnest(range(1, len(w) - least(3, len(w)) + 2)) AS i FROM t WHERE len(w) > 0)),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pairs AS MATERIALIZED (
  SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS i FROM s x JOIN s y USING (g) WHERE x.doc_id <> y.doc_id GROUP BY ALL)
  JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * i >= 85 * (p.n + q.n - i)),
r AS (SELECT doc_id AS d, doc_id AS c FROM t UNION SELECT r.d, pairs.b FROM r JOIN pairs ON pairs.a = r.c)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept
FROM t LEFT JOIN n USING (doc_id) JOIN (SELECT d AS doc_id, min(c) AS component_id FROM r GROUP BY d) USING (doc_id)
"""
