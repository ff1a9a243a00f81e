"""Merkle manifest of a dataset: a digest for each row, a tree for each group, one root, and a proof for each row.

1. Rows are digested where they are read; only digests travel. Leaves get their ranks from a range exchange: places within
   partitions, moved by the counts of the partitions before.
2. A tree is built a page of PAGE levels at a time: the digests of 2 ** PAGE consecutive nodes are one record, which holds the
   children of all nodes between them and the page's own digest. Records are kept by that digest, equal pages once. The digests
   of pages are the nodes of the next pass, so a hundred billion leaves take four.
3. Requests for leaves descend from the root: digits of the rank choose a child at each level, and those not chosen are
   collected. Requests for rows below one page are one request above it, so upper pages are asked little. A page is asked
   once for each distinct slot, however many rows share it.
4. The segments of a path, root first, are reversed into a proof, which folds back to the root.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, stage

#: Levels of a page: 1,024 digests and what lies above them, some 64 KB.
PAGE = 10
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
STEP = "array<struct<side int, kin binary>>"


class Tree(NamedTuple):
    """tops (g, tall, digest): the number of passes and the last digest of each group. pages: the records of each pass, (digest, levels)."""

    tops: DataFrame
    pages: list[DataFrame]


def hexed(digest: Column) -> Column:
    return F.lower(F.hex(digest))


def combined(text: Column) -> Column:
    """The digest of a string, binary."""
    return F.unhex(F.sha2(text.cast("binary"), 256))


def parent(left: Column, right: Column) -> Column:
    """The digest over one or two digests as hex; right may be null."""
    return combined(F.concat(hexed(left), F.coalesce(hexed(right), F.lit(""))))


def encoded(values: Sequence[Column]) -> Column:
    """Values one after another: `-` for null, else UTF-8 byte count, `:` and the value."""
    return F.concat(*[F.coalesce(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v), F.lit("-")) for v in (v.cast("string") for v in values)])


def group_key(value: Column) -> Column:
    """A value as a group's name: null has one of its own, and comes first."""
    return F.coalesce(F.concat(F.lit("="), value.cast("string")), F.lit("-"))


def bits(x: Column, by: Column) -> Column:
    return F.call_function("shiftright", x, by.cast("int"))


def ranked(rows: DataFrame, *order: str) -> DataFrame:
    """rows with i, their place from 0 within g by order, and n, the number of rows of g. Equal rows get places in any order.

    Only partitions are counted, and a window sees one row for each partition of a group, so no task holds a group.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = ["g", *order, "tie"]
    dealt = rows.withColumn("tie", F.xxhash64(F.monotonically_increasing_id()))
    placed = stage(dealt.repartitionByRange(parts, *keys).sortWithinPartitions(*keys).select(*rows.columns, F.monotonically_increasing_id().alias("at")))
    placed = placed.withColumn("part", F.shiftright("at", 33))
    counts = placed.groupBy("g", "part").agg(F.count("*").alias("k"), F.min("at").alias("least"))
    before = F.sum("k").over(Window.partitionBy("g").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    moved = counts.select("g", "part", (F.coalesce(before, F.lit(0)) - F.col("least")).alias("by"), F.sum("k").over(Window.partitionBy("g")).alias("n"))
    return placed.join(moved, ["g", "part"]).select(*rows.columns, (F.col("at") + F.col("by")).alias("i"), "n")


def level_above(level: Column) -> Column:
    last = F.floor((F.size(level) + 1) / 2).cast("int") - 1
    return F.transform(F.sequence(F.lit(0), last), lambda j: parent(F.get(level, 2 * j), F.get(level, 2 * j + 1)))


def page_records(nodes: DataFrame) -> DataFrame:
    """(g, i, n, digest, levels) of the pages over nodes (g, i, n, digest), n the number of nodes of g: full pages rise PAGE levels, also where a last node is alone; a group's only page rises until one node remains."""
    of = nodes.groupBy("g", F.shiftright("i", PAGE).alias("i"), "n").agg(F.array_sort(F.collect_list(F.struct("i", "digest"))).alias("leaves"))
    height = F.when(F.col("n") > 2**PAGE, F.lit(PAGE)).otherwise(F.length(F.bin(F.col("n") - 1)))
    levels = F.aggregate(F.sequence(F.lit(1), height), F.array(F.transform("leaves", lambda x: x["digest"])), lambda below, _: F.concat(below, F.array(level_above(F.element_at(below, -1)))))
    of = of.select("g", "i", F.ceil(F.col("n") / 2**PAGE).alias("n"), levels.alias("levels"))
    return of.withColumn("digest", F.element_at(F.element_at("levels", -1), 1))


def build(nodes: DataFrame) -> Tree:
    """The trees over nodes (g, i, n, digest), i from 0 to n - 1 in each g. A group of one node has that as its top and no page."""
    nodes = nodes.select("g", "i", "n", "digest")
    tops = nodes.filter("n = 1").select("g", F.lit(0).alias("tall"), "digest")
    pages = []
    while not (nodes := nodes.filter("n > 1")).isEmpty():
        made = stage(page_records(nodes))
        pages.append(made.select("digest", "levels"))
        nodes = made.select("g", "i", "n", "digest")
        tops = tops.unionByName(nodes.filter("n = 1").select("g", F.lit(len(pages)).alias("tall"), "digest"))
    return Tree(tops, pages)


def segment(levels: Column, slot: Column) -> Column:
    """The steps down a page to a slot: which child was chosen and the digest of the other one, null where there is none."""
    height = F.size(levels) - 1
    at = lambda k: bits(slot, k)
    return F.transform(F.sequence(height - 1, F.lit(0), F.lit(-1)), lambda k: F.struct(at(k).bitwiseAND(1).cast("int").alias("side"), F.get(F.get(levels, k), at(k).bitwiseXOR(F.lit(1)).cast("int")).alias("kin")))


def descend(tops: DataFrame, pages: list[DataFrame], requests: DataFrame) -> DataFrame:
    """requests (g, i, others) with base, the group's top digest, digest, that of leaf i, and path, the steps to it, root first.

    tops (g, tall, digest, path): path are the steps that lead to a group's top. Requests beyond a group's leaves give no row.
    """
    base = F.col("digest").alias("base")
    alone = requests.join(tops.filter("tall = 0").select("g", "digest", "path", base), "g").filter("i = 0")
    found, out = None, alone.select(*requests.columns, "base", "digest", "path")
    for s in reversed(range(len(pages))):
        asking = requests if s == 0 else requests.select("g", F.shiftright("i", PAGE * s).alias("i")).distinct()
        start = tops.filter(F.col("tall") == s + 1).select("g", F.lit(0).cast("long").alias("up"), "digest", "path", base)
        if found is not None:
            start = start.unionByName(found.withColumnRenamed("i", "up"))
        rows = asking.withColumns({"up": F.shiftright("i", PAGE), "slot": F.col("i").bitwiseAND(2**PAGE - 1)}).join(start, ["g", "up"])
        asked = rows.groupBy("digest").agg(F.collect_set("slot").alias("slots"))  # a page has 2 ** PAGE slots at most
        step = F.transform("slots", lambda slot: F.struct(slot.alias("slot"), F.get(F.get("levels", F.lit(0)), slot.cast("int")).alias("next"), segment(F.col("levels"), slot).alias("steps")))
        told = asked.join(pages[s].dropDuplicates(["digest"]), "digest").select("digest", F.explode(step).alias("t")).select("digest", "t.slot", "t.next", "t.steps")
        found = rows.join(told, ["digest", "slot"]).filter("next IS NOT NULL").select(*asking.columns, "base", F.col("next").alias("digest"), F.concat("path", "steps").alias("path"))
        if s:
            found = cut(found)
    return out if found is None else out.unionByName(found)


def fold(leaf: Column, proof: Column) -> Column:
    """The root that a leaf and its proof, steps leaf first, lead to."""
    return F.aggregate(proof, leaf, lambda node, s: F.when(s["side"] == 1, parent(s["kin"], node)).otherwise(parent(node, s["kin"])))


def proof_hash(proof: Column) -> Column:
    """Hex digest over the siblings of a proof as hex, leaf first."""
    return F.sha2(F.concat_ws("", F.transform(proof, lambda s: hexed(s["kin"]))).cast("binary"), 256)


def manifest(leaves: DataFrame) -> tuple[DataFrame, str | None]:
    """leaves (g, name, leaf, others), a tree for each g with leaves by name, and the groups' tops by g under one root.

    Returns leaves without leaf, with i, n, base (the group's top), digest (the leaf's, as the descent from the root finds it) and
    proof (steps, leaf first), and the root's digest as hex, None without leaves.
    """
    placed = ranked(leaves, "name", "leaf")
    tree = build(placed.withColumnRenamed("leaf", "digest"))
    groups = ranked(tree.tops.withColumnsRenamed({"g": "of"}).withColumn("g", F.lit("")), "of")
    above = build(groups)
    root = above.tops.select(hexed(F.col("digest"))).first()
    empty = F.array().cast(STEP).alias("path")
    starts = descend(above.tops.select("g", "tall", "digest", empty), above.pages, groups.select("g", "i", "of", F.col("tall").alias("passes")))
    tops = cut(starts.select(F.col("of").alias("g"), F.col("passes").alias("tall"), "digest", "path"))
    found = descend(tops, tree.pages, placed.drop("leaf"))
    return found.withColumn("proof", F.reverse("path")).drop("path"), root and root[0]


def tampered() -> Column:
    """Rows whose n_chars is tampered with: 7 divides the crc32 of the id as text; null ids and null n_chars are left alone."""
    return (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0) & F.col("n_chars").isNotNull()


def verified_rows(docs: DataFrame) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified), one row for each row of docs.

    Null values have an encoding of their own, null languages a tree of their own, which is the first; null ids are the first
    leaves of their tree and are not tampered with. Rows of one id follow each other by digest; equal rows are leaves each, with
    a proof each. Empty texts are values like others; very long ones are digested whole where they are read. A table without
    rows gives none. Other columns, whatever their names, are ignored.
    """
    docs = docs.select(*FIELDS)
    more = (F.col("n_chars").cast("decimal(20)") + 1).cast("decimal(20)")
    leaf = lambda n: combined(encoded([F.col(c) if c != "n_chars" else n for c in FIELDS]))
    leaves = stage(docs.select(group_key(F.col("lang")).alias("g"), F.col("doc_id").alias("name"), leaf(F.col("n_chars")).alias("leaf"), F.when(tampered(), leaf(more)).alias("bent")))
    found, root = manifest(leaves)
    folded = hexed(fold(F.coalesce("bent", "digest"), F.col("proof")))
    out = found.select(F.col("name").alias("doc_id"), hexed(F.col("digest")).alias("leaf"), hexed(F.col("base")).alias("subroot"), F.lit(root).cast("string").alias("root"), proof_hash(F.col("proof")).alias("proof_sha256"), folded.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


ORACLE = r"""
WITH RECURSIVE
crc_table AS (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda c, z: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
d AS MATERIALIZED (
  SELECT doc_id, lang, n_chars, coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') AS a,
    coalesce(strlen(text) || ':' || text, '-') AS z,
    xor(list_reduce(list_prepend(4294967295, list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)), lambda c, b: xor(c >> 8, t[((xor(c, b)) & 255) + 1])), 4294967295) % 7 = 0 AS bent
  FROM documents, crc_table),
l AS MATERIALIZED (
  SELECT doc_id, lang, sha256(a || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') || z) AS leaf,
    CASE WHEN bent AND n_chars IS NOT NULL THEN sha256(a || strlen((n_chars + 1)::VARCHAR) || ':' || (n_chars + 1) || z) END AS other,
    row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST) - 1 AS r
  FROM d),
v AS (
  SELECT lang, 0 AS k, r AS i, leaf AS h FROM l
  UNION ALL
  SELECT lang, k + 1, i // 2, sha256(h || coalesce(nxt, '')) FROM (SELECT *, lead(h) OVER (PARTITION BY lang ORDER BY i) AS nxt, count(*) OVER (PARTITION BY lang) AS c FROM v) WHERE c > 1 AND i % 2 = 0),
n AS MATERIALIZED (SELECT * FROM v),
tops AS MATERIALIZED (SELECT lang, max(k) AS tall, arg_max(h, k) AS h, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS r FROM n GROUP BY lang),
w AS (
  SELECT 0 AS k, r AS i, h FROM tops
  UNION ALL
  SELECT k + 1, i // 2, sha256(h || coalesce(nxt, '')) FROM (SELECT *, lead(h) OVER (ORDER BY i) AS nxt, count(*) OVER () AS c FROM w) WHERE c > 1 AND i % 2 = 0),
m AS MATERIALIZED (SELECT * FROM w),
root AS (SELECT max(k) AS tall, arg_max(h, k) AS h FROM m),
steps AS MATERIALIZED (
  SELECT l.lang, l.r, ks.k, CASE WHEN (l.r >> ks.k) % 2 = 1 THEN 'l' ELSE 'r' END AS side, n.h
  FROM l JOIN tops ON tops.lang IS NOT DISTINCT FROM l.lang, range(0, 64) ks(k) LEFT JOIN n ON n.lang IS NOT DISTINCT FROM l.lang AND n.k = ks.k AND n.i = xor(l.r >> ks.k, 1) WHERE ks.k < tops.tall
  UNION ALL
  SELECT l.lang, l.r, 1000 + ks.k, CASE WHEN (tops.r >> ks.k) % 2 = 1 THEN 'l' ELSE 'r' END, m.h
  FROM l JOIN tops ON tops.lang IS NOT DISTINCT FROM l.lang, root, range(0, 64) ks(k) LEFT JOIN m ON m.k = ks.k AND m.i = xor(tops.r >> ks.k, 1) WHERE ks.k < root.tall),
p AS (SELECT lang, r, string_agg(h, '' ORDER BY k) AS proof, list(side || coalesce(h, '') ORDER BY k) AS path FROM steps GROUP BY lang, r)
SELECT doc_id, leaf, tops.h AS subroot, root.h AS root, sha256(coalesce(proof, '')) AS proof_sha256, folded AS folded_root, folded = root.h AS verified
FROM (SELECT l.*, proof, list_reduce(list_prepend(coalesce(other, leaf), coalesce(path, [])), lambda a, x: sha256(CASE WHEN x[1] = 'l' THEN x[2:] || a ELSE a || x[2:] END)) AS folded FROM l LEFT JOIN p ON p.lang IS NOT DISTINCT FROM l.lang AND p.r = l.r) l
JOIN tops ON tops.lang IS NOT DISTINCT FROM l.lang, root
"""
