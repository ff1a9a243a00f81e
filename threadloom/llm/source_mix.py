"""Mixing sources to target weights: hash-threshold histograms, DataFrame functions only.

Every document has a fixed 30-bit hash of its id. A source that needs r.f times its words takes all of its documents r
times, and once more those whose hash lies under a threshold. The threshold is found top-down: words are summed by source
and the leading bits of the hash, the bucket in which the budget ends is the only one refined by the next bits, and what
is left is one pass that compares hashes. No document is sorted and no source meets in one task: sums are combined
map-side, and thresholds are one row a source.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

BITS, LEVELS = 10, 3
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def id_hash(ident: Column) -> Column:
    """30 bits of the MD5 of the id as text, null as the empty text; equal ids stay together."""
    digest = F.md5(F.coalesce(ident.cast("string"), F.lit("")).cast("binary"))
    return F.shiftright(F.conv(F.substring(digest, 1, 8), 16, 10).cast("long"), 32 - BITS * LEVELS)


def source_targets(sizes: DataFrame, weights: Sequence[int] = (5, 2, 1), cap: int = 3) -> DataFrame:
    """One row a source: source_size, target, whole (full repeats) and rest (words beyond them).

    Sources in code point order, null last, take the weights in turn and share all words; a target stops at cap times the
    source, the excess going to the others by weight. That fixed point is a water level: sources sorted by cap * size /
    weight are full as long as the level that the others would get lies above them.
    """
    s = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    nth = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    s = s.withColumn("w", F.element_at(F.array(*[F.lit(int(w)) for w in weights]), (nth - 1) % len(weights) + 1).cast("long"))
    s = s.withColumn("full", F.col("source_size") * cap)
    before = Window.orderBy(F.col("full") / F.col("w"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    left = F.sum("source_size").over(whole) - F.coalesce(F.sum("full").over(before), F.lit(0))
    others = F.sum("w").over(whole) - F.coalesce(F.sum("w").over(before), F.lit(0))
    s = s.withColumn("capped", left * F.col("w") > F.col("full") * others)
    level = (F.sum("source_size").over(whole) - F.sum(F.when(F.col("capped"), F.col("full")).otherwise(0)).over(whole)) / F.sum(F.when(F.col("capped"), 0).otherwise(F.col("w"))).over(whole)
    s = s.withColumn("target", F.when(F.col("capped"), F.col("full").cast("double")).otherwise(level * F.col("w")))
    repeats = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    s = s.withColumn("whole", repeats)
    return s.select("source", "source_size", "target", "whole", (F.col("target") - F.col("whole") * F.col("source_size")).alias("rest"))


def thresholds(sized: DataFrame, weights: Sequence[int] = (5, 2, 1), cap: int = 3) -> DataFrame:
    """source_targets() of (source, size, h), with the hash prefix at which the rest ends, and the words before and up to it."""
    plan = cut(source_targets(sized, weights, cap).withColumns({"prefix": F.lit(0).cast("long"), "spent": F.lit(0).cast("long")}))
    for level in range(LEVELS):
        shift = BITS * (LEVELS - 1 - level)
        at = plan.select(F.col("source").alias("s"), "prefix", "spent", "rest")
        inside = sized.join(at, F.col("source").eqNullSafe(F.col("s")) & (F.shiftright("h", shift + BITS) == F.col("prefix")))
        words = inside.groupBy("s", "rest", "spent", F.shiftright("h", shift).alias("bucket")).agg(F.sum("size").alias("words"))
        upto = F.col("spent") + F.sum("words").over(Window.partitionBy("s").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0))
        cutting = words.withColumn("upto", upto).filter("upto > rest").groupBy("s").agg(F.min(F.struct("bucket", "upto", "words")).alias("b"))
        ends = plan.drop("prefix", "spent", "upto").join(cutting, F.col("source").eqNullSafe(F.col("s")), "left")
        plan = cut(ends.select("source", "source_size", "target", "whole", "rest", F.col("b.bucket").alias("prefix"), (F.col("b.upto") - F.col("b.words")).alias("spent"), F.col("b.upto").alias("upto")))
    return plan


def copies_of(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """rows (row, source, size, h) with their source's plan and copies, how often the mix takes each."""
    out = rows.join(plan.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")))
    nearer = (F.col("h") == F.col("prefix")) & (F.col("upto") - F.col("rest") < F.col("rest") - F.col("spent"))
    return out.withColumn("copies", F.col("whole") + F.coalesce((F.col("h") < F.col("prefix")) | nearer, F.lit(False)).cast("long"))


def _sized(docs: DataFrame, keep: list[str]) -> DataFrame:
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"), F.col("source"), word_count(F.col("text")).alias("size"), id_hash(F.col("doc_id")).alias("h"))


def mix_sources(docs: DataFrame, weights: Sequence[int] = (5, 2, 1), cap: int = 3) -> DataFrame:
    """(doc_id, size, source_size, target, taken, copies): how often, and so how many words of, each document the mix takes.

    Null text or no words: size 0, taken 0, copies as for its source. Null source: a source of its own, last in order.
    Null ids and repeated ids share a hash and are taken together. An empty table gives an empty result. Other columns of
    docs are ignored, whatever their names. Within half of the words that share its last 30-bit hash, a source's taken
    words equal its target; the same rows give the same mix, in any order and partitioning.
    """
    sized = cut(_sized(docs, ["doc_id"]))
    out = copies_of(sized, thresholds(sized.drop("row"), weights, cap))
    return out.select("row.doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies")


def mixed(docs: DataFrame, weights: Sequence[int] = (5, 2, 1), cap: int = 3) -> DataFrame:
    """The rows of docs of which the mix takes words, with copies, how often it takes them, and taken, the words so taken.

    Columns of docs of those two names are replaced; see mix_sources() for the rest.
    """
    sized = cut(_sized(docs, ["doc_id"]).drop("row"))
    out = copies_of(_sized(docs, docs.columns), thresholds(sized, weights, cap)).withColumn("taken", F.col("size") * F.col("copies")).filter("taken > 0")
    return out.select(*[F.col(f"row.`{c}`") for c in docs.columns if c not in ("copies", "taken")], "copies", "taken")


ORACLE = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT >> 2 AS h
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w FROM s),
o AS (
  SELECT *, 3 * source_size AS top, sum(source_size) OVER () AS total, sum(w) OVER () AS weights,
         coalesce(sum(3 * source_size) OVER b, 0) AS top_before, coalesce(sum(w) OVER b, 0) AS w_before
  FROM w WINDOW b AS (ORDER BY 3 * source_size / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
c AS (SELECT *, (total - top_before) * w > top * (weights - w_before) AS capped FROM o),
l AS (
  SELECT *, (total - sum(CASE WHEN capped THEN top ELSE 0 END) OVER ())::DOUBLE / (sum(CASE WHEN capped THEN 0 ELSE w END) OVER ())::DOUBLE AS level
  FROM c),
t AS (SELECT source, source_size, CASE WHEN capped THEN top::DOUBLE ELSE level * w END AS target FROM l),
p AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS whole FROM t),
r AS (SELECT *, target - whole * source_size AS rest FROM p),
u AS (
  SELECT d.*, source_size, target, whole, rest,
         sum(size) OVER (PARTITION BY d.source ORDER BY h RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto,
         sum(size) OVER (PARTITION BY d.source, h) AS own
  FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source),
e AS (SELECT *, upto <= rest OR (upto - own <= rest AND upto - rest < rest - (upto - own)) AS more FROM u)
SELECT doc_id, size, source_size, target, (size * (whole + more::INT))::BIGINT AS taken, whole + more::INT AS copies FROM e
"""
