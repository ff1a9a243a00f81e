"""Spelling variants: words that are one edit apart, found through a reduced alphabet, and followed to their commonest form.

1. Words are counted over all texts, with map-side sums; from here on only the vocabulary is handled.
2. Letters are hashed to SYMBOLS symbols. Words one edit apart have reduced words that are equal or one edit apart. One-edit
   neighbourhoods of reduced words are generated whole, each edit at one of its two ends: deletions at the longer word, which
   are the insertions of the shorter one, and replacements at the word with the lesser symbol. Neighbours are known by the
   polynomial hash of their symbols, each made from the hash of the word in a few operations, so a very long word costs its
   length, not its square; what a hash confuses is sorted out in the last step.
3. Neighbours are joined with the reduced vocabulary. Rows carry ids and a mask of the letters that a word has an odd number of
   times, in which one edit changes two bits at most; what passes that is verified on the words themselves.
4. A form has at least twice the count of its word, so forms make trees; pointers are doubled until they end at roots.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import poly_hash
from .common import ascii_lower, cut, lean, stage

RUN = r"[A-Za-zÀ-ÿ]+"
#: Symbols of the reduced alphabet. Eight letters make 16 million reduced words.
SYMBOLS = 8
LEAST_LETTERS, LEAST_COUNT = 5, 3
#: One run in NOISE loses a letter.
NOISE = 97
#: Neighbours of a batch, at about most.
BATCH = 1 << 16
U = np.uint64
MARKS = poly_hash.values(11)[:SYMBOLS]


def symbols(word: str) -> np.ndarray:
    """The symbol of each letter."""
    return (poly_hash.mix(np.frombuffer(word.encode("utf-32-le"), np.uint32).astype(U) + U(1)) % U(SYMBOLS)).astype(np.int64)


def letter_mask(word: str) -> int:
    """A bit for each of 64 hashes of letters, set where its letters occur an odd number of times."""
    letters = poly_hash.mix(np.frombuffer(word.encode("utf-32-le"), np.uint32).astype(U) + U(99)) % U(64)
    return int(np.bitwise_xor.reduce(U(1) << letters).view(np.int64))


def reduced(s: np.ndarray) -> np.ndarray:
    """The hash of a reduced word, as an array of one."""
    return poly_hash.prefixes(MARKS[s])[-1:]


def neighbours(s: np.ndarray, step: int = BATCH // SYMBOLS) -> Iterator[np.ndarray]:
    """Hashes of a reduced word, of it with each symbol deleted and with each symbol replaced by greater ones, step positions at a time, distinct within each."""
    own, before = MARKS[s], poly_hash.prefixes(MARKS[s])
    whole, power, back = before[-1], poly_hash.powers(len(s)), poly_hash.powers(2, "down")[1]
    for a in range(0, len(s), step):
        i = np.arange(a, min(a + step, len(s)))
        deleted = before[i] + (whole - before[i + 1]) * back
        at, to = np.nonzero(np.arange(SYMBOLS) > s[i][:, None])
        replaced = whole + (MARKS[to] - own[i][at]) * power[i][at]
        yield np.unique(np.concatenate([before[-1:], deleted, replaced]))


def neighbour_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, word) to (id, mask, key), one row for each neighbour."""
    ids, masks, keys, n = [], [], [], 0

    def flush() -> pa.RecordBatch:
        spread = [np.repeat(np.array(x, np.int64), [len(k) for k in keys]) for x in (ids, masks)]
        return pa.RecordBatch.from_arrays([pa.array(spread[0]), pa.array(spread[1]), pa.array(np.concatenate(keys).view(np.int64))], ["id", "mask", "key"])

    for b in batches:
        for i, word in zip(b.column(0).to_pylist(), b.column(1), strict=True):
            mask = letter_mask(word.as_py())
            for found in neighbours(symbols(word.as_py())):
                ids.append(i)
                masks.append(mask)
                keys.append(found)
                n += len(found)
                if n >= BATCH:
                    yield flush()
                    ids, masks, keys, n = [], [], [], 0
    if n:
        yield flush()


def reduced_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, word) to (other, other_mask, key): the reduced vocabulary."""
    for b in batches:
        words = b.column(1).to_pylist()
        keys = np.concatenate([reduced(symbols(w)) for w in words]).view(np.int64) if words else []
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array([letter_mask(w) for w in words], pa.int64()), pa.array(keys, pa.int64())], ["other", "other_mask", "key"])


def noisy(run: Column, doc_id: Column) -> Column:
    """A run that loses its code point h % length where NOISE divides h, the crc32 of `<doc_id>:<run>`; a null id counts as empty."""
    h = F.crc32(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), run).cast("binary"))
    at = (h % F.length(run)).cast("int")
    return F.when(h % NOISE == 0, F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.length(run)))).otherwise(run)


def vocabulary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, word, n): the words of LEAST_LETTERS code points and LEAST_COUNT occurrences or more, written once."""
    runs = docs.select(F.col(id_col).alias("doc_id"), F.explode(F.regexp_extract_all(ascii_lower(F.col(text_col)), F.lit(RUN), F.lit(0))).alias("run"))
    counts = runs.select(noisy(F.col("run"), F.col("doc_id")).alias("word")).filter(F.length("word") >= LEAST_LETTERS).groupBy("word").agg(F.count("*").alias("n"))
    return stage(counts.filter(F.col("n") >= LEAST_COUNT).select(F.monotonically_increasing_id().alias("id"), "word", "n"))


def near_words(words: DataFrame) -> DataFrame:
    """(word, n, near, near_n) of the ordered pairs of words (id, word, n) that differ by exactly one edit."""
    lists = words.select("id", "word")
    keys = lists.mapInArrow(lean(neighbour_rows), "id long, mask long, key long")
    pairs = keys.join(lists.mapInArrow(lean(reduced_rows), "other long, other_mask long, key long"), "key")
    pairs = pairs.filter("id <> other AND bit_count(mask ^ other_mask) <= 2").select("id", "other")
    pairs = pairs.join(words, "id").join(words.toDF("other", "near", "near_n"), "other").select("word", "n", "near", "near_n")
    pairs = pairs.filter((F.abs(F.length("word") - F.length("near")) <= 1) & (F.levenshtein("word", "near", 1) == 1))
    ends = F.array(F.struct("word", "n", "near", "near_n"), F.struct(F.col("near").alias("word"), F.col("near_n").alias("n"), F.col("word").alias("near"), F.col("n").alias("near_n")))
    return pairs.select(F.explode(ends).alias("p")).select("p.*").dropDuplicates(["word", "near"])


def roots(up: DataFrame) -> DataFrame:
    """(word, root) of (word, form): the last word that forms lead to. Pointers double, so a chain is followed in a logarithm of its length."""
    up = cut(up.select("word", F.col("form").alias("root")))
    while True:
        on = up.select(F.col("word").alias("root"), F.col("root").alias("further"))
        moved = cut(up.join(on, "root", "left"))
        up = moved.select("word", F.coalesce("further", "root").alias("root"))
        if moved.filter("further IS NOT NULL").isEmpty():
            return up


def variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, form, root, n, n_near, form_n), one row for each word of the vocabulary.

    form: the near word of largest n, the first in code-point order among several, if that n is twice the word's or more; root:
    where forms end. Null, empty and blank texts have no words, null ids count as empty in the noise, repeated rows count again,
    very long texts and words are taken whole. Without words there are no rows. Other columns of docs are ignored.
    """
    words = vocabulary(docs, id_col, text_col)
    best = F.min(F.struct((-F.col("near_n")).alias("minus"), "near")).alias("best")
    near = near_words(words).groupBy("word", "n").agg(F.count("*").alias("n_near"), best)
    fits = -F.col("best.minus") >= 2 * F.col("n")
    near = cut(near.select("word", "n_near", F.when(fits, F.col("best.near")).alias("form"), F.when(fits, -F.col("best.minus")).alias("form_n")))
    ends = roots(near.filter("form IS NOT NULL"))
    out = words.select("word", "n").join(near, "word", "left").join(ends, "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form_n")


ORACLE = r"""
WITH RECURSIVE
crc_table AS (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda c, z: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
r AS (
  SELECT coalesce(doc_id::VARCHAR, '') AS d, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\x{C0}-\x{FF}]+')) AS w FROM documents),
h AS (  -- a letter beyond ASCII is two bytes, 192 + code // 64 and 128 + code % 64
  SELECT w, xor(list_reduce(list_prepend(4294967295, flatten(list_transform(string_split(d || ':' || w, ''), lambda x: CASE WHEN unicode(x) < 128 THEN [unicode(x)::BIGINT] ELSE [192 + unicode(x) // 64, 128 + unicode(x) % 64]::BIGINT[] END))),
    lambda c, b: xor(c >> 8, t[((xor(c, b)) & 255) + 1])), 4294967295) AS h FROM r, crc_table),
k AS (SELECT CASE WHEN h % 97 = 0 THEN w[:h % length(w)] || w[h % length(w) + 2:] ELSE w END AS word FROM h),
v AS MATERIALIZED (SELECT word, count(*) AS n FROM k WHERE length(word) >= 5 GROUP BY word HAVING count(*) >= 3),
c AS MATERIALIZED (SELECT word, i, word[:i - 1] || word[i + 1:] AS rest FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM v)),
p AS MATERIALIZED (
  SELECT a.word, b.word AS near FROM c a JOIN c b ON a.i = b.i AND a.rest = b.rest WHERE a.word <> b.word
  UNION SELECT c.word, v.word FROM c JOIN v ON v.word = c.rest
  UNION SELECT v.word, c.word FROM c JOIN v ON v.word = c.rest),
g AS MATERIALIZED (
  SELECT p.word, any_value(x.n) AS n, count(*) AS n_near, min({'m': -y.n, 'w': p.near}) AS best
  FROM p JOIN v x ON x.word = p.word JOIN v y ON y.word = p.near GROUP BY p.word),
f AS MATERIALIZED (SELECT word, n_near, CASE WHEN -best.m >= 2 * n THEN best.w END AS form, CASE WHEN -best.m >= 2 * n THEN -best.m END AS form_n FROM g),
up AS (SELECT word, word AS root FROM v UNION ALL SELECT up.word, f.form FROM up JOIN f ON f.word = up.root WHERE f.form IS NOT NULL)
SELECT v.word, form, up.root, n, coalesce(n_near, 0)::BIGINT AS n_near, form_n::BIGINT AS form_n
FROM v LEFT JOIN f USING (word) JOIN up ON up.word = v.word
WHERE up.root NOT IN (SELECT word FROM f WHERE form IS NOT NULL)
"""
