"""Benchmark decontamination by winnowing, DataFrame functions only.

Both sides hash every run of K words and keep the least hash of each T = WINDOW - K + 1 consecutive runs, so two texts that
share WINDOW words in a row keep at least one hash in common. Texts with a kept hash of the benchmark are looked at again:
only their windows around such a hash are spelled out and joined, as text, with the benchmark's windows, which extends
hits to whole spans and discards hash collisions. Items shorter than WINDOW words are one window each; they are found by
the hashes of runs of just their lengths.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, cut, let, row_key

WINDOW, K = 13, 5
BETWEEN_WORDS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """Runs of ASCII digits and letters (A-Z lower-cased) and characters beyond ASCII; null has none."""
    return F.filter(F.split(ascii_lower(F.coalesce(text, F.lit(""))), BETWEEN_WORDS), lambda w: w != "")


def starts(n: Column, length) -> Column:
    """1-based starts of runs of length words among n; none if n is less."""
    length = F.lit(length) if isinstance(length, int) else length
    return F.when(n >= length, F.sequence(F.lit(1), n - length + 1)).otherwise(F.array().cast("array<int>"))


def run_hashes(w: Column, length) -> Column:
    return F.transform(starts(F.size(w), length), lambda i: F.xxhash64(F.slice(w, i, length)))


def kept_hashes(hashes: Column) -> Column:
    """Distinct least hashes of every WINDOW - K + 1 consecutive ones."""
    t = WINDOW - K + 1
    return F.array_distinct(F.transform(starts(F.size(hashes), t), lambda i: F.array_min(F.slice(hashes, i, t))))


def benchmark_windows(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(window, length, items): distinct windows as space-joined text, with the ids, as strings, of the items that hold them."""
    w = benchmark.select(F.col(id_col).cast("string").alias("item"), words(F.col(text_col)).alias("w")).filter(F.size("w") > 0)
    w = w.withColumn("length", F.least(F.size("w"), F.lit(WINDOW)))
    w = w.select("item", "length", F.explode(F.transform(starts(F.size("w"), F.col("length")), lambda i: F.array_join(F.slice("w", i, F.col("length")), " "))).alias("window"))
    return w.groupBy("window", "length").agg(F.array_sort(F.collect_set("item")).alias("items"))


def judged(docs: DataFrame, benchmark: DataFrame, keep: list[str], share: int = 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(row, n_words, n_hit, items, contaminated), one row for each row of docs: row a struct of its columns keep.

    A word is hit if it lies inside any occurrence of a window of the benchmark; contaminated: n_hit > 0 and share * n_hit
    >= n_words. Null and wordless texts have no words and no hits; null and wordless items have no windows; an item with a
    null id counts as a window without an id. Repeated rows get equal results. Empty tables: no rows, or no hits.
    """
    docs = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"), F.col(id_col).alias("id"), F.col(text_col).alias("text")).select("row", *row_key("id"), "text")
    windows = cut(benchmark_windows(benchmark))
    lengths = sorted(r[0] for r in windows.select("length").distinct().collect())  # WINDOW of them at most
    long_hashes = windows.filter(F.col("length") == WINDOW).select(F.explode(let(F.split("window", " "), lambda w: kept_hashes(run_hashes(w, K)))).alias("hash"), F.lit(K).alias("length")).distinct()
    short_hashes = windows.filter(F.col("length") < WINDOW).select(F.explode(run_hashes(F.split("window", " "), F.col("length"))).alias("hash"), "length").distinct()

    tokenised = docs.select("k1", "k2", words(F.col("text")).alias("w"))
    found = docs.select("k1", "k2", F.lit(WINDOW).alias("n"), F.array().cast("array<bigint>").alias("hashes")).limit(0)

    def hashes_of(n: int):
        if n == WINDOW:
            return lambda w: let(run_hashes(w, K), kept_hashes)
        return lambda w: F.array_distinct(run_hashes(w, n))

    for n in lengths:
        side = long_hashes if n == WINDOW else short_hashes.filter(F.col("length") == n)
        own = tokenised.select("k1", "k2", F.explode(let(F.col("w"), hashes_of(n))).alias("hash")).join(side.select("hash"), "hash", "left_semi")
        found = found.unionByName(own.groupBy("k1", "k2").agg(F.collect_set("hash").alias("hashes")).withColumn("n", F.lit(n)))

    def occurrences(w: Column) -> Column:
        """Structs (s, n, window) of the windows next to a kept hash of the benchmark, or at one for short items."""

        def near(hashes: Column) -> Column:
            at = F.filter(F.transform(hashes, lambda h, i: F.when(F.array_contains("hashes", h), i + 1)), lambda p: p.isNotNull())
            around = lambda p: F.when(F.col("n") == WINDOW, F.sequence(F.greatest(F.lit(1), p - (WINDOW - K)), F.least(p, F.size(w) - WINDOW + 1))).otherwise(F.array(p))
            return F.array_distinct(F.flatten(F.transform(at, around)))

        run = F.when(F.col("n") == WINDOW, F.lit(K)).otherwise(F.col("n"))
        return F.transform(let(run_hashes(w, run), near), lambda s: F.struct(s.alias("s"), (s + F.col("n")).alias("e"), F.array_join(F.slice(w, s, F.col("n")), " ").alias("window")))

    near = docs.select("k1", "k2", "text").join(found, ["k1", "k2"]).select("k1", "k2", F.explode(let(words(F.col("text")), occurrences)).alias("o")).select("k1", "k2", "o.*")
    hits = near.join(windows.select("window", "items"), "window")
    hits = hits.groupBy("k1", "k2").agg(F.array_sort(F.collect_set(F.struct("s", "e"))).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))
    covered = F.aggregate("spans", F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n")), lambda a, x: F.struct(F.greatest(a["end"], x["e"]).alias("end"), (a["n"] + F.greatest(F.lit(0), x["e"] - F.greatest(a["end"], x["s"]))).alias("n")))
    hits = hits.select("k1", "k2", covered["n"].alias("n_hit"), "items")
    out = docs.select("row", "k1", "k2", F.size(words(F.col("text"))).cast("long").alias("n_words")).join(hits, ["k1", "k2"], "left")
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    return out.select("row", "n_words", n_hit.alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"), ((n_hit > 0) & (share * n_hit >= F.col("n_words"))).alias("contaminated"))


def contamination(docs: DataFrame, benchmark: DataFrame, share: int = 20) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated) for each row of docs; see judged()."""
    out = judged(docs, benchmark, ["doc_id"], share)
    return out.select("row.doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), "contaminated")


def uncontaminated(docs: DataFrame, benchmark: DataFrame, share: int = 20) -> DataFrame:
    """The rows of docs that are not contaminated, all columns; see judged()."""
    return judged(docs, benchmark, docs.columns, share).filter("NOT contaminated").select(*[F.col(f"row.`{c}`") for c in docs.columns])


ORACLE = r"""
WITH t AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
b AS (
  SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
bw AS (
  SELECT DISTINCT item_id, n, list_aggregate(w[i:i + n - 1], 'string_agg', ' ') AS g
  FROM (SELECT item_id, w, least(len(w), 13) AS n, unnest(range(1, len(w) - least(len(w), 13) + 2)) AS i FROM b WHERE len(w) > 0)),
ns AS (SELECT DISTINCT n FROM bw),
dw AS (
  SELECT doc_id, n, i, list_aggregate(w[i:i + n - 1], 'string_agg', ' ') AS g
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM t, ns WHERE len(w) >= n)),
hit AS (SELECT doc_id, i, dw.n, item_id FROM dw JOIN bw USING (g)),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hit) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM t LEFT JOIN pos USING (doc_id) LEFT JOIN its USING (doc_id)
"""
