"""URL filters: a sort-merge range join of urls and nested prefix rules.

A rule (host, path) fits its host and all subdomains where the path starts with the rule's. A url has one canonical key for
each suffix of its host that a rule could name: the labels reversed, a slash, the path. A rule's key has the same form, so
the urls it fits at one depth are the keys that start with it, an interval of the sorted keys, and two such intervals are
nested or apart. Keys are dealt into ranges by sampled split points; a rule goes to each range that its interval meets;
each range is swept in order with a stack of the rules still open.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, cut

#: Keys drawn, and characters kept of each, to choose the ranges; they shape the work, not the result.
SAMPLE, SPLIT_CHARS = 4096, 200


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.locate("://", F.coalesce(url, F.lit("")))
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    return ascii_lower(F.regexp_extract(rest, r"^([^/?#]*)", 1)), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def sweep(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows sorted by bucket, key and kind (0 a rule, 1 a url key): gives each url key the longest rule open there."""
    bucket, open_rules = None, []
    for batch in rows:
        out = []
        for b, key, kind, host, path, rule_host, rule_path, verdict in batch.itertuples(index=False, name=None):
            if b != bucket:
                bucket, open_rules = b, []
            while open_rules and not key.startswith(open_rules[-1][0]):
                open_rules.pop()
            if kind == 0:
                open_rules.append((key, rule_host, rule_path, verdict))
            elif open_rules:
                out.append((host, path, *open_rules[-1][1:]))
        yield pd.DataFrame(out, columns=["host", "path", "rule_host", "rule_path", "verdict"])


def judge_urls(pages: DataFrame, rules: DataFrame, default: str = "allow", id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(page_id, host, path, rule, verdict), one row for each row of pages.

    rules: host, path, verdict. The longest fitting rule (host and path together, then the longer host) decides; of equal
    rules with other verdicts the greater text, block before allow, holds. rule is host plus path, null where none fits;
    the verdict is then default. Null urls and urls without :// have empty host and path. Rules with a null host or path
    fit nothing. An empty table of pages or of rules gives no rows, or the default throughout. Other columns are ignored.
    """
    spark = pages.sparkSession
    host, path = host_and_path(F.col("url"))
    urls = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url")).select("page_id", host.alias("host"), path.alias("path"))
    labels = lambda c: F.split(c, r"\.")
    back = lambda parts: F.array_join(F.reverse(parts), ".")
    rules = rules.filter("host IS NOT NULL AND path IS NOT NULL").groupBy("host", "path").agg(F.max("verdict").alias("verdict"))
    rules = cut(rules.select(F.concat(back(labels(F.col("host"))), F.lit("/"), F.col("path")).alias("key"), "host", "path", "verdict", F.size(labels(F.col("host"))).alias("depth")))
    deepest = rules.agg(F.max("depth")).first()[0] or 0
    distinct = urls.groupBy("host", "path").agg(F.lit(1).alias("kind"))
    parts = labels(F.col("host"))
    depths = F.sequence(F.lit(1), F.least(F.size(parts), F.lit(max(1, deepest))))
    keys = distinct.select("host", "path", "kind", F.explode(F.transform(depths, lambda j: F.concat(back(F.slice(parts, -j, j)), F.lit("/"), F.col("path")))).alias("key"))
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    drawn = sorted(r[0] for r in keys.orderBy(F.xxhash64("key")).limit(SAMPLE).select(F.substring("key", 1, SPLIT_CHARS)).collect())
    splits = sorted({drawn[i * len(drawn) // buckets] for i in range(1, buckets)}) if drawn else []

    @F.pandas_udf("int")
    def first_bucket(key: pd.Series) -> pd.Series:
        return key.map(lambda k: bisect_right(splits, k)).astype("int32")

    @F.pandas_udf("int")
    def last_bucket(key: pd.Series) -> pd.Series:
        return key.map(lambda k: bisect_left(splits, k + "\U0010ffff")).astype("int32")

    side = rules.select(F.explode(F.sequence(first_bucket("key"), last_bucket("key"))).alias("bucket"), "key", F.lit(0).alias("kind"), F.lit("").alias("host"), F.lit("").alias("path"), F.col("host").alias("rule_host"), F.col("path").alias("rule_path"), "verdict")
    none = F.lit(None).cast("string")
    rows = side.unionByName(keys.select(first_bucket("key").alias("bucket"), "key", "kind", "host", "path", none.alias("rule_host"), none.alias("rule_path"), none.alias("verdict")))
    rows = rows.repartition(buckets, "bucket").sortWithinPartitions("bucket", "key", "kind")
    hits = rows.select("bucket", "key", "kind", "host", "path", "rule_host", "rule_path", "verdict").mapInPandas(sweep, "host string, path string, rule_host string, rule_path string, verdict string")
    rule = F.concat("rule_host", "rule_path")
    best = hits.groupBy("host", "path").agg(F.max(F.struct(F.length(rule).alias("n"), F.length("rule_host").alias("m"), rule.alias("rule"), F.col("verdict").alias("verdict"))).alias("best"))
    return urls.join(best, ["host", "path"], "left").select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))


RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]

ORACLE = r"""
WITH rest AS (
  SELECT page_id, CASE WHEN strpos(coalesce(url, ''), '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS r FROM pages),
u AS (
  SELECT page_id, translate(regexp_extract(r, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path FROM rest),
rules(h, p, v) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
m AS (
  SELECT u.*, h || p AS rule, v, row_number() OVER (PARTITION BY page_id ORDER BY length(h || p) DESC NULLS LAST, length(h) DESC) AS n
  FROM u LEFT JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p))
SELECT page_id, host, path, rule, coalesce(v, 'allow') AS verdict FROM m WHERE n = 1
"""
