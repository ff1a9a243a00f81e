"""Queries of sampling, splits and drift."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import drift as K
from ..operators import sampling as S
from .tables import table


def _orders(spark, d):
    """orders as conversation summaries: root, brand (the customer's nation), start_time, message_count."""
    o = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return o.select(F.col("o_orderkey").alias("root"), F.when(F.col("o_orderkey") % 50 != 0, F.col("n_name")).alias("brand"), F.col("o_orderdate").alias("start_time"), (F.col("o_orderkey") % 7 * F.when(F.col("n_name") < "D", 9).otherwise(1) + 1).alias("message_count"))


ORDERS = """
WITH s AS (
  SELECT o_orderkey AS root, CASE WHEN o_orderkey % 50 <> 0 THEN n_name ELSE '__unknown__' END AS brand, o_orderdate AS start_time, (o_orderkey % 7 * CASE WHEN n_name < 'D' THEN 9 ELSE 1 END + 1)::BIGINT AS message_count
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey),
b AS (SELECT brand, sum(message_count) / (SELECT sum(message_count) FROM s) AS share FROM s GROUP BY brand),
k AS (SELECT *, row_number() OVER (ORDER BY share DESC, brand) - 1 AS k, sum(share) OVER (ORDER BY share DESC, brand ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS suffix FROM b),
c AS (SELECT *, share * (1 - 0.08::DOUBLE * k) / suffix > 0.08::DOUBLE + 1e-12 AS capped FROM k),
t AS (SELECT brand, share, CASE WHEN capped THEN 0.08::DOUBLE ELSE share * (1 - 0.08::DOUBLE * (SELECT count(*) FROM c WHERE capped)) / (SELECT max(suffix) FROM c WHERE NOT capped) END AS target FROM c)
"""
SEEDED = "('0x' || substr(md5('{}:' || {}::VARCHAR), 1, 15))::BIGINT"


def eligible(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.when(F.col("doc_id") % 9 != 0, F.col("lang")).alias("lang"), (F.col("doc_id") % 100 / 100).alias("confidence"))
    return S.eligible(docs)


def natural_shares(spark, d):
    return S.natural_shares(_orders(spark, d)).select("brand", F.round("share", 9).alias("share"))


def _targets(spark, d):
    return S.capped_shares(S.natural_shares(_orders(spark, d)))


def capped_shares(spark, d):
    return _targets(spark, d).select("brand", F.round("share", 9).alias("share"), F.round("target", 9).alias("target"))


def weekly_pick(spark, d):
    return S.weekly_pick(_orders(spark, d), _targets(spark, d), 20000)


def _split(spark, d):
    return S.stratified_split(table(spark, d, "documents").select("doc_id", "lang"), "lang", "doc_id")


def stratified_split(spark, d):
    return _split(spark, d)


def split_counts(spark, d):
    return _split(spark, d).groupBy("split", "lang").agg(F.count("*").alias("n"))


def intent_frame(spark, d):
    e = table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").alias("k"), F.get_json_object("props", "$.intent").alias("intent"), F.length("props").alias("n"), "event_type")
    return e.filter("event_type = 'purchase'")


def seeded_sample(spark, d):
    return S.sample(table(spark, d, "documents").select("doc_id", "source"), "doc_id", 100)


def sample_excluding(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "source")
    return S.sample_excluding(docs, table(spark, d, "labels"), "doc_id", 100)


def pools(spark, d):
    return S.pools(table(spark, d, "documents").select("doc_id"), "doc_id")


def first_per_group(spark, d):
    return S.first_per_group(table(spark, d, "documents").select("doc_id", "source"), "source", "doc_id", 5)


def quota_sample(spark, d):
    docs = table(spark, d, "documents")
    tags = docs.select("doc_id", F.explode(F.array(F.when(F.col("lang") == "fr", "french"), F.when(F.col("n_chars") > 2000, "long"), F.lit("any"))).alias("quota")).filter("quota IS NOT NULL")
    return S.quota_sample(tags, {"french": 30, "long": 24, "any": 90}, "doc_id")


def label_quota(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.filter(F.array(F.when(F.col("doc_id") % 3 == 0, "A"), F.when(F.col("doc_id") % 5 == 0, "B")), lambda x: x.isNotNull()).alias("labels"))
    return S.label_quota(docs, "doc_id", 30, 10, 20)


def _sides(spark, d):
    e = table(spark, d, "embeddings")
    return e.filter("label = 0"), e.filter("label BETWEEN 1 AND 4")


def centroid_shift(spark, d):
    out = K.centroid_shift(*_sides(spark, d))
    return out.withColumn("shift", F.round("shift", 6))


def _counts(spark, d):
    e = table(spark, d, "events").withColumn("type", F.when(F.col("event_type") != "error", F.col("event_type")))
    return K.label_counts(e.filter("ts < '2024-01-08'"), "type"), K.label_counts(e.filter("ts >= '2024-01-08' AND (event_type <> 'click' OR event_id % 3 = 0)"), "type")


def label_distributions(spark, d):
    out = K.distributions(*_counts(spark, d))
    return out.select("label", F.round("p_reference", 9).alias("p_reference"), F.round("p_live", 9).alias("p_live"))


def psi(spark, d):
    return K.psi(*_counts(spark, d)).withColumn("psi", F.round("psi", 6))


def drift_runs(spark, d):
    r, live = _sides(spark, d)
    a, b = _counts(spark, d)
    return K.drift_runs({"real": (r, live, a, b), "same": (r, r, a, a)}).withColumn("value", F.round(F.col("value") + 0.0, 6))


WEEKS = ("2024-01-08", "2024-01-15", "2024-01-22", "2024-01-29")


def drift_by_week(spark, d):
    """One week of twitter tickets against the four after it: their vectors and their labels. Where a side has no vector, as the events' ids go beyond the vectors', the shift is null."""
    e = table(spark, d, "events")
    tickets = e.filter("user_id % 2 = 0").select(F.col("event_id").alias("id"), "ts")
    reference, live = K.week_windows(tickets, "ts", "2024-01-01", WEEKS)
    vectors = table(spark, d, "embeddings").select((F.col("vec_id") * 7919 % 10000).alias("id"), "embedding")
    predictions = e.select(F.col("event_id").alias("ticket_id"), F.when(F.col("event_type") != "error", F.col("event_type")).alias("label"))
    shift = K.centroid_shift(*[vectors.join(side.select("id"), "id", "left_semi") for side in (reference, live)], empty=True)
    psi = K.psi(*[K.label_counts_of(predictions, side) for side in (reference, live)])
    return shift.crossJoin(psi).withColumns({"shift": F.round("shift", 6), "psi": F.round("psi", 6)})  # one row each


WEEKLY = """
WITH t AS (SELECT event_id AS id, date_trunc('week', ts)::DATE AS week, event_type AS label FROM events WHERE user_id % 2 = 0),
r AS (SELECT * FROM t WHERE week = DATE '2024-01-01'), l AS (SELECT * FROM t WHERE week IN (DATE '2024-01-08', DATE '2024-01-15', DATE '2024-01-22', DATE '2024-01-29')),
v AS (SELECT vec_id * 7919 % 10000 AS id, embedding FROM embeddings), rv AS (SELECT * FROM v SEMI JOIN r USING (id)), lv AS (SELECT * FROM v SEMI JOIN l USING (id)),
rm AS (SELECT dim, avg(x) AS m FROM (SELECT unnest(embedding)::DOUBLE AS x, unnest(range(1, len(embedding) + 1)) AS dim FROM rv) GROUP BY dim),
lm AS (SELECT dim, avg(x) AS m FROM (SELECT unnest(embedding)::DOUBLE AS x, unnest(range(1, len(embedding) + 1)) AS dim FROM lv) GROUP BY dim),
s AS (SELECT 1 - sum(rm.m * lm.m) / (sqrt(sum(rm.m * rm.m)) * sqrt(sum(lm.m * lm.m))) AS shift FROM rm JOIN lm USING (dim)),
rc AS (SELECT label, count(*) AS n FROM r WHERE label <> 'error' GROUP BY label), lc AS (SELECT label, count(*) AS n FROM l WHERE label <> 'error' GROUP BY label),
p AS (SELECT greatest(coalesce(rc.n / (SELECT sum(n) FROM rc), 0), 1e-6) AS a, greatest(coalesce(lc.n / (SELECT sum(n) FROM lc), 0), 1e-6) AS b FROM rc FULL JOIN lc USING (label)),
q AS (SELECT sum((b - a) * ln(b / a)) AS psi FROM p)
SELECT round(shift, 6) AS shift, (SELECT count(*) FROM rv) AS n_reference, (SELECT count(*) FROM lv) AS n_live, shift > 0.05 AS alarm, round(psi, 6) AS psi,
       CASE WHEN psi > 0.25 THEN 'alarm' WHEN psi > 0.1 THEN 'watch' ELSE 'stable' END AS status FROM s, q
"""
PSI = """
WITH r AS (SELECT event_type AS label, count(*) AS n FROM events WHERE ts < '2024-01-08' AND event_type <> 'error' GROUP BY ALL),
l AS (SELECT event_type AS label, count(*) AS n FROM events WHERE ts >= '2024-01-08' AND event_type <> 'error' AND (event_type <> 'click' OR event_id % 3 = 0) GROUP BY ALL),
p AS (SELECT label, coalesce(r.n / (SELECT sum(n) FROM r), 0) AS a, coalesce(l.n / (SELECT sum(n) FROM l), 0) AS b FROM r FULL JOIN l USING (label)),
v AS (SELECT sum((greatest(b, 1e-6) - greatest(a, 1e-6)) * ln(greatest(b, 1e-6) / greatest(a, 1e-6))) AS psi FROM p)
"""
SHIFT = """
WITH x AS (SELECT label, unnest(embedding)::DOUBLE AS x, unnest(range(1, len(embedding) + 1)) AS dim FROM embeddings WHERE label <= 4),
m AS (SELECT dim, avg(x) FILTER (label = 0) AS r, avg(x) FILTER (label > 0) AS l FROM x GROUP BY dim),
s AS (SELECT round(1 - sum(r * l) / (sqrt(sum(r * r)) * sqrt(sum(l * l))), 6) AS shift FROM m)
"""
D = SEEDED.format(42, "doc_id")
QUERIES = {
    "eligible": (eligible, "SELECT * FROM (SELECT doc_id, CASE WHEN doc_id % 9 <> 0 THEN lang END AS lang, doc_id % 100 / 100 AS confidence FROM documents) WHERE lang IS NULL OR lang = 'en' OR confidence < 0.70"),
    "natural_shares": (natural_shares, ORDERS + "SELECT brand, round(share, 9) AS share FROM b"),
    "capped_shares": (capped_shares, ORDERS + "SELECT brand, round(share, 9) AS share, round(target, 9) AS target FROM t"),
    "weekly_pick": (weekly_pick, ORDERS + f", r AS (SELECT *, strftime(start_time, '%G-W%V') AS week, row_number() OVER (PARTITION BY brand, strftime(start_time, '%G-W%V') ORDER BY {SEEDED.format(42, 'root')}, root) AS round FROM s), q AS (SELECT *, coalesce(sum(message_count) OVER (PARTITION BY brand ORDER BY round, week ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS spent FROM r) SELECT root, brand, week, message_count FROM q JOIN t USING (brand) WHERE spent < round_even(target * 20000, 0)"),
    "stratified_split": (stratified_split, f"WITH p AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY {D}, doc_id) - 1 AS k, count(*) OVER (PARTITION BY lang) AS n FROM documents) SELECT doc_id, lang, CASE WHEN k < round_even(n * 0.70::DOUBLE, 0) THEN 'train' WHEN k < round_even(n * (0.70::DOUBLE + 0.15::DOUBLE), 0) THEN 'val' ELSE 'test' END AS split FROM p"),
    "split_counts": (split_counts, f"WITH p AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY {D}, doc_id) - 1 AS k, count(*) OVER (PARTITION BY lang) AS n FROM documents) SELECT CASE WHEN k < round_even(n * 0.70::DOUBLE, 0) THEN 'train' WHEN k < round_even(n * (0.70::DOUBLE + 0.15::DOUBLE), 0) THEN 'val' ELSE 'test' END AS split, lang, count(*) AS n FROM p GROUP BY ALL"),
    "intent_frame": (intent_frame, "SELECT event_id, props->>'$.k' AS k, props->>'$.intent' AS intent, length(props)::INT AS n, event_type FROM events WHERE event_type = 'purchase'"),
    "seeded_sample": (seeded_sample, f"SELECT doc_id, source FROM documents ORDER BY {D}, doc_id LIMIT 100"),
    "sample_excluding": (sample_excluding, f"SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) ORDER BY {D}, doc_id LIMIT 100"),
    "pools": (pools, f"SELECT doc_id, CASE WHEN row_number() OVER (ORDER BY {D}, doc_id) <= round_even((SELECT count(*) FROM documents) * 0.1::DOUBLE, 0) THEN 'gold' ELSE 'shell' END AS pool FROM documents"),
    "first_per_group": (first_per_group, "SELECT doc_id, source FROM documents QUALIFY row_number() OVER (PARTITION BY source ORDER BY doc_id) <= 5"),
    "quota_sample": (quota_sample, f"WITH a AS (SELECT doc_id FROM documents WHERE lang = 'fr' ORDER BY {D}, doc_id LIMIT 30), b AS (SELECT doc_id FROM documents WHERE n_chars > 2000 AND doc_id NOT IN (SELECT doc_id FROM a) ORDER BY {D}, doc_id LIMIT 24), c AS (SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM a UNION SELECT doc_id FROM b) ORDER BY {D}, doc_id LIMIT 90) SELECT doc_id, 'french' AS quota FROM a UNION ALL SELECT doc_id, 'long' FROM b UNION ALL SELECT doc_id, 'any' FROM c"),
    "label_quota": (label_quota, f"WITH a AS (SELECT doc_id FROM documents WHERE doc_id % 3 = 0 ORDER BY {D}, doc_id LIMIT 30), b AS (SELECT doc_id FROM documents WHERE doc_id % 5 = 0 ORDER BY {D}, doc_id LIMIT 30), n AS (SELECT doc_id FROM documents WHERE doc_id % 3 <> 0 AND doc_id % 5 <> 0 ORDER BY {D}, doc_id LIMIT 10), c AS (SELECT doc_id FROM a UNION SELECT doc_id FROM b UNION SELECT doc_id FROM n) SELECT doc_id, row_number() OVER (ORDER BY {SEEDED.format('42-blind', 'doc_id')}, doc_id) <= 20 AS blind FROM c"),
    "centroid_shift": (centroid_shift, SHIFT + "SELECT shift, (SELECT count(*) FROM embeddings WHERE label = 0) AS n_reference, (SELECT count(*) FROM embeddings WHERE label BETWEEN 1 AND 4) AS n_live, shift > 0.05 AS alarm FROM s"),
    "label_distributions": (label_distributions, PSI + "SELECT label, round(a, 9) AS p_reference, round(b, 9) AS p_live FROM p"),
    "psi": (psi, PSI + "SELECT round(psi, 6) AS psi, CASE WHEN psi > 0.25 THEN 'alarm' WHEN psi > 0.1 THEN 'watch' ELSE 'stable' END AS status FROM v"),
    "drift_by_week": (drift_by_week, WEEKLY),
    "drift_runs": (drift_runs, PSI + "," + SHIFT.strip()[5:] + "SELECT 'real' AS scenario, 'cosine_shift' AS metric, shift AS value FROM s UNION ALL SELECT 'real', 'psi', round(psi, 6) FROM v UNION ALL SELECT 'same', 'cosine_shift', 0.0 UNION ALL SELECT 'same', 'psi', 0.0"),
}
