"""Queries of conversations, tickets and documents."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import threads as O
from ..sources import tables as A
from ..sources.shared import shared_dir
from .q_text import NORMAL, URGENCY_SQL
from .tables import MESSAGES, SENTIMENT, messages, sentiment, table


def posts(spark, d):
    """events as posts that reply to the same user's event before them on the same day."""
    from pyspark.sql import Window

    e = table(spark, d, "events")
    before = F.lag("event_id").over(Window.partitionBy("user_id", F.to_date("ts")).orderBy("ts", "event_id"))
    return e.select(
        F.col("event_id").alias("id"), before.alias("parent_id"), F.lit(None).cast("string").alias("child_ids"), F.col("ts").alias("sent_at"), F.col("event_type").alias("author"),
        (F.col("event_type") != "purchase").alias("inbound"), F.element_at(F.array(F.lit("en"), F.lit("fr")), (F.col("event_id") % 2 + 1).cast("int")).alias("lang"), (F.col("event_id") % 10 / 10).alias("confidence"),
    )


POSTS = """
WITH p AS (
  SELECT event_id AS id, ts AS sent_at, event_type AS author, event_type <> 'purchase' AS inbound, (['en', 'fr'])[(event_id % 2 + 1)::INT] AS lang, event_id % 10 / 10 AS confidence,
         user_id, min(event_id) OVER (PARTITION BY user_id, ts::DATE) AS root FROM events)
"""


def reply_components(spark, d):
    p = posts(spark, d)
    edges = p.filter("parent_id IS NOT NULL").select(F.col("parent_id").alias("src"), F.col("id").alias("dst"))
    return O.components(p, edges)


def reply_edges(spark, d):
    p = posts(spark, d).select("id", "parent_id", F.concat_ws(",", F.col("parent_id").cast("string"), F.col("id").cast("string")).alias("child_ids"))
    return O.reply_edges(p.select(F.col("id").cast("string").alias("id"), F.col("parent_id").cast("string").alias("parent_id"), "child_ids"))


def _rooted(spark, d):
    return posts(spark, d).join(reply_components(spark, d), "id")


def conversation_summary(spark, d):
    return O.conversation_summary(_rooted(spark, d))


def slice_posts(spark, d):
    r = _rooted(spark, d)
    chosen = O.conversation_summary(r).filter("message_count >= 3")
    return O.slice_of(r, chosen).select("id", "root")


def order_posts(spark, d):
    return O.order_posts(_rooted(spark, d))


def dedup_messages(spark, d):
    m = messages(spark, d)
    again = m.filter("seq % 3 = 0").withColumn("seq", F.col("seq") + 1000)
    return O.dedup_messages(m.unionByName(again)).select("ticket_id", "seq", "author_role", "content_hash")


def tickets(spark, d):
    t = O.tickets(messages(spark, d))
    return t.select("ticket_id", "created_at", "message_count", "customer_messages", F.array_join(F.transform("messages", lambda m: F.concat(m["seq"].cast("string"), F.substring(m["author_role"], 1, 1))), ",").alias("roles"))


def _digest(df, c):
    return df.select("ticket_id", F.length(c).alias("n"), F.md5(F.col(c).cast("binary")).alias("digest"))


def customer_documents(spark, d):
    return _digest(O.customer_documents(messages(spark, d)), "document")


def dialogues(spark, d):
    return _digest(O.dialogues(messages(spark, d)), "dialogue")


def first_customer_message(spark, d):
    return _digest(O.first_customer_message(messages(spark, d)), "opening")


def multi_message(spark, d):
    return O.multi_message(messages(spark, d), 2, "customer")


def thread_summaries(spark, d):
    return O.thread_summaries(messages(spark, d)).select("ticket_id", "task", "message_count", F.md5(F.col("label").cast("binary")).alias("digest"))


def index_records(spark, d):
    return O.index_records(messages(spark, d)).select("id", "metadata", F.length("document").alias("n"))


def article_bodies(spark, d):
    b = table(spark, d, "benchmark")
    return b.select("item_id", O.article_body(F.lit("To fix this:"), F.split("text", " "), F.lit("Contact us if it persists.")).alias("body"))


def _urgency(spark, d):
    return O.first_customer_message(messages(spark, d)).select("ticket_id", T.urgency_label(F.round(T.caps_ratio(F.col("opening")) * 10, 6)).alias("urgency_label"))


def trajectories(spark, d):
    t = O.trajectories(messages(spark, d), sentiment(spark, d), _urgency(spark, d))
    return t.select("ticket_id", F.array_join("sequence", ",").alias("sequence"), F.array_join(F.transform("scores", lambda s: F.format_number(s, 2)), ",").alias("scores"), "final_customer_label", F.round("resolution_quality", 6).alias("resolution_quality"))


def trajectory_predictions(spark, d):
    """Predictions of all tickets with the urgency of their opening, written as a task's rows and read back, then once again."""
    m = messages(spark, d)
    score = F.round(T.urgency_score(F.col("opening")), 6)
    urgency = O.first_customer_message(m).select("ticket_id", T.urgency_label(score).alias("urgency_label"), score.alias("urgency_score"))
    rows = O.trajectory_predictions(O.trajectories(m, sentiment(spark, d), urgency), urgency, "rules_v1", "urgency_v1")
    path = f"{shared_dir(spark)}/io-{uuid.uuid4().hex}"
    for _ in range(2):
        A.replace_task(rows, path)
    said = lambda name: F.get_json_object("payload", f"$.{name}")
    return spark.read.parquet(path).select("ticket_id", "task", "label", F.round("score", 6).alias("score"), "model_version", said("urgency_label").alias("urgency_label"), F.round(said("urgency_score").cast("double"), 6).alias("urgency_score"), said("urgency_model_version").alias("urgency_model_version"), F.size(F.from_json(said("sequence"), "array<string>")).alias("n"))


def resolved(spark, d):
    t = O.resolved(O.trajectories(messages(spark, d), sentiment(spark, d), _urgency(spark, d)))
    oldest = messages(spark, d).groupBy("ticket_id").agg(F.min("sent_at").alias("since"))
    return t.join(oldest, "ticket_id").orderBy("since", "ticket_id").limit(40).select("ticket_id", "since", F.round("resolution_quality", 6).alias("resolution_quality"))


def resolved_with_messages(spark, d):
    m = messages(spark, d)
    t = m.groupBy(F.col("ticket_id").alias("id")).agg(F.min("sent_at").alias("ingested_at")).withColumn("source", F.when(F.col("id") % 3 == 0, "bitext").otherwise("twitter"))
    r = O.resolved_with_messages(O.trajectories(m, sentiment(spark, d), _urgency(spark, d)), t, m, "twitter", 40)
    return r.select("id", "source", F.size("messages").alias("n"), F.array_join(F.transform("messages", lambda x: F.concat(x["seq"].cast("string"), F.substring(x["author_role"], 1, 1))), ",").alias("roles"))


M = f"WITH m AS ({MESSAGES})\n"
TRAJECTORY = f"""
WITH m AS ({MESSAGES}), s AS ({SENTIMENT}),
v AS (SELECT *, CASE label WHEN 'positive' THEN score WHEN 'negative' THEN -score ELSE 0 END AS v FROM m JOIN s USING (ticket_id, seq)),
f AS (
  SELECT ticket_id, string_agg(label, ',' ORDER BY seq) AS sequence, string_agg(printf('%.2f', v::DOUBLE), ',' ORDER BY seq) AS scores,
         coalesce(arg_max(label, seq) FILTER (author_role = 'customer'), arg_max(label, seq)) AS final_customer_label, coalesce(arg_max(v, seq) FILTER (author_role = 'customer'), arg_max(v, seq)) AS final FROM v GROUP BY ticket_id),
o AS (SELECT ticket_id, coalesce(arg_min(text, seq) FILTER (author_role = 'customer'), arg_min(text, seq)) AS t, min(sent_at) AS since FROM m GROUP BY ticket_id),
u AS (SELECT ticket_id, since, round(length(regexp_replace(t, '[^\\p{{Lu}}]', '', 'g')) / nullif(length(regexp_replace(t, '[^\\p{{L}}]', '', 'g')), 0) * 10, 6) AS c FROM o),
t AS (SELECT ticket_id, since, sequence, scores, final_customer_label, round(final * CASE WHEN c >= 2 THEN 1.0 WHEN c >= 0.7 THEN 0.66 ELSE 0.33 END, 6)::DOUBLE AS resolution_quality FROM f JOIN u USING (ticket_id))
"""


_URGENT = URGENCY_SQL.replace("SELECT doc_id AS id, text AS t FROM documents UNION ALL SELECT page_id, html FROM pages", f"SELECT ticket_id AS id, coalesce(arg_min(text, seq) FILTER (author_role = 'customer'), arg_min(text, seq)) AS t FROM ({MESSAGES}) GROUP BY ticket_id")
PREDICTIONS = TRAJECTORY + f""", g AS (SELECT id, label, score FROM ({_URGENT})), k AS (SELECT ticket_id, count(*) AS n FROM v GROUP BY ticket_id)
SELECT ticket_id, 'sentiment_trajectory' AS task, final_customer_label AS label, round(final * CASE g.label WHEN 'high' THEN 1.0 WHEN 'medium' THEN 0.66 ELSE 0.33 END, 6)::DOUBLE AS score, 'rules_v1' AS model_version,
       g.label AS urgency_label, round(g.score, 6)::DOUBLE AS urgency_score, 'urgency_v1' AS urgency_model_version, n::INT AS n
FROM f JOIN g ON g.id = ticket_id JOIN k USING (ticket_id)"""


def _dig(agg: str, where: str = "") -> str:
    return f"{M}, x AS (SELECT ticket_id, {agg} AS t FROM m {where} GROUP BY ticket_id) SELECT ticket_id, length(t)::INT AS n, md5(t) AS digest FROM x"


LINE = "upper(author_role[1]) || author_role[2:] || ': ' || text"
QUERIES = {
    "reply_components": (reply_components, POSTS + "SELECT id, root FROM p"),
    "reply_edges": (reply_edges, "WITH p AS (SELECT event_id AS id, lag(event_id) OVER (PARTITION BY user_id, ts::DATE ORDER BY ts, event_id) AS q FROM events), e AS (SELECT q AS src, id AS dst FROM p WHERE q IS NOT NULL UNION SELECT id, q FROM p WHERE q IS NOT NULL) SELECT src::VARCHAR AS src, dst::VARCHAR AS dst FROM e"),
    "conversation_summary": (conversation_summary, POSTS + "SELECT root, arg_min(author, (sent_at, id)) FILTER (NOT inbound) AS brand, min(sent_at) AS start_time, count(*) AS message_count, arg_min(lang, (sent_at, id)) FILTER (inbound) AS root_lang, coalesce(arg_min(confidence, (sent_at, id)) FILTER (inbound), 0) AS confidence FROM p GROUP BY root"),
    "slice_posts": (slice_posts, POSTS + "SELECT id, root FROM p WHERE root IN (SELECT root FROM p GROUP BY root HAVING count(*) >= 3)"),
    "order_posts": (order_posts, POSTS + "SELECT root, id, row_number() OVER (PARTITION BY root ORDER BY sent_at, id) - 1 AS place FROM p"),
    "dedup_messages": (dedup_messages, f"WITH m0 AS ({MESSAGES}), m AS (SELECT * FROM m0 UNION ALL SELECT ticket_id, seq + 1000, author_role, text, sent_at FROM m0 WHERE seq % 3 = 0), h AS (SELECT ticket_id, seq, author_role, sha1({NORMAL}) AS content_hash FROM m), k AS (SELECT *, row_number() OVER (PARTITION BY ticket_id, content_hash ORDER BY seq) AS n FROM h) SELECT ticket_id, (row_number() OVER (PARTITION BY ticket_id ORDER BY seq) - 1)::INT AS seq, author_role, content_hash FROM k WHERE n = 1"),
    "tickets": (tickets, M + "SELECT ticket_id, min(sent_at) AS created_at, count(*) AS message_count, count(*) FILTER (author_role = 'customer') AS customer_messages, string_agg(seq::VARCHAR || author_role[1], ',' ORDER BY seq) AS roles FROM m GROUP BY ticket_id"),
    "customer_documents": (customer_documents, _dig("string_agg(text, chr(10) ORDER BY seq)", "WHERE author_role = 'customer'")),
    "dialogues": (dialogues, _dig(f"string_agg({LINE}, chr(10) ORDER BY seq)")),
    "first_customer_message": (first_customer_message, _dig("coalesce(arg_min(text, seq) FILTER (author_role = 'customer'), arg_min(text, seq))")),
    "multi_message": (multi_message, M + "SELECT ticket_id, count(*) AS n FROM m WHERE author_role = 'customer' GROUP BY ticket_id HAVING count(*) >= 2"),
    "thread_summaries": (thread_summaries, f"{M}, x AS (SELECT ticket_id, count(*) AS message_count, string_agg({LINE}, chr(10) ORDER BY seq) AS t FROM m GROUP BY ticket_id HAVING count(*) >= 2) SELECT ticket_id, 'thread_summary' AS task, message_count, md5(array_to_string(list_filter(string_split(t, chr(10)), lambda x: trim(x) <> '')[1:4], ' ')) AS digest FROM x"),
    "index_records": (index_records, f"{M}, x AS (SELECT ticket_id, min(sent_at) AS c, string_agg({LINE}, chr(10) ORDER BY seq) AS t FROM m GROUP BY ticket_id) SELECT ticket_id AS id, '{{\"source\":\"ticket\",\"created_at\":\"' || strftime(c, '%Y-%m-%d %H:%M:%S') || '\"}}' AS metadata, length(t)::INT AS n FROM x"),
    "article_bodies": (article_bodies, "WITH x AS (SELECT item_id, string_split(text, ' ') AS s FROM benchmark) SELECT item_id, 'To fix this:' || chr(10) || array_to_string(list_transform(s, lambda x, i: i::VARCHAR || '. ' || x), chr(10)) || chr(10) || 'Contact us if it persists.' AS body FROM x"),
    "trajectory_predictions": (trajectory_predictions, PREDICTIONS),
    "trajectories": (trajectories, TRAJECTORY + "SELECT ticket_id, sequence, scores, final_customer_label, resolution_quality FROM t"),
    "resolved_with_messages": (resolved_with_messages, TRAJECTORY + ", o1 AS (SELECT ticket_id AS id FROM t WHERE resolution_quality > 0 AND ticket_id % 3 <> 0 ORDER BY since, ticket_id LIMIT 40) SELECT id, 'twitter' AS source, count(*)::INT AS n, string_agg(seq::VARCHAR || author_role[1], ',' ORDER BY seq) AS roles FROM o1 JOIN m ON ticket_id = id GROUP BY id"),
    "resolved": (resolved, TRAJECTORY + "SELECT ticket_id, since, resolution_quality FROM t WHERE resolution_quality > 0 ORDER BY since, ticket_id LIMIT 40"),
}
