"""Queries of topics, retrieval, reply drafting and reads."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import retrieve as M
from ..operators import serve as N
from ..operators import topics as I
from .tables import MESSAGES, RUNS, messages, runs, table

STOP = ["the", "of", "and", "de", "la", "to", "in"]


def _topic_docs(spark, d):
    return table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("topic"), "text")


def _terms(spark, d):
    return I.topic_terms(_topic_docs(spark, d), STOP)


def cluster_keywords(spark, d):
    return I.cluster_keywords(_terms(spark, d))


def class_tfidf(spark, d):
    return I.class_tfidf(_terms(spark, d)).select("topic", F.round("weight", 4).alias("weight"), "rank")


def _catalog(spark, d):
    return I.catalog(_topic_docs(spark, d), I.cluster_keywords(_terms(spark, d)))


def topic_catalog(spark, d):
    return _catalog(spark, d).select("topic", "size", F.array_join("keywords", " ").alias("keywords"), "label")


def topic_assignment(spark, d):
    t = I.assign(_topic_docs(spark, d).select("id", "topic"), _catalog(spark, d).filter("topic <> 'src3'"))
    return t.select("id", "task", "label", F.size("keywords").alias("n"))


def largest_topics(spark, d):
    return I.largest(_catalog(spark, d), 5).select("topic", "size")


def topic_coherence(spark, d):
    return I.coherence(_topic_docs(spark, d), I.cluster_keywords(_terms(spark, d)).select("topic", "term")).select("topic", F.round("npmi", 5).alias("npmi"))


def variant_stats(spark, d):
    e = table(spark, d, "events")
    return I.variant_stats(e.select(F.col("event_type").alias("variant"), (F.col("user_id") % 12 - 1).cast("int").alias("topic")))


def kmeans_topics(spark, d):
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return N.value_counts(I.kmeans_topics(v, 10), "topic_key")


def density_topics(spark, d):
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return N.value_counts(I.density_topics(v, 20, levels=4), "topic_key")


def document_embeddings(spark, d):
    v = I.embed(table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text"))
    return v.select("id", F.size("vector").alias("dims"), F.round(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x * x), 3).alias("norm"))


def topic_names(spark, d):
    return table(spark, d, "benchmark").select("item_id", I.clean_name(F.concat(F.lit(' "'), F.col("text"), F.lit('.." '))).alias("name"))


def _vectors(spark, d):
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label")


def _queries(spark, d):
    return table(spark, d, "embeddings").filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))


def vector_top_k(spark, d):
    return M.top_k(_queries(spark, d), _vectors(spark, d)).select("query_id", "id", F.round("score", 5).alias("score"), "rank")


def filtered_top_k(spark, d):
    return M.top_k(_queries(spark, d), _vectors(spark, d), 3, F.col("label") < 5).select("query_id", "id", "rank")


def approximate_top_k(spark, d):
    return M.approximate_top_k(_queries(spark, d), _vectors(spark, d)).select("query_id", "id", F.round("score", 5).alias("score"), "rank")


def _hits(spark, d):
    v = _vectors(spark, d)
    own = _queries(spark, d).select("query_id", F.col("query_id").alias("id"))
    return M.retrieve(_queries(spark, d), {"kb": v.filter("label >= 7"), "ticket": v.filter("label < 7")}, 5, own)


def retrieve_two(spark, d):
    return _hits(spark, d).select("query_id", "kind", "id", F.round("score", 5).alias("score"), "rank")


def _texts(spark, d):
    """A text for each vector: the document of the same number."""
    return table(spark, d, "embeddings").join(table(spark, d, "documents"), F.col("vec_id") == F.col("doc_id"), "left").select(F.col("vec_id").alias("id"), F.coalesce("text", F.lit("")).alias("text"))


def rerank_hits(spark, d):
    t = _texts(spark, d)
    h = _hits(spark, d).join(t, "id").join(t.select(F.col("id").alias("query_id"), F.col("text").alias("query")), "query_id")
    return M.rerank(h, F.round(M.lexical_score(F.col("query"), F.col("text")), 6)).select("query_id", "id", "second", "new_rank")


def bm25_rerank(spark, d):
    t = _texts(spark, d)
    scored = M.bm25(_hits(spark, d), t.withColumnRenamed("id", "query_id"), t)
    return M.rerank(scored, F.round("bm25", 6)).select("query_id", "id", "second", "new_rank")


def highlights(spark, d):
    t = _texts(spark, d)
    h = _hits(spark, d).join(t, "id").join(t.select(F.col("id").alias("query_id"), F.col("text").alias("query")), "query_id")
    return h.select("query_id", "id", F.size(M.highlight(F.col("query"), F.col("text"))).alias("n"))


def search_reranked(spark, d):
    t, v = _texts(spark, d), _vectors(spark, d)
    q = _queries(spark, d).join(t.withColumnRenamed("id", "query_id"), "query_id")
    return M.search(q, {"kb": v.filter("label >= 7"), "ticket": v.filter("label < 7")}, t).drop("score")


def search_results(spark, d):
    c = _vectors(spark, d).select("id", F.when(F.col("label") >= 7, "kb").otherwise("ticket").alias("kind"), F.concat(F.lit("Article "), F.col("id").cast("string")).alias("title"))
    return M.results(_hits(spark, d), c, 3).drop("score")


def confidence_gate(spark, d):
    g = M.confidence_gate(_queries(spark, d), _hits(spark, d), 0.5)
    return g.select("query_id", F.round("best", 5).alias("best"), "drafts")


def reply_prompts(spark, d):
    t = _texts(spark, d)
    q = _queries(spark, d).join(t.withColumnRenamed("id", "query_id"), "query_id").select("query_id", "text")
    p = M.prompts(q, M.numbered_sources(_hits(spark, d), t))
    return p.select("query_id", F.length("prompt").alias("n"), F.md5(F.col("prompt").cast("binary")).alias("digest"))


def citations(spark, d):
    e = table(spark, d, "events")
    reply = F.concat(F.lit("See ["), (F.col("user_id") % 4 + 1).cast("string"), F.lit("] and ["), (F.col("event_id") % 4 + 1).cast("string"), F.lit("], not [x]."))
    return e.select("event_id", F.array_join(F.transform(M.citations(reply), lambda n: n.cast("string")), ",").alias("cited"))


def _ledger(spark, d):
    e = table(spark, d, "events")
    return e.select(F.col("event_type").alias("purpose"), F.lit("m").alias("model"), F.sha2(F.col("user_id").cast("string").cast("binary"), 256).alias("prompt_hash"), M.call_cost(F.col("user_id") * 100, F.col("event_id") % 50, 3.0, 15.0).alias("cost"))


def call_spend(spark, d):
    return M.spend(_ledger(spark, d), 5.0).withColumn("spent", F.round("spent", 6))


def pending_calls(spark, d):
    led = _ledger(spark, d)
    return M.pending_calls(led.select("purpose", "model", "prompt_hash", F.lit(0.25).alias("cost")), led.filter("purpose < 'f'"), 40.0).select("purpose", "prompt_hash")


def cached_calls(spark, d):
    led = _ledger(spark, d)
    answered = led.filter("purpose < 'f'").withColumn("response", F.substring("prompt_hash", 1, 8))
    return M.cached_calls(led.select("purpose", "model", "prompt_hash").distinct(), answered).select("purpose", "prompt_hash", "response")


def retrieval_eval(spark, d):
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label")
    q = _queries(spark, d)
    truth = q.select("query_id").join(e.select(F.col("id").alias("query_id"), "label"), "query_id").join(e.filter("id % 50 <> 0").select(F.col("id").alias("relevant"), "label"), "label").select("query_id", "relevant")
    return M.evaluate_retrieval(q, e.filter("id % 50 <> 0"), truth).select(F.round("hit_rate", 6).alias("hit_rate"), "n")


def _tickets(spark, d):
    return table(spark, d, "documents").select(F.col("doc_id").alias("id"), "source", (F.lit("2024-01-01").cast("timestamp") + F.make_interval(mins=(F.col("doc_id") * 37 % 1000).cast("int"))).alias("ingested_at"))


def list_tickets(spark, d):
    return N.list_tickets(_tickets(spark, d), "src3", 20, 5).select("id", "source")


def tickets_with_messages(spark, d):
    page = N.list_tickets(_tickets(spark, d), "src3", 20, 5, messages(spark, d))
    return page.select("id", "source", F.size("messages").alias("n"), F.array_join(F.transform("messages", lambda m: m["seq"].cast("string")), ",").alias("turns"))


def ticket_by_id(spark, d):
    return N.ticket(_tickets(spark, d), 7).select("id", "source")


def ticket_predictions(spark, d):
    p = table(spark, d, "events").select("event_id", F.col("user_id").alias("ticket_id"), F.col("event_type").alias("task"), "value")
    return N.predictions_of(p, 5, "click")


def _run_columns(df):
    return df.select("id", "task", "model_version", "split")


def eval_runs(spark, d):
    return _run_columns(N.eval_runs(runs(spark, d), "click", None, 25))


def latest_runs(spark, d):
    return _run_columns(N.latest_by(runs(spark, d), ["task", "split"]))


def best_metrics(spark, d):
    return N.best_metric(runs(spark, d), "macro_f1").withColumn("best", F.round("best", 9))


def latest_coherence(spark, d):
    r = runs(spark, d).withColumn("metrics", F.when(F.col("id") % 4 != 0, F.create_map(F.lit("coherence"), F.col("metrics")["hit_rate"])).otherwise(F.col("metrics")))
    return N.latest_metric(r, "coherence").withColumn("latest", F.round("latest", 9))


def ticket_with_messages(spark, d):
    t = N.ticket(_tickets(spark, d), 7, messages(spark, d)).select("id", "source", F.posexplode("messages").alias("place", "m"))
    return t.select("id", "source", "place", "m.seq", "m.author_role", "m.text")


def ranked_runs(spark, d):
    return N.ranked_runs(runs(spark, d), "hit_rate", F.col("split") == "test").select("id", "task", "place")


def report_rows(spark, d):
    r = N.report_rows(runs(spark, d), "click", "val")
    return r.groupBy("model_version", "metric").agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean"))


def value_counts(spark, d):
    return N.value_counts(runs(spark, d), "task", "split")


def latest_selected(spark, d):
    return _run_columns(N.latest_selected(runs(spark, d)))


def _predictions(spark, d):
    return table(spark, d, "events").select(F.col("event_id").alias("id"), F.col("event_type").alias("task"), F.col("ts").alias("created_at"), F.col("value").alias("score"), F.when(F.col("user_id") % 2 == 0, "a").otherwise("b").alias("model_version"))


def newest_predictions(spark, d):
    return N.newest(_predictions(spark, d), "error", 15).select("id", "task")


def lowest_scored(spark, d):
    return N.lowest_scored(_predictions(spark, d), "error", "a", 15).select("id", "score")


def latest_variants(spark, d):
    return _run_columns(N.latest_by(runs(spark, d).filter("task = 'click'"), ["model_version"]))


def customer_messages(spark, d):
    t = messages(spark, d).select(F.col("ticket_id").alias("id"), F.when(F.col("ticket_id") % 2 == 0, "twitter").otherwise("bitext").alias("source")).distinct()
    return N.customer_messages(messages(spark, d), t, "twitter").select("ticket_id", "seq")


def texts_by_id(spark, d):
    ids = messages(spark, d).filter("ticket_id % 5 = 0").select("ticket_id")
    return N.texts_of(messages(spark, d), ids).select("ticket_id", "seq", F.length("text").alias("n"))


TOKENS = "list_filter(string_split(lower(regexp_replace(text, '[^\\p{L}\\p{N}]+', ' ', 'g')), ' '), lambda x: x <> '')"
TERMS = f"""
WITH w AS (SELECT source AS topic, doc_id AS id, unnest({TOKENS}) AS term FROM documents),
t AS (SELECT topic, term, count(*) AS tf FROM w WHERE length(term) >= 2 AND term NOT IN ('the', 'of', 'and', 'de', 'la', 'to', 'in', 'url', 'user', 'email', 'phone', 'emoji') GROUP BY ALL),
k AS (SELECT *, (row_number() OVER (PARTITION BY topic ORDER BY tf DESC, term))::INT AS rank FROM t QUALIFY rank <= 10),
c AS (SELECT source AS topic, count(*) AS size FROM documents GROUP BY ALL),
cat AS (SELECT topic, size, string_agg(term, ' ' ORDER BY rank) AS keywords, string_agg(term, ', ' ORDER BY rank) FILTER (rank <= 4) AS label FROM c LEFT JOIN k USING (topic) GROUP BY ALL)
"""
VECTORS = """
WITH q AS (SELECT vec_id AS query_id, embedding AS qv FROM embeddings WHERE vec_id % 50 = 0),
s AS (SELECT query_id, vec_id AS id, label, list_dot_product(qv::DOUBLE[], embedding::DOUBLE[]) / sqrt(list_dot_product(qv::DOUBLE[], qv::DOUBLE[]) * list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS score FROM q CROSS JOIN embeddings)
"""
HITS = VECTORS + """,
h AS (SELECT query_id, CASE WHEN label >= 7 THEN 'kb' ELSE 'ticket' END AS kind, id, score, (row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, CASE WHEN label >= 7 THEN 'kb' ELSE 'ticket' END, id))::INT AS rank FROM s WHERE id <> query_id QUALIFY rank <= 5)
"""
RANKED = "(row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id))::INT AS rank"
LEDGER = "WITH l AS (SELECT event_type AS purpose, sha256(user_id::VARCHAR) AS prompt_hash, (user_id * 100 * 3.0::DOUBLE + event_id % 50 * 15.0::DOUBLE) / 1e6 AS cost FROM events)\n"
R = f"WITH r AS ({RUNS})\n"
WORDS = ", x AS (SELECT vec_id AS vid, list_filter(string_split(lower(regexp_replace(coalesce(text, ''), '[^\\p{L}\\p{N}_]+', ' ', 'g')), ' '), lambda y: y <> '') AS t, list_distinct(list_filter(t, lambda y: NOT list_contains([" + ", ".join(f"'{w}'" for w in M.STOP) + "], y))) AS w FROM embeddings LEFT JOIN documents ON vec_id = doc_id)"
SECOND = "round(CASE WHEN len(q2.w) > 0 THEN len(list_intersect(q2.w, d2.w)) / len(q2.w) ELSE 0 END, 6)"
BM25 = WORDS + """,
held AS (SELECT vid, list_filter(t, lambda y: list_contains(w, y)) AS words FROM x), size AS (SELECT count(*) AS texts, avg(len(words)) AS mean FROM held),
post AS (SELECT vid, length, word, count(*) AS tf FROM (SELECT vid, len(words) AS length, unnest(words) AS word FROM held) GROUP BY ALL), freq AS (SELECT word, count(*) AS df FROM post GROUP BY word),
asked AS (SELECT vid, unnest(list_distinct(words)) AS word FROM held),
sums AS (SELECT h.query_id, h.id, sum(ln(1 + (texts - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / mean))) AS s FROM h JOIN asked a ON a.vid = h.query_id JOIN post p ON p.vid = h.id AND p.word = a.word JOIN freq f ON f.word = a.word, size GROUP BY ALL)
"""
QUERIES = {
    "cluster_keywords": (cluster_keywords, TERMS + "SELECT topic, term, tf, rank FROM k"),
    "class_tfidf": (class_tfidf, TERMS + ", a AS (SELECT avg(w) AS a FROM (SELECT sum(tf) AS w FROM t GROUP BY topic)), f AS (SELECT term, sum(tf) AS f FROM t GROUP BY term), x AS (SELECT topic, term, round(tf * ln(1 + a / f), 6) AS weight FROM t JOIN f USING (term), a) SELECT topic, round(weight, 4) AS weight, (row_number() OVER (PARTITION BY topic ORDER BY weight DESC, term))::INT AS rank FROM x QUALIFY rank <= 10"),
    "topic_catalog": (topic_catalog, TERMS + "SELECT * FROM cat"),
    "topic_assignment": (topic_assignment, TERMS + "SELECT doc_id AS id, 'topic' AS task, CASE WHEN source = 'src3' THEN 'unlabeled' ELSE label END AS label, CASE WHEN source = 'src3' THEN 0 ELSE len(string_split(keywords, ' ')) END::INT AS n FROM documents JOIN cat ON source = topic"),
    "largest_topics": (largest_topics, "SELECT source AS topic, count(*) AS size FROM documents GROUP BY ALL ORDER BY size DESC, topic LIMIT 5"),
    "topic_coherence": (topic_coherence, TERMS + ", v AS (SELECT DISTINCT term FROM k), p AS (SELECT DISTINCT id, term FROM w SEMI JOIN v USING (term)), n AS (SELECT count(*) AS n FROM documents), s1 AS (SELECT term, count(*) AS c FROM p GROUP BY term), s2 AS (SELECT x.term AS a, y.term AS b, count(*) AS c FROM p x JOIN p y ON x.id = y.id AND x.term < y.term GROUP BY ALL), z AS (SELECT x.topic, greatest(coalesce(s2.c, 0) / n, 1e-12) AS pab, greatest(sa.c / n, 1e-12) AS pa, greatest(sb.c / n, 1e-12) AS pb FROM k x JOIN k y ON x.topic = y.topic AND x.term < y.term LEFT JOIN s2 ON s2.a = x.term AND s2.b = y.term JOIN s1 sa ON sa.term = x.term JOIN s1 sb ON sb.term = y.term, n) SELECT topic, round(avg(CASE WHEN pab >= 1 THEN 1 ELSE ln(pab / (pa * pb)) / -ln(pab) END), 5) AS npmi FROM z GROUP BY topic"),
    "variant_stats": (variant_stats, "SELECT event_type AS variant, count(DISTINCT user_id % 12) FILTER (user_id % 12 <> 0) AS topics, count(*) FILTER (user_id % 12 = 0) AS outliers FROM events GROUP BY ALL"),
    "kmeans_topics": (kmeans_topics, None),
    "density_topics": (density_topics, None),
    "document_embeddings": (document_embeddings, None),
    "topic_names": (topic_names, "SELECT item_id, trim(regexp_replace(trim(' ' || text), '\\.+$', '')) AS name FROM benchmark"),
    "vector_top_k": (vector_top_k, VECTORS + f"SELECT query_id, id, round(score, 5) AS score, {RANKED} FROM s QUALIFY rank <= 5"),
    "filtered_top_k": (filtered_top_k, VECTORS + f"SELECT query_id, id, {RANKED} FROM s WHERE label < 5 QUALIFY rank <= 3"),
    "approximate_top_k": (approximate_top_k, None),
    "retrieve_two": (retrieve_two, HITS + "SELECT query_id, kind, id, round(score, 5) AS score, rank FROM h"),
    "rerank_hits": (rerank_hits, HITS + WORDS + f", z AS (SELECT query_id, id, rank, {SECOND} AS second FROM h JOIN x q2 ON q2.vid = query_id JOIN x d2 ON d2.vid = id) SELECT query_id, id, second, (row_number() OVER (PARTITION BY query_id ORDER BY second DESC, rank))::INT AS new_rank FROM z"),
    "highlights": (highlights, HITS + WORDS + " SELECT query_id, id, len(list_filter(d2.t, lambda y: list_contains(q2.w, y)))::INT AS n FROM h JOIN x q2 ON q2.vid = query_id JOIN x d2 ON d2.vid = id"),
    "bm25_rerank": (bm25_rerank, HITS + BM25 + ", z AS (SELECT h.query_id, h.id, rank, round(coalesce(s, 0), 6) AS second FROM h LEFT JOIN sums USING (query_id, id)) SELECT query_id, id, second, (row_number() OVER (PARTITION BY query_id ORDER BY second DESC, rank))::INT AS new_rank FROM z"),
    "search_reranked": (search_reranked, HITS.replace("rank <= 5", "rank <= 40").replace("WHERE id <> query_id", "") + WORDS + f", z AS (SELECT query_id, kind, id, score, rank, {SECOND} AS second FROM h JOIN x q2 ON q2.vid = query_id JOIN x d2 ON d2.vid = id) SELECT query_id, kind, id, rank, (row_number() OVER (PARTITION BY query_id ORDER BY second DESC, rank))::INT AS new_rank FROM z QUALIFY new_rank <= 5"),
    "tickets_with_messages": (tickets_with_messages, "WITH p AS (SELECT doc_id AS id, source FROM documents WHERE source = 'src3' ORDER BY doc_id * 37 % 1000, doc_id LIMIT 20 OFFSET 5), m AS (SELECT conv_id AS id, count(*) AS n, string_agg(turn::VARCHAR, ',' ORDER BY turn) AS turns FROM conversations WHERE role IN ('user', 'assistant') GROUP BY conv_id) SELECT id, source, coalesce(n, 0)::INT AS n, coalesce(turns, '') AS turns FROM p LEFT JOIN m USING (id)"),
    "search_results": (search_results, HITS + "SELECT query_id, rank, kind, id, CASE WHEN kind = 'kb' THEN 'Article ' || id END AS title FROM h WHERE rank <= 3"),
    "confidence_gate": (confidence_gate, HITS + "SELECT q.query_id, round(b, 5) AS best, coalesce(b >= 0.5, false) AS drafts FROM q LEFT JOIN (SELECT query_id, max(score) AS b FROM h GROUP BY ALL) USING (query_id)"),
    "reply_prompts": (reply_prompts, HITS + ", x AS (SELECT vec_id AS id, coalesce(text, '') AS text FROM embeddings LEFT JOIN documents ON vec_id = doc_id), p AS (SELECT query_id, string_agg('[' || rank || '] ' || text, chr(10) ORDER BY rank) AS s FROM h JOIN x USING (id) WHERE rank <= 4 GROUP BY ALL), y AS (SELECT q.query_id, 'Issue: ' || x.text || chr(10) || 'Sources:' || chr(10) || coalesce(s, '') AS t FROM q JOIN x ON x.id = q.query_id LEFT JOIN p ON p.query_id = q.query_id) SELECT query_id, length(t)::INT AS n, md5(t) AS digest FROM y"),
    "citations": (citations, "SELECT event_id, CASE WHEN user_id % 4 = event_id % 4 THEN (user_id % 4 + 1)::VARCHAR ELSE least(user_id % 4, event_id % 4) + 1 || ',' || greatest(user_id % 4, event_id % 4) + 1 END AS cited FROM events"),
    "call_spend": (call_spend, LEDGER + "SELECT round(sum(cost), 6) AS spent, sum(cost) >= 5 AS exhausted FROM l"),
    "pending_calls": (pending_calls, LEDGER + ", m AS (SELECT DISTINCT purpose, prompt_hash FROM l WHERE purpose >= 'f') SELECT purpose, prompt_hash FROM m QUALIFY sum(0.25) OVER (ORDER BY prompt_hash, purpose ROWS UNBOUNDED PRECEDING) <= 40"),
    "cached_calls": (cached_calls, LEDGER + "SELECT DISTINCT purpose, prompt_hash, substr(prompt_hash, 1, 8) AS response FROM l WHERE purpose < 'f'"),
    "retrieval_eval": (retrieval_eval, VECTORS + f", r AS (SELECT query_id, label, {RANKED} FROM s WHERE id % 50 <> 0 QUALIFY rank <= 5), t AS (SELECT vec_id AS query_id, label AS own FROM embeddings WHERE vec_id % 50 = 0), f AS (SELECT query_id, max((label = own)::INT) AS hit FROM r JOIN t USING (query_id) GROUP BY ALL) SELECT round(avg(hit), 6) AS hit_rate, count(*) AS n FROM f"),
    "list_tickets": (list_tickets, "SELECT doc_id AS id, source FROM documents WHERE source = 'src3' ORDER BY doc_id * 37 % 1000, doc_id LIMIT 20 OFFSET 5"),
    "ticket_by_id": (ticket_by_id, "SELECT doc_id AS id, source FROM documents WHERE doc_id = 7"),
    "ticket_predictions": (ticket_predictions, "SELECT event_id, user_id AS ticket_id, event_type AS task, value FROM events WHERE user_id = 5 AND event_type = 'click'"),
    "eval_runs": (eval_runs, R + "SELECT id, task, model_version, split FROM r WHERE task = 'click' ORDER BY started_at DESC, id LIMIT 25"),
    "latest_runs": (latest_runs, R + "SELECT id, task, model_version, split FROM r QUALIFY row_number() OVER (PARTITION BY task, split ORDER BY started_at DESC, id) = 1"),
    "latest_coherence": (latest_coherence, R + "SELECT task, round(arg_max(hit_rate, (started_at, -id)), 9) AS latest FROM r WHERE split <> 'latency' AND id % 4 <> 0 GROUP BY task"),
    "ticket_with_messages": (ticket_with_messages, f"SELECT doc_id AS id, source, (row_number() OVER (ORDER BY seq) - 1)::INT AS place, seq, author_role, m.text FROM documents JOIN ({MESSAGES}) m ON ticket_id = doc_id WHERE doc_id = 7"),
    "best_metrics": (best_metrics, R + "SELECT task, round(max(macro_f1), 9) AS best FROM r WHERE split <> 'latency' GROUP BY task"),
    "ranked_runs": (ranked_runs, R + "SELECT id, task, (rank() OVER (PARTITION BY task ORDER BY hit_rate DESC))::INT AS place FROM r WHERE split = 'test'"),
    "report_rows": (report_rows, R + "SELECT model_version, 'macro_f1' AS metric, count(*) AS n, round(avg(macro_f1), 6) AS mean FROM r WHERE task = 'click' AND split = 'val' GROUP BY ALL UNION ALL SELECT model_version, 'hit_rate', count(*), round(avg(hit_rate), 6) FROM r WHERE task = 'click' AND split = 'val' GROUP BY ALL"),
    "value_counts": (value_counts, R + "SELECT task, split, count(*) AS n FROM r GROUP BY ALL"),
    "latest_selected": (latest_selected, R + "SELECT id, task, model_version, split FROM r WHERE split = 'test' AND selected AND model_version LIKE 'baseline\\_%' ESCAPE '\\' QUALIFY row_number() OVER (PARTITION BY task ORDER BY started_at DESC, id) = 1"),
    "newest_predictions": (newest_predictions, "SELECT event_id AS id, event_type AS task FROM events WHERE event_type = 'error' ORDER BY ts DESC, id LIMIT 15"),
    "lowest_scored": (lowest_scored, "SELECT event_id AS id, value AS score FROM events WHERE event_type = 'error' AND user_id % 2 = 0 ORDER BY value, event_id LIMIT 15"),
    "latest_variants": (latest_variants, R + "SELECT id, task, model_version, split FROM r WHERE task = 'click' QUALIFY row_number() OVER (PARTITION BY model_version ORDER BY started_at DESC, id) = 1"),
    "customer_messages": (customer_messages, "SELECT conv_id AS ticket_id, turn AS seq FROM conversations WHERE role = 'user' AND conv_id % 2 = 0"),
    "texts_by_id": (texts_by_id, "SELECT conv_id AS ticket_id, turn AS seq, length(text)::INT AS n FROM conversations WHERE role IN ('user', 'assistant') AND conv_id % 5 = 0"),
}
