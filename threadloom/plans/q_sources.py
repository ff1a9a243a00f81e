"""Queries of sources, sinks and classifiers. Files go to a new folder under the shared one."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import classify as G
from ..operators import sampling
from ..sources import tables as A
from ..sources import versions as V
from ..sources.shared import shared_dir
from .q_spans import G as SPANS_SQL
from .tables import table


def _folder(spark) -> str:
    return f"{shared_dir(spark)}/io-{uuid.uuid4().hex}"


def csv_posts(spark, d):
    e, path = table(spark, d, "events"), _folder(spark)
    e.select(
        F.col("event_id").cast("string").alias("tweet_id"), F.col("event_type").alias("author_id"), F.when(F.col("event_id") % 2 == 0, "True").otherwise("False").alias("inbound"), F.date_format("ts", "EEE MMM dd HH:mm:ss '+0000' yyyy").alias("created_at"),
        F.when(F.col("event_id") % 5 != 0, F.concat(F.lit('a "quoted", text\n'), F.col("props"))).alias("text"), F.lit("1, 2").alias("response_tweet_id"), F.col("user_id").cast("string").alias("in_response_to_tweet_id"),
    ).write.csv(path, header=True, escape='"')
    return A.read_posts(spark, path).select("id", "author", "inbound", "sent_at", F.length("text").alias("n"), F.size(T.parse_ids(F.col("child_ids"))).alias("children"), "parent_id")


def json_utterances(spark, d):
    docs, path = table(spark, d, "documents"), _folder(spark)
    half = F.floor(F.length("text") / 2).cast("int")  # the whole text, in two fields
    docs.select(F.lit("B").alias("flags"), F.substring("text", F.lit(1), half).alias("instruction"), F.col("lang").alias("category"), F.col("source").alias("intent"), F.substring("text", half + 1, F.length("text")).alias("response"), F.col("doc_id").cast("string").alias("id")).write.json(path)
    return A.read_utterances(spark, path, "id").select("ticket_id", "external_id", "seq", "author_role", "intent", F.length("text").alias("n"))


def labelled_texts(spark, d):
    docs = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id")
    split = F.when(F.col("doc_id") % 3 == 0, "validation").otherwise("train")
    return A.labelled_texts(docs.select(F.col("doc_id").alias("i"), "text", F.col("quality").alias("label"), split.alias("split")), "quality", ["poor", "good"]).select("id", "label", "split")


def pooled_sets(spark, d):
    m = table(spark, d, "conversations")
    p = A.pooled(even=m.filter("conv_id % 2 = 0").select("conv_id", "turn"), odd=m.filter("conv_id % 2 = 1").select("turn", "conv_id"))
    return p.groupBy("source").agg(F.count("*").alias("n"), F.sum("conv_id").alias("ids"))


def span_examples(spark, d):
    from .q_spans import rendered

    path = _folder(spark)
    r = rendered(spark, d).select(F.col("id").cast("string").alias("id"), "text", "entities", F.lit("template").alias("source"), F.lit("train").alias("split"), F.col("template_id").cast("string").alias("template_id"))
    A.write_examples(r, path)
    A.write_examples(r.filter("id % 10 = 0"), path, append=True)
    return A.read_examples(spark, path).groupBy("template_id").agg(F.count("*").alias("n"), F.sum(F.size("entities")).alias("spans"))


def insert_absent(spark, d):
    rows, path = table(spark, d, "events").select("event_id", "user_id", "event_type"), _folder(spark)
    A.insert_absent(rows.filter("event_id % 2 = 0"), path, ["event_id"])
    A.insert_absent(rows, path, ["event_id"])
    A.insert_absent(rows, path, ["event_id"])
    return A.existing(spark, path, rows).groupBy("event_type").agg(F.count("*").alias("n"), F.sum("event_id").alias("ids"))


def upserted(spark, d):
    e = table(spark, d, "events").select("event_id", "value")
    new = e.filter("event_id % 3 = 0").select((F.col("event_id") * 2).alias("event_id"), F.lit(1.5).alias("value"))
    return A.upserted(e, new, ["event_id"])


def _predictions(spark, d):
    return table(spark, d, "events").select(F.col("event_id").alias("ticket_id"), F.col("event_type").alias("task"), F.round("value", 4).alias("score"))


def replace_task(spark, d):
    p, path = _predictions(spark, d), _folder(spark)
    A.replace_task(p, path)
    for _ in range(2):  # a rerun changes nothing
        A.replace_task(p.filter("task = 'click' AND ticket_id % 2 = 0").withColumn("score", F.lit(0.5)), path)
    return spark.read.parquet(path).groupBy("task").agg(F.count("*").alias("n"), F.round(F.sum("score"), 2).alias("score"))


def replaced_for_tickets(spark, d):
    p = _predictions(spark, d)
    return A.replaced_for_tickets(p, p.filter("ticket_id % 7 = 0").withColumn("score", F.lit(0.25))).groupBy("task").agg(F.count("*").alias("n"), F.round(F.sum("score"), 2).alias("score"))


def _fails(df):
    """df as a write that fails in its tasks."""
    return df.withColumn("event_id", F.when(F.rand() >= 0, F.raise_error(F.lit("lost"))).otherwise(F.col("event_id")))


def upsert_table(spark, d):
    """Two upserts into one table, the second once again; a write that fails between them changes nothing."""
    e, path = table(spark, d, "events").select("event_id", "value"), _folder(spark)
    V.upsert(e, path, ["event_id"])
    new = e.filter("event_id % 3 = 0").select((F.col("event_id") * 2).alias("event_id"), F.lit(1.5).alias("value"))
    V.upsert(new, path, ["event_id"])
    try:
        V.publish(_fails(e), path)
    except Exception as error:
        if "lost" not in str(error):
            raise
    V.upsert(new, path, ["event_id"])
    return V.current(spark, path, e)


def replace_tickets_table(spark, d):
    p, path = _predictions(spark, d), _folder(spark)
    V.publish(p, path)
    for _ in range(2):  # a rerun changes nothing
        V.replace_for_tickets(p.filter("ticket_id % 7 = 0").withColumn("score", F.lit(0.25)), path)
    return V.current(spark, path, p).groupBy("task").agg(F.count("*").alias("n"), F.round(F.sum("score"), 2).alias("score"))


def split_tables(spark, d):
    """Splits of all documents, written and read back split by split."""
    docs, path = table(spark, d, "documents").select("doc_id", "lang", "text"), _folder(spark)
    rows = docs.withColumn("split", F.element_at(F.array(F.lit("train"), F.lit("val"), F.lit("test")), (F.col("doc_id") % 3 + 1).cast("int")))
    V.write_splits(rows, path)
    parts = [V.read_split(spark, path, rows, s).withColumn("read", F.lit(s)) for s in ("train", "val", "test")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).select("doc_id", "lang", "split", (F.col("split") == F.col("read")).alias("same"), F.md5(F.col("text").cast("binary")).alias("digest"))


def append_runs(spark, d):
    path = _folder(spark)
    runs = table(spark, d, "labels").groupBy("toxic").agg(F.count("*").alias("n"))
    A.append_run(runs, path)
    A.append_run(runs, path)
    return spark.read.parquet(path).filter("started_at IS NOT NULL").groupBy("toxic").agg(F.count("*").alias("rows"), F.sum("n").alias("n"))


def json_export(spark, d):
    m = table(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role"))).alias("messages"))
    return A.json_lines(m)


def embedding_table(spark, d):
    path = _folder(spark)
    e = table(spark, d, "embeddings")
    A.write_embeddings(e.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector")), path)
    back = spark.read.parquet(path).join(e, F.col("id") == F.col("vec_id"))
    return back.select("id", F.size("vector").alias("dims"), (F.col("vector") == F.col("embedding").cast("array<float>")).alias("same"))


def train_baseline(spark, d):
    docs = sampling.stratified_split(table(spark, d, "documents").select("doc_id", F.col("lang").alias("label"), "text"), "label", "doc_id")
    path = _folder(spark)
    A.append_run(G.eval_runs(G.train_job(docs), "language"), path)
    metrics = F.from_json("metrics", "split string, macro_f1 double, selected boolean")
    return spark.read.parquet(path).select("run_id", "task", "model_version", metrics.alias("m")).select("run_id", "task", "model_version", "m.*")


def sanitised_labels(spark, d):
    said = F.when(F.col("event_id") % 4 == 0, F.lit(" HIGH ")).when(F.col("event_id") % 4 == 1, "low").otherwise(F.col("event_type"))
    return table(spark, d, "events").select("event_id", G.sanitised(said).alias("label"))


EXAMPLES = SPANS_SQL + ", r AS (SELECT id, template_id FROM e UNION ALL SELECT id, template_id FROM e WHERE id % 10 = 0), c AS (SELECT doc_id AS id, count(*) AS c FROM g GROUP BY doc_id) SELECT template_id::VARCHAR AS template_id, count(*) AS n, sum(c)::BIGINT AS spans FROM r JOIN c USING (id) GROUP BY template_id".replace(", r AS", ", rr AS").replace("FROM r JOIN", "FROM rr JOIN")
E = "SELECT event_id AS ticket_id, event_type AS task, round(value, 4) AS score FROM events"
QUERIES = {
    "csv_posts": (csv_posts, "SELECT event_id::VARCHAR AS id, event_type AS author, event_id % 2 = 0 AS inbound, date_trunc('second', ts)::TIMESTAMP AS sent_at, CASE WHEN event_id % 5 = 0 THEN 0 ELSE length(props) + 17 END::INT AS n, 2 AS children, user_id::VARCHAR AS parent_id FROM events"),
    "json_utterances": (json_utterances, None),
    "labelled_texts": (labelled_texts, "SELECT 'quality_' || s || '_' || doc_id AS id, CASE quality WHEN 1 THEN 'good' ELSE 'poor' END AS label, s AS split FROM (SELECT doc_id, quality, CASE WHEN doc_id % 3 = 0 THEN 'val' ELSE 'train' END AS s FROM documents JOIN labels USING (doc_id))"),
    "pooled_sets": (pooled_sets, "SELECT CASE WHEN conv_id % 2 = 0 THEN 'even' ELSE 'odd' END AS source, count(*) AS n, sum(conv_id)::BIGINT AS ids FROM conversations GROUP BY ALL"),
    "span_examples": (span_examples, EXAMPLES),
    "insert_absent": (insert_absent, "SELECT event_type, count(*) AS n, sum(event_id)::BIGINT AS ids FROM events GROUP BY ALL"),
    "upserted": (upserted, "WITH n AS (SELECT event_id * 2 AS event_id, 1.5::DOUBLE AS value FROM events WHERE event_id % 3 = 0) SELECT event_id, value FROM events ANTI JOIN n USING (event_id) UNION ALL SELECT * FROM n"),
    "upsert_table": (upsert_table, "WITH n AS (SELECT event_id * 2 AS event_id, 1.5::DOUBLE AS value FROM events WHERE event_id % 3 = 0) SELECT event_id, value FROM events ANTI JOIN n USING (event_id) UNION ALL SELECT * FROM n"),
    "replace_task": (replace_task, f"SELECT task, count(*) AS n, round(sum(score), 2) AS score FROM (SELECT ticket_id, task, CASE WHEN task = 'click' THEN 0.5 ELSE score END AS score FROM ({E}) WHERE task <> 'click' OR ticket_id % 2 = 0) GROUP BY task"),
    "replaced_for_tickets": (replaced_for_tickets, f"SELECT task, count(*) AS n, round(sum(CASE WHEN ticket_id % 7 = 0 THEN 0.25 ELSE score END), 2) AS score FROM ({E}) GROUP BY task"),
    "replace_tickets_table": (replace_tickets_table, f"SELECT task, count(*) AS n, round(sum(CASE WHEN ticket_id % 7 = 0 THEN 0.25 ELSE score END), 2) AS score FROM ({E}) GROUP BY task"),
    "split_tables": (split_tables, "SELECT doc_id, lang, (['train', 'val', 'test'])[(doc_id % 3 + 1)::INT] AS split, true AS same, md5(text) AS digest FROM documents"),
    "append_runs": (append_runs, "SELECT toxic, 2::BIGINT AS rows, (2 * count(*))::BIGINT AS n FROM labels GROUP BY toxic"),
    "json_export": (json_export, "SELECT '{\"conv_id\":' || conv_id || ',\"messages\":[' || string_agg('{\"turn\":' || turn || ',\"role\":\"' || role || '\"}', ',' ORDER BY turn) || ']}' AS line FROM conversations GROUP BY conv_id"),
    "embedding_table": (embedding_table, "SELECT vec_id AS id, len(embedding)::INT AS dims, true AS same FROM embeddings"),
    "train_baseline": (train_baseline, None),
    "sanitised_labels": (sanitised_labels, "SELECT event_id, CASE WHEN event_id % 4 = 0 THEN 'high' WHEN event_id % 4 = 1 THEN 'low' ELSE 'medium' END AS label FROM events"),
}
