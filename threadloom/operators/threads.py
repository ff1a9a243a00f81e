"""Reply graphs to conversations, tickets, and the documents built from them."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.shared import cut, stored


def reply_edges(posts: DataFrame) -> DataFrame:
    """(src, dst): each post with its parent and with its listed children, without self-loops. Ends may be absent posts."""
    up = posts.filter("parent_id IS NOT NULL").select(F.col("parent_id").alias("src"), F.col("id").alias("dst"))
    down = posts.select(F.col("id").alias("src"), F.explode(T.parse_ids(F.col("child_ids"))).alias("dst"))
    return up.unionByName(down).filter("src <> dst").distinct()


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, root): the least node that each node reaches. Each round points every node to its least neighbour, follows the
    pointers by doubling jumps to their roots, and keeps the edges between different roots, until none is left."""
    edges = cut(edges.select(F.col("src").alias("a"), F.col("dst").alias("b")).filter("a <> b").distinct())
    labels = nodes.select("id").union(edges.select("a")).union(edges.select("b")).distinct().withColumn("root", F.col("id"))
    while not edges.isEmpty():
        both = edges.union(edges.select("b", "a"))
        up = cut(both.groupBy("a").agg(F.least("a", F.min("b")).alias("p")))
        while True:
            nearer = cut(up.join(up.select(F.col("a").alias("p"), F.col("p").alias("q")), "p").select("a", "p", "q"))
            up = nearer.select("a", F.col("q").alias("p"))
            if nearer.filter("p <> q").isEmpty():
                break
        jump = up.toDF("x", "y")
        labels = cut(labels.join(jump, F.col("root") == F.col("x"), "left").select("id", F.coalesce("y", "root").alias("root")))
        moved = edges.join(jump.toDF("a", "la"), "a").join(jump.toDF("b", "lb"), "b")
        edges = cut(moved.select(F.col("la").alias("a"), F.col("lb").alias("b")).filter("a <> b").distinct())
    return labels


def conversations(posts: DataFrame) -> DataFrame:
    """posts with root: the least id of its conversation among the posts that are present."""
    found = components(posts, reply_edges(posts))
    rooted = posts.join(found.withColumnRenamed("root", "label"), "id")
    return rooted.withColumn("root", F.min("id").over(Window.partitionBy("label"))).drop("label")


def conversation_summary(posts: DataFrame) -> DataFrame:
    """(root, brand, start_time, message_count, root_lang, confidence) of posts (root, id, author, inbound, sent_at, lang, confidence).

    brand: author of the first outbound post; lang: of the first inbound one. First is by time, nulls first, then id.
    """
    place = F.struct(F.coalesce(F.unix_micros(F.col("sent_at").cast("timestamp")), F.lit(-(2**62))).alias("t"), F.col("id"))
    return posts.groupBy("root").agg(
        F.min_by("author", F.when(~F.col("inbound"), place)).alias("brand"), F.min("sent_at").alias("start_time"), F.count("*").alias("message_count"),
        F.min_by("lang", F.when(F.col("inbound"), place)).alias("root_lang"), F.coalesce(F.min_by("confidence", F.when(F.col("inbound"), place)), F.lit(0.0)).alias("confidence"),
    )


def slice_of(posts: DataFrame, selected: DataFrame) -> DataFrame:
    return posts.join(selected.select("root").distinct(), "root", "left_semi")


def _stacks(posts: DataFrame) -> DataFrame:
    """(root, id, loop, stack) of posts (root, id, parent_id, sent_at).

    stack: of the keys (time, id) from the top of the thread down to the post, those that are greater than all keys after them.
    Taking the least ready post each time is the order of these arrays: below a post all lesser ones follow it at once. Stacks of two
    adjoining stretches of a path merge into one, so each round doubles the stretch. loop marks posts on or below a cycle, whose
    stack is their own key.
    """
    key = F.struct(F.coalesce(F.unix_micros(F.col("sent_at").cast("timestamp")), F.lit(-(2**62))).alias("t"), F.col("id").alias("i"))
    above = posts.select("root", F.col("id").alias("parent_id"), F.lit(True).alias("there")).distinct()
    up = F.when(F.col("there") & (F.col("parent_id") != F.col("id")), F.col("parent_id"))
    now = stored(posts.join(above, ["root", "parent_id"], "left").select("root", "id", up.alias("up"), F.array(key).alias("stack")))
    open_now, before = now.filter("up IS NOT NULL").count(), -1
    while open_now and open_now != before:
        top = now.select("root", F.col("id").alias("up"), F.col("up").alias("next"), F.col("stack").alias("over"))
        merged = F.when(F.col("over").isNotNull(), F.concat(F.filter("over", lambda x: x > F.col("stack")[0]), "stack")).otherwise(F.col("stack"))
        now = stored(now.join(top, ["root", "up"], "left").select("root", "id", F.col("next").alias("up"), merged.alias("stack")))
        before, open_now = open_now, now.filter("up IS NOT NULL").count()
    loop = F.col("up").isNotNull()
    return now.select("root", "id", loop.alias("loop"), F.when(loop, F.slice("stack", -1, 1)).otherwise(F.col("stack")).alias("stack"))


def order_posts(posts: DataFrame) -> DataFrame:
    """(root, id, place): 0-based order in each conversation: parents before children, of those ready the least by time, nulls
    first, and id; posts on or below cycles come last, by time and id.

    That is the order by time and id wherever no post then stands before its parent; only the other conversations are ordered by
    their stacks.
    """
    spot = Window.partitionBy("root").orderBy(F.col("sent_at").asc_nulls_first(), "id")
    fast = posts.select("root", "id", "parent_id", "sent_at", (F.row_number().over(spot) - 1).alias("place"))
    parents = fast.select("root", F.col("id").alias("parent_id"), F.col("place").alias("above"))
    late = fast.join(parents, ["root", "parent_id"]).filter("above > place").select("root").distinct()
    stacks = _stacks(posts.join(late, "root", "left_semi").select("root", "id", "parent_id", "sent_at"))
    slow = stacks.select("root", "id", (F.row_number().over(Window.partitionBy("root").orderBy("loop", "stack")) - 1).cast("long").alias("place"))
    return fast.join(late, "root", "left_anti").select("root", "id", F.col("place").cast("long")).unionByName(slow)


def dedup_messages(messages: DataFrame) -> DataFrame:
    """Messages of which no earlier one of the same ticket has the same content hash, renumbered from 0."""
    same = Window.partitionBy("ticket_id", "content_hash").orderBy("seq")
    kept = messages.withColumn("content_hash", T.content_hash(F.col("text"))).withColumn("nth", F.row_number().over(same)).filter("nth = 1").drop("nth")
    return kept.withColumn("seq", F.row_number().over(Window.partitionBy("ticket_id").orderBy("seq")) - 1)


def tickets(messages: DataFrame) -> DataFrame:
    """(ticket_id, created_at, lang, message_count, customer_messages, messages): messages nested in order."""
    nested = F.array_sort(F.collect_list(F.struct("seq", "author_role", "text", "sent_at", T.language_vote(F.col("text"))["lang"].alias("lang"))))
    t = messages.groupBy("ticket_id").agg(nested.alias("messages"), F.min("sent_at").alias("created_at"), F.count("*").alias("message_count"), F.count_if(F.col("author_role") == "customer").alias("customer_messages"))
    return t.withColumn("lang", F.col("messages")[0]["lang"])


def ticket_uuid(source: str, external_id: str) -> uuid.UUID:
    return uuid.uuid5(uuid.UUID(T.NAMESPACE), f"ticket:{source}:{external_id}")


def _joined(messages: DataFrame, what, sep: str, name: str) -> DataFrame:
    ordered = F.array_sort(F.collect_list(F.struct("seq", what.alias("t"))))
    return messages.groupBy("ticket_id").agg(F.array_join(F.transform(ordered, lambda m: m["t"]), sep).alias(name))


def customer_documents(messages: DataFrame) -> DataFrame:
    return _joined(messages.filter("author_role = 'customer'"), F.col("text"), "\n", "document")


def dialogues(messages: DataFrame) -> DataFrame:
    return _joined(messages, F.concat(F.initcap("author_role"), F.lit(": "), F.col("text")), "\n", "dialogue")


def first_customer_message(messages: DataFrame) -> DataFrame:
    customer = F.when(F.col("author_role") == "customer", F.col("seq"))
    return messages.groupBy("ticket_id").agg(F.coalesce(F.min_by("text", customer), F.min_by("text", "seq")).alias("opening"))


def multi_message(messages: DataFrame, least: int = 2, role: str | None = None) -> DataFrame:
    rows = messages.filter(F.col("author_role") == role) if role else messages
    return rows.groupBy("ticket_id").agg(F.count("*").alias("n")).filter(F.col("n") >= least)


def lead_k(dialogue, k: int = 4):
    """The first k non-blank lines joined by a space."""
    if k < 1:
        raise ValueError("k must be at least 1")
    return F.array_join(F.slice(F.filter(F.split(dialogue, "\n"), lambda x: F.trim(x) != ""), 1, k), " ")


def thread_summaries(messages: DataFrame, summarise=lead_k) -> DataFrame:
    """Prediction rows (ticket_id, task, label, message_count) of tickets with two messages or more; summarise: Column to Column."""
    long = multi_message(messages)
    return dialogues(messages).join(long, "ticket_id").select("ticket_id", F.lit("thread_summary").alias("task"), summarise(F.col("dialogue")).alias("label"), F.col("n").alias("message_count"))


def index_records(messages: DataFrame) -> DataFrame:
    """(id, document, metadata): what retrieval indexes of a ticket."""
    d = dialogues(messages).join(messages.groupBy("ticket_id").agg(F.min("sent_at").alias("created_at")), "ticket_id")
    meta = F.to_json(F.struct(F.lit("ticket").alias("source"), F.date_format("created_at", "yyyy-MM-dd HH:mm:ss").alias("created_at")))
    return d.select(F.col("ticket_id").alias("id"), F.col("dialogue").alias("document"), meta.alias("metadata"))


def article_body(intro, steps, footer):
    numbered = F.transform(steps, lambda s, i: F.concat((i + 1).cast("string"), F.lit(". "), s))
    return F.concat_ws("\n", intro, F.array_join(numbered, "\n"), footer)


def trajectories(messages: DataFrame, sentiment: DataFrame, urgency: DataFrame) -> DataFrame:
    """(ticket_id, sequence, scores, final_customer_label, resolution_quality) from per-message sentiment (ticket_id, seq,
    label, score) and per-ticket urgency (ticket_id, urgency_label); tickets without a scored message give no row."""
    rows = messages.join(sentiment, ["ticket_id", "seq"])
    value = T.signed(F.col("label"), F.col("score"))
    ordered = F.array_sort(F.collect_list(F.struct("seq", "label", value.alias("v"))))
    customer = F.when(F.col("author_role") == "customer", F.col("seq"))
    t = rows.groupBy("ticket_id").agg(
        ordered.alias("m"), F.coalesce(F.max_by("label", customer), F.max_by("label", "seq")).alias("final_customer_label"), F.coalesce(F.max_by(value, customer), F.max_by(value, "seq")).alias("final"),
    )
    weight = F.when(F.col("urgency_label") == "high", 1.0).when(F.col("urgency_label") == "medium", 0.66).when(F.col("urgency_label") == "low", 0.33).otherwise(F.raise_error(F.concat(F.lit("unknown urgency "), "urgency_label")).cast("double"))
    t = t.join(urgency, "ticket_id")
    return t.select("ticket_id", F.transform("m", lambda x: x["label"]).alias("sequence"), F.transform("m", lambda x: x["v"]).alias("scores"), "final_customer_label", (F.col("final") * weight).alias("resolution_quality"))


def trajectory_predictions(trajectory: DataFrame, urgency: DataFrame, model_version: str, urgency_version: str) -> DataFrame:
    """Rows (ticket_id, task, label, score, payload, model_version) of trajectories() and urgency (ticket_id, urgency_label,
    urgency_score), to be written with replace_task(); payload is JSON and null values stay in it."""
    both = trajectory.join(urgency, "ticket_id")
    parts = F.struct("sequence", "scores", "final_customer_label", "resolution_quality", "urgency_label", "urgency_score", F.lit(urgency_version).alias("urgency_model_version"))
    return both.select(
        "ticket_id", F.lit("sentiment_trajectory").alias("task"), F.col("final_customer_label").alias("label"), F.col("resolution_quality").alias("score"),
        F.to_json(parts, {"ignoreNullFields": "false"}).alias("payload"), F.lit(model_version).alias("model_version"),
    )


def resolved(trajectory: DataFrame) -> DataFrame:
    return trajectory.filter("resolution_quality > 0")


def resolved_with_messages(trajectory: DataFrame, tickets: DataFrame, messages: DataFrame, source: str, limit: int) -> DataFrame:
    """Tickets (id, source, ingested_at) of a source that are resolved, the oldest `limit`, each with its messages in order."""
    some = tickets.filter(F.col("source") == source).join(resolved(trajectory).select(F.col("ticket_id").alias("id")), "id", "left_semi")
    return with_messages(some.orderBy("ingested_at", "id").limit(limit), messages)


def with_messages(tickets: DataFrame, messages: DataFrame) -> DataFrame:
    """tickets with messages: an array of (seq, author_role, text) in order, empty where there is none."""
    few = messages.join(tickets.select(F.col("id").alias("ticket_id")), "ticket_id", "left_semi")
    nested = few.groupBy(F.col("ticket_id").alias("id")).agg(F.array_sort(F.collect_list(F.struct("seq", "author_role", "text"))).alias("messages"))
    return tickets.join(nested, "id", "left").withColumn("messages", F.coalesce("messages", F.array().cast(nested.schema["messages"].dataType)))
