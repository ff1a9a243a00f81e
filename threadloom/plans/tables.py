"""The driver's tables in the roles that the operators expect."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conversations as messages: ticket_id, seq, author_role, text, sent_at; system turns are left out."""
    c = table(spark, sf_dir, "conversations")
    return c.filter(F.col("role").isin("user", "assistant")).select(
        F.col("conv_id").alias("ticket_id"), F.col("turn").alias("seq"), F.when(F.col("role") == "user", "customer").otherwise("agent").alias("author_role"), "text",
        (F.lit("2024-01-01 00:00:00").cast("timestamp") + F.make_interval(hours=F.col("conv_id").cast("int"), mins=F.col("turn").cast("int"))).alias("sent_at"),
    )


MESSAGES = """
  SELECT conv_id AS ticket_id, turn AS seq, CASE WHEN role = 'user' THEN 'customer' ELSE 'agent' END AS author_role, text,
         TIMESTAMP '2024-01-01 00:00:00' + to_hours(conv_id) + to_minutes(turn) AS sent_at
  FROM conversations WHERE role IN ('user', 'assistant')"""


def sentiment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sentiment for each message, from its text alone: label by length, score in (0, 1)."""
    n = F.length("text")
    return messages(spark, sf_dir).select("ticket_id", "seq", F.element_at(F.array(F.lit("negative"), F.lit("neutral"), F.lit("positive")), (n % 3 + 1).cast("int")).alias("label"), ((n % 97 + 1) / 100).alias("score"))


SENTIMENT = f"""
  SELECT ticket_id, seq, (['negative', 'neutral', 'positive'])[(length(text) % 3 + 1)::INT] AS label, (length(text) % 97 + 1) / 100 AS score
  FROM ({MESSAGES})"""


def topic_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as topic predictions with a time: topic, created_at."""
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("ticket_id"), F.col("event_type").alias("topic"), F.col("ts").alias("created_at"))


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as evaluation runs: id, task, model_version, split, metrics, started_at."""
    e = table(spark, sf_dir, "events")
    split = F.element_at(F.array(F.lit("train"), F.lit("val"), F.lit("test")), (F.col("user_id") % 3 + 1).cast("int"))
    version = F.concat(F.when(F.col("event_id") % 2 == 0, "baseline_v").otherwise("model_v"), (F.col("event_id") % 5).cast("string"))
    return e.select(F.col("event_id").alias("id"), F.col("event_type").alias("task"), version.alias("model_version"), split.alias("split"), F.create_map(F.lit("macro_f1"), F.col("value") / 1000, F.lit("hit_rate"), (F.col("event_id") % 101) / 100.0).alias("metrics"), (F.col("event_id") % 3 == 0).alias("selected"), F.col("ts").alias("started_at"))


RUNS = """
  SELECT event_id AS id, event_type AS task, (CASE WHEN event_id % 2 = 0 THEN 'baseline_v' ELSE 'model_v' END) || (event_id % 5)::VARCHAR AS model_version,
         (['train', 'val', 'test'])[(user_id % 3 + 1)::INT] AS split, value / 1000 AS macro_f1, (event_id % 101) / 100.0::DOUBLE AS hit_rate, event_id % 3 = 0 AS selected, ts AS started_at
  FROM events"""
