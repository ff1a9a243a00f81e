"""Read queries over tickets, predictions and evaluation runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .threads import with_messages

MAX_PAGE, MAX_RUNS = 200, 500


def list_tickets(tickets: DataFrame, source: str | None = None, limit: int = 50, offset: int = 0, messages: DataFrame | None = None) -> DataFrame:
    """A page of tickets, the oldest first; with messages, each with its own nested in order."""
    rows = tickets.filter(F.col("source") == source) if source else tickets
    page = rows.orderBy("ingested_at", "id").offset(offset).limit(min(limit, MAX_PAGE))
    return page if messages is None else with_messages(page, messages)


def ticket(tickets: DataFrame, ident, messages: DataFrame | None = None) -> DataFrame:
    one = tickets.filter(F.col("id") == ident)
    return one if messages is None else with_messages(one, messages)


def predictions_of(predictions: DataFrame, ticket_id, task: str | None = None) -> DataFrame:
    rows = predictions.filter(F.col("ticket_id") == ticket_id)
    return rows.filter(F.col("task") == task) if task else rows


def eval_runs(runs: DataFrame, task: str | None = None, model: str | None = None, limit: int = 100) -> DataFrame:
    for c, v in (("task", task), ("model_version", model)):
        runs = runs.filter(F.col(c) == v) if v else runs
    return runs.orderBy(F.desc("started_at"), "id").limit(min(limit, MAX_RUNS))


def latest_by(runs: DataFrame, keys: list[str], when: str = "started_at") -> DataFrame:
    """The newest run of each key; of equal times the least id."""
    place = F.struct(F.col(when), (-F.col("id")).alias("n"))
    rest = [c for c in runs.columns if c not in keys]
    return runs.groupBy(*keys).agg(F.max_by(F.struct(*rest), place).alias("r")).select(*keys, "r.*")


def best_metric(runs: DataFrame, name: str) -> DataFrame:
    """(task, best) of a metric, latency runs left out."""
    return runs.filter("split <> 'latency'").groupBy("task").agg(F.max(F.col("metrics")[name]).alias("best"))


def latest_metric(runs: DataFrame, name: str) -> DataFrame:
    """(task, latest) of a metric: that of each task's newest run that has it, latency runs left out; of equal times the least id."""
    has = runs.filter("split <> 'latency'").withColumn("latest", F.col("metrics")[name]).filter("latest IS NOT NULL")
    return latest_by(has, ["task"]).select("task", "latest")


def ranked_runs(runs: DataFrame, name: str, where: Column | None = None) -> DataFrame:
    rows = runs.filter(where) if where is not None else runs
    return rows.select("*", F.col("metrics")[name].alias("value")).withColumn("place", F.rank().over(Window.partitionBy("task").orderBy(F.desc("value"))))


def report_rows(runs: DataFrame, task: str, split: str) -> DataFrame:
    return runs.filter((F.col("task") == task) & (F.col("split") == split)).select("model_version", F.explode("metrics").alias("metric", "value"))


def value_counts(rows: DataFrame, *by: str) -> DataFrame:
    return rows.groupBy(*by).agg(F.count("*").alias("n"))


def latest_selected(runs: DataFrame) -> DataFrame:
    return latest_by(runs.filter("split = 'test' AND selected").filter(F.col("model_version").startswith("baseline_")), ["task"])


def newest(predictions: DataFrame, task: str, n: int) -> DataFrame:
    return predictions.filter(F.col("task") == task).orderBy(F.desc("created_at"), "id").limit(n)


def lowest_scored(predictions: DataFrame, task: str, model: str, n: int) -> DataFrame:
    return predictions.filter((F.col("task") == task) & (F.col("model_version") == model)).orderBy("score", "id").limit(n)


def customer_messages(messages: DataFrame, tickets: DataFrame, source: str) -> DataFrame:
    return messages.filter("author_role = 'customer'").join(tickets.filter(F.col("source") == source).select(F.col("id").alias("ticket_id")), "ticket_id", "left_semi")


def texts_of(messages: DataFrame, ids: DataFrame) -> DataFrame:
    return messages.join(ids.select("ticket_id").distinct(), "ticket_id", "left_semi")
