"""Weekly volumes, the dense window, shares, leave-one-out z-scores and emerging topics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import week_start

MIN_HISTORY, MIN_TICKETS, MIN_Z, DENSE_SHARE, FLAT = 4, 5, 2.0, 0.10, 1e-9
OUTLIERS = "-1"


def weekly_counts(events: DataFrame) -> DataFrame:
    """(topic, week, count) of rows (topic, created_at); null times, null topics and outliers are left out."""
    kept = events.filter("created_at IS NOT NULL AND topic IS NOT NULL").filter(F.col("topic").cast("string") != OUTLIERS)
    return kept.groupBy("topic", week_start(F.col("created_at")).alias("week")).agg(F.count("*").alias("count"))


def weekly_totals(counts: DataFrame) -> DataFrame:
    return counts.groupBy("week").agg(F.sum("count").alias("total"))


def dense_window(totals: DataFrame) -> DataFrame:
    """(week, total) of the longest run of consecutive weeks with a tenth of the median total or more; the earliest of equals."""
    bar = totals.agg((F.median("total") * DENSE_SHARE).alias("bar"))
    dense = totals.crossJoin(F.broadcast(bar)).filter("total >= bar")  # one row
    run = F.date_sub("week", (F.row_number().over(Window.orderBy("week")) * 7).cast("int"))
    runs = dense.withColumn("run", run)
    best = runs.groupBy("run").agg(F.count("*").alias("n"), F.min("week").alias("first")).orderBy(F.desc("n"), "first").limit(1)
    return runs.join(F.broadcast(best.select("run")), "run", "left_semi").select("week", "total")


def topic_trends(counts: DataFrame) -> DataFrame:
    """(topic, week, count, share, z_score, is_emerging) for every topic on every week of the dense window."""
    window = dense_window(weekly_totals(counts))
    grid = counts.select("topic").distinct().crossJoin(window)
    points = grid.join(counts, ["topic", "week"], "left").withColumn("count", F.coalesce("count", F.lit(0)))
    points = points.withColumn("share", F.when(F.col("total") == 0, 0.0).otherwise(F.col("count") / F.col("total"))).drop("total")
    weeks = points.groupBy("topic").agg(F.collect_list(F.struct("week", "count", "share")).alias("p"))  # as many as the window has

    def step(a, y):
        """Running count, mean and sum of squared deviations: equal shares deviate by exactly 0."""
        n, d = a["n"] + 1, y["share"] - a["mean"]
        mean = a["mean"] + d / n
        return F.struct(n.alias("n"), mean.alias("mean"), (a["dev"] + d * (y["share"] - mean)).alias("dev"))

    none = F.struct(F.lit(0.0).alias("n"), F.lit(0.0).alias("mean"), F.lit(0.0).alias("dev"))
    others = lambda x: F.aggregate(F.filter("p", lambda y: y["week"] != x["week"]), none, step)
    out = weeks.select("topic", F.explode(F.transform("p", lambda x: F.struct(x["week"].alias("week"), x["count"].alias("count"), x["share"].alias("share"), others(x).alias("o")))).alias("x")).select("topic", "x.*")
    dev = F.sqrt(F.col("o.dev") / (F.col("o.n") - 1))
    z = (F.col("share") - F.col("o.mean")) / F.when(dev == 0, FLAT).otherwise(dev)
    out = out.withColumn("z_score", F.when(F.col("o.n") >= MIN_HISTORY, F.round(z, 6) + 0.0))
    return out.select("topic", "week", "count", "share", "z_score", F.coalesce((F.col("z_score") > MIN_Z) & (F.col("count") >= MIN_TICKETS), F.lit(False)).alias("is_emerging"))


def emerging(trends: DataFrame, catalog: DataFrame | None = None) -> DataFrame:
    """The flagged points; with a catalog (topic, label) each with its label, or `unlabeled`."""
    flagged = trends.filter("is_emerging")
    if catalog is None:
        return flagged
    return flagged.join(catalog.select("topic", "label"), "topic", "left").withColumn("label", F.coalesce("label", F.lit("unlabeled")))


def volume_series(trends: DataFrame, catalog: DataFrame) -> DataFrame:
    """(topic, label, points): each topic's points by week, with its label or `unlabeled`."""
    points = trends.groupBy("topic").agg(F.array_sort(F.collect_list(F.struct("week", "count", F.round("share", 6).alias("share"), "is_emerging"))).alias("points"))
    return points.join(catalog.select("topic", "label"), "topic", "left").withColumn("label", F.coalesce("label", F.lit("unlabeled")))


def largest_series(counts: DataFrame, n: int) -> DataFrame:
    """Rows of the n topics with the largest totals; ties by topic."""
    top = counts.groupBy("topic").agg(F.sum("count").alias("t")).orderBy(F.desc("t"), "topic").limit(n)
    return counts.join(top.select("topic"), "topic", "left_semi")
