"""Embedding and label drift between a reference and a live window."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import week_start

COSINE_ALARM, PSI_WATCH, PSI_ALARM, FLOOR = 0.05, 0.1, 0.25, 1e-6


def centroid(vectors: DataFrame, column: str = "embedding") -> DataFrame:
    """(dim, mean) of a column of equally long vectors."""
    return vectors.select(F.posexplode(column).alias("dim", "x")).groupBy("dim").agg(F.avg(F.col("x").cast("double")).alias("mean"))


def centroid_shift(reference: DataFrame, live: DataFrame, column: str = "embedding", empty: bool = False) -> DataFrame:
    """One row (shift, n_reference, n_live, alarm): 1 minus the cosine of the mean vectors; an empty side or a zero mean is an error.
    With empty, the shift and alarm of an empty side are null."""
    pair = centroid(reference, column).withColumnRenamed("mean", "r").join(centroid(live, column).withColumnRenamed("mean", "l"), "dim", "full")
    sums = pair.agg(F.sum(F.col("r") * F.col("l")).alias("dot"), F.sqrt(F.sum(F.col("r") ** 2)).alias("a"), F.sqrt(F.sum(F.col("l") ** 2)).alias("b"))
    counts = reference.agg(F.count("*").alias("n_reference")).crossJoin(live.agg(F.count("*").alias("n_live")))
    bad = F.coalesce(F.col("a") * F.col("b"), F.lit(0.0)) == 0
    missing = (F.col("n_reference") == 0) | (F.col("n_live") == 0) if empty else F.lit(False)
    shift = F.when(missing, F.lit(None).cast("double")).when(bad, F.raise_error(F.lit("an empty side or a zero centroid")).cast("double")).otherwise(1 - F.col("dot") / (F.col("a") * F.col("b")))
    return sums.crossJoin(counts).select(shift.alias("shift"), "n_reference", "n_live").withColumn("alarm", F.col("shift") > COSINE_ALARM)


def week_windows(rows: DataFrame, when: str, reference: str, live: tuple[str, ...]) -> tuple[DataFrame, DataFrame]:
    """The rows of the week that begins on the Monday reference, and those of the weeks live; an empty side is an error."""
    week = week_start(F.col(when)).cast("string")
    sides = rows.filter(week == reference), rows.filter(week.isin(*live))
    for side, name in zip(sides, ("reference", "live"), strict=True):
        if side.isEmpty():
            raise ValueError(f"no rows in the {name} window")
    return sides


def label_counts_of(predictions: DataFrame, tickets: DataFrame) -> DataFrame:
    """(label, n) of the predictions (ticket_id, label) of tickets (id), which a window or a source has chosen; null labels are left out."""
    return label_counts(predictions.join(tickets.select(F.col("id").alias("ticket_id")).distinct(), "ticket_id", "left_semi"), "label")


def label_counts(rows: DataFrame, label: str) -> DataFrame:
    return rows.filter(F.col(label).isNotNull()).groupBy(F.col(label).alias("label")).agg(F.count("*").alias("n"))


def distributions(reference: DataFrame, live: DataFrame) -> DataFrame:
    """(label, p_reference, p_live) over the labels of either side of (label, n)."""
    part = lambda df, name: df.crossJoin(F.broadcast(df.agg(F.sum("n").alias("all")))).select("label", (F.col("n") / F.col("all")).alias(name))  # noqa: E731  one row
    both = part(reference, "p_reference").join(part(live, "p_live"), "label", "full")
    return both.select("label", F.coalesce("p_reference", F.lit(0.0)).alias("p_reference"), F.coalesce("p_live", F.lit(0.0)).alias("p_live"))


def psi(reference: DataFrame, live: DataFrame) -> DataFrame:
    """One row (psi, status) from (label, n) of both sides."""
    r, q = F.greatest("p_reference", F.lit(FLOOR)), F.greatest("p_live", F.lit(FLOOR))
    total = distributions(reference, live).agg(F.sum((q - r) * F.log(q / r)).alias("psi"))
    return total.withColumn("status", F.when(F.col("psi") > PSI_ALARM, "alarm").when(F.col("psi") > PSI_WATCH, "watch").otherwise("stable"))


def drift_runs(scenarios: dict[str, tuple[DataFrame, DataFrame, DataFrame, DataFrame]]) -> DataFrame:
    """(scenario, metric, value) for scenarios of reference and live vectors, reference and live label counts."""
    out = None
    for name, (rv, lv, rl, ll) in scenarios.items():
        rows = centroid_shift(rv, lv).select(F.lit(name).alias("scenario"), F.lit("cosine_shift").alias("metric"), F.col("shift").alias("value"))
        rows = rows.unionByName(psi(rl, ll).select(F.lit(name).alias("scenario"), F.lit("psi").alias("metric"), F.col("psi").alias("value")))
        out = rows if out is None else out.unionByName(rows)
    return out
