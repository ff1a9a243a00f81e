"""Tables that are replaced as a whole: each write is a new folder, and the newest one that Spark has finished is the table.

Spark puts _SUCCESS into a folder after all tasks of its job have committed. A write that fails, or whose executors are lost for good,
leaves a folder without it, which no reader takes, so readers see the old rows or the new ones and never a part of either.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def versions(spark: SparkSession, path: str) -> list[tuple[int, bool]]:
    """(number, finished) of each version of the table at path, ascending."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    if not store.exists(folder):
        return []
    found = []
    for entry in store.listStatus(folder):
        name = entry.getPath().getName()
        if number := re.fullmatch(r"v(\d{10})", name):
            found.append((int(number.group(1)), store.exists(spark._jvm.org.apache.hadoop.fs.Path(entry.getPath(), "_SUCCESS"))))
    return sorted(found)


def current(spark: SparkSession, path: str, like: DataFrame) -> DataFrame:
    """The rows of the newest finished version; without one, none, with like's columns."""
    done = [number for number, finished in versions(spark, path) if finished]
    return spark.read.schema(like.schema).parquet(f"{path}/v{done[-1]:010d}").select(*like.columns) if done else like.limit(0)


def publish(df: DataFrame, path: str, partition_by: tuple[str, ...] = ()) -> None:
    """Writes df as the next version. Of two that write at once, the second to begin fails and changes nothing."""
    taken = [number for number, _ in versions(df.sparkSession, path)]
    df.write.mode("errorifexists").partitionBy(*partition_by).parquet(f"{path}/v{(taken[-1] if taken else 0) + 1:010d}")


def _without(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """old's rows whose keys new lacks; nulls are equal."""
    gone = new.select(*[F.col(k).alias(f"_new_{k}") for k in keys]).distinct()
    same = None
    for k in keys:
        equal = F.col(k).eqNullSafe(F.col(f"_new_{k}"))
        same = equal if same is None else same & equal
    return old.join(gone, same, "left_anti")


def upsert(new: DataFrame, path: str, keys: list[str]) -> None:
    """Rows of new take the place of those of equal keys, null ones too, or are added; once again changes nothing.

    Of several rows of new with equal keys the greatest stays, by the other columns from the left, null least.
    """
    others = [c for c in new.columns if c not in keys]
    one = new.groupBy(*keys).agg(F.max(F.struct(*others)).alias("_row")).select(*keys, "_row.*").select(*new.columns) if others else new.distinct()
    publish(_without(current(new.sparkSession, path, new), one, keys).unionByName(one), path)


def replace_for_tickets(new: DataFrame, path: str) -> None:
    """All rows of new's (task, ticket_id) go and new's come, repeated ones as often as they are there; other rows stay."""
    publish(_without(current(new.sparkSession, path, new), new, ["task", "ticket_id"]).unionByName(new), path)


def write_splits(df: DataFrame, path: str) -> None:
    """df (..., split) as the next version, a folder a split, so that a reader of one split opens no other."""
    publish(df, path, ("split",))


def read_split(spark: SparkSession, path: str, like: DataFrame, split: str) -> DataFrame:
    return current(spark, path, like).filter(F.col("split") == split)
