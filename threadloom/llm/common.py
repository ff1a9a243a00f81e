"""What the corpus operators share: tables, row keys, and the folder that driver and executors both see."""

from __future__ import annotations

import ctypes
import gc
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


#: Bytes of an Arrow batch in registered queries.
BATCH = "4m"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, a folder that driver and executors share. Where that is unset a session on one machine, as in
    tests, gets a temporary folder; on a cluster it is an error, for executors would write to disks of their own."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if not found:
        if not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", found)
    if not context._jsc.sc().getCheckpointDir().isDefined():
        context.setCheckpointDir(found)
    return found


def slices(batches: Iterator[pa.RecordBatch], rows: int = 500) -> Iterator[pa.RecordBatch]:
    """The batches in pieces of a few rows, so that what is made of a piece is small; Spark bounds the batches' own bytes."""
    for b in batches:
        for i in range(0, b.num_rows, rows):
            yield b.slice(i, rows)


def give_back() -> None:
    """Returns what this Python worker has freed to the system. Spark keeps workers, two or more a core, for later tasks, and
    what an idle one still holds is missing to the others of its executor."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc only
        trim(0)


def lean(f: Callable) -> Callable:
    """f, an iterator of batches to an iterator of batches, whose memory goes back at the end of each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from f(batches)
        finally:
            give_back()

    return run


def lean_group(f: Callable) -> Callable:
    """f, a group's table to a table, whose memory goes back after each group."""

    def run(group: pa.Table) -> pa.Table:
        try:
            return f(group)
        finally:
            give_back()

    return run


def lean_cogroup(f: Callable) -> Callable:
    """f, the tables of two groups to a table, whose memory goes back after each pair."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        try:
            return f(left, right)
        finally:
            give_back()

    return run


def cut(df: DataFrame) -> DataFrame:
    """df, computed once and kept in the shared checkpoint folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def freed(spark: SparkSession) -> None:
    """Spark removes shuffle files of what nothing refers to only when the driver collects its garbage, which one with much memory does
    seldom; now it does."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def stage(df: DataFrame) -> DataFrame:
    """df, written once as Parquet under the shared folder and read back: lineage ends, columns can be pruned."""
    path = f"{shared_dir(df.sparkSession)}/stage-{uuid.uuid4().hex}"
    df.write.parquet(path)
    freed(df.sparkSession)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _new_table(spark: SparkSession, kind: str) -> str:
    base = "stage_" + re.sub(r"\W", "_", spark.sparkContext.applicationId)
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {base} LOCATION '{shared_dir(spark)}/{base}'")
    return f"{base}.{kind}_{uuid.uuid4().hex}"


def tabled(df: DataFrame) -> tuple[DataFrame, str]:
    """As stage(), but a table, and its name: discard() frees it before the run's end."""
    spark = df.sparkSession
    name = _new_table(spark, "rows")
    df.write.format("parquet").saveAsTable(name)
    gc.collect()
    return spark.table(name), name


def bucketed(df: DataFrame, *keys: str) -> tuple[DataFrame, str]:
    """df, written once under the shared folder as a table bucketed by keys, and the table's name: later joins on keys read it
    where it lies and shuffle their other side only. discard() frees it; else it stays as long as the folder does."""
    spark = df.sparkSession
    name, n = _new_table(spark, "buckets"), int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.repartition(n, *keys).write.bucketBy(n, *keys).option("compression", "zstd").format("parquet").saveAsTable(name)
    return spark.table(name), name


def discard(spark: SparkSession, name: str) -> None:
    """Drops a table of bucketed() or tabled(), with its files, once nothing that is still to run reads it."""
    spark.sql(f"DROP TABLE IF EXISTS {name}")


def short_batches(spark: SparkSession) -> SparkSession:
    """spark, with Arrow batches of BATCH bytes where the session has Spark's own bound; for registered queries and the pipeline,
    whose tasks hold several batches at once. Operators leave the session as it is."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name) in ("67108864b", "64m", "67108864"):
        spark.conf.set(name, BATCH)
    return spark


def row_key(id_col: str = "doc_id", text_col: str = "text") -> list[Column]:
    """Two columns k1, k2 that tell texts of rows apart, null and repeated ids included; equal pairs have equal texts."""
    ident = F.col(id_col)
    return [F.coalesce(ident.cast("long"), F.lit(-1)).alias("k1"), F.xxhash64(ident.isNull(), F.col(text_col)).alias("k2")]


def held_out(id_col: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo 4, is 2; a null id counts as an empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 4 == 2


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased, every other character as it is."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def let(value: Column, body) -> Column:
    """body(value) with value computed once a row, whatever the optimiser merges."""
    return F.element_at(F.transform(F.array(value), body), 1)
