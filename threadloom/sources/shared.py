"""The folder that driver and executors share."""

from __future__ import annotations

import ctypes
import functools
import re
import tempfile
import uuid
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Bytes of an Arrow batch in registered queries.
BATCH = "4m"


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Where it is unset a session on one machine gets a temporary folder; on a cluster it is an error."""
    found, context = spark.conf.get("spark.checkpoint.dir", None), spark.sparkContext
    if not found:
        if not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", found)
    if not context._jsc.sc().getCheckpointDir().isDefined():
        context.setCheckpointDir(found)
    return found


def cut(df: DataFrame) -> DataFrame:
    """df, computed once and kept in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """df, written to the shared folder and read back. Unlike after cut(), what the optimizer knows of df's columns ends here: in
    loops that join a table with itself that knowledge grows with each round."""
    path = f"{shared_dir(df.sparkSession)}/stage-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def short_batches(spark: SparkSession) -> SparkSession:
    """spark, with Arrow batches of BATCH bytes where the session has Spark's own bound; for registered queries. Operators leave the
    session as it is."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name) in ("67108864b", "64m", "67108864"):
        spark.conf.set(name, BATCH)
    return spark


def give_back() -> None:
    """Returns what this Python worker has freed to the system; Spark keeps workers for later tasks, and idle ones would hold it."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc only
        trim(0)


def lean(f: Callable) -> Callable:
    """f, an iterator to an iterator, whose memory goes back at the end of each task."""

    @functools.wraps(f)
    def run(rows):
        try:
            yield from f(rows)
        finally:
            give_back()

    return run
