"""Connected components by contraction."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, lean

#: Edges that one task contracts, at most.
FEW = 100_000


def contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges of one partition, batch by batch, as stars round the least node of each part."""
    for batch in batches:
        parent: dict[int, int] = {}

        def root(x: int) -> int:
            while parent.setdefault(x, x) != x:
                parent[x] = x = parent[parent[x]]
            return x

        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            x, y = root(a), root(b)
            if x != y:
                parent[max(x, y)] = min(x, y)
        nodes = list(parent)
        yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([root(x) for x in nodes], pa.int64())], ["a", "b"])


def contract_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All edges of one partition as contract() does those of a batch."""
    held = [b for b in batches if b.num_rows]
    if held:
        yield from contract(pa.Table.from_batches(held).combine_chunks().to_batches())


def components(edges: DataFrame) -> DataFrame:
    """(node, label): every node of edges (a, b) with the least node that it reaches.

    Each round points every node to its least neighbour, follows the pointers to their roots, and keeps the edges between
    different roots; the nodes left at least halve. Rounds are cut by checkpoints. FEW edges or less are contracted by one task, for
    which rounds would only make many small files. Self-edges keep a node; no edges give no rows.
    """
    edges = cut(edges.select(F.col("a").cast("long"), F.col("b").cast("long")).mapInArrow(contract, "a long, b long").distinct())
    labels = None
    while True:
        few = edges.count() <= FEW
        if few:
            up = cut(edges.coalesce(1).mapInArrow(lean(contract_all), "a long, b long").toDF("a", "p"))
        else:
            both = edges.union(edges.select("b", "a"))
            up = cut(both.groupBy("a").agg(F.least("a", F.min("b")).alias("p")))
        while not few:  # jumps double, so a chain of any length ends at its root after a logarithm of them
            top = up.select(F.col("a").alias("p"), F.col("p").alias("q"))
            nearer = cut(up.join(top, "p").select("a", "p", "q"))
            up = nearer.select("a", F.col("q").alias("p"))
            if nearer.filter("p <> q").isEmpty():
                break
        jumped = up.toDF("x", "y")
        if labels is None:
            labels = cut(jumped.toDF("node", "label"))
        else:
            labels = cut(labels.join(jumped, F.col("label") == F.col("x"), "left").select("node", F.coalesce("y", "label").alias("label")))
        if few:
            return labels
        a = edges.join(jumped.toDF("a", "la"), "a").join(jumped.toDF("b", "lb"), "b")
        edges = cut(a.select(F.least("la", "lb").alias("a"), F.greatest("la", "lb").alias("b")).filter("a <> b").distinct())
        if edges.isEmpty():
            return labels
