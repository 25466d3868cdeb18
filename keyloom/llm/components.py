"""Connected components of an edge table: union-find within tasks, then large-star and small-star rounds.

Defined results: loops (a = b) and repeated edges change nothing, no edges give no rows, and nulls are not
allowed. Every task first replaces its edges by a spanning forest of them. What is left goes through rounds
of distributed star operations until every node hangs on the least of its component. Edges that fit
a checked bound (a constant, whatever the input) go through one more union-find instead.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import Scratch, lean

ROUNDS = 60
#: Edges of 16 bytes that one task may hold (16 MB): up to so many are grouped by one union-find.
ONE_TASK = 1_000_000


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each node of the edges with the least node of its component, but for those that are it."""
    nodes, index = np.unique(np.concatenate([a, b]), return_inverse=True)
    parent = np.arange(len(nodes))
    x, y = index[: len(a)], index[len(a) :]
    while True:  # hook the larger root under the smaller, then halve the paths until all are flat
        u, v = parent[x], parent[y]
        if not (u != v).any():
            break
        np.minimum.at(parent, np.maximum(u, v), np.minimum(u, v))
        while (parent != parent[parent]).any():
            parent = parent[parent]
    hang = np.flatnonzero(parent != np.arange(len(nodes)))
    return nodes[parent[hang]], nodes[hang]


def _forests(edges: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = np.zeros(0, np.int64), np.zeros(0, np.int64)
        held: list[list[np.ndarray]] = [[a], [b]]
        size = 0
        for batch in batches:
            for own, column in zip(held, batch.columns, strict=True):
                own.append(column.to_numpy())
            size += batch.num_rows
            if size > ONE_TASK:  # memory stays bounded by the nodes of one task
                a, b = forest(np.concatenate(held[0]), np.concatenate(held[1]))
                held, size = [[a], [b]], 0
        a, b = forest(np.concatenate(held[0]), np.concatenate(held[1]))
        for i in range(0, len(a), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(a[i : i + (1 << 16)]), pa.array(b[i : i + (1 << 16)])], names=["a", "b"])

    return edges.select(F.col("a").cast("long"), F.col("b").cast("long")).mapInArrow(lean(run), "a long, b long")


def _both(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))


def _to_least(scratch: Scratch, near: DataFrame, larger_only: bool) -> tuple[DataFrame, DataFrame]:
    """Link the neighbours of each node to the least of them. The minima are a table of their own, so a hub's rows can be split over tasks."""
    least = scratch.save(near.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")))
    out = near.join(least, "u")
    out = out.where("v > u") if larger_only else out
    return out.select(F.greatest("v", "m").alias("b"), F.least("v", "m").alias("a")).where("a < b"), least


def _settled(edges: DataFrame) -> bool:
    """Whether every node hangs on one node that hangs on none: a count and two sums are all that reach the driver."""
    roles = edges.select(F.col("b").alias("v"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(edges.select(F.col("a").alias("v"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    by_node = roles.groupBy("v").agg(F.sum("up").alias("ups"), F.max("down").alias("downs"))
    return not by_node.where("ups > 1 or (ups = 1 and downs = 1)").limit(1).count()


def components(scratch: Scratch, edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (columns a, b: no nulls); a component is named by its least node.

    Rounds end when every node hangs on the least of its component. Edges never grow in number.
    """
    now = scratch.save(_forests(edges.where("a != b")))
    one_task = now.count() <= ONE_TASK
    if one_task:
        now = scratch.save(_forests(now.coalesce(1)))
    for _ in range(ROUNDS):
        if one_task or _settled(now):
            break
        large, least_l = _to_least(scratch, _both(now), True)
        mid = scratch.save(large.select("a", "b").distinct())
        small, least_s = _to_least(scratch, mid.select(F.col("b").alias("u"), F.col("a").alias("v")), False)
        hang = least_s.select(F.greatest("u", "m").alias("b"), F.least("u", "m").alias("a")).where("a < b")
        new = scratch.save(small.select("a", "b").unionByName(hang.select("a", "b")).distinct())
        for old in (now, least_l, mid, least_s):
            scratch.drop(old)
        now = new
    else:
        raise RuntimeError(f"components did not settle in {ROUNDS} rounds")
    return now.select(F.col("b").alias("node"), F.col("a").alias("component")).unionByName(now.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct())
