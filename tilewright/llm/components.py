"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W
from .scratch import Scratch

#: So many edges (16 bytes each) at most are read by one task, instead of several shuffles for each step.
ONE_TASK = 1 << 19


def least_reached(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges -> their nodes, ascending, and of each the smallest one that it reaches."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    i, j = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while len(i):
        x, y = root[i], root[j]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while not np.array_equal(up := root[root], root):
            root = up
        apart = root[i] != root[j]
        i, j = i[apart], j[apart]
    return nodes, nodes[root]


def _in_one_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All edges (a, b) -> (node, component)."""
    none = np.empty(0, np.int64)
    a, b = (np.concatenate(x) for x in zip((none, none), *((batch.column(0).to_numpy(), batch.column(1).to_numpy()) for batch in batches)))
    yield pa.RecordBatch.from_arrays([pa.array(x) for x in least_reached(a, b)], names=["node", "component"])


def connected_components(edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """edges(a, b) of longs -> (node, component): the smallest id that the node reaches.

    Each step is two grouped minima and a join, all keyed by node; the minima
    combine on the map side, so a hub costs no more than its links. The edges
    of a step are a written table. Up to ONE_TASK edges are read by one task
    instead; edges, which are counted first, should be a written table. Nodes
    without an edge are absent, as are loops and nulls; repeated edges count
    once.
    """
    edges = edges.select("a", "b").where("a != b")
    if edges.limit(ONE_TASK + 1).count() <= ONE_TASK:
        return edges.coalesce(1).mapInArrow(W.tidied(_in_one_task), "node long, component long")
    e = scratch.table(f"{name}0", edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct())
    mark, step = None, 0
    while True:
        both = e.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(e.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("m").alias("a"), F.col("v").alias("b"))
        low = large.groupBy("b").agg(F.min("a").alias("m"))
        small = large.join(low, "b").select("m", F.explode(F.array("a", "b")).alias("v"))
        new = small.where("m < v").select(F.col("m").alias("a"), F.col("v").alias("b")).distinct()
        e_new = scratch.table(f"{name}{step + 1}", new)
        now = e_new.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        scratch.drop(f"{name}{step}")
        e, step = e_new, step + 1
        if now == mark:
            break
        mark = now
    return e.select(F.col("b").alias("node"), F.col("a").alias("component")).unionByName(e.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct())
