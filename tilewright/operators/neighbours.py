"""Exact nearest neighbours: a stated set of query vectors, in blocks, against all rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..shipping import ship

#: Query vectors sent to the executors at once.
BLOCK = 2048


def _blocks(queries: DataFrame) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    ids: list[int] = []
    vectors: list[list[float]] = []
    for r in queries.toLocalIterator():
        ids.append(r[0])
        vectors.append(r[1])
        if len(ids) == BLOCK:
            yield np.array(ids, np.int64), np.array(vectors, np.float64)
            ids, vectors = [], []
    if ids:
        yield np.array(ids, np.int64), np.array(vectors, np.float64)


def _closest(q: np.ndarray, x: np.ndarray, k: int, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(query, row) of all rows that may be among the k nearest of a query: by one matrix product, with room for its rounding. own marks rows that don't count."""
    d = (q**2).sum(1)[:, None] + (x**2).sum(1) - 2 * (q @ x.T)
    d[own] = np.inf
    if d.shape[1] > k:
        last = np.partition(d, k - 1, axis=1)[:, k - 1 : k]
        scale = (q**2).sum(1)[:, None] + (x**2).sum(1).max()
        near = d <= last + 1e-9 * scale
    else:
        near = np.ones(d.shape, bool)
    return np.nonzero(near & ~own)


def nearest(rows: DataFrame, queries: DataFrame, k: int, itself: bool = True) -> DataFrame:
    """rows(id, features, label), queries(id, features) -> (query, id, label, distance, rank): the k nearest rows of each query by Euclidean distance, ties by id. Without itself, rows with the query's id don't count.

    Each task keeps the k best of its rows for every query of the block, so
    what is shuffled is k rows per query and task, whatever the number of rows.
    """
    ship(rows.sparkSession)
    kind = rows.schema["label"].dataType.simpleString()

    def search(qid: np.ndarray, q: np.ndarray):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            found = (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))  # query, id, distance
            labels: dict[int, object] = {}
            for batch in batches:
                for a in range(0, batch.num_rows, 2048):
                    part = batch.slice(a, 2048)
                    ids = part.column(0).to_numpy().astype(np.int64)
                    x = np.array(part.column(1).to_pylist(), np.float64)
                    own = np.zeros((len(qid), len(ids)), bool) if itself else qid[:, None] == ids
                    i, j = _closest(q, x, k, own)
                    d = np.concatenate([np.sqrt(((x[j[s : s + 65536]] - q[i[s : s + 65536]]) ** 2).sum(axis=1)) for s in range(0, len(i), 65536)] or [np.empty(0)])
                    every = [np.concatenate(y) for y in zip(found, (i, ids[j], d))]
                    order = np.lexsort((every[1], every[2], every[0]))
                    every = [y[order] for y in every]
                    first = np.searchsorted(every[0], every[0])
                    kept = np.arange(len(order)) - first < k
                    found = tuple(y[kept] for y in every)
                    names = part.column(2)
                    labels |= {int(ids[y]): names[int(y)].as_py() for y in np.unique(j).tolist()}
                wanted = set(found[1].tolist())
                labels = {y: v for y, v in labels.items() if y in wanted}
            yield pa.RecordBatch.from_arrays([pa.array(qid[found[0]], pa.int64()), pa.array(found[1], pa.int64()), pa.array([labels[y] for y in found[1].tolist()], out_kind), pa.array(found[2], pa.float64())], names=["query", "id", "label", "distance"])

        return run

    from pyspark.sql.pandas.types import to_arrow_type

    out_kind = to_arrow_type(rows.schema["label"].dataType)
    schema = f"query long, id long, label {kind}, distance double"
    found = rows.sparkSession.createDataFrame([], schema)
    for n, (qid, q) in enumerate(_blocks(queries)):
        part = rows.select("id", "features", "label").mapInArrow(search(qid, q), schema)
        found = part if not n else found.unionByName(part)
    w = Window.partitionBy("query").orderBy("distance", "id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def vote_by_distance(near: DataFrame) -> DataFrame:
    """(query, predicted): the label with the largest sum of 1 / distance; rows at distance 0 decide alone. Ties: the smallest label."""
    zero = near.withColumn("z", F.max((F.col("distance") == 0).cast("int")).over(Window.partitionBy("query")))
    weight = F.when(F.col("z") == 1, (F.col("distance") == 0).cast("double")).otherwise(F.try_divide(F.lit(1.0), F.col("distance")))
    sums = zero.withColumn("w", weight).groupBy("query", "label").agg(F.sum("w").alias("w"))
    return sums.groupBy("query").agg(F.min_by("label", F.struct((-F.round("w", 9)).alias("w"), "label")).alias("predicted"))
