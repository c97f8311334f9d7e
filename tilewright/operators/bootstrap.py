"""Clustered bootstrap of classification metrics."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import metrics


#: Draws and seed of the final intervals: fixed values.
REPEATS, SEED = 2000, 20260819
METRICS = ("accuracy", "macro_precision", "macro_recall", "macro_f1", "weighted_precision", "weighted_recall", "weighted_f1", "macro_auc")


def numpy_draws(groups: DataFrame, group: str, repeats: int = REPEATS, seed: int = SEED, most: int = 100_000) -> DataFrame:
    """(draw, group, times) by numpy's generator over the sorted groups, for parity with published intervals.

    The generator is one sequence, so one task goes through it and sends what
    it draws in batches. The groups are collected; more than `most` are refused.
    """
    names = sorted(r[0] for r in groups.where(F.col(group).isNotNull()).select(F.col(group).cast("string")).distinct().limit(most + 1).collect())
    if len(names) > most:
        raise ValueError(f"more than {most} groups; use hashed_draws")
    spark, n = groups.sparkSession, len(names)
    if not n:
        return spark.createDataFrame([], "draw long, group string, times long")
    index = spark.createDataFrame(list(enumerate(names)), "i long, group string")

    def run(batches):
        for _ in batches:
            rng = np.random.default_rng(seed)
            for d in range(repeats):
                u, c = np.unique(rng.choice(n, n, replace=True), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(u), d)), pa.array(u), pa.array(c)], names=["draw", "i", "times"])

    return spark.range(1, numPartitions=1).mapInArrow(run, "draw long, i long, times long").join(index, "i").select("draw", "group", "times")


def hashed_draws(groups: DataFrame, group: str, repeats: int = REPEATS) -> DataFrame:
    """(draw, group, times): in each of `repeats` draws, as many groups with replacement as there are, from a fixed integer sequence that SQL can rebuild. Nothing is collected but the number of groups."""
    spark = groups.sparkSession
    g = groups.where(F.col(group).isNotNull()).select(F.col(group).alias("group")).distinct()
    numbered = _numbered(g, "group")
    n = g.count()
    picks = spark.range(repeats).select(F.col("id").alias("draw"), F.explode(F.sequence(F.lit(0), F.lit(max(n - 1, 0)))).alias("j"))
    picks = picks.select("draw", F.expr(f"(draw * 7919 + j * 104729 + draw * j * 31 + 17) % 1000003 % {max(n, 1)}").alias("i"))
    times = picks.groupBy("draw", "i").agg(F.count("*").alias("times"))
    return times.join(numbered, "i").select("draw", "group", "times")


def _numbered(d: DataFrame, col: str) -> DataFrame:
    """d (distinct in col) with i from 0 in the order of the md5 of col's text.

    Counts by the hash's first three digits, 4096 at most, tell where each of
    these buckets begins; only inside one are rows ordered.
    """
    b = d.withColumn("__h", F.md5(F.col(col).cast("string").cast("binary"))).withColumn("__b", F.substring("__h", 1, 3))
    per = b.groupBy("__b").agg(F.count("*").alias("n"))
    before = per.select("__b", (F.sum("n").over(Window.orderBy("__b")) - F.col("n")).alias("__before"))
    return b.join(before, "__b").withColumn("i", F.row_number().over(Window.partitionBy("__b").orderBy("__h", F.col(col).cast("string"))) - 1 + F.col("__before")).drop("__b", "__h", "__before")


def with_row_groups(predictions: DataFrame, row_id: str, group: str = "group") -> DataFrame:
    """For tables without source groups: each row is a group of its own."""
    return predictions.withColumn(group, F.col(row_id).cast("string"))


def distribution(predictions: DataFrame, truth: str, predicted: str, group: str, draws: DataFrame, scores: str | None = None, labels: list | None = None) -> DataFrame:
    """One row of metrics per draw; with scores (an array in the order of labels) also macro_auc, one against the rest.

    Predictions are counted once by (group, truth, predicted); a draw
    multiplies these counts. Areas need the scores, so each draw reads the
    rows of its groups, with how often it drew them as weight.
    """
    p = predictions.withColumn("group", F.col(group))
    counts = p.groupBy("group", F.col(truth).alias("truth"), F.col(predicted).alias("predicted")).agg(F.count("*").alias("c"))
    m = draws.join(counts, "group").groupBy("draw", "truth", "predicted").agg(F.sum(F.col("times") * F.col("c")).alias("n"))
    out = metrics.summary(m, ["draw"])
    if scores is None:
        return out
    rows = draws.join(p.select("group", F.col(truth).alias("truth"), F.col(scores).alias("scores")), "group")
    return out.join(metrics.macro_auc(rows, "truth", "scores", labels, ["draw"], "times").withColumnRenamed("auc", "macro_auc"), "draw", "left")


def intervals(dist: DataFrame, point: DataFrame, names: list[str]) -> DataFrame:
    """(metric, point, lower, upper): the point estimate and linear 2.5 and 97.5 % quantiles."""
    q = dist.agg(*(F.percentile(m, F.array(F.lit(0.025), F.lit(0.975))).alias(m) for m in names))
    rows = F.array(*(F.struct(F.lit(m).alias("metric"), F.col(f"{m}")[0].alias("lower"), F.col(f"{m}")[1].alias("upper")) for m in names))
    points = point.select(F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).alias("point")) for m in names))).alias("p")).select("p.metric", "p.point")
    return q.select(F.explode(rows).alias("r")).select("r.metric", "r.lower", "r.upper").join(points, "metric")
