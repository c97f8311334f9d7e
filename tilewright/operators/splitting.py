"""Leakage-safe group-aware splits, and their audits."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .matching import ContractError

SPLITS = ("Train", "Validation", "Test")
TEST_SHARE, VALIDATION_SHARE, SEED = 0.2, 0.1, 42


def _lowest(df: DataFrame, part: str, order: str, quota: str) -> DataFrame:
    """df with `chosen`: whether a row is among the `quota` lowest of its part by a hex hash.

    Counts by the hash's first four digits (65536 at most for each part) find
    the bucket that the quota ends in; only inside it are rows ranked. So a
    part that holds most rows isn't sorted in one task.
    """
    bucketed = df.withColumn("__bucket", F.substring(order, 1, 4))
    counts = bucketed.groupBy(part, "__bucket").agg(F.count("*").alias("__n"))
    before = counts.withColumn("__before", F.sum("__n").over(Window.partitionBy(part).orderBy("__bucket")) - F.col("__n")).select(part, "__bucket", "__before")
    ranked = bucketed.join(before, [part, "__bucket"]).withColumn("__rank", F.row_number().over(Window.partitionBy(part, "__bucket").orderBy(order)))
    return ranked.withColumn("chosen", F.col("__before") + F.col("__rank") <= F.col(quota)).drop("__bucket", "__before", "__rank")


def assign_groups(rows: DataFrame, cls: str, group: str, seed: int = SEED) -> DataFrame:
    """(class, group, split), one row per group of a class: of G groups ceil(0.2 G) are Test, and of the others ceil(0.1 R) Validation, in the order of sha256('class|group|seed'). Fewer than 3 groups in a class is an error."""
    groups = rows.where(F.col(group).isNotNull()).select(F.col(cls).alias("class"), F.col(group).cast("string").alias("group")).distinct()
    sizes = groups.groupBy("class").agg(F.count("*").alias("g"))
    few = [r["class"] for r in sizes.where("g < 3").take(5)]
    if few:
        raise ContractError(f"classes {few} have fewer than 3 groups")
    sizes = sizes.withColumn("n_test", F.ceil(F.col("g") * F.lit(TEST_SHARE).cast("double")))
    sizes = sizes.withColumn("n_validation", F.ceil((F.col("g") - F.col("n_test")) * F.lit(VALIDATION_SHARE).cast("double")))
    g = groups.join(sizes, "class")

    def key(s: int):
        return F.sha2(F.concat_ws("|", "class", "group", F.lit(str(s))), 256)

    test = _lowest(g.withColumn("h", key(seed)), "class", "h", "n_test")
    rest = _lowest(test.where("not chosen").drop("chosen").withColumn("h", key(seed + 1)), "class", "h", "n_validation")
    done = test.where("chosen").select("class", "group", F.lit("Test").alias("split"))
    return done.unionByName(rest.select("class", "group", F.when(F.col("chosen"), "Validation").otherwise("Train").alias("split")))


def assign_groups_by_permutation(rows: DataFrame, cls: str, group: str, seed: int = SEED) -> DataFrame:
    """The same shares by numpy's legacy permutations of each class's sorted groups, for parity with published splits.

    The distinct groups are collected; meant for catalogues of up to a million groups, and refuses more.
    """
    found = rows.where(F.col(group).isNotNull()).select(F.col(cls).cast("string"), F.col(group).cast("string")).distinct().limit(1_000_001).collect()
    if len(found) > 1_000_000:
        raise ContractError("more than a million groups; use assign_groups")
    by_class: dict[str, list[str]] = {}
    for c, g in found:
        by_class.setdefault(c, []).append(g)
    out = []
    for i, c in enumerate(sorted(by_class)):
        names = sorted(by_class[c])
        if len(names) < 3:
            raise ContractError(f"class {c} has fewer than 3 groups")
        s = seed + 100 * i
        order = np.random.RandomState(s).permutation(len(names))
        n_test = math.ceil(TEST_SHARE * len(names))
        out += [(c, names[k], "Test") for k in order[:n_test]]
        left = sorted(names[k] for k in order[n_test:])
        order = np.random.RandomState(s + 1).permutation(len(left))
        n_validation = math.ceil(VALIDATION_SHARE * len(left))
        out += [(c, left[k], "Validation" if j < n_validation else "Train") for j, k in enumerate(order)]
    return rows.sparkSession.createDataFrame(out, "class string, group string, split string")


def split_rows(rows: DataFrame, cls: str, group: str, seed: int = SEED) -> DataFrame:
    """rows with `split`; null for rows without a group."""
    a = assign_groups(rows, cls, group, seed).select(F.col("class").alias(cls), F.col("group").alias("__group"), "split")
    return rows.withColumn("__group", F.col(group).cast("string")).join(a, [cls, "__group"], "left").drop("__group")


def split_summary(rows: DataFrame, cls: str, group: str) -> DataFrame:
    """(class, split, n_rows, percent_of_class, n_groups) for each class and for ALL, with every split."""
    per = rows.groupBy(F.col(cls).alias("class"), "split", F.col(group).alias("g")).agg(F.count("*").alias("n"))
    sums = per.groupingSets([["class", "split"], ["split"]], "class", "split").agg(F.sum("n").alias("n_rows"), F.countDistinct("g").alias("n_groups"), F.grouping_id().alias("level"))
    sums = sums.withColumn("class", F.when(F.col("level") > 0, "ALL").otherwise(F.col("class"))).drop("level")
    grid = sums.select("class").distinct().select("class", F.explode(F.array(*map(F.lit, SPLITS))).alias("split"))
    full = grid.join(sums, ["class", "split"], "left").na.fill(0, ["n_rows", "n_groups"])
    return full.withColumn("percent_of_class", F.coalesce(F.try_divide(F.col("n_rows") * 100.0, F.sum("n_rows").over(Window.partitionBy("class"))), F.lit(0.0)))


def group_overlap(rows: DataFrame, group: str) -> DataFrame:
    """(group, n_splits, splits, n_rows) of groups in more than one split: empty if nothing leaks."""
    per = rows.where(F.col(group).isNotNull()).groupBy(F.col(group).alias("group"), "split").agg(F.count("*").alias("n"))
    return per.groupBy("group").agg(F.count("split").alias("n_splits"), F.array_join(F.array_sort(F.collect_set("split")), ", ").alias("splits"), F.sum("n").alias("n_rows")).where("n_splits > 1")


def require_disjoint(rows: DataFrame, group: str) -> None:
    if leak := group_overlap(rows, group).take(3):
        raise ContractError(f"groups in several splits, as {[r['group'] for r in leak]}")
