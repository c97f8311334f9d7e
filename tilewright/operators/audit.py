"""Quality audit of text-typed features in long form: (scenario, row_id, feature, raw, split)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import keys as K
from .quantiles import quantiles

IQR_FACTOR = 1.5


def classify(long: DataFrame, raw: str = "raw", feature: str = "feature") -> DataFrame:
    """Adds value (finite number or null), issue (Missing, Text, Positive_Inf, Negative_Inf or null) and negative (below zero where that isn't allowed)."""
    t = F.lower(K.trimmed(F.col(raw)))
    infinite = t.rlike(K.INFINITE)
    issue = (
        F.when(t.isNull() | (t == "") | (t == "nan"), "Missing")
        .when(infinite & t.startswith("-"), "Negative_Inf").when(infinite, "Positive_Inf")
        .when(~t.rlike(K.NUMBER), "Text")
    )
    value = K.finite_number(F.col(raw))
    below = F.coalesce(value < 0, F.lit(False))
    return long.withColumn("value", value).withColumn("issue", issue).withColumn("below", below).withColumn("allowed", K.is_consistency_feature(F.col(feature)))


def _count(cond: Column, name: str) -> list[Column]:
    return [F.count_if(cond).alias(f"{name}_all"), F.count_if(cond & (F.col("split") == "Train")).alias(f"{name}_train")]


def audit_features(long: DataFrame, factor: float = IQR_FACTOR) -> DataFrame:
    """One row per scenario and feature: counts of issues over all rows and Train, and the spread of Train's finite values with the bounds beyond which others are outliers.

    Quartiles and median are exact with linear interpolation.
    """
    keys = ["scenario", "feature"]
    c = classify(long)
    train = F.when(F.col("split") == "Train", F.col("value"))
    issues = [x for k in ("Missing", "Text", "Positive_Inf", "Negative_Inf") for x in _count(F.coalesce(F.col("issue") == k, F.lit(False)), k.lower())]
    g = c.groupBy("scenario", "feature").agg(
        F.count("*").alias("total_rows"), F.count_if(F.col("split") == "Train").alias("train_rows"), F.first("allowed").alias("allowed"), *issues,
        *_count(F.col("below") & ~F.col("allowed"), "invalid_negative"), *_count(F.col("below") & F.col("allowed"), "negative_allowed"),
        F.countDistinct(train).alias("unique_train"), F.min(train).alias("min_train"), F.max(train).alias("max_train"), F.avg(train).alias("mean_train"),
        F.stddev_samp(train).alias("std_train"),
    )
    g = g.join(quantiles(c.where("split = 'Train'"), keys, "value", [0.25, 0.5, 0.75]), keys, "left")
    g = g.select("*", F.col("q")[1].alias("median_train"), F.col("q")[0].alias("q1_train"), F.col("q")[2].alias("q3_train"), (F.col("q")[2] - F.col("q")[0]).alias("iqr_train"), (F.col("unique_train") <= 1).alias("constant_train")).drop("q")
    g = g.withColumn("outlier_lower_train", F.col("q1_train") - factor * F.col("iqr_train")).withColumn("outlier_upper_train", F.col("q3_train") + factor * F.col("iqr_train"))
    flags = sum((F.col(f"{k}_all") for k in ("missing", "text", "positive_inf", "negative_inf", "invalid_negative")), F.lit(0).cast("long"))
    return g.withColumn("expected_nonnegative", ~F.col("allowed")).drop("allowed").withColumn("flags", flags + F.col("constant_train").cast("long"))


def audit_outliers(long: DataFrame, audit: DataFrame | None = None, factor: float = IQR_FACTOR) -> DataFrame:
    """One row per scenario, feature and split: finite values outside Train's quartiles by factor times their distance, where that is above 0."""
    a = audit_features(long, factor) if audit is None else audit
    usable = F.coalesce(F.col("iqr_train") > 0, F.lit(False))
    bounds = a.select("scenario", "feature", usable.alias("usable"), F.col("outlier_lower_train").alias("lower"), F.col("outlier_upper_train").alias("upper"))
    # bounds have a row for each feature; rows are counted where they are read
    j = classify(long).join(bounds, ["scenario", "feature"])
    finite = F.col("value").isNotNull()
    out = j.groupBy("scenario", "feature", "split", "usable", "lower", "upper").agg(
        F.count("*").alias("rows"), F.count_if(finite).alias("finite"), F.count_if(F.col("usable") & (F.col("value") < F.col("lower"))).alias("low"), F.count_if(F.col("usable") & (F.col("value") > F.col("upper"))).alias("high"))
    return out.withColumn("percent", F.coalesce(F.try_divide((F.col("low") + F.col("high")) * 100.0, F.col("finite")), F.lit(0.0)))


def audit_report(long: DataFrame, factor: float = IQR_FACTOR) -> DataFrame:
    """audit_features with outliers_all_splits and place: each scenario's features from 1, those with most flags first, then most outliers, then by name."""
    a = audit_features(long, factor)
    n = audit_outliers(long, a, factor).where(F.col("split").isin("Train", "Validation", "Test")).groupBy("scenario", "feature").agg(F.sum(F.col("low") + F.col("high")).alias("outliers_all_splits"))
    rows = a.join(n, ["scenario", "feature"], "left").withColumn("outliers_all_splits", F.coalesce("outliers_all_splits", F.lit(0).cast("long")))
    order = Window.partitionBy("scenario").orderBy(F.col("flags").desc(), F.col("outliers_all_splits").desc(), F.col("feature"))  # as many rows as features
    return rows.withColumn("place", F.row_number().over(order).cast("long"))


def audit_examples(long: DataFrame, most: int = 10) -> DataFrame:
    """(scenario, feature, row_id, issue, raw): the first rows with an issue of each feature, by row_id.

    Ranked twice, first within a hash part of each feature, so that a feature
    with many issues isn't sorted in one task.
    """
    c = classify(long)
    issue = F.coalesce("issue", F.when(F.col("below") & ~F.col("allowed"), "Negative"))
    bad = c.select("scenario", "feature", "row_id", issue.alias("issue"), "raw").where("issue is not null").withColumn("part", F.pmod(F.xxhash64("row_id"), F.lit(64)))
    order = [F.col("row_id"), F.col("raw")]
    near = bad.withColumn("n", F.row_number().over(Window.partitionBy("scenario", "feature", "part").orderBy(*order))).where(F.col("n") <= most)
    return near.withColumn("n", F.row_number().over(Window.partitionBy("scenario", "feature").orderBy(*order))).where(F.col("n") <= most).drop("n", "part")
