"""Imputation, clipping and scaling, fitted on Train only, in long form: (scenario, row_id, feature, pos, value, split).

The fit is three passes, each a grouped aggregate: the median; the quartiles
of the imputed values; mean, deviation and range of the clipped values. Their
results, one row per feature, are joined to the next pass; Spark broadcasts
them when their size allows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import audit
from .quantiles import quantiles

IQR_FACTOR = 1.5


def coerce(long: DataFrame) -> DataFrame:
    """long(..., feature, raw) -> value in place of raw, and became_null: non_numeric, positive_inf, negative_inf or invalid_negative for a raw value that isn't kept; null for one that is, or was missing.

    Values below 0 are kept in consistency features only.
    """
    c = audit.classify(long)
    bad = F.col("below") & ~F.col("allowed")
    reason = F.when(F.col("issue") == "Text", "non_numeric").when(F.col("issue") == "Positive_Inf", "positive_inf").when(F.col("issue") == "Negative_Inf", "negative_inf").when(bad, "invalid_negative")
    return c.withColumn("became_null", reason).withColumn("value", F.when(~bad, F.col("value"))).drop("raw", "issue", "below", "allowed")


def coercion_counts(coerced: DataFrame) -> DataFrame:
    """(scenario, split, non_numeric, positive_inf, negative_inf, invalid_negative)."""
    kinds = ("non_numeric", "positive_inf", "negative_inf", "invalid_negative")
    return coerced.groupBy("scenario", "split").agg(*(F.count_if(F.coalesce(F.col("became_null") == k, F.lit(False))).alias(k) for k in kinds))


def _quantiles(rows: DataFrame, keys: list[str], at: list[float], accuracy: int | None) -> DataFrame:
    """Exact; with an accuracy, Spark's sketch alone, in one pass."""
    if accuracy is None:
        return quantiles(rows, keys, "value", at)
    return rows.groupBy(*keys).agg(F.percentile_approx("value", F.array(*map(F.lit, at)), accuracy).alias("q"))


def clipped(x: Column, lo: Column, hi: Column) -> Column:
    """x within the bounds that aren't null; null stays null."""
    return F.when(x.isNotNull(), F.least(F.greatest(x, lo), hi))


def fit(long: DataFrame, factor: float = IQR_FACTOR, accuracy: int | None = None) -> DataFrame:
    """One row per scenario and feature: median, q1, q3, iqr, lower, upper, mean, std (population), min, max, missing, constant, keep. Features without a value or with one value in Train have keep = false."""
    keys = ["scenario", "feature"]
    train = long.where("split = 'Train'")
    p1 = train.groupBy(*keys).agg(F.count_if(F.col("value").isNull()).alias("missing"), F.min("value").alias("a"), F.max("value").alias("b"), F.min("pos").alias("pos"))
    p1 = p1.join(_quantiles(train, keys, [0.5], accuracy).select(*keys, F.col("q")[0].alias("median")), keys, "left")
    p1 = p1.select(*keys, "pos", "median", "missing", F.coalesce(F.col("a") == F.col("b"), F.lit(True)).alias("constant"))
    filled = train.join(p1, keys).withColumn("value", F.coalesce("value", "median"))
    q = _quantiles(filled, keys, [0.25, 0.75], accuracy).select(*keys, F.col("q")[0].alias("q1"), F.col("q")[1].alias("q3"))
    iqr = F.col("q3") - F.col("q1")
    p2 = p1.join(q, keys, "left").withColumn("iqr", iqr).withColumn("lower", F.when(iqr > 0, F.col("q1") - factor * iqr)).withColumn("upper", F.when(iqr > 0, F.col("q3") + factor * iqr))
    cut = train.join(p2, keys).withColumn("value", clipped(F.coalesce("value", "median"), F.col("lower"), F.col("upper")))
    p3 = cut.groupBy(*keys).agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"), F.min("value").alias("min"), F.max("value").alias("max"))
    return p2.join(p3, keys).withColumn("keep", ~F.col("constant"))


def frozen(params: DataFrame) -> DataFrame:
    """The parameters as a local table, so that what reads them doesn't fit again. They have a row for each feature of a scenario."""
    return params.sparkSession.createDataFrame(params.collect(), params.schema)


def transform(long: DataFrame, params: DataFrame) -> DataFrame:
    """long with clean, standard, minmax and was_missing, low, high; features with keep = false are left out. A deviation or range of 0 gives 0; values outside Train's range aren't cut."""
    p = params.where("keep").select("scenario", "feature", "median", "lower", "upper", "mean", "std", "min", "max")
    j = long.join(p, ["scenario", "feature"])
    filled = F.coalesce("value", "median")
    j = j.withColumn("was_missing", F.col("value").isNull()).withColumn("low", F.coalesce(filled < F.col("lower"), F.lit(False))).withColumn("high", F.coalesce(filled > F.col("upper"), F.lit(False)))
    j = j.withColumn("clean", clipped(filled, F.col("lower"), F.col("upper")))
    standard = F.coalesce(F.try_divide(F.col("clean") - F.col("mean"), F.col("std")), F.lit(0.0))
    minmax = F.coalesce(F.try_divide(F.col("clean") - F.col("min"), F.col("max") - F.col("min")), F.lit(0.0))
    return j.withColumn("standard", standard).withColumn("minmax", minmax).drop("median", "lower", "upper", "mean", "std", "min", "max")


def counts(prepared: DataFrame) -> DataFrame:
    """(scenario, split, n_values, missing, missing_after, low, high)."""
    return prepared.groupBy("scenario", "split").agg(F.count("*").alias("n_values"), F.count_if("was_missing").alias("missing"), F.count_if(F.col("clean").isNull()).alias("missing_after"), F.count_if("low").alias("low"), F.count_if("high").alias("high"))


def to_wide(prepared: DataFrame, value: str) -> DataFrame:
    """(scenario, row_id, split, features array<double>), features by pos."""
    rows = prepared.groupBy("scenario", "row_id", "split").agg(F.array_sort(F.collect_list(F.struct("pos", F.col(value).alias("v")))).alias("r"))
    return rows.select("scenario", "row_id", "split", F.transform("r", lambda x: x["v"]).alias("features"))
