"""Exact quantiles of grouped numbers without keeping a group's values in one place."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: A sketch of this accuracy finds the interval that holds a quantile; its error is a tenth of MARGIN.
ACCURACY, MARGIN = 10_000, 0.001
#: Groups of fewer values are ordered whole.
SMALL = 50_000


def quantiles(rows: DataFrame, keys: list[str], value: str, at: list[float]) -> DataFrame:
    """(keys..., q array<double>): linear interpolated quantiles of the values that aren't null, in the order of `at`; groups without a value are absent.

    Three grouped aggregates: a sketch bounds each quantile by an interval
    that holds about 2 * MARGIN of the group; values below the interval are
    counted and those inside counted by distinct value; only these are
    ordered.
    """
    rows = rows.select(*keys, F.col(value).cast("double").alias("__v")).where("__v is not null")
    ends = [x for p in at for x in (max(0.0, p - MARGIN), min(1.0, p + MARGIN))]
    sketch = rows.groupBy(*keys).agg(F.count("*").alias("__n"), F.min("__v").alias("__low"), F.max("__v").alias("__high"), F.percentile_approx("__v", F.array(*map(F.lit, ends)), ACCURACY).alias("__e"))
    small = F.col("__n") < SMALL
    ranges = F.array(*(F.struct(F.lit(i).alias("i"), (F.lit(p) * (F.col("__n") - 1)).alias("rank"), F.when(small, F.col("__low")).otherwise(F.col("__e")[2 * i]).alias("lo"), F.when(small, F.col("__high")).otherwise(F.col("__e")[2 * i + 1]).alias("hi")) for i, p in enumerate(at)))
    wanted = sketch.select(*keys, F.explode(ranges).alias("__r")).select(*keys, "__r.*")
    near = rows.join(wanted, keys).where("__v <= hi")
    # one row for all values below the interval, one for each value inside
    counted = near.groupBy(*keys, "i", "rank", F.when(F.col("__v") >= F.col("lo"), F.col("__v")).alias("__v")).agg(F.count("*").alias("c"))
    up_to = F.sum("c").over(Window.partitionBy(*keys, "i").orderBy(F.col("__v").asc_nulls_first()))
    placed = counted.withColumn("__to", up_to).withColumn("__from", F.col("__to") - F.col("c")).where("__v is not null")

    def of(rank):
        return F.max(F.when((F.col("__from") <= rank) & (rank < F.col("__to")), F.col("__v")))

    below, above = F.floor("rank"), F.ceil("rank")
    pair = placed.groupBy(*keys, "i", "rank").agg(of(below).alias("a"), of(above).alias("b"))
    value_at = F.col("a") + (F.col("b") - F.col("a")) * (F.col("rank") - F.floor("rank"))
    return pair.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("i", value_at.alias("x")))).alias("q")).select(*keys, F.transform("q", lambda s: s["x"]).alias("q"))
