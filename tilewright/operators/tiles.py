"""Dispersion and internal consistency of tiles with several channels.

Input rows are pixels: key columns that name the tile, one column a channel.
The mean absolute deviation needs the tile's mean first; it comes from a
window over the same keys as the aggregate, so there is one exchange. A tile
is bounded by its pixels, so no group grows with the data.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MEASURES = ("range", "variance", "std", "mad", "q1", "q3", "iqr", "cv")


def tile_statistics(pixels: DataFrame, keys: list[str], channels: list[str]) -> DataFrame:
    """keys, <channel>_<measure> ..., alpha, n. Sample variance; mad is the mean absolute deviation from the mean; linear quartiles; cv = std / mean, null at mean 0. One pixel: null everywhere. alpha = k/(k-1) * (1 - sum of variances / variance of the sum), null when the latter is 0."""
    tile = Window.partitionBy(*keys)
    doubles = pixels.select(*keys, *(F.col(c).cast("double").alias(c) for c in channels))
    centred = doubles.select("*", *(F.avg(c).over(tile).alias(f"__{c}") for c in channels))
    total = reduce(lambda a, b: a + b, (F.col(c) for c in channels))
    aggregates = [F.count("*").alias("n"), F.var_samp(total).alias("__total")]
    for c in channels:
        aggregates += [
            F.min(c).alias(f"{c}__lo"), F.max(c).alias(f"{c}__hi"), F.var_samp(c).alias(f"{c}_variance"), F.stddev_samp(c).alias(f"{c}_std"),
            F.avg(F.abs(F.col(c) - F.col(f"__{c}"))).alias(f"{c}__mad"), F.avg(c).alias(f"{c}__mean"), F.percentile(c, F.array(F.lit(0.25), F.lit(0.75))).alias(f"{c}__q"),
        ]
    g = centred.groupBy(*keys).agg(*aggregates)
    many = F.col("n") > 1

    def measures(c: str) -> list[Column]:
        q = F.col(f"{c}__q")
        found = {"range": F.col(f"{c}__hi") - F.col(f"{c}__lo"), "variance": F.col(f"{c}_variance"), "std": F.col(f"{c}_std"), "mad": F.col(f"{c}__mad"), "q1": q[0], "q3": q[1], "iqr": q[1] - q[0], "cv": F.try_divide(f"{c}_std", f"{c}__mean")}
        return [F.when(many, found[m]).alias(f"{c}_{m}") for m in MEASURES]

    k = len(channels)
    parts = reduce(lambda a, b: a + b, (F.col(f"{c}_variance") for c in channels))
    alpha = F.lit(k / (k - 1)) * (F.lit(1.0) - F.try_divide(parts, F.col("__total")))
    return g.select(*keys, *(x for c in channels for x in measures(c)), alpha.alias("alpha"), "n")


def feature_names(channels: list[str], tile: int | str) -> list[str]:
    """Names in order: the consistency of the tile, then each channel's measures."""
    return [f"cronbach_{tile}", *(f"{c}{m}_{tile}" for c in channels for m in MEASURES)]


def to_long(stats: DataFrame, image: str, tile: str, channels: list[str]) -> DataFrame:
    """(image, tile, nth, measure, value): nth counts the features of a tile from 0."""
    cells = [("alpha", "cronbach"), *((f"{c}_{m}", f"{c}{m}") for c in channels for m in MEASURES)]
    array = F.array(*(F.struct(F.lit(i).alias("nth"), F.lit(name).alias("measure"), F.col(c).alias("value")) for i, (c, name) in enumerate(cells)))
    return stats.select(F.col(image), F.col(tile), F.explode(array).alias("f")).select(image, tile, "f.nth", "f.measure", "f.value")


def to_vectors(stats: DataFrame, image: str, tile: str, channels: list[str]) -> DataFrame:
    """(image, tiles, features array<double>): the features of an image's tiles in order, 1 + 8 per channel each."""
    cells = F.array("alpha", *(f"{c}_{m}" for c in channels for m in MEASURES))
    rows = stats.groupBy(image).agg(F.array_sort(F.collect_list(F.struct(F.col(tile).alias("tile"), cells.alias("cells")))).alias("rows"))
    return rows.select(image, F.size("rows").alias("tiles"), F.flatten(F.transform("rows", lambda r: r["cells"])).alias("features"))


def tile_number(x: Column, y: Column, width: Column, side: int) -> Column:
    """1-based row-major number of the tile that holds pixel (x, y)."""
    return (F.floor(y / side) * F.floor(width / side) + F.floor(x / side) + 1).cast("int")
