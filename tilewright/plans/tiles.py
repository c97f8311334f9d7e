"""Tile statistics: suppliers as images, line numbers as tiles, rows as pixels, three columns as channels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import tiles as T
from .base import longs, query, read, rounded

CHANNELS = ["b", "g", "r"]
KEYS = ["image", "tile"]


def pixels(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "lineitem").selectExpr("l_suppkey as image", "l_linenumber as tile", "l_quantity as b", "l_extendedprice / 997.0D as g", "l_tax * 100.0D as r")


_PX = "px AS (SELECT l_suppkey AS image, l_linenumber AS tile, l_quantity AS b, l_extendedprice / 997.0::DOUBLE AS g, l_tax * 100.0::DOUBLE AS r FROM lineitem)"


def _stats_sql() -> str:
    per, out = [], []
    for c in CHANNELS:
        per.append(f"max({c}) - min({c}) AS {c}_range, var_samp({c}) AS {c}_variance, stddev_samp({c}) AS {c}_std, avg(abs({c} - m{c})) AS {c}_mad, quantile_cont({c}, 0.25) AS {c}_q1, quantile_cont({c}, 0.75) AS {c}_q3, stddev_samp({c}) / nullif(avg({c}), 0) AS {c}_cv")
        for m in T.MEASURES:
            x = f"{c}_q3 - {c}_q1" if m == "iqr" else f"{c}_{m}"
            out.append(f"CASE WHEN n > 1 THEN {x} END AS {c}_{m}")
    means = ", ".join(f"avg({c}) OVER (PARTITION BY image, tile) AS m{c}" for c in CHANNELS)
    return f"""{_PX}, cen AS (SELECT *, {means} FROM px),
agg AS (SELECT image, tile, count(*) AS n, var_samp(b + g + r) AS vt, {", ".join(per)} FROM cen GROUP BY image, tile),
stats AS (SELECT image, tile, n, {", ".join(out)}, 1.5 * (1 - (b_variance + g_variance + r_variance) / nullif(vt, 0)) AS alpha FROM agg)"""


_STATS = _stats_sql()
_MEASURED = [f"{c}_{m}" for c in CHANNELS for m in T.MEASURES]


@query(f"WITH {_STATS} SELECT image, tile, n, {', '.join(f'round({m}, 4) + 0.0::DOUBLE AS {m}' for m in _MEASURED)} FROM stats")
def tile_dispersion(spark: SparkSession, d: str) -> DataFrame:
    s = T.tile_statistics(pixels(spark, d), KEYS, CHANNELS)
    return rounded(s.select(*KEYS, "n", *_MEASURED), 4, *_MEASURED)


@query(f"WITH {_STATS} SELECT image, tile, round(alpha, 4) + 0.0::DOUBLE AS alpha FROM stats")
def tile_alpha(spark: SparkSession, d: str) -> DataFrame:
    return rounded(T.tile_statistics(pixels(spark, d), KEYS, CHANNELS).select(*KEYS, "alpha"), 4, "alpha")


_CELLS = ", ".join(f"({i}, '{name}', {col})" for i, (name, col) in enumerate([("cronbach", "alpha"), *((f"{c}{m}", f"{c}_{m}") for c in CHANNELS for m in T.MEASURES)]))


@query(f"WITH {_STATS} SELECT image, tile, nth, measure, round(value, 4) + 0.0::DOUBLE AS value FROM stats, LATERAL (VALUES {_CELLS}) v(nth, measure, value)")
def tile_features_long(spark: SparkSession, d: str) -> DataFrame:
    return rounded(T.to_long(T.tile_statistics(pixels(spark, d), KEYS, CHANNELS), "image", "tile", CHANNELS), 4, "value")


@query("SELECT l_suppkey AS image, count(DISTINCT l_linenumber) AS tiles, 25 * count(DISTINCT l_linenumber) AS features FROM lineitem GROUP BY l_suppkey")
def tile_feature_count(spark: SparkSession, d: str) -> DataFrame:
    v = T.to_vectors(T.tile_statistics(pixels(spark, d), KEYS, CHANNELS), "image", "tile", CHANNELS)
    return longs(v.select("image", "tiles", F.size("features").alias("features")), "tiles", "features")


@query("SELECT l_orderkey AS y, l_partkey AS x, CAST((l_orderkey // 64) * (512 // 64) + (l_partkey % 512) // 64 + 1 AS INTEGER) AS tile FROM lineitem")
def tile_numbers(spark: SparkSession, d: str) -> DataFrame:
    p = read(spark, d, "lineitem").select(F.col("l_orderkey").alias("y"), F.col("l_partkey").alias("x"))
    return p.select("y", "x", T.tile_number(F.col("x") % 512, F.col("y"), F.lit(512), 64).alias("tile"))
