"""Feature scores and rankings, in long form: (scenario, feature, pos, label, value)."""

from __future__ import annotations

import sys

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..shipping import ship
from .matching import ContractError

#: Fixed values.
K_VALUES = (25, 50, 75, 100, 125, 150, 175, 200, 225)
KEYS = ["scenario", "feature", "pos"]


def sane(score: Column) -> Column:
    """For ordering: NaN and null as -inf, +inf as the largest double."""
    low = F.lit(float("-inf"))
    return F.when(score.isNull() | F.isnan(score), low).when(score == float("inf"), F.lit(sys.float_info.max)).otherwise(score)


def variance(long: DataFrame) -> DataFrame:
    return long.groupBy(*KEYS).agg(F.var_pop("value").alias("score"))


def _by_class(long: DataFrame) -> DataFrame:
    """Per feature and label: n, sum, mean, squared deviations from that mean. All scores below need only these, so the rows are read once and shuffled as partial sums."""
    return long.where("value is not null").groupBy(*KEYS, "label").agg(F.count("*").alias("n"), F.sum("value").alias("s"), F.avg("value").alias("m"), (F.var_pop("value") * F.count("*")).alias("ss"), F.min("value").alias("low"))


def chi2(long: DataFrame) -> DataFrame:
    """Chi-square of class sums against class shares, (classes - 1) degrees of freedom; null where a feature sums to 0. Values below 0 are an error."""
    c = _by_class(long)
    w = Window.partitionBy(*KEYS)
    c = c.withColumn("checked", F.when(F.col("low") < -1e-12, F.raise_error(F.lit("chi2 needs values that aren't negative"))).otherwise(F.lit(0)))
    expected = F.sum("s").over(w) * F.col("n") / F.sum("n").over(w)
    parts = c.select(*KEYS, F.try_divide((F.col("s") - expected) ** 2, expected).alias("x"), "checked")
    return parts.groupBy(*KEYS).agg((F.sum("x") + F.max("checked")).alias("score"), (F.count("*") - 1).alias("df"))


def anova(long: DataFrame) -> DataFrame:
    """F statistic of a one-way analysis of variance, with its degrees of freedom; null where all values of each class are equal."""
    w = Window.partitionBy(*KEYS)
    c = _by_class(long).withColumn("grand", F.sum("s").over(w) / F.sum("n").over(w))
    g = c.groupBy(*KEYS).agg(F.sum(F.col("n") * (F.col("m") - F.col("grand")) ** 2).alias("between"), F.sum("ss").alias("within"), F.count("*").alias("k"), F.sum("n").alias("n"))
    score = F.try_divide(F.col("between") / (F.col("k") - 1), F.try_divide(F.col("within"), F.col("n") - F.col("k")))
    return g.where("k > 1").select(*KEYS, score.alias("score"), (F.col("k") - 1).alias("df"), (F.col("n") - F.col("k")).alias("df2"))


def p_values(scores: DataFrame, kind: str) -> DataFrame:
    """scores (one row per feature) with p_value; kind is f or chi2. By continued fractions on the few statistics, in Arrow batches."""
    ship(scores.sparkSession)

    def run(batches):
        from ..functions.distributions import chi2_sf, f_sf

        for b in batches:
            b["p_value"] = [None if pd.isna(x) else (f_sf(x, d, e) if kind == "f" else chi2_sf(x, d)) for x, d, e in zip(b["score"], b["df"], b["df2"] if kind == "f" else b["df"])]
            yield b

    return scores.mapInPandas(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in scores.schema) + ", p_value double")


def rank(scores: DataFrame, method: str) -> DataFrame:
    """scores with method and rank from 1: by score descending, ties by position."""
    w = Window.partitionBy("scenario").orderBy(sane(F.col("score")).desc(), F.col("pos"))
    return scores.select(*KEYS, "score", F.lit(method).alias("method"), F.row_number().over(w).alias("rank"))


def all_features(long: DataFrame) -> DataFrame:
    """The baseline: every feature in its order, score 1."""
    return rank(long.select(*KEYS).distinct().withColumn("score", F.lit(1.0)), "AllMsr")


def valid_ks(n: int, ks: tuple[int, ...] = K_VALUES) -> list[int]:
    return sorted({min(k, n) for k in ks} | {n})


def top_k(ranking: DataFrame, ks: tuple[int, ...] = K_VALUES) -> DataFrame:
    """(scenario, method, k, rank, feature): the first k features for each k, and all."""
    n = ranking.groupBy("scenario", "method").agg(F.max("rank").alias("n"))
    lists = F.array_sort(F.array_distinct(F.concat(*[F.array(F.least(F.lit(k), F.col("n"))) for k in ks], F.array("n"))))
    want = n.select("scenario", "method", F.explode(lists).alias("k"))
    return ranking.join(want, ["scenario", "method"]).where("rank <= k").select("scenario", "method", "k", "rank", "feature")


def jaccard(lists: DataFrame) -> DataFrame:
    """(scenario, k, method_a, method_b, common, jaccard) of each pair of methods; two empty lists have 1."""
    sets = lists.groupBy("scenario", "k", "method").agg(F.collect_set("feature").alias("s"))
    a, b = (sets.select("scenario", "k", F.col("method").alias(f"method_{x}"), F.col("s").alias(f"s{x}")) for x in "ab")
    j = a.join(b, ["scenario", "k"]).where("method_a < method_b")
    common, union = F.size(F.array_intersect("sa", "sb")), F.size(F.array_union("sa", "sb"))
    return j.select("scenario", "k", "method_a", "method_b", common.cast("long").alias("common"), F.coalesce(F.try_divide(common.cast("double"), union), F.lit(1.0)).alias("jaccard"))


def _digamma(x: np.ndarray) -> np.ndarray:
    x = np.asarray(x, float).copy()
    out = np.zeros_like(x)
    for _ in range(6):
        small = x < 6
        out[small] -= 1 / x[small]
        x[small] += 1
    y = 1 / (x * x)
    return out + np.log(x) - 0.5 / x - y * (1 / 12 - y * (1 / 120 - y / 252))


def mutual_information_of(x: np.ndarray, label: np.ndarray, k: int = 3) -> float:
    """Nearest-neighbour estimate between one continuous variable and classes (Ross 2014), in nats, not below 0. Classes of one row are left out."""
    names, code, size = np.unique(label, return_inverse=True, return_counts=True)
    keep = size[code] > 1
    x, code = x[keep], code[keep]
    n = len(x)
    if n < 2:
        return 0.0
    radius, ks = np.zeros(n), np.zeros(n)
    for c in np.unique(code):
        at = np.flatnonzero(code == c)
        order = at[np.argsort(x[at], kind="stable")]
        v, m = x[order], len(order)
        kk = min(k, m - 1)
        best = np.full(m, np.inf)
        for lo in range(kk + 1):  # the kk nearest of a sorted value are among those lo below and kk - lo above
            d = np.zeros(m)
            i = np.arange(m)
            ok = (i - lo >= 0) & (i + kk - lo < m)
            d[ok] = np.maximum(v[i[ok]] - v[i[ok] - lo], v[i[ok] + kk - lo] - v[i[ok]])
            d[~ok] = np.inf
            best = np.minimum(best, d)
        radius[order], ks[order] = best, kk
    # rows nearer than the radius, itself included: differences decide, since sums round
    s = np.sort(x)
    lo, hi = np.searchsorted(s, x - radius, "right"), np.searchsorted(s, x + radius, "left")
    while (move := (lo > 0) & (x - s[np.maximum(lo - 1, 0)] < radius)).any():
        lo = lo - move
    while (move := (lo < n) & (x - s[np.minimum(lo, n - 1)] >= radius) & (s[np.minimum(lo, n - 1)] < x)).any():
        lo = lo + move
    while (move := (hi < n) & (s[np.minimum(hi, n - 1)] - x < radius)).any():
        hi = hi + move
    while (move := (hi > 0) & (s[np.maximum(hi - 1, 0)] - x >= radius) & (s[np.maximum(hi - 1, 0)] > x)).any():
        hi = hi - move
    m = np.maximum(hi - lo, 1)
    per = np.bincount(code)[code]
    value = _digamma(np.array([n]))[0] + _digamma(ks).mean() - _digamma(per).mean() - _digamma(m).mean()
    return max(0.0, float(value))


def mutual_information(long: DataFrame, k: int = 3, most_rows: int = 5_000_000) -> DataFrame:
    """Scores by nearest neighbours. A task holds the rows of one feature, one number and one label each; more than most_rows are refused."""
    ship(long.sparkSession)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        if len(pdf) > most_rows:
            raise ContractError(f"a feature has more than {most_rows} rows")
        first = pdf.iloc[0]
        return pd.DataFrame([(first["scenario"], first["feature"], first["pos"], mutual_information_of(pdf["value"].to_numpy(float), pdf["label"].to_numpy(), k))], columns=[*KEYS, "score"])

    kinds = long.schema
    return long.select(*KEYS, "label", "value").groupBy(*KEYS).applyInPandas(run, ", ".join(f"{c} {kinds[c].dataType.simpleString()}" for c in KEYS) + ", score double")


def _with_scores(names: DataFrame, values: list[float], spark) -> DataFrame:
    s = spark.createDataFrame([(i, float(v)) for i, v in enumerate(values)], "i int, score double")
    nth = names.withColumn("i", F.row_number().over(Window.partitionBy("scenario").orderBy("pos")) - 1)
    return nth.join(s, "i").select(*KEYS, "score")


def forest_importance(wide: DataFrame, names: DataFrame, trees: int = 300, depth: int | None = None, seed: int = 42) -> DataFrame:
    """wide(features array, label) of one scenario, names(scenario, feature, pos) -> importances of a class-balanced random forest (binned splits)."""
    from . import models

    model = models.fit_forest(wide, trees=trees, depth=depth, balanced=True, seed=seed)
    return _with_scores(names, models.importances(model), wide.sparkSession)


def l1_importance(wide: DataFrame, names: DataFrame, c: float = 1.0) -> DataFrame:
    """Mean over classes of the absolute weights of a sparse multinomial logistic regression, and how many classes use the feature."""
    from . import models

    m = models.fit_logistic(wide, c=c, l1=True, balanced=True).stages[-1]
    w = np.abs(m.coefficientMatrix.toArray())
    used = (w > 1e-12).sum(axis=0)
    out = _with_scores(names, w.mean(axis=0).tolist(), wide.sparkSession)
    extra = _with_scores(names, used.tolist(), wide.sparkSession).withColumnRenamed("score", "n_classes")
    return out.join(extra.withColumn("n_classes", F.col("n_classes").cast("int")), KEYS)
