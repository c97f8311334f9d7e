"""Classification metrics from prediction tables: (truth, predicted) and scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def encode_labels(train: DataFrame, label: str) -> DataFrame:
    """(label, code): codes 0.. in sorted order. As many rows as labels, so one task may order them."""
    d = train.where(F.col(label).isNotNull()).select(F.col(label).alias("label")).distinct()
    return d.withColumn("code", F.row_number().over(Window.orderBy("label")) - 1)


def display_names(rows: DataFrame, label: str, name: str) -> DataFrame:
    """(label, display): the class name if a label has just one, else the label's text."""
    g = rows.groupBy(F.col(label).alias("label")).agg(F.collect_set(name).alias("n"))
    return g.select("label", F.when(F.size("n") == 1, F.col("n")[0]).otherwise(F.col("label").cast("string")).alias("display"))


def argmax_label(p: Column) -> Column:
    """Position of the first largest score."""
    return (F.array_position(p, F.array_max(p)) - 1).cast("int")


def expand_binary(p: Column) -> Column:
    return F.array(F.lit(1.0) - p, p)


def confusion(rows: DataFrame, truth: str, predicted: str, by: list[str] | None = None) -> DataFrame:
    """(by..., truth, predicted, n) over the full grid of labels that occur on either side."""
    by = by or []
    n = rows.groupBy(*by, F.col(truth).alias("truth"), F.col(predicted).alias("predicted")).agg(F.count("*").alias("n"))
    labels = n.select(*by, F.explode(F.array("truth", "predicted")).alias("label")).distinct()
    lists = labels.groupBy(*by).agg(F.collect_list("label").alias("l"))
    grid = lists.select(*by, F.explode("l").alias("truth"), "l").select(*by, "truth", F.explode("l").alias("predicted"))
    return grid.join(n, [*by, "truth", "predicted"], "left").na.fill(0, ["n"])


def percent_of_truth(matrix: DataFrame) -> DataFrame:
    """confusion with percent: of each true label, 0 where it has no row."""
    return matrix.withColumn("percent", F.coalesce(F.try_divide(F.col("n") * 100.0, F.sum("n").over(Window.partitionBy("truth"))), F.lit(0.0)))


def classwise(matrix: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(by..., label, precision, recall, f1, support); a share of nothing is 0."""
    by = by or []
    ends = matrix.select(*by, F.explode(F.array(F.struct(F.col("truth").alias("label"), F.lit(1).alias("t"), F.lit(0).alias("p")), F.struct(F.col("predicted").alias("label"), F.lit(0).alias("t"), F.lit(1).alias("p")))).alias("e"), "n", (F.col("truth") == F.col("predicted")).cast("int").alias("hit"))
    g = ends.groupBy(*by, F.col("e.label").alias("label")).agg(F.sum(F.col("n") * F.col("e.t")).alias("support"), F.sum(F.col("n") * F.col("e.p")).alias("called"), F.sum(F.col("n") * F.col("e.t") * F.col("hit")).alias("tp"))

    def share(a: Column, b: Column) -> Column:
        return F.coalesce(F.try_divide(a.cast("double"), b), F.lit(0.0))

    return g.select(*by, "label", share(F.col("tp"), F.col("called")).alias("precision"), share(F.col("tp"), F.col("support")).alias("recall"), share(2 * F.col("tp"), F.col("support") + F.col("called")).alias("f1"), "support", "tp")


def summary(matrix: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(by..., accuracy, macro_* and weighted_* of precision, recall, f1, n). The macro mean is over labels that occur as truth or prediction."""
    by = by or []
    seen = classwise(matrix, by)
    occurs = seen.join(matrix.where("n > 0").select(*by, F.explode(F.array("truth", "predicted")).alias("label")).distinct(), [*by, "label"], "left_semi")
    cols = []
    for m in ("precision", "recall", "f1"):
        cols += [F.avg(m).alias(f"macro_{m}"), F.try_divide(F.sum(F.col(m) * F.col("support")), F.sum("support")).alias(f"weighted_{m}")]
    return occurs.groupBy(*by).agg(F.try_divide(F.sum("tp").cast("double"), F.sum("support")).alias("accuracy"), *cols, F.sum("support").alias("n"))


def auc(rows: DataFrame, positive: str, score: str, by: list[str] | None = None, buckets: int = 4096, weight: str | None = None) -> DataFrame:
    """(by..., auc): the chance that a positive outscores a negative, ties half (mid-ranks); null without both kinds. Null and NaN scores are left out. weight: how often a row counts.

    Rows are first counted by distinct score; these go to buckets of equal
    width between the extremes, and only within a bucket are scores ordered.
    """
    by = by or []
    ok = rows.where(F.col(score).isNotNull() & ~F.isnan(F.col(score).cast("double")))
    c = ok.groupBy(*by, F.col(score).cast("double").alias("s")).agg(*(F.sum(F.when(c, F.col(weight) if weight else F.lit(1)).otherwise(0)).alias(n) for c, n in ((F.col(positive), "p"), (~F.col(positive), "q"))))
    ends = c.groupBy(*by).agg(F.min("s").alias("lo"), F.max("s").alias("hi"))
    c = (c.join(ends, by) if by else c.crossJoin(F.broadcast(ends))).withColumn("b", F.least(F.floor(F.coalesce(F.try_divide(F.col("s") - F.col("lo"), F.col("hi") - F.col("lo")), F.lit(0.0)) * buckets), F.lit(buckets - 1)))
    per = c.groupBy(*by, "b").agg(F.sum("q").alias("qb"))
    below = per.withColumn("below", F.sum("qb").over(Window.partitionBy(*by).orderBy("b")) - F.col("qb")).drop("qb")
    inner = c.join(below, [*by, "b"]).withColumn("lower", F.sum("q").over(Window.partitionBy(*by, "b").orderBy("s")) - F.col("q") + F.col("below"))
    g = inner.groupBy(*by).agg(F.sum(F.col("p") * (F.col("lower") + F.col("q") * 0.5)).alias("u"), F.sum("p").alias("n1"), F.sum("q").alias("n0"))
    return g.select(*by, F.try_divide(F.col("u"), F.col("n1").cast("double") * F.col("n0")).alias("auc"))


def macro_auc(rows: DataFrame, label: str, scores: str, labels: list, by: list[str] | None = None, weight: str | None = None) -> DataFrame:
    """(by..., auc): mean one-versus-rest area over the given labels; scores is an array in their order. With two labels the area is that of the second."""
    by = by or []
    extra = [weight] if weight else []
    pairs = rows.select(*by, *extra, F.col(label).alias("label"), F.posexplode(scores).alias("k", "s"))
    if len(labels) == 2:
        pairs = pairs.where("k = 1")
    names = F.array(*map(F.lit, labels))
    each = auc(pairs.select(*by, *extra, "k", (F.col("label") == F.element_at(names, F.col("k") + 1)).alias("y"), "s"), "y", "s", [*by, "k"], weight=weight)
    return each.groupBy(*by).agg(F.avg("auc").alias("auc"))
