"""Metrics, areas under curves, bootstrap and the experiment ledger."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import bootstrap as B
from ..operators import ledger as L
from ..operators import metrics as M
from ..operators import selection as S
from .base import longs, query, read, rounded


def predictions(spark: SparkSession, d: str) -> DataFrame:
    p = F.when(F.col("o_totalprice") < 150000, "F").when(F.col("o_totalprice") < 400000, "O").otherwise("X")
    return read(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("grp"), F.col("o_orderstatus").alias("truth"), p.alias("predicted"))


_PRED = "pred AS (SELECT o_orderkey, o_custkey AS grp, o_orderstatus AS truth, CASE WHEN o_totalprice < 150000 THEN 'F' WHEN o_totalprice < 400000 THEN 'O' ELSE 'X' END AS predicted FROM orders)"
_CM = f"""{_PRED}, lab AS (SELECT DISTINCT l FROM (SELECT truth AS l FROM pred UNION ALL SELECT predicted FROM pred)),
cm AS (SELECT a.l AS truth, b.l AS predicted, count(p.o_orderkey) AS n FROM lab a CROSS JOIN lab b LEFT JOIN pred p ON p.truth = a.l AND p.predicted = b.l GROUP BY 1, 2)"""


def _class_sql(cm: str, by: str = "") -> str:
    k = f"{by}, " if by else ""
    return f"""SELECT {k}label, sum(t * n) AS support, sum(p * n) AS called, sum(t * n * hit) AS tp FROM (
    SELECT {k}truth AS label, 1 AS t, 0 AS p, n, CAST(truth = predicted AS INT) AS hit FROM {cm} UNION ALL SELECT {k}predicted, 0, 1, n, 0 FROM {cm}) GROUP BY {k}label"""


_SCORES = "coalesce(tp / nullif(called, 0), 0) AS precision, coalesce(tp / nullif(support, 0), 0) AS recall, coalesce(2 * tp / nullif(support + called, 0), 0) AS f1"
_NAMES = ["accuracy", *(f"{a}_{m}" for m in ("precision", "recall", "f1") for a in ("macro", "weighted"))]
_SUMMARY = "sum(tp) / sum(support) AS accuracy, " + ", ".join(f"avg({m}) AS macro_{m}, sum({m} * support) / nullif(sum(support), 0) AS weighted_{m}" for m in ("precision", "recall", "f1"))


@query(f"WITH {_CM} SELECT truth, predicted, n FROM cm")
def confusion(spark: SparkSession, d: str) -> DataFrame:
    return M.confusion(predictions(spark, d), "truth", "predicted")


@query(f"WITH {_CM} SELECT truth, predicted, n, round(coalesce(n * 100.0::DOUBLE / nullif(sum(n) OVER (PARTITION BY truth), 0), 0), 6) + 0.0::DOUBLE AS percent FROM cm")
def confusion_pct(spark: SparkSession, d: str) -> DataFrame:
    return rounded(M.percent_of_truth(M.confusion(predictions(spark, d), "truth", "predicted")), 6, "percent")


@query(f"WITH {_CM}, c AS ({_class_sql('cm')}) SELECT label, CAST(support AS BIGINT) AS support, round(precision, 6) + 0.0::DOUBLE AS precision, round(recall, 6) + 0.0::DOUBLE AS recall, round(f1, 6) + 0.0::DOUBLE AS f1 FROM (SELECT *, {_SCORES} FROM c)")
def metrics_classwise(spark: SparkSession, d: str) -> DataFrame:
    c = M.classwise(M.confusion(predictions(spark, d), "truth", "predicted")).drop("tp")
    return longs(rounded(c, 6, "precision", "recall", "f1"), "support")


@query(f"WITH {_CM}, c AS ({_class_sql('cm')}), s AS (SELECT *, {_SCORES} FROM c) SELECT {', '.join(f'round({x}, 6) + 0.0::DOUBLE AS {x}' for x in _NAMES)}, CAST(n AS BIGINT) AS n FROM (SELECT {_SUMMARY}, sum(support) AS n FROM s)")
def metrics_macro_weighted(spark: SparkSession, d: str) -> DataFrame:
    return longs(rounded(M.summary(M.confusion(predictions(spark, d), "truth", "predicted")), 6, *_NAMES), "n")


def _auc_sql(by: str, source: str) -> str:
    k = f"{by}, " if by else ""
    part = f"PARTITION BY {by} " if by else ""
    part_s = f"PARTITION BY {by}, s" if by else "PARTITION BY s"
    return f"""SELECT {k}(sum(CASE WHEN y THEN mid END) - count(*) FILTER (y) * (count(*) FILTER (y) + 1) / 2.0::DOUBLE) / nullif(CAST(count(*) FILTER (y) AS DOUBLE) * count(*) FILTER (NOT y), 0) AS auc
  FROM (SELECT *, rank() OVER ({part}ORDER BY s) + (count(*) OVER ({part_s}) - 1) / 2.0::DOUBLE AS mid FROM {source}){f' GROUP BY {by}' if by else ''}"""


@query(f"WITH src AS (SELECT CAST(n_chars AS DOUBLE) AS s, quality = 1 AS y FROM documents JOIN labels USING (doc_id)) SELECT round(auc, 6) AS auc FROM ({_auc_sql('', 'src')})")
def auc_binary(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "documents").select("doc_id", "n_chars").join(read(spark, d, "labels").select("doc_id", (F.col("quality") == 1).alias("y")), "doc_id")
    return rounded(M.auc(rows, "y", "n_chars"), 6, "auc")


@query(f"""WITH src AS (SELECT k, label = k AS y, CAST(embedding[k + 1] AS DOUBLE) AS s FROM embeddings, (SELECT DISTINCT label AS k FROM embeddings))
SELECT round(avg(auc), 6) AS auc FROM ({_auc_sql('k', 'src')})""")
def auc_ovr_macro(spark: SparkSession, d: str) -> DataFrame:
    e = read(spark, d, "embeddings").select("label", "embedding")
    labels = sorted(r[0] for r in e.select("label").distinct().collect())
    cut = e.select("label", F.transform(F.array(*map(F.lit, labels)), lambda k: F.element_at("embedding", k.cast("int") + 1).cast("double")).alias("scores"))
    return rounded(M.macro_auc(cut, "label", "scores", labels), 6, "auc")


_TESTED = """tested AS (SELECT vec_id, 'g' || (vec_id % 97) AS grp, CASE WHEN label < 5 THEN 'a' ELSE 'b' END AS truth, CASE WHEN embedding[1] > embedding[2] THEN 'a' ELSE 'b' END AS predicted,
  CAST(embedding[2] AS DOUBLE) - CAST(embedding[1] AS DOUBLE) AS s FROM embeddings)"""


def tested(spark: SparkSession, d: str) -> DataFrame:
    """Predictions of two classes with scores, in source groups."""
    e, x = read(spark, d, "embeddings"), F.transform("embedding", lambda v: v.cast("double"))
    s = x[1] - x[0]
    return e.select("vec_id", F.concat(F.lit("g"), (F.col("vec_id") % 97).cast("string")).alias("grp"), F.when(F.col("label") < 5, "a").otherwise("b").alias("truth"), F.when(x[0] > x[1], "a").otherwise("b").alias("predicted"), F.array(-s, s).alias("scores"))


def _weighted_auc(source: str) -> str:
    return f"""SELECT draw, sum(p * (below + q * 0.5::DOUBLE)) / nullif(CAST(sum(p) AS DOUBLE) * sum(q), 0) AS macro_auc FROM (
    SELECT *, sum(q) OVER (PARTITION BY draw ORDER BY s) - q AS below FROM (SELECT draw, s, sum(CASE WHEN truth = 'b' THEN times ELSE 0 END) AS p, sum(CASE WHEN truth = 'b' THEN 0 ELSE times END) AS q FROM {source} GROUP BY ALL)) GROUP BY draw"""


_CI = list(B.METRICS)


@query(f"""WITH {_TESTED}, g AS (SELECT grp, row_number() OVER (ORDER BY md5(grp), grp) - 1 AS i FROM (SELECT DISTINCT grp FROM tested)), n AS (SELECT count(*) AS n FROM g),
t AS (SELECT draw, (draw * 7919 + j * 104729 + draw * j * 31 + 17) % 1000003 % n AS i, count(*) AS times FROM n, range({B.REPEATS}) a(draw), range((SELECT n FROM n)) b(j) GROUP BY ALL),
r AS (SELECT draw, times, truth, predicted, s FROM t JOIN g USING (i) JOIN tested p ON p.grp = g.grp),
cm AS (SELECT draw, truth, predicted, sum(times) AS n FROM r GROUP BY ALL),
c AS ({_class_sql('cm', 'draw')}), sc AS (SELECT *, {_SCORES} FROM c), m AS (SELECT * FROM (SELECT draw, {_SUMMARY} FROM sc GROUP BY draw) JOIN ({_weighted_auc('r')}) USING (draw)),
pc AS (SELECT truth, predicted, count(*) AS n FROM tested GROUP BY ALL), c1 AS ({_class_sql('pc')}), s1 AS (SELECT *, {_SCORES} FROM c1),
one AS (SELECT 0 AS draw, 1 AS times, truth, s FROM tested), p AS (SELECT * FROM (SELECT {_SUMMARY} FROM s1), ({_weighted_auc('one')}))
{" UNION ALL ".join(f"SELECT '{x}' AS metric, round((SELECT {x} FROM p), 6) + 0.0::DOUBLE AS point, round(quantile_cont({x}, 0.025), 6) + 0.0::DOUBLE AS lower, round(quantile_cont({x}, 0.975), 6) + 0.0::DOUBLE AS upper FROM m" for x in _CI)}""")
def bootstrap_ci(spark: SparkSession, d: str) -> DataFrame:
    p = tested(spark, d)
    dist = B.distribution(p, "truth", "predicted", "grp", B.hashed_draws(p, "grp"), "scores", ["a", "b"])
    point = M.summary(M.confusion(p, "truth", "predicted")).join(M.macro_auc(p, "truth", "scores", ["a", "b"]).withColumnRenamed("auc", "macro_auc"))
    return rounded(B.intervals(dist, point, _CI), 6, "point", "lower", "upper")


def ledger(spark: SparkSession, d: str) -> DataFrame:
    li = read(spark, d, "lineitem").withColumn("model", F.concat(F.lit("m"), (F.col("l_suppkey") % 9).cast("string")))
    g = li.groupBy(F.col("l_returnflag").alias("scenario"), F.col("l_linestatus").alias("method"), F.col("l_linenumber").cast("long").alias("k"), "model")
    r = g.agg(F.round(F.avg("l_discount"), 6).alias("accuracy"), F.round(F.avg("l_tax"), 6).alias("f1"), F.round(F.sum("l_quantity"), 2).alias("seconds"))
    return r.withColumn("run_id", F.concat_ws("|", "scenario", "method", F.col("k").cast("string"), "model"))


_LED = """led AS (SELECT l_returnflag AS scenario, l_linestatus AS method, CAST(l_linenumber AS BIGINT) AS k, 'm' || (l_suppkey % 9) AS model, round(avg(l_discount), 6) AS accuracy, round(avg(l_tax), 6) AS f1, round(sum(l_quantity), 2) AS seconds,
  l_returnflag || '|' || l_linestatus || '|' || l_linenumber || '|m' || (l_suppkey % 9) AS run_id FROM lineitem GROUP BY ALL)"""


@query(f"WITH {_LED} SELECT *, row_number() OVER (PARTITION BY scenario, model ORDER BY accuracy DESC, f1 DESC, k, method) AS rank FROM led QUALIFY rank <= 3")
def screening_top_n(spark: SparkSession, d: str) -> DataFrame:
    return longs(L.top_n(ledger(spark, d), ["scenario", "model"]), "rank")


@query(f"WITH {_LED} SELECT * FROM led QUALIFY row_number() OVER (PARTITION BY scenario ORDER BY accuracy DESC, f1 DESC, k, method, model) = 1")
def best_per_scenario(spark: SparkSession, d: str) -> DataFrame:
    return L.best(ledger(spark, d), ["scenario"])


_STAGED = f"{_LED}, staged AS (SELECT *, CASE WHEN k <= 4 THEN 'Screening' ELSE ' Tuning ' END AS stage, CASE WHEN model = 'm3' THEN 'Failed' ELSE 'Completed' END AS status FROM led)"


def staged(spark: SparkSession, d: str) -> DataFrame:
    return ledger(spark, d).withColumn("stage", F.when(F.col("k") <= 4, "Screening").otherwise(" Tuning ")).withColumn("status", F.when(F.col("model") == "m3", "Failed").otherwise("Completed"))


@query(f"WITH {_STAGED} SELECT * FROM staged WHERE trim(stage) = 'Tuning' AND status = 'Completed' QUALIFY row_number() OVER (PARTITION BY scenario, method ORDER BY accuracy DESC, f1 DESC, k, model) = 1")
def best_tuned(spark: SparkSession, d: str) -> DataFrame:
    return L.best(L.tuned(staged(spark, d)), ["scenario", "method"], ("k", "model"))


@query(f"WITH {_LED} SELECT scenario, method, k, model, accuracy, CASE scenario WHEN 'R' THEN 1 WHEN 'A' THEN 2 ELSE 3 END AS place FROM led QUALIFY row_number() OVER (PARTITION BY scenario ORDER BY accuracy DESC, f1 DESC, k, method, model) = 1")
def scenario_report(spark: SparkSession, d: str) -> DataFrame:
    rows = L.best(ledger(spark, d), ["scenario"]).select("scenario", "method", "k", "model", "accuracy")
    return S.in_scenario_order(rows, ("R", "A", "N")).withColumn("place", F.col("place").cast("int"))


@query(f"WITH {_LED} SELECT * EXCLUDE (scenario) FROM led ORDER BY accuracy DESC, f1 DESC, scenario, k, method, model LIMIT 1")
def global_winner(spark: SparkSession, d: str) -> DataFrame:
    led = ledger(spark, d).withColumn("all", F.lit(1))
    return L.best(led, ["all"], ("scenario", "k", "method", "model")).drop("all", "scenario")


@query(f"""WITH {_LED}, g AS (SELECT scenario, method, k, count(DISTINCT model) AS models, avg(accuracy) AS accuracy, min(accuracy) AS least, max(accuracy) AS most, avg(f1) AS f1 FROM led GROUP BY ALL HAVING count(DISTINCT model) = 9)
SELECT scenario, method, k, models, round(accuracy, 6) + 0.0::DOUBLE AS accuracy, least, most, round(f1, 6) + 0.0::DOUBLE AS f1, row_number() OVER w AS rank, row_number() OVER w <= 3 AS selected FROM g WINDOW w AS (PARTITION BY scenario ORDER BY accuracy DESC, f1 DESC, k, method)""")
def screening_aggregate(spark: SparkSession, d: str) -> DataFrame:
    return longs(rounded(L.screening_aggregate(ledger(spark, d), 9), 6, "accuracy", "f1"), "rank")


@query(f"WITH {_LED} SELECT scenario, method, count(*) AS n, max(accuracy) AS best_accuracy, round(avg(accuracy), 6) + 0.0::DOUBLE AS mean_accuracy, round(sum(seconds), 2) AS seconds FROM led GROUP BY 1, 2")
def experiment_summary(spark: SparkSession, d: str) -> DataFrame:
    return rounded(rounded(L.experiment_summary(ledger(spark, d), ["scenario", "method"]), 6, "mean_accuracy"), 2, "seconds")


@query("""WITH r AS (SELECT l_returnflag AS scenario, l_linestatus AS method, CAST(l_linenumber % 3 AS INTEGER) AS seed, avg(l_discount) AS accuracy, avg(l_tax) AS f1 FROM lineitem GROUP BY ALL)
SELECT scenario, method, round(avg(accuracy), 6) + 0.0::DOUBLE AS mean_accuracy, round(stddev_samp(accuracy), 6) + 0.0::DOUBLE AS sd_accuracy, round(avg(f1), 6) + 0.0::DOUBLE AS mean_f1, round(stddev_samp(f1), 6) + 0.0::DOUBLE AS sd_f1, list_sort(list(DISTINCT seed)) = [0, 1, 2] AS complete, count(DISTINCT seed) AS n_seeds FROM r GROUP BY 1, 2""")
def seed_summary(spark: SparkSession, d: str) -> DataFrame:
    runs = read(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("scenario"), F.col("l_linestatus").alias("method"), (F.col("l_linenumber") % 3).cast("int").alias("seed")).agg(F.avg("l_discount").alias("accuracy"), F.avg("l_tax").alias("f1"))
    return rounded(L.seed_summary(runs, ["scenario", "method"], [0, 1, 2]), 6, "mean_accuracy", "sd_accuracy", "mean_f1", "sd_f1")


@query(f"WITH {_LED} SELECT run_id, CASE WHEN k <= 3 THEN accuracy + 1 ELSE accuracy END AS accuracy, CASE WHEN k <= 3 THEN 2 ELSE 0 END AS \"at\" FROM led")
def ledger_upsert(spark: SparkSession, d: str) -> DataFrame:
    led = ledger(spark, d)
    old = led.select("run_id", "accuracy", F.lit(0).alias("at"))
    new = led.where("k <= 3")
    new = new.select("run_id", "accuracy", F.lit(1).alias("at")).unionByName(new.select("run_id", (F.col("accuracy") + 1).alias("accuracy"), F.lit(2).alias("at")))
    return L.upsert(old, new)


@query(f"WITH {_LED} SELECT run_id FROM led WHERE k > 5 OR model = 'm4'")
def tuning_gate(spark: SparkSession, d: str) -> DataFrame:
    led = ledger(spark, d)
    done = led.where("k <= 5").select("run_id", F.when(F.col("model") == "m4", "Failed").otherwise("Completed").alias("status"))
    return L.pending(led.select("run_id"), done)


@query("SELECT o_orderstatus AS scenario, arg_min(o_custkey, (val_loss, o_custkey)) AS epoch, min(val_loss) AS val_loss FROM (SELECT *, round(o_totalprice / 1000, 0) AS val_loss FROM orders) GROUP BY 1")
def best_epoch(spark: SparkSession, d: str) -> DataFrame:
    h = read(spark, d, "orders").select(F.col("o_orderstatus").alias("scenario"), F.col("o_custkey").alias("epoch"), F.round(F.col("o_totalprice") / 1000, 0).alias("val_loss"))
    return L.best_epoch(h, ["scenario"])


@query("SELECT o_orderstatus AS label, CAST(dense_rank() OVER (ORDER BY o_orderstatus) - 1 AS INTEGER) AS code FROM (SELECT DISTINCT o_orderstatus FROM orders WHERE o_orderstatus IS NOT NULL)")
def label_codes(spark: SparkSession, d: str) -> DataFrame:
    return M.encode_labels(read(spark, d, "orders"), "o_orderstatus").withColumn("code", F.col("code").cast("int"))


@query("SELECT c_nationkey AS label, CASE WHEN count(DISTINCT c_mktsegment) = 1 THEN any_value(c_mktsegment) ELSE CAST(c_nationkey AS VARCHAR) END AS display FROM customer GROUP BY 1")
def display_names(spark: SparkSession, d: str) -> DataFrame:
    return M.display_names(read(spark, d, "customer"), "c_nationkey", "c_mktsegment")


@query("SELECT vec_id, CAST(list_position(embedding, list_max(embedding)) - 1 AS INTEGER) AS code FROM embeddings")
def argmax_codes(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "embeddings").select("vec_id", M.argmax_label(F.col("embedding")).alias("code"))
