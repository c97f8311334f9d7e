"""Screening and tuning of models over feature lists: what to run, in which order, and one ledger row for each run.

A run is one model with its parameters on one list of features of one
scenario. It learns from Train, answers for Validation and never sees Test.
"""

from __future__ import annotations

import json
import time

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import ledger as L
from . import metrics, models, neighbours, preparation, selection

STAGES = ("Screening", "Tuning")
_LEDGER = "run_id string, stage string, scenario string, method string, k int, model string, parameters string, status string, accuracy double, f1 double, seconds double, error string"


def _run(stage: str, scenario: str, method: str, k: int, model: str, params: dict) -> dict:
    return {"run_id": L.make_run_id(stage, scenario, method, k, model, params), "stage": stage, "scenario": scenario, "method": method, "k": k, "model": model, "parameters": json.dumps(params, sort_keys=True)}


def screening_runs(lists: DataFrame, scenario: str, names: list[str], fast: tuple[int, ...] | None = None) -> list[dict]:
    """Each model with its screening parameters on every list of the scenario. There are as many as methods, sizes and models."""
    checked = L.checked_names(names, tuple(models.SCREENING), "model")
    found = selection.discover(lists.where(F.col("scenario") == scenario), fast).orderBy("method", "k").collect()
    return [_run("Screening", scenario, r["method"], r["k"], m, models.SCREENING[m]) for m in checked for r in found]


def tuning_runs(lists: DataFrame, ledger: DataFrame, scenario: str, names: list[str], top: int = 3, fast: tuple[int, ...] | None = None) -> list[dict]:
    """Each model's tuning grid on the lists with its best completed screening results; an error while screening isn't complete."""
    spark = lists.sparkSession
    planned = screening_runs(lists, scenario, names, fast)
    if planned:
        L.require_complete(spark.createDataFrame([(r["run_id"],) for r in planned], "run_id string"), ledger)
    done = ledger.where((F.col("scenario") == scenario) & (F.col("stage") == "Screening") & (F.col("status") == "Completed") & F.col("model").isin(names))
    best = L.top_n(done, ["model"], top).orderBy("model", "rank").collect()
    return [_run("Tuning", scenario, r["method"], r["k"], r["model"], p) for r in best for p in models.TUNING[r["model"]]]


def answer(prepared: DataFrame, labels: DataFrame, features: list[str], model: str, params: dict) -> DataFrame:
    """prepared(scenario, row_id, split, feature, pos, clean, standard), labels(row_id, label) -> (row_id, label, predicted) of Validation rows, as text.

    The model reads the preparation that it is meant for: models.VARIANT.
    """
    value = models.VARIANT[model]
    long = prepared.where(F.col("feature").isin(features) & F.col("split").isin("Train", "Validation"))
    selection.require_features([r[0] for r in long.select("feature").distinct().collect()], features, "the prepared table")  # as many as features
    named = long.select("row_id", "split", "feature", "pos", F.col(value).alias("value")).join(labels, "row_id").withColumn("label", F.col("label").cast("string"))
    rows = preparation.to_wide(long, value).drop("scenario").join(labels, "row_id").withColumn("label", F.col("label").cast("string"))
    train, asked = rows.where("split = 'Train'").select("label", "features"), rows.where("split = 'Validation'").select("row_id", "label", "features")
    if model in ("svm_rbf", "svm_poly"):
        return models.run_bounded(rows.select("row_id", "label", "features", "split"), [{"name": model, "model": model, **params}]).drop("config")
    if model == "knn":
        known = rows.where("split = 'Train'").select(F.col("row_id").alias("id"), "features", "label")
        near = neighbours.nearest(known, asked.select(F.col("row_id").alias("id"), "features"), params["k"], itself=True)
        found = neighbours.vote_by_distance(near).withColumnRenamed("query", "row_id")
    elif model == "gnb":
        found = models.gnb_predict(models.gnb_fit(named.where("split = 'Train'"), **params), named.where("split = 'Validation'")).select("row_id", "predicted")
    elif model == "vote":
        return models.vote(train, asked, named.where("split = 'Train'"), named.where("split = 'Validation'"))
    else:
        fit = {"forest": models.fit_forest, "tree": models.fit_tree, "logistic": models.fit_logistic, "sgd": models.fit_sgd}[model]
        return models.predict(fit(train, **params), asked).select("row_id", "label", F.col("predicted").cast("string").alias("predicted"))
    return asked.select("row_id", "label").join(found.withColumn("predicted", F.col("predicted").cast("string")), "row_id")


def run_stage(stage: str, prepared: DataFrame, labels: DataFrame, lists: DataFrame, ledger: DataFrame | None, scenario: str, names: list[str], max_hours: float = 0.0, top: int = 3, fast: tuple[int, ...] | None = None) -> DataFrame:
    """The ledger with the rows of the stage's runs that weren't completed before. An error of one run becomes its row, and the next goes on."""
    if stage not in STAGES:
        raise selection.ContractError(f"no stage {stage}")
    spark = prepared.sparkSession
    before = spark.createDataFrame([], _LEDGER + ", at double") if ledger is None else ledger
    runs = screening_runs(lists, scenario, names, fast) if stage == "Screening" else tuning_runs(lists, before, scenario, names, top, fast)
    done = {r[0] for r in before.where("status = 'Completed'").select("run_id").collect()}  # as many as runs

    def work(run: dict) -> dict:
        began = time.monotonic()
        features = selection.selected(lists, scenario, run["method"], run["k"])
        got = metrics.summary(metrics.confusion(answer(prepared.where(F.col("scenario") == scenario), labels, features, run["model"], json.loads(run["parameters"])), "label", "predicted")).first()
        return {"accuracy": got["accuracy"], "f1": got["macro_f1"], "seconds": time.monotonic() - began}

    rows = L.run_grid(runs, done, work, max_hours)
    order = [c.split()[0] for c in _LEDGER.split(", ")]
    new = spark.createDataFrame([(*(r.get(c) for c in order), time.time()) for r in rows], _LEDGER + ", at double")
    return L.upsert(before, new)
