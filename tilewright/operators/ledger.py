"""The ledger of experiments: run ids, resumption, selection and reports."""

from __future__ import annotations

import hashlib
import json
import time

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .matching import ContractError


def canonical(value) -> str:
    """JSON with sorted keys and no spaces; text is parsed first."""
    return json.dumps(json.loads(value) if isinstance(value, str) else value, sort_keys=True, separators=(",", ":"))


def signature(config) -> str:
    return hashlib.sha256(json.dumps(config, sort_keys=True).encode()).hexdigest()


def make_run_id(stage: str, scenario: str, method: str, k: int, model: str, params: dict) -> str:
    return "|".join([stage, scenario, method, str(k), model, json.dumps(params, sort_keys=True)])


def checked_names(values: list[str], allowed: tuple[str, ...], kind: str) -> list[str]:
    """Repeated names once, in order; unknown ones are an error."""
    unknown = [v for v in values if v not in allowed]
    if unknown:
        raise ContractError(f"unknown {kind}: {unknown}")
    return list(dict.fromkeys(values))


def upsert(ledger: DataFrame, new: DataFrame, key: str = "run_id") -> DataFrame:
    """ledger with the rows of new in place of those with the same key; of repeated keys in new, the one with the largest `at`."""
    w = Window.partitionBy(key).orderBy(F.col("at").desc())
    last = new.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")
    return ledger.join(last, key, "left_anti").unionByName(last, allowMissingColumns=True)


def pending(grid: DataFrame, ledger: DataFrame, key: str = "run_id") -> DataFrame:
    """Of the planned runs, those without a completed row."""
    return grid.join(ledger.where("status = 'Completed'").select(key), key, "left_anti")


def require_complete(grid: DataFrame, ledger: DataFrame) -> None:
    """The gate before tuning: all planned screening runs are completed."""
    if left := pending(grid, ledger).take(3):
        raise ContractError(f"screening isn't complete: {[r['run_id'] for r in left]}")


def _order(*extra: str):
    return [F.col("accuracy").desc(), F.col("f1").desc(), *(F.col(c).asc() for c in extra)]


def top_n(ledger: DataFrame, by: list[str], n: int = 3, ties: tuple[str, ...] = ("k", "method")) -> DataFrame:
    """The n best rows of each key by accuracy, F1, then the tie columns ascending; with their rank."""
    w = Window.partitionBy(*by).orderBy(*_order(*ties))
    return ledger.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def tuned(ledger: DataFrame) -> DataFrame:
    """Completed tuning runs, of which the best are chosen; none is an error."""
    done = ledger.where("status = 'Completed' and trim(stage) = 'Tuning'")
    if not done.head(1):
        raise ContractError("no completed tuning run")
    return done


def best(ledger: DataFrame, by: list[str], ties: tuple[str, ...] = ("k", "method", "model")) -> DataFrame:
    """One row of each key: an aggregate with map-side combining, not a sort."""
    key = F.struct((-F.col("accuracy")).alias("a"), (-F.col("f1")).alias("f"), *ties)
    rest = [c for c in ledger.columns if c not in by]
    g = ledger.groupBy(*by).agg(F.min_by(F.struct(*rest), key).alias("r"))
    return g.select(*by, "r.*")


def experiment_summary(ledger: DataFrame, by: list[str]) -> DataFrame:
    return ledger.groupBy(*by).agg(F.count("*").alias("n"), F.max("accuracy").alias("best_accuracy"), F.avg("accuracy").alias("mean_accuracy"), F.sum("seconds").alias("seconds"))


def screening_aggregate(ledger: DataFrame, n_models: int, by: tuple[str, ...] = ("method", "k"), keep: int = 3) -> DataFrame:
    """Per (method, k) with all models done: mean, least and largest accuracy, mean F1, rank and whether it is selected."""
    g = ledger.groupBy("scenario", *by).agg(F.countDistinct("model").alias("models"), F.avg("accuracy").alias("accuracy"), F.min("accuracy").alias("least"), F.max("accuracy").alias("most"), F.avg("f1").alias("f1"))
    g = g.where(F.col("models") == n_models)
    w = Window.partitionBy("scenario").orderBy(*_order("k", "method"))
    return g.withColumn("rank", F.row_number().over(w)).withColumn("selected", F.col("rank") <= keep)


def seed_summary(runs: DataFrame, by: list[str], seeds: list[int]) -> DataFrame:
    """Mean and sample deviation over seeds; complete says whether exactly the expected seeds ran."""
    want = F.array(*map(F.lit, sorted(seeds)))
    g = runs.groupBy(*by).agg(F.avg("accuracy").alias("mean_accuracy"), F.stddev_samp("accuracy").alias("sd_accuracy"), F.avg("f1").alias("mean_f1"), F.stddev_samp("f1").alias("sd_f1"), F.array_sort(F.collect_set("seed")).alias("seeds"))
    return g.withColumn("complete", F.col("seeds") == want).withColumn("n_seeds", F.size("seeds").cast("long")).drop("seeds")


def best_epoch(history: DataFrame, by: list[str]) -> DataFrame:
    """The first epoch with the smallest validation loss; NaN losses don't count."""
    ok = history.where(F.col("val_loss").isNotNull() & ~F.isnan("val_loss"))
    return ok.groupBy(*by).agg(F.min(F.struct("val_loss", "epoch")).alias("m")).select(*by, "m.epoch", "m.val_loss")


def run_grid(runs: list[dict], done: set[str], work, max_hours: float = 0.0) -> list[dict]:
    """Calls work(run) for each run that isn't done; an error becomes a Failed row and the next run goes on. Stops between runs when max_hours (0: unlimited) are over."""
    out, began = [], time.monotonic()
    for run in runs:
        if run["run_id"] in done:
            continue
        if max_hours and time.monotonic() - began >= max_hours * 3600:
            break
        try:
            out.append(run | work(run) | {"status": "Completed", "error": None})
        except Exception as e:  # noqa: BLE001  the ledger keeps it
            out.append(run | {"status": "Failed", "error": f"{type(e).__name__}: {e}"[:500]})
    return out
