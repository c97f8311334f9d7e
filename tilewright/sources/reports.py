"""Reports as folders of tables, tables that a chart can be drawn from, and saved models."""

from __future__ import annotations

import io

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import ledger, metrics
from ..operators.matching import ContractError
from ..operators.models import DenseNet, HuberMachine, KernelMachine
from .tables import _fs, write_json, write_table


def write_report(spark: SparkSession, folder: str, tables: dict[str, DataFrame], settings: dict, suffix: str = ".csv") -> None:
    """One table for each sheet of a report (summary, overlap, unmatched rows, ...), and settings.json."""
    for name, table in tables.items():
        write_table(table, f"{folder}/{name}{suffix}")
    write_json(spark, settings, f"{folder}/settings.json")


def write_issues(extracted: DataFrame, path: str) -> str:
    """The quality log: the rows of an extraction that have an issue, without their features."""
    return write_table(extracted.where("issue is not null").drop("features"), path)


def loss_curves(history: DataFrame, by: list[str]) -> DataFrame:
    """history(by..., epoch, loss, val_loss) -> with best: whether it is the epoch of the smallest validation loss, to be marked on the curve. Losses that aren't finite are an error."""
    bad = [F.col(c).isNull() | F.isnan(c) | (F.abs(F.col(c)) == float("inf")) for c in ("loss", "val_loss")]
    if history.where(bad[0] | bad[1]).head(1):
        raise ContractError("a history has losses that aren't finite")
    marks = ledger.best_epoch(history, by).select(*by, F.col("epoch").alias("__best"))
    return history.join(marks, by).withColumn("best", F.col("epoch") == F.col("__best")).drop("__best")


def confusion_cells(matrix: DataFrame) -> DataFrame:
    """confusion(truth, predicted, n) -> with percent of the true label, and dark: whether the cell's text is light, for counts and for percents."""
    top = matrix.agg(F.coalesce(F.max("n"), F.lit(0)).alias("__top"))
    cells = metrics.percent_of_truth(matrix).join(F.broadcast(top))  # one row
    return cells.withColumn("dark_count", F.col("n") >= 0.5 * F.col("__top")).withColumn("dark_percent", F.col("percent") >= 50).drop("__top")


_PARTS = {
    KernelMachine: ("x", "solution", "names", "gamma", "kernel", "degree", "coef0"),
    DenseNet: ("w", "b", "g", "h", "mean", "var", "names"),
    HuberMachine: ("w", "names"),
}
_LISTS = ("w", "b", "g", "h", "mean", "var")


def save_model(spark: SparkSession, model, path: str) -> None:
    """A kernel machine, dense net or Huber machine as arrays. Spark's own models have write()."""
    arrays = {"kind": np.array(type(model).__name__)}
    for part in _PARTS[type(model)]:
        v = getattr(model, part)
        if part in _LISTS and isinstance(v, list):
            arrays |= {f"{part}.{i}": a for i, a in enumerate(v)}
        else:
            arrays[part] = np.array(v)
    held = io.BytesIO()
    np.savez_compressed(held, **arrays)
    p, fs = _fs(spark, path)
    out = fs.create(p, True)
    try:
        out.write(bytearray(held.getvalue()))
    finally:
        out.close()


def load_model(spark: SparkSession, path: str):
    """What save_model wrote; it predicts as before."""
    raw = spark.read.format("binaryFile").load(path).select("content").first()[0]
    held = np.load(io.BytesIO(bytes(raw)), allow_pickle=False)
    kinds = {k.__name__: k for k in _PARTS}
    kind = kinds[str(held["kind"])]
    model = kind.__new__(kind)
    for part in _PARTS[kind]:
        many = sorted((n for n in held.files if n.startswith(f"{part}.")), key=lambda n: int(n.split(".")[1]))
        if many:
            setattr(model, part, [held[n] for n in many])
        else:
            v = held[part]
            setattr(model, part, v.item() if v.ndim == 0 else v.tolist() if kind is HuberMachine and part == "names" else v)
    return model
