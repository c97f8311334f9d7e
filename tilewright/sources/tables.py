"""Tables in Parquet, CSV and gzipped CSV, through Spark's own readers, so on any file system that Spark can open."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.matching import ContractError

#: Tried in this order.
SUFFIXES = (".parquet", ".csv.gz", ".csv", ".xlsx")


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    p, fs = _fs(spark, path)
    return fs.exists(p)


def find_table(spark: SparkSession, folder: str, stem: str) -> str:
    for s in SUFFIXES:
        if exists(spark, path := f"{folder}/{stem}{s}"):
            return path
    raise FileNotFoundError(f"none of {[stem + s for s in SUFFIXES]} in {folder}")


def unique_header(columns: list[str]) -> list[str]:
    """Trimmed names without blanks; a repeated one is an error."""
    names = [c.strip() for c in columns if c and c.strip()]
    if len(set(names)) < len(names):
        raise ContractError(f"repeated column names in {names}")
    return names


def read_table(spark: SparkSession, path: str, sheet: str | int = 0, multiline: bool = False) -> DataFrame:
    """All CSV columns are text: features are coerced by the audit and the preparation, not by a guess of the reader. With multiline, values may hold newlines, and each CSV file is one task. Workbooks need pandas with an Excel engine and are read on the driver."""
    low = path.lower()
    if low.endswith((".xlsx", ".xlsm", ".xls")):
        import pandas as pd

        df = spark.createDataFrame(pd.read_excel(path, sheet_name=sheet, dtype=str))
    elif low.endswith((".csv", ".csv.gz")):
        df = spark.read.csv(path, header=True, encoding="UTF-8", multiLine=multiline)
        first = df.columns[0] if df.columns else ""
        if first.startswith("﻿"):
            df = df.withColumnRenamed(first, first.lstrip("﻿"))
    else:
        df = spark.read.parquet(path)
    unique_header(df.columns)
    return df.toDF(*(c.strip() for c in df.columns))


def suffix_of(path: str) -> str:
    return next((s for s in SUFFIXES if path.lower().endswith(s)), "")


def write_table(df: DataFrame, path: str, order_by: str | None = None) -> str:
    """Format by suffix: .parquet, .csv or .csv.gz. With order_by, files in that order, as when rows get back their first order."""
    w = (df.orderBy(order_by) if order_by else df).write.mode("overwrite")
    if suffix_of(path) == ".csv.gz":
        w.csv(path, header=True, compression="gzip")
    elif suffix_of(path) == ".csv":
        w.csv(path, header=True)
    else:
        w.parquet(path)
    return path


def write_partitioned(df: DataFrame, path: str, by: tuple[str, ...] = ("scenario", "variant", "split")) -> str:
    """One table whose folders are the parts: a read of one scenario, variant and split opens no other file."""
    df.write.mode("overwrite").partitionBy(*[c for c in by if c in df.columns]).parquet(path)
    return path


def load_part(spark: SparkSession, path: str, scenario: str, variant: str, split: str, allow_test: bool = False) -> DataFrame:
    """Pruned to one part; Test is refused unless asked for."""
    if split == "Test" and not allow_test:
        raise ContractError("Test stays closed until the final evaluation")
    return spark.read.parquet(path).where((F.col("scenario") == scenario) & (F.col("variant") == variant) & (F.col("split") == split))


def require_shape(rows: DataFrame, names: list[str], metadata: DataFrame | None = None, features: str = "features") -> None:
    """As many features in each row as names, no name twice, and as many rows as the metadata has."""
    if len(set(names)) < len(names):
        raise ContractError("repeated feature names")
    if rows.where(F.col(features).isNull() | (F.size(features) != len(names))).head(1):
        raise ContractError(f"rows with other than {len(names)} features")
    if metadata is not None and (n := rows.count()) != (m := metadata.count()):
        raise ContractError(f"{n} rows of features and {m} of metadata")


def require_files(spark: SparkSession, paths: list[str]) -> None:
    """What a locked evaluation reads is all there."""
    if missing := [p for p in paths if not exists(spark, p)]:
        raise ContractError(f"missing: {missing}")


def replace_atomically(df: DataFrame, path: str, check: Callable[[DataFrame], None] | None = None) -> None:
    """Written whole beside path, read back, checked, then renamed: what check refuses (by raising) never reaches path.

    Between the two renames there is no table for a moment: a reader that
    finds none must look again. A failed second rename puts the old one back.
    """
    spark, end, mark = df.sparkSession, suffix_of(path), uuid.uuid4().hex
    bare = path[: len(path) - len(end)]
    new, old = f"{bare}.new-{mark}{end}", f"{bare}.old-{mark}{end}"
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    p, fs = _fs(spark, path)
    write_table(df, new)
    try:
        if check:
            check(read_table(spark, new))
        had = fs.exists(p)
        if had and not fs.rename(p, hadoop(old)):
            raise OSError(f"can't rename {path}")
        if not fs.rename(hadoop(new), p):
            if had:
                fs.rename(hadoop(old), p)
            raise OSError(f"can't rename {new}")
    finally:
        fs.delete(hadoop(new), True)
    fs.delete(hadoop(old), True)


def write_json(spark: SparkSession, value, path: str) -> None:
    p, fs = _fs(spark, path)
    out = fs.create(p, True)
    try:
        out.write(bytearray(json.dumps(value, indent=2, sort_keys=True, default=str).encode()))
    finally:
        out.close()


def read_json(spark: SparkSession, path: str):
    return json.loads("\n".join(r[0] for r in spark.read.text(path, wholetext=True).collect()))


def claim_lock(spark: SparkSession, path: str, again: bool = False) -> None:
    """Creates a marker file, or refuses: a locked evaluation runs once."""
    p, fs = _fs(spark, path)
    if again:
        fs.delete(p, False)
    if not fs.createNewFile(p):
        raise ContractError(f"{path} is there: this evaluation has been run")
