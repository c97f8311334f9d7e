"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shipping import ship

#: Rows of 8-byte ids, and bytes of lists, that may be broadcast; more are joined by a shuffle.
BROADCAST_IDS, BROADCAST_BYTES = 2_000_000, 32 << 20


def shared_root(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where unset, and only in local mode, one of our own."""
    sc = spark.sparkContext
    root = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not sc.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    root = "file://" + tempfile.mkdtemp(prefix="tilewright-")
    spark.conf.set("spark.checkpoint.dir", root)
    return root


_made: dict[str, list[str]] = {}


def clear(spark: SparkSession) -> None:
    """Deletes the tables of all runs of this application. Results that are still to be computed from them are lost."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for base in _made.pop(spark.sparkContext.applicationId, []):
        path = jvm.org.apache.hadoop.fs.Path(base)
        path.getFileSystem(conf).delete(path, True)


class Scratch:
    """Tables of one run of an operator: written once, reread from shared storage,
    so a lost executor costs no more than the stage it was in."""

    def __init__(self, spark: SparkSession, name: str):
        ship(spark)
        self.spark, self.base = spark, f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"
        _made.setdefault(spark.sparkContext.applicationId, []).append(self.base)

    def table(self, name: str, df: DataFrame) -> DataFrame:
        path = f"{self.base}/{name}"
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        """Only for tables that no result still to be computed reads."""
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(f"{self.base}/{name}")
            path.getFileSystem(conf).delete(path, True)


def keep_ids(df: DataFrame, ids: DataFrame, key: str, how: str = "left_semi") -> DataFrame:
    """Rows of df joined with ids (unique in key) on key. ids are broadcast
    only when their counted number is small; else both sides are shuffled."""
    small = ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    return df.join(F.broadcast(ids) if small else ids, key, how)


def keep_lists(df: DataFrame, lists: DataFrame, key: str, column: str) -> DataFrame:
    """Rows of df joined with lists (unique in key, with an array of small structs). lists are broadcast only when their counted size is small."""
    n, m = lists.agg(F.count("*"), F.coalesce(F.sum(F.size(column)), F.lit(0))).first()
    return df.join(F.broadcast(lists) if 64 * n + 48 * m <= BROADCAST_BYTES else lists, key)
