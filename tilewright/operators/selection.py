"""Choosing what to run and what to freeze: feature lists from rankings, and checks before a locked evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .matching import ContractError

#: The scenarios in the order of reports, and the names that are never features.
SCENARIOS = ("Binary", "Three_Class", "Five_Class")
METADATA = frozenset(
    {
        "ImgName",
        "FileName",
        "ImagePath",
        "ClassName",
        "label",
        "SourceGroupID",
        "PatchSize",
        "ImageWidth",
        "ImageHeight",
        "ImageSHA256",
        "Split",
        "split",
        "stem",
        "filename",
        "tissue",
        "group_id",
        "local_cluster_label",
        "LC25000_ClassName",
        "LC25000_FileName",
        "LC25000_Tissue",
        "Previous_SourceGroupID",
        "_match_stem_LC25000",
        "LC25000_GroupID",
        "LC25000_LocalCluster",
    }
)


def feature_columns(columns: list[str]) -> list[str]:
    """Every column that isn't metadata and doesn't begin with Unnamed:, in order."""
    return [c.strip() for c in columns if c.strip() not in METADATA and not c.strip().startswith("Unnamed:")]


def discover(ranking: DataFrame, fast: tuple[int, ...] | None = None) -> DataFrame:
    """(method, k) to run from the lists that exist; of AllMsr only the longest; with fast, only these k."""
    ks = ranking.select("method", "k").distinct()
    top = ks.where("method = 'AllMsr'").groupBy("method").agg(F.max("k").alias("k"))
    rest = ks.where("method != 'AllMsr'")
    return (rest.where(F.col("k").isin(*fast)) if fast else rest).unionByName(top)


def selected(lists: DataFrame, scenario: str, method: str, k: int) -> list[str]:
    """The names of one list in rank order; wrong length or repeated names are an error."""
    names = [r["feature"] for r in list_features(lists, scenario, method, k).limit(k + 1).collect()]
    if len(names) != k or len(set(names)) != k:
        raise ContractError(f"{method} has {len(set(names))} of {k} features for {scenario}")
    return names


def require_features(columns: list[str], wanted: list[str], what: str) -> None:
    if missing := [w for w in wanted if w not in set(columns)]:
        raise ContractError(f"{what}: features {missing[:5]} are missing")


def require_only_split(rows: DataFrame, split: str) -> None:
    """A loaded part holds rows of its split only."""
    if rows.where(~F.col("split").eqNullSafe(split)).head(1):
        raise ContractError(f"rows of another split than {split}")


def require_finite(rows: DataFrame, features: str = "features") -> None:
    bad = F.exists(features, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    if rows.where(bad).head(1):
        raise ContractError("features that aren't finite")


def require_winner(frozen: dict, winner: dict, tolerance: float = 1e-15) -> None:
    """The frozen configuration is what validation picks."""
    for k, v in frozen.items():
        w = winner.get(k)
        if (abs(v - w) > tolerance) if isinstance(v, float) and isinstance(w, float) else v != w:
            raise ContractError(f"frozen {k} is {v!r}, validation picks {w!r}")


def in_scenario_order(rows: DataFrame, order: tuple[str, ...] = SCENARIOS, column: str = "scenario") -> DataFrame:
    """One report row for each scenario, with its place from 1; a missing or repeated scenario is an error, others are left out."""
    place = F.array_position(F.array(*map(F.lit, order)), F.col(column))
    found = rows.withColumn("place", place).where("place > 0")
    n = {r[0]: r[1] for r in found.groupBy(column).count().collect()}  # as many as scenarios
    if missing := [s for s in order if n.get(s) != 1]:
        raise ContractError(f"not one row each for {missing}")
    return found.orderBy("place")


def list_features(lists: DataFrame, scenario: str, method: str, k: int) -> DataFrame:
    """(rank, feature) of one list, by rank."""
    return lists.where((F.col("scenario") == scenario) & (F.col("method") == method) & (F.col("k") == k)).select("rank", "feature").orderBy("rank")
