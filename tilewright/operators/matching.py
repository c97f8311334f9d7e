"""Joins under a uniqueness contract: group attachment in two stages, and transfer of columns with audits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import keys as K


class ContractError(ValueError):
    pass


def require_unique(df: DataFrame, key: str, what: str) -> None:
    found = [r[0] for r in df.groupBy(key).count().where("count > 1").select(key).take(5)]
    if found:
        raise ContractError(f"{what}: repeated keys, as {found}")


def require_columns(df: DataFrame, wanted: list[str], what: str) -> None:
    missing = [c for c in wanted if c not in df.columns]
    if missing:
        raise ContractError(f"{what}: columns {missing} are missing")


def attach_groups(features: DataFrame, groups: DataFrame, name: str, group_name: str = "filename", strict: bool = False) -> DataFrame:
    """features with the columns of groups (but group_name) and matched_by: name, stem or null.

    First by normalised file name; rows without a match then by stem, if that
    stem occurs once among the groups. Blank names match nothing. Names
    repeated in groups are an error. The number of rows stays. Whether either
    join is a broadcast is left to Spark, which knows the size of groups.
    """
    g = groups.withColumn("__key", K.basename(F.col(group_name))).withColumn("__stem", K.stem(F.col(group_name))).where("__key != ''")
    require_unique(g, "__key", "groups")
    carried = [c for c in groups.columns if c != group_name]
    struct = F.struct(*carried).alias("__g")
    by_name = g.select("__key", struct)
    lone = g.groupBy("__stem").agg(F.count("*").alias("n"), F.first(F.struct(*carried)).alias("__s")).where("n = 1").select("__stem", "__s")
    f = features.withColumn("__key", K.basename(F.col(name))).withColumn("__stem", K.stem(F.col(name)))
    first = f.join(by_name, "__key", "left").withColumn("__by", F.when(F.col("__g").isNotNull(), "name"))
    # only rows that are left go through the second join: those matched by name share no key there
    done = first.where("__by is not null or __stem = ''")
    left = first.where("__by is null and __stem != ''").drop("__g").join(lone.withColumnRenamed("__s", "__g"), "__stem", "left").withColumn("__by", F.when(F.col("__g").isNotNull(), "stem"))
    both = done.select(*features.columns, "__g", "__by").unionByName(left.select(*features.columns, "__g", "__by"))
    out = both.select(*features.columns, *(F.col(f"__g.{c}").alias(c) for c in carried), F.col("__by").alias("matched_by"))
    if strict and out.where("matched_by is null").head(1):
        raise ContractError("some rows match no group")
    return out


def with_names(rows: DataFrame, names: DataFrame, key: str, value: str) -> DataFrame:
    """rows with `value` looked up by normalised key where rows have no such column, or null in it. Keys that names has more than once give nothing."""
    found = usable_keys(names.withColumn("__key", K.match_key(key, F.col(key))), "__key").select("__key", F.col(value).alias("__value"))
    j = rows.withColumn("__key", K.match_key(key, F.col(key))).join(found, "__key", "left")
    kept = F.coalesce(F.col(value), F.col("__value")) if value in rows.columns else F.col("__value")
    return j.select(*[c for c in rows.columns if c != value], kept.alias(value))


def unmatched(attached: DataFrame) -> DataFrame:
    return attached.where("matched_by is null").drop("matched_by")


def usable_keys(reference: DataFrame, key: str) -> DataFrame:
    """Rows of reference whose key is neither null, blank nor repeated."""
    lone = reference.where(F.col(key).isNotNull() & (F.col(key) != "")).groupBy(key).count().where("count = 1").select(key)
    return reference.join(lone, key, "left_semi")


def ambiguous_keys(reference: DataFrame, key: str) -> DataFrame:
    """(key, n) of keys that occur more than once."""
    return reference.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n")).where("n > 1")


def transfer(target: DataFrame, reference: DataFrame, target_key: str, reference_key: str, columns: list[str], strict: bool = False) -> DataFrame:
    """target with `columns` of reference by normalised key, and `matched`.

    A column that target has is overwritten where matched, another is added.
    Repeated reference keys are unusable. Target rows all stay.
    """
    r = usable_keys(reference.withColumn("__key", K.match_key(reference_key, F.col(reference_key))), "__key").select("__key", *(F.col(c).alias(f"__{c}") for c in columns), F.lit(True).alias("__hit"))
    j = target.withColumn("__key", K.match_key(target_key, F.col(target_key))).join(r, "__key", "left")
    kept = [F.when(F.col("__hit"), F.col(f"__{c}")).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in target.columns]
    out = j.select(*kept, *(F.col(f"__{c}").alias(c) for c in columns if c not in target.columns), F.coalesce("__hit", F.lit(False)).alias("matched"))
    if strict and out.where("not matched").head(1):
        raise ContractError("some target rows match no reference row")
    return out


def mismatches(target: DataFrame, reference: DataFrame, target_key: str, reference_key: str, column: str, row_id: str) -> DataFrame:
    """(row_id, target_value, reference_value) of matched rows that disagree on a column, by the tolerant equality of that column."""
    r = usable_keys(reference.withColumn("__key", K.match_key(reference_key, F.col(reference_key))), "__key").select("__key", F.col(column).cast("string").alias("reference_value"))
    t = target.select(F.col(row_id), K.match_key(target_key, F.col(target_key)).alias("__key"), F.col(column).cast("string").alias("target_value"))
    return t.join(r, "__key").where(~K.tolerant_equal(F.col("target_value"), F.col("reference_value"), column)).select(row_id, "target_value", "reference_value")


def repeated_rows(target: DataFrame, key: str, row_id: str) -> DataFrame:
    """(row_id, key, n) of target rows whose normalised key others share."""
    t = target.select(F.col(row_id), K.match_key(key, F.col(key)).alias("match_value")).where("match_value != ''")
    return t.join(t.groupBy("match_value").agg(F.count("*").alias("n")).where("n > 1"), "match_value").select(row_id, "match_value", "n")


def aligned(a: DataFrame, b: DataFrame, row_id: str) -> DataFrame:
    """(row_id, side) of rows that only one of two variants has, or has more often; empty if they align."""
    x, y = (d.groupBy(row_id).count().withColumnRenamed("count", n) for d, n in ((a, "__a"), (b, "__b")))
    return x.join(y, row_id, "full").where("not (__a <=> __b)").select(row_id, F.when(F.coalesce("__a", F.lit(0)) > F.coalesce("__b", F.lit(0)), "left").otherwise("right").alias("side"))
