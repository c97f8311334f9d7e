"""Normalised keys and scalar rules as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What a numeric text looks like; anything else that a cast would accept is not a number here.
NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"
INFINITE = r"^[+-]?(inf|infinity)$"


def trimmed(x: Column) -> Column:
    return F.regexp_replace(x.cast("string"), r"^\s+|\s+$", "")


def basename(x: Column) -> Column:
    """Last path segment (either slash), lower case; null is empty."""
    return F.lower(F.element_at(F.split(F.replace(trimmed(F.coalesce(x.cast("string"), F.lit(""))), F.lit("\\"), F.lit("/")), "/"), -1))


def stem(x: Column) -> Column:
    """basename without its last extension; a leading or trailing dot makes none."""
    return F.regexp_replace(basename(x), r"(.)\.[^.]+$", "$1")


def match_key(column: str, x: Column) -> Column:
    """The key form of a match column: hashes lower case, names as basename, others trimmed."""
    name = column.lower()
    if "sha" in name:
        return F.lower(trimmed(x))
    return basename(x) if name in ("filename", "imgname", "imagepath") else trimmed(x)


def split_name(x: Column) -> Column:
    """Train, Validation or Test for their usual spellings; any other text trimmed."""
    low = F.lower(trimmed(x))
    return F.when(low.isin("train", "training"), "Train").when(low.isin("validation", "valid", "val"), "Validation").when(low.isin("test", "testing"), "Test").otherwise(trimmed(x))


def finite_number(x: Column) -> Column:
    """The value of a numeric text; null for blank, other text and infinities."""
    t = trimmed(x)
    return F.when(t.rlike(NUMBER), t.try_cast("double"))


def tolerant_equal(a: Column, b: Column, column: str) -> Column:
    """Of a column named label: equal as whole numbers, their fractions cut off, or else as trimmed text. Of others: as trimmed text regardless of case. Null is empty."""
    text = [F.coalesce(trimmed(c), F.lit("")) for c in (a, b)]
    if column != "label":
        return F.lower(text[0]) == F.lower(text[1])
    number = [F.when(c.rlike(NUMBER), c.try_cast("double")) for c in text]
    x, y = (F.signum(n) * F.floor(F.abs(n)) for n in number)
    return F.coalesce(x == y, text[0] == text[1])


def first_existing(columns: list[str], wanted: tuple[str, ...]) -> str | None:
    """Resolved while planning: the first wanted name that is a column."""
    return next((w for w in wanted if w in columns), None)


def safe_text(x: Column) -> Column:
    """A double for export: null for NaN, text for infinities."""
    return F.when(F.isnan(x), None).when(x == float("inf"), "Infinity").when(x == float("-inf"), "-Infinity").otherwise(x.cast("string"))


def is_consistency_feature(name: Column) -> Column:
    return F.lower(name).startswith("cronbach")


def run_id(*parts: Column) -> Column:
    return F.concat_ws("|", *parts)


def without_true(x: Column) -> Column:
    """A column name of a confusion table without its True_."""
    return F.regexp_replace(x, "^True_", "")
