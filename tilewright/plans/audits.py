"""Quality audit over text-typed columns of lineitem, some of them spoilt."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import audit as A
from ..operators import preparation as P
from .base import longs, query, read, rounded

_SPOILT = "CASE (l_orderkey + l_linenumber) % 23 WHEN 0 THEN NULL WHEN 1 THEN ' ' WHEN 2 THEN 'abc' WHEN 3 THEN 'inf' WHEN 4 THEN '-Inf' WHEN 5 THEN '-' || CAST(l_quantity AS {text}) WHEN 6 THEN '1d' ELSE CAST(l_quantity AS {text}) END"
_SPLIT = "CASE WHEN l_linenumber < 6 THEN 'Train' WHEN l_linenumber = 6 THEN 'Validation' ELSE 'Test' END"
_PARTS = [("qty", _SPOILT), ("cronbach_d", "CAST(round(l_discount - 0.05{d}, 2) AS {text})"), ("flat", "CASE WHEN l_linenumber = 7 THEN '9' ELSE '5' END")]


def _long(kind: str, d: str) -> str:
    rows = [f"SELECT scenario, l_orderkey * 8 + l_linenumber AS row_id, '{name}' AS feature, {expr.format(text=kind, d=d)} AS raw, {_SPLIT} AS split FROM li" for name, expr in _PARTS]
    return " UNION ALL ".join(rows)


_LI = "SELECT l_orderkey, l_linenumber, l_quantity, l_discount, l_returnflag, 'All' AS scenario FROM {t} UNION ALL SELECT l_orderkey, l_linenumber, l_quantity, l_discount, l_returnflag, 'Pair' AS scenario FROM {t} WHERE l_returnflag IN ('A', 'R')"


def long_rows(spark: SparkSession, d: str) -> DataFrame:
    li = read(spark, d, "lineitem")
    return spark.sql(f"WITH li AS ({_LI.format(t='{li}')}) {_long('STRING', 'D')}", li=li)


_BASE = f"""li AS ({_LI.format(t='lineitem')}), long AS ({_long('VARCHAR', '::DOUBLE')}),
k AS (SELECT *, lower(regexp_replace(raw, '^\\s+|\\s+$', '', 'g')) AS t, feature LIKE 'cronbach%' AS allowed FROM long),
c AS (SELECT *, CASE WHEN t IS NULL OR t = '' OR t = 'nan' THEN 'Missing' WHEN t IN ('inf', '+inf') THEN 'Positive_Inf' WHEN t = '-inf' THEN 'Negative_Inf'
        WHEN NOT regexp_full_match(t, '[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?') THEN 'Text' END AS issue,
      CASE WHEN regexp_full_match(t, '[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?') THEN TRY_CAST(t AS DOUBLE) END AS value FROM k)"""
_TV = "value) FILTER (split = 'Train' AND value IS NOT NULL"
_ISSUES = ("Missing", "Text", "Positive_Inf", "Negative_Inf")
_COUNTS = ", ".join(f"count(*) FILTER (issue = '{i}') AS {i.lower()}_all, count(*) FILTER (issue = '{i}' AND split = 'Train') AS {i.lower()}_train" for i in _ISSUES)
_AUDIT = f"""{_BASE}, au AS (SELECT scenario, feature, count(*) AS total_rows, count(*) FILTER (split = 'Train') AS train_rows, NOT any_value(allowed) AS expected_nonnegative, {_COUNTS},
  count(*) FILTER (value < 0 AND NOT allowed) AS invalid_negative_all, count(*) FILTER (value < 0 AND NOT allowed AND split = 'Train') AS invalid_negative_train,
  count(*) FILTER (value < 0 AND allowed) AS negative_allowed_all, count(*) FILTER (value < 0 AND allowed AND split = 'Train') AS negative_allowed_train,
  count(DISTINCT {_TV}) AS unique_train, min({_TV}) AS min_train, max({_TV}) AS max_train, avg({_TV}) AS mean_train, stddev_samp({_TV}) AS std_train,
  quantile_cont(value, 0.5) FILTER (split = 'Train') AS median_train, quantile_cont(value, 0.25) FILTER (split = 'Train') AS q1_train, quantile_cont(value, 0.75) FILTER (split = 'Train') AS q3_train
  FROM c GROUP BY scenario, feature),
audit AS (SELECT *, q3_train - q1_train AS iqr_train, q1_train - 1.5 * (q3_train - q1_train) AS outlier_lower_train, q3_train + 1.5 * (q3_train - q1_train) AS outlier_upper_train, unique_train <= 1 AS constant_train,
  missing_all + text_all + positive_inf_all + negative_inf_all + invalid_negative_all + CAST(unique_train <= 1 AS BIGINT) AS flags FROM au)"""
_FLOATS = ["min_train", "max_train", "mean_train", "std_train", "median_train", "q1_train", "q3_train", "iqr_train", "outlier_lower_train", "outlier_upper_train"]


@query(f"WITH {_AUDIT} SELECT * REPLACE ({', '.join(f'round({x}, 6) + 0.0::DOUBLE AS {x}' for x in _FLOATS)}) FROM audit")
def audit_features(spark: SparkSession, d: str) -> DataFrame:
    return rounded(A.audit_features(long_rows(spark, d)), 6, *_FLOATS)


_OUTLIERS = """b AS (SELECT scenario, feature, coalesce(iqr_train > 0, false) AS usable, q1_train - 1.5 * iqr_train AS lower, q3_train + 1.5 * iqr_train AS upper FROM audit)"""


@query(f"""WITH {_AUDIT}, {_OUTLIERS}, n AS (SELECT scenario, feature, count(*) FILTER (usable AND (value < lower OR value > upper)) AS outliers_all_splits FROM c JOIN b USING (scenario, feature) GROUP BY ALL)
SELECT * REPLACE ({', '.join(f'round({x}, 6) + 0.0::DOUBLE AS {x}' for x in _FLOATS)}), row_number() OVER (PARTITION BY scenario ORDER BY flags DESC, outliers_all_splits DESC, feature) AS place FROM audit JOIN n USING (scenario, feature)""")
def audit_report(spark: SparkSession, d: str) -> DataFrame:
    return rounded(A.audit_report(long_rows(spark, d)), 6, *_FLOATS)


_COERCED = "CASE WHEN issue = 'Text' THEN 'non_numeric' WHEN issue = 'Positive_Inf' THEN 'positive_inf' WHEN issue = 'Negative_Inf' THEN 'negative_inf' WHEN value < 0 AND NOT allowed THEN 'invalid_negative' END AS became_null"


@query(f"WITH {_BASE} SELECT scenario, feature, row_id, split, CASE WHEN NOT coalesce(value < 0 AND NOT allowed, false) THEN value END AS value, {_COERCED} FROM c")
def prep_coerced(spark: SparkSession, d: str) -> DataFrame:
    return P.coerce(long_rows(spark, d))


@query(f"""WITH {_BASE}, n AS (SELECT scenario, split, {_COERCED} FROM c)
SELECT scenario, split, {", ".join(f"count(*) FILTER (became_null = '{k}') AS {k}" for k in ("non_numeric", "positive_inf", "negative_inf", "invalid_negative"))} FROM n GROUP BY ALL""")
def prep_coercion_counts(spark: SparkSession, d: str) -> DataFrame:
    return P.coercion_counts(P.coerce(long_rows(spark, d)))


@query(f"""WITH {_AUDIT}, b AS (SELECT scenario, feature, coalesce(iqr_train > 0, false) AS usable, q1_train - 1.5 * iqr_train AS lower, q3_train + 1.5 * iqr_train AS upper FROM audit),
n AS (SELECT scenario, feature, split, usable, lower, upper, count(*) AS rows, count(value) AS finite,
  count(*) FILTER (usable AND value < lower) AS low, count(*) FILTER (usable AND value > upper) AS high FROM c JOIN b USING (scenario, feature) GROUP BY ALL)
SELECT * REPLACE (round(lower, 6) + 0.0::DOUBLE AS lower, round(upper, 6) + 0.0::DOUBLE AS upper), round(coalesce((low + high) * 100.0::DOUBLE / nullif(finite, 0), 0), 6) + 0.0::DOUBLE AS percent FROM n""")
def audit_outliers(spark: SparkSession, d: str) -> DataFrame:
    return longs(rounded(A.audit_outliers(long_rows(spark, d)), 6, "lower", "upper", "percent"), "rows", "finite", "low", "high")


@query(f"""WITH {_BASE} SELECT scenario, feature, row_id, coalesce(issue, 'Negative') AS issue, raw FROM c WHERE issue IS NOT NULL OR (value < 0 AND NOT allowed)
QUALIFY row_number() OVER (PARTITION BY scenario, feature ORDER BY row_id, raw) <= 10""")
def audit_examples(spark: SparkSession, d: str) -> DataFrame:
    return A.audit_examples(long_rows(spark, d))


@query(f"WITH {_BASE} SELECT scenario, feature, split, count(*) AS n, count(raw) AS with_text FROM c GROUP BY ALL")
def value_counts(spark: SparkSession, d: str) -> DataFrame:
    return long_rows(spark, d).groupBy("scenario", "feature", "split").agg(F.count("*").alias("n"), F.count("raw").alias("with_text"))
