"""Group-aware splits over events: event types as classes, users as groups within each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import splitting as S
from .base import longs, query, read, rounded


def events(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "events").select("event_id", "event_type", F.col("user_id").cast("string").alias("user"))


_ASSIGN = """g AS (SELECT DISTINCT event_type AS class, CAST(user_id AS VARCHAR) AS grp FROM events WHERE user_id IS NOT NULL),
o AS (SELECT *, row_number() OVER (PARTITION BY class ORDER BY sha256(class || '|' || grp || '|42')) AS r, count(*) OVER (PARTITION BY class) AS n FROM g),
t AS (SELECT *, r <= ceil(n * 0.2::DOUBLE) AS test FROM o),
v AS (SELECT class, grp, row_number() OVER (PARTITION BY class ORDER BY sha256(class || '|' || grp || '|43')) AS r, count(*) OVER (PARTITION BY class) AS n FROM t WHERE NOT test),
a AS (SELECT class, grp, 'Test' AS split FROM t WHERE test UNION ALL SELECT class, grp, CASE WHEN r <= ceil(n * 0.1::DOUBLE) THEN 'Validation' ELSE 'Train' END FROM v),
s AS (SELECT event_id, event_type, CAST(user_id AS VARCHAR) AS grp, split FROM events JOIN a ON class = event_type AND a.grp = CAST(user_id AS VARCHAR))"""


@query(f'WITH {_ASSIGN} SELECT class, grp AS "group", split FROM a')
def group_split(spark: SparkSession, d: str) -> DataFrame:
    return S.assign_groups(events(spark, d), "event_type", "user")


@query(f"""WITH {_ASSIGN}, u AS (SELECT event_type AS class, split, grp FROM s UNION ALL SELECT 'ALL', split, grp FROM s),
c AS (SELECT class, split, count(*) AS n_rows, count(DISTINCT grp) AS n_groups FROM u GROUP BY 1, 2),
grid AS (SELECT DISTINCT c.class, x.split FROM c, (VALUES ('Train'), ('Validation'), ('Test')) x(split))
SELECT class, split, coalesce(n_rows, 0) AS n_rows, coalesce(n_groups, 0) AS n_groups,
       round(coalesce(n_rows, 0) * 100.0::DOUBLE / sum(coalesce(n_rows, 0)) OVER (PARTITION BY class), 6) + 0.0::DOUBLE AS percent_of_class FROM grid LEFT JOIN c USING (class, split)""")
def split_summary(spark: SparkSession, d: str) -> DataFrame:
    s = S.split_summary(S.split_rows(events(spark, d), "event_type", "user"), "event_type", "user")
    return longs(rounded(s, 6, "percent_of_class"), "n_rows", "n_groups")


@query(f"WITH {_ASSIGN} SELECT grp AS \"group\", count(DISTINCT split) AS n_splits, string_agg(DISTINCT split, ', ' ORDER BY split) AS splits, count(*) AS n_rows FROM s GROUP BY grp HAVING count(DISTINCT split) > 1")
def group_overlap(spark: SparkSession, d: str) -> DataFrame:
    return longs(S.group_overlap(S.split_rows(events(spark, d), "event_type", "user"), "user"), "n_rows")


@query("SELECT CAST(NULL AS VARCHAR) AS \"group\", CAST(0 AS BIGINT) AS n_splits, '' AS splits, CAST(0 AS BIGINT) AS n_rows WHERE false")
def class_group_overlap(spark: SparkSession, d: str) -> DataFrame:
    e = events(spark, d).withColumn("pair", F.concat_ws("-", "event_type", "user"))
    return longs(S.group_overlap(S.split_rows(e, "event_type", "user"), "pair"), "n_rows")
