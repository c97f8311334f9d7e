"""Preparation and feature ranking over embedding dimensions, with some values taken out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import preparation as P
from ..operators import ranking as R
from ..operators import selection as S
from .base import longs, query, read, rounded


def long_rows(spark: SparkSession, d: str) -> DataFrame:
    e = read(spark, d, "embeddings").select(F.col("vec_id").alias("row_id"), "label", F.posexplode("embedding").alias("pos", "v"))
    value = F.when((F.col("row_id") + F.col("pos")) % 17 != 0, F.when(F.col("pos") == 5, F.lit(3.0)).otherwise(F.col("v").cast("double")))
    split = F.when(F.col("row_id") % 10 < 7, "Train").when(F.col("row_id") % 10 == 7, "Validation").otherwise("Test")
    return e.select(F.lit("All").alias("scenario"), "row_id", F.concat(F.lit("f"), F.col("pos").cast("string")).alias("feature"), "pos", value.alias("value"), split.alias("split"), "label")


_LONG = """x AS (SELECT vec_id AS row_id, label, unnest(embedding) AS v, unnest(range(len(embedding))) AS pos FROM embeddings),
long AS (SELECT 'All' AS scenario, row_id, 'f' || pos AS feature, CAST(pos AS INTEGER) AS pos, label,
  CASE WHEN (row_id + pos) % 17 <> 0 THEN CASE WHEN pos = 5 THEN 3.0::DOUBLE ELSE CAST(v AS DOUBLE) END END AS value,
  CASE WHEN row_id % 10 < 7 THEN 'Train' WHEN row_id % 10 = 7 THEN 'Validation' ELSE 'Test' END AS split FROM x),
p1 AS (SELECT scenario, feature, min(pos) AS pos, quantile_cont(value, 0.5) AS median, count(*) FILTER (value IS NULL) AS missing, coalesce(min(value) = max(value), true) AS constant FROM long WHERE split = 'Train' GROUP BY 1, 2),
p2 AS (SELECT p1.*, q1, q3, q3 - q1 AS iqr, CASE WHEN q3 > q1 THEN q1 - 1.5 * (q3 - q1) END AS lower, CASE WHEN q3 > q1 THEN q3 + 1.5 * (q3 - q1) END AS upper
  FROM p1 JOIN (SELECT l.scenario, l.feature, quantile_cont(coalesce(value, median), 0.25) AS q1, quantile_cont(coalesce(value, median), 0.75) AS q3 FROM long l JOIN p1 USING (scenario, feature) WHERE split = 'Train' GROUP BY 1, 2) USING (scenario, feature)),
cut AS (SELECT l.*, p2.* EXCLUDE (scenario, feature, pos), coalesce(value, median) AS filled, least(greatest(coalesce(value, median), lower), upper) AS clean FROM long l JOIN p2 USING (scenario, feature)),
params AS (SELECT p2.*, mean, std, lo AS min, hi AS max, NOT constant AS keep FROM p2 JOIN (
  SELECT scenario, feature, avg(clean) AS mean, stddev_pop(clean) AS std, min(clean) AS lo, max(clean) AS hi FROM cut WHERE split = 'Train' GROUP BY 1, 2) USING (scenario, feature)),
prep AS (SELECT c.scenario, c.row_id, c.feature, c.pos, c.label, c.split, c.clean, coalesce((c.clean - mean) / nullif(std, 0), 0) AS standard, coalesce((c.clean - p.min) / nullif(p.max - p.min, 0), 0) AS minmax,
  c.value IS NULL AS was_missing, coalesce(filled < c.lower, false) AS low, coalesce(filled > c.upper, false) AS high FROM cut c JOIN params p USING (scenario, feature) WHERE keep)"""
_PARAM = ["median", "q1", "q3", "iqr", "lower", "upper", "mean", "std", "min", "max"]


@query(f"WITH {_LONG} SELECT * REPLACE ({', '.join(f'round({x}, 6) + 0.0::DOUBLE AS {x}' for x in _PARAM)}) FROM params")
def prep_params(spark: SparkSession, d: str) -> DataFrame:
    return rounded(P.fit(long_rows(spark, d)), 6, *_PARAM)


def prepared(spark: SparkSession, d: str) -> DataFrame:
    rows = long_rows(spark, d)
    return P.transform(rows, P.frozen(P.fit(rows)))


@query(f"WITH {_LONG} SELECT row_id, feature, split, round(standard, 6) + 0.0::DOUBLE AS standard FROM prep")
def prep_standard(spark: SparkSession, d: str) -> DataFrame:
    return rounded(prepared(spark, d).select("row_id", "feature", "split", "standard"), 6, "standard")


@query(f"WITH {_LONG} SELECT row_id, feature, split, round(minmax, 6) + 0.0::DOUBLE AS minmax FROM prep")
def prep_minmax(spark: SparkSession, d: str) -> DataFrame:
    return rounded(prepared(spark, d).select("row_id", "feature", "split", "minmax"), 6, "minmax")


@query(f"WITH {_LONG} SELECT row_id, feature, split, round(clean, 6) + 0.0::DOUBLE AS clean FROM prep")
def prep_clean(spark: SparkSession, d: str) -> DataFrame:
    return rounded(prepared(spark, d).select("row_id", "feature", "split", "clean"), 6, "clean")


@query(f"WITH {_LONG} SELECT scenario, split, count(*) AS n_values, count(*) FILTER (was_missing) AS missing, count(*) FILTER (clean IS NULL) AS missing_after, count(*) FILTER (low) AS low, count(*) FILTER (high) AS high FROM prep GROUP BY 1, 2")
def prep_counts(spark: SparkSession, d: str) -> DataFrame:
    return P.counts(prepared(spark, d))


def train(spark: SparkSession, d: str, variant: str) -> DataFrame:
    """Train rows of one variant, with value."""
    return prepared(spark, d).where("split = 'Train'").drop("value").withColumnRenamed(variant, "value")


_VAR = "variance AS (SELECT scenario, feature, pos, var_pop(clean) AS score FROM prep WHERE split = 'Train' GROUP BY ALL)"
_CHI = """cc AS (SELECT scenario, feature, pos, label, count(*) AS n, sum(minmax) AS s FROM prep WHERE split = 'Train' GROUP BY ALL),
ce AS (SELECT *, sum(s) OVER w * n / sum(n) OVER w AS e FROM cc WINDOW w AS (PARTITION BY scenario, feature)),
chi2 AS (SELECT scenario, feature, pos, sum((s - e) ** 2 / nullif(e, 0)) AS score, count(*) - 1 AS df FROM ce GROUP BY ALL)"""
_F = """fc AS (SELECT scenario, feature, pos, label, count(*) AS n, avg(standard) AS m, var_pop(standard) * count(*) AS ss, sum(standard) AS s FROM prep WHERE split = 'Train' GROUP BY ALL),
fg AS (SELECT *, sum(s) OVER w / sum(n) OVER w AS grand FROM fc WINDOW w AS (PARTITION BY scenario, feature)),
anova AS (SELECT scenario, feature, pos, (sum(n * (m - grand) ** 2) / (count(*) - 1)) / nullif(sum(ss) / (sum(n) - count(*)), 0) AS score, count(*) - 1 AS df, sum(n) - count(*) AS df2 FROM fg GROUP BY ALL)"""


def _rank(t: str, name: str) -> str:
    return f"SELECT scenario, '{name}' AS method, feature, pos, score, row_number() OVER (PARTITION BY scenario ORDER BY round(score, 9) DESC, pos) AS rank FROM {t}"


def _scored(df: DataFrame) -> DataFrame:
    """Scores tied but for summation order rank by position."""
    return df.withColumn("score", F.round("score", 9))


@query(f"WITH {_LONG}, {_VAR} SELECT scenario, method, feature, pos, rank, round(score, 6) + 0.0::DOUBLE AS score FROM ({_rank('variance', 'Variance')})")
def rank_variance(spark: SparkSession, d: str) -> DataFrame:
    return longs(rounded(R.rank(_scored(R.variance(train(spark, d, "clean"))), "Variance"), 6, "score"), "rank")


@query(f"WITH {_LONG}, {_CHI} SELECT scenario, method, feature, pos, rank, round(score, 6) + 0.0::DOUBLE AS score FROM ({_rank('chi2', 'Chi2')})")
def rank_chi2(spark: SparkSession, d: str) -> DataFrame:
    return longs(rounded(R.rank(_scored(R.chi2(train(spark, d, "minmax"))), "Chi2"), 6, "score"), "rank")


@query(f"WITH {_LONG}, {_F} SELECT scenario, method, feature, pos, rank, round(score, 6) + 0.0::DOUBLE AS score FROM ({_rank('anova', 'Fclass')})")
def rank_anova(spark: SparkSession, d: str) -> DataFrame:
    return longs(rounded(R.rank(_scored(R.anova(train(spark, d, "standard"))), "Fclass"), 6, "score"), "rank")


#: Upper tails as series: of the incomplete beta function, and of the incomplete gamma function.
_F_TAIL = "sum(exp(lgamma(a + b + j) - lgamma(b) - lgamma(a + j + 1) + (a + j) * ln(x) + b * ln(1 - x)))"
_CHI_TAIL = "1 - sum(exp((a + j) * ln(x) - x - lgamma(a + j + 1)))"


@query(f"""WITH {_LONG}, {_F}, v AS (SELECT *, df2 / 2.0::DOUBLE AS a, df / 2.0::DOUBLE AS b, df2 / (df2 + df * score) AS x FROM anova)
SELECT scenario, feature, pos, round(score, 6) + 0.0::DOUBLE AS score, df, CAST(df2 AS BIGINT) AS df2, round({_F_TAIL}, 7) + 0.0::DOUBLE AS p_value FROM v, range(20000) r(j) GROUP BY ALL""")
def anova_p_values(spark: SparkSession, d: str) -> DataFrame:
    return longs(rounded(rounded(R.p_values(R.anova(train(spark, d, "standard")), "f"), 7, "p_value"), 6, "score"), "df", "df2")


@query(f"""WITH {_LONG}, {_CHI}, v AS (SELECT *, df / 2.0::DOUBLE AS a, score / 2.0::DOUBLE AS x FROM chi2)
SELECT scenario, feature, pos, round(score, 6) + 0.0::DOUBLE AS score, df, round({_CHI_TAIL}, 7) + 0.0::DOUBLE AS p_value FROM v, range(2000) r(j) GROUP BY ALL""")
def chi2_p_values(spark: SparkSession, d: str) -> DataFrame:
    return longs(rounded(rounded(R.p_values(R.chi2(train(spark, d, "minmax")), "chi2"), 7, "p_value"), 6, "score"), "df")


_ALL = f"""{_LONG}, {_VAR}, {_CHI}, {_F}, every AS ({_rank('variance', 'Variance')} UNION ALL {_rank('chi2', 'Chi2')} UNION ALL {_rank('anova', 'Fclass')}
  UNION ALL SELECT DISTINCT scenario, 'AllMsr' AS method, feature, pos, 1.0 AS score, dense_rank() OVER (PARTITION BY scenario ORDER BY pos) AS rank FROM prep WHERE split = 'Train'),
n AS (SELECT scenario, method, max(rank) AS n FROM every GROUP BY ALL),
ks AS (SELECT DISTINCT scenario, method, least(k, n) AS k FROM n, unnest({list(R.K_VALUES)}) t(k) UNION SELECT scenario, method, n FROM n),
lists AS (SELECT scenario, method, k, rank, feature FROM every JOIN ks USING (scenario, method) WHERE rank <= k)"""


def _lists(spark: SparkSession, d: str) -> DataFrame:
    ranks = [R.rank(_scored(R.variance(train(spark, d, "clean"))), "Variance"), R.rank(_scored(R.chi2(train(spark, d, "minmax"))), "Chi2"), R.rank(_scored(R.anova(train(spark, d, "standard"))), "Fclass"), R.all_features(train(spark, d, "clean"))]
    every = ranks[0]
    for r in ranks[1:]:
        every = every.unionByName(r)
    return R.top_k(every)


@query(f"WITH {_ALL} SELECT scenario, method, CAST(k AS BIGINT) AS k, rank, feature FROM lists")
def topk_lists(spark: SparkSession, d: str) -> DataFrame:
    return longs(_lists(spark, d), "k", "rank")


@query(f"""WITH {_ALL} SELECT DISTINCT method, CAST(k AS BIGINT) AS k FROM lists WHERE method <> 'AllMsr' AND k IN (25, 50) UNION SELECT method, CAST(max(k) AS BIGINT) FROM lists WHERE method = 'AllMsr' GROUP BY 1""")
def selection_discover(spark: SparkSession, d: str) -> DataFrame:
    return longs(S.discover(_lists(spark, d), (25, 50)), "k")


@query(f"WITH {_ALL} SELECT rank, feature FROM lists WHERE method = 'Fclass' AND k = 25")
def selection_features(spark: SparkSession, d: str) -> DataFrame:
    return longs(S.list_features(_lists(spark, d), "All", "Fclass", 25), "rank")


@query(f"""WITH {_ALL}, s AS (SELECT scenario, k, method, list(feature) AS l FROM lists GROUP BY ALL)
SELECT a.scenario, CAST(a.k AS BIGINT) AS k, a.method AS method_a, b.method AS method_b, CAST(len(list_intersect(a.l, b.l)) AS BIGINT) AS common,
  round(len(list_intersect(a.l, b.l)) / len(list_distinct(list_concat(a.l, b.l))), 6) + 0.0::DOUBLE AS jaccard FROM s a JOIN s b ON a.scenario = b.scenario AND a.k = b.k AND a.method < b.method""")
def method_jaccard(spark: SparkSession, d: str) -> DataFrame:
    return longs(rounded(R.jaccard(_lists(spark, d)), 6, "jaccard"), "k")


@query()
def rank_mutual_info(spark: SparkSession, d: str) -> DataFrame:
    return R.rank(R.mutual_information(train(spark, d, "standard")), "Mutclass")
