"""Key rules, two-stage matching and transfer, on names built from customers and orders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import keys as K
from ..operators import matching as M
from .base import query, read


def raw_names(spark: SparkSession, d: str) -> DataFrame:
    n, k = F.col("c_name"), F.col("c_custkey") % 5
    raw = F.when(k == 0, F.concat(F.lit("C:\\data\\"), F.upper(n), F.lit(".JPEG"))).when(k == 1, F.concat(F.lit("\t dir/"), n, F.lit(".png "))).when(k == 2, n).when(k == 3, F.concat(n, F.lit(".tar.gz"))).otherwise(F.concat(F.lit("."), n))
    return read(spark, d, "customer").select("c_custkey", "c_nationkey", "c_mktsegment", "c_name", raw.alias("raw"))


_RAW = r"""raw AS (SELECT c_custkey, c_nationkey, c_mktsegment, c_name, CASE c_custkey % 5 WHEN 0 THEN 'C:\data\' || upper(c_name) || '.JPEG'
  WHEN 1 THEN chr(9) || ' dir/' || c_name || '.png ' WHEN 2 THEN c_name WHEN 3 THEN c_name || '.tar.gz' ELSE '.' || c_name END AS raw FROM customer)"""


def _base(x: str) -> str:
    return rf"lower(string_split(replace(regexp_replace(coalesce({x}, ''), '^\s+|\s+$', '', 'g'), '\', '/'), '/')[-1])"


def _stem(x: str) -> str:
    return rf"regexp_replace({_base(x)}, '(.)\.[^.]+$', '\1')"


@query(f"WITH {_RAW} SELECT c_custkey, {_base('raw')} AS base, {_stem('raw')} AS stem FROM raw")
def key_basename_stem(spark: SparkSession, d: str) -> DataFrame:
    return raw_names(spark, d).select("c_custkey", K.basename(F.col("raw")).alias("base"), K.stem(F.col("raw")).alias("stem"))


@query("""SELECT o_orderkey, CASE o_orderkey % 8 WHEN 0 THEN 'Train' WHEN 1 THEN 'Train' WHEN 2 THEN 'Validation' WHEN 3 THEN 'Validation' WHEN 4 THEN 'Validation'
  WHEN 5 THEN 'Test' WHEN 6 THEN 'Test' ELSE 'other ' || o_orderstatus END AS split FROM orders""")
def split_normalize(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey") % 8
    raw = F.when(k == 0, "train").when(k == 1, " TRAINING").when(k == 2, "Val ").when(k == 3, "valid").when(k == 4, "VALIDATION").when(k == 5, "test").when(k == 6, "Testing\n").otherwise(F.concat(F.lit(" other "), "o_orderstatus"))
    return read(spark, d, "orders").select("o_orderkey", K.split_name(raw).alias("split"))


_PAIRS = "(0, '1', '1.0'), (1, ' 2', '2.7'), (2, 'A', ' a '), (3, 'x', 'y'), (4, NULL, NULL), (5, NULL, ''), (6, '3', 'three'), (7, '-1.5', '-1'), (8, '1.2', '1.9')"


def _text_sql(x: str) -> str:
    return f"regexp_replace(coalesce({x}, ''), '^\\s+|\\s+$', '', 'g')"


_NUMBER_SQL = "CASE WHEN regexp_full_match({x}, '[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?') THEN trunc(CAST({x} AS DOUBLE)) END"


@query(f"""WITH p(k, a, b) AS (VALUES {_PAIRS}), t AS (SELECT k, {_text_sql('a')} AS x, {_text_sql('b')} AS y FROM p)
SELECT c_custkey, coalesce({_NUMBER_SQL.format(x='x')} = {_NUMBER_SQL.format(x='y')}, x = y) AS same_label, lower(x) = lower(y) AS same_text FROM customer JOIN t ON k = c_custkey % 9""")
def tolerant_equal(spark: SparkSession, d: str) -> DataFrame:
    c = read(spark, d, "customer").select("c_custkey", (F.col("c_custkey") % 9).cast("int").alias("k"))
    pairs = spark.sql(f"SELECT * FROM VALUES {_PAIRS} AS t(k, a, b)")  # the nine rows above
    return c.join(F.broadcast(pairs), "k").select("c_custkey", K.tolerant_equal(F.col("a"), F.col("b"), "label").alias("same_label"), K.tolerant_equal(F.col("a"), F.col("b"), "ClassName").alias("same_text"))


@query("""SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN NULL WHEN 1 THEN 'Infinity' WHEN 2 THEN '-Infinity' ELSE 'finite' END AS value,
  CASE WHEN o_orderkey % 2 = 0 THEN o_orderstatus ELSE 'x_True_' || o_orderstatus END AS label FROM orders""")
def export_values(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey") % 4
    x = F.when(k == 0, F.lit(float("nan"))).when(k == 1, F.lit(float("inf"))).when(k == 2, F.lit(float("-inf"))).otherwise(F.col("o_totalprice"))
    name = F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("True_"), "o_orderstatus")).otherwise(F.concat(F.lit("x_True_"), "o_orderstatus"))
    safe = K.safe_text(x)
    return read(spark, d, "orders").select("o_orderkey", F.when(safe.rlike("^[0-9]"), "finite").otherwise(safe).alias("value"), K.without_true(name).alias("label"))


def group_file(spark: SparkSession, d: str) -> DataFrame:
    n, k = F.col("c_name"), F.col("c_custkey") % 7
    name = F.when(k == 0, F.concat(n, F.lit(".jpeg"))).when(k == 1, F.concat(n, F.lit(".png"))).when(k == 2, F.concat(F.lit("x/"), n, F.lit(".jpg"))).when(k == 3, F.concat(n, F.lit("_b.png"))).when(k == 4, n).when(k == 5, F.concat(n, F.lit(".tar.gz"))).otherwise(F.concat(F.lit("."), n))
    first = read(spark, d, "customer").select(name.alias("filename"), F.concat(F.lit("g"), F.col("c_nationkey").cast("string")).alias("group_id"), F.col("c_mktsegment").alias("label"))
    twin = read(spark, d, "customer").where("c_nationkey = 3").select(F.concat(n, F.lit(".second")).alias("filename"), F.lit("twin").alias("group_id"), F.col("c_mktsegment").alias("label"))
    return first.unionByName(twin)


_GROUPS = f"""gf AS (
  SELECT CASE c_custkey % 7 WHEN 0 THEN c_name || '.jpeg' WHEN 1 THEN c_name || '.png' WHEN 2 THEN 'x/' || c_name || '.jpg' WHEN 3 THEN c_name || '_b.png' WHEN 4 THEN c_name WHEN 5 THEN c_name || '.tar.gz' ELSE '.' || c_name END AS filename,
         'g' || c_nationkey AS group_id, c_mktsegment AS label FROM customer
  UNION ALL SELECT c_name || '.second', 'twin', c_mktsegment FROM customer WHERE c_nationkey = 3),
gk AS (SELECT {_base('filename')} AS base, {_stem('filename')} AS stem, group_id, label FROM gf),
lone AS (SELECT stem, any_value(group_id) AS group_id, any_value(label) AS label FROM gk GROUP BY stem HAVING count(*) = 1),
fk AS (SELECT c_custkey, {_base('raw')} AS base, {_stem('raw')} AS stem FROM raw),
att AS (SELECT c_custkey, coalesce(a.group_id, s.group_id) AS group_id, coalesce(a.label, s.label) AS label,
         CASE WHEN a.base IS NOT NULL THEN 'name' WHEN s.stem IS NOT NULL THEN 'stem' END AS matched_by
  FROM fk LEFT JOIN gk a ON a.base = fk.base LEFT JOIN lone s ON a.base IS NULL AND fk.stem <> '' AND s.stem = fk.stem)"""


@query(f"WITH {_RAW}, {_GROUPS} SELECT * FROM att")
def match_exact_then_stem(spark: SparkSession, d: str) -> DataFrame:
    return M.attach_groups(raw_names(spark, d).select("c_custkey", "raw"), group_file(spark, d), "raw").drop("raw")


@query(f"WITH {_RAW}, {_GROUPS} SELECT c_custkey FROM att WHERE matched_by IS NULL")
def match_unmatched(spark: SparkSession, d: str) -> DataFrame:
    return M.unmatched(M.attach_groups(raw_names(spark, d).select("c_custkey", "raw"), group_file(spark, d), "raw")).select("c_custkey")


def _target(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "orders").select("o_orderkey", F.concat(F.lit("dir/Customer-"), F.col("o_custkey").cast("string"), F.lit(".PNG")).alias("FileName"), F.col("o_orderstatus").alias("label"), F.lit("old").alias("Split"))


def _reference(spark: SparkSession, d: str) -> DataFrame:
    c = read(spark, d, "customer")
    r = c.select(F.concat(F.lit("customer-"), F.col("c_custkey").cast("string"), F.lit(".png")).alias("FileName"), F.when(F.col("c_nationkey") < 12, " f").otherwise("O").alias("label"), F.when(F.col("c_acctbal") > 0, "Train").otherwise("Test").alias("Split"), F.col("c_mktsegment").alias("group_id"))
    return r.unionByName(c.where("c_nationkey = 7").select(F.concat(F.lit("customer-"), F.col("c_custkey").cast("string"), F.lit(".png")).alias("FileName"), F.lit("O").alias("label"), F.lit("Train").alias("Split"), F.lit("twin").alias("group_id")))


_TR = """ref AS (SELECT c_custkey, CASE WHEN c_nationkey < 12 THEN ' f' ELSE 'O' END AS label, CASE WHEN c_acctbal > 0 THEN 'Train' ELSE 'Test' END AS split, c_mktsegment AS group_id FROM customer WHERE c_nationkey <> 7),
hit AS (SELECT o_orderkey, o_custkey, o_orderstatus, r.* FROM orders LEFT JOIN ref r ON c_custkey = o_custkey)"""


@query(f"WITH {_TR} SELECT o_orderkey, coalesce(split, 'old') AS \"Split\", group_id, c_custkey IS NOT NULL AS matched FROM hit")
def transfer_split(spark: SparkSession, d: str) -> DataFrame:
    return M.transfer(_target(spark, d), _reference(spark, d), "FileName", "FileName", ["Split", "group_id"]).select("o_orderkey", "Split", "group_id", "matched")


@query(f"WITH {_TR} SELECT o_orderkey, o_orderstatus AS target_value, label AS reference_value FROM hit WHERE c_custkey IS NOT NULL AND trim(o_orderstatus) <> trim(label)")
def transfer_mismatch(spark: SparkSession, d: str) -> DataFrame:
    return M.mismatches(_target(spark, d), _reference(spark, d), "FileName", "FileName", "label", "o_orderkey")


@query("SELECT o_orderkey, 'customer-' || o_custkey || '.png' AS match_value, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders QUALIFY n > 1")
def transfer_duplicates(spark: SparkSession, d: str) -> DataFrame:
    return M.repeated_rows(_target(spark, d), "FileName", "o_orderkey")


@query("SELECT doc_id, sha256(text) AS hash FROM documents")
def content_hash(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("hash"))


@query("SELECT sha256(text) AS hash, count(*) AS n FROM documents GROUP BY 1 HAVING count(*) > 1")
def ambiguous_hash(spark: SparkSession, d: str) -> DataFrame:
    return M.ambiguous_keys(content_hash(spark, d), "hash")


@query("SELECT c_custkey, 'left' AS side FROM customer WHERE c_nationkey = 5")
def variant_alignment(spark: SparkSession, d: str) -> DataFrame:
    c = read(spark, d, "customer").select("c_custkey", "c_nationkey")
    return M.aligned(c, c.where("c_nationkey != 5"), "c_custkey")


@query("SELECT 'Screening|' || l_returnflag || '|' || l_linestatus || '|' || l_linenumber AS run_id, count(*) AS n FROM lineitem GROUP BY 1")
def run_ids(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "lineitem").select(K.run_id(F.lit("Screening"), F.col("l_returnflag"), F.col("l_linestatus"), F.col("l_linenumber").cast("string")).alias("run_id")).groupBy("run_id").agg(F.count("*").alias("n"))
