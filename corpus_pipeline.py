"""A corpus pipeline of five stages, each written as Parquet and read again by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tilewright.llm.compact_windows import cut_passages
from tilewright.llm.hyperlang import fit_profiles, held_out, keep_identified
from tilewright.llm.lp_packing import pack
from tilewright.llm.minhash_forest import near_duplicates
from tilewright.llm.scratch import Scratch, keep_ids
from tilewright.llm.simhash_windows import without_leaks


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a language can be told; those without text or letters go."""
    model = fit_profiles(docs.where(~held_out()).select("lang", "text"))
    return keep_identified(docs, model)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each group of near copies (five-word shingles, similarity 0.8). Rows without doc_id can't be told from others and stay."""
    gone = near_duplicates(docs, shingle_words=5, percent=80).where("not kept").select("doc_id").distinct()
    return keep_ids(docs, gone, "doc_id", "left_anti")


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 words or more that an earlier document has are cut out; the earliest keeps them."""
    return cut_passages(docs, min_words=50, percent=80)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    return without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of at most 2048 ids."""
    return pack(docs, capacity=2048, end_id=0)


STAGES = [("language_id", language_id), ("near_dedup", near_dedup), ("substring_dedup", substring_dedup), ("decontaminate", decontaminate), ("packing", packing)]

#: Language vectors, MinHash orders, tokenization and packing have no SQL form; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = scratch.table(name, stage(spark, docs, sf_dir))
    return docs
