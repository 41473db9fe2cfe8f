"""A training corpus from raw documents, in five stages that each call one operator.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes it as Parquet to the
shared folder and hands what it reads back to the next.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievewright.llm import common, decontaminate, line_dedup, ngram_join, packing, quality


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject."""
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def line_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines that are boilerplate for their source; n_chars follows the text."""
    cut = line_dedup.drop_boilerplate(docs, "source", "text")
    return cut.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else cut


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest id, in one row."""
    groups = ngram_join.jaccard_groups(docs)
    others = groups.where(~F.col("component_id").eqNullSafe(F.col("doc_id"))).select("doc_id")
    return common.one_row_each(common.without(docs, others))


def benchmark_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark passage."""
    return decontaminate.drop_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of training sequences, with their ids."""
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), 1)


STAGES = [("quality_filter", quality_filter), ("line_filter", line_filter), ("near_duplicates", near_duplicates), ("benchmark_filter", benchmark_filter), ("packed", packed)]

#: A fitted classifier and a tokenizer's ids are beyond SQL; stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, from the table of documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs, _ = common.written(stage(spark, docs, sf_dir), name)
    return docs
