"""The registered queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import public_tokenizers

from . import common, decontaminate, embed_dedup, line_dedup, ngram_join, packing, preferences, quality, suffix_dedup, token_counts, token_files


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = common.scratch(spark, "token-files")
    token_files.write(table(spark, sf_dir, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"), 2)
    return token_files.documents(spark, path)


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", line_dedup.host_of(F.col("url")).alias("host"), line_dedup.html_text(F.col("html")).alias("text"))
    pages, _ = common.written(pages, "page-text")
    return line_dedup.drop_boilerplate(pages, "host", "text", count_cols=("n_lines", "n_dropped"))


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.cut_repeats(table(spark, sf_dir, "documents")).drop("spans", "kept")


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), 1)
    return pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids")


def op7_preferences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs made of two conversations each, that say the same up to a last reply."""
    return preferences.format_pairs(preferences.forked_pairs(table(spark, sf_dir, "conversations")))


def op8_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_groups(table(spark, sf_dir, "documents"))


def op9_embed_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.score(docs, quality.train(docs, table(spark, sf_dir, "labels")))


QUERIES = {f.__name__: f for f in (op1_token_files, op2_line_dedup, op3_decontaminate, op4_suffix_dedup, op5_token_counts, op6_packing, op7_preferences, op8_ngram_join, op9_embed_dedup, op10_quality)}
ORACLE_SQL: dict[str, str] = {
    "op2_line_dedup": f"""WITH p AS (SELECT page_id, nullif(lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1)), '') AS host, {line_dedup.oracle_html("html")} AS t FROM pages),
      {line_dedup.oracle_lines("p", "host", "t")}
      SELECT page_id, host, new_text AS text, n_lines, n_dropped FROM src JOIN cleaned USING (r)""",
    "op3_decontaminate": f"WITH {decontaminate.oracle()} SELECT * FROM leaks",
    "op7_preferences": preferences.oracle(),
    "op8_ngram_join": f"WITH RECURSIVE {ngram_join.oracle()} SELECT * FROM grouped",
}
