"""The registered queries of this folder, and their SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kgspark.llm import bpe, decontaminate, html_text, jaccard_join, passages, pii, quality_knn, quality_rules, toxicity, warc
from kgspark.llm.common import scratch, table, written


#: The key of the registered query; a deployment passes a secret of its own.
PII_KEY = "registered query"


def kept(spark: SparkSession, make: Callable[[], DataFrame], name: str) -> DataFrame:
    """What make returns as a table; the tables that it wrote on the way go."""
    with scratch(spark):
        return written(make(), name, up=1)


def op7_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = pii.replace(table(spark, sf_dir, "documents").select("doc_id", "text"), PII_KEY)
    return done.select("doc_id", "text", F.col("__pii_entities").cast("long").alias("n_entities"))


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = bpe.encode_decode(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return done.select("doc_id", (F.octet_length("token_ids") / 4).cast("long").alias("n_tokens"), F.sha2("token_ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op1_string_tiling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_knn_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_knn.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_warc_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return warc.read(pages, warc.write(pages)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op4_subword_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_line_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))


def op6_line_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = quality_rules.clean(table(spark, sf_dir, "documents"))
    return done.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op9_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kept(spark, lambda: jaccard_join.link(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id"), "op9")


def op10_compact_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kept(spark, lambda: passages.repeated(table(spark, sf_dir, "documents")), "op10")


QUERIES = {"op1_string_tiling": op1_string_tiling, "op3_warc_index": op3_warc_index, "op2_knn_quality": op2_knn_quality, "op4_subword_toxicity": op4_subword_toxicity, "op5_line_blocks": op5_line_blocks, "op6_line_rules": op6_line_rules, "op7_surrogates": op7_surrogates, "op8_bpe": op8_bpe, "op9_jaccard": op9_jaccard, "op10_compact_windows": op10_compact_windows}
ORACLE_SQL = {"op6_line_rules": quality_rules.SQL}
