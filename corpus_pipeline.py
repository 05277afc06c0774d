"""Five stages from raw documents to token ids; each works on all that its predecessor kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kgspark.llm import bpe, decontaminate, jaccard_join, pii, quality_rules
from kgspark.llm.common import scratch, table, written

#: The key of the surrogates; a deployment passes a secret of its own.
PII_KEY = "registered pipeline"


def _counted(docs: DataFrame) -> DataFrame:
    """n_chars, where documents have it, follows the text."""
    return docs.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else docs


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Failing lines go, and documents that lose too much."""
    return _counted(quality_rules.passing(docs))


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the least id stays."""
    return jaccard_join.one_of_each(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold half of a benchmark item or more go."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def anonymised(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data and secrets become surrogates."""
    return _counted(pii.replace(docs, PII_KEY).drop("__pii_entities"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, token_ids (binary, little-endian unsigned 32-bit integers), and hashes of the ids and of the text decoded from them."""
    done = bpe.encode_decode(docs, public_tokenizers.path("byte_bpe_50k.json"))
    return done.select("doc_id", (F.octet_length("token_ids") / 4).cast("long").alias("n_tokens"), "token_ids", F.sha2("token_ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


STAGES = [("quality rules", quality), ("n-gram jaccard join", deduplicate), ("benchmark decontamination", decontaminated), ("pii", anonymised), ("bpe", encoded)]
#: SQL cannot express the joins and merges; the tests hold the rows against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. Each stage is written and read again; a stage's own tables go when it is written, its result when the last one is."""
    docs = table(spark, sf_dir, "documents")
    with scratch(spark):
        for k, (name, stage) in enumerate(STAGES):
            with scratch(spark):
                docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"), up=2 if k == len(STAGES) - 1 else 1)
    return docs
