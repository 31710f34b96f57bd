"""A corpus pipeline of five operators.

STAGES names the stages in order; each function takes (spark, docs, sf_dir), works on all
documents the stage before it kept, and returns the columns of documents (the last one adds
the token ids).  run() applies them to the documents table, each stage written and reread.
"""

from __future__ import annotations

from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridweave.llm import bpe, decontam, langid, secrets, simhash
from gridweave.llm.common import scratch, small_batches, table
from gridweave.llm.queries import tokenizer

#: Texts of which a learned language explains less are rejected, as are those without a letter.
MIN_LANGUAGE = 0.2


def _in_small_batches(stage):
    """The stage, with texts going to Python in small batches: five stages share the workers' memory."""

    @wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        small_batches(spark)
        return stage(spark, docs, sf_dir)

    return run_stage


@_in_small_batches
def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in none of the languages learned from the rows that name theirs go; null texts and texts without a letter, too."""
    guess = langid.predict(langid.train(docs), "text", spark)
    return docs.where((guess["lang"] != langid.UNKNOWN) & (guess["score"] >= MIN_LANGUAGE))


@_in_small_batches
def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (5-word Jaccard similarity of 0.8 or more) the document with the smallest id stays."""
    return simhash.deduplicate_similar(docs)


@_in_small_batches
def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a passage of the benchmark go."""
    return decontam.decontaminate(docs, table(spark, sf_dir, "benchmark"))


@_in_small_batches
def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked in the text, and n_chars follows where the table has it."""
    masked = docs.withColumn("text", secrets.redacted("text"))
    return masked.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else masked


@_in_small_batches
def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Adds token_ids (packed little-endian unsigned 32-bit integers), n_tokens, and round_trip: whether
    decoding gives the text back.  Columns of these names are replaced."""
    return bpe.tokenize(docs, tokenizer(spark), same="round_trip")


STAGES = [("language ID", identify_language), ("near dedup", deduplicate), ("decontamination", decontaminate), ("secrets", mask_secrets), ("BPE", encode)]

#: None of fingerprints, models and merges can be had in SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        path = scratch(spark, f"stage-{i}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
