"""The training-data pipeline: five stages over documents, each one of the package's operators.

Quality classifier, near-duplicates, substring deduplication, benchmark decontamination, tokens. A stage takes all that
the one before kept; all but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from contestry.llm.bpe import decode, default_path, encode
from contestry.llm.common import small_batches, table, written
from contestry.llm.decontaminate import drop_leaks
from contestry.llm.near_copies import near_copies
from contestry.llm.quality_classifier import keep_good
from contestry.llm.simhash import keep_one
from contestry.llm.substring import cleaned


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the quality classifier rejects; a null or empty text is judged as one of no words. Rows of one id are each judged."""
    return keep_good(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each group of texts whose 5-word shingles are similar by 0.8 or more.

    Null and empty texts are copies of each other; rows with a null id stay.
    """
    small_batches(spark)
    return keep_one(docs, near_copies(docs))


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes out the words of repeated passages; n_chars follows the text. Every document stays."""
    small_batches(spark)
    return cleaned(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that hold a benchmark passage; null texts and null ids stay, as does everything without a benchmark."""
    return drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids and the SHA-256 of the text that the ids decode to, a row for each document; a null text has no ids."""
    small_batches(spark)
    path = default_path()
    ids = decode(encode(docs, path), path)
    return ids.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"))


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("substrings", substrings), ("decontamination", decontamination), ("tokens", tokens)]

#: SQL can't express the classifier, the fingerprints or the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
