"""The corpus pipeline: quality, near-duplicates, secrets, mixing, tokens, each over all that its predecessor kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
stage's documents. All but the last return the columns of documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from auditloom.llm import mixing, ngram_join, piece_codec, quality_classifier, secret_scan
from auditloom.llm.common import shared_folder, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop what the quality classifier rejects; it learns from the labels and their whole documents."""
    model = quality_classifier.train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return quality_classifier.accepted(docs, model)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near-copies, that with the smallest id."""
    return ngram_join.one_of_each(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mask every secret and every linked part of a credential in the text."""
    return secret_scan.redact(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replicate documents to the sources' target weights, in a global random order."""
    return mixing.mix(docs).select(*docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encode each text; returns doc_id, source, n_tokens and token_ids."""
    return piece_codec.encode(docs, piece_codec.load()).select("doc_id", "source", "n_tokens", "token_ids")


STAGES = [("quality classifier", quality), ("n-gram Jaccard join", near_duplicates), ("secret scans", secrets),
          ("mixing sources to target weights", mixture), ("SentencePiece encoding and decoding", tokens)]

#: SQL can't express a learned classifier.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; the tables between them lie in the shared folder."""
    folder = f"{shared_folder(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES):
        path = f"{folder}/{number}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
