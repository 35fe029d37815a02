"""The corpus pipeline: documents in, the mix of what is worth keeping out, as tokens.

Each stage takes what its predecessor kept, whole; all but the last return the
columns of documents. run() passes DataFrames from stage to stage; a caller that
writes every stage's result and reads it again gets the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewrack.llm import mixing, pieces, quality, queries, secrets, simhash
from tidewrack.llm.common import staged, table


def accept_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, learned from the labels of docs, rejects go."""
    return quality.accepted(docs, table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every group of near-duplicates (words in fives, similarity 0.8) the document with the smallest doc_id stays."""
    return simhash.deduplicated(docs)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every secret in a text gives way to a mark; no document goes. n_chars follows the text."""
    return secrets.redacted(docs).withColumn("n_chars", F.length("text").cast("long"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents come as often as their source's weight asks for: not at all, once, or up to four times."""
    return mixing.mixed_documents(docs)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The tokens of every row: doc_id, n_tokens, ids_sha256, decoded_sha256, as the round trip of encoding and decoding gives them."""
    return pieces.round_trip(docs, queries.PIECES)


STAGES = [
    ("quality classifier", accept_quality),
    ("simhash near-dedup", drop_near_duplicates),
    ("secret scans", redact_secrets),
    ("source mixing", mix_sources),
    ("sentencepiece", encode_pieces),
]

#: SQL can't express the classifier, the fingerprints or the encoding; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each staged as Parquet before the next, as several read their input more than once."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
