"""The queries of this subpackage and their oracle SQL, by name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import html_text, licenses, media, mixing, pieces, projections, quality, secrets, simhash, suffix_lm
from .common import table

#: where the vocabularies of public tokenizers lie
TOKENIZERS = "/opt/tokenizers"
PIECES = f"{TOKENIZERS}/piece_bpe_32k.model"


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classified(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.round_trip(table(spark, sf_dir, "documents"), PIECES)


def op3_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op4_flac_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.round_trip(table(spark, sf_dir, "documents"))


def op5_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.grouped(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hexadecimal(found["fp"]).alias("fingerprint"), "component_id")


def op6_suffix_tree_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_lm.scored(table(spark, sf_dir, "documents"))


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents")).drop("detections")


def op8_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.main_text(table(spark, sf_dir, "pages"))


def op9_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return projections.near_duplicates(table(spark, sf_dir, "embeddings"))


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.report(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_quality_classifier": op1_quality_classifier,
    "op2_sentencepiece": op2_sentencepiece,
    "op3_source_mixing": op3_source_mixing,
    "op4_flac_media": op4_flac_media,
    "op5_simhash_near_dedup": op5_simhash_near_dedup,
    "op6_suffix_tree_lm": op6_suffix_tree_lm,
    "op7_license_scan": op7_license_scan,
    "op8_main_text": op8_main_text,
    "op9_embedding_near_dedup": op9_embedding_near_dedup,
    "op10_secret_scan": op10_secret_scan,
}

ORACLE_SQL = {
    "op3_source_mixing": mixing.oracle_sql(),
    "op7_license_scan": licenses.oracle_sql(),
    "op10_secret_scan": secrets.oracle_sql(),
}
