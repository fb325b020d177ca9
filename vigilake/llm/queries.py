"""opN_<name>: one query for each training-data operator, over whole tables with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigilake.llm import common as C
from vigilake.llm import compact_windows, decontaminate, flac, language_crf, license_scan, quality_nbsvm, sentencepiece_ffbs, simhash, suffix_dedup, token_records


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_ffbs.digests(C.table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.scan(C.table(spark, sf_dir, "documents"), C.table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "contaminated", "n_items", "items", "spans")


def op3_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = C.fresh(spark, "tokens")
    shards = token_records.write(C.table(spark, sf_dir, "documents"), folder, public_tokenizers.path("word_bpe_49k.json"))
    return token_records.read(spark, folder, shards)


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.groups(C.table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))


def op5_compact_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compact_windows.classes(C.table(spark, sf_dir, "documents"))


def op6_flac(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored form is written to the shared folder, and what it describes is read back from there."""
    return flac.digests(C.cut(flac.media(C.table(spark, sf_dir, "documents")), "media"))


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.digests(C.table(spark, sf_dir, "documents"))


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(C.table(spark, sf_dir, "documents"))


def op9_language_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = C.table(spark, sf_dir, "documents")
    found = language_crf.label(docs, language_crf.train(docs))
    return found.select("doc_id", (C.crc_mod("doc_id", 3) == 1).alias("held_out"), "lang_pred", "score")


def op10_quality_nbsvm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = C.table(spark, sf_dir, "documents")
    model = quality_nbsvm.train(docs, C.table(spark, sf_dir, "labels"))
    return quality_nbsvm.score(docs, model).select(
        "doc_id", (C.crc_mod("doc_id", 4) == 2).alias("held_out"), "score", (F.col("score") >= quality_nbsvm.THRESHOLD).cast("int").alias("predicted")
    )


QUERIES = {
    "op1_sentencepiece": op1_sentencepiece,
    "op2_decontaminate": op2_decontaminate,
    "op3_token_records": op3_token_records,
    "op4_simhash": op4_simhash,
    "op5_compact_windows": op5_compact_windows,
    "op6_flac": op6_flac,
    "op7_suffix_dedup": op7_suffix_dedup,
    "op8_license_scan": op8_license_scan,
    "op9_language_crf": op9_language_crf,
    "op10_quality_nbsvm": op10_quality_nbsvm,
}
ORACLES = {"op8_license_scan": license_scan.oracle()}
