"""Corpus pipeline: quality filter, near-duplicate removal, repeated substrings, decontamination, token ids.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents, and other
columns are dropped. Stages work on everything their predecessor kept. Rows without a doc_id pass the stages that link
documents unchanged. Null and empty texts are scored like any other, are copies of each other, have no repeats left and so go
in the third stage, hold no benchmark passage and have no ids. Of rows that repeat an id, near-duplicate removal keeps all
or none. An empty table gives an empty result in every stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigilake.llm import common as C
from vigilake.llm import decontaminate, quality_nbsvm, sentencepiece_ffbs, simhash, suffix_dedup

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents that the classifier accepts."""
    model = quality_nbsvm.train(docs, C.table(spark, sf_dir, "labels"))
    return quality_nbsvm.keep(docs, model).select(*COLUMNS)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document with the smallest id of each group of near copies."""
    found = simhash.near_copies(docs).where("doc_id <> component").select("doc_id").distinct()
    return docs.join(found, "doc_id", "left_anti").select(*COLUMNS)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Take out substrings that start earlier in the corpus; a document of which nothing is left goes."""
    left = suffix_dedup.kept(docs, carry=["lang", "source"])
    left = left.where("text <> ''").select("doc_id", "text", "lang", "source", F.length("text").cast("long").alias("n_chars"))
    return left.unionByName(docs.where("doc_id is null").select(*COLUMNS)).select(*COLUMNS)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents without a passage of the benchmark."""
    return decontaminate.clean(docs, C.table(spark, sf_dir, "benchmark")).select(*COLUMNS)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id and its sampled piece ids."""
    return sentencepiece_ffbs.sample(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES = [
    ("quality classifier", quality),
    ("SimHash near-dedup", near_copies),
    ("suffix-array dedup", repeats),
    ("benchmark decontamination", decontaminated),
    ("SentencePiece encoding", token_ids),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each stage but the last is written and read again; what it wrote besides, and the stage before it, are deleted then."""
    docs, since = C.table(spark, sf_dir, "documents"), C.mark()
    for _, stage in STAGES[:-1]:
        docs = C.cut(stage(spark, docs, sf_dir), "stage")
        C.sweep(spark, since, docs)
    return STAGES[-1][1](spark, docs, sf_dir)
