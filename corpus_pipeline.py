"""From raw documents to packed sequences: quality, exact copies, near copies, secrets, packing.

STAGES lists (name, function); each function takes (spark, docs, sf_dir) and works on all rows of
docs, which the stage before it kept. Each result is written as Parquet and read again as the next
stage's docs. All but the last return the columns of documents."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from marginalia.llm import common, exact, jaccard, packing, quality, secrets


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject. Null and empty texts have the score of a text
    whose statistics are 0; rows that repeat are judged alike; without labels every score is 0.5 and all
    documents stay; an empty table stays empty; further columns pass as they are."""
    return quality.keep_good(docs, quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal texts, the one with the largest identifier. Null counts as the empty text, a
    null identifier stays only where its text has no other, of rows that repeat text and identifier one
    stays; an empty table stays empty; further columns pass as they are."""
    return exact.drop_duplicates(docs, keep="largest")


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies, the document with the smallest identifier. Texts without words are near
    nothing, rows with a null identifier stay; an empty table stays empty; further columns pass as they are."""
    return jaccard.keep_one(docs)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with each secret replaced by a mark and n_chars set anew. Null and empty texts stay as
    they are, repeated rows are treated each; an empty table stays empty; further columns pass as they are."""
    return secrets.redact(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of at most 1024 tokens. Null and empty texts have the end id only,
    repeated rows are packed each; an empty table gives an empty one; further columns are not read."""
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("quality", good_quality), ("exact_dedup", without_copies), ("near_dedup", without_near_copies), ("secrets", without_secrets), ("packing", packed)]

#: SQL has no classifier, tokenizer or similarity join: tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. What a stage writes on its way is removed when its result is written, and its
    input when the next stage has been."""
    scratch = common.Scratch(spark, "pipeline")
    docs, last = common.documents(spark, sf_dir), None
    for name, stage in STAGES:
        with common.freed():
            docs = scratch.keep(stage(spark, docs, sf_dir), name)
        if last:
            scratch.drop(last)
        last = name
    return docs
