"""The corpus pipeline: documents in, token ids of a clean and balanced mix out.

STAGES are applied in order.  Each takes (spark, docs, sf_dir), works on all that
its predecessor kept and returns a DataFrame, written as Parquet and read again
as the next one's docs; all but the last return the columns of documents.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from spanloom.llm.jaccard_join import keep_one
from spanloom.llm.language_id import keep_identified
from spanloom.llm.mixing import mix
from spanloom.llm.quality_rules import keep_good
from spanloom.llm.streaming_encoder import encode_documents
from spanloom.session import shared_dir, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the trees reject go.  The trees learn from the labelled input."""
    return keep_good(docs, table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language that is likelier than all others together go."""
    return keep_identified(docs, table(spark, sf_dir, "documents"), least=0.5)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies stays: the one with the smallest id."""
    return keep_one(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it: 150 % of all words, sources weighed 3, 1, 2."""
    return mix(docs, share=1.5, cap=2.0, keep_columns=True)


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of every document: doc_id, n_bytes, n_tokens, ids, round_trip."""
    return encode_documents(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES = [
    ("quality_rules", quality_rules),
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("mixing", mixing),
    ("sentencepiece", sentencepiece),
]

#: learned models and tokenizers have no SQL; tests hold the stages against brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what lies between is written to the shared folder."""
    folder = f"{shared_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs.write.parquet(f"{folder}/{k}-{name}")
            docs = spark.read.parquet(f"{folder}/{k}-{name}")
    return docs
