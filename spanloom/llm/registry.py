"""Queries of the corpus operators and the SQL of those that SQL can express."""

from __future__ import annotations

import corpus_pipeline
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from spanloom.llm.jaccard_join import near_duplicates
from spanloom.llm.language_id import identify
from spanloom.llm.mixing import mix
from spanloom.llm.prefix_forest import neighbours
from spanloom.llm.quality_classifier import classify
from spanloom.llm.quality_rules import judge
from spanloom.llm.sharding import shard_rows
from spanloom.llm.streaming_encoder import encode_digests
from spanloom.llm.token_counts import count_tokens
from spanloom.llm.token_files import output_folder, read_token_files, write_token_files
from spanloom.session import table


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_prefix_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours(table(spark, sf_dir, "embeddings"), every=50, k=5)


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_rows(table(spark, sf_dir, "documents"), n_shards=24)


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), limit=4096)


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_digests(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"), share=1.5, cap=2.0)


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = output_folder(spark)
    manifest = write_token_files(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), folder, end_id=2)
    return read_token_files(spark, manifest, folder)


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def queries() -> dict:
    """One query opN_<name> for each operator."""
    return {
        "op1_quality_classifier": op1_quality_classifier,
        "op2_prefix_forest": op2_prefix_forest,
        "op3_sharding": op3_sharding,
        "op4_token_counts": op4_token_counts,
        "op5_sentencepiece": op5_sentencepiece,
        "op6_jaccard_join": op6_jaccard_join,
        "op7_mixing": op7_mixing,
        "op8_token_files": op8_token_files,
        "op9_language_id": op9_language_id,
        "op10_quality_rules": op10_quality_rules,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL; operators that are not here are tested against brute force."""
    return {} if corpus_pipeline.ORACLE_SQL is None else {"pipeline": corpus_pipeline.ORACLE_SQL}
