"""The registered queries of the corpus operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import read_table
from quarry.llm.fingerprints import fingerprints
from quarry.llm.language_id import language_id
from quarry.llm.line_dedup import line_dedup
from quarry.llm.nbest import encode_documents
from quarry.llm.near_dedup import near_classes
from quarry.llm.packing import pack_documents
from quarry.llm.quality import quality_rules
from quarry.llm.sharding import shard_documents
from quarry.llm.substring_dedup import substring_dedup
from quarry.llm.token_files import read_documents, write_tokens


def docs_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "documents")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(docs_of(spark, sf_dir), "doc_id")


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(docs_of(spark, sf_dir))


def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(docs_of(spark, sf_dir))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id(docs_of(spark, sf_dir))


def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_classes(docs_of(spark, sf_dir))
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op6_nbest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(docs_of(spark, sf_dir))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(docs_of(spark, sf_dir))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(docs_of(spark, sf_dir))


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_documents(write_tokens(docs_of(spark, sf_dir)))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup(docs_of(spark, sf_dir))
    return out.select("doc_id", "source", F.col("_n_lines").alias("n_lines"), F.col("_n_dropped").alias("n_dropped"), F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_quality_rules, op2_packing, op3_fingerprints, op4_language_id, op5_near_dedup, op6_nbest, op7_substring_dedup, op8_sharding, op9_token_files, op10_line_dedup)}


def oracle_sql() -> dict[str, str]:
    from quarry.llm.oracles import SQL

    return dict(SQL)
