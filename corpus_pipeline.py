"""From raw documents to token ids: quality rules, near-duplicates, decontamination, personal data,
byte-pair encoding. Each stage reads what its predecessor wrote.

Defined cases, for every stage: a null or empty text counts as the empty text, which the quality rules
reject (later stages, given one, keep it; equal ones are near-duplicates); rows with a null doc_id are
judged by their text, and stay in near-duplicate removal, where they can't be told apart; of rows that
repeat a doc_id each is judged by its own text, and near-duplicate removal keeps one; texts of any
length are whole; an empty table gives an empty table; columns beyond those of documents, whatever their names,
stay as they are up to the encoding, which returns its own columns."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from wordloom.llm import bpe, decontaminate, pii, quality, simhash
from wordloom.session import stored, table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go."""
    return quality.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the smallest doc_id stays."""
    return simhash.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark passage go."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data and secrets in texts give way to tags."""
    return pii.redact(docs)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of each document, and its ids."""
    rows = bpe.round_trip(docs, public_tokenizers.path("word_bpe_49k.json"))
    return rows.select("doc_id", "n_tokens", "ids", bpe.sha256_hex(rows["ids"]).alias("ids_sha256"), bpe.sha256_hex(rows["decoded"]).alias("decoded_sha256"))


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("personal_data", personal_data),
    ("encoding", encoding),
]

#: SQL can express neither SimHash fingerprints nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over the table documents, each written as Parquet and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
