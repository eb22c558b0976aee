"""The corpus pipeline: documents in, encoded documents out. Every stage takes what the one before has kept.

Quality rules drop junk, SimHash leaves one document of each group of near copies, personal data is masked, sources are
mixed to their target weights by repeating and dropping documents, and what remains is encoded. Each stage's result is
written as Parquet in the shared folder and read again, so a lost executor costs at most one stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from refloom.llm import mixing, piece_codec, pii, quality_rules, simhash
from refloom.session import materialize

#: Vocabulary of the last stage.
PIECES = public_tokenizers.path("piece_bpe_32k.model")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules."""
    return quality_rules.keep(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one with the smallest id, of each group of near copies."""
    return simhash.one_of_each(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data masked by its kind."""
    return pii.mask(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them, up to three times each."""
    return mixing.mixed(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids, decoded): ids as little-endian unsigned 32-bit integers with begin and end."""
    return piece_codec.encoded(docs, PIECES)


STAGES = [
    ("quality_rules", quality),
    ("simhash", near_duplicates),
    ("pii", personal_data),
    ("mixing", mix),
    ("sentencepiece", encode),
]

#: Rounded Newton solutions and the vocabulary are beyond SQL; tests/llm/test_pipeline.py has a plain version instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
