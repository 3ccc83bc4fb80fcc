"""The corpus pipeline: documents through the training-data operators, one stage after another.

Each stage is ``(spark, docs, sf_dir) -> DataFrame``; its result is written as Parquet to the
shared checkpoint folder and read back as the next stage's documents. All but the last return
the columns of ``documents``.

Nulls, repeated rows and empty tables: a null text counts as empty and is never toxic by itself; of equal texts (all
empty ones too) the row with the largest doc_id stays, one row if it is repeated; texts without words are near
duplicates of nothing; a null source is a source of its own; a document without a doc_id stays unless its text
makes it go; an empty table goes through all stages and gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from raterlab.llm import bpe, exact_dedup, mixing, ngram_join, toxicity
from raterlab.llm.common import free_driver, scratch_path

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not predicted toxic; the model is fitted on the labelled ones among them."""
    free_driver(spark)
    return toxicity.drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_exact_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id stays."""
    free_driver(spark)
    return exact_dedup.drop_duplicates(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of linked documents the one with the smallest doc_id stays."""
    free_driver(spark)
    return ngram_join.one_per_group(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it."""
    free_driver(spark)
    return mixing.mixed_documents(docs)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' columns but the text, with n_tokens, ids (packed) and the text decoded from them."""
    free_driver(spark)
    vocabulary = bpe.read_vocabulary(public_tokenizers.path("word_bpe_49k.json"))
    return bpe.encode_decode(docs, vocabulary, [c for c in docs.columns if c != "text"])


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_exact_duplicates),
    ("ngram_join", drop_near_duplicates),
    ("mixing", mix_sources),
    ("bpe", tokenize),
]

#: The toxicity model and the tokeniser are beyond SQL.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole documents table."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = scratch_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
