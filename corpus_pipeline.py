"""From raw documents to packed sequences: quality, language, near-duplicates, mixing, packing.

Every stage takes what the one before kept, written as Parquet and read again. Stages
but the last return the columns of documents.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from kithgraph.llm import language_id, mixing, packing, quality_model, shared, similar
from kithgraph.llm.queries import tokenizer_path

#: A document goes if its quality score is below this one.
LEAST_QUALITY = 0.5
#: A document goes if its language is unknown or if none is likelier than this (four languages alike have a quarter each).
LEAST_LANGUAGE = 0.35


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop what the quality classifier rejects."""
    model = quality_model.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality_model.accepted(docs, model, LEAST_QUALITY)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop texts without a language that the network is sure enough of."""
    return language_id.accepted(docs, language_id.fit(docs), LEAST_LANGUAGE)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group that links: at least 0.8 of the five-word shingles alike, or fingerprints within two bits."""
    return similar.representatives(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix of sources takes it."""
    return mixing.repeated(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of tokenised documents with their sequence and place in it."""
    return packing.pack_documents(docs, tokenizer_path())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", quality),
    ("language ID", language),
    ("SimHash near-dedup", near_duplicates),
    ("mixing sources to target weights", mix),
    ("best-fit packing", pack),
]

#: Trained models and iterative solving are nothing that SQL expresses; tests compare with brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what a stage needs only for itself goes when it is written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    at = f"{shared.shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        with shared.passing(spark):
            stage(spark, docs, sf_dir).write.parquet(f"{at}/{k}")
        docs = spark.read.parquet(f"{at}/{k}")
    return docs
