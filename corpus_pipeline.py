"""A corpus from raw documents to packed sequences: five stages, each written as Parquet and read back by the next.

All stages: null and empty texts are texts without words; an empty table stays empty; columns beyond doc_id and text, whatever
their names, come through as they are; rows without doc_id are judged like others; texts are judged whole, however long.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from loomtext.llm.minhash import drop_similar
from loomtext.llm.packing import pack_documents
from loomtext.llm.privacy import sanitise
from loomtext.llm.quality import keep_good
from loomtext.llm.scratch import materialise
from loomtext.llm.toxicity import drop_toxic


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2: documents that the quality rules reject go; equal texts share a verdict, and texts of under 50 words go."""
    return keep_good(docs)


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: documents predicted to be toxic go; without labels of both kinds none does unless all labels are toxic."""
    return drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: one document of each group of near copies, alike in 0.8 of their five-word shingles or more, stays.

    It is the one of the least doc_id (null last), of equal rows any one. Texts without a word are copies of each other.
    """
    return drop_similar(docs)


def privacy(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6: personal data and terms that disclose it are replaced in the texts; all rows stay, nulls stay null."""
    return sanitise(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: the texts' tokens, packed into sequences; a null or empty text is its end mark, repeated rows are packed as often."""
    return pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality),
    ("toxicity", toxicity),
    ("near_copies", near_copies),
    ("privacy", privacy),
    ("packing", packing),
]

#: Tokenizers, a fitted classifier and estimation are beyond SQL; tests/llm/test_whole_pipeline.py holds run() against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of `sf_dir`."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
