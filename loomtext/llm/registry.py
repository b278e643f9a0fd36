"""Queries of this subpackage, one for each operator, over whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from loomtext.llm.fingerprints import fingerprints
from loomtext.llm.notices import licence_notices
from loomtext.llm.packing import pack_documents
from loomtext.llm.preferences import SQL as PREFERENCES_SQL, answers_swapped, format_preferences
from loomtext.llm.privacy import span_report
from loomtext.llm.quality import judged
from loomtext.llm.resampling import resample
from loomtext.llm.sharding import assign_shards
from loomtext.llm.simhash import near_copies
from loomtext.llm.token_count import count_tokens
from loomtext.llm.toxicity import toxicity
from loomtext.llm.whitening import whiten
from loomtext.llm.word_bpe import encode_decode


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document by the 32k piece vocabulary."""
    return count_tokens(_read(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op2_weak_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and the verdict of weak supervision for every document."""
    told = judged(_read(spark, sf_dir, "documents"))
    counts = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return told.select(*counts, "base_failed", "kept", "quality")


def op4_lookup_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document, of its edited text, and their likeness."""
    return fingerprints(_read(spark, sf_dir, "documents"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's toxicity, learned from two thirds of the labels."""
    return toxicity(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op3_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded by the 49k word vocabulary."""
    return encode_decode(_read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op6_disclosing_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data and the terms that reveal it in every document."""
    return span_report(_read(spark, sf_dir, "documents"))


def op7_preference_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation with its last answer and with another one's, as prompt and masked completions."""
    return format_preferences(*answers_swapped(_read(spark, sf_dir, "conversations"))).withColumnRenamed("pair_id", "conv_id")


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 4096 tokens."""
    return pack_documents(_read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op9_flow_resharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 16 shards of near equal bytes."""
    placed = assign_shards(_read(spark, sf_dir, "documents"), 16)
    return placed.select("doc_id", "size", "text_crc32", "law", "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op10_simhash_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's SimHash fingerprint and component of near copies."""
    return near_copies(_read(spark, sf_dir, "documents"), width=4, seed=42, distance=4)


def op11_licence_notices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence notices of every document, exact and with a few edits."""
    return licence_notices(_read(spark, sf_dir, "documents")).drop("spans")


def op12_jacobi_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every embedding on the first 16 principal components, whitened."""
    return whiten(_read(spark, sf_dir, "embeddings"), 16)


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's weight towards the benchmark's texts, and the five per cent drawn."""
    told = resample(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))
    return told.select("doc_id", "n_features", "weight", "score", "rank")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (
        op1_token_counts,
        op2_weak_quality,
        op3_bpe_codec,
        op4_lookup_fingerprints,
        op5_toxicity,
        op6_disclosing_terms,
        op7_preference_pairs,
        op8_best_fit_packing,
        op9_flow_resharding,
        op10_simhash_components,
        op11_licence_notices,
        op12_jacobi_whitening,
        op13_importance_resampling,
    )
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL of the queries that SQL can express."""
    return {"op7_preference_pairs": PREFERENCES_SQL}
