"""Queries and their DuckDB twins by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function's name, with its SQL if SQL can express it."""

    def keep(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def document_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, word): every lower-case letter run of the documents, in any script."""
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[\\p{L}\\p{M}']+"), F.lit(0))).alias("word"))


#: The same in SQL.
WORDS = "select doc_id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{M}'']+')) as word from documents"
