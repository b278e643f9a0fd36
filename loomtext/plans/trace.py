"""The record of how each sentence of a document was handled, and its roll-up."""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import Column, DataFrame, functions as F

from loomtext.functions import morphology as M, script as S, text as X
from loomtext.functions.segment import sentences
from loomtext.operators.corpus import PREFIXES


class Translator(Protocol):
    """A model: a column of prefixed inputs to struct<status, text, error>."""

    def __call__(self, model_input: Column) -> Column: ...


def no_model(model_input: Column) -> Column:
    """No model is loaded: the text is null, never invented."""
    return F.struct(F.lit("not_loaded").alias("status"), F.lit(None).cast("string").alias("text"), F.lit(None).cast("string").alias("error"))


def trace_sentences(docs: DataFrame, key: str, direction: str = "en-dv", translator: Translator = no_model) -> DataFrame:
    """(key, place, input, latin, thaana, preserved, model_input, status, output, register): a row per sentence.

    On the way to English the source is read out in Latin letters for the model; on the way from English the model's
    output is, and written in Thaana. The model never sees Thaana.
    """
    rows = docs.select(key, F.posexplode(sentences(X.normalise(F.col("text")))).alias("place", "input"))
    source = S.to_latin(F.col("input")) if direction == "dv-en" else F.col("input")
    rows = rows.withColumn("latin", source).withColumn("model_input", F.concat(F.lit(PREFIXES[direction]), "latin"))
    rows = rows.withColumn("result", translator(F.col("model_input")))
    text = F.when(F.col("result.status") == "ready", F.col("result.text"))
    output = text if direction == "dv-en" else S.to_thaana(text)
    thaana = F.col("input") if direction == "dv-en" else output
    return rows.select(
        key, "place", "input", "latin", thaana.alias("thaana"), F.array_join(S.unread(F.col("input")), "").alias("preserved"), "model_input",
        F.col("result.status").alias("status"), output.alias("output"), M.register_of(X.tokens(F.col("latin"))).alias("register"),
    )


def trace_documents(docs: DataFrame, key: str, direction: str = "en-dv", translator: Translator = no_model) -> DataFrame:
    """(key, sentences, available, output): all outputs joined if there is one for every sentence; documents without sentences too."""
    traced = trace_sentences(docs, key, direction, translator).groupBy(key).agg(
        F.count(F.lit(1)).alias("sentences"),
        F.every(F.coalesce(F.col("output") != "", F.lit(False))).alias("available"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "output"))), lambda x: x["output"]), " ").alias("output"),
    )
    met = docs.select(key).join(traced, key, "left")
    ready = F.coalesce("available", F.lit(False))
    return met.select(key, F.coalesce("sentences", F.lit(0)).alias("sentences"), ready.alias("available"), F.when(ready, F.col("output")).alias("output"))
