"""Facts out of loosely structured text: event dictionaries, named numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

_ANSI = "\\x1b\\[[0-9;]*[A-Za-z]"
_FLAT = "\\{[^{}]*\\}"


def plain_lines(text: Column) -> Column:
    """Lines without colour codes; a carriage return begins a new one."""
    return F.split(F.translate(F.regexp_replace(text, _ANSI, ""), "\r", "\n"), "\n")


def numbers_of(raw: Column) -> Column:
    """map<string, double> of a flat dictionary in JSON or Python notation; null if it is neither."""
    return F.from_json(F.replace(raw, F.lit("'"), F.lit('"')), "map<string,double>")


def events(logs: DataFrame, text: str) -> DataFrame:
    """(..., line, raw, event, kind): each flat dictionary in the logs, by the keys that it has; kind is failed if unreadable."""
    rows = logs.select(*[c for c in logs.columns if c != text], F.posexplode(plain_lines(F.col(text))).alias("line", "said"))
    rows = rows.withColumn("raw", F.explode(F.regexp_extract_all("said", F.lit(_FLAT), F.lit(0)))).withColumn("event", numbers_of(F.col("raw")))

    def has(key: str) -> Column:
        return F.map_contains_key("event", key)

    kind = F.when(F.col("event").isNull(), "failed").when(has("eval_loss"), "eval").when(has("train_runtime"), "summary").when(has("loss"), "train").otherwise("other")
    return rows.withColumn("kind", kind).drop("said")


def facts(text: Column, patterns: dict[str, str]) -> dict[str, Column]:
    """The first group of each pattern, null where it doesn't match."""
    return {name: F.nullif(F.regexp_extract(text, pattern, 1), F.lit("")) for name, pattern in patterns.items()}
