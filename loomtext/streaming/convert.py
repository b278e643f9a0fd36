"""Script conversion of documents that arrive as files: stateless, with errors in a column and a checkpoint to resume."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from loomtext.functions import script as S


def rules_version() -> str:
    """A fingerprint of the conversion rules."""
    told = repr((S.thaana_tokens(), sorted(S.thaana_map().items()), S.MARKS, S.latin_tokens(), sorted(S.latin_map().items())))
    return hashlib.sha256(told.encode()).hexdigest()


def convert(requests: DataFrame) -> DataFrame:
    """(id, output, error, rules) for requests (id, direction, text), batch or stream; a bad request fails alone."""
    known = F.col("direction").isin("th2la", "la2th")
    output = F.when(F.col("direction") == "th2la", S.to_latin(F.col("text"))).when(F.col("direction") == "la2th", S.to_thaana(F.col("text")))
    error = F.when(~F.coalesce(known, F.lit(False)), F.concat(F.lit("unknown direction: "), F.coalesce("direction", F.lit("none")))).when(F.col("text").isNull(), "no text")
    return requests.select("id", F.when(error.isNull(), output).alias("output"), error.alias("error"), F.lit(rules_version()).alias("rules"))


def run_files(spark: SparkSession, source: str, sink: str, checkpoint: str) -> StreamingQuery:
    """Convert the JSON files in `source` that no run has seen, then stop."""
    requests = spark.readStream.schema("id long, direction string, text string").json(source)
    return convert(requests).writeStream.format("json").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(sink)


def progress(query: StreamingQuery) -> list[dict[str, float]]:
    """What a query has done, batch by batch: number, rows read, seconds."""
    return [{"batch": p["batchId"], "rows": p["numInputRows"], "seconds": p["durationMs"].get("triggerExecution", 0) / 1000} for p in map(dict, query.recentProgress)]
