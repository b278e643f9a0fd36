"""Appends that go on where they stopped: a stream's rows under their keys, each once, whatever is killed when."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery


def appended(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """The table that append_stream() writes at `path`; before its first batch, an empty one of `schema`."""
    try:
        return spark.read.parquet(path).drop("batch")
    except AnalysisException:
        if schema is None:
            raise
        return spark.createDataFrame([], schema)


def _put(rows: DataFrame, number: int, path: str, key: str) -> None:
    """Write what is new in a batch as the batch's own folder: a batch that is tried again replaces what it had written.

    New is what no other batch has, of equal keys the least row; a null key is a key like any other.
    """
    spark = rows.sparkSession
    others = [c for c in rows.columns if c != key]
    least = rows.groupBy(key).agg(F.min(F.struct(*others)).alias("row")) if others else rows.distinct()
    flat = least.select(*[F.col(c) if c == key else F.col("row")[c].alias(c) for c in rows.columns])
    try:
        done = spark.read.parquet(path).where(F.col("batch") != number).select(F.col(key).alias("done"))
        flat = flat.join(done, F.col(key).eqNullSafe(F.col("done")), "left_anti")
    except AnalysisException as e:
        if not any(x in str(e) for x in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA")):
            raise
    flat.write.mode("overwrite").parquet(f"{path}/batch={number}")


def append_stream(rows: DataFrame, path: str, key: str, checkpoint: str, only_new_files: bool = True) -> StreamingQuery:
    """Append a stream's rows to the table at `path`, each key once; started again with its checkpoint, it goes on.

    A batch is known by its number, which the checkpoint keeps: if it died before it was noted as done, it comes again
    under the same number. With `only_new_files` the query ends when it has read all there is.
    """
    if key not in rows.columns or "batch" in rows.columns:
        raise ValueError(f"rows need a column {key} and none named batch")
    writer = rows.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda batch, number: _put(batch, number, path, key))
    return (writer.trigger(availableNow=True) if only_new_files else writer).start()
