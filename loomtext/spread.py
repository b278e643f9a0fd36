"""Small tables that much is computed for, in as many tasks as a shuffle has."""

from __future__ import annotations

from pyspark.sql import DataFrame


def spread(rows: DataFrame) -> DataFrame:
    """`rows` dealt anew over all of a session's shuffle partitions.

    Distinct words or stems are few bytes, so adaptive execution puts them into one task by their size; what is then
    computed for each of them would run on one core.
    """
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
