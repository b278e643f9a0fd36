"""The next row in the order of an id, without a task that holds all ids."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from loomtext.llm.scratch import materialise


def next_lower(ids: DataFrame) -> DataFrame:
    """(id, next_id) for the distinct long column `id`: the next lower id; after the lowest comes the highest.

    Ids are range-partitioned, so that ranges follow one another; inside a range the next id is that of the next row, and
    the lowest of a range is followed by the highest of the nearest range below, which one row for each range tells.
    """
    spark = ids.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = materialise(ids.select("id").distinct().repartitionByRange(n, "id").withColumn("range", F.spark_partition_id()), "ranges")
    ends = ranged.groupBy("range").agg(F.min("id").alias("least"), F.max("id").alias("most"))
    by_range = Window.orderBy("range")  # one row for each of n ranges
    above = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    follows = ends.select("range", F.coalesce(F.lag("most").over(by_range), F.max("most").over(above)).alias("wrap"))
    inside = Window.partitionBy("range").orderBy("id")
    stepped = ranged.withColumn("below", F.lag("id").over(inside))
    return stepped.join(F.broadcast(follows), "range").select("id", F.coalesce("below", "wrap").alias("next_id"))
