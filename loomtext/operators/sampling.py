"""Samples: proportional allocation, per-stratum draws, shards, order statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from loomtext.names import unused
from loomtext.operators.corpus import seeded_order
from loomtext.scratch import materialise

PASSES = 4


def allocate(counts: DataFrame, total: int, floor: int) -> DataFrame:
    """(name, n, quota) from (name, n), a row for each stratum: a floor, then by size, then by largest remainder.

    Units that remain go round the strata by remainder up to PASSES times, to those that still have rows; that is the
    same as giving stratum i of the order one unit in round r while fewer than the remainder are given.
    """
    every = Window.partitionBy()
    c = counts.withColumn("floor", F.least(F.lit(floor), F.col("n")))
    c = c.withColumn("left", F.lit(total) - F.sum("floor").over(every))
    c = c.withColumn("floor", F.when(F.col("left") <= 0, 0).otherwise(F.col("floor"))).withColumn("left", F.when(F.col("left") <= 0, total).otherwise(F.col("left")))
    c = c.withColumn("head", F.col("n") - F.col("floor")).withColumn("pool", F.sum("head").over(every))
    c = c.withColumn("exact", F.when(F.col("pool") > 0, F.col("left") * F.col("head") / F.col("pool")).otherwise(0.0))
    c = c.withColumn("base", F.col("floor") + F.floor("exact")).withColumn("short", F.lit(total) - F.sum("base").over(every))
    c = c.withColumn("place", F.row_number().over(Window.orderBy(F.desc(F.col("exact") - F.floor("exact")), "name")))
    offers = c.withColumn("round", F.explode(F.sequence(F.lit(1), F.lit(PASSES)))).where(F.col("base") + F.col("round") <= F.col("n"))
    given = offers.withColumn("turn", F.row_number().over(Window.orderBy("round", "place"))).where(F.col("turn") <= F.col("short"))
    extra = given.groupBy("name").agg(F.count(F.lit(1)).alias("extra"))
    return c.join(extra, "name", "left").select("name", "n", (F.col("base") + F.coalesce("extra", F.lit(0))).alias("quota"))


def draw(rows: DataFrame, stratum: str, key: str, quotas: DataFrame, seed: int) -> DataFrame:
    """The first `quota` rows of each stratum (name) in a seeded order, without replacement.

    Ranking keeps a bounded heap for each stratum in each task before the shuffle (a group limit), so a hot stratum sends
    its quota from each task only.
    """
    met = rows.join(F.broadcast(quotas.select(F.col("name").alias(stratum), "quota")), stratum)
    most = quotas.agg(F.max("quota")).first()[0] or 0
    order = Window.partitionBy(stratum).orderBy(seeded_order(F.col(key), seed), key)
    ranked = met.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most)
    return ranked.where(F.col("place") <= F.col("quota")).drop("quota")


def ranged(rows: DataFrame, *order: str) -> tuple[DataFrame, str]:
    """`rows` range-partitioned by `order`, written, with their range's number in a column of the returned name.

    Written, since a range is sampled anew each time it is planned: sizes and rows must be of the same ranges.
    """
    n, own = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), unused(rows)
    return materialise(rows.repartitionByRange(n, *order).withColumn(f"{own}range", F.spark_partition_id()), "ranges"), f"{own}range"


def numbered(rows: DataFrame, order: str, name: str = "place") -> DataFrame:
    """`rows` with their place from 0 in `order`, without one task that has all: places within ranges, plus what lies before."""
    placed, at = ranged(rows, order)
    sizes = placed.groupBy(at).agg(F.count(F.lit(1)).alias("n"))
    before = sizes.select(F.col(at).alias(f"{at}_of"), (F.sum("n").over(Window.orderBy(at)) - F.col("n")).alias(f"{at}_before"))  # a row for each range
    inside = F.row_number().over(Window.partitionBy(at).orderBy(order)) - 1
    met = placed.withColumn(f"{at}_inside", inside).join(F.broadcast(before), F.col(at) == F.col(f"{at}_of"))
    return met.withColumn(name, F.col(f"{at}_inside") + F.col(f"{at}_before")).drop(at, f"{at}_of", f"{at}_before", f"{at}_inside")


def numbered_top(ordered: DataFrame, k: int) -> DataFrame:
    """The first `k` rows of an ordered table with their `place` from 1: a bounded heap in each task, k rows in the last."""
    top = ordered.limit(k).coalesce(1)
    return top.withColumn("place", F.monotonically_increasing_id() + 1)


def round_robin(rows: DataFrame, order: str, shards: int) -> DataFrame:
    """`rows` with `shard`: place modulo `shards`."""
    return numbered(rows, order).withColumn("shard", (F.col("place") % shards).cast("int"))


def systematic(rows: DataFrame, order: str, step: int, most: int) -> DataFrame:
    """Every `step`-th row by place, `most` at most."""
    return numbered(rows, order).where((F.col("place") % step == 0) & (F.col("place") < step * most))


def nearest_rank(values: Column, q: float) -> Column:
    """The value at floor(q n) of a sorted array, the last at most."""
    return F.get(values, F.least(F.size(values) - 1, F.floor(F.size(values) * q).cast("int")))


def running(rows: DataFrame, group: str, value: str, amount: str) -> DataFrame:
    """`rows` with `upto`: the sum of `amount` over the rows of the group up to this one, in the order of value.

    Rows are range-partitioned by group and value, so that a hot group spreads; sums inside a range get what lies before.
    """
    placed, at = ranged(rows, group, value)
    sums = placed.groupBy(group, at).agg(F.sum(amount).alias("s"))
    so_far = F.sum("s").over(Window.partitionBy(group).orderBy(at)) - F.col("s")  # a row for each range of a group
    before = sums.select(F.col(group).alias(f"{at}_group"), F.col(at).alias(f"{at}_of"), so_far.alias(f"{at}_before"))
    inside = F.sum(amount).over(Window.partitionBy(at, group).orderBy(value).rowsBetween(Window.unboundedPreceding, 0))
    met = placed.withColumn(f"{at}_inside", inside).join(before, F.col(group).eqNullSafe(F.col(f"{at}_group")) & (F.col(at) == F.col(f"{at}_of")))
    return met.withColumn("upto", F.col(f"{at}_inside") + F.col(f"{at}_before")).drop(at, f"{at}_group", f"{at}_of", f"{at}_before", f"{at}_inside")


def _counted(rows: DataFrame, group: str, value: str) -> DataFrame:
    """(of, v, c, n, total, upto): each distinct value of a group, how often it comes, and how many rows there are up to it.

    Equal values are counted before they meet, and cumulated by value; no list of a group's rows is built.
    """
    counts = rows.groupBy(F.col(group).alias("of"), F.col(value).alias("v")).agg(F.count(F.lit(1)).alias("c"))
    totals = counts.groupBy(F.col("of").alias("g")).agg(F.sum("c").alias("n"), F.sum(F.col("v") * F.col("c")).alias("total"))
    return running(counts, "of", "v", "c").join(totals, F.col("of").eqNullSafe(F.col("g"))).drop("g")


def quantiles(rows: DataFrame, group: str, value: str, qs: dict[str, float], clamp: bool = True) -> DataFrame:
    """(group, n, mean, *qs): the value of each group at place floor(q n) of its sorted rows, nulls left out.

    With `clamp` the place is n - 1 at most; without, a place behind the last row gives null.
    """
    placed = _counted(rows.where(F.col(value).isNotNull()), group, value)

    def at(q: float) -> Column:
        place = F.floor(F.col("n") * q)
        return F.least(F.col("n") - 1, place) if clamp else place

    found = [F.min(F.when(F.col("upto") > at(q), F.col("v"))).alias(k) for k, q in qs.items()]
    return placed.groupBy(F.col("of").alias(group)).agg(F.first("n").alias("n"), F.first(F.col("total") / F.col("n")).alias("mean"), *found)


def medians(rows: DataFrame, group: str, value: str) -> DataFrame:
    """(group, n, median): the middle value of each group, between two middle ones their mean."""
    placed = _counted(rows.where(F.col(value).isNotNull()), group, value)
    middle = [F.min(F.when(F.col("upto") > F.floor((F.col("n") - k) / 2), F.col("v"))) for k in (1, 0)]
    told = placed.groupBy(F.col("of").alias(group)).agg(F.first("n").alias("n"), middle[0].alias("low"), middle[1].alias("high"))
    return told.select(group, "n", ((F.col("low") + F.col("high")) / 2).alias("median"))


def empirical_cdf(rows: DataFrame, group: str, value: str) -> DataFrame:
    """(group, value, percent): for each row in the order of value, the percent of rows up to it; of equal values one after another."""
    placed = _counted(rows, group, value)
    each = placed.select("of", "v", "n", F.explode(F.sequence(F.col("upto") - F.col("c") + 1, F.col("upto"))).alias("k"))
    return each.select(F.col("of").alias(group), F.col("v").alias(value), (100.0 * F.col("k") / F.col("n")).alias("percent"))


def first_examples(rows: DataFrame, group: str, order: str, k: int) -> DataFrame:
    """The first k rows of each group."""
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(group).orderBy(order))).where(F.col("place") <= k)
