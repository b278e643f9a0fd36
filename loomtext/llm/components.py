"""Connected components of a graph of ordered ids, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from loomtext.llm.scratch import discard, materialise


def connected_components(links: DataFrame) -> DataFrame:
    """(node, root) for each node of `links` (a, b), root the smallest node it can reach; a root has no row of its own.

    Each round hangs every node's larger neighbours, then its smaller ones, on the least node it knows; only minima and
    joins are used, so that no neighbourhood is gathered in one place. A round's edges are written to the shared folder.
    """
    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    mark, turn, last = None, 0, None
    while True:
        edges = materialise(edges, f"edges{turn}")
        if last is not None:
            discard(last)
        last = edges
        now = edges.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
        if (now["n"], now["x"]) == mark or not now["n"]:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        mark, turn = (now["n"], now["x"]), turn + 1
        both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        below = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(below, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = small.unionAll(below.select("u", F.col("m").alias("v"))).distinct()
