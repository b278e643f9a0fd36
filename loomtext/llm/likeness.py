"""Sets that are alike: connected by an exact Jaccard bound, found where they share a key.

Whoever calls gives keys of which like sets share at least one. A node is first held against one or two of the least
nodes of its keys, then against those least nodes that this didn't link it with; what that links is one group, and only
nodes of different groups that share a key are then held against each other. So a large group of near copies makes no
square of pairs, and yet every pair of a key is linked or compared.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from loomtext.llm.components import connected_components
from loomtext.llm.scratch import materialise

#: Least Jaccard likeness, as a fraction.
LIKE = (4, 5)


def alike(a: Column, b: Column) -> Column:
    """The distinct items of two arrays have a Jaccard likeness of LIKE or more, in whole numbers; empty sets are alike."""
    common, part, whole = F.size(F.array_intersect(a, b)), *LIKE
    return (part + whole) * common >= part * (F.size(a) + F.size(b))


def alike_pairs(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those of `pairs` (a, b) whose sets are alike."""
    a = sets.select(F.col("node").alias("a"), F.col("items").alias("of_a"), F.size("items").alias("n_a"))
    b = sets.select(F.col("node").alias("b"), F.col("items").alias("of_b"), F.size("items").alias("n_b"))
    both = pairs.join(a, "a").join(b, "b")
    part, whole = LIKE
    near = (whole * F.col("n_a") >= part * F.col("n_b")) & (whole * F.col("n_b") >= part * F.col("n_a"))
    return both.where(near).where(alike(F.col("of_a"), F.col("of_b"))).select("a", "b")


def all_pairs(open_keys: DataFrame) -> DataFrame:
    """Pairs (a, b) of nodes that share a key of `open_keys` (key, node, root) and have different roots."""
    x, y = (open_keys.select("key", F.col("node").alias(n), F.col("root").alias(f"r_{n}")) for n in "ab")
    return x.join(y, "key").where("a > b and r_a <> r_b").select("a", "b").distinct()


def rest_links(open_keys: DataFrame, sets: DataFrame) -> DataFrame:
    """Links (a, b) of nodes that share a key of `open_keys` and have different roots, by comparing every pair."""
    return alike_pairs(all_pairs(open_keys), sets)


def cell_links(may: Callable[[int], np.ndarray], root: np.ndarray, items: list[np.ndarray]) -> list[tuple[int, int]]:
    """Links (i, j) that connect whatever is alike among the sets of one cell: fewer than there are sets.

    Sets of one root are connected already; `may` gives those before the i-th that may be alike with it.
    """
    part, whole = LIKE
    size = np.asarray([len(x) for x in items], np.int64)
    label = np.unique(root, return_inverse=True)[1]
    _, told, many = np.unique(np.concatenate(items), return_inverse=True, return_counts=True)
    own = [x[many[x] > 1] for x in np.split(told, np.cumsum(size)[:-1])]  # what only one set has is common to none
    held, links = np.zeros(len(many), bool), []
    for i in range(1, len(items)):
        near = may(i)
        near = near[(label[near] != label[i]) & (whole * size[near] >= part * size[i]) & (whole * size[i] >= part * size[near])]
        if not len(near):
            continue
        held[own[i]] = True
        ends = np.cumsum([len(own[j]) for j in near])
        counted = np.concatenate([[0], np.cumsum(held[np.concatenate([own[j] for j in near])])])
        common = np.diff(counted[ends], prepend=0)
        held[own[i]] = False
        near = near[(part + whole) * common >= part * (size[near] + size[i])]
        found, first = np.unique(label[near], return_index=True)
        links += [(i, int(near[k])) for k in first]
        label[np.isin(label, found)] = label[i]
    return links


def like_components(keys: DataFrame, sets: DataFrame, links_of: Callable[[DataFrame, DataFrame], DataFrame] = rest_links) -> DataFrame:
    """(node, root) for each node that has a like one: `keys` (key, node) says who may be alike, `sets` (node, items) what is.

    `links_of` finds links that connect what is alike among nodes that share a key but aren't linked yet.
    """
    keys = materialise(keys.distinct(), "keys")
    least = keys.groupBy("key").agg(F.min("node").alias("b"), F.count(F.lit(1)).alias("n")).where("n > 1")
    # one or two pairs for a node link most near copies; of what is linked no other pair is looked at
    partners = keys.join(least, "key").where("node <> b").groupBy("node").agg(F.min("b").alias("low"), F.max("b").alias("high"))
    some = partners.select(F.col("node").alias("a"), F.explode(F.array_distinct(F.array("low", "high"))).alias("b"))
    links = materialise(alike_pairs(some, sets), "partners")

    def parted(linked: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(key, node, root) of all nodes, and (key, centre, centre_root) of keys that aren't of one root."""
        rooted = keys.join(connected_components(linked), "node", "left").select("key", "node", F.coalesce("root", "node").alias("root"))
        ends = rooted.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.min(F.struct("node", "root")).alias("c")).where("low < high")
        return rooted, ends.select("key", F.col("c.node").alias("centre"), F.col("c.root").alias("centre_root"))

    rooted, centres = parted(links)
    stars = rooted.join(centres, "key").where("root <> centre_root").select(F.col("node").alias("a"), F.col("centre").alias("b")).distinct()
    links = links.unionAll(materialise(alike_pairs(stars, sets), "stars"))
    rooted, centres = parted(links)
    open_keys = materialise(rooted.join(centres, "key").where("node <> centre").select("key", "node", "root"), "open")
    return connected_components(links.unionAll(links_of(open_keys, sets)))
