"""Connected components of a table of links, by joins."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from backtrail.llm.common import cut, forget_shuffles, release


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (node, smallest node of its component) that connect what the links (a, b) connect."""
    if len(a) == 0:
        return a, b
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[x], root[y])
        before = root.copy()
        np.minimum.at(root, root[x], low)
        np.minimum.at(root, root[y], low)
        while not np.array_equal(root, root[root]):
            root = root[root]
        if np.array_equal(root, before):
            break
    moved = root != np.arange(len(nodes))
    return nodes[moved], nodes[root[moved]]


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of `links` (a, b) but the roots; root is the smallest node of a component.

    Large-star and small-star steps in turn: every node links its larger neighbours to its smallest
    one, then its smaller ones. The smallest neighbours are folded on the map side and written first,
    so the join of a node with very many links has two plain shuffles, which Spark splits when they
    are skewed. Nothing is collected but a count and a checksum of the links per round; the tables and shuffles
    of a round are removed after it, so that the disk holds those of one round. Rows with a
    null end and links of a node with itself are no links. Empty in, empty out.
    """
    ends = [F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")]
    clean = links.filter(F.col("a").isNotNull() & F.col("b").isNotNull() & (F.col("a") != F.col("b")))
    star = cut(clean.select(*ends).distinct(), "links")
    state = _state(star)
    while state[0]:
        both = star.select(F.col("hi").alias("x"), F.col("lo").alias("y")).union(star.select(F.col("lo").alias("x"), F.col("hi").alias("y")))
        first = cut(both.groupBy("x").agg(F.min("y").alias("m")).select(F.col("x").alias("lo"), F.least("x", "m").alias("m")), "least")
        large = star.join(first, "lo").select("hi", F.col("m").alias("lo"))
        # the smaller neighbours of a node: its own, and those that the large star gave it
        large = cut(large.distinct(), "large")
        least = cut(large.groupBy("hi").agg(F.min("lo").alias("m")), "least")
        rest = large.join(least, "hi").filter(F.col("lo") != F.col("m")).select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
        before, star = star, cut(least.select("hi", F.col("m").alias("lo")).union(rest).distinct(), "links")
        release(before, first, large, least)
        del before, both, first, large, least, rest
        forget_shuffles(star.sparkSession)
        after = _state(star)
        if after == state:
            break
        state = after
    return star.select(F.col("hi").alias("node"), F.col("lo").alias("root"))


def _state(star: DataFrame) -> tuple:
    return tuple(star.agg(F.count("*"), F.bit_xor(F.xxhash64("hi", "lo")), F.sum(F.col("lo").cast("decimal(38,0)"))).first())
