"""Connected components of a link table as Spark joins and aggregates."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulae.session import discard, reuse

MAX_ROUNDS = 60


def local_forest(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Smallest member (by index) of each index's component, for links
    ``a[i]``-``b[i]`` among ``n`` indexes."""
    root = np.arange(n)
    while len(a):
        ra, rb = root[a], root[b]
        if (same := ra == rb).all():
            break
        a, b, ra, rb = a[~same], b[~same], ra[~same], rb[~same]
        np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))
        while not np.array_equal(jump := root[root], root):
            root = jump
    return root


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node of ``links``; the root is the component's
    smallest node. Alternating large-star and small-star rounds, each written
    to the shared folder; a hub's rows are only ever joined with one row of
    its own, written before the join, as adaptive execution splits no join
    that has an aggregate between it and the shuffle. Self-links and nulls are
    ignored; no links give no rows."""
    edges = (links.where(F.col(a) != F.col(b))
             .select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct())
    edges, before = reuse(edges), None
    for _ in range(MAX_ROUNDS):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = reuse(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
        large = reuse(both.join(least, "u").where(F.col("v") > F.col("u"))
                      .select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        low = reuse(large.groupBy("u").agg(F.min("v").alias("m")))
        small = (large.join(low, "u")
                 .select(F.explode(F.array(F.struct(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v")),
                                           F.struct(F.col("u").alias("u"), F.col("m").alias("v")))).alias("e"))
                 .select("e.u", "e.v").where("u != v").distinct())
        after, old = reuse(small), edges
        state = tuple(after.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        edges = after
        discard(old, least, large, low)
        if state == before:
            break
        before = state
    else:
        raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
    return (edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
            .unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()))
