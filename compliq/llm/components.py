"""Connected components of an edge table, by alternating large-star and small-star steps (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from compliq.llm.common import materialize


def _facts(edges: DataFrame) -> tuple:
    r = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b") % 1_000_003), F.bit_xor(F.xxhash64("b", "a"))).first()
    return tuple(r)


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component): the smallest node reachable, for each node that has an edge (a, b); loops and repeats are harmless.

    The nodes must be of one ordered type. A step joins the edges with one row per node, so a node with very many
    neighbours is only a skewed key of a join, which adaptive execution splits; no neighbour list is ever gathered.
    """
    edges = materialize(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    before = _facts(edges)
    for _ in range(rounds):
        # large star: each node links its larger neighbours to its smallest
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = materialize(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        large = materialize(large.distinct())
        # small star: each node links its smaller neighbours and itself to the smallest
        least = materialize(large.groupBy("a").agg(F.min("b").alias("m")))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        edges = materialize(small.union(least.select("a", F.col("m").alias("b"))).distinct())
        after = _facts(edges)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError("components did not settle")
    stars = edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return stars.union(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
