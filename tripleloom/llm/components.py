"""Connected components of an edge table by alternating large and small stars, all in joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise


def _to_smallest(sym: DataFrame, out, with_self: bool) -> DataFrame:
    least = materialise(sym.groupBy("a").agg(F.min("b").alias("m")), "star").withColumnRenamed("a", "k")
    joined = sym.join(least, sym["a"] == least["k"]).select("a", "b", F.least("a", "m").alias("m"))
    made = out(joined)
    if with_self:
        made = made.unionByName(least.where("m < k").select(F.col("k").alias("a"), F.col("m").alias("b")))
    return made.where("a <> b").distinct()


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """edges(a, b) of longs -> node, component: the smallest node reachable. Nodes without an edge don't appear.

    Each round points every node's larger neighbours, then its smaller ones, at the smallest; the edges only shrink or
    shorten, and when a round changes none they are stars.
    """
    cur = materialise(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    state = None
    for _ in range(max_rounds):
        sym = cur.unionByName(cur.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = materialise(_to_smallest(sym, lambda j: j.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")), False), "large-star")
        cur = materialise(_to_smallest(large, lambda j: j.select(F.col("b").alias("a"), F.col("m").alias("b")), True), "small-star")
        cur = cur.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        new = tuple(cur.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if new == state or not new[0]:
            break
        state = new
    else:
        raise RuntimeError(f"components didn't settle in {max_rounds} rounds")
    return cur.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(cur.select(F.col("b").alias("node"), F.col("b").alias("component"))).distinct()
