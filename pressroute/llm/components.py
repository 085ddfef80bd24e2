"""Connected components by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from pressroute.llm.common import stage
from pressroute.operators.joins import split_join


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node's larger neighbours are linked to the least of its neighbourhood."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("low"))
    return split_join(both, least, ["a"]).where("b > a").select(F.col("b").alias("a"), F.least("a", "low").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours are linked to the least of them."""
    least = edges.groupBy("a").agg(F.min("b").alias("low"))
    joined = split_join(edges, least, ["a"])
    return joined.select(F.explode(F.array(F.struct(F.col("a"), F.col("low").alias("b")),
                                           F.struct(F.col("b").alias("a"), F.col("low").alias("b")))).alias("e")
                         ).select("e.*").where("a != b").distinct()


def connected_components(edges: DataFrame, purpose: str) -> DataFrame:
    """``node, root`` of every node of the links ``a, b``; the root is the least node of its component.

    Large and small stars alternate until the links no longer change; each round is written to the
    shared folder, and only a row count and a checksum come to the driver. A node with very many links
    is split by adaptive execution. Links must not hold nulls; self links are ignored.
    """
    now = stage(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a != b").distinct(), f"{purpose}-links")
    seen = None
    while True:
        state = now.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("sum")).first()
        if state == seen or state["n"] == 0:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
                now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        seen = state
        now = stage(_small_star(_large_star(now)), f"{purpose}-links")
