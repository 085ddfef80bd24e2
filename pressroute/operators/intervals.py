"""Points in intervals by equi-joins alone: no nested loop, and no row per pair of a point and an interval.

Time is cut into leaves of one second, and leaves into a binary tree: node n of level k holds the leaves
n * 2^k .. (n + 1) * 2^k - 1. The leaves between an interval's first and last one are covered by two nodes a
level at most (and by all nodes of the highest level between), and the points below each node are aggregated
once for all intervals. Only the points in an interval's first and last second are compared with its ends, one
row for each distinct instant.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from pressroute.operators.joins import split_join

LEAF_MICROS = 1_000_000
#: Levels of the tree: a node of the highest holds six days.
LEVELS = 20


def covering_nodes(first: Column, last: Column, levels: int = LEVELS) -> Column:
    """The nodes ``(level, node)`` that hold the leaves ``first`` to ``last``, each once; empty if last is before first."""
    def named(level, node):
        return F.struct(F.lit(level).alias("level"), node.cast("long").alias("node"))

    nodes = []
    for level in range(levels):
        size = 1 << level
        low, high = F.floor((first + (size - 1)) / size), F.floor((last + 1) / size)  # whole nodes from low to before high
        if level == levels - 1:
            top = F.when(low < high, F.transform(F.sequence(low, high - 1), lambda node: named(level, node)))
        else:
            nodes += [F.when((low < high) & (F.pmod(odd, F.lit(2)) == 1), named(level, node)) for node, odd in ((low, low), (high - 1, high))]
    return F.concat(F.array_compact(F.array(*nodes)), F.coalesce(top, F.array().cast("array<struct<level:int,node:bigint>>")))


def aggregate_in_intervals(intervals: DataFrame, keys: list[str], start: str, stop: str, points: DataFrame, at: str,
                           aggregates: dict[str, tuple[Callable[[str], Column], str]]) -> DataFrame:
    """``keys`` and one column an aggregate, over the points with ``start <= at <= stop`` of the intervals of each key.

    ``aggregates`` names a function and a column of ``points``: ``{"first": (F.min, "date")}``. The function must be
    able to work on its own results (``F.min``, ``F.max``, ``F.sum``, ``F.bit_or``). Intervals may overlap at will.
    A key whose intervals hold no point has no row; intervals with a null end hold nothing. An instant that very many
    points share is one row before anything is shuffled by it, and a node that very many intervals use is split.
    """
    def micros(name):
        return F.unix_micros(F.col(name).cast("timestamp"))

    def leaf(value):
        return F.floor(value / LEAF_MICROS)

    again = [fn(name).alias(name) for name, (fn, _) in aggregates.items()]
    instants = points.where(F.col(at).isNotNull()).groupBy(micros(at).alias("__at")).agg(
        *[fn(column).alias(name) for name, (fn, column) in aggregates.items()])
    spans = intervals.where(F.col(start) <= F.col(stop)).select(*keys, micros(start).alias("__start"), micros(stop).alias("__stop")).withColumns(
        {"__first": leaf(F.col("__start")), "__last": leaf(F.col("__stop"))})
    edges = spans.withColumn("__leaf", F.explode(F.array_distinct(F.array("__first", "__last"))))
    inside = edges.join(instants.withColumn("__leaf", leaf(F.col("__at"))), "__leaf").where("__at between __start and __stop")
    above = F.array(*[F.struct(F.lit(level).alias("level"), F.floor(F.col("__leaf") / (1 << level)).cast("long").alias("node"))
                      for level in range(LEVELS)])
    leaves = instants.groupBy(leaf(F.col("__at")).alias("__leaf")).agg(*again)
    nodes = leaves.select(F.explode(above).alias("__n"), *aggregates).select("__n.level", "__n.node", *aggregates).groupBy("level", "node").agg(*again)
    between = covering_nodes(F.col("__first") + 1, F.col("__last") - 1)
    cover = spans.select(*keys, F.explode(between).alias("__n")).select(*keys, "__n.level", "__n.node")
    whole = split_join(cover, nodes, ["level", "node"]).groupBy(*keys).agg(*again)
    return inside.groupBy(*keys).agg(*again).unionByName(whole).groupBy(*keys).agg(*again)
