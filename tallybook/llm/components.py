"""Connected components of a graph whose edges are rows, by alternating stars.

Each round hangs the neighbours of every node on the smallest one it knows, first the
larger neighbours, then the smaller ones. Components become stars around their smallest
node after few rounds. Sides are joined by key; nothing is gathered.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallybook.session import is_small, materialise


def _signature(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.xxhash64("b", "a") % 65536))
    return tuple(row.first())


def _hang(edges: DataFrame, large: bool) -> DataFrame:
    """Edges (v, m): m is the smallest node next to u or u itself, v its larger or smaller ones."""
    both = edges.unionByName(edges.selectExpr("b AS a", "a AS b"))
    if not large:
        both = both.where("b < a")
    least = materialise(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")))
    chosen = both.where("b > a") if large else both.unionByName(least.selectExpr("a", "a AS b"))
    hung = chosen.join(F.broadcast(least) if is_small(least) else least, "a")
    return materialise(hung.where("b <> m").selectExpr("b AS a", "m AS b").distinct())


def components(edges: DataFrame) -> DataFrame:
    """`node, component` for every node of `edges` (`a`, `b`: longs); the smallest node names it."""
    edges = edges.where("a <> b").selectExpr("greatest(a, b) AS a", "least(a, b) AS b").distinct()
    edges = materialise(edges)
    before = None
    while (now := _signature(edges)) != before:
        before = now
        edges = _hang(_hang(edges, True), False)
    return edges.selectExpr("a AS node", "b AS component").unionByName(
        edges.selectExpr("b AS node", "b AS component").distinct()
    )
