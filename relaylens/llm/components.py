"""Connected components of an edge table by star contraction.

Each round hooks every neighbour of a node onto the smallest one it knows
(first the larger neighbours, then the smaller); rounds end when the edges
are stars already.  A round is a partial aggregate and a join on the node,
so a node with very many neighbours is never gathered, and each round's
edges are written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from relaylens.llm.ship import to_table


def _print(edges: DataFrame) -> tuple:
    """Equal for equal edge sets."""
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def _hook(edges: DataFrame, larger: bool) -> DataFrame:
    """For every node u and its least known node m: each larger neighbour
    (or u and each smaller one) linked to m."""
    if larger:
        near = edges.union(edges.select("v", "u")).toDF("u", "v")
    else:
        near = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = near.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    rows = near.join(least, "u")
    if larger:
        out = rows.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = rows.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
    return out.where(F.col("u") != F.col("v")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(u, v): every node that is not its component's smallest, with that
    smallest node.  ``edges`` has u and v (long), in any direction."""
    now = to_table(edges.where(F.col("u") != F.col("v")).select("u", "v").distinct(), "edges")
    seen = _print(now)
    while seen[0]:
        now = to_table(_hook(_hook(now, True), False), "edges")
        got = _print(now)
        if got == seen:
            break
        seen = got
    return now
