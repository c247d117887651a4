"""The eight ways to follow edges from a vertex."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import spill

DIRECTIONS = ("incoming edges", "outgoing edges", "all edges", "symmetric edges", "in-neighbors", "out-neighbors", "all neighbors", "symmetric neighbors")


def both_ways(edges: DataFrame, *keep: str) -> DataFrame:
    """Every edge and its reverse in one pass, loops twice: center, other."""
    return edges.select(*keep, F.inline(F.array(F.struct(F.col("src").alias("center"), F.col("dst").alias("other")), F.struct(F.col("dst").alias("center"), F.col("src").alias("other")))))


def pairs(edges: DataFrame, direction: str, weight: str | None = None) -> DataFrame:
    """center, other for the direction. Symmetric edges are as many as the rarer of the two directions has, neighbours are distinct.

    With ``weight`` also that attribute of the edge followed; of parallel edges to a neighbour the one of smallest eid counts (of two edges there and back the smaller, too).
    No single edge stands for a symmetric one, so that a weight is an error there.
    """
    if direction not in DIRECTIONS:
        raise ValueError(f"no direction {direction!r}; there are {DIRECTIONS}")
    kind = direction.replace("neighbors", "edges").replace("in-", "incoming ").replace("out-", "outgoing ")
    keep = ["eid", weight] if weight else []
    if kind == "symmetric edges":
        if weight:
            raise ValueError(f"edge attributes are not defined on {direction}")
        out = symmetric(edges).select(F.col("src").alias("center"), F.col("dst").alias("other"))
    elif kind == "all edges":
        out = both_ways(edges, *keep)
    else:
        ends = ("dst", "src") if kind == "incoming edges" else ("src", "dst")
        out = edges.select(*keep, F.col(ends[0]).alias("center"), F.col(ends[1]).alias("other"))
    if direction.endswith("neighbors"):
        return out.groupBy("center", "other").agg(F.min(F.struct("eid", weight))[weight].alias(weight)) if weight else out.distinct()
    return out.drop("eid")


def symmetric(edges: DataFrame) -> DataFrame:
    """src, dst, min(copies, reversed copies) times each, numbered by k. One aggregation over unordered pairs, no join."""
    low, high = F.least("src", "dst"), F.greatest("src", "dst")
    counted = edges.groupBy(low.alias("a"), high.alias("b")).agg(F.count_if(F.col("src") <= F.col("dst")).alias("forth"), F.count_if(F.col("src") >= F.col("dst")).alias("back"))
    copies = counted.withColumn("n", F.least("forth", "back")).where("n > 0").select("a", "b", F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))).alias("k"))
    return copies.select("k", F.inline(F.expr("if(a = b, array(struct(a as src, b as dst)), array(struct(a as src, b as dst), struct(b as src, a as dst)))")))


def neighbours(edges: DataFrame) -> DataFrame:
    """Simple undirected neighbourhood: center, other, distinct and without loops."""
    return both_ways(edges.where("src <> dst")).distinct()


def in_order(pairs: DataFrame, at: str, by: str) -> tuple[DataFrame, DataFrame]:
    """The rows of each ``at`` numbered 0, 1, ... by ``by`` as k, and their number as d. So that one of a vertex's many neighbours is looked up by (vertex, number), and none has them all in a row."""
    rows = spill(pairs.withColumn("k", F.row_number().over(Window.partitionBy(at).orderBy(by)) - 1))
    return rows, spill(rows.groupBy(at).agg(F.count(F.lit(1)).alias("d")))
