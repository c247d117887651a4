"""A few keys holding most records: per-key results without one key holding up the rest."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import heavy_keys, shuffle_width, spill, whole_number

#: Share of the rows from which the sketch names a key as heavy; bounds the broadcast to 100 keys an end.
SKETCH_SUPPORT = 0.01


def edges_of(df: DataFrame, src: str = "src", dst: str = "dst", edge_id: str = "edge_id") -> DataFrame:
    """Each edge once, with its ends as int64.

    Rows delivered again are recognised by ``edge_id`` (should their ends differ, the smallest value stands); rows
    without one count as an edge each. Text that is no whole number gives a null end.
    """
    ends = [(whole_number(c) if dict(df.dtypes)[c] == "string" else F.col(c).cast("bigint")).alias(n) for c, n in ((src, "src"), (dst, "dst"))]
    rows = df.select(F.col(edge_id).alias("edge_id"), *ends)
    known = rows.where("edge_id is not null").groupBy("edge_id").agg(F.min("src").alias("src"), F.min("dst").alias("dst"))
    return known.unionByName(rows.where("edge_id is null")).select("src", "dst")


def endpoint_stats(edges: DataFrame, support: float = SKETCH_SUPPORT) -> DataFrame:
    """Edge and distinct-neighbour counts of every vertex at either end: endpoint, vertex_key, edges, neighbours, heavy.

    ``edges`` has src and dst (int64) and should be a written table, since it is read twice. Heavy keys are named by a
    sketch over all rows (at most ``1/support`` an end, no key at or above the support is missed). Their rows are picked
    by a broadcast join and counted in salted groups, then summed; all other keys are counted by an ordinary shuffle.
    Null ends are no vertices; a null neighbour counts as an edge but not as a neighbour. Empty input gives no rows.
    """
    spark = edges.sparkSession
    heavy = heavy_keys(edges, ["src", "dst"], support)
    named = spark.createDataFrame([(e, k) for e in ("src", "dst") for k in heavy[e]], "endpoint string, vertex_key bigint")
    ends = edges.select(F.inline(F.array(
        F.struct(F.lit("src").alias("endpoint"), F.col("src").alias("vertex_key"), F.col("dst").alias("other")),
        F.struct(F.lit("dst").alias("endpoint"), F.col("dst").alias("vertex_key"), F.col("src").alias("other")),
    ))).where("vertex_key is not null")
    keys, salt = ["endpoint", "vertex_key"], F.pmod(F.xxhash64("other"), F.lit(shuffle_width(spark)))
    hot = (
        ends.join(F.broadcast(named), keys)
        .groupBy(*keys, "other").agg(F.count(F.lit(1)).alias("n"))
        .groupBy(*keys, salt.alias("salt")).agg(F.sum("n").alias("n"), F.count("other").alias("k"))
        .groupBy(*keys).agg(F.sum("n").alias("edges"), F.sum("k").alias("neighbours")).withColumn("heavy", F.lit(True))
    )
    rest = (
        ends.join(F.broadcast(named), keys, "left_anti")
        .groupBy(*keys, "other").agg(F.count(F.lit(1)).alias("n"))
        .groupBy(*keys).agg(F.sum("n").alias("edges"), F.count("other").alias("neighbours")).withColumn("heavy", F.lit(False))
    )
    return hot.unionByName(rest)


def heavy_vertices(edges: DataFrame, share: float = 0.03, support: float = SKETCH_SUPPORT) -> DataFrame:
    """The vertices holding at least ``share`` of the edges that have a value at an end: endpoint, vertex_key, edges.

    Candidates come from the sketch, their exact counts from a broadcast join over all edges. The total of each end
    is counted exactly. ``share`` must be at least ``support``.
    """
    if share < support:
        raise ValueError("share must not be below the support of the sketch")
    spark = edges.sparkSession
    heavy = heavy_keys(edges, ["src", "dst"], support)
    named = spark.createDataFrame([(e, k) for e in ("src", "dst") for k in heavy[e]], "endpoint string, vertex_key bigint")
    ends = edges.select(F.inline(F.array(F.struct(F.lit("src").alias("endpoint"), F.col("src").alias("vertex_key")), F.struct(F.lit("dst").alias("endpoint"), F.col("dst").alias("vertex_key"))))).where("vertex_key is not null")
    totals = ends.groupBy("endpoint").agg(F.count(F.lit(1)).alias("total"))
    counts = ends.join(F.broadcast(named), ["endpoint", "vertex_key"]).groupBy("endpoint", "vertex_key").agg(F.count(F.lit(1)).alias("edges"))
    return counts.join(F.broadcast(totals), "endpoint").where(F.col("edges") >= F.lit(Decimal(str(share))) * F.col("total")).select("endpoint", "vertex_key", "edges")


def prepared(df: DataFrame) -> DataFrame:
    """:func:`edges_of` as a written table."""
    return spill(edges_of(df))
