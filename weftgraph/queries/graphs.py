"""Graphs over the driver's tables, as frames and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..graph import Graph
from .common import table


def people(spark: SparkSession, d: str) -> Graph:
    """People and whom they know: one vertex for each vertexId, each edge once if both its ends exist; weight 1 to 7."""
    v = table(spark, d, "testgraph_vertices").where("vertexId is not null").groupBy(F.col("vertexId").alias("id")).agg(F.max("name").alias("name"), F.max("age").alias("age"))
    e = table(spark, d, "testgraph_edges").where("edge_id is not null").groupBy(F.col("edge_id").alias("eid")).agg(F.min("srcVertexId").alias("src"), F.min("dstVertexId").alias("dst"), F.min("comment").alias("comment"))
    g = Graph(v, e.withColumn("weight", (F.col("eid") % 7 + 1).cast("double")))
    return g.induced(v)


PEOPLE = """
v AS (SELECT vertexId AS id, max(name) AS name, max(age) AS age FROM testgraph_vertices WHERE vertexId IS NOT NULL GROUP BY vertexId),
e AS (SELECT * FROM (SELECT edge_id AS eid, min(srcVertexId) AS src, min(dstVertexId) AS dst, min(comment) AS comment, CAST(edge_id % 7 + 1 AS DOUBLE) AS weight
  FROM testgraph_edges WHERE edge_id IS NOT NULL GROUP BY edge_id) WHERE src IN (SELECT id FROM v) AND dst IN (SELECT id FROM v)),
nb AS (SELECT DISTINCT a, b FROM (SELECT src AS a, dst AS b FROM e UNION ALL SELECT dst, src FROM e) WHERE a <> b)"""


def sales(spark: SparkSession, d: str) -> DataFrame:
    """One row a line: customer, supplier, price."""
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey")
    line = table(spark, d, "lineitem").select("l_orderkey", "l_suppkey", "l_extendedprice", "l_quantity")
    return line.join(o, line.l_orderkey == o.o_orderkey).select(
        F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("customer"), F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("supplier"), F.col("l_extendedprice").alias("price"), F.col("l_quantity").alias("quantity")
    )


SALES = "sales AS (SELECT 'c' || o_custkey AS customer, 's' || l_suppkey AS supplier, l_extendedprice AS price, l_quantity AS quantity FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"


def trade(spark: SparkSession, d: str) -> Graph:
    """Nations, and what the customers of one bought from the suppliers of another if over the average of all such pairs."""
    v = table(spark, d, "nation").select(F.col("n_nationkey").cast("bigint").alias("id"), F.col("n_name").alias("name"), F.col("n_regionkey").cast("bigint").alias("region"))
    c = table(spark, d, "customer").select("c_custkey", F.col("c_nationkey").cast("bigint").alias("src"))
    s = table(spark, d, "supplier").select("s_suppkey", F.col("s_nationkey").cast("bigint").alias("dst"))
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey")
    line = table(spark, d, "lineitem").select("l_orderkey", "l_suppkey", "l_quantity")
    e = line.join(o, line.l_orderkey == o.o_orderkey).join(c, F.col("o_custkey") == c.c_custkey).join(s, F.col("l_suppkey") == s.s_suppkey)
    e = e.groupBy("src", "dst").agg(F.sum("l_quantity").alias("weight"))
    mean = e.agg(F.avg("weight").alias("mean"))
    e = e.withColumn("_one", F.lit(1)).join(F.broadcast(mean.withColumn("_one", F.lit(1))), "_one").where("weight > mean")
    return Graph(v, e.select((F.col("src") * 1000 + F.col("dst")).alias("eid"), "src", "dst", "weight"))


TRADE = """
v AS (SELECT CAST(n_nationkey AS BIGINT) AS id, n_name AS name, CAST(n_regionkey AS BIGINT) AS region FROM nation),
flows AS (SELECT CAST(c_nationkey AS BIGINT) AS src, CAST(s_nationkey AS BIGINT) AS dst, sum(l_quantity) AS weight
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2),
e AS (SELECT src * 1000 + dst AS eid, src, dst, weight FROM flows WHERE weight > (SELECT avg(weight) FROM flows)),
nb AS (SELECT DISTINCT a, b FROM (SELECT src AS a, dst AS b FROM e UNION ALL SELECT dst, src FROM e) WHERE a <> b)"""
