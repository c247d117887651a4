"""Queries over sources and sinks, edge and weighted forms, management, plumbing and properties of random results, with their SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import functions as F

from ..functions.aggregators import aggregate
from ..graph import Graph
from ..operators import attributes as A
from ..operators import build as B
from ..operators import communities as C
from ..operators import generate as N
from ..operators import iterative as I
from ..operators import learn as L
from ..operators import metrics as M
from ..operators import plumbing as P
from ..operators import segment as S
from ..operators import structure as T
from ..operators import workflow as W
from ..plans import views as V
from ..runtime import shared_dir
from ..sources import readers as R
from ..sources import writers as O
from .common import table
from .graphs import PEOPLE, TRADE, people, trade

QUERIES: dict[str, Callable] = {}
SQL: dict[str, str] = {}


def query(sql: str, name: str | None = None):
    def add(f):
        QUERIES[name or f.__name__] = f
        SQL[name or f.__name__] = sql
        return f

    return add


def r(c, digits: int = 4):
    return F.round(F.col(c) if isinstance(c, str) else c, digits)


def _folder(spark) -> str:
    return f"{shared_dir(spark)}/weftgraph/{uuid.uuid4().hex}"


# Sources and sinks: written and read back

_CUSTOMERS = "SELECT c_custkey, c_name, c_acctbal, c_mktsegment FROM customer"


def _customers(spark, d):
    return table(spark, d, "customer").select(F.col("c_custkey").cast("bigint").alias("c_custkey"), "c_name", F.col("c_acctbal").cast("double").alias("c_acctbal"), "c_mktsegment")


@query(_CUSTOMERS)
def csv_round_trip(spark, d):
    path = _folder(spark)
    O.write_csv(_customers(spark, d), path, delimiter=";", quote_all=True)
    return R.read_csv(spark, path, delimiter=";", sql="select cast(c_custkey as bigint) c_custkey, c_name, cast(c_acctbal as double) c_acctbal, c_mktsegment from this")


@query(_CUSTOMERS + " WHERE c_acctbal > 0")
def csv_without_header_round_trip(spark, d):
    path = _folder(spark)
    O.write_csv(_customers(spark, d), path, header=False)
    df = R.read_csv(spark, path, ["c_custkey", "c_name", "c_acctbal", "c_mktsegment"], sql="select * from this where cast(c_acctbal as double) > 0")
    return df.select(F.col("c_custkey").cast("bigint").alias("c_custkey"), "c_name", F.col("c_acctbal").cast("double").alias("c_acctbal"), "c_mktsegment")


for _kind in ("json", "orc", "parquet"):

    @query(_CUSTOMERS, f"{_kind}_round_trip")
    def _round_trip(spark, d, kind=_kind):
        path = _folder(spark)
        O.write_structured(_customers(spark, d), kind, path)
        return R.read_structured(spark, kind, path, imported_columns=["c_custkey", "c_name", "c_acctbal", "c_mktsegment"])


@query(_CUSTOMERS)
def hive_round_trip(spark, d):
    name = f"weft_{uuid.uuid4().hex}"
    O.write_hive(_customers(spark, d), name, partition_by=["c_mktsegment"], path=_folder(spark))
    return R.read_hive(spark, name, imported_columns=["c_custkey", "c_name", "c_acctbal", "c_mktsegment"])


@query(f"WITH {PEOPLE} SELECT s.name AS a, t.name AS b, weight, CAST(floor(s.age / 10) * 10 AS DOUBLE) AS bottom FROM e JOIN v s ON src = s.id JOIN v t ON dst = t.id WHERE s.age IS NOT NULL")
def graph_snapshot_round_trip(spark, d):
    path = _folder(spark)
    O.save_snapshot(S.by_number(people(spark, d), "age", 10).with_scalars(made="here"), path)
    g = R.read_snapshot(spark, path)
    s = g.segmentation("bucketing")
    bottoms = s.membership.join(s.graph.vertices.select(F.col("id").alias("sid"), "bottom"), "sid").select(F.col("vid").alias("src"), "bottom")
    view = V.triplets(g, {"src_name", "dst_name", "edge_weight"}, ids=True).join(bottoms, "src")
    return view.select(F.col("src_name").alias("a"), F.col("dst_name").alias("b"), F.col("edge_weight").alias("weight"), "bottom")


@query(_CUSTOMERS)
def table_snapshot_round_trip(spark, d):
    path = _folder(spark)
    O.save_snapshot(_customers(spark, d), path)
    return R.read_snapshot(spark, path)


@query("SELECT n_name AS name, count(*) AS customers FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1")
def external_computation_of_two_tables(spark, d):
    count = lambda c, n: c.join(n, F.col("c_nationkey") == F.col("n_nationkey")).groupBy(F.col("n_name").alias("name")).agg(F.count(F.lit(1)).alias("customers"))
    return R.external_computation(count, table(spark, d, "customer"), table(spark, d, "nation"))


@query(f"WITH {PEOPLE} SELECT (SELECT count(*) FROM v) AS vertices, (SELECT count(*) FROM e) AS edges, (SELECT count(*) FROM v) - (SELECT count(*) FROM e) AS less, 'x' AS called")
def scalars_as_a_table(spark, d):
    g = people(spark, d)
    O.compute(g)
    g = P.create_scalar(g, "called", "x").with_scalars(vertices=P.count_vertices(g), edges=P.count_edges(g))
    return O.one_row(dict(A.derive_scalar(g, "less", "vertices - edges").scalars), spark)


# Examples

_EXAMPLE = "(0, 'Adam', 20.3::DOUBLE), (1, 'Eve', 18.2), (2, 'Bob', 50.3), (3, 'Isolated Joe', 2.0)"


@query(f"WITH v(id, name, age) AS (VALUES {_EXAMPLE}), e(s, t, comment, weight) AS (VALUES (0, 1, 'Adam loves Eve', 1.0::DOUBLE), (1, 0, 'Eve loves Adam', 2.0), (2, 0, 'Bob envies Adam', 3.0), (2, 1, 'Bob loves Eve', 4.0)) SELECT a.name AS src, b.name AS dst, a.age AS age, comment, weight FROM e JOIN v a ON s = a.id JOIN v b ON t = b.id")
def example_graph_triplets(spark, d):
    return V.triplets(B.example_graph(spark)).select(F.col("src_name").alias("src"), F.col("dst_name").alias("dst"), F.col("src_age").alias("age"), F.col("edge_comment").alias("comment"), F.col("edge_weight").alias("weight"))


@query("SELECT * FROM (VALUES ('Adam', 3), ('Eve', 3), ('Bob', 12), ('Cat', 8), ('Fish', 10), ('Mouse', 1), ('Wanda', 1), ('Isolated Joe', 0)) t(name, ends)")
def enhanced_example_graph_degrees(spark, d):
    g = B.enhanced_example_graph(spark)
    return g.vertices.join(M.degree(g, "all edges"), "id").select("name", F.col("degree").cast("int").alias("ends"))


@query("SELECT 34 AS vertices, 78 AS edges, 45 AS triangles, 17 AS most")
def karate_club_graph(spark, d):
    g = B.karate_club(spark)
    return spark.createDataFrame([(P.count_vertices(g), P.count_edges(g), M.triangles(g.edges).count(), int(M.degree(g).agg(F.max("degree")).first()[0]))], "vertices int, edges int, triangles int, most int")


@query("SELECT a AS src, b AS dst, CAST(a * b AS DOUBLE) AS x FROM (VALUES (0, 1), (1, 2), (2, 0), (2, 3)) t(a, b)")
def graph_made_in_python(spark, d):
    import pandas as pd

    g = B.create_graph_in_python(spark, lambda n: (pd.DataFrame({"k": range(n)}), pd.DataFrame({"src": [0, 1, 2, 2], "dst": [1, 2, 0, 3], "x": [0.0, 2.0, 0.0, 6.0]})), n=4)
    return g.edges.select("src", "dst", "x")


# Edge forms of attributes


@query(f"WITH {PEOPLE} SELECT eid, CAST(weight AS VARCHAR).replace('.0', '') AS as_text, CAST(weight AS DOUBLE) AS back, 2.0::DOUBLE AS two, CAST(eid AS VARCHAR) AS id_text, coalesce(comment, 'none') AS filled, coalesce(comment, CAST(weight AS VARCHAR).replace('.0', '')) AS merged FROM e")
def edge_attribute_forms(spark, d):
    g = A.add_constant(A.copy_attribute(people(spark, d), "edges", "weight", "as_text"), "edges", "two", 2)
    g = A.to_text(g, "edges", "as_text")
    g = A.to_number(A.copy_attribute(g, "edges", "as_text", "back"), "edges", "back")
    g = A.merge_two(A.expose_id(g, "edges"), "edges", "merged", "comment", "as_text")
    g = A.fill(A.copy_attribute(g, "edges", "comment", "filled"), "edges", {"filled": "none"})
    return g.edges.select("eid", "as_text", "back", "two", "id_text", "filled", "merged")


@query(f"WITH {PEOPLE} SELECT eid, weight AS heft, comment AS said FROM e")
def manage_edge_attributes(spark, d):
    g = A.copy_attribute(people(spark, d), "edges", "weight", "spare")
    g = A.rename_attributes(A.discard_attributes(g, "edges", "spare"), "edges", {"weight": "heft", "comment": "said"})
    g = A.set_icon(A.set_icon(g, "edges", "heft", "star"), "vertices", "name", "person")
    assert g.edges.schema["heft"].metadata == {"icon": "star"} and g.vertices.schema["name"].metadata == {"icon": "person"}
    return g.edges.select("eid", "heft", "said")


@query(f"WITH {PEOPLE} SELECT eid, upper(comment) AS loud FROM e")
def use_table_as_edge_attributes(spark, d):
    g = people(spark, d)
    loud = g.edges.select(F.col("eid").alias("k"), F.upper("comment").alias("loud"))
    return A.use_table(g, "edges", loud, "eid", "k").edges.select("eid", "loud")


@query(f"WITH {PEOPLE} SELECT count(*) AS n, true AS centred, true AS spread FROM e")
def add_random_edge_attribute(spark, d):
    e = A.add_random(people(spark, d), "edges", "x", "Standard Uniform", 3).edges
    return e.agg(F.count("x").alias("n"), (F.abs(F.avg("x") - 0.5) < 5 * 0.2887 / F.sqrt(F.count("x"))).alias("centred"), ((F.min("x") > 0) & (F.max("x") < 1) & (F.abs(F.stddev("x") - 0.2887) < 0.02)).alias("spread"))


@query("SELECT 5 AS copied, 7 AS renamed, 12 AS derived, 'b' AS other, 3 AS left_over")
def manage_graph_attributes(spark, d):
    g = B.create_vertices(spark, 3).with_scalars(a=5, b=7, c="gone")
    g = A.rename_scalars(A.copy_scalar(A.discard_scalars(g, "c"), "a", "copied"), {"b": "renamed"})
    g = A.derive_scalar(g, "derived", "a + renamed")
    g = A.copy_scalar_from(g, B.create_vertices(spark, 1).with_scalars(x="b"), "x", "other")
    return O.one_row({**{k: v for k, v in g.scalars.items() if k != "a"}, "left_over": len(g.scalars) - 2}, spark).select("copied", "renamed", "derived", "other", "left_over")


# Segmentations


@query(f"WITH {PEOPLE} SELECT CAST(floor(age / 10) * 10 AS DOUBLE) AS bottom, CAST(count(*) AS BIGINT) AS n, 0 AS emptied FROM v WHERE age IS NOT NULL GROUP BY 1")
def manage_segmentations(spark, d):
    g = A.copy_segmentation(S.by_number(people(spark, d), "age", 10), "bucketing", "again")
    g = S.make_empty(A.rename_segmentation(A.copy_segmentation(g, "again", "more"), "more", "bare"), "bare")
    g = A.discard_segmentation(g, "bucketing")
    assert sorted(g.segmentations) == ["again", "bare"]
    s = g.segmentation("again")
    counted = s.membership.groupBy("sid").agg(F.count(F.lit(1)).alias("n")).join(T.take_segmentation(g, "again").vertices.select(F.col("id").alias("sid"), "bottom"), "sid")
    return counted.select("bottom", "n", F.lit(g.segmentation("bare").membership.count()).alias("emptied"))


@query(f"WITH {PEOPLE} SELECT a.name AS base, a.name AS segment FROM v a WHERE name IS NOT NULL")
def graph_as_its_own_segmentation(spark, d):
    g = S.self_as_segmentation(people(spark, d), "self")
    return V.belongs_to(g, g.segmentation("self"), {"base_name", "segment_name"}).select(F.col("base_name").alias("base"), F.col("segment_name").alias("segment")).where("base is not null")


@query("SELECT n_name AS nation, r_name AS region FROM nation JOIN region ON n_regionkey = r_regionkey")
def links_by_matching_attributes(spark, d):
    v = Graph(table(spark, d, "nation").select(F.col("n_nationkey").cast("bigint").alias("id"), F.col("n_name").alias("nation"), F.col("n_regionkey").alias("key")))
    s = Graph(table(spark, d, "region").select(F.col("r_regionkey").cast("bigint").alias("id"), F.col("r_name").alias("region"), F.col("r_regionkey").alias("key")))
    g = S.links_from_attributes(S.other_as_segmentation(v, s, "s"), "s", "key", "key")
    return V.belongs_to(g, g.segmentation("s"), {"base_nation", "segment_region"}).select(F.col("base_nation").alias("nation"), F.col("segment_region").alias("region"))


@query("SELECT n_name AS nation, r_name AS region FROM nation JOIN region ON n_regionkey = r_regionkey")
def links_from_a_table(spark, d):
    v = Graph(table(spark, d, "nation").select(F.col("n_nationkey").cast("bigint").alias("id"), F.col("n_name").alias("nation")))
    s = Graph(table(spark, d, "region").select(F.col("r_regionkey").cast("bigint").alias("id"), F.col("r_name").alias("region")))
    links = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_name", "r_name")
    g = S.links_from_table(S.other_as_segmentation(v, s, "s"), "s", links, "nation", "n_name", "region", "r_name")
    return V.belongs_to(g, g.segmentation("s"), {"base_nation", "segment_region"}).select(F.col("base_nation").alias("nation"), F.col("segment_region").alias("region"))


@query("SELECT r_name AS region, r_name AS base_region FROM region")
def copy_attributes_to_segmentation(spark, d):
    g = Graph(table(spark, d, "region").select(F.col("r_regionkey").cast("bigint").alias("id"), F.col("r_name").alias("region")))
    g = A.copy_to_segmentation(S.by_text(g, "region", "s"), "s")
    return g.segmentation("s").graph.vertices.select("region", "base_region")


_AGES = "b AS (SELECT id, CAST(floor(age / 10) * 10 AS DOUBLE) AS bottom FROM v WHERE age IS NOT NULL)"


@query(f"""WITH {PEOPLE}, {_AGES}, n AS (SELECT bottom, count(*) AS n FROM b GROUP BY 1), k AS (SELECT p.bottom, count(*) AS k FROM nb JOIN b p ON p.id = nb.a JOIN b q ON q.id = nb.b AND p.bottom = q.bottom WHERE nb.a < nb.b GROUP BY 1)
SELECT n.bottom, CAST(n * (n - 1) / 2 - coalesce(k, 0) AS BIGINT) AS missing FROM n LEFT JOIN k ON k.bottom = n.bottom WHERE n * (n - 1) / 2 > coalesce(k, 0)""")
def check_cliques_of_ages(spark, d):
    g = S.by_number(people(spark, d), "age", 10)
    found = S.check_cliques(g, "bucketing")
    return found.join(g.segmentation("bucketing").graph.vertices.select(F.col("id").alias("sid"), "bottom"), "sid").select("bottom", "missing")


@query(f"WITH {TRADE}, t AS (SELECT DISTINCT src, dst FROM e), g AS (SELECT DISTINCT src, dst FROM e WHERE weight > 2000 OR src % 2 = 0), x AS (SELECT DISTINCT src, dst FROM e WHERE src < 15) SELECT round((SELECT count(*) FROM g JOIN x ON g.src = x.src AND g.dst = x.dst) / CAST((SELECT count(*) FROM x) AS DOUBLE), 6) AS precision, round((SELECT count(*) FROM g JOIN x ON g.src = x.src AND g.dst = x.dst) / CAST((SELECT count(*) FROM g) AS DOUBLE), 6) AS recall")
def compare_segmentation_edges(spark, d):
    e = trade(spark, d).edges
    precision, recall, _, _ = S.compare_edges(e.where("weight > 2000 or src % 2 = 0"), e.where("src < 15"))
    return spark.createDataFrame([(round(precision, 6), round(recall, 6))], "precision double, recall double")


# Weighted forms


@query("SELECT round(sum(c_acctbal * c_nationkey) / sum(c_nationkey), 6) AS average, round(sum(c_acctbal * c_nationkey), 2) AS total, arg_max(c_acctbal, (c_nationkey, c_acctbal)) AS top FROM customer")
def weighted_aggregate_vertices_globally(spark, d):
    g = Graph(table(spark, d, "customer").withColumn("id", F.col("c_custkey")))
    out = A.aggregate_globally(g, "vertices", [("c_acctbal", a) for a in ("weighted_average", "weighted_sum", "by_max_weight")], "c_nationkey")
    return out.select(r("c_acctbal_weighted_average_by_c_nationkey", 6).alias("average"), r("c_acctbal_weighted_sum_by_c_nationkey", 2).alias("total"), F.col("c_acctbal_by_max_weight_by_c_nationkey").alias("top"))


@query(f"WITH {TRADE} SELECT region, round(sum(id * id) / sum(id), 6) AS average, CAST(sum(id * id) AS DOUBLE) AS total FROM v GROUP BY 1")
def weighted_aggregate_to_segmentation(spark, d):
    g = S.by_text(A.derive(trade(spark, d), "vertices", "k", "cast(id as double)", False), "region", "s")
    out = A.aggregate_to_segmentation(g, "s", [("k", "weighted_average"), ("k", "weighted_sum")], "k")
    return g.segmentation("s").graph.vertices.join(out, "id").select("region", r("k_weighted_average_by_k", 6).alias("average"), F.col("k_weighted_sum_by_k").alias("total"))


@query("WITH m AS (SELECT DISTINCT l_orderkey, p_size FROM lineitem JOIN part ON l_partkey = p_partkey), s AS (SELECT p_size, count(*) AS n FROM m GROUP BY 1) SELECT l_orderkey AS id, round(sum(m.p_size * n) / CAST(sum(n) AS DOUBLE), 6) AS average FROM m JOIN s ON s.p_size = m.p_size GROUP BY 1")
def weighted_aggregate_from_segmentation(spark, d):
    links = table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey")).select(F.col("l_orderkey").alias("vid"), F.col("p_size").cast("double").alias("psize")).distinct()
    g = S._from_keys(Graph(table(spark, d, "orders").select(F.col("o_orderkey").alias("id"))), "s", links, ["psize"], True)
    out = A.aggregate_from_segmentation(g, "s", [("psize", "weighted_average")], "size")
    return out.select("id", r("s_psize_weighted_average_by_size", 6).alias("average"))


@query(f"WITH {PEOPLE} SELECT src AS id, round(sum(weight * eid) / sum(eid), 6) AS average, arg_min(weight, (eid, weight)) AS first FROM e GROUP BY 1")
def weighted_aggregate_edges_to_vertices(spark, d):
    out = A.aggregate_edges(people(spark, d), "outgoing edges", [("weight", "weighted_average"), ("weight", "by_min_weight")], "eid", "")
    return out.select("id", r("weight_weighted_average_by_eid", 6).alias("average"), F.col("weight_by_min_weight_by_eid").alias("first"))


@query(f"WITH {PEOPLE} SELECT src AS id, round(sum(age * age) / sum(age), 6) AS average FROM e JOIN v ON dst = id WHERE age IS NOT NULL GROUP BY 1 HAVING sum(age) <> 0")
def weighted_by_vertices_on_neighbors(spark, d):
    out = A.aggregate_on_neighbours(people(spark, d), "outgoing edges", [("age", "weighted_average")], "age", "")
    return out.select("id", r("age_weighted_average_by_age", 6).alias("average")).where("average is not null")


for _way, _rows in {
    "in_neighbors": "SELECT dst AS id, src AS o, min((eid, weight)).weight AS w FROM (SELECT * FROM e) GROUP BY 1, 2",
    "out_neighbors": "SELECT src AS id, dst AS o, min((eid, weight)).weight AS w FROM e GROUP BY 1, 2",
    "all_neighbors": "SELECT id, o, min((eid, weight)).weight AS w FROM (SELECT src AS id, dst AS o, eid, weight FROM e UNION ALL SELECT dst, src, eid, weight FROM e) GROUP BY 1, 2",
    "all_edges": "SELECT src AS id, dst AS o, weight AS w FROM e UNION ALL SELECT dst, src, weight FROM e",
}.items():
    _text = _rows.replace("min((eid, weight)).weight", "arg_min(weight, eid)")
    query(f"WITH {PEOPLE}, p AS ({_text}) SELECT p.id, round(sum(age * w), 4) AS total FROM p JOIN v ON v.id = p.o GROUP BY 1 HAVING count(age) > 0", f"weighted_by_edges_on_{_way}")(
        lambda spark, d, way=_way: A.aggregate_on_neighbours(people(spark, d), {"all_edges": "all edges", "all_neighbors": "all neighbors"}.get(way, way.replace("_", "-")), [("age", "weighted_sum")], "weight", "").select("id", r("age_weighted_sum_by_weight").alias("total")).where("total is not null")
    )


# Aggregators, filters, SQL functions


@query("WITH x AS (SELECT c_nationkey AS k, CASE WHEN c_custkey % 3 > 0 THEN c_mktsegment END AS s, CASE WHEN c_nationkey < 20 THEN c_custkey END AS n FROM customer), y AS (SELECT CASE WHEN k < 5 THEN k END AS k, s, n FROM x), c AS (SELECT k, s, count(s) AS m FROM y GROUP BY 1, 2), b AS (SELECT k, arg_max(s, (m, s)) FILTER (m > 0) AS common, CAST(nullif(count(s), 0) AS DOUBLE) AS kinds FROM c GROUP BY 1), a AS (SELECT k, CAST(sum(n) AS BIGINT) AS total FROM y GROUP BY 1) SELECT a.k, total, common, kinds FROM a JOIN b ON a.k IS NOT DISTINCT FROM b.k")
def aggregate_by_a_nullable_key(spark, d):
    y = table(spark, d, "customer").select(F.expr("if(c_nationkey < 5, c_nationkey, null)").alias("k"), F.expr("if(c_custkey % 3 > 0, c_mktsegment, null)").alias("s"), F.expr("if(c_nationkey < 20, c_custkey, null)").alias("n"))
    return aggregate(y, ["k"], [("n", "sum"), ("s", "most_common"), ("s", "count_distinct")]).select("k", F.col("n_sum").alias("total"), F.col("s_most_common").alias("common"), F.col("s_count_distinct").alias("kinds"))


@query("SELECT label, list(a ORDER BY i) AS lows, list(b ORDER BY i) AS highs, list(c ORDER BY i) AS sums, list(s ORDER BY i) AS deviations FROM (SELECT label, i, round(min(embedding[i]), 4) AS a, round(max(embedding[i]), 4) AS b, round(sum(embedding[i]), 3) AS c, round(coalesce(stddev_samp(embedding[i]), 0), 4) AS s FROM embeddings, range(1, 65) t(i) WHERE i <= len(embedding) GROUP BY 1, 2) GROUP BY 1")
def aggregate_vectors_elementwise_all(spark, d):
    df = table(spark, d, "embeddings").select("label", F.col("embedding").cast("array<double>").alias("e"))
    out = aggregate(df, ["label"], [("e", f"elementwise_{a}") for a in ("min", "max", "sum", "std_deviation")])
    rounded = lambda c, n, to: F.transform(c, lambda x: F.round(x, n)).alias(to)
    return out.select("label", rounded("e_elementwise_min", 4, "lows"), rounded("e_elementwise_max", 4, "highs"), rounded("e_elementwise_sum", 3, "sums"), rounded("e_elementwise_std_deviation", 4, "deviations"))


@query("SELECT label, CAST(sum(len(embedding)) AS BIGINT) AS numbers, count(*) AS n FROM embeddings GROUP BY 1")
def aggregate_concatenated_vectors(spark, d):
    out = aggregate(table(spark, d, "embeddings"), ["label"], [("embedding", "concatenate"), ("vec_id", "vector")])
    return out.select("label", F.size("embedding_concatenate").cast("bigint").alias("numbers"), F.size("vec_id_vector").cast("bigint").alias("n"))


@query("SELECT location, name FROM event_location WHERE position[1] >= 0 AND position[1] <= 60 AND position[2] > -20 AND position[2] < 60")
def filter_positional_box(spark, d):
    g = Graph(table(spark, d, "event_location").withColumn("id", F.col("location")))
    return B.filter_by_attributes(g, {"position": "[0,60],(-20,60)"}).vertices.select("location", "name")


@query("SELECT p_partkey, p_type FROM part WHERE p_type IN ('STANDARD BRUSHED TIN', 'PROMO PLATED STEEL') OR p_brand = 'Brand#11'")
def filter_quoted_text(spark, d):
    g = Graph(table(spark, d, "part").withColumn("id", F.col("p_partkey")))
    a = B.filter_by_attributes(g, {"p_type": '"STANDARD BRUSHED TIN","PROMO PLATED STEEL"'})
    b = B.filter_by_attributes(g, {"p_brand": '="Brand#11"'})
    return a.vertices.unionByName(b.vertices).select("p_partkey", "p_type").distinct()


@query("SELECT vec_id FROM embeddings WHERE len(list_filter(embedding, lambda x: x <= -0.6)) = 0")
def filter_vector_all(spark, d):
    g = Graph(table(spark, d, "embeddings").withColumn("id", F.col("vec_id")))
    return B.filter_by_attributes(g, {"embedding": "all(>-0.6)"}).vertices.select("vec_id")


@query("WITH c AS (SELECT c_nationkey, c_mktsegment, count(*) AS n FROM customer GROUP BY 1, 2), x AS (SELECT c_nationkey, arg_max(c_mktsegment, (n, c_mktsegment)) AS common FROM c GROUP BY 1) SELECT c_nationkey, common, upper(sha256(common || 'a (b')) AS hashed, list_filter(['BUILDING', common, 'BUILDING'], lambda y: y IN ('BUILDING', 'MACHINERY')) AS shared FROM x")
def sql_functions(spark, d):
    q = "with x as (select c_nationkey, most_common(c_mktsegment) common from input group by 1) select c_nationkey, common, hash(common, 'a (b') hashed, string_intersect(array('BUILDING', common, 'BUILDING'), array('BUILDING', 'MACHINERY')) shared from x"
    return V.sql(q, table(spark, d, "customer"))


@query("SELECT location, true AS near FROM event_location WHERE position IS NOT NULL")
def sql_geodistance(spark, d):
    """The SQL form, the Column form and the great circle agree (to 0.6 %) for every place and a fixed one."""
    from ..functions.sql_functions import geodistance

    df = table(spark, d, "event_location").where("position is not null").select("location", F.col("position")[0].alias("lat"), F.col("position")[1].alias("lon"))
    out = V.sql("select location, lat, lon, geodistance(lat, lon, 47.5D, 19.0D) as metres from input", df)
    column = geodistance("lat", "lon", F.lit(47.5), F.lit(19.0))
    circle = 2 * 6371008.8 * F.asin(F.sqrt(F.sin(F.radians(F.col("lat") - 47.5) / 2) ** 2 + F.cos(F.radians("lat")) * F.cos(F.radians(F.lit(47.5))) * F.sin(F.radians(F.col("lon") - 19.0) / 2) ** 2))
    return out.select("location", ((F.abs(F.col("metres") - column) < 1e-6 * (1 + column)) & (F.abs(F.col("metres") - circle) <= 0.006 * circle)).alias("near"))


# Structure and plumbing


@query(f"WITH {PEOPLE}, k AS (SELECT src, dst, count(*) AS n FROM e GROUP BY 1, 2) SELECT a.src, a.dst, CAST(least(a.n, b.n) AS BIGINT) AS copies FROM k a JOIN k b ON a.src = b.dst AND a.dst = b.src")
def make_edges_symmetric(spark, d):
    return T.make_symmetric(people(spark, d)).edges.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("copies"))


@query(f"WITH {TRADE} SELECT p.src, q.dst, count(*) AS n FROM e p JOIN e q ON p.dst = q.src GROUP BY 1, 2")
def concatenate_bundles_multi(spark, d):
    e = trade(spark, d).edges.select("src", "dst")
    return T.concatenate_multi(e, e).groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {TRADE} SELECT a.region AS src, b.region AS dst, count(*) AS n FROM e JOIN v a ON src = a.id JOIN v b ON dst = b.id WHERE a.region < 4 AND b.region > 0 GROUP BY 1, 2")
def induced_edge_bundle(spark, d):
    g = trade(spark, d)
    m = g.vertices.select("id", F.col("region").alias("new"))
    return T.induced_edges(g.edges, m.where("new < 4"), m.where("new > 0")).groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {PEOPLE} SELECT id, CAST(0 AS BIGINT) AS none FROM v WHERE age > 30 AND name IS NOT NULL")
def vertex_set_intersection(spark, d):
    g = people(spark, d)
    both = T.intersection(g.vertices.where("age > 30"), g.vertices.where("name is not null"))
    loops = T.loop_edges(both)
    return loops.where("src = dst and eid = src").select(F.col("src").alias("id"), F.lit(T.empty_edges(g).count()).cast("bigint").alias("none"))


@query("SELECT name, count(*) AS n, CAST(sum(k) AS BIGINT) AS ends FROM (SELECT s_name AS name, 3 AS k FROM supplier UNION ALL SELECT s_name, 3 FROM supplier) GROUP BY 1")
def union_of_graphs_with_hashed_ids(spark, d):
    links = table(spark, d, "supplier").select("s_name", F.lit("hub").alias("hub"), F.concat("s_name", F.lit("-end")).alias("end"))
    g = B.use_table_as_graph(links.select("s_name", F.col("hub").alias("t")).unionByName(links.select("s_name", F.col("end").alias("t"))).unionByName(links.select("s_name", F.lit("x").alias("t"))), "s_name", "t")
    u = T.union(g, g)
    assert u.vertices.select("id").distinct().count() == u.vertices.count()
    per = u.vertices.join(u.edges.groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("k")), "id")
    return per.groupBy(F.col("stringId").alias("name")).agg(F.count(F.lit(1)).alias("n"), F.sum("k").alias("ends"))


@query(f"WITH {PEOPLE} SELECT v.id, v.name AS own, t.name AS target, CAST(trunc(t.age) AS BIGINT) AS years FROM v JOIN v t ON t.id = v.id - v.id % 10")
def pulled_over_attributes(spark, d):
    g = A.copy_attribute(people(spark, d), "vertices", "age", "years")
    function = g.vertices.select("id", (F.col("id") - F.col("id") % 10).alias("target"))
    values = P.to_long(A.rename_attributes(g, "vertices", {"name": "target_name"}), "vertices", "years").vertices.select("id", "target_name", "years")
    return P.pulled_over(function, values).join(g.vertices.select("id", F.col("name").alias("own")), "id").select("id", "own", F.col("target_name").alias("target"), "years")


@query(f"WITH {PEOPLE} SELECT eid, src AS a, dst AS b FROM e")
def edge_bundle_as_attribute(spark, d):
    return P.ends_as_attribute(people(spark, d)).edges.select("eid", F.col("ends.src").alias("a"), F.col("ends.dst").alias("b"))


@query(f"WITH {PEOPLE} SELECT id, name AS first, age AS second FROM v WHERE name IS NOT NULL AND age IS NOT NULL")
def join_two_attributes(spark, d):
    v = P.join_attributes(people(spark, d), "vertices", "both", "name", "age").vertices
    return v.where("both is not null").select("id", F.col("both.first").alias("first"), F.col("both.second").alias("second"))


@query(f"WITH {PEOPLE} SELECT id, name FROM v WHERE id IN (1, 2, 3, 50, 70) AND name IS NOT NULL")
def restrict_attribute_to_ids(spark, d):
    g = people(spark, d)
    ids = [1, 2, 3, 50, 70]
    rows = P.restrict_to_ids(g, "vertices", "name", ids)
    assert P.collect_attribute(g, "vertices", "name", ids) == {x.id: x.name for x in rows.collect()}
    return rows


@query(f"WITH {PEOPLE}, x AS (SELECT src AS id, eid, dst AS o FROM e UNION ALL SELECT dst, eid, src FROM e) SELECT id, list(eid ORDER BY eid) AS edges, list(DISTINCT o ORDER BY o) AS neighbours FROM x GROUP BY 1")
def edge_and_neighbor_mapping(spark, d):
    return W.incident_edges(people(spark, d))


@query(f"WITH {PEOPLE}, n1 AS (SELECT 50 AS id UNION SELECT b FROM nb WHERE a = 50), n2 AS (SELECT id FROM n1 UNION SELECT b FROM nb WHERE a IN (SELECT id FROM n1)) SELECT eid FROM e WHERE src IN (SELECT id FROM n2) AND dst IN (SELECT id FROM n2)")
def vertex_neighborhood(spark, d):
    return W.neighbourhood(people(spark, d), [50], 2).edges.select("eid")


@query("SELECT 40 AS n, 40 AS different")
def sample_of_vertices(spark, d):
    return W.sample_vertices(people(spark, d), 40).agg(F.count(F.lit(1)).cast("int").alias("n"), F.count_distinct("id").cast("int").alias("different"))


@query(f"WITH {TRADE} SELECT CAST(region AS VARCHAR) AS x, CASE WHEN id < 12 THEN 'low' ELSE 'high' END AS y, count(*) AS count FROM v GROUP BY 1, 2")
def vertex_bucket_grid(spark, d):
    g = A.derive(A.to_text(trade(spark, d), "vertices", "region"), "vertices", "half", "if(id < 12, 'low', 'high')", False)
    return W.bucketed_view(g, "region", "half")[0]


@query(f"WITH {PEOPLE}, {_AGES} SELECT (SELECT count(*) FROM b) AS vertices, (SELECT count(*) FROM e JOIN b p ON src = p.id JOIN b q ON dst = q.id AND p.bottom = q.bottom) AS edges")
def coverage_of_a_segmentation(spark, d):
    return M.coverage(S.by_number(people(spark, d), "age", 10), "bucketing")


@query("WITH m AS (SELECT DISTINCT l_orderkey AS vid, p_brand AS brand FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey) SELECT a.brand AS src, b.brand AS dst, count(*) AS n FROM m a JOIN m b ON a.vid = b.vid AND a.brand < b.brand GROUP BY 1, 2 HAVING count(*) >= 5")
def uniform_overlap_links(spark, d):
    from .graph_queries import _brands

    g = _brands(spark, d)
    names = g.segmentation("brands").graph.vertices
    e = P.uniform_overlap_links(g, "brands", 5)
    e = e.join(names.select(F.col("id").alias("src"), F.col("brand").alias("x")), "src").join(names.select(F.col("id").alias("dst"), F.col("brand").alias("y")), "dst")
    return e.select(F.least("x", "y").alias("src"), F.greatest("x", "y").alias("dst"), "n")


@query(f"WITH {PEOPLE}, x AS (SELECT age AS s, CAST(CASE WHEN id % 3 = 0 THEN 1 ELSE 0 END AS DOUBLE) AS y FROM v WHERE age IS NOT NULL), g AS (SELECT s, sum(y) AS p, sum(1 - y) AS n FROM x GROUP BY 1) SELECT s AS threshold, round(sum(n) OVER (ORDER BY s DESC) / (SELECT sum(n) FROM g), 8) AS fpr, round(sum(p) OVER (ORDER BY s DESC) / (SELECT sum(p) FROM g), 8) AS tpr FROM g")
def roc_curve(spark, d):
    g = A.derive(people(spark, d), "vertices", "y", "if(id % 3 = 0, 1.0D, 0.0D)", False)
    return P.roc_curve(g, "y", "age").select("threshold", r("fpr", 8).alias("fpr"), r("tpr", 8).alias("tpr"))


# Algorithms


@query(f"""WITH RECURSIVE {PEOPLE}, m AS (SELECT DISTINCT a.src AS a, a.dst AS b FROM e a JOIN e b ON a.src = b.dst AND a.dst = b.src WHERE a.src <> a.dst),
cc(id, g) USING KEY (id) AS (SELECT id, id FROM v UNION SELECT m.b, min(cc.g) FROM cc JOIN m ON m.a = cc.id JOIN recurring.cc AS old ON old.id = m.b WHERE cc.g < old.g GROUP BY m.b)
SELECT id, g AS component FROM cc""")
def connected_components_of_mutual_links(spark, d):
    return I.connected_components(people(spark, d), "require both directions")


@query(f"""WITH RECURSIVE {PEOPLE}, core(v, k) USING KEY (v) AS (SELECT a, count(*) FROM nb GROUP BY 1 UNION
SELECT x.a, max(least(x.k, x.n)) FROM (SELECT nb.a, r.k, row_number() OVER (PARTITION BY nb.a ORDER BY r.k DESC) AS n FROM nb JOIN recurring.core r ON r.v = nb.b WHERE nb.a IN (SELECT t.a FROM core c JOIN nb t ON t.b = c.v)) x
  JOIN recurring.core o ON o.v = x.a GROUP BY x.a, o.k HAVING max(least(x.k, x.n)) < o.k)
SELECT v.id, CAST(coalesce(k, 0) AS DOUBLE) AS core FROM v LEFT JOIN core ON core.v = v.id""")
def k_core_numbers(spark, d):
    return I.k_core(people(spark, d))


_HOPS = f"WITH RECURSIVE {TRADE}, h(s, t, d) USING KEY (s, t) AS (SELECT id, id, 0 FROM v UNION SELECT h.s, nb.b, h.d + 1 FROM h JOIN nb ON nb.a = h.t LEFT JOIN recurring.h AS old ON old.s = h.s AND old.t = nb.b WHERE old.d IS NULL)"


@query(_HOPS + ", c AS (SELECT d, count(*) AS n FROM h GROUP BY 1), r AS (SELECT d, sum(n) OVER (ORDER BY d) AS n FROM c) SELECT CAST((SELECT max(d) FROM h) AS BIGINT) AS low, CAST((SELECT max(d) FROM h) AS BIGINT) AS high, CAST((SELECT min(d) FROM r WHERE n >= 0.9 * (SELECT max(n) FROM r)) AS DOUBLE) AS effective")
def diameter_exact(spark, d):
    low, high = I.diameter(trade(spark, d))
    return spark.createDataFrame([(low, high, I.effective_diameter(trade(spark, d)))], "low bigint, high bigint, effective double")


@query(_HOPS + """, w AS (SELECT s, t, d, CASE WHEN d = 0 THEN 1 END AS p FROM h),
p1 AS (SELECT h.s, h.t, count(*) AS p FROM h JOIN nb ON nb.b = h.t JOIN h g ON g.s = h.s AND g.t = nb.a WHERE h.d = 1 AND g.d = 0 GROUP BY 1, 2),
p2 AS (SELECT h.s, h.t, sum(p1.p) AS p FROM h JOIN nb ON nb.b = h.t JOIN p1 ON p1.s = h.s AND p1.t = nb.a WHERE h.d = 2 GROUP BY 1, 2),
p3 AS (SELECT h.s, h.t, sum(p2.p) AS p FROM h JOIN nb ON nb.b = h.t JOIN p2 ON p2.s = h.s AND p2.t = nb.a WHERE h.d = 3 GROUP BY 1, 2),
p4 AS (SELECT h.s, h.t, sum(p3.p) AS p FROM h JOIN nb ON nb.b = h.t JOIN p3 ON p3.s = h.s AND p3.t = nb.a WHERE h.d = 4 GROUP BY 1, 2),
p AS (SELECT id AS s, id AS t, 0 AS d, 1 AS p FROM v UNION ALL SELECT s, t, 1, p FROM p1 UNION ALL SELECT s, t, 2, p FROM p2 UNION ALL SELECT s, t, 3, p FROM p3 UNION ALL SELECT s, t, 4, p FROM p4),
b AS (SELECT x.t AS id, sum(x.p * y.p / CAST(z.p AS DOUBLE)) / 2 AS b FROM p x JOIN p y ON y.s = x.t JOIN p z ON z.s = x.s AND z.t = y.t WHERE x.s <> x.t AND y.s <> y.t AND x.s <> y.t AND x.d + y.d = z.d GROUP BY 1)
SELECT v.id, round(coalesce(b, 0), 5) AS centrality FROM v LEFT JOIN b ON b.id = v.id""")
def betweenness_exact(spark, d):
    return I.betweenness(trade(spark, d)).select("id", r("centrality", 5).alias("centrality"))


@query(f"""WITH RECURSIVE {TRADE}, h(s, t, d) USING KEY (s, t) AS (SELECT id, id, 0 FROM v UNION SELECT h.s, e.dst, h.d + 1 FROM h JOIN e ON e.src = h.t LEFT JOIN recurring.h AS old ON old.s = h.s AND old.t = e.dst WHERE old.d IS NULL),
c AS (SELECT s AS id, count(*) AS k, sum(d) AS far, sum(1.0 / d) AS h FROM h WHERE d > 0 GROUP BY 1), n AS (SELECT count(*) AS n FROM v)
SELECT v.id, round(coalesce((k / (n - 1.0)) * (k / CAST(far AS DOUBLE)), 0), 6) AS closeness, round(coalesce(h / (n - 1.0), 0), 6) AS harmonic FROM n, v LEFT JOIN c ON c.id = v.id""")
def closeness_exact(spark, d):
    g = trade(spark, d)
    return I.closeness(g).join(I.closeness(g, harmonic=True, name="harmonic"), "id").select("id", r("centrality", 6).alias("closeness"), r("harmonic", 6).alias("harmonic"))


@query(f"""WITH RECURSIVE {PEOPLE}, q(m, last) AS (SELECT [a, b], b FROM nb WHERE a < b UNION ALL SELECT list_append(q.m, nb.b), nb.b FROM q JOIN nb ON nb.a = q.last AND nb.b > q.last WHERE NOT EXISTS (SELECT 1 FROM (SELECT unnest(q.m) AS x) u WHERE NOT EXISTS (SELECT 1 FROM nb n2 WHERE n2.a = u.x AND n2.b = nb.b))),
k AS (SELECT m, len(m) AS n FROM q WHERE len(m) >= 3),
x AS (SELECT m, w, count(*) AS c FROM (SELECT m, unnest(m) AS y FROM k) z JOIN (SELECT a, b AS w FROM nb) o ON o.a = z.y GROUP BY 1, 2)
SELECT n AS size, count(*) AS n FROM k WHERE NOT EXISTS (SELECT 1 FROM x WHERE x.m = k.m AND x.c = k.n) GROUP BY 1""")
def maximal_cliques_by_size(spark, d):
    return C.maximal_cliques(people(spark, d).edges).groupBy(F.size("members").cast("bigint").alias("size")).agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH RECURSIVE {PEOPLE}, b AS (SELECT id, floor(age / 10) AS s FROM v WHERE age IS NOT NULL), l AS (SELECT nb.a, nb.b FROM nb JOIN b p ON p.id = nb.a JOIN b q ON q.id = nb.b AND p.s = q.s),
cc(id, g) USING KEY (id) AS (SELECT id, id FROM b UNION SELECT l.b, min(cc.g) FROM cc JOIN l ON l.a = cc.id JOIN recurring.cc AS old ON old.id = l.b WHERE cc.g < old.g GROUP BY l.b),
z AS (SELECT s, g, count(*) AS n FROM cc JOIN b ON b.id = cc.id GROUP BY 1, 2)
SELECT CAST(s * 10 AS DOUBLE) AS bottom, round(1 - max(n) / CAST(sum(n) AS DOUBLE), 6) AS fragmentation FROM z GROUP BY 1""")
def segment_fragmentation_by_age(spark, d):
    g = S.by_number(people(spark, d), "age", 10)
    return M.fragmentation(g, "bucketing").join(g.segmentation("bucketing").graph.vertices.select("id", "bottom"), "id").select("bottom", r("fragmentation", 6).alias("fragmentation"))


@query(f"""WITH {PEOPLE}, a AS (SELECT id, count(o) AS v FROM v LEFT JOIN (SELECT src AS i, dst AS o FROM e UNION ALL SELECT dst, src FROM e) ON i = id GROUP BY 1), i AS (SELECT id, count(eid) AS v FROM v LEFT JOIN e ON dst = id GROUP BY 1), o AS (SELECT id, count(eid) AS v FROM v LEFT JOIN e ON src = id GROUP BY 1),
x AS (SELECT 'degree' AS metric, v FROM a UNION ALL SELECT 'in_degree', v FROM i UNION ALL SELECT 'out_degree', v FROM o)
SELECT metric, CAST(sum(v) AS DOUBLE) AS sum, round(avg(v), 6) AS average, CAST(min(v) AS DOUBLE) AS min, CAST(max(v) AS DOUBLE) AS max, quantile_cont(v, 0.25) AS p25, quantile_cont(v, 0.5) AS p50, quantile_cont(v, 0.75) AS p75 FROM x GROUP BY 1""")
def graph_metrics_of_degrees(spark, d):
    return W.graph_metrics(people(spark, d)).where("metric like '%degree'").withColumn("average", r("average", 6))


@query(f"""WITH {PEOPLE}, p AS (SELECT id, 1 + (id % 17) / 4.0 AS r, (id % 63) / 10.0 AS t FROM v), top AS (SELECT max(r) AS m FROM p)
SELECT eid, round(1 / (1 + exp((greatest(0, a.r + b.r + 2 * ln(greatest(pi() - abs(pi() - abs(a.t - b.t)), 1e-12) / 2)) - m) / 0.9)), 8) AS p FROM top, e JOIN p a ON src = a.id JOIN p b ON dst = b.id""")
def hyperbolic_probability_of_positions(spark, d):
    g = A.derive(A.derive(people(spark, d), "vertices", "radial", "1 + (id % 17) / 4.0D", False), "vertices", "angular", "(id % 63) / 10.0D", False)
    return N.hyperbolic_probability(g, name="p").select("eid", r("p", 8).alias("p"))


@query(f"WITH {PEOPLE} SELECT true AS close, true AS embedded, count(*) AS n FROM v")
def sketched_metrics_are_close(spark, d):
    """HLL sketches of 12 bits (standard error 1.6 %): clustering coefficients and embeddedness near the exact ones."""
    g = people(spark, d)
    a = M.clustering_coefficient(g, "x").join(M.approximate_clustering_coefficient(g, name="y"), "id")
    b = M.embeddedness(g, "x").join(M.approximate_embeddedness(g, name="y"), "eid").where("x is not null")
    near = b.agg((F.avg(F.abs(F.col("x") - F.col("y"))) <= 2.0).alias("embedded"))
    return a.agg((F.avg(F.abs(F.col("x") - F.col("y"))) < 0.1).alias("close"), F.count(F.lit(1)).alias("n")).withColumn("embedded", F.lit(near.first()[0]))


@query(f"WITH RECURSIVE {PEOPLE}, cc(id, g) USING KEY (id) AS (SELECT id, id FROM v UNION SELECT nb.b, min(cc.g) FROM cc JOIN nb ON nb.a = cc.id JOIN recurring.cc AS old ON old.id = nb.b WHERE cc.g < old.g GROUP BY nb.b) SELECT id, g AS component, true AS lightest FROM cc")
def spanning_tree_spans_and_is_light(spark, d):
    """The chosen edges alone connect what the graph connects, and no edge left out is lighter than the heaviest edge of the same component's tree was when chosen: weights as of Kruskal's count."""
    g = people(spark, d)
    tree = I.spanning_tree(g, "weight")
    chosen = g.with_edges(g.edges.join(tree.select("eid"), "eid", "left_semi"))
    # by weight limit: the edges up to w of the tree connect exactly what all edges up to w connect
    light = True
    for w in range(1, 8):
        some = lambda x, w=w: I.connected_components(x.with_edges(x.edges.where(F.col("weight") <= w)))
        light = light and some(chosen).exceptAll(some(g)).limit(1).count() == 0
    return I.connected_components(chosen).withColumn("lightest", F.lit(light))


@query(f"WITH {PEOPLE} SELECT count(*) AS coloured, true AS proper FROM v")
def coloring_is_proper(spark, d):
    g = people(spark, d)
    c = I.coloring(g)
    e = g.edges.where("src <> dst").join(c.withColumnsRenamed({"id": "src", "color": "a"}), "src").join(c.withColumnsRenamed({"id": "dst", "color": "b"}), "dst")
    return c.where("color >= 1").agg(F.count_distinct("id").alias("coloured")).withColumn("proper", F.lit(e.where("a = b").limit(1).count() == 0))


@query(f"WITH {PEOPLE} SELECT (SELECT count(*) FROM v) AS propagated, (SELECT count(*) FROM nation) AS louvain, (SELECT count(*) FROM nation) AS modular, true AS better")
def communities_hold_every_vertex_once(spark, d):
    t = trade(spark, d)
    members = lambda g, n: g.segmentation(n).membership.agg(F.count_distinct("vid"), F.count(F.lit(1))).first()
    a, b = C.find_label_communities(people(spark, d)), C.find_louvain_communities(t, "weight")
    c = C.find_modular_clustering(t, "weight")
    counts = [members(a, "communities"), members(b, "communities"), members(c, "modular_clusters")]
    one = M.modularity(S.from_labels(t, "one", t.vertices.select("id", F.lit(0).cast("bigint").alias("label"))), "one", "weight").first()[0]
    better = c.scalars["modularity"] >= one - 1e-9 and all(x[0] == x[1] for x in counts)
    return spark.createDataFrame([(*(x[1] for x in counts), better)], "propagated bigint, louvain bigint, modular bigint, better boolean")


@query("SELECT true AS none_missing, true AS in_ratio FROM (SELECT count(*) FROM part)")
def train_and_test_sets_in_ratio(spark, d):
    g = Graph(table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_retailprice").alias("price")))
    v = L.split_train_test(g, "price", 0.2, 1).vertices
    n = F.count(F.lit(1))
    return v.agg((F.count_if(F.col("price_test").isNull() == F.col("price_train").isNull()) == 0).alias("none_missing"), (F.abs(F.count("price_test") / n - 0.2) < 5 * F.sqrt(0.16 / n)).alias("in_ratio"))


@query("SELECT p_partkey AS id, true AS same FROM part")
def models_as_sql(spark, d):
    """The SQL text of a linear model, a tree, a logistic model and clusters gives what they predict."""
    g = Graph(table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_size").cast("double").alias("size"), F.col("p_retailprice").cast("double").alias("price")))
    g = A.derive(A.derive(g, "vertices", "big", "if(size > 25, 1.0D, 0.0D)"), "vertices", "kind", "if(size > 25, 'big', 'small')")
    made = {
        "a": (L.train_linear_regression(g, "price", ["size"]), L.predict), "b": (L.train_decision_tree_regressor(g, "price", ["size"]), L.predict), "c": (L.train_decision_tree_classifier(g, "kind", ["size", "price"]), L.classify),
        "d": (L.train_logistic_regression(g, "big", ["size"]), L.classify), "e": (L.train_kmeans(g, ["size", "price"], 3, seed=1), L.classify),
    }
    out = g.vertices.select("id", *(F.expr(L.model_sql(m)).alias(f"sql_{k}") for k, (m, _) in made.items()))
    same = F.lit(True)
    for k, (m, use) in made.items():
        out = out.join(use(g, m, k).select("id", k), "id")
        same &= F.abs(F.col(k) - F.col(f"sql_{k}")) < 1e-6 if k in "ab" else F.col(k) == F.col(f"sql_{k}")
    return out.select("id", same.alias("same"))


_GENERATED = {
    "erdos_renyi": lambda s: N.erdos_renyi(s, 2000, 0.01, 1), "clustered_random": lambda s: N.clustered_random(s, 1000, 10, 0.2, 0.001, 1), "barabasi_albert": lambda s: N.barabasi_albert(s, 1000, 2, 2, 1),
    "dorogovtsev_mendes": lambda s: N.dorogovtsev_mendes(s, 1000, 1), "with_degrees": lambda s: N.with_degrees(s, 500, (1, 2, 3, 4), "Edge switching", 1), "lfr": lambda s: N.lfr(s, 1000, seed=1),
    "mocnik": lambda s: N.mocnik(s, 1000, seed=1), "p2p": lambda s: N.p2p(s, 1000, radius=0.05, seed=1), "hyperbolic_random": lambda s: N.hyperbolic_random(s, 1000, seed=1),
}


@query("SELECT * FROM (VALUES " + ", ".join(f"('{k}', true, true, true, true)" for k in _GENERATED) + ") t(model, no_loops, no_repeats, in_range, edges_as_expected)")
def random_graphs_keep_their_model(spark, d):
    """Edges of the models: exact numbers where the model fixes them, else within five standard deviations of the expectation, or bounded by the model."""
    pairs = 2000 * 1999 / 2
    inner, outer = 10 * 100 * 99 / 2 * 0.2, (1000 * 999 / 2 - 10 * 100 * 99 / 2) * 0.001
    bounds = {
        "erdos_renyi": (pairs * 0.01 - 5 * (pairs * 0.0099) ** 0.5, pairs * 0.01 + 5 * (pairs * 0.0099) ** 0.5), "clustered_random": (inner + outer - 5 * (inner + outer) ** 0.5, inner + outer + 5 * (inner + outer) ** 0.5),
        "barabasi_albert": (1 + 998 * 2, 1 + 998 * 2), "dorogovtsev_mendes": (3 + 997 * 2, 3 + 997 * 2), "with_degrees": (625, 625), "lfr": (500, 10 * 500), "mocnik": (1000, 1000 * 100), "p2p": (1, 1000 * 10), "hyperbolic_random": (500, 1000 * 20),
    }
    sizes = {"erdos_renyi": 2000, "with_degrees": 500}
    rows = []
    for name, make in _GENERATED.items():
        n, loops, distinct, low, high = make(spark).edges.agg(F.count(F.lit(1)), F.count_if(F.col("src") == F.col("dst")), F.count_distinct("src", "dst"), F.min(F.least("src", "dst")), F.max(F.greatest("src", "dst"))).first()
        a, b = bounds[name]
        rows.append((name, loops == 0, distinct == n, low >= 0 and high < sizes.get(name, 1000), a <= n <= b))
    return spark.createDataFrame(rows, "model string, no_loops boolean, no_repeats boolean, in_range boolean, edges_as_expected boolean")


@query(f"WITH {PEOPLE} SELECT true AS known_ends, true AS about_four, true AS growing FROM (SELECT count(*) FROM v)")
def random_edges_keep_their_model(spark, d):
    g = people(spark, d)
    n = P.count_vertices(g)
    e = N.random_edges(g, 4.0, 1)
    k = P.count_edges(e)
    ends = T.induced_edges(e.edges, g.vertices.select("id", F.col("id").alias("new")), g.vertices.select("id", F.col("id").alias("new"))).count()
    grown = P.count_edges(N.scale_free_edges(g, 4, 1.3, 1)) / (n * 1.3**4)
    return spark.createDataFrame([(ends == k, abs(k / n - 4) < 5 * (16 / 3 / n) ** 0.5 + 0.1, 0.8 < grown < 1.25)], "known_ends boolean, about_four boolean, growing boolean")


# The linear ones of those that otherwise run on the 25 nations, on the people


def _ages(spark, d):
    return S.by_number(people(spark, d), "age", 10)


_PAIRS = f"WITH {PEOPLE}, {_AGES}, lab AS (SELECT weight AS w, p.bottom AS s, q.bottom AS t FROM e LEFT JOIN b p ON p.id = src LEFT JOIN b q ON q.id = dst)"


@query(_PAIRS + """, x AS (SELECT sum(w) AS total FROM lab), o AS (SELECT s AS r, sum(w) AS o FROM lab WHERE s IS NOT NULL GROUP BY 1), i AS (SELECT t AS r, sum(w) AS i FROM lab WHERE t IS NOT NULL GROUP BY 1), b2 AS (SELECT s AS r, sum(w) AS b FROM lab WHERE s = t GROUP BY 1)
SELECT round(sum(coalesce(b, 0) / total - coalesce(i, 0) * coalesce(o, 0) / (total * total)), 8) AS modularity, (SELECT round(sum(w) FILTER (s = t) / sum(w), 8) FROM lab) AS coverage, (SELECT sum(w) FILTER (coalesce(s <> t, true)) FROM lab) AS edge_cut
FROM x, o FULL JOIN i ON o.r = i.r LEFT JOIN b2 ON b2.r = coalesce(o.r, i.r)""")
def modularity_and_cut_of_ages(spark, d):
    g = _ages(spark, d)
    both = M.modularity(g, "bucketing", "weight").select(r("modularity", 8).alias("modularity")).withColumn("k", F.lit(1))
    return both.join(M.segmentation_scalars(g, "bucketing", "weight").select(r("coverage", 8).alias("coverage"), "edge_cut", F.lit(1).alias("k")), "k").drop("k")


@query(_PAIRS + """, z AS (SELECT bottom, count(*) AS n FROM b GROUP BY 1), f AS (SELECT w, s AS bottom, coalesce(s = t, false) AS inside, true AS lead FROM lab UNION ALL SELECT w, t, coalesce(s = t, false), false FROM lab),
a AS (SELECT bottom, count(*) FILTER (inside AND lead) AS k, coalesce(sum(w) FILTER (NOT inside), 0) AS cut, sum(w) AS vol FROM f WHERE bottom IS NOT NULL GROUP BY 1),
h AS (SELECT x.bottom, nb.a, count(*) FILTER (y.bottom = x.bottom) AS k_in, count(*) FILTER (coalesce(y.bottom <> x.bottom, true)) AS k_out FROM nb JOIN b x ON x.id = nb.a LEFT JOIN b y ON y.id = nb.b GROUP BY 1, 2),
g AS (SELECT bottom, max(k_in) AS hub, count(*) FILTER (k_in > k_out) AS stable FROM h GROUP BY 1)
SELECT z.bottom, CAST(n AS DOUBLE) AS size, round(k / (n * (n - 1) / 2.0), 8) AS density, round(cut / least(vol, 2 * (SELECT sum(w) FROM lab) - vol), 6) AS conductance, CAST(cut AS DOUBLE) AS expansion, round(hub / (n - 1.0), 8) AS hub_dominance, round(stable / CAST(n AS DOUBLE), 6) AS stability FROM z JOIN a ON a.bottom = z.bottom JOIN g ON g.bottom = z.bottom WHERE n > 1""")
def segment_metrics_of_ages(spark, d):
    g = _ages(spark, d)
    out = M.segment_metrics(g, "bucketing", "weight").join(g.segmentation("bucketing").graph.vertices.select("id", "bottom"), "id")
    return out.where("size > 1").select("bottom", "size", r("density", 8).alias("density"), r("conductance", 6).alias("conductance"), "expansion", r("hub_dominance", 8).alias("hub_dominance"), r("stability", 6).alias("stability"))


@query(f"""WITH {PEOPLE}, t AS (SELECT x.a AS u, x.b AS v, y.b AS c FROM nb x JOIN nb y ON y.a = x.a JOIN nb z ON z.a = x.b AND z.b = y.b),
p AS (SELECT s.u, s.v, s.c AS a, q.c AS b FROM t s JOIN t q ON s.u = q.u AND s.v = q.v AND s.c < q.c),
k AS (SELECT u, v, count(*) AS k FROM p WHERE NOT EXISTS (SELECT 1 FROM nb WHERE nb.a = p.a AND nb.b = p.b)
  AND NOT EXISTS (SELECT 1 FROM t f JOIN t g ON f.u = g.u AND f.c = g.c WHERE f.u = p.u AND f.v = p.a AND g.v = p.b AND f.c <> p.v) GROUP BY 1, 2)
SELECT eid, CAST(coalesce(k, 0) AS DOUBLE) AS dispersion FROM e LEFT JOIN k ON k.u = src AND k.v = dst WHERE src <> dst""")
def dispersion_of_people(spark, d):
    return M.dispersion(people(spark, d)).select("eid", "dispersion")


@query(f"WITH {PEOPLE} SELECT (SELECT count(*) FROM v) AS members, true AS better, true AS modular FROM (SELECT count(*) FROM e)")
def communities_of_people(spark, d):
    """Louvain's communities and modular clusters of all people hold every vertex once, with a modularity that chance groups do not have."""
    g = people(spark, d)
    found = C.find_louvain_communities(g, "weight")
    clusters = C.find_modular_clustering(g, "weight")
    n, m = found.segmentation("communities").membership.agg(F.count_distinct("vid"), F.count(F.lit(1))).first()
    return spark.createDataFrame([(n if n == m else -1, M.modularity(found, "communities", "weight").first()[0] > 0.2, clusters.scalars["modularity"] > 0.2)], "members bigint, better boolean, modular boolean")


@query(f"WITH {PEOPLE} SELECT id, true AS placed FROM v")
def layout_of_people(spark, d):
    """Positions by the lengths of the edges, with 100 pivots."""
    from ..operators import matching as X

    return X.pivot_layout(people(spark, d), 2, 100, length="weight").select("id", ((F.size("position") == 2) & ~F.exists("position", F.isnan)).alias("placed"))


@query(f"WITH {PEOPLE} SELECT id, 128 AS numbers FROM v")
def embedding_of_people(spark, d):
    """Skip-grams over 10 walks of 20 steps from every vertex, 128 numbers, 5 iterations."""
    return L.embed_vertices(people(spark, d)).select("id", F.size("embedding").alias("numbers"))


_LENGTHS = "".join(f", d{k} AS (SELECT source, id, min(d) AS d FROM (SELECT source, id, d FROM d{k - 1} UNION ALL SELECT source, dst, d + weight FROM d{k - 1} JOIN e ON src = id UNION ALL SELECT source, src, d + weight FROM d{k - 1} JOIN e ON dst = id) GROUP BY 1, 2)" for k in range(1, 13))


@query(f"WITH {TRADE}, d0 AS (SELECT id AS source, id, 0.0::DOUBLE AS d FROM v WHERE id < 3){_LENGTHS} SELECT source, id, round(d, 4) AS d FROM d12")
def distances_by_edge_length(spark, d):
    """The nations are few, so that twelve rounds of the SQL reach the fixpoint."""
    g = trade(spark, d)
    return I.distances_by_length(g, "weight", g.vertices.where("id < 3")).select("source", "id", r("d").alias("d"))
