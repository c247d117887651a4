"""Queries over the operators on graphs and tables, with their SQL."""

from __future__ import annotations

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
from ..operators import matching as X
from ..operators import metrics as M
from ..operators import segment as S
from ..operators import structure as T
from ..operators import workflow as W
from ..plans import views as V
from ..sources import readers as R
from .common import table
from .graphs import PEOPLE, SALES, TRADE, people, sales, trade

QUERIES: dict[str, Callable] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    def add(f):
        QUERIES[name or f.__name__] = f
        if sql:
            SQL[name or f.__name__] = sql
        return f

    return add


def r(c, digits: int = 4):
    return F.round(F.col(c) if isinstance(c, str) else c, digits)


# Sources, and building graphs


@query("SELECT c_mktsegment, count(*) AS n, round(sum(c_acctbal), 2) AS balance FROM customer WHERE c_acctbal > 0 GROUP BY 1")
def import_parquet_with_schema(spark, d):
    schema = "c_custkey: long, c_name: string, c_nationkey: int, c_acctbal: double, c_mktsegment: string"
    return R.read_parquet(spark, f"{d}/customer.parquet", schema, imported_columns=["c_mktsegment", "c_acctbal"], sql="select c_mktsegment, count(*) n, round(sum(c_acctbal), 2) balance from this where c_acctbal > 0 group by 1")


@query("SELECT r_name AS name FROM region UNION ALL SELECT r_name FROM region")
def import_union_of_snapshots(spark, d):
    return R.read_union_of_snapshots(spark, [f"{d}/region.parquet"] * 2).select(F.col("r_name").alias("name"))


@query("SELECT s_suppkey AS id, s_name AS name, s_acctbal AS balance FROM supplier")
def use_table_as_vertices(spark, d):
    return B.use_table_as_vertices(table(spark, d, "supplier"), "s_suppkey").vertices.select("id", F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance"))


@query(f"WITH {SALES}, x AS (SELECT customer AS stringId FROM sales UNION ALL SELECT supplier FROM sales) SELECT stringId, CAST(count(*) AS DOUBLE) AS degree FROM x GROUP BY 1")
def use_table_as_graph(spark, d):
    g = B.use_table_as_graph(sales(spark, d), "customer", "supplier")
    return g.vertices.join(M.degree(g, "all edges"), "id").select("stringId", "degree")


@query("""SELECT c.c_name AS customer, s.s_name AS supplier FROM customer c JOIN supplier s ON c.c_custkey = s.s_suppkey""")
def use_table_as_edges(spark, d):
    c = table(spark, d, "customer").select(F.concat(F.lit("c"), F.col("c_custkey")).alias("key"), F.col("c_name").alias("name"), (F.col("c_custkey") * 2).alias("id"))
    s = table(spark, d, "supplier").select(F.concat(F.lit("s"), F.col("s_suppkey")).alias("key"), F.col("s_name").alias("name"), (F.col("s_suppkey") * 2 + 1).alias("id"))
    links = table(spark, d, "supplier").select(F.concat(F.lit("c"), F.col("s_suppkey")).alias("a"), F.concat(F.lit("s"), F.col("s_suppkey")).alias("b"), F.col("s_suppkey").alias("n"))
    g = B.use_table_as_edges(Graph(c.unionByName(s)), links, "key", "a", "b", "n")
    return V.triplets(g, {"src_name", "dst_name"}).select(F.col("src_name").alias("customer"), F.col("dst_name").alias("supplier"))


@query(f"WITH {TRADE} SELECT a.name AS src, b.name AS dst FROM v a JOIN v b ON a.region = b.region AND a.id <> b.id")
def connect_on_attribute(spark, d):
    g = B.connect_on_attribute(trade(spark, d), "region", "region")
    return V.triplets(g, {"src_name", "dst_name"}).select(F.col("src_name").alias("src"), F.col("dst_name").alias("dst"))


@query("SELECT CAST(x AS BIGINT) AS id, CAST(x AS DOUBLE) AS ordinal FROM range(1000) t(x)")
def create_vertices(spark, d):
    return B.create_vertices(spark, 1000).vertices


@query()
def create_example_graph(spark, d):
    return V.triplets(B.example_graph(spark))


def _summary(g: Graph):
    return g.edges.agg(F.count(F.lit(1)).alias("edges"), F.count_distinct("src", "dst").alias("pairs"), F.max("src").alias("last"))


for _name, _make in {
    "create_erdos_renyi_graph": lambda s: N.erdos_renyi(s, 2000, 0.01, 1),
    "create_clustered_random_graph": lambda s: N.clustered_random(s, 1000, 10, 0.2, 0.001, 1),
    "create_barabasi_albert_graph": lambda s: N.barabasi_albert(s, 1000, 2, 2, 1),
    "create_dorogovtsev_mendes_graph": lambda s: N.dorogovtsev_mendes(s, 1000, 1),
    "create_graph_with_degrees": lambda s: N.with_degrees(s, 500, (1, 2, 3, 4), "Edge switching", 1),
    "create_lfr_graph": lambda s: N.lfr(s, 1000, seed=1),
    "create_mocnik_graph": lambda s: N.mocnik(s, 1000, seed=1),
    "create_p2p_graph": lambda s: N.p2p(s, 1000, radius=0.05, seed=1),
    "create_hyperbolic_graph": lambda s: N.hyperbolic_random(s, 1000, seed=1),
}.items():
    query(name=_name)(lambda spark, d, make=_make: _summary(make(spark)))


@query()
def create_random_edges(spark, d):
    return _summary(N.random_edges(people(spark, d), 4.0, 1))


@query()
def create_scale_free_edges(spark, d):
    return _summary(N.scale_free_edges(people(spark, d), 4, 1.3, 1))


@query()
def add_popularity_similarity_edges(spark, d):
    return _summary(N.pso_edges(people(spark, d), seed=1))


@query()
def predict_hyperbolic_edges(spark, d):
    g = N.hyper_map(trade(spark, d))
    return N.predict_hyperbolic_edges(trade(spark, d).with_vertex_values(g), 20).edges.where("hyperbolic_edge_probability is not null").select("src", "dst", "hyperbolic_edge_probability")


@query()
def hyperbolic_edge_probability(spark, d):
    g = trade(spark, d)
    return N.hyperbolic_probability(g.with_vertex_values(N.hyper_map(g)))


# Subgraphs


@query(f"WITH {PEOPLE} SELECT eid, src, dst FROM e WHERE src <> dst")
def discard_loop_edges(spark, d):
    return B.discard_loops(people(spark, d)).edges.select("eid", "src", "dst")


_FILTERS = {
    "filter_number_comparison": ({"age": ">=30"}, None, "age >= 30", "true"),
    "filter_number_interval": ({"age": "[18,40)"}, None, "age >= 18 AND age < 40", "true"),
    "filter_text_negated_regex": ({"name": "!regex(^[A-K])"}, None, "name IS NOT NULL AND NOT regexp_matches(name, '^[A-K]')", "true"),
    "filter_defined_and_edges": ({"name": "*", "age": "<50"}, {"weight": ">3"}, "name IS NOT NULL AND age < 50", "weight > 3"),
    "filter_edge_text": (None, {"comment": "regex(follows|trusts)"}, "true", "comment IS NOT NULL AND regexp_matches(comment, 'follows|trusts')"),
}
for _name, (_v, _e, _wv, _we) in _FILTERS.items():
    query(f"WITH {PEOPLE}, k AS (SELECT id FROM v WHERE {_wv}) SELECT eid, src, dst FROM e WHERE src IN (SELECT id FROM k) AND dst IN (SELECT id FROM k) AND {_we}", _name)(
        lambda spark, d, v=_v, e=_e: B.filter_by_attributes(people(spark, d), v, e).edges.select("eid", "src", "dst")
    )


@query("SELECT event_id, user_id, event_type FROM events WHERE event_type IN ('click', 'view', 'purchase')")
def filter_membership(spark, d):
    g = Graph(table(spark, d, "events").withColumn("id", F.col("event_id")))
    return B.filter_by_attributes(g, {"event_type": "click,view,purchase"}).vertices.select("event_id", "user_id", "event_type")


@query("SELECT vec_id, label FROM embeddings WHERE len(list_filter(embedding, lambda x: x > 0.25)) > 0")
def filter_vector_any(spark, d):
    g = Graph(table(spark, d, "embeddings").withColumn("id", F.col("vec_id")))
    return B.filter_by_attributes(g, {"embedding": "any(>0.25)"}).vertices.select("vec_id", "label")


@query(f"WITH {PEOPLE} SELECT eid, weight FROM e JOIN v s ON src = s.id JOIN v t ON dst = t.id WHERE s.age > 20 AND t.age > 20 AND s.age > t.age AND weight >= 2")
def filter_with_sql_graph(spark, d):
    return V.filter_with_sql(people(spark, d), vertex_filter="age > 20", edge_filter="src_age > dst_age and edge_weight >= 2").edges.select("eid", "weight")


@query("SELECT p_partkey, p_size FROM part WHERE p_size > 25 AND p_brand LIKE 'Brand#1%'")
def filter_with_sql_table(spark, d):
    return V.filter_with_sql(table(spark, d, "part").select("p_partkey", "p_size", "p_brand"), "p_size > 25 and p_brand like 'Brand#1%'").drop("p_brand")


@query()
def create_snowball_sample(spark, d):
    return B.snowball_sample(people(spark, d), 0.02, 2, "hops", 1).vertices.groupBy("hops").agg(F.count(F.lit(1)).alias("n"))


@query()
def sample_by_random_walks(spark, d):
    return B.random_walk_sample(people(spark, d), 5, 50, 0.3, seed=1).vertices.select("id", "first_reached")


# Segmentations

_HALF = "SELECT CAST((b + k) * 250.0 AS DOUBLE) AS bottom, CAST((b + k) * 250.0 + 500 AS DOUBLE) AS top, CAST(count(*) AS DOUBLE) AS size FROM (SELECT floor(c_acctbal / 250.0) AS b FROM customer), (VALUES (0), (-1)) t(k) GROUP BY 1, 2"


@query(_HALF)
def segment_by_number_overlapping(spark, d):
    g = Graph(table(spark, d, "customer").withColumn("id", F.col("c_custkey")))
    return S.by_number(g, "c_acctbal", 500, True).segmentation("bucketing").graph.vertices.drop("id")


@query(f"WITH {PEOPLE} SELECT CAST(floor(age / 10) * 10 AS DOUBLE) AS bottom, CAST(floor(age / 10) * 10 + 10 AS DOUBLE) AS top, CAST(count(*) AS DOUBLE) AS size FROM v WHERE age IS NOT NULL GROUP BY 1, 2")
def segment_by_number(spark, d):
    return S.by_number(people(spark, d), "age", 10).segmentation("bucketing").graph.vertices.drop("id")


@query("""WITH x AS (SELECT epoch(min(l_shipdate)) / 86400 AS a, epoch(max(l_shipdate)) / 86400 AS b FROM lineitem GROUP BY l_orderkey)
SELECT CAST(k * 30.0 AS DOUBLE) AS bottom, CAST(k * 30.0 + 30 AS DOUBLE) AS top, CAST(count(*) AS DOUBLE) AS size FROM (SELECT unnest(generate_series(CAST(floor(a / 30.0) AS BIGINT), CAST(floor(b / 30.0) AS BIGINT))) AS k FROM x) GROUP BY 1, 2""")
def segment_by_interval(spark, d):
    t = F.col("l_shipdate").cast("timestamp_ntz")
    days = lambda c: F.expr(f"timestampdiff(SECOND, timestamp_ntz'1970-01-01', {c}) / 86400.0D")
    x = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.min(t).alias("lo"), F.max(t).alias("hi"))
    return S.by_interval(Graph(x.select("id", days("lo").alias("a"), days("hi").alias("b"))), "a", "b", 30).segmentation("bucketing").graph.vertices.drop("id")


@query("SELECT p_brand, CAST(count(*) AS DOUBLE) AS size FROM part GROUP BY 1")
def segment_by_text(spark, d):
    return S.by_text(Graph(table(spark, d, "part").withColumn("id", F.col("p_partkey"))), "p_brand").segmentation("bucketing").graph.vertices.drop("id")


@query("SELECT element, count(*) AS links FROM (SELECT unnest(string_split(p_type, ' ')) AS element FROM part) GROUP BY 1")
def segment_by_vector(spark, d):
    g = Graph(table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.split("p_type", " ").alias("words")))
    s = S.by_vector(g, "words").segmentation("bucketing")
    return s.membership.groupBy(F.col("sid").alias("id")).agg(F.count(F.lit(1)).alias("links")).join(s.graph.vertices, "id").drop("id")


@query("SELECT p_brand AS a_p_brand, p_size AS b_p_size, CAST(count(*) AS DOUBLE) AS size FROM part GROUP BY 1, 2")
def combine_segmentations(spark, d):
    g = Graph(table(spark, d, "part").withColumn("id", F.col("p_partkey")))
    g = S.combine(S.by_text(S.by_text(g, "p_brand", "a"), "p_size", "b"), ["a", "b"], "c")
    return g.segmentation("c").graph.vertices.select("a_p_brand", "b_p_size", "size")


@query("""WITH x AS (SELECT user_id AS p, epoch(date_trunc('second', ts)) AS t, event_type AS l FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL AND event_type IS NOT NULL),
n AS (SELECT *, CASE WHEN lag(l) OVER w = l THEN 0 ELSE 1 END AS new FROM x WINDOW w AS (PARTITION BY p ORDER BY t, l)),
g AS (SELECT *, sum(new) OVER (PARTITION BY p ORDER BY t, l ROWS UNBOUNDED PRECEDING) AS run FROM n),
r AS (SELECT p, run, l, min(t) AS a, max(t) AS b, count(*) OVER (PARTITION BY p) AS k FROM g GROUP BY 1, 2, 3),
q AS (SELECT c.p, [c.l, d.l] AS locations, greatest(c.a, d.b - 604800) AS lo, c.b AS hi FROM r c JOIN r d ON c.p = d.p AND d.run = c.run + 1 UNION ALL SELECT p, [l], greatest(a, b - 604800), b FROM r WHERE k = 1),
u AS (SELECT DISTINCT p, locations, unnest(generate_series(CAST(floor(lo / 86400) AS BIGINT), CAST(floor(hi / 86400) AS BIGINT))) AS bucket FROM q)
SELECT locations, CAST(count(*) AS DOUBLE) AS people FROM u GROUP BY 1""")
def segment_by_event_sequence(spark, d):
    ev = table(spark, d, "events").select(F.col("user_id").alias("person"), F.unix_timestamp(F.col("ts").cast("timestamp")).cast("double").alias("t"), F.col("event_type").alias("loc"))
    g = Graph(ev.select(F.col("person").alias("id")).distinct())
    return S.by_event_sequence(g, "loc", "t", ev, "continuous", 2, 86400.0, 7 * 86400.0).segmentation("event_sequences").graph.vertices.groupBy("locations").agg(F.sum("size").alias("people"))


@query("SELECT r_name AS region, n_name AS nation FROM nation JOIN region ON n_regionkey = r_regionkey")
def use_table_as_segmentation(spark, d):
    g = Graph(table(spark, d, "nation").select(F.col("n_nationkey").cast("bigint").alias("id"), F.col("n_name").alias("nation")))
    links = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_name", F.col("r_name").alias("region"))
    g = S.from_table(g, links, "nation", "n_name", "region", "s")
    return V.belongs_to(g, g.segmentation("s")).select(F.col("base_nation").alias("nation"), F.col("segment_region").alias("region"))


def _brands(spark, d):
    """Orders, and the brands in them as overlapping segments."""
    line, part = table(spark, d, "lineitem"), table(spark, d, "part")
    links = line.join(part, F.col("l_partkey") == F.col("p_partkey")).select(F.col("l_orderkey").alias("vid"), F.col("p_brand").alias("brand"))
    g = Graph(table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("price")))
    return S._from_keys(g, "brands", links, ["brand"])


_BRANDS = "m AS (SELECT l_orderkey AS vid, p_brand AS brand FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey)"


@query(f"WITH {_BRANDS}, u AS (SELECT DISTINCT vid, brand FROM m) SELECT a.brand AS src_brand, b.brand AS dst_brand, CAST(count(*) AS DOUBLE) AS overlap FROM u a JOIN u b ON a.vid = b.vid AND a.brand <> b.brand GROUP BY 1, 2 HAVING count(*) >= 3")
def create_edges_from_overlaps(spark, d):
    s = S.edges_from_overlap(_brands(spark, d), "brands").segmentation("brands")
    return V.triplets(s.graph, {"src_brand", "dst_brand", "edge_Overlap size"}).withColumnRenamed("edge_Overlap size", "overlap")


@query(f"WITH {_BRANDS}, u AS (SELECT DISTINCT vid, brand FROM m) SELECT brand, count(*) AS n FROM u GROUP BY 1")
def merge_parallel_segment_links(spark, d):
    g = S.merge_parallel_links(_brands(spark, d), "brands")
    return V.belongs_to(g, g.segmentation("brands"), {"segment_brand"}).groupBy(F.col("segment_brand").alias("brand")).agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {_BRANDS} SELECT brand, CAST(count(*) AS DOUBLE) AS price_count, round(sum(o_totalprice), 2) AS price_sum, round(avg(o_totalprice), 6) AS price_average, max(o_totalprice) AS price_max, round(stddev_samp(o_totalprice), 4) AS price_std_deviation FROM m JOIN orders ON vid = o_orderkey GROUP BY 1")
def aggregate_to_segmentation(spark, d):
    g = _brands(spark, d)
    out = A.aggregate_to_segmentation(g, "brands", [("price", a) for a in ("count", "sum", "average", "max", "std_deviation")])
    return g.segmentation("brands").graph.vertices.join(out, "id").select("brand", "price_count", r("price_sum", 2).alias("price_sum"), r("price_average", 6).alias("price_average"), "price_max", r("price_std_deviation").alias("price_std_deviation"))


@query(f"WITH {_BRANDS} SELECT vid AS id, CAST(count(DISTINCT brand) AS DOUBLE) AS brands_brand_count_distinct, max(brand) AS brands_brand_max FROM m GROUP BY 1")
def aggregate_from_segmentation(spark, d):
    return A.aggregate_from_segmentation(_brands(spark, d), "brands", [("brand", "count_distinct"), ("brand", "max")])


def _regions(spark, d):
    return S.by_text(trade(spark, d), "region", "regions")


@query(f"WITH {TRADE} SELECT a.region AS src_region, b.region AS dst_region, count(*) AS n, round(sum(weight), 2) AS weight FROM e JOIN v a ON src = a.id JOIN v b ON dst = b.id GROUP BY 1, 2")
def copy_edges_to_segmentation(spark, d):
    s = S.copy_edges_to_segmentation(_regions(spark, d), "regions").segmentation("regions")
    return V.triplets(s.graph, {"src_region", "dst_region", "edge_weight"}).groupBy("src_region", "dst_region").agg(F.count(F.lit(1)).alias("n"), r(F.sum("edge_weight"), 2).alias("weight"))


@query(f"WITH {TRADE}, s AS (SELECT a.region AS p, b.region AS q FROM e JOIN v a ON src = a.id JOIN v b ON dst = b.id) SELECT x.name AS src, y.name AS dst, count(*) AS n FROM s JOIN v x ON x.region = p JOIN v y ON y.region = q GROUP BY 1, 2")
def copy_edges_to_base_graph(spark, d):
    g = S.copy_edges_to_base(S.copy_edges_to_segmentation(_regions(spark, d), "regions"), "regions")
    return V.triplets(g, {"src_name", "dst_name"}).groupBy(F.col("src_name").alias("src"), F.col("dst_name").alias("dst")).agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {TRADE} SELECT a.name AS src, b.name AS dst, a.region AS region FROM v a JOIN v b ON a.region = b.region")
def create_edges_from_cooccurrence(spark, d):
    g = S.edges_from_cooccurrence(_regions(spark, d), "regions")
    return V.triplets(g, {"src_name", "dst_name", "edge_regions_region"}).select(F.col("src_name").alias("src"), F.col("dst_name").alias("dst"), F.col("edge_regions_region").alias("region"))


@query()
def sample_edges_from_cooccurrence(spark, d):
    return S.sample_cooccurrence(_regions(spark, d), "regions", 0.5, 1).edges.select("src", "dst", "multiplicity")


@query(f"WITH {TRADE}, m AS (SELECT id AS vid, region FROM v) SELECT region, count(*) AS n FROM (SELECT * FROM m UNION SELECT b, region FROM m JOIN nb ON a = vid UNION SELECT src, region FROM m JOIN e ON src = vid AND src = dst) GROUP BY 1")
def grow_segmentation(spark, d):
    g = S.grow(_regions(spark, d), "regions", "all neighbors")
    return V.belongs_to(g, g.segmentation("regions"), {"segment_region"}).groupBy(F.col("segment_region").alias("region")).agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {TRADE} SELECT name, CASE WHEN region < 2 THEN 'low' ELSE 'high' END AS half FROM v")
def pull_segmentation_up(spark, d):
    g = _regions(spark, d)
    s = g.segmentation("regions")
    inner = S.by_text(A.derive(s.graph, "vertices", "half", "if(region < 2, 'low', 'high')"), "half", "halves")
    g = S.pull_up(g.with_segmentation("regions", type(s)(inner, s.membership)), "regions", "halves")
    return V.belongs_to(g, g.segmentation("halves"), {"base_name", "segment_half"}).select(F.col("base_name").alias("name"), F.col("segment_half").alias("half"))


@query(f"WITH {TRADE} SELECT name, region AS regions_region, CAST(count(*) OVER (PARTITION BY region) AS DOUBLE) AS regions_size FROM v")
def copy_attributes_from_segmentation(spark, d):
    return A.copy_from_segmentation(_regions(spark, d), "regions").vertices.select("name", "regions_region", "regions_size")


@query(f"WITH {TRADE} SELECT name, region FROM v")
def take_segmentation_links(spark, d):
    return T.take_segmentation_links(_regions(spark, d), "regions").vertices.select(F.col("base_name").alias("name"), F.col("segment_region").alias("region"))


# Structure


@query(f"WITH {PEOPLE} SELECT dst AS src, src AS dst, eid FROM e")
def reverse_edge_direction(spark, d):
    return T.reverse_edges(people(spark, d)).edges.select("src", "dst", "eid")


@query(f"WITH {PEOPLE} SELECT src, dst, 0.0::DOUBLE AS reversed, count(*) AS n FROM e GROUP BY 1, 2 UNION ALL SELECT dst, src, 1.0::DOUBLE, count(*) FROM e GROUP BY 1, 2")
def add_reversed_edges(spark, d):
    return T.add_reversed_edges(people(spark, d), "reversed").edges.groupBy("src", "dst", "reversed").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {SALES} SELECT customer, supplier, CAST(count(*) AS DOUBLE) AS price_count, round(sum(price), 2) AS price_sum, max(price) AS price_max, round(median(quantity), 4) AS quantity_median FROM sales GROUP BY 1, 2")
def merge_parallel_edges(spark, d):
    g = T.merge_parallel_edges(B.use_table_as_graph(sales(spark, d), "customer", "supplier"), [("price", "count"), ("price", "sum"), ("price", "max"), ("quantity", "median")])
    named = V.triplets(g).withColumnsRenamed({"src_stringId": "customer", "dst_stringId": "supplier"})
    return named.select("customer", "supplier", F.col("edge_price_count").alias("price_count"), r("edge_price_sum", 2).alias("price_sum"), F.col("edge_price_max").alias("price_max"), r("edge_quantity_median").alias("quantity_median"))


@query(f"WITH {SALES} SELECT customer, supplier, quantity, CAST(count(*) AS DOUBLE) AS price_count FROM sales GROUP BY 1, 2, 3")
def merge_parallel_edges_by_attribute(spark, d):
    g = T.merge_parallel_edges(B.use_table_as_graph(sales(spark, d), "customer", "supplier"), [("price", "count")], by="quantity")
    return V.triplets(g).select(F.col("src_stringId").alias("customer"), F.col("dst_stringId").alias("supplier"), F.col("edge_quantity").alias("quantity"), F.col("edge_price_count").alias("price_count"))


@query(f"WITH {TRADE} SELECT a.region AS src, b.region AS dst, count(*) AS n FROM e JOIN v a ON src = a.id JOIN v b ON dst = b.id GROUP BY 1, 2")
def merge_vertices_by_attribute(spark, d):
    g = T.merge_vertices(trade(spark, d), "region", [("name", "count")])
    return V.triplets(g, {"src_region", "dst_region"}).groupBy(F.col("src_region").alias("src"), F.col("dst_region").alias("dst")).agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {TRADE} SELECT p.src, q.dst, count(*) AS n, round(sum(p.weight * q.weight), 0) AS w FROM e p JOIN e q ON p.dst = q.src GROUP BY 1, 2")
def replace_with_triadic_closure(spark, d):
    return T.triadic_closure(trade(spark, d)).edges.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"), r(F.sum(F.col("ab_weight") * F.col("bc_weight")), 0).alias("w"))


@query(f"WITH {TRADE} SELECT p.eid AS src, q.eid AS dst FROM e p JOIN e q ON p.dst = q.src")
def replace_with_edge_graph(spark, d):
    return T.edge_graph(trade(spark, d)).edges.select("src", "dst")


@query(f"WITH {PEOPLE} SELECT CAST(i AS DOUBLE) AS index, count(*) AS n, round(sum(weight), 2) AS weight FROM (SELECT weight, unnest(generate_series(0, CAST(weight AS BIGINT) - 1)) AS i FROM e) GROUP BY 1")
def split_edges(spark, d):
    return T.split_edges(people(spark, d), "weight").edges.groupBy("index").agg(F.count_distinct("eid").alias("n"), r(F.sum("weight"), 2).alias("weight"))


@query(f"WITH {TRADE} SELECT name, CAST(i AS DOUBLE) AS index FROM (SELECT name, unnest(generate_series(0, region - 1)) AS i FROM v WHERE region >= 1)")
def split_vertices(spark, d):
    return T.split_vertices(trade(spark, d), "region").vertices.select("name", "index")


@query(f"WITH {PEOPLE} SELECT src, dst, min(eid) AS eid FROM e GROUP BY 1, 2")
def strip_duplicate_edges(spark, d):
    return T.strip_duplicate_edges(people(spark, d)).edges.select("src", "dst", "eid")


@query(f"WITH {PEOPLE} SELECT eid FROM e WHERE EXISTS (SELECT 1 FROM e f WHERE f.src = e.dst AND f.dst = e.src)")
def remove_non_symmetric_edges(spark, d):
    return T.remove_non_symmetric_edges(people(spark, d)).edges.select("eid")


@query("SELECT name, count(*) AS n FROM (SELECT n_name AS name FROM nation UNION ALL SELECT r_name FROM region) GROUP BY 1")
def graph_union(spark, d):
    a = Graph(table(spark, d, "nation").select(F.col("n_nationkey").cast("bigint").alias("id"), F.col("n_name").alias("name")))
    b = Graph(table(spark, d, "region").select(F.col("r_regionkey").cast("bigint").alias("id"), F.col("r_name").alias("name")))
    return T.union(a, b).vertices.groupBy("name").agg(F.count_distinct("id").alias("n"))


@query(f"WITH {PEOPLE} SELECT id, CASE WHEN age > 30 THEN 'old' END AS kind, name FROM v WHERE name IS NOT NULL")
def graph_rejoin(spark, d):
    g = people(spark, d)
    other = A.derive(B.filter_by_attributes(g, {"age": ">30"}), "vertices", "kind", "'old'", False)
    return T.rejoin(B.filter_by_attributes(g, {"name": "*"}), other, ["kind"]).vertices.select("id", "kind", "name")


@query(f"WITH {PEOPLE} SELECT eid AS id, weight AS edge_weight, s.name AS src_name, t.age AS dst_age FROM e JOIN v s ON src = s.id JOIN v t ON dst = t.id")
def take_edges_as_vertices(spark, d):
    return T.take_edges_as_vertices(people(spark, d)).vertices.select("id", "edge_weight", "src_name", "dst_age")


@query(f"WITH {TRADE} SELECT p.src, q.dst, round(sum(p.weight * q.weight), 0) AS weight FROM e p JOIN e q ON p.dst = q.src GROUP BY 1, 2")
def concatenate_bundles(spark, d):
    e = trade(spark, d).edges.select("src", "dst", "weight")
    return T.concatenate(e, e).select("src", "dst", r("weight", 0).alias("weight"))


# Attributes


@query("SELECT c_custkey AS id, c_name || '-x' AS a, CASE WHEN c_acctbal > 0 THEN 'p' ELSE 'n' END AS b FROM customer")
def derive_vertex_attribute(spark, d):
    g = Graph(table(spark, d, "customer").withColumn("id", F.col("c_custkey")))
    g = A.derive(A.derive(g, "vertices", "a", "c_name || '-x'"), "vertices", "b", "if(c_acctbal > 0, 'p', 'n')")
    return g.vertices.select("id", "a", "b")


@query(f"WITH {PEOPLE} SELECT eid, CASE WHEN s.age IS NOT NULL AND t.age IS NOT NULL THEN round(s.age - t.age + weight, 4) END AS x FROM e JOIN v s ON src = s.id JOIN v t ON dst = t.id")
def derive_edge_attribute(spark, d):
    return A.derive(people(spark, d), "edges", "x", "round(src$age - dst$age + weight, 4)").edges.select("eid", "x")


@query("SELECT c_custkey AS id, CAST(row_number() OVER (ORDER BY c_acctbal, c_custkey) - 1 AS DOUBLE) AS ranking FROM customer")
def add_rank_attribute(spark, d):
    g = Graph(table(spark, d, "customer").select(F.col("c_custkey").alias("id"), "c_acctbal"))
    return A.add_rank(g, "vertices", "c_acctbal").vertices.select("id", "ranking")


@query("SELECT c_custkey AS id, upper(sha256(c_name || 'salt')) AS name FROM customer")
def hash_vertex_attribute(spark, d):
    g = Graph(table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name")))
    return A.hash_attribute(g, "vertices", "name", "salt").vertices


@query(f"WITH {PEOPLE} SELECT id, coalesce(name, '?') AS name, coalesce(age, -1) AS age, coalesce(name, 'none') AS both FROM v")
def fill_and_merge_attributes(spark, d):
    g = A.derive(people(spark, d), "vertices", "none", "'none'", False)
    return A.fill(A.merge_two(g, "vertices", "both", "name", "none"), "vertices", {"name": "?", "age": -1.0}).vertices.select("id", "name", "age", "both")


@query("SELECT c_custkey AS id, n_name AS nation_n_name FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey")
def use_table_as_vertex_attributes(spark, d):
    g = Graph(table(spark, d, "customer").select(F.col("c_custkey").alias("id"), "c_nationkey"))
    return A.use_table(g, "vertices", table(spark, d, "nation").select("n_nationkey", "n_name"), "c_nationkey", "n_nationkey", "nation_").vertices.select("id", "nation_n_name")


@query("SELECT c_custkey AS id, [CASE WHEN c_mktsegment = s THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END FOR s IN ['BUILDING', 'MACHINERY']] AS v FROM customer")
def one_hot_encode(spark, d):
    g = Graph(table(spark, d, "customer").select(F.col("c_custkey").alias("id"), "c_mktsegment"))
    return A.one_hot(g, "v", "c_mktsegment", ["BUILDING", "MACHINERY"]).vertices.select("id", "v")


@query("SELECT p_partkey AS id, [CAST(p_size AS DOUBLE), p_retailprice] AS v FROM part")
def bundle_into_vector(spark, d):
    g = Graph(table(spark, d, "part").select(F.col("p_partkey").alias("id"), "p_size", "p_retailprice"))
    return A.bundle_vector(g, "v", ["p_size", "p_retailprice"]).vertices.select("id", "v")


@query()
def add_random_attribute(spark, d):
    return A.add_random(people(spark, d), "vertices", seed=1).vertices.agg(F.count("random").alias("n"), r(F.avg("random"), 3).alias("mean"), r(F.stddev("random"), 3).alias("deviation"))


@query(f"WITH {PEOPLE} SELECT CAST(id AS VARCHAR) AS id_text, 2.0::DOUBLE AS two, name AS called FROM v")
def manage_attributes(spark, d):
    g = A.expose_id(A.add_constant(people(spark, d), "vertices", "two", 2), "vertices")
    g = A.discard_attributes(A.rename_attributes(A.copy_attribute(g, "vertices", "age", "years"), "vertices", {"name": "called", "age": ""}), "vertices", "years")
    return g.vertices.select("id_text", "two", "called")


@query("SELECT p_partkey AS id, CAST(p_size AS VARCHAR) AS t, CAST(p_size AS DOUBLE) AS x FROM part")
def convert_attributes(spark, d):
    g = Graph(table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_size").cast("double").alias("t"), F.col("p_size").cast("string").alias("x")))
    return A.to_number(A.to_text(g, "vertices", "t"), "vertices", "x").vertices


# Aggregation and propagation

_ALL = ["count", "sum", "max", "min", "average", "median", "std_deviation", "count_distinct", "most_common", "count_most_common", "first"]


def _agg_sql(x: str, by: str, source: str) -> str:
    return f"""base AS ({source}),
c AS (SELECT {by}, {x} AS x, count(*) AS n FROM base WHERE {x} IS NOT NULL GROUP BY 1, 2),
m AS (SELECT {by}, arg_max(x, (n, x)) AS mc, max(n) AS cm, count(*) AS cd FROM c GROUP BY 1),
s AS (SELECT {by}, CASE WHEN count({x}) > 0 THEN CAST(count({x}) AS DOUBLE) END AS x_count, round(sum({x}), 4) AS x_sum, max({x}) AS x_max, min({x}) AS x_min, round(avg({x}), 8) AS x_average, round(median({x}), 4) AS x_median,
  CASE WHEN count({x}) > 0 THEN round(coalesce(stddev_samp({x}), 0), 8) END AS x_std_deviation FROM base GROUP BY 1)
SELECT s.{by}, x_count, x_sum, x_max, x_min, x_average, x_median, x_std_deviation, CAST(cd AS DOUBLE) AS x_count_distinct, mc AS x_most_common, CAST(cm AS DOUBLE) AS x_count_most_common, x_min AS x_first FROM s LEFT JOIN m ON s.{by} = m.{by}"""


def _rounded(df, key):
    exact = {"max", "min", "first", "most_common", "count", "count_distinct", "count_most_common"}
    return df.select(key, *(F.col(f"x_{a}") if a in exact else r(f"x_{a}", 8 if a in ("average", "std_deviation") else 4).alias(f"x_{a}") for a in _ALL))


@query("WITH " + _agg_sql("l_quantity", "l_returnflag", "SELECT l_returnflag, l_quantity FROM lineitem"))
def aggregate_table_by_key(spark, d):
    df = table(spark, d, "lineitem").select("l_returnflag", F.col("l_quantity").alias("x"))
    return _rounded(aggregate(df, ["l_returnflag"], [("x", a) for a in _ALL]), "l_returnflag")


for _direction, _pairs_sql in {
    "incoming edges": "SELECT dst AS id, src AS o FROM e",
    "outgoing edges": "SELECT src AS id, dst AS o FROM e",
    "all edges": "SELECT src AS id, dst AS o FROM e UNION ALL SELECT dst, src FROM e",
    "symmetric edges": "SELECT id, o FROM (SELECT a.src AS id, a.dst AS o, unnest(generate_series(1, least(a.n, b.n))) FROM k a JOIN k b ON a.src = b.dst AND a.dst = b.src)",
    "in-neighbors": "SELECT DISTINCT dst AS id, src AS o FROM e",
    "out-neighbors": "SELECT DISTINCT src AS id, dst AS o FROM e",
    "all neighbors": "SELECT src AS id, dst AS o FROM e UNION SELECT dst, src FROM e",
    "symmetric neighbors": "SELECT DISTINCT a.src AS id, a.dst AS o FROM e a JOIN e b ON a.src = b.dst AND a.dst = b.src",
}.items():
    _slug = _direction.replace(" ", "_").replace("-", "_")
    _k = "k AS (SELECT src, dst, count(*) AS n FROM e GROUP BY 1, 2), "
    query(f"WITH {PEOPLE}, {_k} p AS ({_pairs_sql}) SELECT v.id, CAST(count(p.o) AS DOUBLE) AS degree FROM v LEFT JOIN p ON p.id = v.id GROUP BY 1", f"degree_{_slug}")(
        lambda spark, d, way=_direction: M.degree(people(spark, d), way)
    )
    query(f"WITH {PEOPLE}, {_k} p AS ({_pairs_sql}), " + _agg_sql("age", "id", "SELECT p.id, v.age FROM p JOIN v ON v.id = p.o"), f"aggregate_on_{_slug}")(
        lambda spark, d, way=_direction: _rounded(A.aggregate_on_neighbours(A.copy_attribute(people(spark, d), "vertices", "age", "x"), way, [("x", a) for a in _ALL], prefix=""), "id")
    )

for _way, _source in {"incoming edges": "SELECT dst AS id, weight FROM e", "outgoing edges": "SELECT src AS id, weight FROM e", "all edges": "SELECT src AS id, weight FROM e UNION ALL SELECT dst, weight FROM e"}.items():
    query(f"WITH {PEOPLE}, " + _agg_sql("weight", "id", _source), f"aggregate_edges_to_vertices_{_way.split()[0]}")(
        lambda spark, d, way=_way: _rounded(A.aggregate_edges(A.copy_attribute(people(spark, d), "edges", "weight", "x"), way, [("x", a) for a in _ALL], prefix=""), "id")
    )


@query(f"WITH {PEOPLE} SELECT dst AS id, round(sum(age * weight), 4) AS age_weighted_sum_by_weight, round(sum(age * weight) / sum(CASE WHEN age IS NOT NULL THEN weight END), 8) AS age_weighted_average_by_weight, arg_max(age, (weight, age)) FILTER (age IS NOT NULL) AS age_by_max_weight_by_weight, arg_min(age, (weight, age)) FILTER (age IS NOT NULL) AS age_by_min_weight_by_weight FROM e JOIN v ON src = id GROUP BY 1")
def weighted_aggregate_on_neighbors(spark, d):
    out = A.aggregate_on_neighbours(people(spark, d), "incoming edges", [("age", a) for a in ("weighted_sum", "weighted_average", "by_max_weight", "by_min_weight")], "weight", "")
    return out.select("id", *(r(c, 8 if "average" in c else 4).alias(c) if "weighted_" in c else F.col(c) for c in out.columns if c != "id"))


@query("SELECT CAST(count(c_acctbal) AS DOUBLE) AS c_acctbal_count, round(sum(c_acctbal), 2) AS c_acctbal_sum, round(avg(c_acctbal), 4) AS c_acctbal_average, (SELECT CAST(count(DISTINCT c_mktsegment) AS DOUBLE) FROM customer) AS c_mktsegment_count_distinct, (SELECT arg_max(c_mktsegment, (n, c_mktsegment)) FROM (SELECT c_mktsegment, count(*) AS n FROM customer GROUP BY 1)) AS c_mktsegment_most_common FROM customer")
def aggregate_vertex_attribute_globally(spark, d):
    g = Graph(table(spark, d, "customer").withColumn("id", F.col("c_custkey")))
    out = A.aggregate_globally(g, "vertices", [("c_acctbal", "count"), ("c_acctbal", "sum"), ("c_acctbal", "average"), ("c_mktsegment", "count_distinct"), ("c_mktsegment", "most_common")])
    return out.withColumn("c_acctbal_sum", r("c_acctbal_sum", 2)).withColumn("c_acctbal_average", r("c_acctbal_average"))


@query(f"WITH {PEOPLE} SELECT round(sum(weight * eid) / sum(eid), 6) AS weight_weighted_average_by_eid, round(sum(weight * eid), 2) AS weight_weighted_sum_by_eid FROM e")
def weighted_aggregate_edges_globally(spark, d):
    out = A.aggregate_globally(people(spark, d), "edges", [("weight", "weighted_average"), ("weight", "weighted_sum")], "eid")
    return out.select(r("weight_weighted_average_by_eid", 6).alias("weight_weighted_average_by_eid"), r("weight_weighted_sum_by_eid", 2).alias("weight_weighted_sum_by_eid"))


@query("SELECT label, list(a ORDER BY i) AS embedding_elementwise_average FROM (SELECT label, i, round(avg(embedding[i]), 4) AS a FROM embeddings, range(1, 65) t(i) WHERE i <= len(embedding) GROUP BY 1, 2) GROUP BY 1")
def aggregate_vectors_elementwise(spark, d):
    df = table(spark, d, "embeddings").select("label", F.col("embedding").cast("array<double>").alias("embedding"))
    out = aggregate(df, ["label"], [("embedding", "elementwise_average")])
    return out.select("label", F.transform("embedding_elementwise_average", lambda x: F.round(x, 4)).alias("embedding_elementwise_average"))


@query("SELECT c_nationkey, list(DISTINCT c_mktsegment ORDER BY c_mktsegment) AS c_mktsegment_set, list(c_custkey ORDER BY c_custkey) AS c_custkey_vector FROM customer GROUP BY 1")
def aggregate_sets_and_vectors(spark, d):
    return aggregate(table(spark, d, "customer"), ["c_nationkey"], [("c_mktsegment", "set"), ("c_custkey", "vector")])


@query("""WITH c AS (SELECT c_nationkey, c_mktsegment AS s, count(*) AS n FROM customer GROUP BY 1, 2)
SELECT c_nationkey, CASE WHEN max(n) >= 0.5 * sum(n) THEN arg_max(s, (n, s)) ELSE '' END AS c_mktsegment_majority_50, CASE WHEN max(n) >= sum(n) THEN arg_max(s, (n, s)) ELSE '' END AS c_mktsegment_majority_100 FROM c GROUP BY 1""")
def aggregate_majority(spark, d):
    return aggregate(table(spark, d, "customer"), ["c_nationkey"], [("c_mktsegment", "majority_50"), ("c_mktsegment", "majority_100")])


# Metrics

_TRI = "tri AS (SELECT x.a AS a, x.b AS b, y.b AS c FROM nb x JOIN nb y ON x.b = y.a JOIN nb z ON z.a = x.a AND z.b = y.b WHERE x.a < x.b AND y.a < y.b)"


@query(f"WITH {PEOPLE}, {_TRI} SELECT a, b, c FROM tri")
def find_triangles(spark, d):
    return M.triangles(people(spark, d).edges)


@query(f"""WITH {PEOPLE}, de AS (SELECT DISTINCT src, dst FROM e WHERE src <> dst), n AS (SELECT a AS id, count(*) AS n FROM nb GROUP BY 1),
k AS (SELECT x.a AS id, count(*) AS k FROM nb x JOIN de ON de.src = x.b JOIN nb y ON y.a = x.a AND y.b = de.dst GROUP BY 1)
SELECT v.id, CASE WHEN coalesce(n, 0) <= 1 THEN 1.0 ELSE round(coalesce(k, 0) / (n * (n - 1.0)), 6) END AS clustering_coefficient FROM v LEFT JOIN n ON n.id = v.id LEFT JOIN k ON k.id = v.id""")
def clustering_coefficient(spark, d):
    return M.clustering_coefficient(people(spark, d)).select("id", r("clustering_coefficient", 6).alias("clustering_coefficient"))


@query(f"WITH {PEOPLE}, c AS (SELECT eid, count(*) AS k FROM e JOIN nb x ON x.a = src JOIN nb y ON y.a = dst AND y.b = x.b GROUP BY 1) SELECT e.eid, CAST(coalesce(k, 0) AS DOUBLE) AS embeddedness FROM e LEFT JOIN c ON c.eid = e.eid WHERE src IN (SELECT a FROM nb) AND dst IN (SELECT a FROM nb)")
def embeddedness(spark, d):
    return M.embeddedness(people(spark, d)).where("embeddedness is not null")


@query(f"""WITH {TRADE}, t AS (SELECT x.a AS u, x.b AS v, y.b AS c FROM nb x JOIN nb y ON y.a = x.a JOIN nb z ON z.a = x.b AND z.b = y.b),
p AS (SELECT s.u, s.v, s.c AS a, q.c AS b FROM t s JOIN t q ON s.u = q.u AND s.v = q.v AND s.c < q.c),
k AS (SELECT u, v, count(*) AS k FROM p WHERE NOT EXISTS (SELECT 1 FROM nb WHERE nb.a = p.a AND nb.b = p.b)
  AND NOT EXISTS (SELECT 1 FROM t f JOIN t g ON f.u = g.u AND f.c = g.c WHERE f.u = p.u AND f.v = p.a AND g.v = p.b AND f.c <> p.v) GROUP BY 1, 2)
SELECT eid, CAST(coalesce(k, 0) AS DOUBLE) AS dispersion FROM e LEFT JOIN k ON k.u = src AND k.v = dst WHERE src <> dst""")
def dispersion(spark, d):
    return M.dispersion(trade(spark, d)).select("eid", "dispersion")


@query(f"WITH {PEOPLE} SELECT round(corr(s.age, t.age), 6) AS assortativity FROM e JOIN v s ON src = s.id JOIN v t ON dst = t.id")
def assortativity(spark, d):
    return M.assortativity(people(spark, d), "age").select(r("assortativity", 6).alias("assortativity"))


@query("SELECT round(corr(p_size, p_retailprice), 8) AS correlation FROM part")
def correlate_two_attributes(spark, d):
    g = Graph(table(spark, d, "part").withColumn("id", F.col("p_partkey")))
    return spark.createDataFrame([(round(M.correlate(g, "p_size", "p_retailprice"), 8),)], "correlation double")


_LAB = "lab AS (SELECT weight AS w, a.region AS s, b.region AS t FROM e JOIN v a ON src = a.id JOIN v b ON dst = b.id)"


@query(f"""WITH {TRADE}, {_LAB}, x AS (SELECT sum(w) AS total FROM lab), o AS (SELECT s AS r, sum(w) AS o FROM lab GROUP BY 1), i AS (SELECT t AS r, sum(w) AS i FROM lab GROUP BY 1), b AS (SELECT s AS r, sum(w) AS b FROM lab WHERE s = t GROUP BY 1)
SELECT round(sum(coalesce(b, 0) / total - coalesce(i, 0) * coalesce(o, 0) / (total * total)), 8) AS modularity FROM x, o FULL JOIN i ON o.r = i.r LEFT JOIN b ON b.r = coalesce(o.r, i.r)""")
def modularity(spark, d):
    return M.modularity(_regions(spark, d), "regions", "weight").select(r("modularity", 8).alias("modularity"))


@query(f"""WITH {TRADE}, {_LAB}, z AS (SELECT region, count(*) AS n FROM v GROUP BY 1), f AS (SELECT w, s AS region, s = t AS inside, true AS lead FROM lab UNION ALL SELECT w, t, s = t, false FROM lab),
a AS (SELECT region, count(*) FILTER (inside AND lead) AS k, coalesce(sum(w) FILTER (NOT inside), 0) AS cut, sum(w) AS vol FROM f GROUP BY 1),
h AS (SELECT x.region, nb.a, count(*) FILTER (y.region = x.region) AS k_in, count(*) FILTER (y.region <> x.region) AS k_out FROM nb JOIN v x ON x.id = nb.a JOIN v y ON y.id = nb.b GROUP BY 1, 2),
g AS (SELECT region, max(k_in) AS hub, count(*) FILTER (k_in > k_out) AS stable FROM h GROUP BY 1)
SELECT z.region, CAST(n AS DOUBLE) AS size, round(k / (n * (n - 1) / 2.0), 6) AS density, round(cut / least(vol, 2 * (SELECT sum(w) FROM lab) - vol), 6) AS conductance, round(cut, 2) AS expansion, round(hub / (n - 1.0), 6) AS hub_dominance, round(stable / CAST(n AS DOUBLE), 6) AS stability FROM z JOIN a ON a.region = z.region JOIN g ON g.region = z.region""")
def segment_metrics(spark, d):
    g = _regions(spark, d)
    out = M.segment_metrics(g, "regions", "weight").join(g.segmentation("regions").graph.vertices.select("id", "region"), "id")
    return out.select("region", "size", r("density", 6).alias("density"), r("conductance", 6).alias("conductance"), r("expansion", 2).alias("expansion"), r("hub_dominance", 6).alias("hub_dominance"), r("stability", 6).alias("stability"))


@query(f"WITH {TRADE}, {_LAB} SELECT round(sum(w) FILTER (s = t) / sum(w), 8) AS coverage, round(sum(w) FILTER (s <> t), 2) AS edge_cut FROM lab")
def segmentation_coverage_and_cut(spark, d):
    return M.segmentation_scalars(_regions(spark, d), "regions", "weight").select(r("coverage", 8).alias("coverage"), r("edge_cut", 2).alias("edge_cut"))


@query()
def segment_fragmentation(spark, d):
    return M.fragmentation(S.by_number(people(spark, d), "age", 10), "bucketing").select(r("fragmentation", 6).alias("fragmentation"))


# Iterative algorithms

_PR = f"""WITH {PEOPLE}, w AS (SELECT src, dst, sum(weight) AS w FROM e WHERE weight > 0 GROUP BY 1, 2), s AS (SELECT src, dst, w / sum(w) OVER (PARTITION BY src) AS s FROM w), n AS (SELECT count(*) AS n FROM v), r0 AS (SELECT id, 1.0::DOUBLE AS r FROM v)"""
for _i in range(1, 6):
    _PR += f", i{_i} AS (SELECT dst AS id, 0.85 * sum(r * s) AS x FROM s JOIN r{_i - 1} ON id = src GROUP BY 1), r{_i} AS (SELECT v.id, coalesce(x, 0) + ((SELECT n FROM n) - (SELECT sum(x) FROM i{_i})) / (SELECT n FROM n) AS r FROM v LEFT JOIN i{_i} ON i{_i}.id = v.id)"


@query(_PR + " SELECT id, round(r, 6) AS page_rank FROM r5")
def pagerank(spark, d):
    return I.pagerank(people(spark, d), "weight").select("id", r("page_rank", 6).alias("page_rank"))


_RECURSIVE_CC = """cc(id, g) USING KEY (id) AS (SELECT id, id FROM v
  UNION SELECT nb.b, min(cc.g) FROM cc JOIN nb ON nb.a = cc.id JOIN recurring.cc AS old ON old.id = nb.b WHERE cc.g < old.g GROUP BY nb.b)"""


@query(f"WITH RECURSIVE {PEOPLE}, {_RECURSIVE_CC} SELECT id, g AS component FROM cc")
def connected_components(spark, d):
    return I.connected_components(people(spark, d))


@query(f"WITH {PEOPLE}, m AS (SELECT a.src AS x, a.dst AS y FROM e a JOIN e b ON a.src = b.dst AND a.dst = b.src WHERE a.src <> a.dst) SELECT count(DISTINCT x) AS linked FROM m")
def connected_components_mutual(spark, d):
    c = I.connected_components(people(spark, d), "require both directions")
    return c.groupBy("component").agg(F.count(F.lit(1)).alias("n")).where("n > 1").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("linked"))


_SP = f"WITH {PEOPLE}, d0 AS (SELECT id, 0.0::DOUBLE AS d FROM v WHERE id % 50 = 0)"
for _i in range(1, 6):
    _SP += f", d{_i} AS (SELECT id, min(d) AS d FROM (SELECT id, d FROM d{_i - 1} UNION ALL SELECT dst, d + weight FROM d{_i - 1} JOIN e ON src = id) GROUP BY 1)"


@query(_SP + " SELECT id, d AS distance FROM d5")
def shortest_path(spark, d):
    g = people(spark, d)
    return I.shortest_path(g.with_vertices(g.vertices.withColumn("start", F.when(F.col("id") % 50 == 0, 0.0))), "start", "weight", 5)


# The five rounds of shortest_path and its SQL leave out longer paths; this one has them all.
@query()
def shortest_path_to_fixpoint(spark, d):
    g = people(spark, d)
    return I.shortest_path(g.with_vertices(g.vertices.withColumn("start", F.when(F.col("id") % 50 == 0, 0.0))), "start", "weight", None)


_BFS = f"WITH {TRADE}, s0 AS (SELECT id AS source, id, 0 AS d FROM v)"
for _i in range(1, 11):
    _BFS += f", s{_i} AS (SELECT source, id, min(d) AS d FROM (SELECT source, id, d FROM s{_i - 1} UNION ALL SELECT source, src, d + 1 FROM s{_i - 1} JOIN e ON dst = id) GROUP BY 1, 2)"


@query(_BFS + " SELECT source AS id, round(coalesce(sum(1.0 / d) FILTER (d > 0), 0), 6) AS harmonic FROM s10 GROUP BY 1")
def harmonic_centrality(spark, d):
    return I.centrality(trade(spark, d), "Harmonic", bits=None, name="harmonic").select("id", r("harmonic", 6).alias("harmonic"))


@query(_BFS + " SELECT source AS id, CASE WHEN sum(d) = 0 THEN 1.0 ELSE round(count(*) * count(*) / CAST(sum(d) AS DOUBLE), 6) END AS lin, round(coalesce(CAST(sum(d) AS DOUBLE) / nullif(count(*) - 1, 0), 0), 6) AS average FROM s10 GROUP BY 1")
def lin_and_average_distance(spark, d):
    g = trade(spark, d)
    a, b = I.centrality(g, "Lin", bits=None, name="lin"), I.centrality(g, "Average distance", bits=None, name="average")
    return a.join(b, "id").select("id", r("lin", 6).alias("lin"), r("average", 6).alias("average"))


@query()
def harmonic_centrality_sketched(spark, d):
    return I.centrality(people(spark, d), "Harmonic").select("id", "centrality")


@query(f"WITH {PEOPLE}, o AS (SELECT src, count(*) AS d FROM e GROUP BY 1), k AS (SELECT e.src, sum(coalesce(o.d, 0)) AS k FROM e LEFT JOIN o ON o.src = e.dst GROUP BY 1) SELECT v.id, CAST(coalesce(d, 0) * coalesce(d, 0) + coalesce(d, 0) + 2 * coalesce(k, 0) AS DOUBLE) AS centrality FROM v LEFT JOIN o ON o.src = v.id LEFT JOIN k ON k.src = v.id")
def laplacian_centrality(spark, d):
    return I.laplacian_centrality(people(spark, d))


@query()
def betweenness_centrality(spark, d):
    return I.betweenness(trade(spark, d)).select("id", r("centrality", 6).alias("centrality"))


@query()
def eigenvector_and_katz_centrality(spark, d):
    g = people(spark, d)
    return I.power_iteration(g, iterations=10, name="eigenvector").join(I.power_iteration(g, "Katz", 10, name="katz"), "id")


@query(f"WITH {PEOPLE}, d AS (SELECT a, count(*) AS d FROM nb GROUP BY 1) SELECT v.id, coalesce((SELECT round(count(*) FILTER (y.d > x.d) / CAST(count(*) AS DOUBLE), 6) FROM nb JOIN d x ON x.a = nb.a JOIN d y ON y.a = nb.b WHERE nb.a = v.id HAVING count(*) > 0), 0) AS centrality FROM v")
def sfigality(spark, d):
    return I.sfigality(people(spark, d)).select("id", r("centrality", 6).alias("centrality"))


@query()
def k_path_centrality(spark, d):
    return I.k_path_centrality(people(spark, d))


@query()
def closeness_centrality(spark, d):
    return I.closeness(trade(spark, d))


@query()
def k_core_decomposition(spark, d):
    return I.k_core(people(spark, d))


@query()
def diameter(spark, d):
    low, high = I.diameter(trade(spark, d))
    return spark.createDataFrame([(low, high, I.effective_diameter(trade(spark, d)))], "low bigint, high bigint, effective double")


@query(f"WITH RECURSIVE {PEOPLE}, {_RECURSIVE_CC} SELECT (SELECT count(*) FROM v) - count(DISTINCT g) AS edges FROM cc")
def optimal_spanning_tree(spark, d):
    return I.spanning_tree(people(spark, d), "weight").agg(F.count(F.lit(1)).alias("edges"))


@query("SELECT 0 AS clashes")
def vertex_coloring(spark, d):
    g = people(spark, d)
    c = I.coloring(g)
    e = g.edges.where("src <> dst").join(c.withColumnsRenamed({"id": "src", "color": "a"}), "src").join(c.withColumnsRenamed({"id": "dst", "color": "b"}), "dst")
    # a vertex without a colour counts as a clash
    bare = g.vertices.join(c.where("color is not null"), "id", "left_anti").select(F.lit(1.0).alias("a"), F.lit(1.0).alias("b"))
    return e.select("a", "b").unionByName(bare).agg(F.count_if(F.col("a") == F.col("b")).cast("int").alias("clashes"))


@query(f"WITH {PEOPLE}, {_TRI} SELECT a AS vid, count(*) AS n FROM (SELECT a FROM tri UNION ALL SELECT b FROM tri UNION ALL SELECT c FROM tri) GROUP BY 1")
def segment_by_triangles(spark, d):
    return C.find_triangles(people(spark, d)).segmentation("triangles").membership.groupBy("vid").agg(F.count(F.lit(1)).alias("n"))


@query()
def find_maximal_cliques(spark, d):
    return C.maximal_cliques(people(spark, d).edges).groupBy(F.size("members").alias("size")).agg(F.count(F.lit(1)).alias("n"))


@query()
def find_infocom_communities(spark, d):
    return C.find_infocom_communities(people(spark, d), False).segmentation("communities").graph.vertices.select("size")


@query()
def find_communities_label_propagation(spark, d):
    return C.find_label_communities(people(spark, d)).segmentation("communities").graph.vertices.select("size")


@query()
def find_communities_louvain(spark, d):
    return C.find_louvain_communities(trade(spark, d), "weight").segmentation("communities").graph.vertices.select("size")


@query()
def find_modular_clustering(spark, d):
    g = C.find_modular_clustering(trade(spark, d), "weight")
    return spark.createDataFrame([(g.scalars["modularity"],)], "modularity double")


@query()
def fingerprint_attributes(spark, d):
    g = people(spark, d)
    g = A.derive(A.derive(g, "vertices", "l", "if(id % 10 < 9, id, null)", False), "vertices", "r", "if(id % 10 > 0, id, null)", False)
    return X.fingerprint(g, "l", "r", least_similarity=0.2).vertices.select("id", "l", "r", "l_similarity_score")


@query()
def forest_fire_scores(spark, d):
    return X.forest_fire_scores(people(spark, d), seed=1)


@query()
def place_vertices(spark, d):
    return X.pivot_layout(trade(spark, d), 2, 10)


@query()
def steiner_tree(spark, d):
    g = A.derive(A.derive(A.derive(trade(spark, d), "vertices", "root", "if(id = 0, 1.0D, null)", False), "vertices", "gain", "5.0D"), "edges", "cost", "1000.0D / weight")
    return X.steiner_tree(g, "cost", "root", "gain").vertices.select("id", "node")


# Machine learning


def _parts(spark, d):
    return Graph(table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_size").cast("double").alias("size"), F.col("p_retailprice").alias("price"), "p_brand", F.when(F.col("p_size") > 25, "big").otherwise("small").alias("kind")))


@query("SELECT p_partkey AS id, CASE WHEN p_size > 25 THEN 'big' ELSE 'small' END AS prediction FROM part")
def classify_with_decision_tree(spark, d):
    g = _parts(spark, d)
    return L.classify(g, L.train_decision_tree_classifier(g, "kind", ["size"])).select("id", "prediction")


@query("SELECT p_partkey AS id, round(2.0 * p_size + 1, 3) AS y_prediction FROM part")
def predict_attribute_linear(spark, d):
    g = A.derive(_parts(spark, d), "vertices", "y", "2 * size + 1")
    return L.predict_attribute(g, "y", ["size"]).select("id", r("y_prediction", 3).alias("y_prediction"))


@query()
def train_kmeans(spark, d):
    g = _parts(spark, d)
    return L.classify(g, L.train_kmeans(g, ["size"], 3, seed=1)).groupBy("prediction").agg(F.count(F.lit(1)).alias("n"))


@query()
def train_logistic_regression(spark, d):
    g = A.derive(_parts(spark, d), "vertices", "big", "if(size > 25, 1.0D, 0.0D)")
    return L.classify(g, L.train_logistic_regression(g, "big", ["size"])).groupBy("prediction").agg(F.count(F.lit(1)).alias("n"))


@query()
def train_regression_tree(spark, d):
    g = _parts(spark, d)
    return L.predict(g, L.train_decision_tree_regressor(g, "price", ["size"]))


@query()
def reduce_dimensions_pca(spark, d):
    g = Graph(table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("v")))
    return L.reduce_dimensions(g, "v", 2)


@query("SELECT count(*) AS n FROM part")
def split_train_test(spark, d):
    return L.split_train_test(_parts(spark, d), "price", 0.2, 1).vertices.where("(price_test is null) <> (price_train is null)").agg(F.count(F.lit(1)).alias("n"))


@query()
def embed_vertices(spark, d):
    return L.embed_vertices(trade(spark, d), 1, 8, 5, 3, 3)


@query()
def embed_text_attribute(spark, d):
    g = Graph(table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_type").alias("t")))
    return L.embed_text(g, "t", 16)


@query()
def graph_convolution(spark, d):
    g = A.derive(trade(spark, d), "vertices", "x", "array(cast(region as double), 1.0D)")
    g = A.derive(g, "vertices", "y", "if(region > 2, 1.0D, 0.0D)")
    return L.predict_graph_convolution(g, L.train_graph_convolution(g, "y", "x", 1))


# SQL and views


@query(f"WITH {PEOPLE} SELECT s.name AS a, t.name AS b, weight AS w FROM e JOIN v s ON src = s.id JOIN v t ON dst = t.id WHERE s.age > 40 AND t.age < 20")
def sql_over_triplets(spark, d):
    return V.sql("select src_name a, dst_name b, edge_weight w from edges where src_age > 40 and dst_age < 20", people(spark, d))


@query(f"WITH {TRADE} SELECT region AS r, count(*) AS n FROM v GROUP BY 1")
def sql_over_segmentation(spark, d):
    return V.sql("select segment_region r, count(*) n from `regions.belongs_to` group by 1", _regions(spark, d))


@query("SELECT n_name, sum(o_totalprice) > 0 AS sold, grouping(n_name) AS g, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY ROLLUP (n_name)")
def sql_three_inputs_rollup(spark, d):
    q = "select n_name, sum(o_totalprice) > 0 sold, grouping(n_name) g, count(*) n from one join two on o_custkey = c_custkey join three on c_nationkey = n_nationkey group by rollup (n_name)"
    return V.sql(q, table(spark, d, "orders"), table(spark, d, "customer"), table(spark, d, "nation"))


@query("SELECT l_orderkey, l_linenumber, round(sum(l_quantity) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey ROWS UNBOUNDED PRECEDING), 2) AS running FROM lineitem")
def sql_window(spark, d):
    return V.sql("select l_orderkey, l_linenumber, round(sum(l_quantity) over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey rows unbounded preceding), 2) running from input", table(spark, d, "lineitem"))


@query("SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2")
def sql_pricing_summary(spark, d):
    return V.sql("select l_returnflag, l_linestatus, round(sum(l_quantity), 2) sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) sum_disc, count(*) n from input where l_shipdate <= timestamp_ntz'1998-09-02' group by 1, 2", table(spark, d, "lineitem"))


@query("SELECT c_custkey, c_mktsegment || '!' AS c_mktsegment, c_acctbal * 2 AS doubled FROM customer")
def transform_and_derive_column(spark, d):
    t = V.transform(table(spark, d, "customer").select("c_custkey", "c_mktsegment", "c_acctbal"), c_mktsegment="c_mktsegment || '!'")
    return V.derive_column(t, "doubled", "c_acctbal * 2").drop("c_acctbal")


@query("SELECT p_brand AS value, count(*) AS count FROM part GROUP BY 1 ORDER BY count DESC, value LIMIT 10")
def top_values(spark, d):
    return W.top_values(table(spark, d, "part"), "p_brand", 10)


@query("""WITH x AS (SELECT min(c_acctbal) AS lo, max(c_acctbal) AS hi FROM customer) SELECT CAST(least(floor((c_acctbal - lo) / ((hi - lo) / 20)), 19) AS INT) AS bucket, count(*) AS count FROM customer, x GROUP BY 1""")
def attribute_histogram(spark, d):
    return W.histogram(table(spark, d, "customer"), "c_acctbal")


@query("SELECT min(c_acctbal) AS min, max(c_acctbal) AS max, min(c_acctbal) FILTER (c_acctbal > 0) AS min_positive FROM customer")
def attribute_min_max(spark, d):
    return W.min_max(table(spark, d, "customer"), "c_acctbal")


@query(f"WITH {TRADE} SELECT CAST(a.region AS VARCHAR) AS x1, '' AS y1, CAST(b.region AS VARCHAR) AS x2, '' AS y2, count(*) AS count FROM e JOIN v a ON src = a.id JOIN v b ON dst = b.id GROUP BY 1, 2, 3, 4")
def bucketed_graph_view(spark, d):
    g = A.to_text(trade(spark, d), "vertices", "region")
    return W.bucketed_view(g, "region")[1]


@query("SELECT o_orderpriority AS x, round(sum(o_totalprice), 2) AS y FROM orders GROUP BY 1")
def plot_aggregates(spark, d):
    return W.plot_data(table(spark, d, "orders"), "o_orderpriority", "o_totalprice").withColumn("y", r("y", 2))


@query()
def graph_metrics_table(spark, d):
    return W.graph_metrics(people(spark, d))


@query("SELECT user_id, CAST(count(*) AS BIGINT) AS n, max(value) AS top FROM events GROUP BY 1")
def compute_in_python(spark, d):
    t = table(spark, d, "events").select("user_id", "value")
    out = W.compute_in_python(t, "df['one'] = 1", "df.one: int", per_batch=True)
    return out.groupBy("user_id").agg(F.sum("one").alias("n"), F.max("value").alias("top"))


@query("SELECT time_bucket(INTERVAL 1 DAY, ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def tumbling_windows(spark, d):
    from ..streaming.windows import windowed_counts

    out = windowed_counts(table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp")), "ts", "event_type", "1 day")
    return out.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n")

