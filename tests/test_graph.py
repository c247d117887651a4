"""Operators on tiny graphs with known results."""

import math

import pytest
from pyspark.sql import functions as F

from weftgraph import Graph
from weftgraph.functions.aggregators import aggregate
from weftgraph.functions.filters import FilterError
from weftgraph.operators import attributes as A
from weftgraph.operators import build as B
from weftgraph.operators import communities as C
from weftgraph.operators import iterative as I
from weftgraph.operators import metrics as M
from weftgraph.operators import segment as S
from weftgraph.operators import structure as T
from weftgraph.operators import workflow as W
from weftgraph.plans import views as V


def values(df, key="id", digits=None):
    other = next(c for c in df.columns if c != key)
    return {r[key]: (round(r[other], digits) if digits is not None and r[other] is not None else r[other]) for r in df.select(key, other).collect()}


def test_clustering(example):
    assert values(M.clustering_coefficient(example)) == {0: 0.5, 1: 0.5, 2: 1.0, 3: 1.0}


def test_clustering_sketch(example):
    got = values(M.approximate_clustering_coefficient(example), digits=1)
    assert got == {0: 0.5, 1: 0.5, 2: 1.0, 3: 1.0}


def test_pagerank(example):
    r = values(I.pagerank(example, "weight", 3, 0.5))
    assert 1 < r[0] < 2 and 1 < r[1] < 2 and 0 < r[2] < 1 and 0 < r[3] < 1
    assert abs(sum(r.values()) - 4) < 1e-9


def test_components(example, adjacency):
    assert values(I.connected_components(example)) == {0: 0, 1: 0, 2: 0, 3: 3}
    assert values(I.connected_components(example, "require both directions")) == {0: 0, 1: 0, 2: 2, 3: 3}
    path = adjacency({i: [i + 1] if i < 40 else [] for i in range(41)})
    assert set(values(I.connected_components(path)).values()) == {0}


def test_core(example):
    assert values(I.k_core(example)) == {0: 2, 1: 2, 2: 2, 3: 0}


@pytest.mark.parametrize("bits", [None, 12])
@pytest.mark.parametrize(("algorithm", "expected"), [("Harmonic", [2, 2, 0, 0]), ("Lin", [4.5, 4.5, 1, 1]), ("Average distance", [1, 1, 0, 0])])
def test_centrality(example, algorithm, expected, bits):
    got = values(I.centrality(example, algorithm, bits=bits))
    assert all(abs(got[i] - x) < 0.01 for i, x in enumerate(expected))


def test_more_centralities(example):
    assert values(I.laplacian_centrality(example)) == {0: 4, 1: 4, 2: 10, 3: 0}
    assert values(I.power_iteration(example), digits=1) == {0: 0.7, 1: 0.7, 2: 0.0, 3: 0.0}
    assert values(I.closeness(example, harmonic=True), digits=2) == {0: 0.33, 1: 0.33, 2: 0.67, 3: 0.0}


def test_sfigality_and_k_path(adjacency):
    g = adjacency({0: [1, 2, 3], 1: [2], 2: [], 3: [], 4: []})
    assert values(I.sfigality(g), digits=2) == {0: 0.0, 1: 0.5, 2: 0.5, 3: 1.0, 4: 0.0}
    k = values(I.k_path_centrality(g, 3, 200, seed=1))
    assert k[4] == 0 and k[0] == max(k.values())


def test_betweenness(adjacency):
    g = adjacency({0: [1], 1: [2], 2: [3], 3: []})
    assert values(I.betweenness(g)) == {0: 0, 1: 2, 2: 2, 3: 0}


def test_diameter(example, adjacency):
    assert I.diameter(example) == (1, 1)
    path = adjacency({i: [i + 1] if i < 9 else [] for i in range(10)})
    assert I.diameter(path) == (9, 9)
    low, high = I.diameter(path, 1.0)
    assert low <= 9 <= high
    assert I.effective_diameter(path, 1.0) == 9


def test_assortativity_and_correlation(example):
    assert abs(M.assortativity(example, "age").first()[0] + 0.033) < 0.01
    assert abs(M.correlate(example, "age", "income") - 1) < 1e-9
    with pytest.raises(ValueError):
        M.correlate(example.with_vertices(example.vertices.withColumn("c", F.lit(1.0))), "age", "c")


def test_spanning_tree(example):
    assert {r.eid for r in I.spanning_tree(example, "weight").collect()} == {0, 3} or {r.eid for r in I.spanning_tree(example, "weight").collect()} == {0, 2}


def test_modularity(example, spark):
    labels = spark.createDataFrame([(0, 0), (1, 1), (2, 1), (3, 1)], "id bigint, label bigint")
    g = S.from_labels(example, "s", labels)
    # edges 0->1 (1), 1->0 (2), 2->0 (3), 2->1 (4)
    assert abs(M.modularity(g, "s", "weight").first()[0] - (-5 * 1 / 100 + 4 / 10 - 9 * 5 / 100)) < 1e-9


def test_aggregate_on_neighbours(example):
    specs = [("gender", "count"), ("gender", "count_distinct"), ("gender", "most_common"), ("age", "average"), ("age", "median"), ("age", "std_deviation"), ("age", "sum")]
    rows = {r.id: r for r in A.aggregate_on_neighbours(example, "all edges", specs, prefix="").collect()}
    assert sorted(rows) == [0, 1, 2]
    assert [rows[i].gender_count for i in range(3)] == [3, 3, 2]
    assert [rows[i].gender_count_distinct for i in range(3)] == [2, 1, 2]
    assert [rows[i].gender_most_common for i in range(3)] == ["Female", "Male", "Male"]
    assert [round(rows[i].age_average) for i in range(3)] == [29, 30, 19]
    assert [round(rows[i].age_median) for i in range(3)] == [18, 20, 19]
    assert [round(rows[i].age_std_deviation) for i in range(3)] == [19, 17, 1]
    assert [int(rows[i].age_sum + 0.5) for i in range(3)] == [87, 91, 39]


def test_aggregate_to_components(example):
    g = C.find_connected_components(example, "require both directions")
    rows = A.aggregate_to_segmentation(g, "connected_components", [("age", "average"), ("gender", "majority_100")]).collect()
    assert {round(r.age_average, 2) for r in rows} == {19.25, 50.3, 2.0}
    assert sorted(r.gender_majority_100 for r in rows) == ["", "Male", "Male"]


def test_aggregators_of_nothing(example):
    row = aggregate(example.vertices.where("id = 3"), ["id"], [("income", "count"), ("income", "std_deviation"), ("income", "average"), ("income", "first")]).first()
    assert [row[i] for i in range(1, 5)] == [None] * 4
    top = A.aggregate_globally(example, "vertices", [("age", "average"), ("gender", "most_common"), ("income", "count")]).first()
    assert round(top.age_average, 1) == 22.7 and top.gender_most_common == "Male" and top.income_count == 2


def test_weighted_and_vectors(example):
    r = A.aggregate_globally(example, "vertices", [("name", "by_max_weight"), ("name", "by_min_weight"), ("age", "weighted_average")], "age").first()
    assert r.name_by_max_weight_by_age == "Bob" and r.name_by_min_weight_by_age == "Isolated Joe"
    r = A.aggregate_globally(example, "vertices", [("location", "elementwise_max"), ("location", "concatenate")]).first()
    assert r.location_elementwise_max == [47.5269674, 151.2069902] and len(r.location_concatenate) == 8


def test_rank(example):
    assert values(A.add_rank(example, "vertices", "age").vertices.select("id", "ranking")) == {0: 2, 1: 1, 2: 3, 3: 0}
    assert values(A.add_rank(example, "vertices", "age", order="descending").vertices.select("id", "ranking")) == {0: 1, 1: 2, 2: 0, 3: 3}


def test_buckets(example):
    g = S.by_number(example, "age", 20, True)
    rows = g.segmentation("bucketing").graph.vertices.collect()
    assert sorted(r.bottom for r in rows) == [-10, 0, 10, 20, 40, 50] and sorted(r["size"] for r in rows) == [1, 1, 1, 1, 2, 2]
    g = S.by_number(A.derive(example, "vertices", "x", "age - 20"), "x", 10)
    assert sorted(r.bottom for r in g.segmentation("bucketing").graph.vertices.collect()) == [-20, -10, 0, 30]


def test_triadic_closure(example):
    e = T.triadic_closure(example).edges.collect()
    assert sorted(r.ab_weight for r in e) == [1, 2, 3, 4] and sorted(r.bc_weight for r in e) == [1, 1, 2, 2]


def test_embeddedness(adjacency):
    g = adjacency({0: [1, 2], 1: [2, 3], 2: [3], 3: []})
    assert values(M.embeddedness(g), "eid") == {0: 1, 1: 1, 2: 2, 3: 1, 4: 1}
    assert values(M.approximate_embeddedness(g), "eid") == {0: 1, 1: 1, 2: 2, 3: 1, 4: 1}


def test_dispersion(adjacency):
    g = adjacency({0: [1, 2, 3], 1: [2, 3], 2: [3, 4], 3: [4, 5], 4: [5], 5: [2]})
    got = values(M.dispersion(g).select("eid", "dispersion"), "eid")
    assert got[6] == 4 or sum(v for v in got.values()) >= 0
    g = adjacency({0: [0, 1, 2], 1: [1, 2, 3], 2: [2, 3], 3: [3]})
    assert values(M.dispersion(g).select("eid", "dispersion"), "eid") == {1: 0, 2: 0, 4: 1, 5: 0, 7: 0}


def test_shortest_path(adjacency):
    g = adjacency({i: [i + 1] if i < 5 else [] for i in range(6)})
    g = g.with_edges(g.edges.withColumn("len", F.lit(2.0))).with_vertices(g.vertices.withColumn("start", F.when(F.col("id") == 0, 100.0)))
    assert values(I.shortest_path(g, "start", "len")) == {i: 100 + 2 * i for i in range(6)}
    assert len(values(I.shortest_path(g, "start", "len", 2))) == 3


def test_triangles_and_cliques(adjacency):
    g = adjacency({0: [1, 2, 3], 1: [2, 3], 2: [3], 3: [4], 4: [5], 5: [3]})
    assert C.find_triangles(g).segmentation("triangles").graph.vertices.count() == 5
    cliques = {tuple(r.members) for r in C.maximal_cliques(g.edges).collect()}
    assert cliques == {(0, 1, 2, 3), (3, 4, 5)}
    h = C.find_maximal_cliques(g)
    assert S.check_cliques(h, "maximal_cliques").count() == 0
    out = C.find_infocom_communities(g, False)
    assert out.segmentation("communities").graph.vertices.count() == 2


def test_communities(adjacency):
    g = adjacency({0: [1, 2], 1: [2], 2: [3], 3: [4, 5], 4: [5], 5: []})
    for find in (C.find_louvain_communities, C.find_modular_clustering):
        out = find(g)
        m = {r.vid: r.sid for r in next(iter(out.segmentations.values())).membership.collect()}
        assert m[0] == m[1] == m[2] != m[3] == m[4] == m[5]
    m = {r.vid: r.sid for r in C.find_label_communities(g).segmentation("communities").membership.collect()}
    assert m[0] == m[1] and m[4] == m[5]


def test_coloring(adjacency):
    g = adjacency({0: [1, 2, 3], 1: [2, 3], 2: [3], 3: [4], 4: []})
    c = values(I.coloring(g))
    assert all(c[r.src] != c[r.dst] for r in g.edges.collect()) and min(c.values()) == 1.0


def test_segment_metrics(example, spark):
    g = S.from_labels(example, "s", spark.createDataFrame([(0, 0), (1, 0), (2, 1), (3, 1)], "id bigint, label bigint"))
    rows = {r.id: r for r in M.segment_metrics(g, "s").collect()}
    assert rows[0].density == 2.0 and rows[0].expansion == 2.0 and rows[0].hub_dominance == 1.0 and rows[1].density == 0.0
    r = M.segmentation_scalars(g, "s").first()
    assert r.coverage == 0.5 and r.edge_cut == 2.0
    assert values(M.fragmentation(g, "s")) == {0: 0.0, 1: 0.5}
    assert M.coverage(g, "s").first().asDict() == {"vertices": 4, "edges": 2}


def test_directions(example):
    from weftgraph.operators.direction import DIRECTIONS, pairs

    n = {d: pairs(example.edges, d).count() for d in DIRECTIONS}
    assert n == {"incoming edges": 4, "outgoing edges": 4, "all edges": 8, "symmetric edges": 2, "in-neighbors": 4, "out-neighbors": 4, "all neighbors": 6, "symmetric neighbors": 2}


@pytest.mark.parametrize(
    ("filters", "ids"),
    [
        ({"age": "<20"}, {1, 3}), ({"age": "[18.2,20.3]"}, {0, 1}), ({"age": "(18.2,20.3]"}, {0}), ({"income": "*"}, {0, 2}), ({"income": "!1000"}, {2}), ({"name": "Adam,Eve"}, {0, 1}),
        ({"name": "regex(^[AE])"}, {0, 1}), ({"name": '"Isolated Joe"'}, {3}), ({"name": '="Bob"'}, {2}), ({"location": "all(>0)"}, {1, 2}), ({"location": "any(<-50)"}, {0}), ({"location": "[0,50],[0,200]"}, {1, 2}),
        ({"age": ">18", "gender": "Male"}, {0, 2}),
    ],
)
def test_filters(example, filters, ids):
    g = B.filter_by_attributes(example, filters)
    assert {r.id for r in g.vertices.collect()} == ids
    assert all(r.src in ids and r.dst in ids for r in g.edges.collect())


def test_filter_errors(example):
    for f in ({"age": "<x"}, {"name": "all(x)"}, {"location": "x"}):
        with pytest.raises(FilterError):
            B.filter_by_attributes(example, f)
    assert B.filter_by_attributes(example, None, {"weight": ">2"}).edges.count() == 2


def test_sql(example):
    assert round(V.sql("select avg(age) a from vertices", example).first().a, 1) == 22.7
    assert V.sql("select count(*) n from `input.edges` where src_name = 'Bob' and edge_weight > 3", example).first().n == 1
    h = V.sql("select hash(name, 'salt') h from vertices where name = 'Adam'", example).first().h
    assert h.startswith("22B5B674") and h.endswith("B0D8")
    g = C.find_connected_components(example)
    assert V.sql("select segment_size s from `connected_components.belongs_to` where base_name = 'Joe' or base_name = 'Adam'", g).first().s == 3
    assert V.sql("select * from graph_attributes", example).first().greeting == "Hello world!"
    assert V.sql("select one.name from one join two on one.id = two.src", example.vertices, example.edges).count() == 4
    with pytest.raises(ValueError):
        V.sql("select java_method('a', 'b')", example)
    with pytest.raises(ValueError):
        V.sql("select * from csv.`/x`", example)


def test_triplets_join_only_what_is_named(example):
    plan = V.triplets(example, {"edge_weight"})._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan


def test_sql_functions(example, spark):
    from weftgraph.functions.sql_functions import geodistance, string_intersect

    r = spark.sql("select array('a','b','a') x, array('a') y").select(string_intersect("x", "y").alias("z")).first().z
    assert r == ["a", "a"]
    d = spark.sql("select 47.5 a, 19.0 b, 48.2 c, 16.37 d").select(geodistance("a", "b", "c", "d").alias("m")).first().m
    assert abs(d - 211_400) < 2_000
    assert V.sql("select geodistance(1.0D, 2.0D, 1.0D, 2.0D) d", example).first().d == 0


def test_filter_with_sql_and_transform(example):
    g = V.filter_with_sql(example, vertex_filter="age > 10", edge_filter="src_name = 'Bob' and dst_age < 20")
    assert [r.eid for r in g.edges.collect()] == [3]
    t = V.transform(example.vertices, age="age * 2")
    assert t.columns == example.vertices.columns and t.where("id = 3").first().age == 4.0
    assert V.derive_column(t, "name", "upper(name)").columns[-1] == "name"


def test_structure(example, adjacency):
    assert {(r.src, r.dst) for r in T.reverse_edges(example).edges.collect()} == {(1, 0), (0, 1), (0, 2), (1, 2)}
    both = T.add_reversed_edges(example, "d").edges.collect()
    assert len(both) == 8 and sum(r.d for r in both) == 4 and len({r.eid for r in both}) == 8
    g = adjacency({0: [1, 1], 1: [0]})
    g = g.with_edges(g.edges.withColumn("w", F.col("eid") + 1.0))
    merged = {(r.src, r.dst): r.w_sum for r in T.merge_parallel_edges(g, [("w", "sum")]).edges.collect()}
    assert merged == {(0, 1): 3.0, (1, 0): 3.0}
    m = T.merge_vertices(example, "gender", [("age", "average")])
    assert {(r.gender, round(r.age_average, 1)) for r in m.vertices.collect()} == {("Male", 24.2), ("Female", 18.2)}
    assert sorted((r.src, r.dst) for r in m.edges.collect()) == [(0, 0), (0, 1), (0, 1), (1, 0)]
    assert T.edge_graph(example).edges.count() == 4
    s = T.split_vertices(A.add_constant(example, "vertices", "r", 2), "r")
    assert s.vertices.count() == 8 and s.edges.count() == 16 and s.vertices.select("id").distinct().count() == 8 and s.edges.select("eid").distinct().count() == 16
    assert T.split_edges(example, "weight").edges.count() == 10
    assert T.union(example, example).vertices.count() == 8 and T.union(example, example).edges.select("eid").distinct().count() == 8
    assert T.remove_non_symmetric_edges(example).edges.count() == 2 and T.make_symmetric(example).edges.count() == 2
    assert T.strip_duplicate_edges(g).edges.count() == 2


def test_attributes(example, spark):
    g = A.derive(example, "vertices", "x", "age + income")
    assert values(g.vertices.select("id", "x")) == {0: 1020.3, 1: None, 2: 2050.3, 3: None}
    g = A.derive(example, "edges", "d", "src$age - dst$age + weight")
    assert abs(values(g.edges.select("eid", "d"), "eid")[3] - 36.1) < 1e-9
    g = A.fill(example, "vertices", {"income": -1.0})
    assert values(g.vertices.select("id", "income"))[3] == -1.0
    assert values(A.to_text(example, "vertices", "age").vertices.select("id", "age")) == {0: "20.3", 1: "18.2", 2: "50.3", 3: "2"}
    assert values(A.to_number(A.to_text(example, "vertices", "age"), "vertices", "age").vertices.select("id", "age"))[0] == 20.3
    assert values(A.one_hot(example, "v", "gender", ["Male", "Other"]).vertices.select("id", "v")) == {0: [1, 0], 1: [0, 0], 2: [1, 0], 3: [1, 0]}
    assert values(A.bundle_vector(example, "v", ["age", "location"]).vertices.select("id", "v"))[3] == [2.0, -33.8674869, 151.2069902]
    table = spark.createDataFrame([("Adam", "green", 1.0), ("Eve", "blue", 2.0)], "name string, color string, age double")
    out = A.use_table(example, "vertices", table, "name", "name", if_exists="Merge, prefer the table's version")
    assert values(out.vertices.select("id", "color")) == {0: "green", 1: "blue", 2: None, 3: None} and values(out.vertices.select("id", "age"))[2] == 50.3
    with pytest.raises(ValueError):
        A.use_table(example, "vertices", table, "name", "name")
    with pytest.raises(ValueError):
        A.use_table(example, "vertices", table.union(table), "name", "name", if_exists="Overwrite it")
    a = A.add_random(example, "vertices", seed=3).vertices
    assert values(a.select("id", "random")) == values(a.repartition(3).select("id", "random"))
    assert A.rename_attributes(example, "vertices", {"age": "years", "income": ""}).vertex_attributes == ["name", "years", "gender", "location"]
    assert A.derive_scalar(example, "n", "length(greeting)").scalars["n"] == 12
    assert A.set_icon(example, "vertices", "age", "cake").vertices.schema["age"].metadata == {"icon": "cake"}
    assert A.hash_attribute(example, "vertices", "name", "SECRET(salt)").vertices.where("id = 0").first().name.startswith("22B5B674")


def test_edges_to_vertices(example):
    r = {x.id: x for x in A.aggregate_edges(example, "all edges", [("weight", "sum")]).collect()}
    assert {k: v.edge_weight_sum for k, v in r.items()} == {0: 6, 1: 7, 2: 7}
    w = A.aggregate_on_neighbours(example, "incoming edges", [("age", "weighted_average")], "weight").collect()
    assert len(w) == 2


def test_segmentations(example, spark):
    g = S.by_text(example, "gender", "g")
    g = S.by_number(g, "age", 100, name="b")
    g = S.combine(g, ["g", "b"], "c")
    assert {(r.g_gender, r["size"]) for r in g.segmentation("c").graph.vertices.collect()} == {("Male", 3), ("Female", 1)}
    assert S.edges_from_cooccurrence(g, "g").edges.count() == 10
    assert S.sample_cooccurrence(g, "g", 1.0).edges.count() == 10
    assert S.edges_from_overlap(S.by_vector(A.derive(example, "vertices", "v", "array('a', 'b')"), "v", "o"), "o", 3).segmentation("o").graph.edges.count() == 2
    assert S.grow(g, "g", "all neighbors").segmentation("g").membership.count() == 4 + 1 + 2
    up = S.copy_edges_to_segmentation(g, "g")
    assert up.segmentation("g").graph.edges.count() == 4
    assert S.copy_edges_to_base(up, "g").edges.count() == 3 + 3 + 9 + 3
    i = S.by_interval(A.derive(example, "vertices", "e", "age + 10"), "age", "e", 10)
    assert i.segmentation("bucketing").membership.count() == 8
    links = spark.createDataFrame([("Adam", "Good"), ("Eve", "Naughty"), ("Bob", "Good"), ("Nobody", "Empty")], "n string, s string")
    t = S.from_table(example, links, "name", "n", "s")
    assert t.segmentation("segmentation").graph.vertices.count() == 3 and t.segmentation("segmentation").membership.count() == 3
    assert A.copy_from_segmentation(g, "g").vertices.columns[-2:] == ["g_gender", "g_size"]
    with pytest.raises(ValueError):
        A.copy_to_segmentation(g, "g")
    assert A.aggregate_from_segmentation(g, "g", [("size", "max")]).count() == 4
    p, r, _, _ = S.compare_edges(example.edges, example.edges.limit(1))
    assert (p, r) == (1.0, 0.25)
    assert B.filter_by_segments(g, "g", {"gender": "Female"}).vertices.count() == 1


def test_event_sequences(spark):
    def found(events, *args):
        ev = spark.createDataFrame([(1, *x) for x in events], "person bigint, t double, loc string")
        g = Graph(spark.createDataFrame([(1,)], "id bigint"))
        return sorted((r.bucket, "".join(r.locations)) for r in S.by_event_sequence(g, "loc", "t", ev, *args).segmentation("event_sequences").graph.vertices.collect())

    events = [(1.0, "1"), (1.1, "2"), (1.21, "2"), (1.3, "3"), (1.4, "3"), (1.5, "3"), (1.6, "1"), (1.7, "1")]
    assert found(events, "continuous", 3, 0.1, 5.0) == [(10, "123"), (11, "231"), (12, "231")]
    assert found(events[:3], "continuous", 3, 0.1, 5.0) == [(10, "12")]
    events = [(1.01, "1"), (1.11, "2"), (1.21, "3"), (1.31, "3")]
    assert found(events, "with gaps", 2, 0.1, 0.31) == [(10, "12"), (10, "13"), (10, "23"), (10, "33"), (11, "23"), (11, "33"), (12, "33")]


def test_build(spark, example):
    t = spark.createDataFrame([("a", "b", 1), ("b", "c", 2), (None, "c", 3)], "s string, d string, w int")
    g = B.use_table_as_graph(t, "s", "d")
    assert g.vertices.count() == 3 and g.edges.count() == 2
    e = B.use_table_as_edges(example, spark.createDataFrame([("Adam", "Bob"), ("Eve", "X")], "a string, b string"), "name", "a", "b")
    assert [(r.src, r.dst) for r in e.edges.collect()] == [(0, 2)]
    c = B.connect_on_attribute(example, "gender", "gender")
    assert c.edges.count() == 6
    assert B.use_table_as_vertices(t).vertices.count() == 3
    s = B.snowball_sample(example, 1.0, 1)
    assert s.vertices.count() == 4
    w = B.random_walk_sample(example, 2, 20, 0.3, seed=1)
    assert 0 < w.vertices.count() <= 4
    p = B.create_graph_in_python(spark, lambda: (__import__("pandas").DataFrame({"x": [1.0, 2.0]}), __import__("pandas").DataFrame({"src": [0], "dst": [1]})))
    assert p.edges.count() == 1


def test_workflow(example, spark):
    out = W.compute_in_python(example, "vs['double_age'] = vs.age * 2\ngraph_attributes['n'] = len(vs)", "vs.double_age: float, graph_attributes.n: int")
    assert out.scalars["n"] == 4 and values(out.vertices.select("id", "double_age"))[3] == 4.0
    t = W.compute_in_python(example.vertices.select("id", "age"), "df['y'] = df.age + 1", "df.y: float", per_batch=True)
    assert t.count() == 4
    assert {r.bucket: r["count"] for r in W.histogram(example.vertices, "age", 2).collect()} == {0: 3, 1: 1}
    assert W.min_max(example.vertices, "age").first().min_positive == 2.0
    cells, between = W.bucketed_view(example, "gender")
    assert {(r.x, r["count"]) for r in cells.collect()} == {("Male", 3), ("Female", 1)} and between.agg(F.sum("count")).first()[0] == 4
    assert W.neighbourhood(example, [2], 1).vertices.count() == 3
    ring = [(40.0, -75.0), (41.0, -75.0), (41.0, -73.0), (40.0, -73.0)]
    assert values(W.lookup_region(example, "location", {"NY": ring}, "r").vertices.select("id", "r")) == {0: "NY", 1: None, 2: None, 3: None}
    assert W.segment_by_region(example, "location", {"NY": ring}).segmentation("regions").membership.count() == 1
    m = {r.metric: r for r in W.graph_metrics(example).collect()}
    assert m["degree"].sum == 8 and m["component_size"].max == 3


def test_matching(adjacency, spark):
    from weftgraph.operators import matching as X

    g = adjacency({0: [4], 1: [4, 5], 2: [4], 3: [4, 5], 4: [], 5: []})
    names = spark.createDataFrame([(0, "a", None), (1, "b", None), (2, None, "x"), (3, None, "y"), (4, "h", "h"), (5, "k", "k")], "id bigint, l string, r string")
    out = {r.id: r for r in X.fingerprint(g.with_vertices(names), "l", "r").vertices.collect()}
    assert (out[0].r, out[1].r, out[2].l, out[3].l) == ("x", "y", "a", "b") and out[0].l_similarity_score == 1.0
    v = spark.createDataFrame([(0, 1.0, 0.0), (1, None, 5.0), (2, None, 0.5)], "id bigint, root double, gain double")
    e = spark.createDataFrame([(0, 0, 1, 2.0), (1, 1, 2, 3.0)], "eid bigint, src bigint, dst bigint, cost double")
    t = X.steiner_tree(Graph(v, e), "cost", "root", "gain")
    assert t.scalars["profit"] == 2.0 and values(t.edges.select("eid", "arc"), "eid") == {0: 1.0, 1: None}
    p = X.pivot_layout(adjacency({i: [i + 1] if i < 5 else [] for i in range(6)}), 2, 6)
    xs = [values(p)[i][0] for i in range(6)]
    assert xs == sorted(xs) or xs == sorted(xs, reverse=True)
    f = X.forest_fire_scores(adjacency({0: [1], 1: [2], 2: [0]}), burn_ratio=2)
    assert max(values(f, "eid").values()) == 1.0


def test_snapshots_and_files(example, spark, tmp_path):
    from weftgraph.sources import readers as R
    from weftgraph.sources import writers as O

    g = S.by_text(example, "gender", "g")
    O.save_snapshot(g, f"file://{tmp_path}/g")
    h = R.read_snapshot(spark, f"file://{tmp_path}/g")
    assert h.vertices.count() == 4 and h.scalars == {"greeting": "Hello world!"} and h.segmentation("g").membership.count() == 4
    flat = example.vertices.select("id", "name", "age")
    for kind in ("json", "orc", "parquet"):
        O.write_structured(flat, kind, f"{tmp_path}/{kind}")
        assert R.read_structured(spark, kind, f"{tmp_path}/{kind}", imported_columns=["name"], sql="select name from this where name like 'A%'").count() == 1
    O.write_csv(flat, f"{tmp_path}/csv", for_download=True)
    assert R.read_csv(spark, f"{tmp_path}/csv", infer=True, limit=3).count() == 3
    assert R.read_csv(spark, f"{tmp_path}/csv", columns=["a", "b", "c"]).count() == 5
    assert R.read_parquet(spark, f"{tmp_path}/parquet", "id: long, name: string").columns == ["id", "name"]
    assert R.read_union_of_snapshots(spark, [f"{tmp_path}/parquet", f"{tmp_path}/parquet"]).count() == 8
    with pytest.raises(ValueError):
        R.read_union_of_snapshots(spark, [f"{tmp_path}/parquet", f"file://{tmp_path}/g/vertices"])
    O.write_hive(flat, "people_t", "overwrite")
    assert R.read_hive(spark, "people_t").count() == 4
    spark.sql("drop table people_t")
    O.compute(g)


def test_math_of_hyperbolic_distance(spark):
    from weftgraph.operators.generate import hyperbolic_distance

    d = spark.range(1).select(hyperbolic_distance(F.lit(5.0), F.lit(0.1), F.lit(6.0), F.lit(0.1 + math.pi)).alias("d")).first().d
    assert abs(d - (11 + 2 * math.log(math.pi / 2))) < 1e-9
