"""Random graphs by their invariants, models by what they learn, streams by their windows."""

import math

import pytest
from pyspark.sql import functions as F

from weftgraph import Graph
from weftgraph.operators import attributes as A
from weftgraph.operators import build as B
from weftgraph.operators import generate as N
from weftgraph.operators import iterative as I
from weftgraph.operators import learn as L


def pairs_of(g):
    return [(r.src, r.dst) for r in g.edges.collect()]


def test_erdos_renyi(spark):
    e = pairs_of(N.erdos_renyi(spark, 400, 0.05, 1))
    assert len(set(e)) == len(e) and all(0 <= b < a < 400 for a, b in e)
    want = 0.05 * 400 * 399 / 2
    assert abs(len(e) - want) < 5 * math.sqrt(want)
    assert pairs_of(N.erdos_renyi(spark, 30, 1.0)) and len(pairs_of(N.erdos_renyi(spark, 30, 1.0))) == 435
    assert N.erdos_renyi(spark, 0, 0.5).edges.count() == 0 and N.erdos_renyi(spark, 10, 0.0).edges.count() == 0


def test_clustered(spark):
    e = pairs_of(N.clustered_random(spark, 200, 4, 0.5, 0.01, 1))
    inside = sum(a % 4 == b % 4 for a, b in e)
    assert len(set(e)) == len(e) and abs(inside - 0.5 * 4 * 50 * 49 / 2) < 200 and abs(len(e) - inside - 0.01 * 15_000) < 70


def test_sequential_models(spark):
    g = N.barabasi_albert(spark, 200, 2, 2, 1)
    assert len(pairs_of(g)) == 1 + 2 * 198 and I.connected_components(g).select("component").distinct().count() == 1
    assert len(pairs_of(N.dorogovtsev_mendes(spark, 50, 1))) == 3 + 2 * 47
    for algorithm in ("Havel-Hakimi", "Edge switching"):
        e = pairs_of(N.with_degrees(spark, 40, (1, 2, 3, 4), algorithm, 1))
        deg = [sum(v in p for p in e) for v in range(40)]
        assert deg == [1 + v % 4 for v in range(40)] and len({frozenset(p) for p in e}) == len(e)
    assert 30 < len(pairs_of(N.with_degrees(spark, 100, (1, 2), "Chung-Lu", 1))) < 130
    with pytest.raises(ValueError):
        N.with_degrees(spark, 3, (5,), "Havel-Hakimi")
    g = N.lfr(spark, 300, 6, 20, mixing=0.2, seed=1)
    c = {r.id: r.community for r in g.vertices.collect()}
    e = pairs_of(g)
    assert sum(c[a] == c[b] for a, b in e) / len(e) > 0.6


def test_random_edges(spark):
    g = N.random_edges(B.create_vertices(spark, 500), 6.0, 1)
    assert abs(g.edges.count() - 3000) < 400 and g.edges.select("eid").distinct().count() == g.edges.count()
    g = N.scale_free_edges(B.create_vertices(spark, 200), 3, 1.3, 1)
    n = g.edges.count()
    assert 200 < n < 1200
    d = [r["count"] for r in g.edges.groupBy("dst").count().collect()]
    assert max(d) > 3 * sum(d) / len(d)


def test_geometric(spark):
    g = N.mocnik(spark, 150, 2, 1.5, 1)
    out = {r.src: r["count"] for r in g.edges.groupBy("src").count().collect()}
    assert len(out) == 150 and min(out.values()) >= 1
    g = N.p2p(spark, 300, 3, 5, 0.1, 1)
    assert max(r["count"] for r in g.edges.groupBy("src").count().collect()) <= 5


def test_hyperbolic(spark):
    g = N.hyperbolic_random(spark, 300, 6.0, 3.0, 0.0, 1)
    points = {r.id: (r.radial, r.angular) for r in g.vertices.collect()}
    alpha, R = 1.0, 2 * math.log(300 * 2 / (math.pi * 6.0 * 0.25))

    def dist(a, b):
        (r1, t1), (r2, t2) = points[a], points[b]
        phi = max(math.pi - abs(math.pi - abs(t1 - t2)), 1e-12)
        return max(0.0, r1 + r2 + 2 * math.log(phi / 2))

    want = {(a, b) for a in range(300) for b in range(a + 1, 300) if dist(a, b) <= R}
    assert set(pairs_of(g)) == want and alpha
    out = N.pso_edges(B.create_vertices(spark, 120), seed=1)
    assert out.edges.count() > 100 and set(out.vertices.columns) >= {"radial", "angular"}
    m = N.hyper_map(out.with_vertices(out.vertices.select("id")))
    assert m.count() == 120
    p = N.predict_hyperbolic_edges(out, 15)
    new = p.edges.where("hyperbolic_edge_probability is not null").collect()
    assert len(new) == 15
    coords = {r.id: (r.radial, r.angular) for r in out.vertices.collect()}
    points = coords
    best = sorted(dist(a, b) for a in range(120) for b in range(a + 1, 120))[:15]
    assert sorted(round(dist(r.src, r.dst), 6) for r in new) == [round(x, 6) for x in best]
    assert N.hyperbolic_probability(out).count() == out.edges.count()


@pytest.fixture(scope="module")
def points(spark):
    rows = [(i, float(i % 10), float(i // 10), "big" if i % 10 > 4 else "small", 1.0 if i % 10 > 4 else 0.0) for i in range(100)] + [(100, None, 1.0, "big", 1.0), (101, 9.0, 1.0, None, None)]
    return Graph(spark.createDataFrame(rows, "id bigint, x double, y double, kind string, flag double"))


def test_trees_and_lines(points):
    got = {r.id: r for r in L.classify(points, L.train_decision_tree_classifier(points, "kind", ["x", "y"])).collect()}
    assert len(got) == 101 and got[101].prediction == "big" and got[3].prediction == "small" and got[3].prediction_certainty == 1.0
    got = {r.id: r.prediction for r in L.predict(points, L.train_decision_tree_regressor(points, "flag", ["x"])).collect()}
    assert got[0] == 0.0 and got[101] == 1.0
    got = {r.id: r.prediction for r in L.classify(points, L.train_logistic_regression(points, "flag", ["x"])).collect()}
    assert got[0] == 0.0 and got[9] == 1.0
    g = A.derive(points, "vertices", "z", "3 * x - 2 * y + 1")
    for method in ("Linear regression", "Random forest", "Gradient-boosted trees", "Decision tree"):
        assert L.predict_attribute(g, "z", ["x", "y"], method).count() == 101
    got = {r.id: r.z_prediction for r in L.predict_attribute(g, "z", ["x", "y"]).collect()}
    assert abs(got[25] - (15 - 4 + 1)) < 1e-6
    for method in ("Ridge regression", "Lasso"):
        assert L.predict(g, L.train_linear_regression(g, "z", ["x", "y"], method)).count() == 101
    k = L.classify(points, L.train_kmeans(points, ["x"], 2, seed=1)).groupBy("prediction").count().collect()
    assert len(k) == 2


def test_split_and_dimensions(points, spark):
    s = L.split_train_test(points, "x", 0.3, 1).vertices
    n = s.where("x_test is not null").count()
    assert 15 < n < 45 and s.where("x_test is not null and x_train is not null").count() == 0
    g = A.bundle_vector(points, "v", ["x", "y", "x"])
    assert len(L.reduce_dimensions(g, "v", 2).first().embedding) == 2
    two = Graph(spark.createDataFrame([(i, [float(i % 2) * 50 + i * 0.01, 0.0, 1.0]) for i in range(30)], "id bigint, v array<double>"))
    e = {r.id: r.embedding for r in L.reduce_dimensions(two, "v", 2, "t-SNE", 5).collect()}
    near = sum(math.dist(e[0], e[i]) for i in range(2, 30, 2)) / 14
    far = sum(math.dist(e[0], e[i]) for i in range(1, 30, 2)) / 15
    assert far > near


def test_embeddings(spark, adjacency):
    g = adjacency({0: [1, 2], 1: [2], 2: [3], 3: [4, 5], 4: [5], 5: [], 6: []})
    e = {r.id: r.embedding for r in L.embed_vertices(g, 1, 8, 5, 3, 3).collect()}
    assert len(e) == 7 and all(len(v) == 8 for v in e.values())
    t = Graph(spark.createDataFrame([(1, "a b"), (2, "a b"), (3, "c d e"), (4, None)], "id bigint, t string"))
    e = {r.id: r.embedding for r in L.embed_text(t, "t", 32).collect()}
    assert e[1] == e[2] != e[3] and len(e) == 3
    assert L.embed_text(t, "t", 4, "word2vec").count() == 3
    g = g.with_vertices(g.vertices.selectExpr("id", "array(if(id < 3, 1.0D, 0.0D)) as x", "if(id < 3, 1.0D, 0.0D) as y"))
    m = L.train_graph_convolution(g, "y", "x", 1)
    got = {r.id: r.prediction for r in L.predict_graph_convolution(g, m).collect()}
    assert got[0] == 1.0 and got[5] == 0.0


def test_streams(spark, tmp_path):
    from weftgraph.streaming import windows as S

    rows = spark.range(100).selectExpr("id % 3 as k", "timestamp'2024-01-01 00:00:00' + make_interval(0,0,0,0,0,0, id * 60) as t")
    rows.write.parquet(f"{tmp_path}/in")
    stream = S.stream_parquet(spark, f"{tmp_path}/in", rows.schema)
    for name, out in (("counts", S.windowed_counts(stream, "t", "k", "10 minutes")), ("sessions", S.sessions(stream, "t", "k", "5 minutes")), ("once", S.deduplicated(stream, "t", ["k"]))):
        q = out.writeStream.format("memory").queryName(name).outputMode("append" if name != "counts" else "complete").trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/{name}").start()
        q.awaitTermination(120)
    assert spark.table("counts").agg(F.sum("n")).first()[0] == 100
    assert spark.table("once").count() == 3
    want = S.windowed_counts(rows, "t", "k", "10 minutes").orderBy("start", "k").collect()
    assert spark.table("counts").orderBy("start", "k").collect() == want
