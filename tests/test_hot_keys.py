"""One key with half of the rows, exact settings of what once was capped, and the other ways that large inputs take."""

import json
import random
from collections import Counter
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from weftgraph import Graph, runtime
from weftgraph.functions.sql_functions import rewritten
from weftgraph.graph import Segmentation
from weftgraph.operators import generate, iterative, learn, matching, segment, workflow
from weftgraph.operators.direction import in_order


def star(adjacency, n):
    """A hub linked to all others, which form a ring."""
    return adjacency({0: list(range(1, n)), **{i: [i % (n - 1) + 1] for i in range(1, n)}})


def components(n, edges):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {x: find(x) for x in range(n)}


@pytest.mark.parametrize("last", [0, 10, 10**6])
def test_components_by_contraction(spark, last):
    rng = random.Random(3)
    edges = [(0, i) for i in range(1, 40)] + [(i, i + 1) for i in range(50, 90)] + [(rng.randrange(100, 200), rng.randrange(100, 200)) for _ in range(70)] + [(5, 5)]
    g = Graph(spark.range(200), spark.createDataFrame([(k, a, b) for k, (a, b) in enumerate(edges)], "eid bigint, src bigint, dst bigint"))
    assert {r.id: r.component for r in iterative.connected_components(g, last_links=last).collect()} == components(200, edges)


def test_cores_of_a_hub(adjacency, monkeypatch):
    g = star(adjacency, 40)
    want = {0: 3.0, **{i: 3.0 for i in range(1, 40)}}
    assert {r.id: r.core for r in iterative.k_core(g).collect()} == want
    assert {r.id: r.core for r in iterative.k_core(g, last_links=0).collect()} == want
    monkeypatch.setattr(iterative, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(runtime, "BROADCAST_ROWS", 0)
    assert {r.id: r.core for r in iterative.k_core(g, last_links=0).collect()} == want


def test_cores_by_peeling_and_by_rounds(spark):
    rng = random.Random(11)
    edges = {(rng.randrange(80), rng.randrange(80)) for _ in range(260)} | {(a, b) for a in range(9) for b in range(a)}
    g = Graph(spark.range(90), spark.createDataFrame([(k, a, b) for k, (a, b) in enumerate(edges)], "eid bigint, src bigint, dst bigint"))
    near = {v: {b if a == v else a for a, b in edges if v in (a, b)} - {v} for v in range(90)}
    want, left, k = {}, dict(near), 0
    while left:
        k = max(k, min(len(n & left.keys()) for n in left.values()))
        gone = [v for v, n in left.items() if len(n & left.keys()) <= k]
        want |= {v: float(k) for v in gone}
        left = {v: n for v, n in left.items() if v not in gone}
    for last in (0, 10**6):
        assert {r.id: r.core for r in iterative.k_core(g, last_links=last).collect()} == want


def test_no_row_holds_a_hubs_neighbours(adjacency):
    g = star(adjacency, 60)
    rows, degree = in_order(g.edges.select(F.col("src").alias("at"), F.col("dst").alias("to")), "at", "to")
    assert rows.columns == ["at", "to", "k"] and {r.at: r.d for r in degree.collect()}[0] == 59
    assert sorted(r.k for r in rows.where("at = 0").collect()) == list(range(59))
    walks = [r.walk for r in learn.random_walks(g, 6, 2, 1).collect()]
    linked = {(str(r.src), str(r.dst)) for r in g.edges.collect()}
    assert len(walks) == 120 and all(len(w) == 6 and all((a, b) in linked or (b, a) in linked for a, b in zip(w, w[1:])) for w in walks)
    c = {r.id: r.centrality for r in iterative.k_path_centrality(g, 3, 600, 2).collect()}
    assert max(c, key=c.get) == 0 and len(c) == 60


def segments(spark, links):
    v = spark.createDataFrame([(x,) for x in sorted({v for v, _ in links})], "id bigint")
    s = Graph(spark.createDataFrame([(x,) for x in sorted({s for _, s in links})], "id bigint"))
    return Graph(v, None, {}, {"s": Segmentation(s, spark.createDataFrame(links, "vid bigint, sid bigint"))})


@pytest.mark.parametrize("hot", [1, 1000])
def test_overlaps_with_a_vertex_in_every_segment(spark, monkeypatch, hot):
    monkeypatch.setattr(segment, "HOT_VERTEX", hot)
    rng = random.Random(5)
    links = [(0, s) for s in range(30)] + [(rng.randrange(1, 25), s) for s in range(30) for _ in range(rng.randrange(12))]
    members = {s: {v for v, t in links if t == s} for s in range(30)}
    want = {(a, b): float(len(members[a] & members[b])) for a in members for b in members if a != b and len(members[a] & members[b]) >= 3}
    out = segment.edges_from_overlap(segments(spark, links), "s", 3).segmentation("s").graph.edges.collect()
    assert {(r.src, r.dst): r["Overlap size"] for r in out} == want and want


def test_sampled_pairs_of_a_large_segment(spark):
    links = [(v, 1) for v in range(60)] + [(v, 2) for v in range(0, 60, 2)]
    g = segments(spark, links)
    whole = segment.sample_cooccurrence(g, "s", 1.0, 1).edges.collect()
    shared = Counter((a, b) for s in (1, 2) for a, _ in filter(lambda x: x[1] == s, links) for b, _ in filter(lambda x: x[1] == s, links))
    assert {(r.src, r.dst): r.multiplicity for r in whole} == {k: float(n) for k, n in shared.items()}
    some = segment.sample_cooccurrence(g, "s", 0.1, 1).edges.collect()
    assert abs(len(some) - 360) < 5 * 18 and len({(r.src, r.dst) for r in some}) == len(some)
    assert all(r.multiplicity == shared[r.src, r.dst] for r in some)


def test_sequences_with_gaps_against_brute_force(spark):
    rng = random.Random(9)
    rows = [(1 if rng.random() < 0.5 else rng.randrange(2, 8), float(rng.randrange(0, 60)), rng.choice("abc")) for _ in range(120)]
    events = spark.createDataFrame(rows, "person bigint, t double, loc string")
    people = Graph(events.select(F.col("person").alias("id")).distinct())
    out = segment.by_event_sequence(people, "loc", "t", events, "with gaps", 2, 4.0, 6.0).segmentation("event_sequences")
    got = {(r.vid, tuple(r.locations), r.bucket) for r in out.membership.join(out.graph.vertices.withColumnRenamed("id", "sid"), "sid").collect()}
    want = set()
    for p in {r[0] for r in rows}:
        mine = sorted((t, x) for q, t, x in rows if q == p)
        for o, (t0, _) in enumerate(mine):
            inside = [e for e in mine[o:] if e[0] < t0 + 6]
            want |= {(p, (a[1], b[1]), t0 // 4) for a, b in combinations(inside, 2)}
    assert got == want


def test_all_pairs_are_predicted_if_asked_for(adjacency):
    g = adjacency({i: [(i + 1) % 8] for i in range(8)})
    placed = g.with_vertex_values(generate.hyper_map(g))
    assert generate.predict_hyperbolic_edges(placed.with_edges(None), 1000).edges.count() == 28
    with pytest.raises(ValueError):
        generate.hyper_map(g, most=3)
    with pytest.raises(ValueError):
        learn.reduce_dimensions(g.with_vertices(g.vertices.withColumn("v", F.array(F.lit(1.0), F.lit(2.0)))), "v", 1, "t-SNE", most=3)


def test_weighting_modes_of_fingerprints(spark):
    left = spark.createDataFrame([(1, 10, 1.0), (1, 11, 1.0)], "id bigint, other bigint, w double")
    right = spark.createDataFrame([(2, 10, 1.0), (2, 12, 1.0), (3, 12, 1.0)], "id bigint, other bigint, w double")
    candidates = spark.createDataFrame([(1, 2)], "left bigint, right bigint")
    look = lambda mode: matching.similarities(left, right, candidates, 1, 0.0, 0.0, mode).first().similarity
    # degrees: 10 has 2, 11 has 1, 12 has 2
    assert look("InDegree") == pytest.approx(2 / 5)
    assert look("InverseInDegree") == pytest.approx(0.5 / (0.5 + 1 + 0.5))
    assert look("InverseInDegreeBasedHybrid") == pytest.approx(0.5 / (0.5 + 1 + (1 - 0.5)))


def test_regions_from_a_file(spark, tmp_path):
    square = [[10, 0], [20, 0], [20, 10], [10, 10], [10, 0]]
    (tmp_path / "r.json").write_text(json.dumps({"features": [{"properties": {"n": "A"}, "geometry": {"type": "Polygon", "coordinates": [square]}}, {"properties": {"n": "B"}, "geometry": {"type": "MultiPolygon", "coordinates": [[[[0, 0], [1, 0], [1, 1], [0, 0]]], [[[5, 5], [6, 5], [6, 6], [5, 5]]]]}}]}))
    regions = workflow.read_regions(str(tmp_path / "r.json"), "n")
    assert set(regions) == {"A", "B", "B (2)"} and regions["A"][1] == (0.0, 20.0)
    v = spark.createDataFrame([(1, [5.0, 15.0]), (2, [5.0, 20.05]), (3, [5.0, 21.0]), (4, None)], "id bigint, p array<double>")
    found = workflow.segment_by_region(Graph(v), "p", {"A": regions["A"]}, 10_000.0).segmentation("regions").membership
    assert {r.vid for r in found.collect()} == {1, 2}  # half way up the side, far from its corners
    assert {r.id: r.a for r in workflow.lookup_region(Graph(v), "p", {"A": regions["A"]}, "a").vertices.collect()} == {1: "A", 2: None, 3: None, 4: None}


def test_queries_are_rewritten_outside_of_literals():
    text = rewritten("select hash(a, 'hash(') x, most_common(concat(b, ')')) y, \"hash(\" from t -- hash(\n where c = 'parquet.`x`'")
    assert text == "select weft_hash(a, 'hash(') x, mode() WITHIN GROUP (ORDER BY concat(b, ')') DESC) y, \"hash(\" from t -- hash(\n where c = 'parquet.`x`'"
    with pytest.raises(ValueError):
        rewritten("select * from parquet.`/x`")


def test_written_tables_are_deleted_after_their_scope(spark):
    import os

    with runtime.scratch():
        t = runtime.spill(spark.range(3), n=F.count("id"))
        path = t._weft_path.removeprefix("file://")
        assert t.seen == {"n": 3} and os.path.exists(path)
    assert not os.path.exists(path)


def test_a_wide_side_is_not_broadcast(spark, monkeypatch):
    wide = spark.createDataFrame([(i, "x" * 1000) for i in range(50)], "k bigint, v string")
    assert runtime.fits_broadcast(wide)
    monkeypatch.setattr(runtime, "BROADCAST_BYTES", 20_000)
    assert not runtime.fits_broadcast(wide) and runtime.fits_broadcast(wide.select("k"))
    left = spark.createDataFrame([(0 if i % 2 else i,) for i in range(200)], "k bigint")
    assert runtime.split_join(left, wide, ["k"]).count() == left.join(wide, "k").count()


def test_diameters_by_bounds(spark):
    rng = random.Random(13)
    for n, m, path in ((40, 50, 12), (60, 70, 0), (10, 0, 0)):
        edges = [(rng.randrange(n), rng.randrange(n)) for _ in range(m)] + [(n + i, n + i + 1) for i in range(path)]
        g = Graph(spark.range(n + path + 1), spark.createDataFrame([(k, a, b) for k, (a, b) in enumerate(edges)], "eid bigint, src bigint, dst bigint"))
        near = {v: {b if a == v else a for a, b in edges if v in (a, b)} for v in range(n + path + 1)}
        longest = 0
        for v in near:
            seen, level, d = {v}, {v}, 0
            while level:
                longest, level = max(longest, d), {x for y in level for x in near[y]} - seen
                seen |= level
                d += 1
        assert iterative.diameter(g) == (longest, longest)
        low, high = iterative.diameter(g, 0.5)
        assert low <= longest <= high <= 1.5 * max(low, 1)


def test_mocnik_links_by_each_points_own_reach(spark):
    g = generate.mocnik(spark, 150, 2, 2.0, 4)
    at = {r.id: (r.x, r.y) for r in g.vertices.select("id", generate.uniform("id", 400).alias("x"), generate.uniform("id", 401).alias("y")).collect()}
    far = lambda a, b: ((at[a][0] - at[b][0]) ** 2 + (at[a][1] - at[b][1]) ** 2) ** 0.5
    want = {(a, b) for a in at for r in [2.0 * min(far(a, b) for b in at if b != a)] for b in at if b != a and far(a, b) <= r * (1 + 1e-12)}
    assert {(r.src, r.dst) for r in g.edges.collect()} == want
