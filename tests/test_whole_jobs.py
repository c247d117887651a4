"""Registered queries over small tables of their own: that they do the whole job, not a part of it."""

import heapq
import random
from collections import Counter, deque

import pytest

from weftgraph.operators import iterative, key_stats, matching
from weftgraph.queries import graph_queries as Q
from weftgraph.queries import pipeline_queries as P


@pytest.fixture
def people_dir(spark, tmp_path):
    """A folder with the tables of ``people()``, from (edge id, source, destination) rows."""

    def write(n, edges):
        v = spark.createDataFrame([(i, f"p{i}", i) for i in range(n)], "vertexId bigint, name string, age int")
        e = spark.createDataFrame([(k, a, b, "") for k, a, b in edges], "edge_id bigint, srcVertexId bigint, dstVertexId bigint, comment string")
        v.write.parquet(f"{tmp_path}/testgraph_vertices.parquet")
        e.write.parquet(f"{tmp_path}/testgraph_edges.parquet")
        return str(tmp_path)

    return write


def hops(n, edges, start):
    """Breadth-first distances against the edges' direction."""
    near = {i: [] for i in range(n)}
    for _, a, b in edges:
        near[b].append(a)
    d, todo = {start: 0}, deque([start])
    while todo:
        x = todo.popleft()
        for y in near[x]:
            if y not in d:
                d[y] = d[x] + 1
                todo.append(y)
    return d


def test_sketched_harmonic_centrality_counts_ten_hops(spark, people_dir):
    rng = random.Random(4)
    edges = [(i, i, i + 1) for i in range(19)]
    edges += [(19 + i, rng.randrange(15), 20 + i) for i in range(10)]
    d = people_dir(30, edges)
    got = {r.id: r.centrality for r in Q.harmonic_centrality_sketched(spark, d).collect()}
    for v in range(30):
        want = sum(1 / x for x in hops(30, edges, v).values() if 0 < x <= 10)
        assert got[v] == pytest.approx(want, rel=0.02), v


def dijkstra(n, edges, starts):
    out = {i: [] for i in range(n)}
    for k, a, b in edges:
        out[a].append((b, k % 7 + 1.0))
    d, todo = {}, [(0.0, s) for s in starts]
    while todo:
        x, at = heapq.heappop(todo)
        if at not in d:
            d[at] = x
            for to, w in out[at]:
                heapq.heappush(todo, (x + w, to))
    return d


def test_shortest_paths_of_any_number_of_edges(spark, people_dir):
    rng = random.Random(5)
    edges = [(7 * i, i, i + 1) for i in range(25)]
    edges += [(7 * i + 6, rng.randrange(60), rng.randrange(60)) for i in range(60)]
    d = people_dir(60, edges)
    got = {r.id: r.distance for r in Q.shortest_path_to_fixpoint(spark, d).collect()}
    want = dijkstra(60, edges, [0, 50])
    assert got == want and max(want.values()) > 10
    few = {r.id: r.distance for r in Q.shortest_path(spark, d).collect()}
    assert few != want


def test_p3_found_counts_every_key(spark, tmp_path, monkeypatch):
    rng = random.Random(6)
    rows = [(i, str(1 if i % 3 else rng.randrange(500)), str(2 if i % 5 else rng.randrange(500)) if i % 11 else None) for i in range(3000)]
    spark.createDataFrame(rows, "edge_id bigint, src string, dst string").write.parquet(f"{tmp_path}/fingerprint_100_edges.parquet")
    seen = []
    whole = key_stats.endpoint_stats
    monkeypatch.setattr(key_stats, "endpoint_stats", lambda *a: seen.append(whole(*a)) or seen[-1])
    got = {(r.endpoint, r.vertex_key) for r in P.p3_found(spark, str(tmp_path)).collect()}
    n = Counter()
    for _, s, t in rows:
        n["src", int(s)] += 1
        if t is not None:
            n["dst", int(t)] += 1
    totals = {e: sum(x for (f, _), x in n.items() if f == e) for e in ("src", "dst")}
    assert got == {k for k, x in n.items() if x * 100 >= 3 * totals[k[0]]}
    assert len(seen) == 1 and {(r.endpoint, r.vertex_key): r.edges for r in seen[0].collect()} == n


def test_fires_burn_on_until_the_goal(adjacency, monkeypatch):
    """On a path of 60 vertices the goal is met, however many steps and batches of fires that takes."""
    g = adjacency({i: [i + 1] if i < 59 else [] for i in range(60)})
    counted = []
    whole = matching.rows_of
    monkeypatch.setattr(matching, "rows_of", lambda df: counted.append((df.columns, whole(df))) or counted[-1][1])
    f = matching.forest_fire_scores(g, 0.99, 3.0, seed=1)
    assert sum(n for c, n in counted if c == ["fire", "eid", "at"]) >= 3 * 59
    assert f.count() == 59 and f.agg({"forest_fire_score": "max"}).first()[0] == 1.0
    assert {r[1] for r in matching.forest_fire_scores(g, 0.0, 3.0).collect()} == {0.0}


def test_fires_come_in_bounded_batches(adjacency, monkeypatch):
    monkeypatch.setattr(matching, "FIRE_ROWS", 40, raising=False)
    sizes = []
    spill = matching.spill

    def watched(df):
        out = spill(df)
        if out.columns[:1] == ["fire"]:
            sizes.append(out.count())
        return out

    monkeypatch.setattr(matching, "spill", watched)
    g = adjacency({i: [(i + 1) % 30, (i + 7) % 30] for i in range(30)})
    assert matching.forest_fire_scores(g, 0.99, 2.0, seed=1).count() == 60
    assert 0 < max(sizes) <= 120


def test_coloring_leaves_no_vertex_out(spark, people_dir, monkeypatch):
    d = people_dir(3, [(0, 0, 1), (1, 1, 2)])
    assert Q.vertex_coloring(spark, d).first().clashes == 0
    whole = iterative.coloring
    monkeypatch.setattr(iterative, "coloring", lambda g: whole(g).where("id <> 1"))
    assert Q.vertex_coloring(spark, d).first().clashes == 1
