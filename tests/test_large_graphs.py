"""What once failed on large graphs, at its smallest."""

import random
import tracemalloc
from collections import Counter
from itertools import combinations

import pyarrow as pa
import pytest
from pyspark.sql import DataFrame

from weftgraph.operators import communities, iterative, learn, matching
from weftgraph.queries import more_queries


def cliques_of(edges, least):
    """All maximal cliques, by trying every vertex that could join."""
    near = {}
    for a, b in edges:
        if a != b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    found, todo = set(), [(frozenset(), frozenset(near))]
    seen = set()
    while todo:
        r, p = todo.pop()
        if not p and len(r) >= least:
            found.add(tuple(sorted(r)))
        for v in p:
            if (more := r | {v}) not in seen:
                seen.add(more)
                todo.append((more, p & near[v]))
    return found


@pytest.mark.parametrize("least", [2, 3, 4])
@pytest.mark.parametrize("block", [3, 1 << 20])
def test_maximal_cliques_of_a_dense_graph(spark, monkeypatch, least, block):
    monkeypatch.setattr(communities, "BLOCK", block, raising=False)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")  # a vertex spans several batches
    try:
        rng = random.Random(3)
        edges = [(rng.randrange(18) * 10, rng.randrange(18) * 10) for _ in range(150)] + [(500, x * 10) for x in range(18)] + [(500, 600), (600, 700)]
        e = spark.createDataFrame([(k, *x) for k, x in enumerate(edges)], "eid bigint, src bigint, dst bigint")
        got = [tuple(r.members) for r in communities.maximal_cliques(e, least=least).collect()]
        assert len(got) == len(set(got)) and set(got) == cliques_of(edges, least)
        assert max(map(len, got)) > 4
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


@pytest.mark.parametrize("earlier", [0, 5000])
def test_many_cliques_of_one_vertex_are_not_held_together(earlier):
    """3 ** 9 cliques with one first member, against which a batch of 5,000 earlier neighbours is tested."""
    core = [(i, j) for i in range(27) for j in range(i + 1, 27) if i // 3 != j // 3]
    rows = [(99, None, i, j) for i, j in core] + [(99, 1000 + w, p, None) for w in range(earlier) for p in core[w % len(core)]]
    batches = [pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows[i : i + 10000])], names=["at", "w", "p", "q"]) for i in range(0, len(rows), 10000)]
    tracemalloc.start()
    try:
        got = sum(b.num_rows for b in communities._first_cliques(3)(iter(batches)))
        assert got == 3**9 and tracemalloc.get_traced_memory()[1] < 50e6
    finally:
        tracemalloc.stop()


@pytest.mark.parametrize("block", [3, 40, 1 << 20])
@pytest.mark.parametrize("pivots", [0, 64])
def test_earlier_neighbours_in_the_file_leave_out_the_same_cliques(monkeypatch, block, pivots):
    monkeypatch.setattr(communities, "BLOCK", block)
    monkeypatch.setattr(communities, "PIVOTS", pivots)
    rng = random.Random(9)
    links = sorted({(i, j) for i, j in ((rng.randrange(20), rng.randrange(20)) for _ in range(150)) if i < j})
    near = {w: set(rng.sample(range(20), rng.randrange(1, 6))) for w in range(100, 160)}
    rows = [(99, None, *x) for x in links] + [(99, w, p, None) for w in near for p in near[w]]
    batches = [pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows[i : i + 7])], names=["at", "w", "p", "q"]) for i in range(0, len(rows), 7)]
    got = [tuple(x) for b in communities._first_cliques(3)(iter(batches)) for x in b.column(0).to_pylist()]
    want = {(*c, 99) for c in cliques_of(links, 2) if not any(near[w] >= {*c} for w in near)}
    assert len(got) == len(set(got)) and set(got) == want
    assert len(want) < len(cliques_of(links, 2))


def test_no_row_of_the_clique_search_holds_a_hubs_neighbours(spark, monkeypatch):
    """A hub of 300 rays, half of them linked in pairs: what goes to Python has numbers only, no lists of neighbours or links."""
    edges = [(0, i) for i in range(1, 301)] + [(i, i + 1) for i in range(1, 150, 2)]
    e = spark.createDataFrame([(k, *x) for k, x in enumerate(edges)], "eid bigint, src bigint, dst bigint")
    kinds = []
    for name in ("mapInArrow", "mapInPandas"):
        whole = getattr(type(e), name)
        monkeypatch.setattr(type(e), name, lambda self, *a, _whole=whole, **k: kinds.append([f.dataType.typeName() for f in self.schema.fields]) or _whole(self, *a, **k))
    got = {tuple(r.members) for r in communities.maximal_cliques(e).collect()}
    assert got == {(0, i, i + 1) for i in range(1, 150, 2)}
    assert kinds and all(kind == "long" for k in kinds for kind in k)


@pytest.mark.parametrize("threshold", [0.3, 0.6, 0.9])
@pytest.mark.parametrize("most", [0, 4, 500])
def test_links_of_overlapping_cliques_have_the_components_of_all_pairs(spark, threshold, most):
    rng = random.Random(8)
    members = {k: rng.sample(range(14), rng.choice([3, 3, 4, 5, 7, 9])) for k in range(40)}
    m = spark.createDataFrame([(k, v, float(len(x))) for k, x in members.items() for v in x], "sid bigint, vid bigint, size double")

    def components(links):
        label = {k: k for k in members}
        for _ in members:
            for a, b in links:
                label[a] = label[b] = min(label[a], label[b])
        return label

    size = {k: len(x) for k, x in members.items()}
    all_pairs = [(a, b) for a, b in combinations(members, 2) if len({*members[a]} & {*members[b]}) >= communities._least_shared(size[a], size[b], threshold)]
    got = [(r.src, r.dst) for r in communities._overlap_links(m, threshold, most).collect()]
    assert components(got) == components(all_pairs)


def test_cliques_of_one_edge_are_not_linked_each_to_each(spark):
    """100 triangles on one edge: 4,950 pairs share enough, but a few links say so."""
    m = spark.createDataFrame([(k, v, 3.0) for k in range(100) for v in (1000, 1001, k)], "sid bigint, vid bigint, size double")
    assert 99 <= communities._overlap_links(m, 0.6).count() < 300


def test_cliques_by_size_of_people_with_a_hub(spark, tmp_path, monkeypatch):
    """Only rows of numbers go to Python for the query, and the counts are those of a plain search."""
    rng = random.Random(6)
    edges = [(0, i) for i in range(1, 41)] + [(rng.randrange(1, 25), rng.randrange(1, 25)) for _ in range(120)]
    spark.createDataFrame([(i, f"p{i}", i) for i in range(41)], "vertexId bigint, name string, age int").write.parquet(f"{tmp_path}/testgraph_vertices.parquet")
    spark.createDataFrame([(k, a, b, "") for k, (a, b) in enumerate(edges)], "edge_id bigint, srcVertexId bigint, dstVertexId bigint, comment string").write.parquet(f"{tmp_path}/testgraph_edges.parquet")
    monkeypatch.setattr(DataFrame, "mapInPandas", lambda *a: pytest.fail("lists in rows"))
    got = {r.size: r.n for r in more_queries.maximal_cliques_by_size(spark, str(tmp_path)).collect()}
    assert got == Counter(map(len, cliques_of(edges, 3)))


@pytest.mark.parametrize("in_memory", [0, 10**6])
def test_a_fire_lights_as_many_neighbours_as_the_probability_says(spark, adjacency, in_memory):
    """Fires at spread 0.9 light 9 neighbours a vertex on average: in a ring of links to the next 40 vertices, so all but a few vertices burn."""
    n = 200
    g = adjacency({i: [(i + j) % n for j in range(1, 41)] for i in range(n)})
    seen = []
    whole = matching.together
    try:
        matching.together = lambda x: seen.append(whole(x).toPandas()) or whole(x)
        matching.forest_fire_scores(g, 0.9, 0.5, seed=2, in_memory=in_memory).count()
    finally:
        matching.together = whole
    fires = [len(x[x.eid.notna()]) / x.fire.nunique() for x in seen if x.eid.notna().any()]
    assert max(fires) > 0.9 * n
    assert all(not x.dropna().duplicated(["fire", "at"]).any() for x in seen)


def reaches(n, links, most):
    """For each vertex and hop count the number of vertices that reach it."""
    near = {i: {a for a, b in links if b == i} for i in range(n)}
    out = {}
    for v in range(n):
        seen = {v}
        for d in range(most + 1):
            out[v, d] = len(seen)
            seen = seen.union(*(near[x] for x in seen))
    return out


@pytest.mark.parametrize("numbers", [1 << 10, 1 << 26])
def test_reach_by_registers_writes_no_sketches(spark, adjacency, monkeypatch, numbers):
    monkeypatch.setattr(iterative, "REACH_LEAST", 1, raising=False)
    monkeypatch.setattr(iterative, "REACH_NUMBERS", numbers, raising=False)
    monkeypatch.setattr(iterative, "REACH_BLOCK", 1 << 13, raising=False)
    written, spill = [], iterative.spill
    monkeypatch.setattr(iterative, "spill", lambda df, **k: written.append(df.dtypes) or spill(df, **k))
    rng = random.Random(1)
    n = 300
    links = {(rng.randrange(n - 1), rng.randrange(n - 1)) for _ in range(500)}
    g = adjacency({i: sorted(b for a, b in links if a == i) for i in range(n)})
    got = {(r.id, r.d): r.size for r in iterative._reach(g, "incoming edges", 6, 12).collect()}
    want = reaches(n, links, 6)
    alone = {v for v in range(n) if (v, 1) not in got}
    assert n - 1 in alone and all(want[v, 6] == 1 for v in alone)
    assert {v for v, _ in got} == set(range(n))
    assert all(abs(s - want[k]) <= 3 + 0.05 * want[k] for k, s in got.items())
    assert max(want.values()) > 60
    assert not any(kind == "binary" for dtypes in written for _, kind in dtypes)


def test_sketches_of_a_hop_are_deleted_after_the_next(spark, adjacency, monkeypatch):
    dropped, drop = [], iterative.drop
    monkeypatch.setattr(iterative, "drop", lambda df: dropped.append(df.columns) or drop(df))
    g = adjacency({i: [i + 1] if i < 7 else [] for i in range(8)})
    got = {(r.id, r.d): r.size for r in iterative._reach(g, "incoming edges", 4, 12).collect()}
    assert got[7, 4] == 5 and got[0, 4] == 1
    assert dropped.count(["id", "s"]) == 5


def test_embedding_is_learned_in_parts_and_walks_move_once(spark, adjacency, monkeypatch):
    parts, written, spill = [], [], learn.spill
    whole = learn.Word2Vec
    monkeypatch.setattr(learn, "Word2Vec", lambda **k: parts.append(k.get("numPartitions", 1)) or whole(**k))
    monkeypatch.setattr(learn, "spill", lambda df: written.append(df.columns) or spill(df))
    g = adjacency({0: [1, 2], 1: [2], 2: [], 3: []})
    e = {r.id: r.embedding for r in learn.embed_vertices(g, 1, 8, 5, 3, 3).collect()}
    assert set(e) == {0, 1, 2, 3} and all(len(x) == 8 for x in e.values())
    assert parts == [spark.sparkContext.defaultParallelism] and parts[0] > 1
    assert sum("walk" in c for c in written) == 1
    walks = sorted((r.walk for r in learn.random_walks(g, 5, 2, 1).collect()), key=len)
    assert [len(w) for w in walks] == [1, 1] + [5] * 6 and walks[0] == ["3"]
