"""Cases that once gave wrong rows without an error."""

import pytest
from pyspark.sql import functions as F

from weftgraph import Graph, graph
from weftgraph.functions.aggregators import aggregate
from weftgraph.operators import attributes, build, iterative, segment, structure
from weftgraph.operators import recovering_csv as csv
from weftgraph.operators.direction import pairs


def test_null_keys_are_one_group(spark):
    df = spark.createDataFrame([(None, 2.0, [1.0]), (None, 3.0, None), (1, 4.0, [2.0, 3.0]), (2, None, None)], "k bigint, x double, v array<double>")
    out = aggregate(df, ["k"], [("x", "sum"), ("x", "most_common"), ("x", "median"), ("v", "elementwise_sum")])
    got = {r.k: tuple(r)[1:] for r in out.collect()}
    assert out.count() == 3 and got == {None: (5.0, 3.0, 2.5, [1.0]), 1: (4.0, 4.0, 4.0, [2.0, 3.0]), 2: (None,) * 4}


def test_union_of_hashed_ids(spark):
    df = spark.createDataFrame([("a", "b"), ("b", "c")], "s string, t string")
    g = build.use_table_as_graph(df, "s", "t")
    u = structure.union(structure.union(g, g), g)
    assert u.vertices.count() == 9 and u.vertices.select("id").distinct().count() == 9
    named = u.edges.join(u.vertices.select(F.col("id").alias("src"), "stringId"), "src")
    assert sorted(r.stringId for r in named.collect()) == ["a"] * 3 + ["b"] * 3
    assert u.edges.select("eid").distinct().count() == 6


def test_union_keeps_segmentations_of_one_name(spark, example):
    a = segment.by_text(example, "gender", "s")
    u = structure.union(a, a)
    assert u.segmentation("s").membership.count() == 8 and u.segmentation("s").graph.vertices.count() == 4
    assert u.segmentation("s").membership.join(u.vertices.select(F.col("id").alias("vid")), "vid").count() == 8


def test_ids_whose_hashes_clash(spark, monkeypatch):
    """Hashes of three bits: every vertex still has an id of its own, and the edges find it."""
    monkeypatch.setattr(graph, "hashed_id", lambda *c: F.xxhash64(*c).bitwiseAND(F.lit(7)))
    rows = [(f"v{i}", f"v{i * 7 % 40}") for i in range(40)]
    g = build.use_table_as_graph(spark.createDataFrame(rows, "s string, t string"), "s", "t")
    ids = {r.id: r.stringId for r in g.vertices.collect()}
    assert len(ids) == g.vertices.count() == 40
    assert sorted((ids[r.src], ids[r.dst]) for r in g.edges.collect()) == sorted(rows)
    v = Graph(spark.range(40).withColumn("k", (F.col("id") % 20).cast("string")))
    s = segment.by_text(v, "k").segmentation("bucketing")
    assert s.graph.vertices.select("id").distinct().count() == 20
    assert s.membership.groupBy("sid").count().where("count = 2").count() == 20


def test_weights_on_edges_follow_the_direction(spark):
    v = spark.createDataFrame([(i, float(i)) for i in (1, 2, 3)], "id bigint, x double")
    e = spark.createDataFrame([(0, 1, 2, 5.0), (1, 1, 2, 7.0), (2, 2, 3, 1.0)], "eid bigint, src bigint, dst bigint, w double")
    g = Graph(v, e)
    look = lambda d: {r.id: r[1] for r in attributes.aggregate_on_neighbours(g, d, [("x", "weighted_sum")], "w", "").collect()}
    assert look("incoming edges") == {2: 12.0, 3: 2.0}
    assert look("in-neighbors") == {2: 5.0, 3: 2.0}
    assert look("out-neighbors") == {1: 10.0, 2: 3.0}
    assert look("all neighbors") == {1: 10.0, 2: 5.0 + 3.0, 3: 2.0}
    with pytest.raises(ValueError):
        pairs(e, "symmetric edges", "w")
    with pytest.raises(ValueError):
        iterative.pagerank(g, "w", direction="symmetric neighbors")
    assert {r.id for r in iterative.pagerank(g, "w", direction="in-neighbors").collect()} == {1, 2, 3}


COLUMNS = [("country", "string"), ("code", "string"), ("population", "bigint"), ("area", "double"), ("currency", "string")]


@pytest.mark.parametrize("chunk", [1 << 20, 101, 50])
def test_cuts_damage_no_character(spark, tmp_path, chunk):
    """Accents and broken quotes: the rows do not depend on where the ranges of a file are cut."""
    lines = []
    for i in range(40):
        lines.append([f"Ünïcödé {i},AB,{i},1.5,€", f'"Lánd, {i}\nß",AB,{i},1.5,€', f'"Brökèn {i},AB,{i},1.5,C', f"Ö {i},AB,x,1.5,C"][i % 4])
    (tmp_path / "a.csv").write_bytes(("country,code,population,area,currency\n" + "\n".join(lines) + "\n").encode())
    rows = csv.read_files(spark, f"file://{tmp_path}/a.csv", COLUMNS, chunk_bytes=chunk).collect()
    sound = {r.raw for r in rows if r.reason is None}
    assert sound == {x for i, x in enumerate(lines) if i % 4 < 2}
    assert not any("�" in r.raw for r in rows) and len(rows) == 40
    data = (tmp_path / "a.csv").read_bytes()
    assert all(data[r.offset :].startswith(r.raw.encode()) for r in rows)


def test_an_anchor_inside_a_faulty_record_is_resumed_at():
    g = csv.RecordGrammar(COLUMNS)
    text = '"A,B,1,2,C\nD,E,3,4,F\nG,"H,5,6,J"\nK,L,1,2,M'
    got = [(raw, x.reason if isinstance(x, csv.Fault) else x[0]) for _, raw, x in g.parse_text(text)]
    assert ("D,E,3,4,F", "D") in got and ("K,L,1,2,M", "K") in got and got[0] == ('"A,B,1,2,C', "quoting")
    crlf = "A,B,1,2,C\r\n" + '"A\r\nA",B,1,2,"C"\r\nx\r\n'
    assert [x if isinstance(x, list) else x.reason for _, _, x in g.parse_text(crlf)] == [["A", "B", 1, 2.0, "C"], ["A\r\nA", "B", 1, 2.0, "C"], "columns"]
