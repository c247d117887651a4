"""Parsing with recovery, key statistics under skew, and orphan references."""

import datetime as dt
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from weftgraph.operators import key_stats, orphans
from weftgraph.operators import recovering_csv as csv
from weftgraph.runtime import heavy_keys, split_join, whole_number

COLUMNS = [("country", "string"), ("code", "string"), ("population", "bigint"), ("area", "double"), ("currency", "string")]
GRAMMAR = csv.RecordGrammar(COLUMNS)


@pytest.mark.parametrize(
    ("raw", "want"),
    [
        ("A,B,1,2.5,C", ["A", "B", 1, 2.5, "C"]),
        ('"A, ""x""\nz",B, 12\t,,C', ['A, "x"\nz', "B", 12, None, "C"]),
        ('A,B,"1","2",C', ["A", "B", 1, 2.0, "C"]),
        ("A,B,,,\\", ["A", "B", None, None, "\\"]),
        ('A,B,1,2,"C', "quoting"), ('A"x",B,1,2,C', "quoting"), ('"A"x,B,1,2,C', "quoting"), (' "A",B,1,2,C', "quoting"), ('A,B,1,2,C"', "quoting"), ('"A" ,B,1,2,C', "quoting"),
        ("A,B,1,2", "columns"), ("A,B,1,2,C,", "columns"), ("", "columns"), (None, "columns"),
        ("A,B,x,2,C", "value"), ("A,B,+1,2,C", "value"), ("A,B,1,2.,C", "value"), ("A,B,1,.5,C", "value"), ("A,B,9223372036854775808,2,C", "value"), ("A,B,١,2,C", "value"), ("A,B,1.0,2,C", "value"), ("A,B,1,NaN,C", "value"),
        ("A,B,9223372036854775807,2,C", ["A", "B", 2**63 - 1, 2.0, "C"]), ("A,B,0000000000000000000000001,2,C", ["A", "B", 1, 2.0, "C"]),
        ('"A,B,x', "quoting"),
    ],
)
def test_records(raw, want):
    got = GRAMMAR.parse_record(raw)
    assert (got.reason if isinstance(got, csv.Fault) else got) == want


def test_recovery_in_a_text():
    text = 'A,B,1,2,C\nA,B,1,2,"C\nbroken,too\nD,E,3,4,F\n"G\nH",I,5,6,J'
    got = [(raw, g.reason if isinstance(g, csv.Fault) else g[0]) for _, raw, g in GRAMMAR.parse_text(text)]
    assert got == [("A,B,1,2,C", "A"), ('A,B,1,2,"C', "quoting"), ("broken,too", "columns"), ("D,E,3,4,F", "D"), ('"G\nH",I,5,6,J', "G\nH")]


@given(st.lists(st.lists(st.text(alphabet='ab",\n \\é', max_size=8), min_size=1, max_size=6), max_size=6))
@settings(max_examples=200, deadline=None)
def test_round_trip(rows):
    """What a writer quotes, the grammar reads back, record by record and (where the records are sound) as one text."""
    quote = lambda x: '"' + x.replace('"', '""') + '"'
    for r in rows:
        g = csv.RecordGrammar([(f"c{i}", "string") for i in range(len(r))])
        assert g.parse_record(",".join(map(quote, r))) == r
    same = [r for r in rows if len(r) == 3]
    g = csv.RecordGrammar([("a", "string"), ("b", "string"), ("c", "string")])
    text = "\n".join(",".join(map(quote, r)) for r in same)
    assert [v for _, _, v in g.parse_text(text)] == same


def test_parse_rows(spark):
    rows = [(1, "A,B,1,2,C", "x"), (2, None, "x"), (3, "", None), (3, "", None), (4, "z" * 1_000_000 + ',B,1,2,"', "x"), (5, "A,B,q,2,C", "x")]
    df = spark.createDataFrame(rows, "line_id bigint, raw string, reason string")
    out = csv.parse_rows(df, "raw", COLUMNS, ["line_id"]).collect()
    assert sorted((r.line_id, r.reason) for r in out if r.reason) == [(2, "columns"), (3, "columns"), (3, "columns"), (4, "quoting"), (5, "value")]
    assert next(r.parsed for r in out if r.line_id == 1).asDict() == {"country": "A", "code": "B", "population": 1, "area": 2.0, "currency": "C"}
    assert next(r for r in out if r.line_id == 5).fault_field == 2
    assert csv.parse_rows(df.limit(0), "raw", COLUMNS, ["line_id"]).count() == 0


def test_null_ids_keep_the_others_exact(spark):
    df = spark.createDataFrame([(2**60 + 1, "x"), (None, "y")], "line_id bigint, raw string").coalesce(1)
    assert {(r.line_id, r.parsed.a) for r in csv.parse_rows(df, "raw", [("a", "string")], ["line_id"]).collect()} == {(2**60 + 1, "x"), (None, "y")}


@pytest.mark.parametrize("chunk", [64, 300, 1 << 20])
def test_read_files_in_chunks(spark, tmp_path, chunk):
    """Cutting a file anywhere changes nothing."""
    rng = random.Random(1)
    lines = ["country,code,population,area,currency"]
    for i in range(60):
        kind = rng.random()
        lines.append(f'"Land\n{i}",AB,{i},1.5,C' if kind < 0.3 else f'Land {i},AB,{i},1.5,"C' if kind < 0.4 else f"Land {i},AB,{i},1.5,CUR")
    (tmp_path / "a.csv").write_text("\n".join(lines) + "\n")
    text = (tmp_path / "a.csv").read_text().removesuffix("\n")
    want = sorted((raw, None if isinstance(g, list) else g.reason) for _, raw, g in GRAMMAR.parse_text(text, len(lines[0]) + 1))
    got = sorted((r.raw, r.reason) for r in csv.read_files(spark, f"file://{tmp_path}/a.csv", COLUMNS, chunk_bytes=chunk).collect())
    assert [g for g in got if g[1] is None] == [w for w in want if w[1] is None]
    assert len(got) == len(want)


def test_whole_number(spark):
    df = spark.createDataFrame([(x,) for x in [" 007 ", "\t5.0", "", "  ", None, "5.5", "x", "9223372036854775808", "-3"]], "s string")
    assert [r[0] for r in df.select(whole_number("s")).collect()] == [7, 5, None, None, None, None, None, None, -3]


def edges(spark, rows):
    return key_stats.edges_of(spark.createDataFrame(rows, "edge_id bigint, src string, dst string, endpoint string"))


def test_key_stats(spark):
    rng = random.Random(2)
    rows = [(i, "1" if i % 3 else str(rng.randrange(500)), str(rng.randrange(300)) if i % 7 else " 07 ", "x") for i in range(3000)]
    rows += [(5, rows[5][1], rows[5][2], "x"), (None, "1", None, "x"), (None, "", "7.0", "x")]
    e = edges(spark, rows)
    got = {(r.endpoint, r.vertex_key): (r.edges, r.neighbours) for r in key_stats.endpoint_stats(e).collect()}
    want: dict = {}
    once = {r[0]: r for r in rows if r[0] is not None}
    num = lambda s: int(float(s)) if s and s.strip() else None
    for r in [*once.values(), *(r for r in rows if r[0] is None)]:
        s, t = num(r[1]), num(r[2])
        for name, k, o in (("src", s, t), ("dst", t, s)):
            if k is not None:
                n, near = want.setdefault((name, k), [0, set()])
                want[name, k][0] += 1
                near |= {o} - {None}
    assert got == {k: (n, len(s)) for k, (n, s) in want.items()}
    found = {(r.endpoint, r.vertex_key) for r in key_stats.heavy_vertices(e).collect()}
    totals = {n: sum(v[0] for k, v in want.items() if k[0] == n) for n in ("src", "dst")}
    assert found == {k for k, v in want.items() if v[0] * 100 >= 3 * totals[k[0]]}
    assert key_stats.endpoint_stats(e.limit(0)).count() == 0 and key_stats.heavy_vertices(e.limit(0)).count() == 0
    with pytest.raises(ValueError):
        key_stats.heavy_vertices(e, 0.001)


def test_split_join(spark):
    left = spark.createDataFrame([(1 if i % 2 else i, i) for i in range(400)] + [(None, -1)], "k bigint, v bigint")
    right = spark.createDataFrame([(i, str(i)) for i in range(0, 300)] + [(1, "again")], "k bigint, w string")
    assert heavy_keys(left, ["k"], 0.1)["k"] == [1] or 1 in heavy_keys(left, ["k"], 0.1)["k"]
    for how in ("inner", "left", "left_semi", "left_anti"):
        want = sorted(map(str, left.join(right, ["k"], how).collect()))
        assert sorted(map(str, split_join(left, right, ["k"], how, support=0.1).collect())) == want
    import weftgraph.runtime as runtime

    old, runtime.BROADCAST_ROWS = runtime.BROADCAST_ROWS, 1
    try:
        assert sorted(map(str, split_join(left, right, ["k"], "left", support=0.1).collect())) == sorted(map(str, left.join(right, ["k"], "left").collect()))
    finally:
        runtime.BROADCAST_ROWS = old


def test_orphans(spark):
    rng = random.Random(3)
    day = lambda n: dt.datetime(2024, 1, 1) + dt.timedelta(days=n, seconds=rng.randrange(3) * 43_200)
    vertices = []
    for k in range(40):
        for _ in range(rng.choice([0, 1, 1, 2, 4])):
            a = day(rng.randrange(200))
            b = rng.choice([None, a, a - dt.timedelta(days=3), day(rng.randrange(300)), a + dt.timedelta(days=31)])
            vertices += [(k * 10**12, a, b, "x")] * rng.choice([1, 1, 2])
    vertices += [(None, day(1), None, "x"), (77, None, None, "x"), (78, dt.datetime(2024, 2, 1), dt.datetime(2024, 3, 1), "x"), (78, dt.datetime(2024, 3, 1), None, "x")]
    refs = [(i, rng.choice([*range(45), None]), rng.choice(range(45)), day(rng.randrange(300))) for i in range(500)]
    refs = [(i, None if s is None else s * 10**12, d * 10**12, t) for i, s, d, t in refs]
    refs += [refs[0][:3] + (refs[0][3] + dt.timedelta(days=90),), (900, 77, 78, dt.datetime(2024, 2, 1)), (901, 78, 78, dt.datetime(2024, 1, 31)), (902, 78, 1, None), (903, 78, 78, dt.datetime(2024, 3, 1))]
    v = spark.createDataFrame(vertices, "vertexId bigint, loaded_at timestamp_ntz, deleted_at timestamp_ntz, kind string")
    e = spark.createDataFrame(refs, "edge_id bigint, srcVertexId bigint, dstVertexId bigint, loaded_at timestamp_ntz").withColumn("period", F.lit("clash"))
    got = {tuple(r) for r in orphans.orphan_references(orphans.references(e, "t"), v).collect()}
    once: dict = {}
    for i, s, d, t in refs:
        if t is not None and (i not in once or t < once[i][2]):
            once[i] = (s, d, t)
    want = set()
    for i, (s, d, t) in once.items():
        for name, k in (("src", s), ("dst", d)):
            rows = [x for x in vertices if x[0] == k]
            if k is None or any(x[1] and x[1] <= t and (x[2] is None or t < x[2]) for x in rows):
                continue
            kind = "missing" if not rows else "deleted" if any(x[1] and x[1] <= t for x in rows) else "late"
            want.add(("t", i, name, kind, t.strftime("%Y-%m")))
    assert got == want
    assert {r.kind for r in orphans.orphan_references(orphans.references(e, "t"), v.limit(0)).collect()} == {"missing"}
    assert orphans.orphan_references(orphans.references(e.limit(0), "t"), v).count() == 0
    assert orphans.orphan_counts(orphans.orphan_references(orphans.references(e, "t"), v)).agg(F.sum("n")).first()[0] == len(want)


def test_intervals_are_merged(spark):
    t = lambda d: dt.datetime(2024, 1, d)
    v = spark.createDataFrame([(1, t(1), t(3)), (1, t(1), t(3)), (1, t(2), t(5)), (1, t(5), t(6)), (1, t(8), None), (1, t(9), t(10)), (2, t(4), t(4))], "vertexId bigint, loaded_at timestamp_ntz, deleted_at timestamp_ntz")
    assert sorted((r.key, r.a.day, r.b and r.b.day) for r in orphans.intervals_in_force(v).collect()) == [(1, 1, 6), (1, 8, None)]


@given(st.lists(st.integers(0, orphans.RANGE_BITS - 1), max_size=60), st.lists(st.integers(0, orphans.RANGE_BITS - 1), max_size=60), st.booleans(), st.booleans())
@settings(max_examples=100, deadline=None)
def test_compressed_bitmaps(a, b, wide_a, wide_b):
    """Arrays and bits of any size give what sets give."""
    x = set(a) | (set(range(0, orphans.RANGE_BITS, 7)) if wide_a else set())
    y = set(b) | (set(range(0, orphans.RANGE_BITS, 5)) if wide_b else set())
    p, q = (orphans.bitmap(np.array(sorted(s), np.int64)) for s in (x, y))
    assert set(orphans.positions_of(orphans.and_not(p, q)).tolist()) == x - y
    assert set(orphans.positions_of(orphans.or_(p, q)).tolist()) == x | y
    for c in (p, q, orphans.and_not(p, q), orphans.or_(p, q)):
        assert c.nbytes <= orphans.RANGE_BITS // 8


def test_orphans_of_a_hot_key_with_many_intervals(spark):
    """One key has half of the references and many intervals within a month: as brute force says, and no row grows with the pairs."""
    from datetime import datetime, timedelta

    t0, rng = datetime(2024, 3, 1), random.Random(2)
    v = [(7, t0 + timedelta(hours=2 * i), t0 + timedelta(hours=2 * i + 1)) for i in range(300)] + [(k, t0 + timedelta(days=k), None if k % 2 else t0 + timedelta(days=40)) for k in range(20, 40)]
    e = [(i, 7 if i % 2 else rng.randrange(60), None, t0 + timedelta(minutes=rng.randrange(90 * 1440))) for i in range(800)]
    refs = orphans.references(spark.createDataFrame(e, "edge_id bigint, srcVertexId bigint, dstVertexId bigint, loaded_at timestamp_ntz"), "t")
    vertices = spark.createDataFrame(v, "vertexId bigint, loaded_at timestamp_ntz, deleted_at timestamp_ntz")
    got = {(r.edge_id, r.kind, r.period) for r in orphans.orphan_references(refs, vertices).collect()}
    want = set()
    for i, k, _, at in e:
        mine = [x for x in v if x[0] == k]
        if not any(a <= at and (b is None or at < b) for _, a, b in mine):
            want.add((i, "missing" if not mine else "deleted" if any(a <= at for _, a, b in mine) else "late", at.strftime("%Y-%m")))
    assert got == want and len(want) > 200
