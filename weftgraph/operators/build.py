"""Building graphs from tables, and subgraphs."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.filters import predicate
from ..graph import Graph, clash_free, hashed_id, with_id
from ..runtime import numbered, spill, split_join
from .attributes import uniform
from .direction import in_order


def use_table_as_vertices(df: DataFrame, key: str | None = None) -> Graph:
    """One vertex a row; its id is the integer ``key``, or else a position that is fixed by writing the table once."""
    if key:
        return Graph(df.withColumn("id", F.col(key).cast("bigint")))
    return Graph(spill(df.withColumn("id", F.monotonically_increasing_id())))


def use_table_as_graph(df: DataFrame, src: str, dst: str) -> Graph:
    """One edge a row; vertices are the distinct ends as text (``stringId``). Rows without both ends are dropped.

    Ids are hashes of the text, so that edges need no join; texts whose hashes clash get ids of their own by :func:`clash_free`.
    """
    rows = df.where(F.col(src).isNotNull() & F.col(dst).isNotNull()).select(*(F.col(c).alias(f"edge_{c}" if c in ("eid", "src", "dst") else c) for c in df.columns), F.col(src).cast("string").alias("_src"), F.col(dst).cast("string").alias("_dst"))
    edges = spill(rows.withColumn("eid", F.monotonically_increasing_id()))
    ends = spill(edges.select(F.explode(F.array("_src", "_dst")).alias("stringId")).distinct())
    clashes = clash_free(ends, ["stringId"])
    for end in ("src", "dst"):
        named = clashes if clashes is None else spill(clashes.withColumnRenamed("stringId", f"_{end}"))
        edges = with_id(edges, [f"_{end}"], named, end).drop(f"_{end}")
    return Graph(with_id(ends, ["stringId"], clashes).select("stringId", "id"), edges.select("eid", "src", "dst", *(c for c in rows.columns if c not in ("_src", "_dst"))))


def use_table_as_edges(g: Graph, df: DataFrame, attr: str, src: str, dst: str, eid: str | None = None) -> Graph:
    """Attach edges by ids compared as text; rows without a vertex at both ends are dropped, a repeated vertex key is an error."""
    keys = g.vertices.where(F.col(attr).isNotNull()).select(F.col(attr).cast("string").alias("_key"), "id")
    twice = keys.groupBy("_key").count().where("count > 1").limit(1).collect()
    if twice:
        raise ValueError(f"the vertex key {twice[0][0]!r} is not unique")
    rows = df if eid else spill(df.withColumn("eid", F.monotonically_increasing_id()))
    rows = rows.withColumnRenamed(eid, "eid") if eid else rows
    out = rows
    for column, end in ((src, "_src"), (dst, "_dst")):
        out = out.join(keys.withColumnsRenamed({"_key": f"{end}_key", "id": end}), F.col(column).cast("string") == F.col(f"{end}_key")).drop(f"{end}_key")
    rest = [c for c in df.columns if c not in (src, dst, eid, "eid", "src", "dst")]
    return g.with_edges(out.select("eid", F.col("_src").alias("src"), F.col("_dst").alias("dst"), *rest))


def connect_on_attribute(g: Graph, from_attr: str, to_attr: str) -> Graph:
    """a->b for every pair whose attributes are equal; for one attribute on both sides without loops."""
    left = g.vertices.select(F.col("id").alias("src"), F.col(from_attr).alias("_x"))
    right = g.vertices.select(F.col("id").alias("dst"), F.col(to_attr).alias("_x"))
    out = left.join(right, "_x").drop("_x")
    out = out.where("src <> dst") if from_attr == to_attr else out
    return g.with_edges(out.select(hashed_id("src", "dst").alias("eid"), "src", "dst"))


def create_vertices(spark: SparkSession, size: int) -> Graph:
    return Graph(spark.range(size).withColumn("ordinal", F.col("id").cast("double")))


def example_graph(spark: SparkSession) -> Graph:
    """Four people and four edges (fixed values); two have no income."""
    people = [
        (0, "Adam", 20.3, "Male", 1000.0, [40.71448, -74.00598]),
        (1, "Eve", 18.2, "Female", None, [47.5269674, 19.0323968]),
        (2, "Bob", 50.3, "Male", 2000.0, [1.352083, 103.819836]),
        (3, "Isolated Joe", 2.0, "Male", None, [-33.8674869, 151.2069902]),
    ]
    links = [(0, 0, 1, "Adam loves Eve", 1.0), (1, 1, 0, "Eve loves Adam", 2.0), (2, 2, 0, "Bob envies Adam", 3.0), (3, 2, 1, "Bob loves Eve", 4.0)]
    v = spark.createDataFrame(people, "id bigint, name string, age double, gender string, income double, location array<double>")
    return Graph(v, spark.createDataFrame(links, "eid bigint, src bigint, dst bigint, comment string, weight double"), {"greeting": "Hello world!"})


def enhanced_example_graph(spark: SparkSession) -> Graph:
    """Eight beings and nineteen edges with loops and parallels (fixed values)."""
    singapore = [1.352083, 103.819836]
    beings = [
        (0, "Adam", 20.3, "Male", 1000.0, [40.71448, -74.00598]), (1, "Eve", 18.2, "Female", None, [47.5269674, 19.0323968]), (2, "Bob", 50.3, "Male", None, singapore), (3, "Isolated Joe", 2.0, "Male", 2000.0, [-33.8674869, 151.2069902]),
        (4, "Cat", 12.0, "Female", None, singapore), (5, "Fish", 5.0, "Female", None, singapore), (6, "Mouse", 41.0, "Male", None, singapore), (7, "Wanda", 26.1, "Female", None, [3.1412, 101.68653]),
    ]
    links = [
        (0, 1, "Adam loves Eve"), (1, 0, "Eve loves Adam"), (2, 0, "Bob envies Adam"), (2, 1, "Bob loves Eve"), (2, 2, "Bob hates himself"), (2, 4, "Bob doesn't see the cat"), (2, 5, "Bob owns the fish"), (2, 5, "Bob feeds the fish"),
        (2, 5, "Bob complains to the fish"), (5, 2, "The fish understands Bob"), (5, 2, "The fish helps Bob"), (5, 4, "The fish summons the cat"), (5, 4, "The fish mesmerizes the cat"), (5, 4, "The fish controls the cat"),
        (4, 5, "The cat obeys the fish"), (4, 2, "The cat distracts Bob's attention"), (4, 2, "The cat steals Bob's phone"), (6, 4, "The mouse sees the cat"), (5, 7, "The fish calls Wanda"),
    ]
    v = spark.createDataFrame(beings, "id bigint, name string, age double, gender string, income double, location array<double>")
    e = spark.createDataFrame([(k, a, b, c, float(k)) for k, (a, b, c) in enumerate(links)], "eid bigint, src bigint, dst bigint, comment string, weight double")
    return Graph(v, e, {"greeting": "Hello world! 😀 "})


def karate_club(spark: SparkSession) -> Graph:
    """Zachary's karate club (1977): 34 members and 78 friendships, numbered from 0 (fixed values)."""
    friends = {
        1: (2, 3, 4, 5, 6, 7, 8, 9, 11, 12, 13, 14, 18, 20, 22, 32), 2: (3, 4, 8, 14, 18, 20, 22, 31), 3: (4, 8, 9, 10, 14, 28, 29, 33), 4: (8, 13, 14), 5: (7, 11), 6: (7, 11, 17), 7: (17,),
        9: (31, 33, 34), 10: (34,), 14: (34,), 15: (33, 34), 16: (33, 34), 19: (33, 34), 20: (34,), 21: (33, 34), 23: (33, 34), 24: (26, 28, 30, 33, 34), 25: (26, 28, 32), 26: (32,),
        27: (30, 34), 28: (34,), 29: (32, 34), 30: (33, 34), 31: (33, 34), 32: (33, 34), 33: (34,),
    }
    links = [(a - 1, b - 1) for a, near in friends.items() for b in near]
    return create_vertices(spark, 34).with_edges(spark.createDataFrame([(k, *x) for k, x in enumerate(links)], "eid bigint, src bigint, dst bigint"))


def create_graph_in_python(spark: SparkSession, build: Callable, **scalars: object) -> Graph:
    """A user function giving pandas frames ``vs`` and ``es`` (columns src and dst, positions in vs) on the driver."""
    vs, es = build(**scalars)
    vs, es = vs.copy(), es.copy()
    vs["id"], es["eid"] = range(len(vs)), range(len(es))
    return Graph(spark.createDataFrame(vs), spark.createDataFrame(es), dict(scalars))


def filter_by_attributes(g: Graph, vertices: Mapping[str, str] | None = None, edges: Mapping[str, str] | None = None) -> Graph:
    """Keep vertices and edges that match all filters; edges need both ends."""
    v = g.vertices
    for name, text in (vertices or {}).items():
        v = v.where(predicate(name, v.schema[name].dataType, text))
    out = g.induced(v) if vertices else g
    e = out.edges
    for name, text in (edges or {}).items():
        e = e.where(predicate(name, e.schema[name].dataType, text))
    return out.with_edges(e)


def filter_by_segments(g: Graph, segmentation: str, segments: Mapping[str, str]) -> Graph:
    """Keep vertices that are in a segment matching the filters."""
    s = g.segmentation(segmentation)
    kept = filter_by_attributes(s.graph, segments).vertices.select(F.col("id").alias("sid"))
    ids = s.membership.join(kept, "sid", "left_semi").select(F.col("vid").alias("id")).distinct()
    return g.induced(g.vertices.join(ids, "id", "left_semi"))


def discard_edges(g: Graph) -> Graph:
    return g.with_edges(None)


def discard_loops(g: Graph) -> Graph:
    return g.with_edges(g.need_edges().where("src <> dst"))


def snowball_sample(g: Graph, ratio: float = 0.0001, radius: int = 3, attr: str = "distance_from_start_point", seed: int = 0) -> Graph:
    """Seeds drawn with ``ratio``, and all within ``radius`` hops along the edges; ``attr`` is the distance."""
    from .iterative import shortest_path

    starts = g.vertices.withColumn("_start", F.when(uniform("id", seed) < ratio, F.lit(0.0)))
    reached = shortest_path(g.with_vertices(starts), "_start", None, radius)
    v = g.vertices.join(reached.withColumnRenamed("distance", attr), "id")
    return g.induced(v)


def random_walk_sample(g: Graph, starts: int = 1, walks: int = 10_000, abort: float = 0.15, vertex_attr: str = "first_reached", edge_attr: str = "first_traversed", seed: int = 0) -> Graph:
    """Vertices and edges that random walks meet, with the number of the step that met them first.

    Walk lengths are geometric, at most 2 / ``abort`` steps; a dead end stops a walk. Steps of all walks are counted in
    one sequence, walk after walk.
    """
    if not 0.01 <= abort < 1:
        raise ValueError("the abort probability is in [0.01, 1)")
    most = int(2 / abort)
    points = g.vertices.orderBy(uniform("id", seed), "id").limit(starts).select(F.col("id").alias("at"))
    w = points.withColumn("walk", F.explode(F.sequence(F.lit(1), F.lit(walks)))).select(F.xxhash64("at", "walk").alias("walk"), "at")
    length = F.least(F.floor(F.log(uniform("walk", seed + 1)) / F.log(F.lit(1 - abort))) + 1, F.lit(most))
    w = spill(w.withColumn("length", length).withColumn("step", F.lit(0)))
    ways, degree = in_order(g.need_edges().select(F.col("src").alias("at"), "eid", F.col("dst").alias("to")), "at", "eid")
    trail = [w.select("walk", "step", "at", F.lit(None).cast("bigint").alias("eid"))]
    for step in range(1, most + 1):
        alive = w.where(F.col("length") >= step)
        pick = F.pmod(F.xxhash64("walk", F.lit(step), F.lit(seed)), F.col("d")).cast("int")
        turn = split_join(alive.select("walk", "length", "at"), degree, ["at"]).select("walk", "length", "at", pick.alias("k")).join(ways, ["at", "k"])
        w = spill(turn.select("walk", "length", F.lit(step).alias("step"), F.col("to").alias("at"), "eid"))
        trail.append(w.select("walk", "step", "at", "eid"))
        if not w.limit(1).count():
            break
    steps = trail[0]
    for t in trail[1:]:
        steps = steps.unionByName(t)
    sizes = numbered(steps.groupBy("walk").agg(F.count(F.lit(1)).alias("n")), "walk", "before", "n")
    steps = spill(steps.join(sizes, "walk").withColumn("k", (F.col("before") + F.col("step")).cast("double")))
    v = g.vertices.join(steps.groupBy(F.col("at").alias("id")).agg(F.min("k").alias(vertex_attr)), "id")
    e = g.edges.join(steps.where("eid is not null").groupBy("eid").agg(F.min("k").alias(edge_attr)), "eid")
    return g.with_vertices(v).with_edges(e.select(*g.edges.columns, edge_attr))
