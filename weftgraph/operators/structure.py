"""Structure: reversing, merging, splitting, composing."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.aggregators import aggregate
from ..graph import Graph, Segmentation, clash_free, hashed_id, with_id
from ..runtime import spill
from .direction import symmetric

Specs = Sequence[tuple[str, str]]


def reverse_edges(g: Graph) -> Graph:
    return g.with_edges(g.need_edges().select(*(F.col({"src": "dst", "dst": "src"}.get(c, c)).alias(c) for c in g.edges.columns)))


def add_reversed_edges(g: Graph, marker: str | None = None) -> Graph:
    """Every edge and its reverse (with a new eid); ``marker`` is 0.0 on originals and 1.0 on reversed ones."""
    e = g.need_edges()
    rest = [c for c in e.columns if c not in ("eid", "src", "dst", marker)]
    mark = lambda x: [F.lit(x).alias(marker)] if marker else []
    there = e.select("eid", "src", "dst", *rest, *mark(0.0))
    back = e.select(hashed_id(F.lit("reversed"), "eid").alias("eid"), F.col("dst").alias("src"), F.col("src").alias("dst"), *rest, *mark(1.0))
    return g.with_edges(there.unionByName(back))


def merge_parallel_edges(g: Graph, specs: Specs = (), by: str | None = None, prefix: str = "", suffix: bool = True) -> Graph:
    """One edge for each (src, dst), or (src, dst, ``by``) where ``by`` is defined; its eid is the smallest merged."""
    keys = ["src", "dst"] + ([by] if by else [])
    e = g.need_edges()
    e = e.where(F.col(by).isNotNull()) if by else e
    merged = aggregate(e, keys, specs, prefix=prefix, suffix=suffix, also=[F.min("eid").alias("eid")])
    return g.with_edges(merged.select("eid", "src", "dst", *(c for c in merged.columns if c not in ("eid", "src", "dst"))))


def merge_vertices(g: Graph, key: str, specs: Specs = (), prefix: str = "", suffix: bool = True) -> Graph:
    """One vertex for each defined value of ``key``, with the smallest merged id; edges and segment links are re-pointed, none merged."""
    v = g.vertices.where(F.col(key).isNotNull())
    merged = aggregate(v, [key], specs, prefix=prefix, suffix=suffix, also=[F.min("id").alias("new_id")])
    lead = v.select("id", key).join(v.groupBy(key).agg(F.min("id").alias("new_id")), key).select("id", "new_id")
    edges = g.edges
    if edges is not None:
        for end in ("src", "dst"):
            edges = edges.join(lead.withColumnsRenamed({"id": end}), end).drop(end).withColumnRenamed("new_id", end)
        edges = edges.select(*g.edges.columns)
    segs = {n: replace(s, membership=s.membership.join(lead.withColumnRenamed("id", "vid"), "vid").select(F.col("new_id").alias("vid"), "sid")) for n, s in g.segmentations.items()}
    return replace(g, vertices=merged.withColumnRenamed("new_id", "id").select("id", *(c for c in merged.columns if c != "new_id")), edges=edges, segmentations=segs)


def two_hops(e: DataFrame, ab: list[str], bc: list[str]) -> DataFrame:
    """All a->b->c, an edge joined to every edge that begins where it ends: src, mid, dst, ab_eid, bc_eid, ab_*, bc_*."""
    first = e.select(F.col("src"), F.col("dst").alias("mid"), F.col("eid").alias("ab_eid"), *(F.col(c).alias(f"ab_{c}") for c in ab))
    second = e.select(F.col("src").alias("mid"), F.col("dst"), F.col("eid").alias("bc_eid"), *(F.col(c).alias(f"bc_{c}") for c in bc))
    return first.join(second, "mid")


def triadic_closure(g: Graph) -> Graph:
    """a->b and b->c give a->c, as many as there are such pairs, with attributes ``ab_*`` and ``bc_*``."""
    names = g.edge_attributes
    hops = two_hops(g.need_edges(), names, names)
    return g.with_edges(hops.select(hashed_id("ab_eid", "bc_eid").alias("eid"), "src", "dst", *(f"ab_{c}" for c in names), *(f"bc_{c}" for c in names)))


def edge_graph(g: Graph) -> Graph:
    """Line graph: edges become vertices, linked where one ends and the other begins."""
    hops = two_hops(g.need_edges(), [], [])
    return Graph(g.edges.drop("src", "dst").withColumnRenamed("eid", "id"), hops.select(hashed_id("ab_eid", "bc_eid").alias("eid"), F.col("ab_eid").alias("src"), F.col("bc_eid").alias("dst")), g.scalars)


def split_vertices(g: Graph, repeat: str, index: str = "index") -> Graph:
    """Each vertex trunc(``repeat``) times (none if below 1), numbered from 0; edges and links go to all copies."""
    copies = _copies(g.vertices, repeat, index)
    more = spill(copies.where(F.col(index) > 0).select("id", index))
    copies = with_id(copies, ["id", index], clash_free(more, ["id", index], g.vertices), "_new").withColumn("_new", F.when(F.col(index) == 0, F.col("id")).otherwise(F.col("_new")))
    lead = copies.select("id", "_new")
    edges = g.edges
    if edges is not None:
        cols = edges.columns
        for end in ("src", "dst"):
            edges = edges.join(lead.withColumnsRenamed({"id": end, "_new": f"_{end}"}), end)
        edges = edges.withColumn("eid", F.when((F.col("src") == F.col("_src")) & (F.col("dst") == F.col("_dst")), F.col("eid")).otherwise(hashed_id("eid", "_src", "_dst"))).drop("src", "dst").withColumnsRenamed({"_src": "src", "_dst": "dst"}).select(*cols)
    segs = {n: replace(s, membership=s.membership.join(lead.withColumnRenamed("id", "vid"), "vid").select(F.col("_new").alias("vid"), "sid")) for n, s in g.segmentations.items()}
    return replace(g, vertices=copies.drop("id").withColumnRenamed("_new", "id").select(*g.vertices.columns, index), edges=edges, segmentations=segs)


def split_edges(g: Graph, repeat: str, index: str = "index") -> Graph:
    copies = _copies(g.need_edges(), repeat, index)
    return g.with_edges(copies.withColumn("eid", F.when(F.col(index) == 0, F.col("eid")).otherwise(hashed_id("eid", index))))


def _copies(df: DataFrame, repeat: str, index: str) -> DataFrame:
    n = F.floor(F.col(repeat)).cast("int")
    return df.where(n >= 1).withColumn(index, F.explode(F.sequence(F.lit(0), n - 1))).withColumn(index, F.col(index).cast("double"))


def strip_duplicate_edges(g: Graph) -> Graph:
    """One edge for each (src, dst): the one of smallest eid."""
    e = g.need_edges()
    rest = [c for c in e.columns if c not in ("src", "dst")]
    return g.with_edges(e.groupBy("src", "dst").agg(F.min(F.struct(*rest)).alias("_e")).select("_e.eid", "src", "dst", *(f"_e.{c}" for c in rest if c != "eid")))


def remove_non_symmetric_edges(g: Graph) -> Graph:
    """Keep edges that have a reverse."""
    e = g.need_edges()
    back = e.select(F.col("src").alias("dst"), F.col("dst").alias("src")).distinct()
    return g.with_edges(e.join(back, ["src", "dst"], "left_semi").select(*e.columns))


def make_symmetric(g: Graph) -> Graph:
    """min(copies, reversed copies) edges each way; attributes are dropped."""
    e = symmetric(g.need_edges())
    return g.with_edges(e.select(hashed_id("src", "dst", "k").alias("eid"), "src", "dst"))


def concatenate(ab: DataFrame, bc: DataFrame) -> DataFrame:
    """Compose weighted connections: src, dst, weight, summed over all ways."""
    left, right = ab.select("src", F.col("dst").alias("mid"), F.col("weight").alias("_w")), bc.select(F.col("src").alias("mid"), "dst", "weight")
    return left.join(right, "mid").groupBy("src", "dst").agg(F.sum(F.col("_w") * F.col("weight")).alias("weight"))


def concatenate_multi(ab: DataFrame, bc: DataFrame) -> DataFrame:
    """Compose connections without merging: src, dst."""
    return ab.select("src", F.col("dst").alias("mid")).join(bc.select(F.col("src").alias("mid"), "dst"), "mid").select("src", "dst")


def induced_edges(edges: DataFrame, src_map: DataFrame, dst_map: DataFrame) -> DataFrame:
    """Re-point both ends of edges through mappings (id, new): many images give many edges, none gives none."""
    cols = edges.columns
    out = edges.join(src_map.select(F.col("id").alias("src"), F.col("new").alias("_src")), "src").join(dst_map.select(F.col("id").alias("dst"), F.col("new").alias("_dst")), "dst")
    return out.drop("src", "dst").withColumnsRenamed({"_src": "src", "_dst": "dst"}).select(*cols)


def union(a: Graph, b: Graph) -> Graph:
    """Disjoint union. Vertices and edges of ``a`` keep their ids, those of ``b`` get others; same-named attributes must have one type, missing ones
    are undefined. Segmentations of one name that both sides have are united too."""
    for kind in ("vertices", "edges"):
        x, y = getattr(a, kind), getattr(b, kind)
        if x is not None and y is not None:
            left, right = dict(x.dtypes), dict(y.dtypes)
            if clash := sorted(c for c in left.keys() & right.keys() if left[c] != right[c]):
                raise ValueError(f"attributes of different types: {clash}")
    vid = _apart(a.vertices, b.vertices, "id")
    moved = b.vertices.withColumn("id", vid("id"))
    v = a.vertices.unionByName(moved, allowMissingColumns=True)
    e = a.edges
    if b.edges is not None:
        eid = _apart(a.edges, b.edges, "eid") if a.edges is not None else F.col
        ends = b.edges.withColumns({"eid": eid("eid"), "src": vid("src"), "dst": vid("dst")})
        e = ends if e is None else e.unionByName(ends, allowMissingColumns=True)
    segs = dict(a.segmentations)
    for name, s in b.segmentations.items():
        links = s.membership.withColumn("vid", vid("vid"))
        if name in segs:
            mine = segs[name]
            sid = _apart(mine.graph.vertices, s.graph.vertices, "id")
            segs[name] = Segmentation(union(mine.graph, s.graph), mine.membership.unionByName(links.withColumn("sid", sid("sid"))))
        else:
            segs[name] = Segmentation(s.graph, links)
    return Graph(v, e, {**b.scalars, **a.scalars}, segs)


def _apart(a: DataFrame, b: DataFrame, key: str):
    """A one-to-one mapping of ids of ``b`` to int64 that no row of ``a`` has as ``key``: c -> Column.

    Natural keys (none below 0 on either side) become negative. Else ids are permuted pseudo-randomly, with another seed until none meets an id of ``a``: n*n / 2**64
    are expected to meet, so the first does below a billion.
    """
    low = [df.agg(F.min(key)).first()[0] for df in (a, b)]
    if all(x is None or x >= 0 for x in low):
        return lambda c: -F.col(c) - 1
    for seed in range(64):
        way = lambda c, k=seed: permuted(F.col(c), k)
        if not b.select(way(key).alias(key)).join(a.select(key), key, "left_semi").limit(1).count():
            return way
    raise ValueError("no permutation keeps the ids of both sides apart")


def permuted(c: Column, seed: int) -> Column:
    """A pseudo-random permutation of the int64: halves masked by hashes of each other in turn."""
    low = F.lit(0xFFFFFFFF)
    left, right = F.shiftrightunsigned(c, 32), c.bitwiseAND(low)
    for k in range(3):
        left, right = right, left.bitwiseXOR(F.xxhash64(right, F.lit(seed), F.lit(k)).bitwiseAND(low))
    return F.shiftleft(left, 32).bitwiseOR(right)


def rejoin(target: Graph, source: Graph, attributes: Sequence[str] = (), segmentations: Sequence[str] = (), edges: bool = False) -> Graph:
    """Carry attributes, segmentations and edges over from a graph that descends from the same vertices (same ids)."""
    out = target
    if attributes:
        out = out.with_vertex_values(source.vertices.select("id", *attributes))
    ids = out.vertices.select(F.col("id").alias("vid"))
    for n in segmentations:
        s = source.segmentation(n)
        out = out.with_segmentation(n, replace(s, membership=s.membership.join(ids, "vid", "left_semi")))
    if edges:
        out = out.with_edges(source.need_edges()).induced(out.vertices)
    return out


def intersection(a: DataFrame, b: DataFrame) -> DataFrame:
    """Vertices of ``a`` that ``b`` has too."""
    return a.join(b.select("id"), "id", "left_semi")


def loop_edges(v: DataFrame) -> DataFrame:
    return v.select(F.col("id").alias("eid"), F.col("id").alias("src"), F.col("id").alias("dst"))


def empty_edges(g: Graph) -> DataFrame:
    return g.spark.createDataFrame([], "eid bigint, src bigint, dst bigint")


def take_edges_as_vertices(g: Graph) -> Graph:
    from ..plans.views import triplets

    return Graph(triplets(g, ids=True).drop("src", "dst").withColumnRenamed("eid", "id"), None, g.scalars)


def take_segmentation(g: Graph, name: str) -> Graph:
    return g.segmentation(name).graph


def take_segmentation_links(g: Graph, name: str) -> Graph:
    from ..plans.views import belongs_to

    s = g.segmentation(name)
    tagged = replace(s, membership=s.membership)
    view = belongs_to(Graph(g.vertices.withColumn("_vid", F.col("id"))), replace(tagged, graph=s.graph.with_vertices(s.graph.vertices.withColumn("_sid", F.col("id")))))
    return Graph(view.withColumn("id", hashed_id("base__vid", "segment__sid")).drop("base__vid", "segment__sid"), None, g.scalars)
