"""Exact metrics of graphs and segmentations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..graph import Graph, clash_free, with_id
from ..runtime import spill
from .direction import neighbours, pairs


def degree(g: Graph, direction: str = "all edges", name: str = "degree") -> DataFrame:
    """id and number of edges (or neighbours) in the direction, 0.0 where there are none."""
    counted = pairs(g.need_edges(), direction).groupBy(F.col("center").alias("id")).agg(F.count(F.lit(1)).cast("double").alias(name))
    return g.vertices.select("id").join(counted, "id", "left").fillna(0.0, [name])


def simple_pairs(edges: DataFrame, mutual: bool = False) -> DataFrame:
    """Distinct unordered pairs a < b that are linked (in both directions, if ``mutual``)."""
    e = edges.where("src <> dst").select("src", F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"))
    if mutual:
        return e.groupBy("a", "b").agg(F.count_distinct("src").alias("ways")).where("ways = 2").select("a", "b")
    return e.select("a", "b").distinct()


def triangles(edges: DataFrame, mutual: bool = False) -> DataFrame:
    """Each undirected simple triangle once: a < b < c.

    Pairs are oriented from lower to higher degree, so that a hub is nowhere the middle of many candidate pairs: no
    vertex has more than sqrt(2 * pairs) oriented neighbours.
    """
    t = fans(oriented(simple_pairs(edges, mutual)))
    return t.select(F.sort_array(F.array("x", "p", "q")).alias("t")).select(F.col("t")[0].alias("a"), F.col("t")[1].alias("b"), F.col("t")[2].alias("c"))


def oriented(e: DataFrame) -> DataFrame:
    """Pairs (a, b) as x, y from the end of lower (degree, id) to the other."""
    deg = e.select(F.explode(F.array("a", "b")).alias("v")).groupBy("v").agg(F.count(F.lit(1)).alias("d"))
    e = e.join(deg.withColumnsRenamed({"v": "a", "d": "da"}), "a").join(deg.withColumnsRenamed({"v": "b", "d": "db"}), "b")
    up = F.expr("da < db or (da = db and a < b)")
    return e.select(F.when(up, F.col("a")).otherwise(F.col("b")).alias("x"), F.when(up, F.col("b")).otherwise(F.col("a")).alias("y"))


def fans(o: DataFrame) -> DataFrame:
    """Each triangle of oriented pairs once: x, p < q (by id), and which of p and q is the ``middle`` one of the order; x is the first."""
    wedge = o.select("x", F.col("y").alias("p")).join(o.select("x", F.col("y").alias("q")), "x").where("p < q")
    return wedge.join(o.select(F.least("x", "y").alias("p"), F.greatest("x", "y").alias("q"), F.col("x").alias("middle")), ["p", "q"])


def triangle_corners(t: DataFrame) -> DataFrame:
    """Each triangle from each corner: v and the opposite pair p < q."""
    corner = lambda v, p, q: F.struct(F.col(v).alias("v"), F.col(p).alias("p"), F.col(q).alias("q"))
    return t.select(F.inline(F.array(corner("a", "b", "c"), corner("b", "a", "c"), corner("c", "a", "b"))))


def clustering_coefficient(g: Graph, name: str = "clustering_coefficient") -> DataFrame:
    """Share of the ordered pairs of a vertex's neighbours that are linked; 1.0 with at most one neighbour."""
    e = g.need_edges().where("src <> dst").select("src", "dst").distinct()
    ways = e.groupBy(F.least("src", "dst").alias("p"), F.greatest("src", "dst").alias("q")).agg(F.count(F.lit(1)).alias("ways"))
    linked = triangle_corners(triangles(e)).join(ways, ["p", "q"]).groupBy("v").agg(F.sum("ways").alias("k"))
    size = neighbours(e).groupBy(F.col("center").alias("v")).agg(F.count(F.lit(1)).alias("n"))
    out = g.vertices.select(F.col("id").alias("v")).join(size, "v", "left").join(linked, "v", "left")
    value = F.when(F.coalesce("n", F.lit(0)) <= 1, 1.0).otherwise(F.coalesce("k", F.lit(0)) / (F.col("n") * (F.col("n") - 1)))
    return out.select(F.col("v").alias("id"), value.alias(name))


def embeddedness(g: Graph, name: str = "embeddedness") -> DataFrame:
    """Common neighbours of both ends of each edge; undefined where an end has no neighbour but itself."""
    e = g.need_edges().select("eid", F.least("src", "dst").alias("p"), F.greatest("src", "dst").alias("q"))
    common = triangle_corners(triangles(g.edges)).groupBy("p", "q").agg(F.count(F.lit(1)).alias("k"))
    size = neighbours(g.edges).groupBy(F.col("center").alias("p")).agg(F.count(F.lit(1)).alias("n"))
    out = e.join(size, "p", "left").join(common, ["p", "q"], "left")
    other = size.withColumnsRenamed({"p": "q", "n": "m"})
    value = F.when(F.col("n").isNull() | F.col("m").isNull(), None).when(F.col("p") == F.col("q"), F.col("n")).otherwise(F.coalesce("k", F.lit(0)))
    return out.join(other, "q", "left").select("eid", value.cast("double").alias(name))


def dispersion(g: Graph, name: str = "dispersion") -> DataFrame:
    """Pairs of common neighbours of an edge's ends that are neither linked nor share another neighbour of the source; undefined on loops.

    Also ``normalized_``: dispersion ** 0.61 / (embeddedness + 5).
    """
    t = triangle_corners(triangles(g.need_edges()))
    corner = t.select(F.inline(F.array(F.struct(F.col("v").alias("u"), F.col("p").alias("x"), F.col("q").alias("c")), F.struct(F.col("v").alias("u"), F.col("q").alias("x"), F.col("p").alias("c")))))
    # corner: u's neighbours x and c are linked to each other; so c is common to u and x
    both = corner.select("u", F.col("x").alias("v"), F.col("c").alias("a")).join(corner.select("u", F.col("x").alias("v"), F.col("c").alias("b")), ["u", "v"]).where("a < b")
    linked = simple_pairs(g.edges)
    apart = both.join(linked, ["a", "b"], "left_anti")
    via = corner.select("u", F.col("x").alias("a"), F.col("c").alias("w")).join(corner.select("u", F.col("x").alias("b"), F.col("c").alias("w")), ["u", "w"])
    near = apart.join(via, ["u", "a", "b"]).where("w <> v").select("u", "v", "a", "b").distinct()
    counted = apart.join(near, ["u", "v", "a", "b"], "left_anti").groupBy("u", "v").agg(F.count(F.lit(1)).alias("k"))
    e = g.edges.where("src <> dst").select("eid", F.col("src").alias("u"), F.col("dst").alias("v")).join(counted, ["u", "v"], "left")
    e = e.join(embeddedness(g), "eid", "left")
    k = F.coalesce("k", F.lit(0)).cast("double")
    return e.select("eid", k.alias(name), (F.pow(k, F.lit(0.61)) / (F.col("embeddedness") + 5)).alias(f"normalized_{name}"))


def approximate_embeddedness(g: Graph, bits: int = 12, name: str = "embeddedness") -> DataFrame:
    """Common neighbours by inclusion and exclusion of HLL sketches of the neighbourhoods, at least 0; loops are left out."""
    near = neighbours(g.need_edges()).groupBy("center").agg(F.hll_sketch_agg("other", F.lit(bits)).alias("s"))
    e = g.edges.where("src <> dst").select("eid", "src", "dst")
    e = e.join(near.withColumnsRenamed({"center": "src", "s": "a"}), "src").join(near.withColumnsRenamed({"center": "dst", "s": "b"}), "dst")
    size = F.hll_sketch_estimate("a") + F.hll_sketch_estimate("b") - F.hll_sketch_estimate(F.hll_union("a", "b"))
    return e.select("eid", F.greatest(size, F.lit(0)).cast("double").alias(name))


def approximate_clustering_coefficient(g: Graph, bits: int = 12, name: str = "clustering_coefficient") -> DataFrame:
    """The clustering coefficient with |out(u) and N(v)| by HLL sketches; at most 1.0."""
    e = g.need_edges().where("src <> dst").select("src", "dst").distinct()
    near = neighbours(e)
    n = near.groupBy("center").agg(F.hll_sketch_agg("other", F.lit(bits)).alias("s"), F.count(F.lit(1)).alias("n"))
    out = e.groupBy(F.col("src").alias("other")).agg(F.hll_sketch_agg("dst", F.lit(bits)).alias("o"))
    each = near.join(out, "other").join(n.select("center", "s"), "center")
    shared = F.greatest(F.hll_sketch_estimate("o") + F.hll_sketch_estimate("s") - F.hll_sketch_estimate(F.hll_union("o", "s")), F.lit(0))
    linked = each.groupBy("center").agg(F.sum(shared).alias("k"))
    v = g.vertices.select(F.col("id").alias("center")).join(n.select("center", "n"), "center", "left").join(linked, "center", "left")
    value = F.when(F.coalesce("n", F.lit(0)) <= 1, 1.0).otherwise(F.least(F.lit(1.0), F.coalesce("k", F.lit(0)) / (F.col("n") * (F.col("n") - 1))))
    return v.select(F.col("center").alias("id"), value.alias(name))


def _corr(a: str, b: str):
    """Pearson correlation; null where a deviation is zero."""
    return F.try_divide(F.covar_samp(a, b), F.stddev_samp(a) * F.stddev_samp(b))


def correlate(g: Graph, a: str, b: str) -> float:
    """Pearson correlation of two vertex attributes; an error where it is not defined."""
    r = g.vertices.where(F.col(a).isNotNull() & F.col(b).isNotNull()).agg(_corr(a, b)).first()[0]
    if r is None or r != r:
        raise ValueError(f"the correlation of {a} and {b} is not defined")
    return r


def assortativity(g: Graph, attribute: str) -> DataFrame:
    """One row: correlation of the attribute at the source with that at the target, over the edges."""
    v = g.vertices.where(F.col(attribute).isNotNull()).select("id", F.col(attribute).cast("double").alias("x"))
    ends = g.need_edges().select("src", "dst").join(v.withColumnsRenamed({"id": "src", "x": "a"}), "src").join(v.withColumnsRenamed({"id": "dst", "x": "b"}), "dst")
    return ends.agg(_corr("a", "b").alias("assortativity"))


# Segmentations


def _weighted(g: Graph, weight: str | None) -> DataFrame:
    return g.need_edges().select("src", "dst", (F.col(weight) if weight else F.lit(1.0)).alias("w"))


def _labelled(g: Graph, name: str, weight: str | None) -> DataFrame:
    """Edges with the segments of both ends (null outside of all): src, dst, w, s, t."""
    m = g.segmentation(name).membership
    e = _weighted(g, weight)
    return e.join(m.select(F.col("vid").alias("src"), F.col("sid").alias("s")), "src", "left").join(m.select(F.col("vid").alias("dst"), F.col("sid").alias("t")), "dst", "left")


def modularity(g: Graph, name: str, weight: str | None = None) -> DataFrame:
    """One row: sum over segments of w_ss/W - (in_s/W) * (out_s/W)."""
    e = _labelled(g, name, weight)
    flows = e.select("w", F.inline(F.array(F.struct(F.col("s").alias("seg"), F.lit("out").alias("kind")), F.struct(F.col("t").alias("seg"), F.lit("in").alias("kind")), F.struct(F.when(F.col("s") == F.col("t"), F.col("s")).alias("seg"), F.lit("both").alias("kind")))))
    per = flows.where("seg is not null").groupBy("seg").agg(*(F.sum(F.when(F.col("kind") == k, F.col("w")).otherwise(0.0)).alias(k) for k in ("in", "out", "both")))
    total = _weighted(g, weight).agg(F.sum("w")).first()[0] or 0.0
    return per.agg(F.coalesce(F.sum(F.try_divide(F.col("both"), F.lit(total)) - F.try_divide(F.col("in") * F.col("out"), F.lit(total * total))), F.lit(0.0)).alias("modularity"))


def segment_metrics(g: Graph, name: str, weight: str | None = None) -> DataFrame:
    """For each segment of a non-overlapping segmentation: id, size, density, conductance, expansion, hub_dominance, stability.

    density: internal edges over n(n-1)/2 (edges are counted with parallels and both directions). expansion: weight leaving or
    entering. conductance: that over the lesser of the volumes in and outside, a volume being the sum of the
    weighted degrees. hub_dominance: largest internal degree over n-1. stability: share of the members with more
    distinct neighbours inside than outside. Undefined where a divisor is zero.
    """
    s = g.segmentation(name)
    size = s.membership.groupBy("sid").agg(F.count(F.lit(1)).alias("n"))
    e = _labelled(g, name, weight)
    inside = F.coalesce(F.col("s") == F.col("t"), F.lit(False))
    ends = e.select("w", inside.alias("inside"), F.inline(F.array(F.struct(F.col("s").alias("sid"), F.lit(True).alias("first")), F.struct(F.col("t").alias("sid"), F.lit(False).alias("first"))))).where("sid is not null")
    sums = ends.groupBy("sid").agg(
        F.count_if(F.col("inside") & F.col("first")).alias("internal"), F.sum(F.when(~F.col("inside"), F.col("w")).otherwise(0.0)).alias("cut"), F.sum("w").alias("volume"),
    )
    total = 2 * (_weighted(g, weight).agg(F.sum("w")).first()[0] or 0.0)
    m = s.membership
    near = neighbours(g.need_edges()).join(m.select(F.col("vid").alias("center"), "sid"), "center").join(m.select(F.col("vid").alias("other"), F.col("sid").alias("t")), "other", "left")
    per = near.groupBy("sid", "center").agg(F.count_if(F.col("t") == F.col("sid")).alias("k_in"), F.count_if(~F.coalesce(F.col("t") == F.col("sid"), F.lit(False))).alias("k_out"))
    hubs = per.groupBy("sid").agg(F.max("k_in").alias("hub"), F.count_if(F.col("k_in") > F.col("k_out")).alias("stable"))
    x = size.join(sums, "sid", "left").join(hubs, "sid", "left").fillna(0, ["internal", "hub", "stable"]).fillna(0.0, ["cut", "volume"])
    n = F.col("n")
    return x.select(
        F.col("sid").alias("id"), n.cast("double").alias("size"), F.try_divide(F.col("internal"), n * (n - 1) / 2).alias("density"),
        F.try_divide("cut", F.least(F.col("volume"), F.lit(total) - F.col("volume"))).alias("conductance"), F.col("cut").alias("expansion"),
        F.try_divide(F.col("hub"), n - 1).alias("hub_dominance"), (F.col("stable") / n).alias("stability"),
    )


def fragmentation(g: Graph, name: str) -> DataFrame:
    """1 - share of the largest connected component inside each segment: id, fragmentation."""
    from .iterative import connected_components

    s = g.segmentation(name)
    m = s.membership
    inner = g.need_edges().join(m.withColumnsRenamed({"vid": "src", "sid": "s"}), "src").join(m.withColumnsRenamed({"vid": "dst", "sid": "t"}), "dst").where("s = t")
    keys = ["vid", "sid"]
    nodes = spill(m.select(*keys).distinct())
    clashes = clash_free(nodes, keys)
    inner = inner.select(F.col("s").alias("sid"), "src", "dst")
    for end in ("src", "dst"):
        inner = with_id(inner.withColumnRenamed(end, "vid"), keys, clashes, end).drop("vid")
    nodes = with_id(nodes, keys, clashes)
    part = Graph(nodes.select("id", "sid"), inner.select("src", "dst"))
    sizes = nodes.join(connected_components(part), "id").groupBy("sid", "component").agg(F.count(F.lit(1)).alias("k"))
    return sizes.groupBy(F.col("sid").alias("id")).agg((1 - F.max("k") / F.sum("k")).alias("fragmentation"))


def segmentation_scalars(g: Graph, name: str, weight: str | None = None) -> DataFrame:
    """One row: coverage (internal over total weight) and edge_cut (weight crossing segments)."""
    e = _labelled(g, name, weight)
    inside = F.coalesce(F.col("s") == F.col("t"), F.lit(False))
    return e.agg(F.try_divide(F.sum(F.when(inside, F.col("w")).otherwise(0.0)), F.sum("w")).alias("coverage"), F.coalesce(F.sum(F.when(~inside, F.col("w")).otherwise(0.0)), F.lit(0.0)).alias("edge_cut"))


def coverage(g: Graph, name: str) -> DataFrame:
    """One row: vertices in a segment, edges with both ends in a common one."""
    m = g.segmentation(name).membership.distinct()
    e = g.need_edges().join(m.withColumnRenamed("vid", "src"), "src").join(m.withColumnRenamed("vid", "dst"), ["dst", "sid"])
    covered = e.agg(F.count_distinct("eid")).first()[0]
    return m.agg(F.count_distinct("vid").alias("vertices")).withColumn("edges", F.lit(covered))
