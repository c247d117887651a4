"""Building and using segmentations."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import replace

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..graph import Graph, Segmentation, clash_free, hashed_id, with_id
from ..runtime import spill
from .direction import in_order, pairs

#: Segments of one vertex from which overlaps are looked for by prefixes.
HOT_VERTEX = 1_000


def kept_numbers(rng: np.random.Generator, size: int, p: float) -> np.ndarray:
    """The numbers below ``size`` that are kept with probability p, by geometric skips."""
    if p <= 0:
        return np.zeros(0, np.int64)
    if p > 0.2:
        return np.flatnonzero(rng.random(size) < p)
    at = np.cumsum(rng.geometric(p, int(size * p + 10 * (size * p) ** 0.5 + 20))) - 1
    while at[-1] < size:
        at = np.concatenate([at, at[-1] + np.cumsum(rng.geometric(p, 100))])
    return at[at < size]


def _from_keys(g: Graph, name: str, links: DataFrame, keys: Sequence[str], sizes: bool = False) -> Graph:
    """Segments are the distinct ``keys`` of ``links`` (vid and keys); the keys are their attributes, and their ids are hashes of them without clashes."""
    segments = spill(links.groupBy(*keys).agg(*([F.count(F.lit(1)).cast("double").alias("size")] if sizes else [])) if sizes else links.select(*keys).distinct())
    clashes = clash_free(segments, keys)
    return g.with_segmentation(name, Segmentation(Graph(with_id(segments, keys, clashes).select("id", *segments.columns)), with_id(links, keys, clashes, "sid").select("vid", "sid")))


def from_labels(g: Graph, name: str, labels: DataFrame, extra: bool = True) -> Graph:
    """Segments named by a label: ``labels`` has id and label (an id of a member or a number), one row a vertex."""
    links = labels.select(F.col("id").alias("vid"), F.col("label").alias("sid"))
    segments = links.groupBy("sid").agg(F.count(F.lit(1)).cast("double").alias("size")).withColumnRenamed("sid", "id")
    return g.with_segmentation(name, Segmentation(Graph(segments), links))


def bucket_numbers(x: Column, width: float, overlap: bool) -> Column:
    """The buckets of a number: floor(x / step), with overlap (step = width / 2) also the one before."""
    step = width / 2 if overlap else width
    b = F.floor(x / step)
    return F.array(b - 1, b) if overlap else F.array(b)


def by_number(g: Graph, attr: str, width: float, overlap: bool = False, name: str = "bucketing") -> Graph:
    """Buckets [bottom, top) of a number; undefined values are in none."""
    step = width / 2 if overlap else width
    links = g.vertices.where(F.col(attr).isNotNull()).select(F.col("id").alias("vid"), F.explode(bucket_numbers(F.col(attr), width, overlap)).alias("_b"))
    links = links.select("vid", (F.col("_b") * step).cast("double").alias("bottom"), (F.col("_b") * step + width).cast("double").alias("top"))
    return _from_keys(g, name, links, ["bottom", "top"], True)


def by_interval(g: Graph, begin: str, end: str, width: float, overlap: bool = False, name: str = "bucketing") -> Graph:
    """All buckets that [begin, end] meets; with overlap one before, at half the step."""
    step = width / 2 if overlap else width
    low = F.floor(F.col(begin) / step) - (1 if overlap else 0)
    links = g.vertices.where(f"{begin} <= {end}").select(F.col("id").alias("vid"), F.explode(F.sequence(low, F.floor(F.col(end) / step))).alias("_b"))
    links = links.select("vid", (F.col("_b") * step).cast("double").alias("bottom"), (F.col("_b") * step + width).cast("double").alias("top"))
    return _from_keys(g, name, links, ["bottom", "top"], True)


def by_text(g: Graph, attr: str, name: str = "bucketing") -> Graph:
    links = g.vertices.where(F.col(attr).isNotNull()).select(F.col("id").alias("vid"), F.col(attr).alias(attr))
    return _from_keys(g, name, links, [attr], True)


def by_vector(g: Graph, attr: str, name: str = "bucketing") -> Graph:
    """A segment for each element; an element twice in a vector gives two links."""
    links = g.vertices.select(F.col("id").alias("vid"), F.explode(attr).alias("element")).where("element is not null")
    return _from_keys(g, name, links, ["element"])


def by_event_sequence(g: Graph, locations: str, time: str, people: DataFrame, algorithm: str = "continuous", length: int = 2, step: float = 3600.0, window: float = 7200.0, name: str = "event_sequences") -> Graph:
    """Segments of people who share a sequence of locations at a time: bucket (of ``step``) and locations.

    ``g`` holds the people; ``people`` has person, location and ``time`` columns of the events; equal times are ordered by location.
    continuous: consecutive events at one location are merged into runs, and every ``length`` consecutive runs (all runs, if a person
    has fewer) make a sequence. It is in each bucket of time in which its first run lasts, if its last run ends within ``window`` of it.
    with gaps: each event opens a window; any ``length`` events in it, in order, make a sequence in the event's bucket.
    """
    e = people.select(F.col("person"), F.col(time).alias("t"), F.col(locations).alias("loc")).where("person is not null and t is not null and loc is not null")
    w = Window.partitionBy("person").orderBy("t", "loc")
    if algorithm == "continuous":
        moved = F.coalesce((F.lag("loc").over(w) != F.col("loc")).cast("int"), F.lit(1))
        e = e.withColumn("_new", moved).withColumn("_run", F.sum("_new").over(w)).groupBy("person", "_run", "loc").agg(F.min("t").alias("a"), F.max("t").alias("b"))
        over = Window.partitionBy("person").orderBy("_run")
        frame = over.rowsBetween(0, length - 1)
        rows = e.select("person", "_run", "a", "b", F.collect_list("loc").over(frame).alias("locations"), F.last("b").over(frame).alias("end"), F.count(F.lit(1)).over(Window.partitionBy("person")).alias("_n"))
        rows = rows.where((F.size("locations") == length) | ((F.col("_n") < length) & (F.col("_run") == 1)))
        low, high = F.floor(F.greatest(F.col("a"), F.col("end") - window) / step), F.floor(F.col("b") / step)
        links = rows.where(low <= high).select(F.col("person").alias("vid"), "locations", F.explode(F.sequence(low, high)).alias("bucket"))
    else:
        e = e.withColumn("k", F.row_number().over(w))
        # events are joined by windows of time too: what is within a window lies in the same or in the next
        slot = lambda t: F.floor(F.col(t) / window)
        later = e.select("person", F.col("t").alias("_t"), F.col("loc").alias("_loc"), F.col("k").alias("_k"), slot("t").alias("_slot"))
        rows = e.select("person", F.array("loc").alias("locations"), F.col("t").alias("begin"), F.col("t").alias("end"), F.col("k").alias("first"), F.col("k").alias("last"))
        for _ in range(length - 1):
            rows = rows.withColumn("_slot", F.explode(F.array(slot("begin"), slot("begin") + 1))).join(later, ["person", "_slot"]).where((F.col("_k") > F.col("last")) & (F.col("_t") < F.col("begin") + window))
            rows = rows.select("person", F.concat("locations", F.array("_loc")).alias("locations"), "begin", F.col("_t").alias("end"), "first", F.col("_k").alias("last"))
        opened = rows.withColumn("_slot", F.explode(F.array(slot("end"), slot("end") - 1))).join(later, ["person", "_slot"]).where((F.col("_k") <= F.col("first")) & (F.col("end") < F.col("_t") + window))
        links = opened.select(F.col("person").alias("vid"), "locations", F.floor(F.col("_t") / step).alias("bucket"))
    return _from_keys(g, name, links.distinct(), ["bucket", "locations"], True)


def combine(g: Graph, names: Sequence[str], name: str = "combination") -> Graph:
    """A segment for each combination of segments that shares a vertex, with the attributes of all, prefixed by their names."""
    links = None
    for n in names:
        m = g.segmentation(n).membership.distinct().withColumnRenamed("sid", n)
        links = m if links is None else links.join(m, "vid")
    out = _from_keys(g, name, links, list(names), True)
    s = out.segmentation(name)
    v = s.graph.vertices
    for n in names:
        side = g.segmentation(n).graph
        v = v.join(side.vertices.select(F.col("id").alias(n), *(F.col(c).alias(f"{n}_{c}") for c in side.vertex_attributes)), n).drop(n)
    return out.with_segmentation(name, replace(s, graph=Graph(v)))


def links_from_attributes(g: Graph, name: str, base_attr: str, seg_attr: str) -> Graph:
    """Membership by equality of a vertex's and a segment's attribute."""
    s = g.segmentation(name)
    left = g.vertices.select(F.col("id").alias("vid"), F.col(base_attr).alias("_k"))
    right = s.graph.vertices.select(F.col("id").alias("sid"), F.col(seg_attr).alias("_k"))
    return g.with_segmentation(name, replace(s, membership=left.join(right, "_k").select("vid", "sid")))


def make_empty(g: Graph, name: str) -> Graph:
    s = g.segmentation(name)
    return g.with_segmentation(name, replace(s, membership=s.membership.limit(0)))


def self_as_segmentation(g: Graph, name: str = "self_as_segmentation") -> Graph:
    return g.with_segmentation(name, Segmentation(g, g.vertices.select(F.col("id").alias("vid"), F.col("id").alias("sid"))))


def other_as_segmentation(g: Graph, other: Graph, name: str = "segmentation") -> Graph:
    return g.with_segmentation(name, Segmentation(other, g.spark.createDataFrame([], "vid bigint, sid bigint")))


def from_table(g: Graph, df: DataFrame, base_attr: str, base_column: str, seg_column: str, name: str = "segmentation") -> Graph:
    """Segments are the distinct values of a column; vertices are found by another, compared as text."""
    left = g.vertices.select(F.col("id").alias("vid"), F.col(base_attr).cast("string").alias("_k"))
    rows = df.where(F.col(seg_column).isNotNull()).select(F.col(base_column).cast("string").alias("_k"), F.col(seg_column).cast("string").alias(seg_column))
    every = spill(rows.select(seg_column).distinct())
    clashes = clash_free(every, [seg_column])
    links = with_id(rows.join(left, "_k").select("vid", seg_column), [seg_column], clashes, "sid").select("vid", "sid")
    return g.with_segmentation(name, Segmentation(Graph(with_id(every, [seg_column], clashes)), links))


def links_from_table(g: Graph, name: str, df: DataFrame, base_attr: str, base_column: str, seg_attr: str, seg_column: str) -> Graph:
    s = g.segmentation(name)
    left = g.vertices.select(F.col("id").alias("vid"), F.col(base_attr).cast("string").alias("_b"))
    right = s.graph.vertices.select(F.col("id").alias("sid"), F.col(seg_attr).cast("string").alias("_s"))
    rows = df.select(F.col(base_column).cast("string").alias("_b"), F.col(seg_column).cast("string").alias("_s"))
    return g.with_segmentation(name, replace(s, membership=rows.join(left, "_b").join(right, "_s").select("vid", "sid")))


# Use


def copy_edges_to_base(g: Graph, name: str) -> Graph:
    """For each segment edge s->t a base edge for every u in s and v in t, with the segment edge's attributes."""
    s = g.segmentation(name)
    e = s.graph.need_edges()
    u = s.membership.select(F.col("sid").alias("src"), F.col("vid").alias("_u"))
    v = s.membership.select(F.col("sid").alias("dst"), F.col("vid").alias("_v"))
    out = e.join(u, "src").join(v, "dst").select(hashed_id("eid", "_u", "_v").alias("eid"), F.col("_u").alias("src"), F.col("_v").alias("dst"), *s.graph.edge_attributes)
    return g.with_edges(out)


def copy_edges_to_segmentation(g: Graph, name: str) -> Graph:
    """For each base edge u->v a segment edge for every segment of u and of v."""
    s = g.segmentation(name)
    a = s.membership.select(F.col("vid").alias("src"), F.col("sid").alias("_s"))
    b = s.membership.select(F.col("vid").alias("dst"), F.col("sid").alias("_t"))
    out = g.need_edges().join(a, "src").join(b, "dst").select(hashed_id("eid", "_s", "_t").alias("eid"), F.col("_s").alias("src"), F.col("_t").alias("dst"), *g.edge_attributes)
    return g.with_segmentation(name, replace(s, graph=s.graph.with_edges(out)))


def edges_from_cooccurrence(g: Graph, name: str) -> Graph:
    """All ordered pairs of a segment, loops included, once for each segment; its attributes are copied with its name as prefix.

    The output is quadratic in the segment by definition; :func:`sample_cooccurrence` and aggregation through the
    membership do without it.
    """
    s = g.segmentation(name)
    a = s.membership.select("sid", F.col("vid").alias("src"))
    b = s.membership.select("sid", F.col("vid").alias("dst"))
    attrs = s.graph.vertices.select(F.col("id").alias("sid"), *(F.col(c).alias(f"{name}_{c}") for c in s.graph.vertex_attributes))
    out = a.join(b, "sid").join(attrs, "sid")
    return g.with_edges(out.select(hashed_id("sid", "src", "dst").alias("eid"), "src", "dst", *(f"{name}_{c}" for c in s.graph.vertex_attributes)))


def sample_cooccurrence(g: Graph, name: str, probability: float = 0.001, seed: int = 0) -> Graph:
    """Each ordered pair that shares a segment once, with the probability; ``multiplicity`` is the number of shared segments.

    The pairs of a segment are numbered and drawn by skips, so that the work is in proportion to the sample. A pair counts if it was drawn in the least segment it shares.
    """
    m = g.segmentation(name).membership.distinct()
    members, size = in_order(m, "sid", "vid")
    block = max(1, int(20_000 / max(probability, 1e-12)))
    blocks = size.withColumn("b", F.explode(F.sequence(F.lit(0).cast("bigint"), F.expr(f"(d * d - 1) div {block}"))))

    def run(batches):
        for pdf in batches:
            sids, at = [], []
            for sid, d, b in zip(pdf["sid"], pdf["d"], pdf["b"]):
                kept = kept_numbers(np.random.default_rng([seed, sid & 0x7FFFFFFFFFFFFFFF, b]), min(block, d * d - b * block), probability) + b * block
                sids.append(np.full(len(kept), sid))
                at.append(np.stack([kept // d, kept % d]))
            yield pd.DataFrame({"sid": np.concatenate(sids), "i": np.concatenate([x[0] for x in at]), "j": np.concatenate([x[1] for x in at])})

    drawn = blocks.repartition("sid", "b").mapInPandas(run, "sid bigint, i bigint, j bigint")
    for end, k in (("src", "i"), ("dst", "j")):
        drawn = drawn.join(members.select("sid", F.col("vid").alias(end), F.col("k").cast("bigint").alias(k)), ["sid", k])
    drawn = spill(drawn.select("src", "dst", F.col("sid").alias("_drawn")))
    both = drawn.join(m.select(F.col("vid").alias("src"), "sid"), "src").join(m.select(F.col("vid").alias("dst"), "sid"), ["dst", "sid"])
    out = both.groupBy("src", "dst", "_drawn").agg(F.count(F.lit(1)).cast("double").alias("multiplicity"), F.min("sid").alias("_least")).where("_drawn = _least")
    return g.with_edges(out.select(hashed_id("src", "dst").alias("eid"), "src", "dst", "multiplicity"))


def overlapping(m: DataFrame) -> DataFrame:
    """Pairs a < b of segments that can share as many vertices as both ``need``, with the number they share: a, b, n. ``m`` has sid, vid (distinct) and need (of the segment).

    While no vertex is in more than ``HOT_VERTEX`` segments, all pairs of a vertex are counted. Else the vertices of each segment are ordered by the number of their segments, and only the pairs
    that share one of the first ``size - need + 1`` of both are looked at: all others cannot share enough. So vertices of many segments hardly form pairs.
    """
    m = spill(m)
    many = m.groupBy("vid").agg(F.count(F.lit(1)).alias("_many"))
    pair = lambda x: x.select("vid", F.col("sid").alias("a")).join(x.select("vid", F.col("sid").alias("b")), "vid").where("a < b")
    if (many.agg(F.max("_many")).first()[0] or 0) <= HOT_VERTEX:
        return pair(m).groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))
    size = m.groupBy("sid").agg(F.count(F.lit(1)).alias("_size"))
    at = F.row_number().over(Window.partitionBy("sid").orderBy("_many", "vid"))
    first = m.join(many, "vid").join(size, "sid").withColumn("_at", at).where("_at <= _size - need + 1")
    candidates = spill(pair(first).select("a", "b").distinct())
    x = candidates.join(m.select(F.col("sid").alias("a"), "vid"), "a").join(m.select(F.col("sid").alias("b"), "vid"), ["b", "vid"])
    return x.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))


def edges_from_overlap(g: Graph, name: str, least: int = 3) -> Graph:
    """Both edges between segments that share at least ``least`` vertices, with ``Overlap size``.

    Segments smaller than ``least`` are left out before pairs are formed, and each unordered pair is formed once, by :func:`overlapping`.
    """
    s = g.segmentation(name)
    m = s.membership.distinct()
    large = m.groupBy("sid").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least).select("sid")
    shared = overlapping(m.join(large, "sid", "left_semi").select("sid", "vid", F.lit(least).alias("need"))).where(F.col("n") >= least).select("a", "b", F.col("n").cast("double").alias("Overlap size"))
    out = shared.select("Overlap size", F.inline(F.array(F.struct(F.col("a").alias("src"), F.col("b").alias("dst")), F.struct(F.col("b").alias("src"), F.col("a").alias("dst")))))
    return g.with_segmentation(name, replace(s, graph=s.graph.with_edges(out.select(hashed_id("src", "dst").alias("eid"), "src", "dst", "Overlap size"))))


def grow(g: Graph, name: str, direction: str) -> Graph:
    """Add all neighbours of members, reached in the direction."""
    s = g.segmentation(name)
    near = pairs(g.need_edges(), direction).select(F.col("center").alias("vid"), F.col("other").alias("_u"))
    more = s.membership.join(near, "vid").select(F.col("_u").alias("vid"), "sid")
    return g.with_segmentation(name, replace(s, membership=s.membership.unionByName(more).distinct()))


def merge_parallel_links(g: Graph, name: str) -> Graph:
    s = g.segmentation(name)
    return g.with_segmentation(name, replace(s, membership=s.membership.distinct()))


def pull_up(g: Graph, name: str, inner: str) -> Graph:
    """The segmentation ``inner`` of a segmentation as one of the base graph."""
    s = g.segmentation(name)
    t = s.graph.segmentation(inner)
    m = s.membership.join(t.membership.select(F.col("vid").alias("sid"), F.col("sid").alias("_t")), "sid").select("vid", F.col("_t").alias("sid")).distinct()
    return g.with_segmentation(inner, Segmentation(t.graph, m))


def compare_edges(golden: DataFrame, test: DataFrame) -> tuple[float, float, DataFrame, DataFrame]:
    """Precision and recall of the distinct (src, dst) of ``test``; both edge tables with 1.0 in ``present_in_*`` where the other has the edge."""
    a, b = golden.select("src", "dst").distinct(), test.select("src", "dst").distinct()
    both = a.join(b, ["src", "dst"])
    n, na, nb = both.count(), a.count(), b.count()
    mark = lambda df, name: df.join(both.withColumn(name, F.lit(1.0)), ["src", "dst"], "left").select(*df.columns, name)
    return n / nb if nb else float("nan"), n / na if na else float("nan"), mark(golden, "present_in_test"), mark(test, "present_in_golden")


def check_cliques(g: Graph, name: str, both_directions: bool = False) -> DataFrame:
    """Segments that are no cliques: sid, missing (ordered pairs without an edge, or unordered ones)."""
    m = g.segmentation(name).membership.distinct()
    size = m.groupBy("sid").agg(F.count(F.lit(1)).alias("n"))
    e = g.need_edges().where("src <> dst")
    e = e.select("src", "dst").distinct() if both_directions else e.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct()
    inside = e.join(m.withColumnRenamed("vid", "src"), "src").join(m.withColumnRenamed("vid", "dst"), ["dst", "sid"]).groupBy("sid").agg(F.count(F.lit(1)).alias("k"))
    pairs_of = F.col("n") * (F.col("n") - 1) / (1 if both_directions else 2)
    return size.join(inside, "sid", "left").select("sid", (pairs_of - F.coalesce("k", F.lit(0))).cast("bigint").alias("missing")).where("missing > 0")
