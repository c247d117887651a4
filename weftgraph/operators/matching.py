"""Entity matching by neighbourhood similarity (fingerprinting), and Steiner trees."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..graph import Graph
from ..runtime import drop, rows_of, spill, together
from .direction import neighbours

#: Edges that the fires of one batch burn at about.
FIRE_ROWS = 10_000_000
#: Edges up to which the fires burn in memory, and vertices times fires that burn side by side there.
FIRE_EDGES, FIRE_BLOCK = 5_000_000, 1_000_000


def similarities(left: DataFrame, right: DataFrame, candidates: DataFrame, least_overlap: int = 1, least_similarity: float = 0.5, extra_weight: float = 0.0, weighting: str = "InverseInDegree") -> DataFrame:
    """Similarity of candidate pairs by what they are linked to: left, right, similarity, overlap.

    ``left`` and ``right`` are (id, other, w) with positive weights. Similarity is the sum over common others of min(lw, rw) * g over
    that over all others of max(lw, rw) * g, plus ``extra_weight``. The degree of an other is the number of vertices linked to it; g is the degree (``InDegree``) or
    one over it (``InverseInDegree``); with ``InverseInDegreeBasedHybrid`` it is that for others of the left and one less that for others that only the right is linked to.
    """
    l_ = left.groupBy("id", "other").agg(F.sum("w").alias("lw")).withColumnRenamed("id", "left")
    r_ = right.groupBy("id", "other").agg(F.sum("w").alias("rw")).withColumnRenamed("id", "right")
    degree = l_.select("other").unionByName(r_.select("other")).groupBy("other").agg(F.count(F.lit(1)).cast("double").alias("g"))
    if weighting == "InverseInDegreeBasedHybrid":
        return _hybrid(l_, r_, candidates, degree, least_overlap, least_similarity, extra_weight)
    g = degree.withColumn("g", {"InDegree": F.col("g"), "InverseInDegree": 1 / F.col("g")}[weighting])
    l_, r_ = l_.join(g, "other"), r_.join(g, "other")
    lsum = l_.groupBy("left").agg(F.sum(F.col("lw") * F.col("g")).alias("ls"))
    rsum = r_.groupBy("right").agg(F.sum(F.col("rw") * F.col("g")).alias("rs"))
    common = candidates.select("left", "right").distinct().join(l_, "left").join(r_.drop("g"), ["right", "other"]).groupBy("left", "right").agg(
        F.sum(F.least("lw", "rw") * F.col("g")).alias("same"), F.count(F.lit(1)).alias("overlap"),
    )
    out = common.where(F.col("overlap") >= least_overlap).join(lsum, "left").join(rsum, "right")
    # sum of max = sum of both - sum of min
    value = F.col("same") / (F.col("ls") + F.col("rs") - F.col("same") + extra_weight)
    return out.select("left", "right", value.alias("similarity"), "overlap").where(F.col("similarity") >= least_similarity)


def _hybrid(left: DataFrame, right: DataFrame, candidates: DataFrame, degree: DataFrame, least_overlap: int, least_similarity: float, extra_weight: float) -> DataFrame:
    """:func:`similarities` where the weight of an other depends on the side: sums over the left's others, and over those of the right alone."""
    g = degree.withColumn("g", F.least(F.lit(1.0), 1 / F.col("g")))
    l_, r_ = left.join(g, "other"), right.join(g, "other")
    common = candidates.select("left", "right").distinct().join(l_, "left").join(r_.drop("g"), ["right", "other"]).groupBy("left", "right").agg(
        F.sum(F.least("lw", "rw") * F.col("g")).alias("same"), F.sum(F.greatest("lw", "rw") * F.col("g")).alias("most"),
        F.sum(F.col("lw") * F.col("g")).alias("lc"), F.sum(F.col("rw") * (1 - F.col("g"))).alias("rc"), F.count(F.lit(1)).alias("overlap"),
    )
    lsum = l_.groupBy("left").agg(F.sum(F.col("lw") * F.col("g")).alias("ls"))
    rsum = r_.groupBy("right").agg(F.sum(F.col("rw") * (1 - F.col("g"))).alias("rs"))
    out = common.where(F.col("overlap") >= least_overlap).join(lsum, "left").join(rsum, "right")
    value = F.try_divide("same", F.col("most") + (F.col("ls") - F.col("lc")) + (F.col("rs") - F.col("rc")) + extra_weight)
    return out.select("left", "right", value.alias("similarity"), "overlap").where(F.col("similarity") >= least_similarity)


def stable_matching(pairs: DataFrame) -> DataFrame:
    """left, right, similarity of the stable matching: in each round, pairs that are each other's best are matched and leave. Ties by ids."""
    left = spill(pairs.select("left", "right", "similarity"))
    done = None
    while left.limit(1).count():
        score = lambda o: F.struct(F.col("similarity"), -F.col(o))
        a = left.groupBy("left").agg(F.max_by("right", score("right")).alias("right"))
        b = left.groupBy("right").agg(F.max_by("left", score("left")).alias("left"))
        now = spill(left.join(a, ["left", "right"]).join(b, ["left", "right"]))
        done = now if done is None else done.unionByName(now)
        left = spill(left.join(now.select("left"), "left", "left_anti").join(now.select("right"), "right", "left_anti").select("left", "right", "similarity"))
    return done if done is not None else left


def fingerprint(g: Graph, left_name: str, right_name: str, weight: str | None = None, least_overlap: int = 1, least_similarity: float = 0.5, extra_weight: float = 0.0, weighting: str = "InverseInDegree") -> Graph:
    """Match vertices that have only one of two names by the neighbours they share; both then have both names and ``<name>_similarity_score``.

    Neighbours that have both names count as common ground, and vertices with one name are compared only over a common neighbour.
    """
    e = g.need_edges().select("src", "dst", (F.col(weight) if weight else F.lit(1.0)).alias("w")).where("src <> dst")
    links = e.select("w", F.inline(F.array(F.struct(F.col("src").alias("id"), F.col("dst").alias("other")), F.struct(F.col("dst").alias("id"), F.col("src").alias("other")))))
    names = g.vertices.select("id", F.col(left_name).alias("_l"), F.col(right_name).alias("_r"))
    ls = links.join(names.where("_l is not null and _r is null").select("id"), "id", "left_semi").select("id", "other", "w")
    rs = links.join(names.where("_r is not null and _l is null").select("id"), "id", "left_semi").select("id", "other", "w")
    candidates = ls.select(F.col("id").alias("left"), "other").join(rs.select(F.col("id").alias("right"), "other"), "other").select("left", "right")
    found = stable_matching(similarities(ls, rs, candidates, least_overlap, least_similarity, extra_weight, weighting))
    known = found.join(names.select(F.col("id").alias("left"), "_l"), "left").join(names.select(F.col("id").alias("right"), "_r"), "right")
    gained = known.select(F.inline(F.array(
        F.struct(F.col("left").alias("id"), F.col("_l").alias("_nl"), F.col("_r").alias("_nr"), F.col("similarity")),
        F.struct(F.col("right").alias("id"), F.col("_l").alias("_nl"), F.col("_r").alias("_nr"), F.col("similarity")),
    )))
    v = g.vertices.join(gained, "id", "left").withColumn(left_name, F.coalesce(left_name, "_nl")).withColumn(right_name, F.coalesce(right_name, "_nr"))
    return g.with_vertices(v.withColumn(f"{left_name}_similarity_score", F.col("similarity")).withColumn(f"{right_name}_similarity_score", F.col("similarity")).drop("_nl", "_nr", "similarity"))


def link_by_fingerprint(g: Graph, name: str, least_overlap: int = 1, least_similarity: float = 0.0, extra_weight: float = 0.0, weighting: str = "InverseInDegree") -> Graph:
    """Link base and segmentation vertices by how their neighbourhoods agree under the links there are so far."""
    from dataclasses import replace

    s = g.segmentation(name)
    base = neighbours(g.need_edges()).select(F.col("center").alias("id"), F.col("other").alias("v")).withColumn("w", F.lit(1.0))
    seg = neighbours(s.graph.need_edges()).select(F.col("center").alias("id"), "other").withColumn("w", F.lit(1.0))
    known = s.membership
    left = base.join(known.select(F.col("vid").alias("v"), F.col("sid").alias("other")), "v").select("id", "other", "w")
    left = left.join(known.select(F.col("vid").alias("id")), "id", "left_anti")
    right = seg.join(known.select(F.col("sid").alias("id")), "id", "left_anti")
    candidates = left.select(F.col("id").alias("left"), "other").join(right.select(F.col("id").alias("right"), "other"), "other").select("left", "right")
    found = stable_matching(similarities(left, right, candidates, least_overlap, least_similarity, extra_weight, weighting))
    more = found.select(F.col("left").alias("vid"), F.col("right").alias("sid"))
    out = g.with_segmentation(name, replace(s, membership=known.unionByName(more)))
    return out.with_vertex_values(found.select(F.col("left").alias("id"), F.col("similarity").alias(f"{name}_similarity_score")))


def steiner_tree(g: Graph, edge_cost: str, root_cost: str, gain: str, arc: str = "arc", node: str = "node", profit: str = "profit", root: str = "rootpoints", most: int = 1_000_000) -> Graph:
    """A prize-collecting forest over directed edges: from a root point (vertex with a ``root_cost``), paths to vertices whose ``gain`` outweighs their cost.

    Greedy: again and again the path of best profit joins the forest. Sequential, so it runs on the driver; more than ``most`` edges are an error.
    ``arc`` is 1.0 on chosen edges, ``node`` 1.0 on vertices reached, ``root`` the cost of chosen root points; scalar ``profit``.
    """
    import heapq

    if g.need_edges().limit(most + 1).count() > most:
        raise ValueError(f"more than {most} edges")
    v = g.vertices.select("id", F.col(root_cost).alias("r"), F.coalesce(F.col(gain), F.lit(0.0)).alias("g")).toPandas()
    e = g.need_edges().select("eid", "src", "dst", F.col(edge_cost).alias("c")).where("c is not null").toPandas()
    prize = dict(zip(v["id"], v["g"]))
    roots = {i: c for i, c in zip(v["id"], v["r"]) if c == c and c is not None}
    out: dict[int, list] = {}
    for row in e.itertuples(index=False):
        out.setdefault(row.src, []).append((row.c, row.dst, row.eid))
    node_set: set[int] = set()
    root_set: set[int] = set()
    arcs: set[int] = set()
    total = 0.0
    while True:
        dist = {n: 0.0 for n in node_set} | {r: c for r, c in roots.items() if r not in node_set}
        via: dict[int, tuple] = {}
        heap = [(d, n) for n, d in dist.items()]
        heapq.heapify(heap)
        gained = {n: (0.0 if n in node_set else prize.get(n, 0.0)) for n in dist}
        done: set[int] = set()
        best = (1e-12, None)
        while heap:
            d, n = heapq.heappop(heap)
            if n in done:
                continue
            done.add(n)
            if n not in node_set and gained[n] - d > best[0]:
                best = (gained[n] - d, n)
            for c, m, eid in out.get(n, ()):
                if m not in node_set and d + c < dist.get(m, float("inf")):
                    dist[m], via[m], gained[m] = d + c, (n, eid), gained[n] + prize.get(m, 0.0)
                    heapq.heappush(heap, (d + c, m))
        if best[1] is None:
            break
        total, at = total + best[0], best[1]
        while at not in node_set:
            node_set.add(at)
            if at not in via:
                root_set.add(at)
                break
            at, eid = via[at]
            arcs.add(eid)
    spark = g.spark
    nodes = spark.createDataFrame(pd.DataFrame({"id": sorted(node_set), node: 1.0, root: [roots[n] if n in root_set else None for n in sorted(node_set)]}), f"id bigint, {node} double, {root} double")
    edges = spark.createDataFrame(pd.DataFrame({"eid": sorted(arcs), arc: 1.0}), f"eid bigint, {arc} double")
    return g.with_vertex_values(nodes).with_edge_values(edges).with_scalars(**{profit: total})


def forest_fire_scores(g: Graph, spread: float = 0.99, burn_ratio: float = 10.0, seed: int = 0, name: str = "forest_fire_score", in_memory: int = FIRE_EDGES) -> DataFrame:
    """eid and how often fires burn over an edge, over the most for any. Fires start at random vertices with neighbours, in batches, until
    ``burn_ratio`` times the edges have burned; each burning vertex lights unburned neighbours for as long as a draw is below ``spread``, and a vertex burns once in a fire.

    A fire burns until it dies out. A batch has as many fires as the rest of the goal needs at the edges burned a fire so far, but at most
    twice those before it, and no more than reach ``FIRE_ROWS`` vertices if each is like the largest so far (one fire at least). Without edges between different vertices, or at spread 0, nothing burns.
    A graph of at most ``in_memory`` edges is sent to the tasks, where whole fires burn side by side; a larger one burns step by step in joins.
    """
    from .attributes import uniform

    e = spill(g.need_edges().select("eid", "src", "dst"))
    spark, whole, step, starts = e.sparkSession, None, None, None
    if rows_of(e) <= in_memory:
        links = _links_in_memory(e, seed)
        n = len(links[0]) - 1
        whole = spark.sparkContext.broadcast(links)
        del links
    else:
        step = spill(e.select("eid", F.inline(F.array(F.struct(F.col("src").alias("at"), F.col("dst").alias("to")), F.struct(F.col("dst").alias("at"), F.col("src").alias("to"))))).where("at <> to"))
        starts = spill(step.select("at").distinct())
        n = rows_of(starts)
    chance = min(max(spread, 1e-6), 1 - 1e-6)
    goal, burned, fired, largest, counts, r = burn_ratio * rows_of(e), 0, 0, n, None, 0
    while n and spread > 0 and burned < goal:
        each = max(1.0, burned / fired) if fired else n  # the first batch counts on all vertices burning
        batch = int(max(1, min(n, -(-(goal - burned) // each), FIRE_ROWS // largest, 2 * fired or n)))
        largest = largest if fired else 1
        if whole is not None:
            side = max(1, FIRE_BLOCK // n)  # fires that burn side by side
            blocks = -(-batch // side)
            ids = spark.range(0, blocks, 1, min(blocks, 4 * spark.sparkContext.defaultParallelism))
            levels = [spill(ids.mapInArrow(_fires(whole, side, batch, chance, (seed, r)), "fire bigint, eid bigint, at bigint"))]
            fired += batch
            burned += rows_of(levels[0])
        else:
            fires = starts.select("at", F.xxhash64("at", F.lit(seed), F.lit(r)).alias("fire"))
            fires = fires.orderBy("fire", "at").limit(batch) if batch <= 1000 else fires.where(uniform("fire", 3) < batch / n)
            front = spill(fires.select("fire", F.lit(None).cast("bigint").alias("eid"), "at"))
            fired += rows_of(front)
            d, levels = 0, [front]
            while True:
                seen = together(levels)
                draw = F.xxhash64("fire", "at", "to", "eid", F.lit(d))
                order = F.row_number().over(Window.partitionBy("fire", "at").orderBy(draw))
                much = F.floor(F.log(uniform(F.xxhash64("fire", "at", F.lit(d)), 2)) / F.log(F.lit(chance)))
                lit = front.select("fire", "at").join(step, "at").join(seen.select("fire", F.col("at").alias("to")), ["fire", "to"], "left_anti")
                lit = lit.withColumn("_o", order).where(F.col("_o") <= much).groupBy("fire", F.col("to").alias("_at")).agg(F.min_by("eid", F.struct(draw, "eid")).alias("eid"))
                front = spill(lit.select("fire", "eid", F.col("_at").alias("at")))
                levels.append(front)
                if not rows_of(front):
                    break
                burned, d = burned + rows_of(front), d + 1
        seen = together(levels)
        largest = max(largest, seen.groupBy("fire").count().agg(F.max("count")).first()[0] or 1)
        each = seen.where("eid is not null").groupBy("eid").agg(F.count(F.lit(1)).alias("n"))
        after = spill(each if counts is None else each.unionByName(counts).groupBy("eid").agg(F.sum("n").alias("n")))
        for x in [*levels, counts]:
            drop(x)
        counts, r = after, r + 1
    if not burned:
        return e.select("eid", F.lit(0.0).alias(name))
    top = counts.agg(F.max("n")).first()[0]
    return e.select("eid").join(counts, "eid", "left").select("eid", (F.coalesce("n", F.lit(0)) / top).alias(name))


def _links_in_memory(e: DataFrame, seed: int) -> tuple[np.ndarray, ...]:
    """The links of each vertex that has neighbours, in an order by chance: where they begin, the other ends, the edges' numbers; ids of the vertices and of the edges."""
    t = e.where("src <> dst").orderBy("eid").toArrow()
    src, dst, eid = (t.column(c).to_numpy() for c in ("src", "dst", "eid"))
    del t
    ids, at = np.unique(np.concatenate([src, dst]), return_inverse=True)
    at = at.astype(np.int32)
    k = np.random.default_rng(seed).permutation(len(at)).astype(np.int32)
    k = k[np.argsort(at[k], kind="stable")]
    begin = np.append(0, np.cumsum(np.bincount(at, minlength=len(ids)))).astype(np.int32)
    m = len(src)
    return begin, at[np.where(k < m, k + m, k - m)], k % max(m, 1), ids, eid


def _fires(whole, side: int, batch: int, chance: float, seed: tuple):
    """For numbers of blocks of ``side`` fires: what they burn. A level's vertices light in turn, so that none is lit twice."""

    def run(batches):
        begin, to, edge, ids, eid = whole.value
        n = len(ids)
        burning, first = np.zeros(side * n, bool), np.zeros(side * n, np.int32)
        for k in (x for b in batches for x in b.column(0).to_pylist()):
            rng = np.random.default_rng([abs(seed[0]), int(seed[0] < 0), seed[1], k])
            f = np.arange(min(side, batch - k * side), dtype=np.int32)
            v = rng.integers(0, n, len(f), np.int32)
            touched = [f * n + v]
            burning[touched[0]] = True
            while len(v):
                size = begin[v + 1] - begin[v]
                much = np.floor(np.log(1 - rng.random(len(v))) / np.log(chance))
                owner = np.repeat(np.arange(len(v), dtype=np.int32), size)
                link = np.repeat(begin[v] - (np.cumsum(size, dtype=np.int32) - size), size) + np.arange(len(owner), dtype=np.int32)
                key = f[owner] * n + to[link]
                free = ~burning[key]
                owner, link, key = owner[free], link[free], key[free]
                left = np.bincount(owner, minlength=len(v))
                rank = np.zeros(len(owner), np.int32)
                some = np.flatnonzero((much < left)[owner])  # links of vertices that do not light all; in an order by chance
                some = some[np.argsort(owner[some] + rng.random(len(some)))]
                rank[some] = np.arange(len(some)) - np.searchsorted(owner[some], owner[some])
                reach = np.minimum(much, left)
                while True:
                    tried = np.flatnonzero(rank < reach[owner])
                    first[key[tried[::-1]]] = tried[::-1]  # the first to try lights it
                    lit = tried[first[key[tried]] == tried]
                    lost = np.bincount(owner[tried], minlength=len(v)) - np.bincount(owner[lit], minlength=len(v))
                    now = np.minimum(much + lost, left)  # whoever came too late tries others instead
                    if (now == reach).all():
                        break
                    reach = now
                f, v = f[owner[lit]], to[link[lit]]
                burning[key[lit]] = True
                touched.append(key[lit])
                for i in range(0, len(lit), 1 << 18):
                    s = slice(i, i + (1 << 18))
                    yield pa.RecordBatch.from_arrays([pa.array(f[s].astype(np.int64) + k * side), pa.array(eid[edge[link[lit[s]]]]), pa.array(ids[v[s]])], names=["fire", "eid", "at"])
            burning[np.concatenate(touched)] = False

    return run


def pivot_layout(g: Graph, dimensions: int = 2, pivots: int = 100, name: str = "position", length: str | None = None) -> DataFrame:
    """id and position by pivot MDS: distances to a bounded number of pivots (hops, or sums of the edges' ``length``), centred, projected on their main axes.

    The distances stay distributed; only the pivots' covariance (pivots x pivots) comes to the driver.
    """
    from .iterative import distances, distances_by_length

    chosen = g.vertices.select("id").orderBy(F.xxhash64("id"), "id").limit(pivots)
    d = spill(distances_by_length(g, length, chosen) if length else distances(g, "all edges", 10**6, chosen))
    ids = [int(r.source) for r in d.select("source").distinct().orderBy("source").collect()]
    far = float((d.agg(F.max("d")).first()[0] or 0) + 1)
    wide = g.vertices.select("id").join(d.groupBy("id").pivot("source", ids).agg(F.first("d")), "id", "left").fillna(far)
    sq = wide.select("id", F.array(*(F.col(f"`{c}`").cast("double") ** 2 for c in ids)).alias("x"))
    sq = spill(sq)
    n = max(1, sq.count())
    mean = [r or 0.0 for r in sq.select(*(F.avg(F.col("x")[i]) for i in range(len(ids)))).first()]
    row = F.aggregate("x", F.lit(0.0), lambda a, x: a + x) / max(1, len(ids))
    c = spill(sq.select("id", F.transform("x", lambda x, i: -0.5 * (x - F.array(*map(F.lit, mean))[i] - row + sum(mean) / max(1, len(mean)))).alias("x")))

    def gram(batches):
        total = np.zeros((len(ids), len(ids)))
        for pdf in batches:
            m = np.stack(pdf["x"].to_numpy())
            total += m.T @ m
        yield pd.DataFrame({"i": np.repeat(np.arange(len(ids)), len(ids)), "j": np.tile(np.arange(len(ids)), len(ids)), "v": total.ravel()})

    cov = np.zeros((len(ids), len(ids)))
    for r in c.select("x").mapInPandas(gram, "i bigint, j bigint, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).collect():
        cov[r.i, r.j] = r.v / n
    _, axes = np.linalg.eigh(cov)
    axes = axes[:, ::-1][:, :dimensions]
    at = [F.aggregate(F.zip_with("x", F.array(*(F.lit(float(a)) for a in axes[:, k])), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x) for k in range(axes.shape[1])]
    return c.select("id", F.array(*at).alias(name))
