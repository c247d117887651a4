"""Iterative graph algorithms. Each round's state is a written table: no lineage grows, and a lost executor costs one round."""

from __future__ import annotations

from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..graph import Graph
from ..runtime import BROADCAST_ROWS, drop, heavy_keys, mixed, rows_of, spill, split_join, together
from .direction import both_ways, in_order, neighbours, pairs

#: Links that are solved in one task at most.
LAST_LINKS = 200_000
#: Links from which, and up to which, sketches of reach go by slices of their registers; registers of a slice over all vertices, and numbers worked on at once.
REACH_LEAST, REACH_LINKS, REACH_NUMBERS, REACH_BLOCK = 200_000, 5_000_000, 1 << 26, 1 << 18


def shortest_path(g: Graph, start: str, length: str | None = None, iterations: int | None = 10, name: str = "distance") -> DataFrame:
    """id and least distance from any vertex whose ``start`` is defined (and counts), over at most ``iterations`` edges.

    With None it goes on until no vertex comes nearer, which needs lengths without negative cycles. Unreachable vertices are absent. Only vertices that came nearer in a round relax their edges in the next.
    """
    e = g.need_edges().select("src", F.col("dst"), (F.col(length) if length else F.lit(1.0)).alias("w"))
    e = spill(e.where("w is not null").groupBy("src", "dst").agg(F.min("w").alias("w")))
    new = F.count_if("new")
    best = spill(g.vertices.where(F.col(start).isNotNull()).select("id", F.col(start).cast("double").alias("d")).groupBy("id").agg(F.min("d").alias("d")).withColumn("new", F.lit(True)), n=new)
    for _ in count() if iterations is None else range(iterations):
        if not best.seen["n"]:
            break
        moved = split_join(e, best.where("new").select(F.col("id").alias("src"), "d"), ["src"], right_rows=best.seen["n"]).groupBy(F.col("dst").alias("id")).agg(F.min(F.col("d") + F.col("w")).alias("n"))
        after = best.drop("new").join(moved, "id", "full").select("id", F.least("d", "n").alias("d"), F.coalesce(F.col("n") < F.col("d"), F.col("d").isNull()).alias("new"))
        after = spill(after, n=new)
        drop(best)
        best = after
    return best.select("id", F.col("d").alias(name))


def pagerank(g: Graph, weight: str | None = None, iterations: int = 5, damping: float = 0.85, direction: str = "outgoing edges", name: str = "page_rank") -> DataFrame:
    """id and rank, on average 1.0. Edges of weight 0 or less do not count; what does not flow is shared out equally.

    The direction may be any that :func:`pairs` knows, with a weight any but the symmetric ones.
    """
    e = g.need_edges()
    e = pairs(e.where(F.col(weight) > 0) if weight else e, direction, weight)
    e = e.select(F.col("center").alias("src"), F.col("other").alias("dst"), (F.col(weight).cast("double") if weight else F.lit(1.0)).alias("w"))
    e = e.groupBy("src", "dst").agg(F.sum("w").alias("w"))
    out = e.groupBy("src").agg(F.sum("w").alias("total"))
    flow = spill(e.join(out, "src").select("src", "dst", (F.col("w") / F.col("total")).alias("share")))
    ids = spill(g.vertices.select("id"), n=F.count(F.lit(1)))
    n = ids.seen["n"]
    heavy = heavy_keys(flow, ["src"], 0.02)["src"] if n > BROADCAST_ROWS else []
    rank = ids.withColumn("r", F.lit(1.0))
    for _ in range(iterations):
        ranks = rank.withColumnRenamed("id", "src")
        moved = spill(split_join(flow, ranks, ["src"], heavy=heavy, right_rows=n).groupBy(F.col("dst").alias("id")).agg((F.sum(F.col("r") * F.col("share")) * damping).alias("in")), total=F.sum("in"))
        rest = (n - (moved.seen["total"] or 0.0)) / max(n, 1)
        rank = ids.join(moved, "id", "left").select("id", (F.coalesce("in", F.lit(0.0)) + rest).alias("r"))
    return rank.withColumnRenamed("r", name)


def _solved(links: DataFrame) -> DataFrame:
    """v and r, the least vertex of its component, of few links (a, b), in one task."""

    def run(batches):
        a, b = (np.concatenate(x) for x in zip(*([c.to_numpy() for c in (x.column("a"), x.column("b"))] for x in batches)))
        ids, at = np.unique(np.concatenate([a, b]), return_inverse=True)
        a, b = np.split(at, 2)
        label, before = np.arange(len(ids)), None
        while before is None or (label != before).any():
            before = label.copy()
            np.minimum.at(label, a, before[b])
            np.minimum.at(label, b, before[a])
            label = label[label]
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(ids[label])], names=["v", "r"])

    return links.repartition(1).mapInArrow(run, "v bigint, r bigint")


def connected_components(g: Graph, directions: str = "ignore directions", last_links: int = LAST_LINKS) -> DataFrame:
    """id and component, the smallest id of it. ``require both directions`` uses only pairs linked both ways.

    The graph is contracted: each round every vertex hooks to the least of its closed neighbourhood and follows the hook of that one; links are
    relabelled and deduplicated, so that they become fewer. At most ``last_links`` of them (0: none) are solved in one task. The mappings of the rounds are then
    expanded backwards. The least vertex of a component always hooks to itself. Hooks are broadcast while they are few; else those of hubs are.
    """
    from .metrics import simple_pairs

    links = spill(simple_pairs(g.need_edges(), directions == "require both directions"))
    maps = []
    while (total := rows_of(links)) > last_links:
        both = links.select(F.inline(F.array(F.struct(F.col("a").alias("v"), F.col("b").alias("w")), F.struct(F.col("b").alias("v"), F.col("a").alias("w")))))
        hooks = spill(both.groupBy("v").agg(F.min("w").alias("w"), F.count(F.lit(1)).alias("degree")).select("v", F.least("v", "w").alias("r"), "degree"), n=F.count(F.lit(1)))
        n = hooks.seen["n"]
        heavy = [x.v for x in hooks.where(F.col("degree") * 50 >= total).select("v").collect()] if n > BROADCAST_ROWS else []  # at most 100
        jumped = spill(_through(hooks.select("v", "r"), hooks, n))
        for end in ("a", "b"):
            links = split_join(links, jumped.select(F.col("v").alias(end), F.col("r").alias(f"r_{end}")), [end], heavy=heavy, right_rows=n)
        after = spill(links.where("r_a <> r_b").select(F.least("r_a", "r_b").alias("a"), F.greatest("r_a", "r_b").alias("b")).distinct())
        drop(hooks)
        links = after
        maps.append(jumped)
    if rows_of(links):
        maps.append(spill(_solved(links)))
    if not maps:
        return g.vertices.select("id", F.col("id").alias("component"))
    label = maps.pop()
    while maps:
        label = spill(_through(maps.pop(), label, rows_of(label)))
    return split_join(g.vertices.select(F.col("id").alias("v")), label, ["v"], "left").select(F.col("v").alias("id"), F.coalesce("r", "v").alias("component"))


def _through(first: DataFrame, then: DataFrame, rows: int) -> DataFrame:
    """v and what ``then`` maps its r to, or r itself where it does not."""
    onward = then.select(F.col("v").alias("r"), F.col("r").alias("_r"))
    return split_join(first, onward, ["r"], "left", right_rows=rows).select("v", F.coalesce("_r", "r").alias("r"))


def _peeled(links: DataFrame) -> DataFrame:
    """v and k, its core number, of few links (v, u), both ways, in one task: vertices of the least degree leave, again and again."""

    def run(batches):
        v, u = (np.concatenate(x) for x in zip(*([c.to_numpy() for c in (x.column("v"), x.column("u"))] for x in batches)))
        ids, v = np.unique(v, return_inverse=True)
        near = np.searchsorted(ids, u)[np.argsort(v, kind="stable")]
        degree = np.bincount(v, minlength=len(ids))
        begin, size = np.cumsum(degree) - degree, degree.copy()
        core, alive, k = np.zeros(len(ids), np.int64), np.ones(len(ids), bool), 0
        while alive.any():
            k = max(k, int(degree[alive].min()))
            gone = np.flatnonzero(alive & (degree <= k))
            while len(gone):
                core[gone], alive[gone] = k, False
                n = size[gone]
                hit = near[np.repeat(begin[gone] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
                hit, times = np.unique(hit[alive[hit]], return_counts=True)
                degree[hit] -= times
                gone = hit[degree[hit] <= k]
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(core)], names=["v", "k"])

    return links.repartition(1).mapInArrow(run, "v bigint, k bigint")


def k_core(g: Graph, name: str = "core", last_links: int = LAST_LINKS) -> DataFrame:
    """id and core number of the undirected simple graph: the fixpoint of the h-index over the neighbours' numbers; of at most ``last_links`` links (0: never) it is found in one task.

    A vertex is looked at again only if a neighbour's number has fallen below its own. Numbers are broadcast while they are few; else those of hubs are.
    """
    links = spill(neighbours(g.need_edges()).withColumnsRenamed({"center": "v", "other": "u"}))
    named = lambda core: g.vertices.select("id").join(core.select(F.col("v").alias("id"), F.col("k").cast("double").alias(name)), "id", "left").fillna(0.0, [name])
    if 0 < rows_of(links) <= 2 * last_links:
        return named(_peeled(links))
    core = spill(links.groupBy("v").agg(F.count(F.lit(1)).alias("k")).withColumn("before", F.col("k")), n=F.count(F.lit(1)))
    n = core.seen["n"]
    heavy = heavy_keys(links, ["u"], 0.02)["u"] if n > BROADCAST_ROWS else []
    look = links
    while True:
        now = core.select("v", "k")
        seen = split_join(split_join(look, now.withColumnsRenamed({"v": "u", "k": "ku"}), ["u"], heavy=heavy, right_rows=n), now, ["v"], heavy=heavy, right_rows=n)
        counted = seen.groupBy("v", "k", F.least("k", "ku").alias("c")).agg(F.count(F.lit(1)).alias("n"))
        at_least = F.sum("n").over(Window.partitionBy("v").orderBy(F.desc("c")))
        fallen = counted.withColumn("h", F.least("c", at_least)).groupBy("v").agg(F.max("h").alias("h"))
        after = spill(now.join(fallen, "v", "left").select("v", F.coalesce("h", "k").alias("k"), F.col("k").alias("before")), m=F.count_if(F.col("k") < F.col("before")))
        drop(core)
        core, m = after, after.seen["m"]
        if not m:
            break
        # a vertex is woken by a link whose other end has fallen below its own number
        fell = core.where("k < before").select(F.col("v").alias("u"), F.col("k").alias("ku"))
        wake = split_join(split_join(links, fell, ["u"], heavy=heavy, right_rows=m), core.select("v", "k"), ["v"], heavy=heavy, right_rows=n).where("ku < k").select("v").distinct()
        look = split_join(links, wake, ["v"], "left_semi", heavy=heavy, right_rows=n)
    return named(core)


def distances(g: Graph, direction: str = "outgoing edges", most: int = 10, sources: DataFrame | None = None) -> DataFrame:
    """Hops between vertices: source, id, d, up to ``most``. All sources unless given; exact and quadratic, for small graphs or few sources."""
    step = spill(pairs(g.need_edges(), direction).where("center <> other").distinct())
    seen = spill((g.vertices.select("id") if sources is None else sources.select("id")).select(F.col("id").alias("source"), "id", F.lit(0).alias("d")))
    edge = seen
    for d in range(1, most + 1):
        onward = edge.join(step.withColumnRenamed("center", "id"), "id").select("source", F.col("other").alias("id")).distinct()
        edge = spill(onward.join(seen.select("source", "id"), ["source", "id"], "left_anti").withColumn("d", F.lit(d)))
        if not edge.limit(1).count():
            break
        seen = seen.unionByName(edge)
    return seen


def distances_by_length(g: Graph, length: str | None, sources: DataFrame, direction: str = "all edges") -> DataFrame:
    """Least sums of a positive edge attribute from few sources to all vertices: source, id, d (double). Exact: only pairs that came nearer in a round relax their edges in the next. Edges without a length do not count."""
    e = g.need_edges()
    step = pairs(e.where(F.col(length).isNotNull()) if length else e, direction, length).select("center", "other", (F.col(length).cast("double") if length else F.lit(1.0)).alias("w")).where("center <> other")
    step = spill(step.groupBy("center", "other").agg(F.min("w").alias("w")))
    new = F.count_if("new")
    best = spill(sources.select(F.col("id").alias("source"), "id", F.lit(0.0).alias("d"), F.lit(True).alias("new")), n=new)
    while best.seen["n"]:
        moved = best.where("new").select("source", F.col("id").alias("center"), "d").join(step, "center").groupBy("source", F.col("other").alias("id")).agg(F.min(F.col("d") + F.col("w")).alias("n"))
        after = best.drop("new").join(moved, ["source", "id"], "full").select("source", "id", F.least("d", "n").alias("d"), F.coalesce(F.col("n") < F.col("d"), F.col("d").isNull()).alias("new"))
        after = spill(after, n=new)
        drop(best)
        best = after
    return best.drop("new")


def _reach(g: Graph, direction: str, most: int, bits: int | None, in_memory: int = REACH_LINKS):
    """For every hop count the number of vertices that reach each vertex: id, d, size. Exact sets or HLL sketches of ``bits``.

    Sketches of a graph of at most ``in_memory`` links, unless it is small, go by slices of their registers (:func:`_reach_by_registers`): no sketch is written.
    """
    step = spill(pairs(g.need_edges(), direction).where("center <> other").distinct())
    if bits and REACH_LEAST <= rows_of(step) <= in_memory:
        return _reach_by_registers(step, g.vertices.select("id"), most, bits)
    ids = g.vertices.select("id")
    make = (lambda c: F.hll_sketch_agg(c, F.lit(bits))) if bits else F.collect_set
    size = F.hll_sketch_estimate if bits else (lambda c: F.size(c).cast("bigint"))
    state = spill(ids.groupBy("id").agg(make("id").alias("s")))
    now = spill(state.select("id", F.lit(0).alias("d"), size("s").alias("size")))
    sizes = [now]
    for d in range(1, most + 1):
        moved = step.select(F.col("center").alias("to"), F.col("other").alias("id")).join(state, "id").select(F.col("to").alias("id"), "s")
        every = moved.unionByName(state)
        if bits:
            after = spill(every.groupBy("id").agg(F.hll_union_agg("s").alias("s")))
        else:
            after = spill(every.select("id", F.explode("s").alias("x")).groupBy("id").agg(F.collect_set("x").alias("s")))
        before, now = now, spill(after.select("id", F.lit(d).alias("d"), size("s").alias("size")))
        sizes.append(now)
        drop(state)  # its numbers are written; the sets or sketches are the most of the disk
        state = after
        if not now.join(before.select("id", F.col("size").alias("o")), "id").where("size > o").limit(1).count():
            break
    drop(state)
    return together(sizes)


def _reach_by_registers(step: DataFrame, ids: DataFrame, most: int, bits: int) -> DataFrame:
    """id, d, size by HLL of ``2 ** bits`` registers. Registers do not depend on each other: a task has the links and some registers of all vertices, and follows them through all hops.

    What a vertex needs for its estimate at a hop are the sum of 2 ** -register and the number of registers at 0; both are added up in one integer, over the slices of a task and then over the tasks.
    """
    spark = step.sparkSession
    t = step.orderBy("center", "other").toArrow()
    center, other = (t.column(c).to_numpy() for c in ("center", "other"))
    del t
    at, first, size = np.unique(center, return_index=True, return_counts=True)
    names = np.union1d(at, other)
    order = np.argsort(-size, kind="stable")  # hubs first, then centers of as many links side by side
    size = size[order]
    begin = np.append(0, np.cumsum(size))
    other = other[np.repeat(first[order] - begin[:-1], size) + np.arange(len(other))]
    links = names, np.searchsorted(names, at[order]).astype(np.int32), begin.astype(np.int32), np.searchsorted(names, other).astype(np.int32)
    del center, other, at, first, size, begin, order
    n, m = len(names), 1 << bits
    width = max(1, min(m, REACH_NUMBERS // n))
    slices = -(-m // width)
    tasks = min(slices, spark.sparkContext.defaultParallelism)
    whole = spark.sparkContext.broadcast(links)

    def run(batches):
        names, at, begin, other = whole.value
        h = mixed(names.astype(np.uint64)[:, None], 1)
        bucket, rest = (h & np.uint64(m - 1)).astype(np.int64), (h >> np.uint64(bits)) | np.uint64(1 << 30)
        rho = (np.log2((rest & (~rest + np.uint64(1))).astype(np.float64)) + 1).astype(np.uint8)
        value = np.array([(1 << 44) + (1 << 31)] + [1 << (31 - i) for i in range(1, 32)], np.int64)
        total = np.zeros((most + 1, len(names)), np.int64)
        size = np.diff(begin)
        hubs = int((size > 32).sum())
        cuts = [0]  # centers in blocks of links, as each block's other ends are gathered
        while cuts[-1] < hubs:
            cuts.append(min(hubs, max(cuts[-1] + 1, int(np.searchsorted(begin, begin[cuts[-1]] + REACH_BLOCK // width, "right")) - 1)))
        cuts += list(range(hubs + REACH_BLOCK // width + 1, len(at), REACH_BLOCK // width + 1)) + [len(at)] * (hubs < len(at))

        def near(state, a, b):
            """The most of each register among the neighbours of the centers from a to b."""
            if a < hubs:
                return np.maximum.reduceat(state[other[begin[a] : begin[b]]], begin[a:b] - begin[a], axis=0)
            out = state[other[begin[a:b]]]
            for i in range(1, int(size[a])):
                c = a + int(np.searchsorted(-size[a:b], -i))
                np.maximum(out[: c - a], state[other[begin[a:c] + i]], out=out[: c - a])
            return out

        for k in (x for b in batches for x in b.column(0).to_pylist()):
            for j in range(k * width, m, tasks * width):
                mine = np.flatnonzero((bucket >= j) & (bucket < j + width))
                state = np.zeros((len(names), min(width, m - j)), np.uint8)
                state[mine, bucket[mine] - j] = rho[mine]
                here = np.full(len(names), value[0] * state.shape[1])
                for d in range(most + 1):
                    moved = np.zeros(len(names), bool)
                    if d:
                        after = state.copy()
                        for a, b in zip(cuts, cuts[1:]):
                            old = state[at[a:b]]
                            new = np.maximum(old, near(state, a, b))
                            moved[at[a:b]] = (new != old).any(axis=1)
                            after[at[a:b]] = new
                        state = after
                    else:
                        moved[mine] = True
                    changed = np.flatnonzero(moved)
                    for i in range(0, len(changed), REACH_BLOCK // 4 // width + 1):
                        rows = changed[i : i + REACH_BLOCK // 4 // width + 1]
                        here[rows] = value[state[rows]].sum(axis=1)
                    if not len(changed):
                        total[d:] += here
                        break
                    total[d] += here
        for i in range(0, len(names), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(names[i : i + (1 << 16)]), *(pa.array(x[i : i + (1 << 16)]) for x in total)], names=["id", *(f"s{d}" for d in range(most + 1))])

    parts = spark.range(0, tasks, 1, tasks).mapInArrow(run, "id bigint, " + ", ".join(f"s{d} bigint" for d in range(most + 1)))
    summed = parts.groupBy("id").agg(*(F.sum(f"s{d}").alias(f"s{d}") for d in range(most + 1)))

    def size(s):
        zero, weight = F.shiftright(s, 44), s.bitwiseAND(F.lit((1 << 44) - 1)) / float(1 << 31)
        raw = F.lit(0.7213 / (1 + 1.079 / m) * m * m) / weight
        few = F.lit(float(m)) * F.log(F.lit(float(m)) / F.greatest(zero, F.lit(1)))
        return F.round(F.when((zero > 0) & (few <= 2.5 * m), few).otherwise(raw)).cast("bigint")

    each = F.array(*(F.struct(F.lit(d).alias("d"), (size(F.col(f"s{d}")) if d else F.lit(1).cast("bigint")).alias("size")) for d in range(most + 1)))
    out = spill(summed.select("id", F.inline(each)))
    alone = ids.join(out.where("d = 0").select("id"), "id", "left_anti").select("id", F.lit(0).alias("d"), F.lit(1).cast("bigint").alias("size"))
    return out.unionByName(alone)


def centrality(g: Graph, algorithm: str = "Harmonic", direction: str = "incoming edges", most: int = 10, bits: int | None = 12, name: str = "centrality") -> DataFrame:
    """Harmonic, Lin or Average distance centrality from the numbers of vertices within each distance: id and value.

    With ``bits`` the sets of vertices are HLL sketches merged along the edges (no row grows with the graph), without exact sets.
    Harmonic: sum of new vertices / d. Lin: size**2 / sum of distances (1.0 alone). Average distance: sum of distances / (size - 1) (0 alone).
    """
    reach = _reach(g, direction, most, bits)
    new = F.col("size") - F.coalesce(F.lag("size").over(Window.partitionBy("id").orderBy("d")), F.lit(0))
    per = reach.withColumn("new", F.greatest(new, F.lit(0))).groupBy("id").agg(
        F.sum(F.when(F.col("d") > 0, F.col("new") / F.col("d")).otherwise(0.0)).alias("harmonic"),
        F.sum(F.col("new") * F.col("d")).cast("double").alias("far"), F.max("size").cast("double").alias("size"),
    )
    value = {
        "Harmonic": F.col("harmonic"),
        "Lin": F.when(F.col("far") == 0, 1.0).otherwise(F.try_divide(F.col("size") ** 2, F.col("far"))),
        "Average distance": F.coalesce(F.try_divide(F.col("far"), F.col("size") - 1), F.lit(0.0)),
    }[algorithm]
    return per.select("id", value.alias(name))


def closeness(g: Graph, samples: int = 1000, harmonic: bool = False, name: str = "centrality") -> DataFrame:
    """Closeness over outgoing paths, from a sample of target vertices (all, if there are no more): id and value.

    Closeness: reached / sum of distances, times reached share; harmonic: sum of 1/d over n - 1.
    """
    n = g.vertices.count()
    targets = g.vertices.select("id") if samples >= n else g.vertices.select("id").orderBy(F.xxhash64("id")).limit(samples)
    d = distances(g, "incoming edges", 10**6, targets).where("d > 0")
    scale = n / max(1, min(samples, n))
    per = d.groupBy("id").agg(F.count(F.lit(1)).alias("k"), F.sum("d").alias("far"), F.sum(F.lit(1.0) / F.col("d")).alias("h"))
    value = F.col("h") * scale / max(1, n - 1) if harmonic else (F.col("k") * scale / max(1, n - 1)) * (F.col("k") / F.col("far"))
    return g.vertices.select("id").join(per.select("id", value.alias(name)), "id", "left").fillna(0.0, [name])


def betweenness(g: Graph, samples: int | None = None, name: str = "centrality") -> DataFrame:
    """Brandes' betweenness over undirected simple paths, from all sources or a sample scaled up: id and value (each pair counts once).

    One breadth-first search for all sources at once gives path counts by level, and dependencies are summed level by level back.
    """
    step = spill(neighbours(g.need_edges()))
    n = g.vertices.count()
    chosen = g.vertices.select("id") if samples is None or samples >= n else g.vertices.select("id").orderBy(F.xxhash64("id")).limit(samples)
    level = spill(chosen.select(F.col("id").alias("source"), "id", F.lit(0).alias("d"), F.lit(1.0).alias("paths")))
    seen, levels = level, [level]
    while True:
        onward = level.join(step.withColumnRenamed("center", "id"), "id").groupBy("source", F.col("other").alias("id")).agg(F.sum("paths").alias("paths"))
        level = spill(onward.join(seen.select("source", "id"), ["source", "id"], "left_anti").select("source", "id", F.lit(len(levels)).alias("d"), "paths"))
        if not level.limit(1).count():
            break
        levels.append(level)
        seen = seen.unionByName(level)
    below, total = None, []
    for here in reversed(levels):
        if below is None:
            here = here.withColumn("dep", F.lit(0.0))
        else:
            share = below.select("source", F.col("id").alias("center"), ((1 + F.col("dep")) / F.col("paths")).alias("x")).join(step, "center")
            got = share.groupBy("source", F.col("other").alias("id")).agg(F.sum("x").alias("x"))
            here = here.join(got, ["source", "id"], "left").withColumn("dep", F.col("paths") * F.coalesce("x", F.lit(0.0))).drop("x")
        below = spill(here)
        total.append(below.where("source <> id").select("id", "dep"))
    every = total[0]
    for t in total[1:]:
        every = every.unionByName(t)
    scale = 1.0 if samples is None or samples >= n else n / samples
    per = every.groupBy("id").agg((F.sum("dep") * scale / 2).alias(name))
    return g.vertices.select("id").join(per, "id", "left").fillna(0.0, [name])


def power_iteration(g: Graph, kind: str = "Eigenvector", iterations: int = 50, alpha: float | None = None, beta: float = 0.1, tolerance: float = 1e-9, name: str = "centrality") -> DataFrame:
    """Eigenvector (x = in-neighbours' sum) or Katz (x = alpha * sum + beta) centrality, of unit length: id and value."""
    e = spill(g.need_edges().groupBy("src", "dst").agg(F.count(F.lit(1)).alias("w")))
    ids = spill(g.vertices.select("id"))
    if kind == "Katz" and alpha is None:
        alpha = 1.0 / (1 + (e.groupBy("dst").agg(F.sum("w").alias("d")).agg(F.max("d")).first()[0] or 0))
    x = ids.withColumn("x", F.lit(1.0))
    last = None
    for _ in range(iterations):
        moved = e.join(x.withColumnRenamed("id", "src"), "src").groupBy(F.col("dst").alias("id")).agg(F.sum(F.col("x") * F.col("w")).alias("y"))
        y = F.coalesce("y", F.lit(0.0))
        after = spill(ids.join(moved, "id", "left").select("id", (alpha * y + beta if kind == "Katz" else y + 1e-12).alias("y")))
        norm = after.agg(F.sqrt(F.sum(F.col("y") ** 2))).first()[0] or 1.0
        scale = 1.0 if kind == "Katz" else norm
        x = after.select("id", (F.col("y") / scale).alias("x"))
        if last is not None and abs(norm - last) < tolerance * max(1.0, norm):
            break
        last = norm
    return x.select("id", (F.col("x") / (norm / scale)).alias(name))


def laplacian_centrality(g: Graph, name: str = "centrality") -> DataFrame:
    """d**2 + d + 2 * the out-neighbours' degrees, d being the number of outgoing edges: id and value."""
    e = g.need_edges().select("src", "dst")
    d = e.groupBy("src").agg(F.count(F.lit(1)).alias("d"))
    near = e.join(d.withColumnsRenamed({"src": "dst", "d": "k"}), "dst", "left").groupBy("src").agg(F.sum(F.coalesce("k", F.lit(0))).alias("k"))
    out = g.vertices.select("id").join(d.withColumnRenamed("src", "id"), "id", "left").join(near.withColumnRenamed("src", "id"), "id", "left").fillna(0)
    return out.select("id", (F.col("d") * F.col("d") + F.col("d") + 2 * F.col("k")).cast("double").alias(name))


def sfigality(g: Graph, name: str = "centrality") -> DataFrame:
    """Share of the neighbours that have more neighbours than the vertex: id and value."""
    near = neighbours(g.need_edges())
    d = near.groupBy("center").agg(F.count(F.lit(1)).alias("d"))
    per = near.join(d, "center").join(d.select(F.col("center").alias("other"), F.col("d").alias("k")), "other").groupBy(F.col("center").alias("id")).agg((F.count_if(F.col("k") > F.col("d")) / F.count(F.lit(1))).alias(name))
    return g.vertices.select("id").join(per, "id", "left").fillna(0.0, [name])


def k_path_centrality(g: Graph, k: int = 3, samples: int = 1000, seed: int = 0, name: str = "centrality") -> DataFrame:
    """How often random simple paths of 1 to ``k`` edges visit a vertex after their start, times vertices over paths: id and value.

    Starts, lengths and turns are hashes; every path is a row, extended once a round. Of a vertex's neighbours in order, those on the path (at most
    ``k``) are passed over by their numbers.
    """
    near, degree = in_order(neighbours(g.need_edges()).select(F.col("center").alias("at"), F.col("other").alias("to")), "at", "to")
    n = max(1, g.vertices.count())
    each = -(-samples // n)
    w = g.vertices.select(F.col("id").alias("at"), F.explode(F.sequence(F.lit(1), F.lit(each))).alias("i")).withColumn("w", F.xxhash64("at", "i", F.lit(seed)))
    w = spill(w.select("w", "at", F.array("at").alias("path"), (F.pmod(F.col("w"), F.lit(k)) + 1).alias("length")))
    visits = None
    for step in range(1, k + 1):
        going = w.where(F.col("length") >= step)
        used = going.select("w", "at", F.explode("path").alias("to")).join(near, ["at", "to"]).groupBy("w").agg(F.sort_array(F.collect_list("k")).alias("used"))
        turn = split_join(going, degree, ["at"]).join(used, "w", "left").withColumn("used", F.coalesce("used", F.array().cast("array<int>"))).withColumn("free", F.col("d") - F.size("used")).where("free > 0")
        pick = F.aggregate("used", F.pmod(F.xxhash64("w", F.lit(step)), F.col("free")).cast("int"), lambda x, u: F.when(x >= u, x + 1).otherwise(x))
        turn = turn.select("w", "length", "path", "at", pick.alias("k")).join(near, ["at", "k"])
        w = spill(turn.select("w", F.col("to").alias("at"), F.concat("path", F.array("to")).alias("path"), "length"))
        here = w.select("at")
        visits = here if visits is None else visits.unionByName(here)
    per = visits.groupBy(F.col("at").alias("id")).agg((F.count(F.lit(1)) / each).alias(name))
    return g.vertices.select("id").join(per, "id", "left").fillna(0.0, [name])


def diameter(g: Graph, max_error: float = 0.0) -> tuple[int, int]:
    """Lower and upper bound of the longest shortest undirected path (infinite distances aside): equal, unless ``max_error`` allows a relative difference.

    A breadth-first search from one vertex of each component at a time bounds the eccentricity of all others: it is at least d and e - d, at most e + d, d being the distance to that
    vertex and e its eccentricity. Vertices that cannot be farther from any other than what was found drop out; the next search starts at the one with the highest upper bound, then at
    that with the lowest lower one. So a round has as many rows as there are vertices, and few rounds do.
    """
    near = neighbours(g.need_edges()).select(F.col("center").alias("id")).distinct()
    far = F.lit(1 << 40)
    state = spill(connected_components(g).join(near, "id").select("id", "component", F.lit(0).cast("bigint").alias("low"), far.alias("up")))
    best, k = 0, 0
    while True:
        left = state.where(F.col("up") > best)
        top = left.agg(F.max("up")).first()[0]
        if top is None:
            return best, best
        if max_error > 0 and top < 1 << 40 and top - best <= max_error * max(1, best):
            return best, top
        pick = F.max_by("id", F.struct("up", F.xxhash64("id"))) if k % 2 == 0 else F.min_by("id", F.struct("low", F.xxhash64("id")))
        d = spill(distances(g, "all edges", 10**9, spill(left.groupBy("component").agg(pick.alias("id")).select("id"))))
        reach = d.groupBy("source").agg(F.max("d").cast("bigint").alias("e"))
        best = max(best, reach.agg(F.max("e")).first()[0] or 0)
        found = d.join(reach, "source").select("id", "d", "e")
        after = spill(state.join(found, "id", "left").select("id", "component", F.greatest("low", F.col("d").cast("bigint"), F.col("e") - F.col("d")).alias("low"), F.least("up", F.col("e") + F.col("d")).alias("up")))
        drop(state)
        state, k = after, k + 1


def effective_diameter(g: Graph, ratio: float = 0.9, bits: int | None = None) -> float:
    """Least number of hops within which ``ratio`` of all connected ordered pairs lie. With ``bits`` an estimate by HLL sketches."""
    reach = _reach(g, "all edges", 10**6, bits).groupBy("d").agg(F.sum("size").alias("n")).orderBy("d").collect()
    if not reach:
        return 0.0
    goal = ratio * reach[-1].n
    return float(next(r.d for r in reach if r.n >= goal))


def spanning_tree(g: Graph, weight: str | None = None, optimize: str = "Minimal weight", name: str = "in_tree") -> DataFrame:
    """eid and 1.0 for the edges of an optimal spanning forest (Boruvka; ties by eid)."""
    w = (F.col(weight) if weight else F.lit(1.0)) * (1 if optimize.startswith("Min") else -1)
    e = spill(g.need_edges().where("src <> dst").select("eid", F.col("src").alias("a"), F.col("dst").alias("b"), w.cast("double").alias("w")))
    chosen = []
    while rows_of(e):
        ends = e.select("eid", "w", F.inline(F.array(F.struct(F.col("a").alias("c"), F.col("b").alias("o")), F.struct(F.col("b").alias("c"), F.col("a").alias("o")))))
        best = spill(ends.groupBy("c").agg(F.min(F.struct("w", "eid", "o")).alias("e")).select("c", "e.eid", "e.o"))
        n = rows_of(best)
        chosen.append(best.select("eid").distinct())
        # the chosen edges form trees, each with one pair that chose each other; its smaller end is the root
        back = best.select(F.col("c").alias("o"), F.col("o").alias("back"))
        lead = spill(split_join(best, back, ["o"], right_rows=n).select("c", F.when((F.col("back") == F.col("c")) & (F.col("c") < F.col("o")), F.col("c")).otherwise(F.col("o")).alias("o")))
        while True:
            onward = lead.select(F.col("c").alias("o"), F.col("o").alias("o2"))
            after = spill(split_join(lead, onward, ["o"], right_rows=n).select("c", F.col("o2").alias("o"), (F.col("o2") != F.col("o")).alias("moved")))
            lead = after.drop("moved")
            if not after.where("moved").limit(1).count():
                break
        x, y = lead.select(F.col("c").alias("a"), F.col("o").alias("x")), lead.select(F.col("c").alias("b"), F.col("o").alias("y"))
        after = split_join(split_join(e, x, ["a"], right_rows=n), y, ["b"], right_rows=n)
        after = spill(after.where("x <> y").select("eid", F.col("x").alias("a"), F.col("y").alias("b"), "w"))
        drop(e)
        e = after
    out = g.spark.createDataFrame([], "eid bigint")
    for c in chosen:
        out = out.unionByName(c)
    return out.distinct().withColumn(name, F.lit(1.0))


def coloring(g: Graph, name: str = "color") -> DataFrame:
    """id and a proper colour from 1.0: in each round the uncoloured vertices that come first around them, by
    (degree, hash), take the least colour their neighbours do not have. Each round colours at least one, until all have a colour."""
    links = neighbours(g.need_edges()).withColumnsRenamed({"center": "v", "other": "u"})
    deg = links.groupBy("v").agg(F.count(F.lit(1)).alias("d"))
    order = F.struct(F.col("d"), F.xxhash64("v"), F.col("v"))
    keyed = deg.select("v", order.alias("k"))
    links = spill(links.join(keyed, "v").join(keyed.withColumnsRenamed({"v": "u", "k": "ku"}), "u").select("v", "u", (F.col("ku") > F.col("k")).alias("before")))
    done = [spill(g.vertices.select(F.col("id").alias("v")).join(deg, "v", "left_anti").select("v", F.lit(1).alias("c")))]
    left = spill(deg.select("v"), n=F.count(F.lit(1)))
    while n := left.seen["n"]:
        # links of uncoloured vertices; those of coloured ends that come before say what is taken
        open_ = split_join(links.where("before"), left.withColumnRenamed("v", "u"), ["u"], "left_semi", right_rows=n).select("v").distinct()
        ready = left.join(open_, "v", "left_anti")
        used = together(done).withColumnRenamed("v", "u").join(links.join(ready, "v", "left_semi"), "u").groupBy("v").agg(F.array_sort(F.collect_set("c")).alias("used"))
        free = F.coalesce(F.expr("filter(sequence(1, size(used) + 1), x -> not array_contains(used, x))[0]"), F.lit(1))
        now = spill(ready.join(used, "v", "left").select("v", free.alias("c")))
        done.append(now)
        after = spill(left.join(now, "v", "left_anti"), n=F.count(F.lit(1)))
        drop(left)
        left = after
    return together(done).select(F.col("v").alias("id"), F.col("c").cast("double").alias(name))


def label_propagation(g: Graph, weight: str | None = None, variant: str = "classic", iterations: int = 20) -> DataFrame:
    """id and label: every vertex takes the label of most weight around it, ties to the smaller; half of the vertices move in a round."""
    e = both_ways(g.need_edges().where("src <> dst").withColumn("w", F.col(weight).cast("double") if weight else F.lit(1.0)), "w")
    e = spill(e.groupBy("center", "other").agg(F.sum("w").alias("w")))
    label = spill(g.vertices.select(F.col("id").alias("other"), F.col("id").alias("l")))
    n = rows_of(label)
    heavy = heavy_keys(e, ["other"], 0.02)["other"] if n > BROADCAST_ROWS else []
    still = 0
    for k in range(2 * iterations):
        half = F.pmod(F.xxhash64("center"), F.lit(2)) == k % 2 if variant == "classic" else F.pmod(F.xxhash64("center", F.lit(k // 2)), F.lit(2)) == k % 2
        votes = split_join(e.where(half), label, ["other"], heavy=heavy, right_rows=n).groupBy("center", "l").agg(F.sum("w").alias("w")).groupBy("center").agg(F.max_by("l", F.struct(F.col("w"), -F.col("l"))).alias("n"))
        after = spill(label.join(votes.withColumnRenamed("center", "other"), "other", "left").select("other", F.coalesce("n", "l").alias("l"), (F.coalesce(F.col("n"), F.col("l")) != F.col("l")).alias("moved")))
        moved = after.where("moved").limit(1).count()
        drop(label)
        label = after.select("other", "l")
        still = 0 if moved else still + 1
        if still == 2:
            break
    return label.select(F.col("other").alias("id"), F.col("l").alias("label"))


def louvain(g: Graph, weight: str | None = None, resolution: float = 1.0, max_iterations: int = 10, least_gain: float = 1e-3, last: int = 0) -> DataFrame:
    """id and label of communities found by rounds of local moves and contraction; edges are undirected, loops weigh double.

    Moves are proposed for a random half of the vertices at a time. A round of moves is kept only if it raises modularity. With ``last`` (as in modular clustering) all ends
    when the last so many rounds gained at most ``least_gain`` each on average, or after ``max_iterations`` rounds (negative: no limit); else each level ends after three rounds of little gain.
    """
    e = g.need_edges().select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"), (F.col(weight) if weight else F.lit(1.0)).cast("double").alias("w"))
    e = spill(e.groupBy("a", "b").agg(F.sum("w").alias("w")))
    total = 2 * (e.agg(F.sum("w")).first()[0] or 0.0)
    assigned = spill(g.vertices.select("id", F.col("id").alias("l")))
    if not total:
        return assigned.withColumnRenamed("l", "label")

    def quality(e: DataFrame, c: DataFrame) -> float:
        x = e.join(c.select(F.col("v").alias("a"), F.col("c").alias("s")), "a").join(c.select(F.col("v").alias("b"), F.col("c").alias("t")), "b")
        per = x.select("w", F.inline(F.array(F.struct(F.col("s").alias("c")), F.struct(F.col("t").alias("c")))), (F.col("s") == F.col("t")).alias("i")).groupBy("c").agg(F.sum("w").alias("k"), F.sum(F.when(F.col("i"), F.col("w")).otherwise(0.0)).alias("i"))
        return per.agg(F.sum(F.col("i") / total - resolution * (F.col("k") / total) ** 2)).first()[0] or 0.0

    before, gains, ended = -1.0, [], False
    for level in count() if last else range(max_iterations):
        links = spill(both_ways(e.select(F.col("a").alias("src"), F.col("b").alias("dst"), "w"), "w"))
        k = spill(links.groupBy(F.col("center").alias("v")).agg(F.sum("w").alias("k")))
        c = spill(k.select("v", F.col("v").alias("c")))
        n = rows_of(c)
        heavy = heavy_keys(links, ["other"], 0.02)["other"] if n > BROADCAST_ROWS else []
        best = quality(e, c)
        stale = 0
        for r in count() if last else range(4 * max_iterations):
            sums = c.join(k, "v").groupBy("c").agg(F.sum("k").alias("volume"))
            near = split_join(links.where("center <> other"), c.withColumnsRenamed({"v": "other", "c": "d"}), ["other"], heavy=heavy, right_rows=n).groupBy(F.col("center").alias("v"), "d").agg(F.sum("w").alias("w"))
            own = c.select("v", F.col("c").alias("d")).withColumn("w", F.lit(0.0))
            options = near.unionByName(own).groupBy("v", "d").agg(F.sum("w").alias("w")).join(k, "v").join(c, "v").join(sums.withColumnRenamed("c", "d"), "d")
            gain = F.col("w") - resolution * F.col("k") * (F.col("volume") - F.when(F.col("d") == F.col("c"), F.col("k")).otherwise(0.0)) / total
            turn = F.pmod(F.xxhash64("v", F.lit(level * 1000 + r)), F.lit(2)) == 0
            pick = options.where(turn).groupBy("v").agg(F.max_by("d", F.struct(gain, F.col("d") == F.col("c"), -F.col("d"))).alias("n"))
            moved = spill(c.join(pick, "v", "left").select("v", F.coalesce("n", "c").alias("c")))
            now = quality(e, moved)
            gains.append(max(0.0, now - best))
            ended = bool(last) and (len(gains) >= last and sum(gains[-last:]) <= last * least_gain or 0 <= max_iterations <= len(gains))
            if now > best + 1e-9:
                c, best, stale = moved, now, 0 if now > best + least_gain else stale + 1
            else:
                stale += 1
            if ended or stale >= 3:
                break
        assigned = spill(assigned.join(c.withColumnsRenamed({"v": "l", "c": "n"}), "l", "left").select("id", F.coalesce("n", "l").alias("l")))
        if ended or best <= before + least_gain:
            break
        before = best
        x = e.join(c.select(F.col("v").alias("a"), F.col("c").alias("s")), "a").join(c.select(F.col("v").alias("b"), F.col("c").alias("t")), "b")
        e = spill(x.groupBy(F.least("s", "t").alias("a"), F.greatest("s", "t").alias("b")).agg(F.sum("w").alias("w")))
    return assigned.select("id", F.col("l").alias("label"))
