"""Segmentations found in the structure: components, cliques, triangles, communities."""

from __future__ import annotations

import math
from itertools import combinations, islice
from tempfile import TemporaryFile

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..graph import Graph, Segmentation, clash_free, with_id
from ..runtime import mixed, spill
from . import iterative, metrics
from .segment import from_labels, overlapping

#: Numbers in a block of the tests whether a clique is extended by an earlier vertex, and in a block of cliques.
BLOCK = 1 << 20
#: Excluded candidates up to which all of them are tried for branching.
PIVOTS = 64


def find_connected_components(g: Graph, directions: str = "ignore directions", name: str = "connected_components") -> Graph:
    return from_labels(g, name, iterative.connected_components(g, directions).withColumnRenamed("component", "label"))


def find_triangles(g: Graph, both_directions: bool = False, name: str = "triangles") -> Graph:
    """A segment for each triangle."""
    t = spill(metrics.triangles(g.need_edges(), both_directions))
    t = with_id(t, ["a", "b", "c"], clash_free(t, ["a", "b", "c"]), "sid")
    return g.with_segmentation(name, Segmentation(Graph(t.select(F.col("sid").alias("id"))), t.select(F.explode(F.array("a", "b", "c")).alias("vid"), "sid")))


def _pivot_cliques(near: list[int], n: int, least: int):
    """All maximal cliques of at least ``least`` of the vertices 0, 1, ..., n - 1, whose neighbours are the bits of ``near``, as bits: by branching on what the best-linked candidate does not cover. No recursion.

    Vertices from n on belong to no clique, but what one of them extends is left out; their own bits in ``near`` are those below n only."""
    inside = (1 << n) - 1
    stack = [(0, inside, (1 << len(near)) - 1 ^ inside)]
    while stack:
        r, p, x = stack.pop()
        if not p and not x:
            if r.bit_count() >= least:
                yield r
            continue
        if not p or r.bit_count() + p.bit_count() < least:
            continue
        left = p & ~near[max(_bits(p | (x if x.bit_count() <= PIVOTS else x & inside)), key=lambda v: (p & near[v]).bit_count())]
        for v in _bits(left):
            stack.append((r | 1 << v, p & near[v], x & near[v]))
            p ^= 1 << v
            x |= 1 << v


def _bits(x: int):
    while x:
        low = x & -x
        yield low.bit_length() - 1
        x ^= low


def _numbers(rows: np.ndarray) -> list[int]:
    """Rows of bits, eight a byte, as numbers."""
    return [int.from_bytes(x.tobytes(), "little") for x in rows]


class _Fan:
    """The cliques whose first member is ``at``: from the links (p, q) among its later neighbours, and then, for each earlier neighbour, which of those are its neighbours, too.

    The cliques are never held together: they are found when all earlier neighbours are known, and go out some at a time. Of the earlier neighbours, different rows of bits of up to about 2 * ``BLOCK`` bytes
    are held for the search; the rest goes to a file of the task, with which the cliques found are compared.
    """

    def __init__(self, at: int, least: int):
        self.at, self.least, self.links, self.ids = at, least, [], None
        self.held, self.size, self.file = [], 0, None

    def link(self, p: np.ndarray, q: np.ndarray) -> None:
        self.links.append((p, q))

    def begin(self) -> None:
        p, q = (np.concatenate(x) for x in zip(*self.links))
        self.links = []
        self.ids, at = np.unique(np.concatenate([p, q]), return_inverse=True)
        i, j = np.split(at, 2)
        i, j = np.append(i, j), np.append(j, i)
        order = np.argsort(i, kind="stable")
        self.near = [x for rows in self.packed(i[order], j[order]) for x in _numbers(rows)]

    def packed(self, k: np.ndarray, pos: np.ndarray):
        """Rows 0, 1, ..., eight bits a byte, of which row ``k`` has the bits ``pos``, in the order of ``k``; some at a time."""
        step = max(1, BLOCK // len(self.ids))
        for a in range(0, int(k[-1]) + 1 if len(k) else 0, step):
            s, e = np.searchsorted(k, [a, a + step])
            rows = np.zeros((int(k[e - 1]) + 1 - a, len(self.ids)), bool)
            rows[k[s:e] - a, pos[s:e]] = True
            yield np.packbits(rows, axis=1, bitorder="little")

    def unpacked(self, rows: np.ndarray) -> np.ndarray:
        return np.unpackbits(rows, axis=1, count=len(self.ids), bitorder="little")

    def before(self, w: np.ndarray, m: np.ndarray) -> None:
        """Take what of the later neighbours earlier ones are linked to. All rows of a ``w`` are in one call, in its order."""
        pos = np.minimum(np.searchsorted(self.ids, m), len(self.ids) - 1)
        keep = self.ids[pos] == m
        w, pos = w[keep], pos[keep]
        _, k, n = np.unique(w, return_inverse=True, return_counts=True)
        keep = n[k] >= self.least - 1  # others have no clique among their neighbours
        _, k = np.unique(w[keep], return_inverse=True)
        for rows in self.packed(k, pos[keep]):
            if self.file is not None:
                self.file.write(rows.tobytes())
                continue
            self.held.append(rows)
            self.size += rows.size
            if self.size > 2 * BLOCK:
                self.held = [np.unique(np.concatenate(self.held), axis=0)]
                self.size = self.held[0].size
                if self.size > BLOCK:
                    self.file = TemporaryFile()

    def found(self):
        """The cliques without ``at``, as rows of bits, some at a time."""
        n, wide = len(self.ids), -(-len(self.ids) // 8)
        held = np.unique(np.concatenate(self.held), axis=0) if self.held else np.zeros((0, wide), np.uint8)
        across = _numbers(np.packbits(self.unpacked(held).T, axis=1, bitorder="little"))
        cliques = _pivot_cliques([x | y << n for x, y in zip(self.near, across)] + _numbers(held), n, self.least - 1)
        while some := list(islice(cliques, max(1, BLOCK // n))):
            rows = np.frombuffer(b"".join(c.to_bytes(wide, "little") for c in some), np.uint8).reshape(-1, wide)
            yield rows if self.file is None else rows[~self.extended(rows)]

    def extended(self, cliques: np.ndarray) -> np.ndarray:
        """Whether an earlier neighbour in the file is linked to the whole clique."""
        part = self.unpacked(cliques).astype(np.float32)
        size, out = part.sum(axis=1)[:, None], np.zeros(len(part), bool)
        step = max(1, BLOCK // max(part.shape)) * cliques.shape[1]
        self.file.seek(0)
        while block := self.file.read(step):
            rows = self.unpacked(np.frombuffer(block, np.uint8).reshape(-1, cliques.shape[1])).astype(np.float32)
            out |= (part @ rows.T == size).any(axis=1)
        return out

    def members(self):
        """Sorted members and their number for each clique, some at a time."""
        for rows in self.found():
            k, i = np.nonzero(np.c_[self.unpacked(rows), np.ones(len(rows), np.uint8)])
            ids = np.append(self.ids, self.at)[i]
            ids = ids[np.lexsort((ids, k))]
            yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(np.bincount(k))), pa.int32()), pa.array(ids, pa.int64()))], names=["members"])


def _first_cliques(least: int):
    def run(batches):
        """Rows at, w, p, q, ordered: a link (p, q) of two later neighbours of ``at`` without w; then (w, p), where p is a later neighbour of ``at`` and linked to the earlier neighbour w."""
        fan, rest = None, None
        for batch in batches:
            at, p, q = (batch.column(c).fill_null(0).to_numpy() for c in ("at", "p", "q"))
            first, w = batch.column("w").is_null().to_numpy(zero_copy_only=False), batch.column("w").fill_null(0).to_numpy()
            cuts = np.flatnonzero(np.append(True, at[1:] != at[:-1])).tolist() if len(at) else []
            for i, j in zip(cuts, [*cuts[1:], len(at)]):
                if fan is None or fan.at != at[i]:
                    yield from _ended(fan, rest)
                    fan, rest = _Fan(int(at[i]), least), None
                s = i + int(first[i:j].sum())
                if s > i:
                    fan.link(p[i:s], q[i:s])
                if s < j and (fan.links or fan.ids is not None):
                    if fan.ids is None:
                        fan.begin()
                    ws, ms = w[s:j], p[s:j]
                    if rest is not None:
                        ws, ms = np.append(rest[0], ws), np.append(rest[1], ms)
                    cut = int(np.searchsorted(ws, ws[-1]))  # the last one may go on in the next batch
                    fan.before(ws[:cut], ms[:cut])
                    rest = ws[cut:], ms[cut:]
        yield from _ended(fan, rest)

    return run


def _ended(fan: _Fan | None, rest):
    if fan is None or not fan.links and fan.ids is None:
        return
    if fan.ids is None:
        fan.begin()
    if rest is not None:
        fan.before(*rest)
    yield from fan.members()


def maximal_cliques(edges: DataFrame, both_directions: bool = False, least: int = 3) -> DataFrame:
    """Arrays of the members of all maximal cliques of at least ``least`` vertices: members, in order.

    Every clique is found at its member of lowest (degree, id), from the links among that vertex's later neighbours, of which there are at most sqrt(2 * pairs), without
    those that an earlier neighbour extends. Both come from the triangles as sorted rows that stream through the task, so no row holds a hub's neighbours; a task holds no more than a block of the cliques.
    """
    pairs = spill(metrics.simple_pairs(edges, both_directions))
    t = metrics.fans(spill(metrics.oriented(pairs)))
    if least < 3:
        t = spill(t)
    last = F.when(F.col("middle") == F.col("p"), F.col("q")).otherwise(F.col("p"))
    none = F.lit(None).cast("bigint")
    rows = t.select(F.inline(F.array(F.struct(F.col("x").alias("at"), none.alias("w"), F.col("p"), F.col("q")), F.struct(F.col("middle").alias("at"), F.col("x").alias("w"), last.alias("p"), none.alias("q")))))
    out = rows.repartition("at").sortWithinPartitions("at", F.asc_nulls_first("w")).mapInArrow(_first_cliques(max(least, 3)), "members array<bigint>")
    if least > 2:
        return out
    # with less than three, also the pairs in no triangle
    sides = t.select(F.inline(F.array(*(F.struct(F.least(*x).alias("a"), F.greatest(*x).alias("b")) for x in (("x", "p"), ("x", "q"), ("p", "q"))))))
    return out.unionByName(pairs.join(sides.distinct(), ["a", "b"], "left_anti").select(F.array("a", "b").alias("members")))


def find_maximal_cliques(g: Graph, both_directions: bool = False, least: int = 3, name: str = "maximal_cliques") -> Graph:
    c = spill(maximal_cliques(g.need_edges(), both_directions, least))
    c = with_id(c, ["members"], clash_free(c, ["members"]), "sid")
    v = c.select(F.col("sid").alias("id"), F.size("members").cast("double").alias("size"))
    return g.with_segmentation(name, Segmentation(Graph(v), c.select(F.explode("members").alias("vid"), "sid")))


def _least_shared(a: int, b: int, threshold: float) -> int:
    return math.ceil(threshold * (a + b) * (a * a + b * b) / (4 * a * b))


def _overlap_links(m: DataFrame, threshold: float, most: int = 500) -> DataFrame:
    """src, dst: links between cliques (sid, vid, size) with the same components as those of all pairs that share enough.

    Cliques of sizes a <= b are linked if they have a set of as many vertices as they must share in common. All that have one set in common are linked to the least of them, not each to each:
    that takes a row for each set of a clique, not for each pair. (Two of size b alone need not be linked; with one of size a they are, over it.) Sizes that have
    more than ``most`` such sets are compared in pairs.
    """
    sizes = sorted(int(r[0]) for r in m.select("size").distinct().collect())
    need = {(a, b): _least_shared(a, b, threshold) for a in sizes for b in sizes if a <= b}
    need = {k: max(n, 1) for k, n in need.items() if n <= k[0]}
    by_set = {k: n for k, n in need.items() if max(math.comb(k[0], n), math.comb(k[1], n)) <= most}

    def run(batches):
        """a hash of 128 bits of each set with the sizes, the clique, and its size"""
        for batch in batches:
            size, sid = batch.column("size").to_numpy(), batch.column("sid").to_numpy()
            flat, begin = batch.column("members").flatten().to_numpy(), np.append(0, np.cumsum(size))[:-1]
            for (a, b), n in by_set.items():
                for s in {a, b}:
                    at = np.flatnonzero(size == s)
                    sets = np.array(list(combinations(range(s), n)))
                    for i in range(0, len(at), step := max(1, BLOCK // (len(sets) * n))):
                        here = at[i : i + step]
                        ids = flat[begin[here][:, None] + np.arange(s)][:, sets].astype(np.uint64)
                        h = [mixed(ids, (a << 32) + b + seed) for seed in (1 << 62, 1 << 63)]
                        yield pa.RecordBatch.from_arrays([pa.array(x.ravel().view(np.int64)) for x in h] + [pa.array(np.repeat(sid[here], len(sets))), pa.array(np.full(len(here) * len(sets), s, np.int32)), pa.array(np.full(len(here) * len(sets), a, np.int32))], names=["h", "k", "sid", "size", "a"])

    out = None
    if by_set:
        lists = m.groupBy("sid").agg(F.sort_array(F.collect_list("vid")).alias("members")).select("sid", F.size("members").cast("bigint").alias("size"), "members")
        same = Window.partitionBy("h", "k")
        sets = lists.mapInArrow(run, "h bigint, k bigint, sid bigint, size int, a int").select("sid", "a", F.min("size").over(same).alias("least"), F.min("sid").over(same).alias("first"))
        out = sets.where("sid <> first and least = a").select(F.col("sid").alias("src"), F.col("first").alias("dst")).distinct()
    left = sorted({x for k in need if k not in by_set for x in k})
    if left:
        large = m.where(F.col("size").isin(*map(float, left)))
        # what two cliques must share is at least 0.9 * threshold of the larger
        shared = overlapping(large.select("sid", "vid", F.greatest(F.lit(1), F.ceil(0.9 * threshold * F.col("size"))).alias("need")))
        of = large.groupBy("sid").agg(F.first("size").alias("size"))
        both = shared.join(of.select(F.col("sid").alias("a"), F.col("size").alias("_a")), "a").join(of.select(F.col("sid").alias("b"), F.col("size").alias("_b")), "b").select(F.col("a").alias("src"), F.col("b").alias("dst"), F.col("_a").alias("a"), F.col("_b").alias("b"), "n")
        enough = F.ceil(threshold * (F.col("a") + F.col("b")) * (F.col("a") ** 2 + F.col("b") ** 2) / (4 * F.col("a") * F.col("b")))
        pairs = both.where(F.col("n") >= enough).select("src", "dst")
        out = pairs if out is None else out.unionByName(pairs)
    return spill(out) if out is not None else m.select(F.col("sid").alias("src"), F.col("sid").alias("dst")).limit(0)


def find_infocom_communities(g: Graph, both_directions: bool = True, least: int = 3, threshold: float = 0.6, cliques: str = "maximal_cliques", communities: str = "communities") -> Graph:
    """Communities: components of the maximal cliques, two of sizes a and b being linked if they share at least
    ceil(threshold * (a + b) * (a*a + b*b) / (4*a*b)) vertices."""
    g = find_maximal_cliques(g, both_directions, least, cliques)
    s = g.segmentation(cliques)
    m = spill(s.membership.join(s.graph.vertices.select(F.col("id").alias("sid"), "size"), "sid"))
    links = _overlap_links(m, threshold)
    joined = iterative.connected_components(Graph(m.select(F.col("sid").alias("id")).distinct(), links.select("src", "dst")))
    out = m.join(joined.select(F.col("id").alias("sid"), "component"), "sid").select("vid", F.col("component").alias("sid")).distinct()
    v = out.groupBy(F.col("sid").alias("id")).agg(F.count(F.lit(1)).cast("double").alias("size"))
    return g.with_segmentation(communities, Segmentation(Graph(v), out))


def find_label_communities(g: Graph, weight: str | None = None, variant: str = "classic", name: str = "communities") -> Graph:
    return from_labels(g, name, iterative.label_propagation(g, weight, variant))


def find_louvain_communities(g: Graph, weight: str | None = None, resolution: float = 1.0, name: str = "communities") -> Graph:
    return from_labels(g, name, iterative.louvain(g, weight, resolution))


def find_modular_clustering(g: Graph, weight: str | None = None, max_iterations: int = 30, least_gain: float = 0.001, name: str = "modular_clusters") -> Graph:
    """Clusters by greedy moves and merges that raise modularity; also the scalar ``modularity``.

    It ends when the last five rounds gained at most five times ``least_gain``, or after ``max_iterations`` rounds (negative: no limit).
    """
    out = from_labels(g, name, spill(iterative.louvain(g, weight, 1.0, max_iterations, least_gain, 5)))
    return out.with_scalars(modularity=metrics.modularity(out, name, weight).first()[0])
