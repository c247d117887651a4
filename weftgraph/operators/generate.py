"""Random graphs. Draws are hashes of ids and the seed, so results do not depend on partitioning.

Models in which every step depends on the one before run on the driver; they are for graphs of up to some million
vertices, and say so.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..graph import Graph, hashed_id
from ..runtime import numbered, rows_of, spill
from .attributes import uniform
from .build import create_vertices
from .segment import kept_numbers

#: Vertices of models that are fitted on the driver, at most.
DRIVER_VERTICES = 20_000


def _graph(spark: SparkSession, n: int, edges: Sequence[tuple[int, int]]) -> Graph:
    e = spark.createDataFrame(pd.DataFrame({"eid": range(len(edges)), "src": [int(a) for a, _ in edges], "dst": [int(b) for _, b in edges]}), "eid bigint, src bigint, dst bigint")
    return create_vertices(spark, n).with_edges(e)


def _sampled_pairs(spark: SparkSession, first: int, count: int, p: float, seed: int) -> DataFrame:
    """Numbers below ``count`` kept with probability p, by geometric skips in blocks: work in proportion to what is kept."""
    if p <= 0 or count <= 0:
        return spark.createDataFrame([], "k bigint")
    block = max(1, min(count, int(20_000 / p)))

    def run(batches):
        for pdf in batches:
            out = []
            for b in pdf["id"]:
                rng = np.random.default_rng([seed, first, int(b)])
                size = min(block, count - b * block)
                out.append(kept_numbers(rng, size, p) + b * block)
            yield pd.DataFrame({"k": np.concatenate(out) if out else np.zeros(0, np.int64)})

    return spark.range(-(-count // block)).mapInPandas(run, "k bigint")


def _unordered(k: DataFrame) -> DataFrame:
    """The k-th unordered pair src > dst."""
    a = F.floor((1 + F.sqrt(1 + 8 * F.col("k").cast("double"))) / 2).cast("bigint")
    k = k.withColumn("a", a).withColumn("a", F.expr("case when a * (a - 1) div 2 > k then a - 1 when (a + 1) * a div 2 <= k then a + 1 else a end"))
    return k.select(F.col("k").alias("eid"), F.col("a").alias("src"), F.expr("k - a * (a - 1) div 2").alias("dst"))


def erdos_renyi(spark: SparkSession, size: int = 100, probability: float = 0.01, seed: int = 0) -> Graph:
    """Each unordered pair with the probability. Kept pairs are drawn directly, not filtered from all pairs."""
    return create_vertices(spark, size).with_edges(_unordered(_sampled_pairs(spark, 0, size * (size - 1) // 2, probability, seed)))


def clustered_random(spark: SparkSession, size: int = 100, clusters: int = 10, p_in: float = 0.6, p_out: float = 0.01, seed: int = 0) -> Graph:
    """Planted partition: vertex v is in cluster v mod ``clusters``; attribute ``cluster``."""
    pair = lambda p, k: _unordered(_sampled_pairs(spark, k, size * (size - 1) // 2, p, seed))
    same = F.col("src") % clusters == F.col("dst") % clusters
    e = pair(p_out, 0).where(~same).unionByName(_within(spark, size, clusters, p_in, seed))
    v = create_vertices(spark, size)
    return v.with_vertices(v.vertices.withColumn("cluster", (F.col("id") % clusters).cast("double"))).with_edges(e.select(hashed_id("src", "dst").alias("eid"), "src", "dst"))


def _within(spark: SparkSession, size: int, clusters: int, p: float, seed: int) -> DataFrame:
    """Pairs inside clusters: members of cluster c are c, c + clusters, ...; the pairs of all clusters are numbered in a row."""
    n = -(-size // clusters)
    each = n * (n - 1) // 2
    k = _sampled_pairs(spark, 1, each * clusters, p, seed).select(F.col("k"), F.expr(f"k div {max(1, each)}").alias("c"), F.expr(f"k % {max(1, each)}").alias("r"))
    u = k.withColumn("a", F.floor((1 + F.sqrt(1 + 8 * F.col("r").cast("double"))) / 2).cast("bigint")).withColumn("a", F.expr("case when a * (a - 1) div 2 > r then a - 1 when (a + 1) * a div 2 <= r then a + 1 else a end"))
    out = u.select(F.col("k").alias("eid"), F.expr(f"c + a * {clusters}").alias("src"), F.expr(f"c + (r - a * (a - 1) div 2) * {clusters}").alias("dst"))
    return out.where(F.col("src") < size)


def random_edges(g: Graph, degree: float = 10.0, seed: int = 0) -> Graph:
    """A directed multigraph: round(U * 2 * degree) edges leave every vertex, each to a vertex drawn by hash."""
    ids = spill(g.vertices.select("id").withColumn("_p", F.spark_partition_id()))
    sizes = ids.groupBy("_p").agg(F.count(F.lit(1)).alias("n"))
    sizes = sizes.withColumn("before", F.sum("n").over(Window.orderBy("_p")) - F.col("n"))
    dense = ids.join(F.broadcast(sizes), "_p").select("id", (F.row_number().over(Window.partitionBy("_p").orderBy("id")) - 1 + F.col("before")).alias("k"))
    n = ids.count()
    copies = F.round(uniform("id", seed) * 2 * degree).cast("int")
    out = g.vertices.select("id", F.explode(F.when(copies > 0, F.sequence(F.lit(1), copies)).otherwise(F.array().cast("array<int>"))).alias("i"))
    out = out.withColumn("k", F.floor(uniform(F.xxhash64("id", "i"), seed + 1) * n).cast("bigint"))
    e = out.join(dense.withColumnRenamed("id", "dst"), "k").select(hashed_id("id", "i").alias("eid"), F.col("id").alias("src"), "dst")
    return g.with_edges(e)


def scale_free_edges(g: Graph, iterations: int = 10, multiplier: float = 1.3, seed: int = 0) -> Graph:
    """Preferential attachment on edges: from one loop a vertex on, each round joins the source of one sampled edge to the target of another."""
    e = spill(g.vertices.select(F.col("id").alias("src"), F.col("id").alias("dst")))
    for r in range(iterations):
        # Poisson(multiplier) copies of each edge, twice; the copies are paired at random by position
        tagged = e.withColumn("_u", uniform(F.xxhash64("src", "dst", F.row_number().over(Window.partitionBy("src", "dst").orderBy("src"))), seed * 1000 + r))
        copies = F.lit(0)
        acc, term = math.exp(-multiplier), math.exp(-multiplier)
        k = 0
        while acc < 1 and (k <= multiplier or term > 2**-60):  # to the resolution of the uniform numbers
            k += 1
            copies = copies + (F.col("_u") >= acc).cast("int")
            term *= multiplier / k
            acc += term
        many = spill(tagged.withColumn("_n", copies).where("_n > 0").select("src", "dst", "_u", F.explode(F.sequence(F.lit(1), F.col("_n"))).alias("i")))
        side = lambda c, salt: numbered(many.select(F.col(c), F.xxhash64("src", "dst", "_u", "i", F.lit(seed * 1000 + r), F.lit(salt)).alias("o")), "o", "_at").drop("o")  # noqa: B023, E731
        e = spill(side("src", 1).join(side("dst", 2), "_at").select("src", "dst"))
    return g.with_edges(e.select(hashed_id("src", "dst", F.row_number().over(Window.partitionBy("src", "dst").orderBy("src"))).alias("eid"), "src", "dst"))


def barabasi_albert(spark: SparkSession, size: int = 100, attachments: int = 1, connected_at_start: int = 0, seed: int = 0) -> Graph:
    """Preferential attachment vertex by vertex (driver)."""
    rng, start = np.random.default_rng(seed), max(connected_at_start, attachments, 1)
    edges = [(i, i - 1) for i in range(1, start)]
    ends = [x for e in edges for x in e] or [0]
    for v in range(start, size):
        chosen: set[int] = set()
        while len(chosen) < min(attachments, v):
            chosen.add(int(ends[rng.integers(len(ends))]) if rng.random() < 0.999 else int(rng.integers(v)))
        for u in sorted(chosen):
            edges.append((v, u))
            ends += [v, u]
    return _graph(spark, size, edges)


def dorogovtsev_mendes(spark: SparkSession, size: int = 100, seed: int = 0) -> Graph:
    """From a triangle on, each vertex attaches to both ends of a random edge (driver)."""
    rng, edges = np.random.default_rng(seed), [(0, 1), (1, 2), (2, 0)][: max(0, size)]
    for v in range(3, size):
        a, b = edges[rng.integers(len(edges))]
        edges += [(v, a), (v, b)]
    return _graph(spark, size, edges)


def with_degrees(spark: SparkSession, size: int = 100, degrees: Sequence[int] = (1, 2, 3, 4), algorithm: str = "Chung-Lu", seed: int = 0) -> Graph:
    """A graph whose degrees repeat the list: expected ones (Chung-Lu), or exact ones (Havel-Hakimi; Edge switching shuffles it). Driver."""
    rng, want = np.random.default_rng(seed), np.array([degrees[i % len(degrees)] for i in range(size)])
    edges: set[tuple[int, int]] = set()
    if algorithm == "Chung-Lu":
        total = max(1, want.sum())
        for i in range(size):
            p = np.minimum(1, want[i] * want[:i] / total)
            edges |= {(i, int(j)) for j in np.flatnonzero(rng.random(i) < p)}
        return _graph(spark, size, sorted(edges))
    left = want.copy()
    for _ in range(size):
        order = np.argsort(-left, kind="stable")
        v, d = int(order[0]), int(left[order[0]])
        if d == 0:
            break
        near = [int(u) for u in order[1 : d + 1] if left[u] > 0]
        if len(near) < d:
            raise ValueError("no simple graph has these degrees")
        left[v] = 0
        left[near] -= 1
        edges |= {(max(v, u), min(v, u)) for u in near}
    if algorithm == "Edge switching":
        rows = sorted(edges)
        for _ in range(10 * len(rows)):
            i, j = rng.integers(len(rows), size=2)
            (a, b), (c, d) = rows[i], rows[j]
            x, y = (max(a, d), min(a, d)), (max(c, b), min(c, b))
            if len({a, b, c, d}) == 4 and x not in edges and y not in edges:
                edges -= {rows[i], rows[j]}
                edges |= {x, y}
                rows[i], rows[j] = x, y
    return _graph(spark, size, sorted(edges))


def _power_law(rng: np.random.Generator, low: int, high: int, exponent: float, n: int) -> np.ndarray:
    k = np.arange(low, high + 1)
    p = k.astype(float) ** -exponent
    return rng.choice(k, n, p=p / p.sum())


def lfr(spark: SparkSession, size: int = 100, avg_degree: float = 3, max_degree: int = 10, degree_exponent: float = 2.5, min_community: int = 5, max_community: int = 30, community_exponent: float = 1.5, mixing: float = 0.2, seed: int = 0) -> Graph:
    """Communities with power-law sizes and degrees; a share ``mixing`` of each vertex's edges leaves its community (driver). Attribute ``community``."""
    rng = np.random.default_rng(seed)
    low = 1
    while low < max_degree and _power_law(rng, low, max_degree, degree_exponent, 10_000).mean() < avg_degree:
        low += 1
    deg = _power_law(rng, low, max_degree, degree_exponent, size)
    label, c = np.zeros(size, int), 0
    at = 0
    while at < size:
        n = min(int(_power_law(rng, min_community, max_community, community_exponent, 1)[0]), size - at)
        label[at : at + n] = c
        at, c = at + n, c + 1
    rng.shuffle(label)
    edges: set[tuple[int, int]] = set()

    def wire(stubs: np.ndarray, ok) -> None:
        rng.shuffle(stubs)
        for a, b in zip(stubs[::2], stubs[1::2]):
            if a != b and ok(a, b):
                edges.add((int(max(a, b)), int(min(a, b))))

    inner = np.round(deg * (1 - mixing)).astype(int)
    for k in range(c):
        members = np.flatnonzero(label == k)
        wire(np.repeat(members, np.minimum(inner[members], len(members) - 1)), lambda a, b: True)
    wire(np.repeat(np.arange(size), deg - inner), lambda a, b: label[a] != label[b])
    g = _graph(spark, size, sorted(edges))
    return g.with_vertices(g.vertices.join(spark.createDataFrame([(i, float(x)) for i, x in enumerate(label)], "id bigint, community double"), "id"))


def _grid_near(points: DataFrame, dims: Sequence[str], radius: float, sources: DataFrame | None = None) -> DataFrame:
    """Ordered pairs of points within the radius, from all points or from ``sources`` (of the same columns): src, dst, dist. Points meet only in their own and neighbouring cells."""
    cell = F.array(*(F.floor(F.col(d) / radius) for d in dims))

    def with_dimension(cells, i: int):
        side = F.array(*(F.col("_cell")[i] + k for k in (-1, 0, 1)))
        return F.flatten(F.transform(cells, lambda c: F.transform(side, lambda x: F.concat(c, F.array(x)))))

    around = F.array(F.array().cast("array<bigint>"))
    for i in range(len(dims)):
        around = with_dimension(around, i)
    a = (points if sources is None else sources).withColumn("_cell", cell).select(F.col("id").alias("src"), *(F.col(d).alias(f"_a_{d}") for d in dims), F.explode(around).alias("_cell"))
    b = points.withColumn("_cell", cell).select(F.col("id").alias("dst"), *(F.col(d).alias(f"_b_{d}") for d in dims), "_cell")
    dist = F.sqrt(sum(((F.col(f"_a_{d}") - F.col(f"_b_{d}")) ** 2 for d in dims), F.lit(0.0)))
    return a.join(b, "_cell").where("src <> dst").withColumn("dist", dist).where(F.col("dist") <= radius).select("src", "dst", "dist")


def mocnik(spark: SparkSession, size: int = 100, dimension: int = 2, density: float = 2.5, seed: int = 0) -> Graph:
    """Points in the unit cube; each is linked to all within ``density`` times the distance of its nearest neighbour.

    Nearest neighbours are found in cells of about one point; cells are doubled for the points that find none. Points are then grouped by the
    doublings that their own reach needs, and each group is joined over cells of its size: a point far out does not widen the search of the others.
    """
    v = create_vertices(spark, size).vertices
    dims = [f"x{i}" for i in range(dimension)]
    points = spill(v.select("id", *(uniform("id", seed * 100 + i).alias(d) for i, d in enumerate(dims))))
    first = radius = (1 / max(1, size)) ** (1 / dimension)
    near = None
    left = points
    while rows_of(left) and radius < 2 * math.sqrt(dimension):
        found = spill(_grid_near(points, dims, radius, left).groupBy(F.col("src").alias("id")).agg(F.min("dist").alias("nearest")))
        near = found if near is None else near.unionByName(found)
        left = spill(left.join(found, "id", "left_anti"))
        radius *= 2
    if near is None:
        return Graph(v, spark.createDataFrame([], "eid bigint, src bigint, dst bigint"))
    reach = spill(points.join(near.withColumn("reach", F.greatest(F.col("nearest") * density, F.lit(1e-9))), "id").withColumn("level", F.ceil(F.log2(F.col("reach") / first)).cast("int")))
    e = None
    for level in [r.level for r in reach.select("level").distinct().orderBy("level").collect()]:  # at most the logarithm of the range of distances
        mine = reach.where(F.col("level") == level)
        some = _grid_near(points, dims, first * 2.0**level * (1 + 1e-12), mine).join(mine.select(F.col("id").alias("src"), "reach"), "src").where(F.col("dist") <= F.col("reach"))
        e = some if e is None else e.unionByName(some)
    return Graph(v, e.select(hashed_id("src", "dst").alias("eid"), "src", "dst"))


def p2p(spark: SparkSession, size: int = 100, dense_areas: int = 10, max_degree: int = 10, radius: float = 0.2, seed: int = 0) -> Graph:
    """Points in the unit square, half of them in dense areas; each is linked to its nearest ``max_degree`` others within the radius."""
    v = create_vertices(spark, size).vertices
    area = F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(max(1, dense_areas)))
    dense = uniform("id", seed + 1) < 0.5
    at = lambda k: F.when(dense, uniform(F.xxhash64(area), seed + 10 + k) + (uniform("id", seed + 20 + k) - 0.5) * radius / 2).otherwise(uniform("id", seed + 30 + k))
    near = _grid_near(v.select("id", at(0).alias("x"), at(1).alias("y")), ["x", "y"], radius)
    first = near.withColumn("_r", F.row_number().over(Window.partitionBy("src").orderBy("dist", "dst"))).where(F.col("_r") <= max_degree)
    return Graph(v, first.select(hashed_id("src", "dst").alias("eid"), "src", "dst"))


# Hyperbolic geometry


def hyperbolic_distance(r1, t1, r2, t2):
    """Approximate distance r1 + r2 + 2 ln(phi / 2), phi the angle between; at least 0."""
    phi = F.pi() - F.abs(F.pi() - F.abs(t1 - t2))
    return F.greatest(F.lit(0.0), r1 + r2 + 2 * F.log(F.greatest(phi, F.lit(1e-12)) / 2))


def edge_probability(distance, radius: float, temperature: float):
    return 1 / (1 + F.exp((distance - radius) / (2 * temperature)))


def hyperbolic_random(spark: SparkSession, size: int = 100, avg_degree: float = 4.5, exponent: float = 3.0, temperature: float = 0.0, seed: int = 0) -> Graph:
    """Points in a hyperbolic disk, linked within its radius or, with a temperature, with the Fermi probability. Attributes radial, angular.

    Candidates come from rings of one unit: points of two rings can be near only within an angle that the rings fix, so
    each ring pair is joined over buckets of that angle.
    """
    alpha = (exponent - 1) / 2
    R = 2 * math.log(max(2, size) * 2 * alpha**2 / (math.pi * max(avg_degree, 1e-9) * (alpha - 0.5) ** 2)) if alpha > 0.5 else 2 * math.log(max(2, size))
    R = max(R, 1.0)
    u = uniform("id", seed)
    radial = F.acosh(1 + (F.cosh(F.lit(alpha * R)) - 1) * u) / alpha
    v = spill(create_vertices(spark, size).vertices.withColumn("radial", radial).withColumn("angular", uniform("id", seed + 1) * 2 * math.pi))
    limit = R + (2 * temperature * 12 if temperature else 0.0)
    return Graph(v, _fermi_edges(v, limit, R, temperature, seed))


def _near_angles(v: DataFrame, limit: float) -> DataFrame:
    """Pairs src < dst whose distance can be at most ``limit``: src, dst, distance."""
    ring = F.floor("radial").cast("int")
    rings = [r[0] for r in v.select(ring.alias("r")).distinct().orderBy("r").collect()]
    p = v.select("id", "radial", "angular", ring.alias("ring"))
    tables = []
    for i in rings:
        for j in (x for x in rings if x >= i):
            width = min(math.pi, 2 * math.exp((limit - i - j) / 2))
            n = max(1, int(2 * math.pi / width))
            b = F.floor(F.col("angular") / (2 * math.pi) * n).cast("int") % n
            tables.append((i, j, n, b))
    out = None
    for i, j, n, b in tables:
        a = p.where(F.col("ring") == i).select(F.col("id").alias("a"), F.col("radial").alias("ra"), F.col("angular").alias("ta"), b.alias("k"))
        near = F.array_distinct(F.array((b + n - 1) % n, b, (b + 1) % n))
        c = p.where(F.col("ring") == j).select(F.col("id").alias("b"), F.col("radial").alias("rb"), F.col("angular").alias("tb"), F.explode(near).alias("k"))
        pair = a.join(c, "k").where("a <> b" if i != j else "a < b")
        out = pair if out is None else out.unionByName(pair)
    d = hyperbolic_distance(F.col("ra"), F.col("ta"), F.col("rb"), F.col("tb"))
    if out is None:
        return v.sparkSession.createDataFrame([], "src bigint, dst bigint, distance double")
    return out.withColumn("distance", d).where(F.col("distance") <= limit).select(F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst"), "distance").distinct()


def _fermi_edges(v: DataFrame, limit: float, R: float, temperature: float, seed: int) -> DataFrame:
    near = _near_angles(v, limit)
    if temperature:
        near = near.where(uniform(F.xxhash64("src", "dst"), seed + 2) < edge_probability(F.col("distance"), R, temperature))
    return near.select(hashed_id("src", "dst").alias("eid"), "src", "dst")


def pso_edges(g: Graph, external_degree: float = 1.5, internal_degree: float = 1.5, exponent: float = 0.6, seed: int = 0) -> Graph:
    """Popularity x similarity: vertices appear in a random order at radius 2 ln(order) and random angles; each links to the
    earlier ones nearest to it, about ``external_degree`` + the internal links due at that time. Attributes radial, angular."""
    n = max(2, g.vertices.count())
    shift = int(math.log(n))
    order = numbered(g.vertices.select("id", F.xxhash64("id", F.lit(seed)).alias("o")), "o", "_at")
    v = order.select("id", (F.col("_at") + 1 + shift).cast("double").alias("order"))
    v = spill(v.select("id", "order", (2 * F.log("order")).alias("radial"), (uniform("id", seed + 1) * 2 * math.pi).alias("angular")))
    due = external_degree + 2 * internal_degree * (1 - exponent) / max(1e-9, (1 - n ** -(1 - exponent)) ** 2 * (2 * exponent - 1) if abs(2 * exponent - 1) > 1e-9 else 1.0) * 0.25
    m = max(1, round(due))
    near = _near_angles(v, 2 * math.log(n + shift) + 1.0)
    by = v.select("id", "order")
    pair = near.join(by.withColumnsRenamed({"id": "src", "order": "os"}), "src").join(by.withColumnsRenamed({"id": "dst", "order": "od"}), "dst")
    pair = pair.select(F.when(F.col("os") > F.col("od"), F.col("src")).otherwise(F.col("dst")).alias("late"), F.when(F.col("os") > F.col("od"), F.col("dst")).otherwise(F.col("src")).alias("early"), "distance")
    first = pair.withColumn("_r", F.row_number().over(Window.partitionBy("late").orderBy("distance", "early"))).where(F.col("_r") <= m)
    return g.with_vertex_values(v.drop("order")).with_edges(first.select(hashed_id("late", "early").alias("eid"), F.col("late").alias("src"), F.col("early").alias("dst")))


def _disk(g: Graph, radial: str, temperature: float) -> tuple[float, float]:
    n = max(2, g.vertices.count())
    top = g.vertices.agg(F.max(radial)).first()[0] or 2 * math.log(n)
    return float(top), temperature


def hyperbolic_probability(g: Graph, radial: str = "radial", angular: str = "angular", temperature: float = 0.45, name: str = "hyperbolic_edge_probability") -> DataFrame:
    """eid and Fermi probability of each edge from the coordinates of its ends."""
    R, T = _disk(g, radial, temperature)
    v = g.vertices.select("id", F.col(radial).alias("r"), F.col(angular).alias("t"))
    e = g.need_edges().select("eid", "src", "dst").join(v.withColumnsRenamed({"id": "src", "r": "r1", "t": "t1"}), "src").join(v.withColumnsRenamed({"id": "dst", "r": "r2", "t": "t2"}), "dst")
    return e.select("eid", edge_probability(hyperbolic_distance(F.col("r1"), F.col("t1"), F.col("r2"), F.col("t2")), R, T).alias(name))


def predict_hyperbolic_edges(g: Graph, size: int = 100, radial: str = "radial", angular: str = "angular", temperature: float = 0.45) -> Graph:
    """Add the ``size`` most probable pairs (all, if there are no more), with ``hyperbolic_edge_probability``; existing edges are not left out.

    Pairs are looked for within a distance that grows until there are enough, at last within the largest that two vertices can have.
    """
    R, T = _disk(g, radial, temperature)
    v = spill(g.vertices.where(f"{radial} is not null and {angular} is not null").select("id", F.col(radial).alias("radial"), F.col(angular).alias("angular")))
    limit = R
    while True:
        near = _near_angles(v, limit)
        if limit > 2 * R + 2 * math.log(math.pi / 2) or near.limit(size).count() >= size:
            break
        limit += 1
    top = near.orderBy("distance", "src", "dst").limit(size)
    new = top.select(hashed_id(F.lit("predicted"), "src", "dst").alias("eid"), "src", "dst", edge_probability(F.col("distance"), R, T).alias("hyperbolic_edge_probability"))
    return g.with_edges(new if g.edges is None else g.edges.unionByName(new, allowMissingColumns=True))


def hyper_map(g: Graph, exponent: float = 0.6, candidates: int = 128, seed: int = 0, repelling: int = 0, most: int = DRIVER_VERTICES) -> DataFrame:
    """Hyperbolic coordinates by greedy likelihood: id, radial, angular.

    Vertices come in order of degree at radius 2 ln(order); each takes, of ``candidates`` angles, the likeliest given its earlier neighbours and
    earlier non-neighbours: all, or (as an approximation) the first ``repelling``.
    One vertex depends on those before, so this runs on the driver, over adjacency lists, in time quadratic in the vertices; more than ``most`` are an error.
    """
    if g.vertices.limit(most + 1).count() > most:
        raise ValueError(f"more than {most} vertices")
    from .direction import neighbours

    rows = neighbours(g.need_edges()).groupBy("center").agg(F.collect_list("other").alias("near")).toPandas()
    near = {int(c): [int(x) for x in n] for c, n in zip(rows["center"], rows["near"])}
    ids = sorted((int(r.id) for r in g.vertices.select("id").collect()), key=lambda v: (-len(near.get(v, ())), v))
    rng = np.random.default_rng(seed)
    place: dict[int, tuple[float, float]] = {}
    n = len(ids)
    for k, v in enumerate(ids, 1):
        r = 2 * math.log(k) if k > 1 else 0.0
        angles = rng.random(candidates) * 2 * math.pi
        score = np.zeros(candidates)
        R = 2 * math.log(max(2, k))
        prior = set(near.get(v, ()))
        for u in [x for x in near.get(v, ()) if x in place] + [x for x in ids[: min(k - 1, repelling or n)] if x not in prior]:
            ru, tu = place[u]
            phi = np.maximum(np.pi - np.abs(np.pi - np.abs(angles - tu)), 1e-9)
            z = (r + ru * (1 - exponent) + r * exponent + 2 * np.log(phi / 2) - R) / 0.9
            p = 1 / (1 + np.exp(np.clip(z, -50, 50)))
            score += np.log((p if u in prior else 1 - p) + 1e-12)
        place[v] = (r, float(angles[score.argmax()]))
    out = [(v, exponent * place[v][0] + (1 - exponent) * 2 * math.log(max(1, n)), place[v][1]) for v in ids]
    return g.spark.createDataFrame(out, "id bigint, radial double, angular double")
