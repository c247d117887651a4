"""User code, plots, views of graphs, and small plumbing."""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.sql_functions import geodistance
from ..graph import Graph
from ..runtime import spill

_TYPES = {"str": "string", "float": "double", "int": "bigint", "np.ndarray": "array<double>", "numpy.ndarray": "array<double>"}


def declared(outputs: str) -> dict[str, dict[str, str]]:
    """Parse ``vs.name: type, es.name: type, graph_attributes.name: type, df.name: type``."""
    out: dict[str, dict[str, str]] = {}
    for part in filter(None, (p.strip() for p in re.split(r"[,\n]", outputs))):
        m = re.fullmatch(r"(vs|es|graph_attributes|df)\.(\w+)\s*:\s*([\w.]+)", part)
        if not m or m.group(3) not in _TYPES:
            raise ValueError(f"no declaration: {part!r}")
        out.setdefault(m.group(1), {})[m.group(2)] = _TYPES[m.group(3)]
    return out


def compute_in_python(x: Graph | DataFrame, code: str | Callable, outputs: str, per_batch: bool = False) -> Graph | DataFrame:
    """User code over pandas frames ``vs``, ``es``, ``graph_attributes`` or ``df``.

    The code sees whole tables, and so runs on the driver, unless ``per_batch`` allows it to be run on batches of rows (then distributed). A
    callable takes the frames as keyword arguments and returns what it changed.
    """
    want = declared(outputs)

    def call(frames: dict) -> dict:
        if callable(code):
            return {**frames, **(code(**frames) or {})}
        env = {**frames, "pd": pd, "np": __import__("numpy")}
        exec(code, env)  # noqa: S102 - user code is the feature
        return env

    if isinstance(x, DataFrame):
        kinds = dict(x.dtypes) | want.get("df", {})
        schema = ", ".join(f"`{n}` {k}" for n, k in kinds.items())
        if per_batch:
            return x.mapInPandas(lambda it: (call({"df": p})["df"][list(kinds)] for p in it), schema)
        return x.sparkSession.createDataFrame(call({"df": x.toPandas()})["df"][list(kinds)], schema)
    frames: dict = {"vs": x.vertices.toPandas(), "graph_attributes": dict(x.scalars)}
    if x.edges is not None:
        frames["es"] = x.edges.toPandas()
    got = call(frames)
    out = x
    for name, key, put in (("vs", "id", Graph.with_vertex_values), ("es", "eid", Graph.with_edge_values)):
        if cols := want.get(name):
            frame = x.spark.createDataFrame(got[name][[key, *cols]], f"{key} bigint, " + ", ".join(f"`{n}` {k}" for n, k in cols.items()))
            out = put(out, frame)
    if cols := want.get("graph_attributes"):
        out = out.with_scalars(**{n: got["graph_attributes"][n] for n in cols})
    return out


# Views


def histogram(df: DataFrame, attribute: str, buckets: int = 20, logarithmic: bool = False) -> DataFrame:
    """bucket and count of equal intervals of a number, or of the most frequent values of a text."""
    rows = df.where(F.col(attribute).isNotNull())
    if dict(df.dtypes)[attribute] == "string":
        return top_values(rows, attribute, buckets).select(F.col("value").alias("bucket"), "count")
    x = F.log(F.col(attribute)) if logarithmic else F.col(attribute)
    low, high = rows.agg(F.min(x), F.max(x)).first()
    if low is None:
        return rows.select(F.lit(0).alias("bucket")).limit(0).withColumn("count", F.lit(0))
    width = (high - low) / buckets or 1.0
    return rows.groupBy(F.least(F.floor((x - low) / width), F.lit(buckets - 1)).cast("int").alias("bucket")).agg(F.count(F.lit(1)).alias("count"))


def top_values(df: DataFrame, attribute: str, k: int = 20) -> DataFrame:
    """The k most frequent values: value, count; ties by value."""
    counted = df.where(F.col(attribute).isNotNull()).groupBy(F.col(attribute).alias("value")).agg(F.count(F.lit(1)).alias("count"))
    return counted.orderBy(F.desc("count"), "value").limit(k)


def min_max(df: DataFrame, attribute: str) -> DataFrame:
    """One row: min, max, min_positive."""
    x = F.col(attribute)
    return df.agg(F.min(x).alias("min"), F.max(x).alias("max"), F.min(F.when(x > 0, x)).alias("min_positive"))


def _bucket(df: DataFrame, attribute: str, buckets: int) -> Column:
    if dict(df.dtypes)[attribute] == "string":
        return F.col(attribute)
    low, high = df.agg(F.min(attribute), F.max(attribute)).first()
    width = ((high or 0) - (low or 0)) / buckets or 1.0
    return F.least(F.floor((F.col(attribute) - F.lit(low)) / width), F.lit(buckets - 1)).cast("string")


def bucketed_view(g: Graph, x: str, y: str | None = None, buckets: int = 4) -> tuple[DataFrame, DataFrame | None]:
    """Vertices counted on a grid of one or two attributes (x, y, count), and edges between cells (x1, y1, x2, y2, count)."""
    by = _bucket(g.vertices, y, buckets) if y else F.lit("")
    v = g.vertices.select("id", _bucket(g.vertices, x, buckets).alias("x"), by.alias("y")).where("x is not null and y is not null")
    cells = v.groupBy("x", "y").agg(F.count(F.lit(1)).alias("count"))
    if g.edges is None:
        return cells, None
    e = g.edges.select("src", "dst").join(v.withColumnsRenamed({"id": "src", "x": "x1", "y": "y1"}), "src").join(v.withColumnsRenamed({"id": "dst", "x": "x2", "y": "y2"}), "dst")
    return cells, e.groupBy("x1", "y1", "x2", "y2").agg(F.count(F.lit(1)).alias("count"))


def neighbourhood(g: Graph, centers: Sequence[int], hops: int = 1) -> Graph:
    """The subgraph within a number of hops of the centres, whatever the edges' direction."""
    from .iterative import distances

    ids = distances(g, "all edges", hops, g.spark.createDataFrame([(c,) for c in centers], "id bigint")).select("id").distinct()
    return g.induced(g.vertices.join(spill(ids), "id", "left_semi"))


def sample_vertices(g: Graph, n: int) -> DataFrame:
    """n vertices, the first by the hash of their id."""
    return g.vertices.orderBy(F.xxhash64("id"), "id").limit(n)


def plot_data(df: DataFrame, x: str, y: str, agg: str = "sum") -> DataFrame:
    """The aggregated points that a bar, line or scatter plot draws: x, y."""
    return df.groupBy(F.col(x).alias("x")).agg(F.expr(f"{agg}(`{y}`)").alias("y"))


def incident_edges(g: Graph) -> DataFrame:
    """id, and sorted arrays of its edges and neighbours."""
    from .direction import both_ways

    return both_ways(g.need_edges(), "eid").groupBy(F.col("center").alias("id")).agg(F.array_sort(F.collect_list("eid")).alias("edges"), F.array_sort(F.collect_set("other")).alias("neighbours"))


def graph_metrics(g: Graph, percentiles: Sequence[float] = (0.25, 0.5, 0.75)) -> DataFrame:
    """Sum, average, least and interpolated percentiles of degrees and component sizes, one row a metric."""
    from .iterative import connected_components
    from .metrics import degree

    rows = [degree(g, d).select(F.lit(n).alias("metric"), F.col("degree").alias("v")) for n, d in (("degree", "all edges"), ("in_degree", "incoming edges"), ("out_degree", "outgoing edges"), ("neighbors", "all neighbors"))]
    rows.append(connected_components(g).groupBy("component").agg(F.count(F.lit(1)).cast("double").alias("v")).select(F.lit("component_size").alias("metric"), "v"))
    every = rows[0]
    for r in rows[1:]:
        every = every.unionByName(r)
    return every.groupBy("metric").agg(F.sum("v").alias("sum"), F.avg("v").alias("average"), F.min("v").alias("min"), F.max("v").alias("max"), *(F.percentile("v", F.lit(p)).alias(f"p{int(100 * p)}") for p in percentiles))


# Geography: polygons are (name, [(lat, lon), ...])


def _inside(lat: Column, lon: Column, ring: Sequence[tuple[float, float]]) -> Column:
    """Even-odd rule, as one expression."""
    crossings = F.lit(0)
    for (a1, o1), (a2, o2) in zip(ring, [*ring[1:], ring[0]]):
        if a1 == a2:
            continue
        crosses = ((F.lit(a1) > lat) != (F.lit(a2) > lat)) & (lon < F.lit(o2 - o1) * (lat - a1) / F.lit(a2 - a1) + o1)
        crossings = crossings + crosses.cast("int")
    return crossings % 2 == 1


def lookup_region(g: Graph, position: str, regions: Mapping[str, Sequence[tuple[float, float]]], output: str) -> Graph:
    """Name of the first polygon that holds the position."""
    lat, lon = F.col(position)[0], F.col(position)[1]
    value = F.coalesce(*(F.when(_inside(lat, lon, ring), F.lit(name)) for name, ring in regions.items()), F.lit(None).cast("string"))
    return g.with_vertices(g.vertices.withColumn(output, F.when(F.col(position).isNotNull(), value)))


def _to_side(lat: Column, lon: Column, a: tuple[float, float], b: tuple[float, float]) -> Column:
    """Metres to the nearest point of a side of a polygon: the foot of the perpendicular in the plane of degrees, longitudes being shortened as at the point's latitude."""
    k = F.cos(F.radians(lat))
    x, y = (lon - a[1]) * k, lat - a[0]
    dx, dy = F.lit(b[1] - a[1]) * k, F.lit(b[0] - a[0])
    t = F.coalesce(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.try_divide(x * dx + y * dy, dx * dx + dy * dy))), F.lit(0.0))
    return geodistance(lat, lon, F.lit(a[0]) + t * (b[0] - a[0]), F.lit(a[1]) + t * (b[1] - a[1]))


def segment_by_region(g: Graph, position: str, regions: Mapping[str, Sequence[tuple[float, float]]], distance: float = 0.0, name: str = "regions") -> Graph:
    """Vertices in each polygon, or within ``distance`` metres of its border."""
    from .segment import _from_keys

    lat, lon = F.col(position)[0], F.col(position)[1]

    def near(ring):
        test = _inside(lat, lon, ring)
        for a, b in zip(ring, [*ring[1:], ring[0]]) if distance else ():
            test = test | (_to_side(lat, lon, tuple(map(float, a)), tuple(map(float, b))) <= distance)
        return test

    hits = F.array_compact(F.array(*(F.when(near(ring), F.lit(n)) for n, ring in regions.items())))
    links = g.vertices.where(F.col(position).isNotNull()).select(F.col("id").alias("vid"), F.explode(hits).alias("region"))
    return _from_keys(g, name, links, ["region"], True)


def read_regions(path: str, name: str) -> dict[str, list[tuple[float, float]]]:
    """The outer rings of a GeoJSON file of polygons and multipolygons, by a property: region -> (lat, lon) corners. Several rings of a name are numbered from the second on. A file of regions is small; it is read on the driver."""
    import json

    out: dict[str, list[tuple[float, float]]] = {}
    with open(path.removeprefix("file://"), encoding="utf-8") as f:
        features = json.load(f)["features"]
    for feature in features:
        shape, label = feature["geometry"], str(feature["properties"][name])
        for polygon in [shape["coordinates"]] if shape["type"] == "Polygon" else shape["coordinates"] if shape["type"] == "MultiPolygon" else []:
            key, k = label, 1
            while key in out:
                k += 1
                key = f"{label} ({k})"
            out[key] = [(float(y), float(x)) for x, y, *_ in polygon[0][:-1]]
    return out
