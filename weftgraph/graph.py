"""The data model: graphs and segmentations as immutable bundles of DataFrames."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .runtime import BROADCAST_ROWS, drop, rows_of, spill, split_join

EDGE_KEYS = ("eid", "src", "dst")


@dataclass(frozen=True)
class Graph:
    """``vertices`` has ``id`` and one nullable column an attribute (null: undefined); ``edges`` has ``eid``, ``src``, ``dst`` and attributes.

    ``scalars`` are graph attributes; ``segmentations`` map names to :class:`Segmentation`. Every operator returns a new graph.
    """

    vertices: DataFrame
    edges: DataFrame | None = None
    scalars: Mapping[str, Any] = field(default_factory=dict)
    segmentations: Mapping[str, Segmentation] = field(default_factory=dict)

    @property
    def spark(self) -> SparkSession:
        return self.vertices.sparkSession

    @property
    def vertex_attributes(self) -> list[str]:
        return [c for c in self.vertices.columns if c != "id"]

    @property
    def edge_attributes(self) -> list[str]:
        return [] if self.edges is None else [c for c in self.edges.columns if c not in EDGE_KEYS]

    def need_edges(self) -> DataFrame:
        if self.edges is None:
            raise ValueError("the graph has no edges")
        return self.edges

    def with_vertices(self, vertices: DataFrame) -> Graph:
        return replace(self, vertices=vertices)

    def with_edges(self, edges: DataFrame | None) -> Graph:
        return replace(self, edges=edges)

    def with_scalars(self, **scalars: Any) -> Graph:
        return replace(self, scalars={**self.scalars, **scalars})

    def with_segmentation(self, name: str, segmentation: Segmentation) -> Graph:
        return replace(self, segmentations={**self.segmentations, name: segmentation})

    def segmentation(self, name: str) -> Segmentation:
        if name not in self.segmentations:
            raise KeyError(f"no segmentation {name!r}; there are {sorted(self.segmentations)}")
        return self.segmentations[name]

    def with_vertex_values(self, values: DataFrame, default: Mapping[str, Any] | None = None) -> Graph:
        """Add the columns of ``values`` (keyed by unique ``id``) as vertex attributes; absent vertices stay undefined or get the default."""
        names = [c for c in values.columns if c != "id"]
        out = self.vertices.drop(*names).join(values, "id", "left")
        return self.with_vertices(out.fillna(dict(default)) if default else out)

    def with_edge_values(self, values: DataFrame) -> Graph:
        """Add the columns of ``values`` (keyed by unique ``eid``) as edge attributes."""
        names = [c for c in values.columns if c != "eid"]
        return self.with_edges(self.need_edges().drop(*names).join(values, "eid", "left"))

    def induced(self, vertices: DataFrame) -> Graph:
        """The graph on a subset of the vertices: edges need both ends, segment links their vertex."""
        ids = vertices.select("id")
        edges = self.edges
        if edges is not None:
            edges = edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi").select(*self.edges.columns)
        kept = {n: replace(s, membership=s.membership.join(ids.withColumnRenamed("id", "vid"), "vid", "left_semi")) for n, s in self.segmentations.items()}
        return replace(self, vertices=vertices, edges=edges, segmentations=kept)


@dataclass(frozen=True)
class Segmentation:
    """A graph whose vertices are segments, and ``membership`` (vid, sid) of base vertices in them; overlaps are allowed."""

    graph: Graph
    membership: DataFrame


def hashed_id(*cols):
    """A reproducible 64-bit hash of columns.

    With n elements two clash with probability n*n / 2**65: 3 % at a billion, near certainty at ten billion. It is the id of edges that
    operators make; ids of vertices and segments go through :func:`clash_free`.
    """
    return F.xxhash64(*cols)


def clash_free(keys: DataFrame, cols: Sequence[str], taken: DataFrame | None = None) -> DataFrame | None:
    """Exact ids by hash: of distinct ``keys`` (best a written table) those whose :func:`hashed_id` another key or an ``id`` of ``taken`` has too, with an ``_id``
    of their own that none has. Of clashing keys the least keeps its hash. None if all hashes differ, as nearly always below a billion keys."""
    cols = list(cols)
    hashed = keys.select(*cols, hashed_id(*cols).alias("_id"))
    twice = hashed.groupBy("_id").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("_id")
    found = hashed.join(twice, "_id", "left_semi").select("*", F.row_number().over(Window.partitionBy("_id").orderBy(*cols)).alias("_k")).where("_k > 1").select(*cols)
    known = hashed.select("_id")
    if taken is not None:
        found = found.unionByName(hashed.join(taken.select(F.col("id").alias("_id")), "_id", "left_semi").select(*cols)).distinct()
        known = known.unionByName(taken.select(F.col("id").alias("_id")))
    found = spill(found)
    if not rows_of(found):
        drop(found)
        return None
    out, left, k = None, found, 0
    while rows_of(left):
        k += 1
        tried = left.select(*cols, F.xxhash64(*cols, F.lit(k)).alias("_id"))
        used = known if out is None else known.unionByName(out.select("_id"))
        fresh = split_join(tried, used.join(tried.select("_id").distinct(), "_id", "left_semi").distinct(), ["_id"], "left_anti")
        first = F.row_number().over(Window.partitionBy("_id").orderBy(*cols)) == 1
        good = spill(fresh.select("*", first.alias("_first")).where("_first").drop("_first"))
        out = good if out is None else spill(out.unionByName(good))
        left = spill(_same_keys(left, good, cols, "left_anti"))
    return out


def _same_keys(left: DataFrame, right: DataFrame, cols: Sequence[str], how: str) -> DataFrame:
    renamed = right.withColumnsRenamed({c: f"_same_{c}" for c in cols})
    on = None
    for c in cols:
        same = left[c].eqNullSafe(renamed[f"_same_{c}"])
        on = same if on is None else on & same
    return left.join(renamed, on, how)


def with_id(df: DataFrame, cols: Sequence[str], exceptions: DataFrame | None, name: str = "id") -> DataFrame:
    """``df`` with the id of its key ``cols``: the hash, or what :func:`clash_free` gave to the exceptions."""
    if exceptions is None:
        return df.withColumn(name, hashed_id(*cols))
    joined = _same_keys(df, F.broadcast(exceptions) if rows_of(exceptions) <= BROADCAST_ROWS else exceptions, cols, "left")
    return joined.withColumn(name, F.coalesce("_id", hashed_id(*cols))).drop("_id", *(f"_same_{c}" for c in cols))
