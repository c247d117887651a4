"""Small operators that others are put together from."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..graph import Graph
from .attributes import _frame, _put


def count_vertices(g: Graph) -> int:
    return g.vertices.count()


def count_edges(g: Graph) -> int:
    return g.need_edges().count()


def table_to_scalar(df: DataFrame, rows: int = 10) -> list[tuple]:
    """The first rows of a table, for display."""
    return [tuple(r) for r in df.limit(rows).collect()]


def create_scalar(g: Graph, name: str, value: Any) -> Graph:
    return g.with_scalars(**{name: value})


def restrict_to_ids(g: Graph, on: str, attribute: str, ids: Sequence[int]) -> DataFrame:
    """The attribute of a few elements: id (or eid) and value. The filter reaches the scan."""
    key = "id" if on == "vertices" else "eid"
    return _frame(g, on).where(F.col(key).isin(list(ids)) & F.col(attribute).isNotNull()).select(key, attribute)


def collect_attribute(g: Graph, on: str, attribute: str, ids: Sequence[int]) -> dict[int, Any]:
    """:func:`restrict_to_ids` as a map; as large as the list of ids."""
    return {r[0]: r[1] for r in restrict_to_ids(g, on, attribute, ids).collect()}


def ends_as_attribute(g: Graph, name: str = "ends") -> Graph:
    """The ends of each edge as one pair."""
    return g.with_edges(g.need_edges().withColumn(name, F.struct("src", "dst")))


def join_attributes(g: Graph, on: str, name: str, first: str, second: str) -> Graph:
    """Two attributes as a pair, defined where both are."""
    both = F.when(F.col(first).isNotNull() & F.col(second).isNotNull(), F.struct(F.col(first).alias("first"), F.col(second).alias("second")))
    return _put(g, on, _frame(g, on).withColumn(name, both))


def pulled_over(function: DataFrame, values: DataFrame) -> DataFrame:
    """Values (id, ...) re-keyed through a function (id, target): each id gets the values of its target."""
    cols = [c for c in values.columns if c != "id"]
    return function.select("id", "target").join(values.withColumnRenamed("id", "target"), "target").select("id", *cols)


def to_long(g: Graph, on: str, *names: str) -> Graph:
    """Whole numbers of numbers, cut towards zero."""
    return _put(g, on, _frame(g, on).withColumns({n: F.col(n).cast("bigint") for n in names}))


def uniform_overlap_links(g: Graph, segmentation: str, least: int) -> DataFrame:
    """Segments linked where they share at least ``least`` vertices: src < dst, n."""
    from .segment import overlapping

    m = g.segmentation(segmentation).membership.distinct().select("sid", "vid", F.lit(least).alias("need"))
    return overlapping(m).where(F.col("n") >= least).select(F.col("a").alias("src"), F.col("b").alias("dst"), "n")


def roc_curve(g: Graph, label: str, score: str) -> DataFrame:
    """Points of the receiver operating characteristic, from the highest threshold down: threshold, fpr, tpr. ``label`` is 1.0 or 0.0; ties are one point."""
    from ..runtime import numbered

    rows = g.vertices.where(F.col(label).isNotNull() & F.col(score).isNotNull()).groupBy((-F.col(score)).alias("_o")).agg(F.count_if(F.col(label) == 1.0).alias("p"), F.count_if(F.col(label) == 0.0).alias("n"))
    up = numbered(rows, "_o", "_tp", "p").select("_o", (F.col("_tp") + F.col("p")).alias("tp"))
    down = numbered(rows, "_o", "_fp", "n").select("_o", (F.col("_fp") + F.col("n")).alias("fp"))
    p, n = rows.agg(F.sum("p"), F.sum("n")).first()
    return up.join(down, "_o").select((-F.col("_o")).alias("threshold"), F.try_divide("fp", F.lit(n)).alias("fpr"), F.try_divide("tp", F.lit(p)).alias("tpr"))
