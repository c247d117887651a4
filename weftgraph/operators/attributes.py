"""Vertex, edge and graph attributes. ``on`` is ``vertices`` or ``edges``."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from dataclasses import replace
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.aggregators import aggregate
from ..functions.sql_functions import salted_hash
from ..graph import Graph
from ..plans.views import triplets

IF_EXISTS = (
    "Overwrite it", "Merge, prefer the table's version", "Merge, prefer the graph's version",
    "Merge, report error on conflict", "Keep the graph's version", "Disallow this",
)


def _frame(g: Graph, on: str) -> DataFrame:
    return g.vertices if on == "vertices" else g.need_edges()


def _put(g: Graph, on: str, df: DataFrame) -> Graph:
    return g.with_vertices(df) if on == "vertices" else g.with_edges(df)


def _key(on: str) -> str:
    return "id" if on == "vertices" else "eid"


def add_constant(g: Graph, on: str, name: str, value: Any) -> Graph:
    """A number (as double) or a text on all elements."""
    return _put(g, on, _frame(g, on).withColumn(name, F.lit(float(value) if isinstance(value, int | float) else value)))


def uniform(key: Column | str, seed: int) -> Column:
    """A number in (0, 1) that depends on the key and the seed alone, not on the partitioning."""
    return (F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(2**52)) + 0.5) / float(2**52)


def normal(key: Column | str, seed: int) -> Column:
    return F.sqrt(-2 * F.log(uniform(key, 2 * seed))) * F.cos(2 * F.pi() * uniform(key, 2 * seed + 1))


def add_random(g: Graph, on: str, name: str = "random", dist: str = "Standard Normal", seed: int = 0) -> Graph:
    draw = {"Standard Normal": normal, "Standard Uniform": uniform}[dist]
    return _put(g, on, _frame(g, on).withColumn(name, draw(_key(on), seed)))


def add_rank(g: Graph, on: str, key: str, name: str = "ranking", order: str = "ascending") -> Graph:
    """Position from 0 (as double) by the attribute, ties by id; undefined values have none.

    A global order without a global sort in one task: rows are range-partitioned, counted, and
    numbered from the running total of the partitions before.
    """
    df, k = _frame(g, on), _key(on)
    way = F.asc if order == "ascending" else F.desc
    rows = df.where(F.col(key).isNotNull()).select(k, key)
    parts = rows.repartitionByRange(way(key), F.asc(k)).withColumn("_part", F.spark_partition_id())
    from ..runtime import spill

    parts = spill(parts)
    sizes = parts.groupBy("_part").agg(F.count(F.lit(1)).alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    at = F.row_number().over(Window.partitionBy("_part").orderBy(way(key), F.asc(k))) - 1
    ranked = parts.join(F.broadcast(sizes.select("_part", "_before")), "_part").select(k, (at + F.col("_before")).cast("double").alias(name))
    return _put(g, on, df.drop(name).join(ranked, k, "left"))


def to_number(g: Graph, on: str, *names: str) -> Graph:
    """Double of text or numbers: empty text is undefined, other text that is no number is an error."""
    df = _frame(g, on)
    kinds = dict(df.dtypes)
    return _put(g, on, df.withColumns({n: (F.nullif(F.col(n), F.lit("")) if kinds[n] == "string" else F.col(n)).cast("double") for n in names}))


def number_text(x: Column) -> Column:
    """A number as text with at most ten decimals and no trailing zeros."""
    plain = F.regexp_replace(F.format_number(x, 10), ",", "")
    return F.regexp_replace(F.regexp_replace(plain, r"(\.\d*?)0+$", "$1"), r"\.$", "")


def to_text(g: Graph, on: str, *names: str) -> Graph:
    df = _frame(g, on)
    kinds = dict(df.dtypes)
    return _put(g, on, df.withColumns({n: number_text(F.col(n)) if kinds[n] in ("double", "float") else F.col(n).cast("string") for n in names}))


def derive(g: Graph, on: str, output: str, expr: str, defined_attrs: bool = True) -> Graph:
    """An SQL expression over attributes and scalars; on edges also ``src_x`` and ``dst_x`` (or ``src$x``, ``dst$x``).

    With ``defined_attrs`` it is undefined where any attribute it names is. Endpoints are joined only if named.
    """
    expr = expr.replace("src$", "src_").replace("dst$", "dst_")
    words = set(re.findall(r"[A-Za-z_]\w*", re.sub(r"'[^']*'", "", expr)))
    scalars = {k: v for k, v in g.scalars.items() if k in words}
    if on == "vertices":
        df = g.vertices
        names = [c for c in g.vertex_attributes if c in words]
        work = df
    else:
        df = g.need_edges()
        ends = {w for w in words if w[:4] in ("src_", "dst_") and w[4:] in g.vertex_attributes}
        view = triplets(g, ends, ids=True).select("eid", *sorted(ends)) if ends else None
        names = [c for c in g.edge_attributes if c in words] + sorted(ends)
        work = df.join(view, "eid") if ends else df
    work = work.withColumns({k: F.lit(v) for k, v in scalars.items()}) if scalars else work
    value = F.expr(expr)
    if defined_attrs and names:
        guard = F.col(names[0]).isNotNull()
        for n in names[1:]:
            guard &= F.col(n).isNotNull()
        value = F.when(guard, value)
    return _put(g, on, work.withColumn(output, value).select(*(c for c in df.columns if c != output), output))


def expose_id(g: Graph, on: str, name: str = "id_text") -> Graph:
    """The internal id as text, under a name other than the id's own."""
    return _put(g, on, _frame(g, on).withColumn(name, F.col(_key(on)).cast("string")))


def fill(g: Graph, on: str, defaults: Mapping[str, Any]) -> Graph:
    return _put(g, on, _frame(g, on).withColumns({k: F.coalesce(F.col(k), F.lit(v)) for k, v in defaults.items()}))


def merge_two(g: Graph, on: str, name: str, first: str, second: str) -> Graph:
    """The first where it is defined, else the second; both must have one type."""
    df = _frame(g, on)
    if dict(df.dtypes)[first] != dict(df.dtypes)[second]:
        raise ValueError(f"{first} and {second} have different types")
    return _put(g, on, df.withColumn(name, F.coalesce(first, second)))


def hash_attribute(g: Graph, on: str, name: str, salt: str) -> Graph:
    secret = re.fullmatch(r"SECRET\((.*)\)", salt, re.S)
    return _put(g, on, _frame(g, on).withColumn(name, salted_hash(F.col(name).cast("string"), F.lit(secret.group(1) if secret else salt))))


def use_table(g: Graph, on: str, table: DataFrame, id_attr: str, id_column: str, prefix: str = "", unique_keys: bool = False, if_exists: str = "Disallow this") -> Graph:
    """Look attributes up in a table by ids compared as text. A repeated table key is an error, a repeated graph key with ``unique_keys``."""
    if if_exists not in IF_EXISTS:
        raise ValueError(f"if_exists must be one of {IF_EXISTS}")
    df = _frame(g, on)
    key = F.col(id_column).cast("string")
    rows = table.where(F.col(id_column).isNotNull()).select(key.alias("_key"), *(F.col(c).alias(f"_new_{prefix}{c}") for c in table.columns if c != id_column))
    checked = [(rows, "_key", "table")] + ([(df, id_attr, "graph")] if unique_keys else [])
    for frame, column, what in checked:
        twice = frame.where(F.col(column).isNotNull()).groupBy(column).count().where("count > 1").limit(1).collect()
        if twice:
            raise ValueError(f"the {what} key {twice[0][0]!r} is not unique")
    out = df.withColumn("_key", F.col(id_attr).cast("string")).join(rows, "_key", "left").drop("_key")
    for c in (c for c in table.columns if c != id_column):
        name, new = f"{prefix}{c}", F.col(f"_new_{prefix}{c}")
        if name in df.columns:
            if if_exists == "Disallow this":
                raise ValueError(f"the attribute {name!r} exists")
            old = F.col(name)
            value = {
                "Overwrite it": new,
                "Merge, prefer the table's version": F.coalesce(new, old),
                "Merge, prefer the graph's version": F.coalesce(old, new),
                "Merge, report error on conflict": F.when(old != new, F.raise_error(F.lit(f"conflict in {name}"))).otherwise(F.coalesce(old, new)),
                "Keep the graph's version": old,
            }[if_exists]
        else:
            value = new
        out = out.withColumn(name, value).drop(f"_new_{prefix}{c}")
    return _put(g, on, out)


def bundle_vector(g: Graph, output: str, elements: Sequence[str]) -> Graph:
    """Numbers, then vectors, of a vertex in one vector; undefined if any is."""
    kinds = dict(g.vertices.dtypes)
    single = [c for c in elements if not kinds[c].startswith("array")]
    parts = ([F.array(*(F.col(c).cast("double") for c in single))] if single else []) + [F.col(c) for c in elements if kinds[c].startswith("array")]
    guard = F.lit(True)
    for c in elements:
        guard &= F.col(c).isNotNull()
    return g.with_vertices(g.vertices.withColumn(output, F.when(guard, F.concat(*parts))))


def one_hot(g: Graph, output: str, attribute: str, categories: Sequence[str]) -> Graph:
    """1.0 at the position of the category, all zeros for an unknown one, undefined if the attribute is."""
    vector = F.array(*(F.when(F.col(attribute) == c, 1.0).otherwise(0.0) for c in categories))
    return g.with_vertices(g.vertices.withColumn(output, F.when(F.col(attribute).isNotNull(), vector)))


# Management of attributes, scalars and segmentations


def copy_attribute(g: Graph, on: str, name: str, destination: str) -> Graph:
    return _put(g, on, _frame(g, on).withColumn(destination, F.col(name)))


def discard_attributes(g: Graph, on: str, *names: str) -> Graph:
    return _put(g, on, _frame(g, on).drop(*names))


def rename_attributes(g: Graph, on: str, changes: Mapping[str, str]) -> Graph:
    """New names; an empty one discards the attribute."""
    df = _frame(g, on)
    return _put(g, on, df.select(*(F.col(c).alias(changes.get(c, c)) for c in df.columns if changes.get(c, c))))


def set_icon(g: Graph, on: str, name: str, icon: str) -> Graph:
    """Metadata of the column."""
    df = _frame(g, on)
    return _put(g, on, df.withMetadata(name, {**df.schema[name].metadata, "icon": icon}))


def copy_scalar(g: Graph, name: str, destination: str) -> Graph:
    return g.with_scalars(**{destination: g.scalars[name]})


def copy_scalar_from(g: Graph, other: Graph, name: str, save_as: str = "") -> Graph:
    return g.with_scalars(**{save_as or name: other.scalars[name]})


def discard_scalars(g: Graph, *names: str) -> Graph:
    return replace(g, scalars={k: v for k, v in g.scalars.items() if k not in names})


def rename_scalars(g: Graph, changes: Mapping[str, str]) -> Graph:
    return replace(g, scalars={changes.get(k, k): v for k, v in g.scalars.items() if changes.get(k, k)})


def derive_scalar(g: Graph, output: str, expr: str) -> Graph:
    """An SQL expression over the scalars."""
    row = g.spark.range(1).select(*(F.lit(v).alias(k) for k, v in g.scalars.items())).select(F.expr(expr)).first()
    return g.with_scalars(**{output: row[0]})


def copy_segmentation(g: Graph, name: str, destination: str) -> Graph:
    return g.with_segmentation(destination, g.segmentation(name))


def discard_segmentation(g: Graph, name: str) -> Graph:
    return replace(g, segmentations={k: v for k, v in g.segmentations.items() if k != name})


def rename_segmentation(g: Graph, before: str, after: str) -> Graph:
    return replace(g, segmentations={after if k == before else k: v for k, v in g.segmentations.items()})


# Propagation

Specs = Sequence[tuple[str, str]]


def aggregate_globally(g: Graph, on: str, specs: Specs, weight: str | None = None, prefix: str = "", suffix: bool = True) -> DataFrame:
    """One row of aggregates over all elements."""
    return aggregate(_frame(g, on), [], specs, weight, prefix, suffix)


def aggregate_on_neighbours(g: Graph, direction: str, specs: Specs, weight: str | None = None, prefix: str = "neighborhood", suffix: bool = True) -> DataFrame:
    """id and aggregates of the neighbours' attributes, reached in the direction; vertices without neighbours are absent.

    ``weight`` is an attribute of the neighbours, or else of the edges that lead to them.
    """
    from .direction import pairs

    names = sorted({a for a, _ in specs})
    on_edges = bool(weight) and weight not in g.vertex_attributes
    linked, extra = pairs(g.need_edges(), direction, weight if on_edges else None), [weight] if weight and not on_edges else []
    values = g.vertices.select(F.col("id").alias("other"), *sorted({*names, *extra}))
    return aggregate(linked.join(values, "other").drop("other"), ["center"], specs, weight, prefix, suffix).withColumnRenamed("center", "id")


def aggregate_edges(g: Graph, direction: str, specs: Specs, weight: str | None = None, prefix: str = "edge", suffix: bool = True) -> DataFrame:
    """id and aggregates of the attributes of a vertex's incoming, outgoing or all edges (a loop counts twice there)."""
    from .direction import both_ways

    e = g.need_edges()
    names = sorted({a for a, _ in specs} | ({weight} if weight else set()))
    if direction == "all edges":
        linked = both_ways(e, *names).drop("other").withColumnRenamed("center", "id")
    else:
        linked = e.select(F.col("dst" if direction == "incoming edges" else "src").alias("id"), *names)
    return aggregate(linked, ["id"], specs, weight, prefix, suffix)


def aggregate_to_segmentation(g: Graph, name: str, specs: Specs, weight: str | None = None, prefix: str = "", suffix: bool = True) -> DataFrame:
    """id (of the segment) and aggregates of its members' attributes."""
    names = sorted({a for a, _ in specs} | ({weight} if weight else set()))
    linked = g.segmentation(name).membership.join(g.vertices.select(F.col("id").alias("vid"), *names), "vid").drop("vid")
    return aggregate(linked, ["sid"], specs, weight, prefix, suffix).withColumnRenamed("sid", "id")


def aggregate_from_segmentation(g: Graph, name: str, specs: Specs, weight: str | None = None, prefix: str = "", suffix: bool = True) -> DataFrame:
    """id (of the vertex) and aggregates of its segments' attributes."""
    s = g.segmentation(name)
    names = sorted({a for a, _ in specs} | ({weight} if weight else set()))
    linked = s.membership.join(s.graph.vertices.select(F.col("id").alias("sid"), *names), "sid").drop("sid")
    return aggregate(linked, ["vid"], specs, weight, prefix or name, suffix).withColumnRenamed("vid", "id")


def _function(links: DataFrame, key: str) -> None:
    twice = links.groupBy(key).count().where("count > 1").limit(1).collect()
    if twice:
        raise ValueError(f"{key} {twice[0][0]} has several links")


def copy_from_segmentation(g: Graph, name: str, prefix: str = "") -> Graph:
    """The segment's attributes on its vertices; a vertex may be in one segment only."""
    s = g.segmentation(name)
    _function(s.membership, "vid")
    side = s.graph.vertices.select(F.col("id").alias("sid"), *(F.col(c).alias(f"{prefix or name}_{c}") for c in s.graph.vertex_attributes))
    return g.with_vertex_values(s.membership.join(side, "sid").drop("sid").withColumnRenamed("vid", "id"))


def copy_to_segmentation(g: Graph, name: str, prefix: str = "base") -> Graph:
    """The vertex's attributes on its segment; a segment may have one vertex only."""
    s = g.segmentation(name)
    _function(s.membership, "sid")
    side = g.vertices.select(F.col("id").alias("vid"), *(F.col(c).alias(f"{prefix}_{c}") for c in g.vertex_attributes))
    seg = s.graph.with_vertex_values(s.membership.join(side, "vid").drop("vid").withColumnRenamed("sid", "id"))
    return g.with_segmentation(name, replace(s, graph=seg))
