"""Graphs as tables, and SQL over graphs and tables.

A graph ``g`` has the tables ``vertices``, ``edges`` (triplets ``edge_*``, ``src_*``, ``dst_*``), ``edge_attributes``,
``graph_attributes`` and, for each segmentation, ``<name>.vertices`` ... and ``<name>.belongs_to`` (``base_*``, ``segment_*``).
A triplet view joins an end's attributes only if a query refers to them: Catalyst does not drop such joins.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import sql_functions
from ..graph import EDGE_KEYS, Graph, Segmentation


def vertices(g: Graph) -> DataFrame:
    return g.vertices.select(*sorted(g.vertex_attributes))


def edge_attributes(g: Graph) -> DataFrame:
    return g.need_edges().select(*sorted(g.edge_attributes))


def triplets(g: Graph, columns: set[str] | None = None, ids: bool = False) -> DataFrame:
    """``edge_*``, ``src_*`` and ``dst_*`` columns; only those in ``columns`` if given. ``ids`` keeps eid, src and dst."""
    out = g.need_edges()
    keep = [F.col(c).alias(f"edge_{c}") for c in sorted(g.edge_attributes) if columns is None or f"edge_{c}" in columns]
    for end in ("src", "dst"):
        names = [c for c in sorted(g.vertex_attributes) if columns is None or f"{end}_{c}" in columns]
        if names:
            side = g.vertices.select(F.col("id").alias(f"_{end}"), *(F.col(c).alias(f"_{end}_{c}") for c in names))
            out = out.join(side, out[end] == side[f"_{end}"], "left").drop(f"_{end}")
            keep += [F.col(f"_{end}_{c}").alias(f"{end}_{c}") for c in names]
    return out.select(*(EDGE_KEYS if ids else ()), *keep)


def graph_attributes(g: Graph) -> DataFrame:
    """One row of the scalars."""
    if not g.scalars:
        return g.spark.range(1).select()
    return g.spark.range(1).select(*(F.lit(v).alias(k) for k, v in sorted(g.scalars.items())))


def belongs_to(g: Graph, s: Segmentation, columns: set[str] | None = None) -> DataFrame:
    out, keep = s.membership, []
    for key, prefix, side in (("vid", "base", g), ("sid", "segment", s.graph)):
        names = [c for c in sorted(side.vertex_attributes) if columns is None or f"{prefix}_{c}" in columns]
        if names:
            frame = side.vertices.select(F.col("id").alias(key), *(F.col(c).alias(f"{prefix}_{c}") for c in names))
            out = out.join(frame, key)
            keep += [f"{prefix}_{c}" for c in names]
    return out.select(*keep)


def _words(query: str) -> set[str] | None:
    """The names a query may refer to; None (all columns) if it has a star outside of count(*)."""
    if "*" in re.sub(r"count\s*\(\s*\*\s*\)", "", query, flags=re.I):
        return None
    return set(re.findall(r"\w+", query))


def tables(g: Graph, query: str, prefix: str = "") -> dict[str, DataFrame]:
    """The views of a graph that a query names, by their names."""
    out: dict[str, DataFrame] = {}
    names = _words(query)

    def used(name: str) -> bool:
        return re.search(rf"(?<![\w.`]){re.escape(name)}(?![\w.])", query.replace("`", "")) is not None

    def add(h: Graph, p: str) -> None:
        for name, build in (("vertices", vertices), ("edge_attributes", edge_attributes), ("graph_attributes", graph_attributes)):
            if used(p + name):
                out[p + name] = build(h)
        if used(p + "edges"):
            out[p + "edges"] = triplets(h, names)
        for n, s in h.segmentations.items():
            if used(f"{p}{n}.belongs_to"):
                out[f"{p}{n}.belongs_to"] = belongs_to(h, s, names)
            add(s.graph, f"{p}{n}.")

    add(g, prefix)
    return out


def sql(query: str, *inputs: Graph | DataFrame, names: list[str] | None = None, spark: SparkSession | None = None) -> DataFrame:
    """Run a query over up to ten inputs, named ``one`` ... ``ten`` unless ``names`` are given.

    A table is known by its name (a single one also as ``input``), a graph by ``name.vertices`` and so on; a
    single graph's tables also without the name.
    """
    default = ["one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten"]
    names = names or (["input"] if len(inputs) == 1 else default[: len(inputs)])
    spark = spark or (inputs[0].spark if isinstance(inputs[0], Graph) else inputs[0].sparkSession)
    sql_functions.register(spark)
    text = sql_functions.rewritten(query)
    known: dict[str, DataFrame] = {}
    for name, x in zip(names, inputs, strict=True):
        if isinstance(x, Graph):
            known |= tables(x, query, f"{name}.")
            if len(inputs) == 1:
                known |= {k: v for k, v in tables(x, query).items() if k not in known}
        else:
            known[name] = x
    if "weft_hash(" in text:
        spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION weft_hash(s STRING, salt STRING) RETURNS STRING RETURN upper(sha2(concat(s, salt), 256))")
    frames, parts = {}, []
    for i, k in enumerate(sorted(known, key=len, reverse=True)):
        spelled = "`?[.]`?".join(map(re.escape, k.split(".")))
        text, n = re.subn(rf"(?<![\w.`])`?{spelled}`?(?![\w`])(?![.]\w+[.])", lambda m, k=k: f"`{k}`" if "." in k else m.group(0), text)
        if n:
            frames[f"weft_{i}"] = known[k]
            parts.append(f"`{k}` AS (SELECT * FROM {{weft_{i}}})")
    if parts:
        own = re.match(r"\s*WITH\s+(RECURSIVE\s+)?", text, re.I)
        head = f"WITH {(own and own.group(1)) or ''}{', '.join(parts)}"
        text = f"{head}, {text[own.end() :]}" if own else f"{head} {text}"
    return spark.sql(text, **frames)


def filter_with_sql(x: Graph | DataFrame, where: str = "", vertex_filter: str = "", edge_filter: str = "") -> Graph | DataFrame:
    """Rows of a table, or vertices and edges of a graph, for which the SQL conditions hold. Edge conditions may use ``edge_*``, ``src_*``, ``dst_*``."""
    if isinstance(x, DataFrame):
        return x.where(where) if where else x
    g = x.induced(x.vertices.where(vertex_filter)) if vertex_filter else x
    if edge_filter:
        kept = triplets(g, _words(edge_filter), ids=True).where(edge_filter).select("eid")
        g = g.with_edges(g.need_edges().join(kept, "eid", "left_semi"))
    return g


def transform(df: DataFrame, **new: str) -> DataFrame:
    """Replace columns by SQL expressions over the old ones."""
    return df.select(*(F.expr(new[c]).alias(c) if c in new else F.col(c) for c in df.columns))


def derive_column(df: DataFrame, name: str, value: str) -> DataFrame:
    """Add or replace a column by an SQL expression; it comes last."""
    return df.select(*(c for c in df.columns if c != name), F.expr(value).alias(name))
