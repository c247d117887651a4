"""Sinks."""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..graph import Graph, Segmentation

MODES = {"error if exists": "error", "overwrite": "overwrite", "append": "append", "ignore": "ignore"}


def write_csv(
    df: DataFrame, path: str, delimiter: str = ",", quote: str = '"', quote_all: bool = False, header: bool = True, escape: str = "\\", null_value: str = "", date_format: str = "yyyy-MM-dd",
    timestamp_format: str | None = None, trim_left: bool = False, trim_right: bool = False, save_mode: str = "error if exists", for_download: bool = False,
) -> None:
    """Delimited text; for download as a single file."""
    options = {
        "sep": delimiter, "quote": quote, "quoteAll": quote_all, "header": header, "escape": escape, "nullValue": null_value, "dateFormat": date_format,
        "timestampFormat": timestamp_format, "ignoreLeadingWhiteSpace": trim_left, "ignoreTrailingWhiteSpace": trim_right,
    }
    (df.coalesce(1) if for_download else df).write.options(**{k: v for k, v in options.items() if v is not None}).mode(MODES[save_mode]).csv(path)


def write_structured(df: DataFrame, kind: str, path: str, save_mode: str = "error if exists", for_download: bool = False) -> None:
    """json, parquet, orc, avro or delta files."""
    (df.coalesce(1) if for_download else df).write.format(kind).mode(MODES[save_mode]).save(path)


def write_jdbc(df: DataFrame, url: str, table: str, mode: str = "error if exists", properties: dict | None = None) -> None:
    df.write.jdbc(url, table, MODES[mode], properties or {})


def write_hive(df: DataFrame, table: str, mode: str = "error if exists", partition_by: Sequence[str] = (), path: str | None = None) -> None:
    """A table of the catalog; with a ``path`` its files lie there."""
    w = df.write.mode(MODES[mode])
    w = w.option("path", path) if path else w
    (w.partitionBy(*partition_by) if partition_by else w).saveAsTable(table)


def _text(spark: SparkSession, path: str, text: str | None = None) -> str:
    """Write, or read if no text is given, a small file on the data's file system."""
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    if text is not None:
        out = fs.create(p, True)
        out.write(bytearray(text.encode()))
        out.close()
        return text
    if not fs.exists(p):
        raise FileNotFoundError(path)
    stream = fs.open(p)
    try:
        return bytes(jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
    finally:
        stream.close()


def save_snapshot(x: DataFrame | Graph, path: str) -> None:
    """A table as Parquet; a graph as a folder of its tables."""
    if isinstance(x, DataFrame):
        x.write.parquet(path)
        return
    x.vertices.write.parquet(f"{path}/vertices")
    if x.edges is not None:
        x.edges.write.parquet(f"{path}/edges")
    for i, (_, s) in enumerate(sorted(x.segmentations.items())):
        s.membership.write.parquet(f"{path}/segmentation-{i}/membership")
        save_snapshot(s.graph, f"{path}/segmentation-{i}/graph")
    _text(x.spark, f"{path}/graph.json", json.dumps({"scalars": dict(x.scalars), "edges": x.edges is not None, "segmentations": sorted(x.segmentations)}, default=str))


def load_graph(spark: SparkSession, path: str) -> Graph:
    meta = json.loads(_text(spark, f"{path}/graph.json"))
    g = Graph(spark.read.parquet(f"{path}/vertices"), spark.read.parquet(f"{path}/edges") if meta["edges"] else None, meta["scalars"])
    segs = {n: Segmentation(load_graph(spark, f"{path}/segmentation-{i}/graph"), spark.read.parquet(f"{path}/segmentation-{i}/membership")) for i, n in enumerate(meta["segmentations"])}
    return replace(g, segmentations=segs)


def _neo4j(df: DataFrame, url: str, username: str, password: str, database: str, **options: str) -> None:
    login = {"url": url, "authentication.basic.username": username, "authentication.basic.password": password, **({"database": database} if database else {})}
    df.write.format("org.neo4j.spark.DataSource").mode("Overwrite").options(**login, **options).save()


def write_neo4j_attributes(g: Graph, on: str, labels: str, keys: str, attributes: Sequence[str], url: str = "bolt://localhost:7687", username: str = "neo4j", password: str = "neo4j", database: str = "") -> None:
    """Update matched nodes (``on`` vertices) or relationships through the connector."""
    df = (g.vertices if on == "vertices" else g.need_edges()).select(*keys.split(","), *attributes)
    kind = {"labels": labels, "node.keys": keys} if on == "vertices" else {"relationship": labels, "relationship.save.strategy": "keys", "relationship.keys": keys}
    _neo4j(df, url, username, password, database, **kind)


def write_neo4j_graph(g: Graph, node_labels: str = "", relationship_type: str = "", url: str = "bolt://localhost:7687", username: str = "neo4j", password: str = "neo4j", database: str = "") -> None:
    _neo4j(g.vertices, url, username, password, database, **{"labels": node_labels or ":Node", "node.keys": "id"})
    e = g.need_edges().withColumnRenamed("src", "source.id").withColumnRenamed("dst", "target.id")
    _neo4j(e, url, username, password, database, **{"relationship": relationship_type or "LINK", "relationship.save.strategy": "keys", "relationship.source.labels": node_labels or ":Node", "relationship.source.node.keys": "source.id:id", "relationship.target.labels": node_labels or ":Node", "relationship.target.node.keys": "target.id:id"})


def compute(*frames: DataFrame | Graph) -> None:
    """Force computation without keeping the results."""
    for x in frames:
        for df in (x,) if isinstance(x, DataFrame) else filter(None, (x.vertices, x.edges)):
            df.write.format("noop").mode("overwrite").save()


def one_row(values: dict, spark: SparkSession) -> DataFrame:
    """Scalars as a table."""
    return spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items()))
