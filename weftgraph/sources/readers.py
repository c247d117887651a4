"""Sources. All share one tail: chosen columns, a limit, and a query in which the table is called ``this``."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession

from ..functions.sql_functions import rewritten
from ..graph import Graph

ERROR_HANDLING = {"Fail on any malformed line": "FAILFAST", "Ignore malformed lines": "DROPMALFORMED", "Salvage malformed lines: truncate or fill with nulls": "PERMISSIVE"}


def finish(df: DataFrame, columns: Sequence[str] = (), limit: int | None = None, sql: str = "") -> DataFrame:
    """The shared tail of all importers; Catalyst pushes it into the scan."""
    df = df.select(*columns) if columns else df
    df = df.limit(limit) if limit is not None else df
    return df.sparkSession.sql(re.sub(r"\bthis\b", "{this}", rewritten(sql)), this=df) if sql else df


def read_csv(
    spark: SparkSession, path: str, columns: Sequence[str] = (), delimiter: str = ",", quote: str = '"', escape: str = "\\", null_value: str = "", date_format: str = "yyyy-MM-dd",
    timestamp_format: str | None = None, trim_left: bool = False, trim_right: bool = False, comment: str | None = None, error_handling: str = "Fail on any malformed line", infer: bool = False, **tail,
) -> DataFrame:
    """Delimited text. ``columns`` name text columns of files without a header; else the header does. See also
    :mod:`weftgraph.operators.recovering_csv` for files with broken quotes."""
    options = {
        "sep": delimiter, "quote": quote, "escape": escape, "nullValue": null_value, "dateFormat": date_format, "timestampFormat": timestamp_format,
        "ignoreLeadingWhiteSpace": trim_left, "ignoreTrailingWhiteSpace": trim_right, "comment": comment, "mode": ERROR_HANDLING[error_handling], "inferSchema": infer,
    }
    reader = spark.read.options(**{k: v for k, v in options.items() if v is not None})
    if columns:
        from pyspark.sql.types import StringType, StructField, StructType

        df = reader.option("inferSchema", False).schema(StructType([StructField(c, StringType()) for c in columns])).csv(path)
    else:
        df = reader.option("header", True).csv(path)
    return finish(df, tail.pop("imported_columns", ()), **tail)


def read_structured(spark: SparkSession, kind: str, path: str, **tail) -> DataFrame:
    """Self-describing files: orc, json, avro, delta. For delta ``version_as_of`` gives an older version."""
    reader = spark.read.format(kind)
    if (version := tail.pop("version_as_of", None)) is not None:
        reader = reader.option("versionAsOf", version)
    return finish(reader.load(path), tail.pop("imported_columns", ()), **tail)


def read_parquet(spark: SparkSession, path: str, schema: str | None = None, **tail) -> DataFrame:
    """With a ``schema`` of lines ``column: type`` (or ``array of type``) nothing is read until it is needed, not even footers."""
    reader = spark.read
    if schema:
        parts = [re.match(r"\s*([^:]+?)\s*:\s*(.+?)\s*$", x) for x in re.split(r"[,\n]", schema) if x.strip()]
        kind = lambda t: f"array<{t[len('array of ') :].strip()}>" if t.lower().startswith("array of ") else t
        reader = reader.schema(", ".join(f"`{m.group(1)}` {kind(m.group(2))}" for m in parts))
    return finish(reader.parquet(path), tail.pop("imported_columns", ()), **tail)


def read_jdbc(spark: SparkSession, url: str, table: str, key_column: str | None = None, num_partitions: int = 0, predicates: Sequence[str] = (), properties: dict | None = None, **tail) -> DataFrame:
    """A database table; in parallel by predicates, or by equal ranges of a numeric key between its extremes."""
    properties = properties or {}
    if predicates:
        df = spark.read.jdbc(url, table, predicates=list(predicates), properties=properties)
    elif key_column and num_partitions > 1:
        low, high = spark.read.jdbc(url, f"(select min({key_column}) a, max({key_column}) b from {table}) x", properties=properties).first()
        df = spark.read.jdbc(url, table, column=key_column, lowerBound=low, upperBound=high, numPartitions=num_partitions, properties=properties)
    else:
        df = spark.read.jdbc(url, table, properties=properties)
    return finish(df, tail.pop("imported_columns", ()), **tail)


def read_hive(spark: SparkSession, table: str, **tail) -> DataFrame:
    return finish(spark.table(table), tail.pop("imported_columns", ()), **tail)


def read_bigquery(spark: SparkSession, parent_project: str, project: str = "", dataset: str = "", table: str = "", query: str = "", credentials_file: str | None = None, views_enabled: bool = False, materialization_dataset: str = "", **tail) -> DataFrame:
    """A table, or the result of a query, through the connector (to be on the class path)."""
    reader = spark.read.format("bigquery").option("parentProject", parent_project).option("viewsEnabled", views_enabled or bool(query))
    if credentials_file:
        reader = reader.option("credentialsFile", credentials_file)
    df = reader.option("materializationDataset", materialization_dataset).option("query", query).load() if query else reader.load(f"{project}.{dataset}.{table}")
    return finish(df, tail.pop("imported_columns", ()), **tail)


def read_neo4j(spark: SparkSession, vertex_query: str, edge_query: str, url: str = "bolt://localhost:7687", username: str = "neo4j", password: str = "neo4j", database: str = "") -> Graph:
    """Nodes and relationships of two queries through the connector; they must return ``id`` and ``eid``, ``src``, ``dst``."""
    reader = spark.read.format("org.neo4j.spark.DataSource").options(**{"url": url, "authentication.basic.username": username, "authentication.basic.password": password, **({"database": database} if database else {})})
    return Graph(reader.option("query", vertex_query).load(), reader.option("query", edge_query).load())


def read_snapshot(spark: SparkSession, path: str) -> DataFrame | Graph:
    """A saved table or graph."""
    from .writers import load_graph

    from py4j.protocol import Py4JJavaError

    try:
        return load_graph(spark, path)
    except (FileNotFoundError, Py4JJavaError):
        return spark.read.parquet(path)


def read_union_of_snapshots(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """All rows of tables of one schema."""
    frames = [spark.read.parquet(p) for p in paths]
    first = frames[0].schema
    for p, f in zip(paths, frames):
        if [(x.name, x.dataType) for x in f.schema] != [(x.name, x.dataType) for x in first]:
            raise ValueError(f"the schema of {p} differs from that of {paths[0]}")
    return reduce(DataFrame.unionByName, frames)


def external_computation(compute: Callable[..., DataFrame], *inputs: DataFrame) -> DataFrame:
    """A table computed by a user function over tables."""
    return compute(*inputs)
