"""Queries p1, p3 and p6, with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import key_stats, orphans, recovering_csv
from ..runtime import shared_dir, spill
from .common import table

COUNTRY_COLUMNS = [("country", "string"), ("country_code", "string"), ("population", "bigint"), ("area", "double"), ("currency", "string")]


def _p1(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "import_large_csv_test").where("line_no > 1")
    return recovering_csv.parse_rows(lines, "raw", COUNTRY_COLUMNS, ["line_id", "file_name"])


def p1_found(spark, d):
    return _p1(spark, d).where("reason is not null").select("line_id", "reason").distinct()


def p1_loaded(spark, d):
    return _p1(spark, d).where("reason is null").select("line_id", "file_name", "parsed.*")


def p1_loaded_from_files(spark, d):
    """The lines written as files and read back as such: broken quotes are recovered from at the next anchor, in ranges of 64 KB."""
    lines = table(spark, d, "import_large_csv_test").where("line_no > 1")
    folder = f"{shared_dir(spark)}/weftgraph/{uuid.uuid4().hex}"
    lines.repartitionByRange("file_name", "line_no", "line_id").select("file_name", "raw").write.partitionBy("file_name").text(folder)
    rows = recovering_csv.read_files(spark, f"{folder}/file_name=*/part-*", COUNTRY_COLUMNS, header=False, chunk_bytes=64 << 10)
    return rows.where("reason is null").select(F.url_decode(F.regexp_extract("file", "file_name=([^/]*)", 1)).alias("file_name"), "parsed.*")


def p1_reasons(spark, d):
    return _p1(spark, d).groupBy("file_name", F.coalesce("reason", F.lit("sound")).alias("outcome")).agg(F.count(F.lit(1)).alias("n"))


def p3_found(spark, d):
    edges = key_stats.prepared(table(spark, d, "fingerprint_100_edges"))
    stats = spill(key_stats.endpoint_stats(edges))
    totals = stats.groupBy("endpoint").agg(F.sum("edges").alias("total"))
    return stats.join(F.broadcast(totals), "endpoint").where(F.col("edges") * 100 >= 3 * F.col("total")).select("endpoint", "vertex_key")


def p3_vertex_counts(spark, d):
    edges = key_stats.prepared(table(spark, d, "fingerprint_100_edges"))
    return key_stats.endpoint_stats(edges).select("endpoint", "vertex_key", "edges", "neighbours")


def _p6(spark: SparkSession, d: str) -> DataFrame:
    refs = spill(orphans.references(table(spark, d, "testgraph_edges"), "testgraph_edges").unionByName(orphans.references(table(spark, d, "two_edge_csv"), "two_edge_csv")))
    return orphans.orphan_references(refs, table(spark, d, "testgraph_vertices"))


def p6_found(spark, d):
    return _p6(spark, d)


def p6_orphans_per_period(spark, d):
    return orphans.orphan_counts(_p6(spark, d))


QUERIES = {q.__name__: q for q in (p1_found, p1_loaded, p1_loaded_from_files, p1_reasons, p3_found, p3_vertex_counts, p6_found, p6_orphans_per_period)}

_FIELD = '(?:"(?:[^"]|"")*"|[^",]*)'
_P1 = f"""
WITH p AS (
  SELECT line_id, file_name, coalesce(raw, '') AS raw,
    regexp_full_match(coalesce(raw, ''), '(?s){_FIELD}(?:,{_FIELD})*') AS quoted,
    regexp_extract_all(',' || coalesce(raw, ''), '(?s),({_FIELD})', 1) AS f
  FROM import_large_csv_test WHERE line_no > 1),
u AS (SELECT *, CASE WHEN quoted THEN list_transform(f, lambda x: CASE WHEN x[1] = '"' THEN replace(x[2:-2], '""', '"') ELSE x END) END AS v FROM p),
t AS (SELECT *, trim(v[3], ' ' || chr(9)) AS pop, trim(v[4], ' ' || chr(9)) AS ar FROM u),
c AS (SELECT *, CASE WHEN NOT quoted THEN 'quoting' WHEN len(v) <> 5 THEN 'columns'
  WHEN NOT (pop = '' OR (regexp_full_match(pop, '[0-9]+') AND TRY_CAST(pop AS HUGEINT) BETWEEN 0 AND 9223372036854775807)) THEN 'value'
  WHEN NOT (ar = '' OR regexp_full_match(ar, '[0-9]+([.][0-9]+)?')) THEN 'value' END AS reason FROM t)
"""


def _whole(c: str) -> str:
    core = f"regexp_replace(trim({c}, ' ' || chr(9)), '[.]0$', '')"
    return f"CASE WHEN regexp_full_match({core}, '[+-]?[0-9]+') THEN TRY_CAST({core} AS BIGINT) END"


_P3 = f"""
WITH r AS (SELECT edge_id, {_whole("src")} AS src, {_whole("dst")} AS dst FROM fingerprint_100_edges),
e AS (SELECT min(src) AS src, min(dst) AS dst FROM r WHERE edge_id IS NOT NULL GROUP BY edge_id UNION ALL SELECT src, dst FROM r WHERE edge_id IS NULL),
x AS (SELECT 'src' AS endpoint, src AS vertex_key, dst AS other FROM e WHERE src IS NOT NULL
  UNION ALL SELECT 'dst', dst, src FROM e WHERE dst IS NOT NULL)
"""
_P6 = f"""
WITH r AS (SELECT 'testgraph_edges' AS table_name, edge_id, srcVertexId AS s, dstVertexId AS d, loaded_at FROM testgraph_edges
  UNION ALL SELECT 'two_edge_csv', edge_id, {_whole("srcVertexId")}, {_whole("dstVertexId")}, loaded_at FROM two_edge_csv),
e AS (SELECT table_name, edge_id, min(s) AS s, min(d) AS d, min(loaded_at) AS t FROM r GROUP BY 1, 2),
x AS (SELECT table_name, edge_id, t, 'src' AS endpoint, s AS k FROM e WHERE s IS NOT NULL AND t IS NOT NULL
  UNION ALL SELECT table_name, edge_id, t, 'dst', d FROM e WHERE d IS NOT NULL AND t IS NOT NULL),
j AS (SELECT x.table_name, x.edge_id, x.endpoint, x.t, count(v.vertexId) AS n,
    coalesce(bool_or(v.loaded_at <= t AND (v.deleted_at IS NULL OR t < v.deleted_at)), false) AS inside,
    coalesce(bool_or(v.loaded_at <= t), false) AS before
  FROM x LEFT JOIN testgraph_vertices v ON v.vertexId = x.k GROUP BY 1, 2, 3, 4),
o AS (SELECT table_name, edge_id, endpoint, CASE WHEN n = 0 THEN 'missing' WHEN before THEN 'deleted' ELSE 'late' END AS kind,
  strftime(t, '%Y-%m') AS period FROM j WHERE NOT inside)
"""
_LOADED = "v[1] AS country, v[2] AS country_code, TRY_CAST(nullif(pop, '') AS BIGINT) AS population, TRY_CAST(nullif(ar, '') AS DOUBLE) AS area, v[5] AS currency FROM c WHERE reason IS NULL"
SQL = {
    "p1_loaded_from_files": _P1 + "SELECT file_name, " + _LOADED,
    "p1_found": _P1 + "SELECT DISTINCT line_id, reason FROM c WHERE reason IS NOT NULL",
    "p1_loaded": _P1 + "SELECT line_id, file_name, " + _LOADED,
    "p1_reasons": _P1 + "SELECT file_name, coalesce(reason, 'sound') AS outcome, count(*) AS n FROM c GROUP BY 1, 2",
    "p3_found": _P3 + ", n AS (SELECT endpoint, vertex_key, count(*) AS edges, sum(count(*)) OVER (PARTITION BY endpoint) AS total FROM x GROUP BY 1, 2) SELECT endpoint, vertex_key FROM n WHERE edges * 100 >= 3 * total",
    "p3_vertex_counts": _P3 + "SELECT endpoint, vertex_key, count(*) AS edges, count(DISTINCT other) AS neighbours FROM x GROUP BY 1, 2",
    "p6_found": _P6 + "SELECT * FROM o",
    "p6_orphans_per_period": _P6 + "SELECT table_name, period, endpoint, kind, count(*) AS n FROM o GROUP BY 1, 2, 3, 4",
}
