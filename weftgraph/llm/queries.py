"""Queries p2, p4, p5, p7, p8 and p9, with SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..queries.common import table
from ..runtime import spill
from . import clean_events, groups, leaks, packing, runs, subjects, subsequences


def p2_found(spark, d):
    return groups.consolidate(table(spark, d, "unordered_edge_row"))


def _clean(spark, d):
    return clean_events.clean_events(table(spark, d, "person_event"), table(spark, d, "event_location"))


def p4_patterns(spark, d):
    return subsequences.frequent_subsequences(_clean(spark, d))


def p4_found(spark, d):
    return p4_patterns(spark, d).select("pattern")


def p5_found(spark, d):
    return runs.collapse_runs(_clean(spark, d), 2).select("person_id", "place", "first_event_id", "last_event_id")


def p5_spans(spark, d):
    return runs.collapse_runs(_clean(spark, d)).select("person_id", "place", "first_event_id", "last_event_id", "startTime", "endTime", "events", "duration")


def p7_containers(spark, d):
    return packing.fill_containers(table(spark, d, "documents"))


def p7_fill(spark, d):
    return packing.fill_report(p7_containers(spark, d))


def p7_violations(spark, d):
    """What a packing may not do: containers over the capacity, texts within the capacity that are divided, parts whose tokens do not add up to the text's; and the documents packed."""
    packed = spill(p7_containers(spark, d))
    over = packed.groupBy("container").agg(F.sum("tokens").alias("n")).where(F.col("n") > packing.CAPACITY).count()
    per = packed.groupBy("doc_id").agg(F.count(F.lit(1)).alias("parts"), F.sum("tokens").alias("n"), F.max("doc_tokens").alias("whole"))
    return per.agg(
        F.lit(over).cast("bigint").alias("over_capacity"), F.count_if((F.col("parts") > 1) & (F.col("whole") <= packing.CAPACITY)).alias("divided"),
        F.count_if(F.col("n") != F.col("whole")).alias("incomplete"), F.count(F.lit(1)).alias("documents"),
    )


def p8_found(spark, d):
    return leaks.leaks(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p8_items(spark, d):
    return p8_found(spark, d).groupBy("item_id").agg(F.count(F.lit(1)).alias("documents"))


QUERIES = {q.__name__: q for q in (p2_found, p4_found, p4_patterns, p5_found, p5_spans, p7_containers, p7_fill, p7_violations, p8_found, p8_items)}

_CLEAN = """
WITH RECURSIVE chain AS (SELECT location AS l, location AS cur, alias_of FROM event_location
  UNION ALL SELECT c.l, x.location, x.alias_of FROM chain c JOIN event_location x ON c.alias_of = x.location),
loc AS (SELECT l, cur AS place FROM chain WHERE alias_of IS NULL),
last AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY event_id
  ORDER BY loaded_at DESC NULLS LAST, person_id DESC NULLS LAST, time DESC NULLS LAST, location DESC NULLS LAST) AS rn FROM person_event WHERE event_id IS NOT NULL) WHERE rn = 1),
ev AS (SELECT event_id, person_id, time, place FROM last JOIN loc ON l = location WHERE person_id IS NOT NULL AND time IS NOT NULL)
"""
_RUNS = (
    _CLEAN
    + """,
a AS (SELECT *, CASE WHEN lag(place) OVER w = place THEN 0 ELSE 1 END AS new FROM ev WINDOW w AS (PARTITION BY person_id ORDER BY time, event_id)),
b AS (SELECT *, sum(new) OVER (PARTITION BY person_id ORDER BY time, event_id ROWS UNBOUNDED PRECEDING) AS run FROM a),
s AS (SELECT person_id, place, arg_min(event_id, (time, event_id)) AS first_event_id, arg_max(event_id, (time, event_id)) AS last_event_id,
  min(time) AS startTime, max(time) AS endTime, count(*) AS events, max(time) - min(time) AS duration FROM b GROUP BY person_id, place, run)
"""
)
_STEP = "({b}.time, {b}.event_id) > ({a}.time, {a}.event_id) AND {b}.time < a.time + 21600"
_P4 = (
    _CLEAN
    + """,
n AS (SELECT count(DISTINCT person_id) AS n FROM ev),
fp AS (SELECT a.place AS p, b.place AS q FROM ev a JOIN ev b ON a.person_id = b.person_id AND """
    + _STEP.format(a="a", b="b")
    + """ AND a.place <> b.place GROUP BY 1, 2 HAVING count(DISTINCT a.person_id) * 100 >= 5 * (SELECT n FROM n)),
t2 AS (SELECT a.person_id, a.time AS t0, b.time, b.event_id, [a.place, b.place] AS ps FROM ev a JOIN ev b ON a.person_id = b.person_id AND """
    + _STEP.format(a="a", b="b")
    + """ JOIN fp ON a.place = p AND b.place = q)"""
    + "".join(
        f""",
t{k} AS (SELECT DISTINCT a.person_id, a.t0, b.time, b.event_id, list_append(a.ps, b.place) AS ps FROM t{k - 1} a JOIN ev b ON a.person_id = b.person_id
  AND (b.time, b.event_id) > (a.time, a.event_id) AND b.time < a.t0 + 21600 AND """
        + " AND ".join(f"(a.ps[{i}], b.place) IN (SELECT p, q FROM fp)" for i in range(1, k))
        + ")"
        for k in (3, 4, 5)
    )
    + """,
c AS (SELECT ps, count(DISTINCT person_id) AS persons FROM (SELECT person_id, ps FROM t3 UNION ALL SELECT person_id, ps FROM t4 UNION ALL SELECT person_id, ps FROM t5) GROUP BY 1),
f AS (SELECT array_to_string(ps, '>') AS pattern, persons FROM c WHERE persons * 100 >= 5 * (SELECT n FROM n))
"""
)
SQL = {
    "p7_violations": "SELECT 0 AS over_capacity, 0 AS divided, 0 AS incomplete, count(DISTINCT doc_id) AS documents FROM documents",
    "p4_found": _P4 + "SELECT pattern FROM f",
    "p4_patterns": _P4 + "SELECT pattern, persons FROM f",
    "p2_found": """
WITH RECURSIVE n AS (SELECT src AS a, dst AS b FROM unordered_edge_row WHERE src IS NOT NULL AND dst IS NOT NULL
  UNION SELECT dst, src FROM unordered_edge_row WHERE src IS NOT NULL AND dst IS NOT NULL),
v AS (SELECT src AS id FROM unordered_edge_row WHERE src IS NOT NULL UNION SELECT dst FROM unordered_edge_row WHERE dst IS NOT NULL),
cc(id, g) USING KEY (id) AS (SELECT id, id FROM v
  UNION SELECT n.b, min(cc.g) FROM cc JOIN n ON n.a = cc.id JOIN recurring.cc AS old ON old.id = n.b WHERE cc.g < old.g GROUP BY n.b)
SELECT id AS record_id, g AS group_id FROM cc""",
    "p5_found": _RUNS + "SELECT person_id, place, first_event_id, last_event_id FROM s WHERE events >= 2",
    "p5_spans": _RUNS + "SELECT * FROM s",
}


def _p9(spark, d):
    docs = table(spark, d, "documents")
    return subjects.document_subjects(docs, subjects.fit(docs, table(spark, d, "subject_labels")))


def p9_found(spark, d):
    return _p9(spark, d).select("doc_id", F.explode("subjects").alias("subject")).distinct()


def p9_documents(spark, d):
    return _p9(spark, d)


def p9_composition(spark, d):
    return subjects.composition(_p9(spark, d))


QUERIES |= {q.__name__: q for q in (p9_found, p9_documents, p9_composition)}
