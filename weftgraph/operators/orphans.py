"""References to records that do not exist: bitmaps of references AND-NOT bitmaps of parents in force.

1. Keys of both sides are dictionary-encoded: a hash bucket and a dense position in it, so that sparse keys fill
   bitmaps. A key range is a run of 32,768 positions of a bucket.
2. For each range and month there is a compressed bitmap of the keys referenced: a sorted array of positions, or bits where they
   are shorter. The parents' bitmaps are kept as changes: an interval in force sets its key's bit with the first month
   it covers whole, and clears it after the last.
3. Month by month, references AND-NOT parents leaves the keys that were not in force throughout.
4. The surviving bits are decoded, and only their references are checked against the exact moments.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import heavy_keys, shuffle_width, spill, split_join, whole_number

RANGE_BITS = 32_768
#: Keys that a dictionary bucket is laid out for; one with more simply has several ranges.
BUCKET_KEYS = 20_000
#: Positions (of two bytes) up to which a bitmap is a sorted array; a bitmap of bits takes as much space.
ARRAY_MOST = RANGE_BITS // 16
_MONTH = "year({0}) * 12 + month({0}) - 1"
_MONTH_START = "to_timestamp_ntz(make_date(div({0}, 12), {0} % 12 + 1, 1))"


def references(df: DataFrame, table_name: str, src: str = "srcVertexId", dst: str = "dstVertexId") -> DataFrame:
    """The references of an edge table, each edge once: table_name, edge_id, endpoint, key, at.

    Of rows delivered again the earliest ``loaded_at`` counts. Ends without a value refer to nothing; an edge without
    ``loaded_at`` has no moment to be checked at and is left out; rows without ``edge_id`` stay apart.
    """
    ends = [(whole_number(c) if dict(df.dtypes)[c] == "string" else F.col(c).cast("bigint")).alias(n) for c, n in ((src, "s"), (dst, "d"))]
    rows = df.select("edge_id", *ends, F.col("loaded_at").cast("timestamp_ntz").alias("at"))
    known = rows.where("edge_id is not null").groupBy("edge_id").agg(F.min("s").alias("s"), F.min("d").alias("d"), F.min("at").alias("at"))
    both = F.inline(F.array(F.struct(F.lit("src").alias("endpoint"), F.col("s").alias("key")), F.struct(F.lit("dst").alias("endpoint"), F.col("d").alias("key"))))
    return known.unionByName(rows.where("edge_id is null")).where("at is not null").select(F.lit(table_name).alias("table_name"), "edge_id", "at", both).where("key is not null")


def intervals_in_force(vertices: DataFrame, key: str = "vertexId") -> DataFrame:
    """Disjoint intervals [a, b) in which a key is in force: key, a, b (null b: without end).

    Rows delivered again, overlapping or touching are merged, first within a day of ``loaded_at`` and then for each
    key, so that a key delivered very often is thinned out before its rows meet. Rows never in force (deleted at or
    before their loading, or without ``loaded_at``) give none.
    """
    far = F.lit("9999-12-31").cast("timestamp_ntz")
    rows = vertices.select(F.col(key).cast("bigint").alias("key"), F.col("loaded_at").cast("timestamp_ntz").alias("a"), F.coalesce(F.col("deleted_at").cast("timestamp_ntz"), far).alias("b"))
    rows = rows.where("key is not null and a < b").groupBy("key", "a").agg(F.max("b").alias("b"))
    for part in ([F.col("key"), F.to_date("a")], [F.col("key")]):
        over = Window.partitionBy(*part).orderBy("a")
        begun = F.max("b").over(over.rowsBetween(Window.unboundedPreceding, -1))
        rows = rows.withColumn("_new", (begun.isNull() | (begun < F.col("a"))).cast("int")).withColumn("_day", F.to_date("a"))
        rows = rows.withColumn("_run", F.sum("_new").over(over))
        by = ["key", "_day", "_run"] if len(part) == 2 else ["key", "_run"]
        rows = rows.groupBy(*by).agg(F.min("a").alias("a"), F.max("b").alias("b")).select("key", "a", "b")
    return rows.withColumn("b", F.when(F.col("b") < far, F.col("b")))


def bitmap(positions: np.ndarray) -> np.ndarray:
    """A compressed bitmap of positions below ``RANGE_BITS``: sorted uint16 positions, or (more than ``ARRAY_MOST``) bits in bytes."""
    positions = np.unique(positions).astype(np.uint16)
    if len(positions) <= ARRAY_MOST:
        return positions
    bits = np.zeros(RANGE_BITS, np.uint8)
    bits[positions] = 1
    return np.packbits(bits, bitorder="little")


def positions_of(bits: np.ndarray) -> np.ndarray:
    return bits if bits.dtype == np.uint16 else np.flatnonzero(np.unpackbits(bits, bitorder="little")).astype(np.uint16)


def _dense(bits: np.ndarray) -> np.ndarray:
    if bits.dtype == np.uint8:
        return bits
    out = np.zeros(RANGE_BITS, np.uint8)
    out[bits] = 1
    return np.packbits(out, bitorder="little")


def or_(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    if a.dtype == b.dtype == np.uint16 and len(a) + len(b) <= ARRAY_MOST:
        return np.union1d(a, b)
    return _compressed(_dense(a) | _dense(b))


def and_not(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The bits of ``a`` that ``b`` does not have. An array on either side is never blown up."""
    if a.dtype == np.uint16:
        if b.dtype == np.uint16:
            return np.setdiff1d(a, b, assume_unique=True)
        return a[b[a >> 3] >> (a & 7).astype(np.uint8) & 1 == 0]
    if b.dtype == np.uint16:
        out = a.copy()
        np.bitwise_and.at(out, b >> 3, ~(np.uint8(1) << (b & 7).astype(np.uint8)))
        return _compressed(out)
    return _compressed(a & ~b)


def _compressed(bits: np.ndarray) -> np.ndarray:
    return positions_of(bits) if np.unpackbits(bits).sum() <= ARRAY_MOST else bits


def _survivors(named: DataFrame, buckets: int) -> DataFrame:
    """Reference AND-NOT parent over distinct (key, month, kind), kind R (referenced), S (in force from here on) or E (no longer): the keys and months left.

    A task has a bucket's keys, in one row a month and kind at most: their dictionary, their bitmaps by range, month and kind, and the decoding.
    """

    def run(table: pa.Table) -> pa.Table:
        key, month = table.column("key").to_numpy(), table.column("month").to_numpy()
        kind = np.array(table.column("kind").to_pylist())
        dictionary, code = np.unique(key, return_inverse=True)
        keys, months = [], []
        for r in range(-(-len(dictionary) // RANGE_BITS)):
            here = code // RANGE_BITS == r
            at = np.flatnonzero(here)
            at = at[np.argsort(month[at], kind="stable")]
            parent = np.zeros(0, np.uint16)
            for some in np.split(at, np.flatnonzero(np.diff(month[at])) + 1):
                marks = {k: bitmap(code[some[kind[some] == k]] % RANGE_BITS) for k in "SER"}
                parent = and_not(or_(parent, marks["S"]), marks["E"])
                left = positions_of(and_not(marks["R"], parent)).astype(np.int64) + r * RANGE_BITS
                keys.append(dictionary[left])
                months.append(np.full(len(left), month[some[0]], np.int32))
        return pa.table({"key": pa.array(np.concatenate(keys), pa.int64()), "month": pa.array(np.concatenate(months), pa.int32())})

    bucket = F.pmod(F.xxhash64("key"), F.lit(buckets)).cast("int")
    return named.withColumn("bucket", bucket).groupBy("bucket").applyInArrow(run, "key bigint, month int")


def orphan_references(refs: DataFrame, vertices: DataFrame, key: str = "vertexId") -> DataFrame:
    """References to keys of which no row is in force at the reference's moment.

    ``refs`` is as :func:`references` gives it (read several times, so best a written table), ``vertices`` has the key,
    ``loaded_at`` and ``deleted_at``; a row is in force from the one (inclusive) to the other (exclusive). Returns
    table_name, edge_id, endpoint, kind (``missing``: the key has no row; ``deleted``: a row was loaded at or before the
    moment; ``late``: all are loaded after it, or at an unknown time) and period (``yyyy-MM``). Extra columns are not
    read. Repeated rows come out once; empty vertices make every reference ``missing``.

    Hot keys: references are reduced to distinct (key, month) before they meet anything; the join back to single
    references broadcasts the survivors of heavy keys. Each of these references looks up the one interval that began last before it,
    in an order of both by (key, month); a heavy key's references are spread by salt, with its few intervals in every part.
    """
    spark = refs.sparkSession
    refs = refs.withColumn("month", F.expr(_MONTH.format("at")).cast("int"))
    live = spill(intervals_in_force(vertices, key))
    months = live.select(
        "key",
        F.expr(f"{_MONTH.format('a')} + if(a > {_MONTH_START.format(f'({_MONTH.format("a")})')}, 1, 0)").cast("int").alias("first"),
        F.expr(_MONTH.format("b")).cast("int").alias("after"),
    ).where("after is null or first < after")
    referred = refs.select("key", "month").distinct()
    change = F.inline(F.array(F.struct(F.col("first").alias("month"), F.lit("S").alias("kind")), F.struct(F.col("after").alias("month"), F.lit("E").alias("kind"))))
    named = referred.withColumn("kind", F.lit("R")).unionByName(months.select("key", change).where("month is not null"))
    buckets = max(1, -(-refs.agg(F.approx_count_distinct("key")).first()[0] // BUCKET_KEYS))
    left = _survivors(named, buckets)
    first = vertices.select(F.col(key).cast("bigint").alias("key"), F.col("loaded_at").cast("timestamp_ntz").alias("a")).where("key is not null").groupBy("key").agg(F.min("a").alias("first_at"), F.lit(True).alias("known"))
    left = spill(left.join(first, "key", "left"))
    heavy = heavy_keys(refs, ["key"], 0.02)["key"]
    width = shuffle_width(spark)
    hot = F.col("key").isin(heavy) if heavy else F.lit(False)
    found = split_join(refs, left, ["key", "month"], heavy=heavy).withColumn("salt", F.when(hot, F.pmod(F.xxhash64("edge_id", "at"), F.lit(width)).cast("int")).otherwise(F.lit(0)))
    # the parts of intervals in months that they do not cover whole
    touched = F.array_distinct(F.array(F.expr(_MONTH.format("a")).cast("int"), F.expr(_MONTH.format("b")).cast("int")))
    spans = live.select("key", "a", "b", F.explode(touched).alias("month")).where("month is not null").join(left.select("key", "month"), ["key", "month"], "left_semi")
    spans = spans.select("key", "month", F.greatest("a", F.expr(_MONTH_START.format("month"))).alias("at"), F.struct("b").alias("span"))
    spans = spans.withColumn("salt", F.explode(F.when(hot, F.sequence(F.lit(0), F.lit(width - 1))).otherwise(F.array(F.lit(0)))))
    # of one moment the interval comes before the reference
    over = Window.partitionBy("key", "month", "salt").orderBy("at", F.col("edge").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    row = F.struct("table_name", "edge_id", "endpoint", "first_at", "known").alias("edge")
    both = found.select("key", "month", "salt", "at", row).unionByName(spans, allowMissingColumns=True).withColumn("begun", F.last("span", ignorenulls=True).over(over)).where("edge is not null")
    outside = both.where("begun is null or begun.b <= at")
    kind = F.expr("case when edge.known is null then 'missing' when edge.first_at <= at then 'deleted' else 'late' end").alias("kind")
    rows = outside.select("edge.table_name", "edge.edge_id", "edge.endpoint", kind, "key", "at").distinct()
    return rows.select("table_name", "edge_id", "endpoint", "kind", F.date_format("at", "yyyy-MM").alias("period"))


def orphan_counts(found: DataFrame) -> DataFrame:
    """Orphan references per table, month, end and kind: table_name, period, endpoint, kind, n."""
    return found.groupBy("table_name", "period", "endpoint", "kind").agg(F.count(F.lit(1)).alias("n"))
