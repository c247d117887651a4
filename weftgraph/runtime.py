"""What all operators share: written tables that cut lineage, heavy-key detection, skew-proof joins."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Rows and bytes that a side may have at most to be broadcast by :func:`split_join`, which counts them before.
BROADCAST_ROWS, BROADCAST_BYTES = 100_000, 64 << 20
_scopes: list[list[tuple[SparkSession, str]]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``. Where it is unset, one of our own if the session is local; on a cluster an error."""
    conf = spark.sparkContext.getConf()
    path = conf.get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        path = "file://" + os.path.join(tempfile.gettempdir(), f"weftgraph-{spark.sparkContext.applicationId}")
        spark.conf.set("spark.checkpoint.dir", path)
    return path


def spill(df: DataFrame, **observed: Column) -> DataFrame:
    """Write ``df`` once as a Parquet table in the shared folder and read it back.

    Cuts the lineage like ``checkpoint()``, but computes the plan only once, stores it
    compressed by column, and survives the loss of executors. ``observed`` are aggregates of the
    written table; their values are in the ``seen`` of the result. (Observations taken while writing would make the session unfit for some models of Spark's library.)
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/weftgraph/{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._weft_path = path
    if observed:
        out.seen = out.agg(*(c.alias(n) for n, c in observed.items())).first().asDict()
    if _scopes:
        _scopes[-1].append((spark, path))
    return out


@contextmanager
def scratch() -> Iterator[None]:
    """Every table that :func:`spill` writes inside the block is deleted at its end. Results that are read later must be written or collected inside."""
    _scopes.append([])
    try:
        yield
    finally:
        for spark, path in _scopes.pop():
            _delete(spark, path)


def together(written: list[DataFrame]) -> DataFrame:
    """Tables of one schema written by :func:`spill`, as one scan."""
    return written[0].sparkSession.read.schema(written[0].schema).parquet(*(x._weft_path for x in written))


def rows_of(df: DataFrame) -> int:
    """Number of rows; of a table written by :func:`spill` it is read from the footers, and once only."""
    n = getattr(df, "_weft_rows", None)
    if n is None:
        n = df.count()
        if hasattr(df, "_weft_path"):
            df._weft_rows = n
    return n


def drop(df: DataFrame | None) -> None:
    """Delete a table written by :func:`spill` that nothing will read again."""
    path = getattr(df, "_weft_path", None)
    if path:
        _delete(df.sparkSession, path)


def _delete(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def fits_broadcast(df: DataFrame, rows: int | None = None) -> bool:
    """Whether a side has at most ``BROADCAST_ROWS`` rows and ``BROADCAST_BYTES`` bytes. ``rows`` tells how many there are at most, if known; rows of fixed width need no look then."""
    if rows is not None and rows > BROADCAST_ROWS:
        return False
    loose = [f for f in df.schema.fields if f.dataType.typeName() in ("string", "binary", "array", "map", "struct")]
    fixed = 8 * (len(df.columns) - len(loose))
    if not loose:
        if rows is None:
            rows = rows_of(df) if hasattr(df, "_weft_path") else df.limit(BROADCAST_ROWS + 1).count()
        return rows <= BROADCAST_ROWS and rows * fixed <= BROADCAST_BYTES
    width = sum((F.coalesce(F.octet_length(F.col(f"`{f.name}`") if f.dataType.typeName() in ("string", "binary") else F.to_json(F.struct(f"`{f.name}`"))), F.lit(0)) for f in loose), F.lit(fixed))
    n, size = df.limit(BROADCAST_ROWS + 1).select(width.alias("w")).agg(F.count(F.lit(1)), F.sum("w")).first()
    return n <= BROADCAST_ROWS and (size or 0) <= BROADCAST_BYTES


def numbered(df: DataFrame, order: str, name: str, size: str | None = None) -> DataFrame:
    """``df`` with the position 0, 1, ... of each row in an order (or the sum of ``size`` over the rows before it), without a sort in one task: range partitions are summed, and each begins where
    those before it end."""
    parts = spill(df.repartitionByRange(order).withColumn("_part", F.spark_partition_id()))
    each = F.col(size) if size else F.lit(1)
    totals = parts.groupBy("_part").agg(F.sum(each).alias("_n"))
    totals = totals.withColumn("_before", F.sum("_n").over(Window.orderBy("_part")) - F.col("_n"))
    within = F.sum(each).over(Window.partitionBy("_part").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)) - each
    return parts.join(F.broadcast(totals.select("_part", "_before")), "_part").withColumn(name, within + F.col("_before")).drop("_part", "_before")


def shuffle_width(spark: SparkSession) -> int:
    """Number of salts for hot groups: one for each shuffle partition."""
    return max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))


def heavy_keys(df: DataFrame, cols: list[str], support: float = 0.01) -> dict[str, list]:
    """Keys holding at least ``support`` of the rows, found by a mergeable counter sketch.

    The sketch keeps at most ``1/support`` counters for each partition and misses no key at or above
    the support; it may name a few below. So the result is bounded by ``1/support`` keys a column,
    whatever the input. Nulls are left out.
    """
    row = df.stat.freqItems(cols, support).first()
    return {c: sorted({x for x in (row[i] or []) if x is not None}) if row else [] for i, c in enumerate(cols)}


def split_join(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner", key: str | None = None, support: float = 0.02, heavy: list | None = None, right_rows: int | None = None) -> DataFrame:
    """Join a side with hot keys (``left``) to another without holding up one task.

    A ``right`` that :func:`fits_broadcast` (``right_rows`` may say how many rows it has at most) is broadcast. Else, keys owning at least ``support`` of ``left`` are found
    by sketch, or given as ``heavy``: their part of ``right`` is broadcast when it fits, or both
    sides are salted; all other keys take the ordinary shuffle join. ``how`` is inner, left, left_semi or left_anti. Null keys match nothing.
    """
    key = key or on[0]
    if fits_broadcast(right, right_rows):
        return left.join(F.broadcast(right), on, how)
    heavy = heavy_keys(left, [key], support)[key] if heavy is None else heavy
    if not heavy:
        return left.join(right, on, how)
    hot = F.coalesce(F.col(key).isin(heavy), F.lit(False))
    hot_left, hot_right = left.where(hot), right.where(hot)
    rest = left.where(~hot).join(right.where(~hot), on, how)
    if fits_broadcast(hot_right):
        part = hot_left.join(F.broadcast(hot_right), on, how)
    else:
        width = shuffle_width(left.sparkSession)
        salt = F.pmod(F.xxhash64(*left.columns), F.lit(width)).cast("int")
        salted = hot_right.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(width - 1))))
        part = hot_left.withColumn("_salt", salt).join(salted, [*on, "_salt"], how).drop("_salt")
    return part.unionByName(rest)


def whole_number(text: Column | str) -> Column:
    """The int64 in a text: spaces and tabs around it, leading zeros and a trailing ``.0`` do not count.

    Blank text, and text that is no whole number in the int64 range, gives null.
    """
    text = F.col(text) if isinstance(text, str) else text
    core = F.regexp_replace(F.btrim(text, F.lit(" \t")), r"\.0$", "")
    return F.when(core.rlike(r"^[+-]?[0-9]+$"), core.try_cast("bigint"))


def mixed(ids: np.ndarray, seed: int) -> np.ndarray:
    """A hash of 64 bits of the last axis."""
    h = np.full(ids.shape[:-1], seed, np.uint64)
    for i in range(ids.shape[-1]):
        h = (h ^ ids[..., i]) + np.uint64(0x9E3779B97F4A7C15)
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        h ^= h >> np.uint64(31)
    return h


def free_name(taken, name: str) -> str:
    """``name``, with underscores in front until it clashes with none of the names taken."""
    taken = {x.lower() for x in taken}
    while name.lower() in taken:
        name = "_" + name
    return name
