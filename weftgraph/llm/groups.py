"""Consolidating pairwise matches into groups by randomised graph contraction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..runtime import BROADCAST_ROWS, drop, rows_of, spill, split_join

_LOW = 0xFFFFFFFF
_ROUNDS = 3


def _half(c: Column, seed: int, k: int) -> Column:
    return F.xxhash64(c, F.lit(seed * 8 + k)).bitwiseAND(F.lit(_LOW))


def scramble(c: Column, seed: int) -> Column:
    """A pseudo-random permutation of the int64 (a Feistel network of hashes), so that its minimum names one vertex."""
    left, right = F.shiftrightunsigned(c, 32), c.bitwiseAND(F.lit(_LOW))
    for k in range(_ROUNDS):
        left, right = right, left.bitwiseXOR(_half(right, seed, k))
    return F.shiftleft(left, 32).bitwiseOR(right)


def unscramble(c: Column, seed: int) -> Column:
    """The inverse of :func:`scramble`."""
    left, right = F.shiftrightunsigned(c, 32), c.bitwiseAND(F.lit(_LOW))
    for k in reversed(range(_ROUNDS)):
        left, right = right.bitwiseXOR(_half(left, seed, k)), left
    return F.shiftleft(left, 32).bitwiseOR(right)


def _relabel(edges: DataFrame, hooks: DataFrame, rows: int, heavy: list) -> DataFrame:
    """Both ends of edges by their hooks: r_a, r_b."""
    for end in ("a", "b"):
        edges = split_join(edges, hooks.select(F.col("v").alias(end), F.col("r").alias(f"r_{end}")), [end], heavy=heavy, right_rows=rows)
    return edges


def _follow(labels: DataFrame, onward: DataFrame, rows: int) -> DataFrame:
    """v and the label that ``onward`` gives to its label r, or r where there is none."""
    later = onward.select(F.col("v").alias("r"), F.col("r").alias("root"))
    return split_join(labels.select("v", "r"), later, ["r"], "left", right_rows=rows).select("v", F.coalesce("root", "r").alias("r"))


def consolidate(pairs: DataFrame, src: str = "src", dst: str = "dst", seed: int = 1) -> DataFrame:
    """One group identifier for every record linked directly or over others: record_id, group_id (the smallest id).

    Every record that occurs as an end of any row comes out once. A row without one of its ends, or pairing a record
    with itself, links nothing. Repeated rows, reversed pairs and extra columns change nothing; empty input gives no rows.

    Each round, every vertex hooks to the vertex of its closed neighbourhood that comes first in a fresh random order, and
    follows that vertex's own hook; edges are relabelled by the hooks and deduplicated. The expected number of rounds is
    logarithmic, whatever the diameter. Afterwards the mappings of the rounds are expanded backwards. Hub vertices: the
    hook is an aggregation combined before the shuffle; in a large round, a vertex with at least 1 % of the edges has
    its hook broadcast (at most 200 such vertices can exist), all others are joined by shuffle.
    """
    rows = pairs.select(F.col(src).cast("bigint").alias("a"), F.col(dst).cast("bigint").alias("b"))
    linked = rows.where("a is not null and b is not null and a <> b")
    edges = spill(linked.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    mappings: list[DataFrame] = []
    while (total := rows_of(edges)) > 0:
        seed += 1
        both = edges.select(F.inline(F.array(F.struct(F.col("a").alias("v"), F.col("b").alias("w")), F.struct(F.col("b").alias("v"), F.col("a").alias("w")))))
        best = both.groupBy("v").agg(F.min(scramble(F.col("w"), seed)).alias("m"), F.count(F.lit(1)).alias("degree"))
        hooks = spill(best.select("v", unscramble(F.least("m", scramble(F.col("v"), seed)), seed).alias("r"), "degree"))
        n = rows_of(hooks)
        heavy = [x.v for x in hooks.where(F.col("degree") * 100 >= total).select("v").collect()] if n > BROADCAST_ROWS else []  # at most 2 * 100
        jumped = spill(_follow(hooks, hooks, n))
        moved = _relabel(edges, jumped, n, heavy).where("r_a <> r_b")
        shrunk = spill(moved.select(F.least("r_a", "r_b").alias("a"), F.greatest("r_a", "r_b").alias("b")).distinct())
        drop(hooks)
        drop(edges)
        edges = shrunk
        mappings.append(jumped)
    everyone = rows.select(F.explode(F.array("a", "b")).alias("record_id")).where("record_id is not null").distinct()
    if not mappings:
        return everyone.withColumn("group_id", F.col("record_id"))
    labels = mappings.pop()
    while mappings:
        first = mappings.pop()
        after = spill(_follow(first, labels, rows_of(labels)))
        drop(first)
        drop(labels)
        labels = after
    smallest = spill(labels.groupBy("r").agg(F.min("v").alias("low")))
    named = split_join(labels, smallest, ["r"]).select(F.col("v").alias("record_id"), "low")
    return everyone.join(named, "record_id", "left").select("record_id", F.coalesce("low", "record_id").alias("group_id"))
