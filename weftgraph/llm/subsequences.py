"""Frequent subsequences with gaps: pivot-item partitioning."""

from __future__ import annotations

from collections import Counter
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import drop, heavy_keys, shuffle_width, spill

#: Length of a block of a sequence, as a multiple of the window: a block repeats the events of one window after it.
BLOCK_WINDOWS = 4
#: Persons with at least this share of the rows have their blocks spread over many tasks.
HOT_PERSON = 0.002
_PARTIALS = 1_000_000
_COUNTS = "a bigint, b bigint, person bigint, n bigint"


def sequences(events: DataFrame, window: float, hot: list[int]) -> DataFrame:
    """Sequences cut into blocks, one row each: person, hot, rows (of this person here), own, times, items.

    A block holds the events of ``BLOCK_WINDOWS`` windows, the first ``own`` of the row, and those up to one window
    later: every pattern that begins in a block lies in it. No row grows with the length of a sequence. The blocks of a
    hot person are spread by block, all others' are together.
    """
    length = window * BLOCK_WINDOWS
    block = F.floor(F.col("time") / length)
    blocks = F.when(F.col("time") - block * length < window, F.array(block, block - 1)).otherwise(F.array(block))
    rows, keys, salted = events.select("person_id", "time", "event_id", "place"), ["person_id"], F.lit(False)
    if hot:
        rows = rows.select("*", F.explode(F.when(F.col("person_id").isin(hot), blocks).otherwise(F.array(F.lit(None).cast("bigint")))).alias("salt"))
        keys, salted = ["person_id", "salt"], F.col("salt").isNotNull()
    rows = rows.repartition(shuffle_width(events.sparkSession), *keys)
    # blocks are laid out after the shuffle, so that what they repeat is not shuffled, but for hot persons
    rows = rows.select("*", block.alias("_home"), F.explode(F.when(salted, F.array("salt")).otherwise(blocks) if hot else blocks).alias("block"))
    steps = F.sort_array(F.collect_list(F.struct("time", "event_id", "place")))
    own = F.sum((F.col("block") == F.col("_home")).cast("int"))
    lists = rows.groupBy(*keys, "block").agg(steps.alias("steps"), own.alias("own")).where("own > 0")
    return lists.select(
        F.col("person_id").alias("person"), salted.alias("hot"), F.count(F.lit(1)).over(Window.partitionBy(*keys)).cast("int").alias("rows"),
        F.col("own").cast("int").alias("own"), F.col("steps.time").alias("times"), F.col("steps.place").alias("items"),
    )


def _flat(batch: pa.RecordBatch, name: str) -> tuple[np.ndarray, np.ndarray]:
    column = batch.column(batch.schema.get_field_index(name))
    return column.flatten().to_numpy(zero_copy_only=False), np.diff(column.offsets.to_numpy())


def _columns(batch: pa.RecordBatch) -> dict[str, np.ndarray]:
    return {n: batch.column(i).to_numpy(zero_copy_only=False) for i, n in enumerate(batch.schema.names) if n in ("person", "hot", "rows", "own")}


def _groups(c: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Number of the person of each row; each person's id; whether all its rows are in this batch."""
    persons, of = np.unique(c["person"], return_inverse=True)
    seen = np.bincount(of, minlength=len(persons))
    need, hot = np.zeros(len(persons), np.int64), np.zeros(len(persons), bool)
    need[of] = c["rows"]
    np.logical_or.at(hot, of, c["hot"].astype(bool))
    return of, persons, (seen == need) & ~hot


def window_pairs(items: np.ndarray, times: np.ndarray, row: np.ndarray, own: np.ndarray, window: float) -> tuple[np.ndarray, np.ndarray]:
    """Positions (i, j) of all ordered pairs of different items in a row that begin with an own event and lie within the window."""
    left, right = [], []
    at = np.flatnonzero(own)
    lag = 1
    while len(at):
        at = at[at + lag < len(row)]
        at = at[row[at + lag] == row[at]]
        at = at[times[at + lag] < times[at] + window]
        ok = at[items[at + lag] != items[at]]
        left.append(ok)
        right.append(ok + lag)
        lag += 1
    return (np.concatenate(left), np.concatenate(right)) if left else (np.zeros(0, np.int64),) * 2


def _count_short(window: float):
    """Persons with each item and each ordered pair in a window. Persons wholly in a batch are counted, of others the (pair, person) come out."""

    def run(batches):
        total: Counter = Counter()
        for batch in batches:
            c = _columns(batch)
            times, size = _flat(batch, "times")
            items, _ = _flat(batch, "items")
            of, persons, whole = _groups(c)
            row = np.repeat(np.arange(len(size)), size)
            own = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size) < c["own"][row]
            i, j = window_pairs(items, times, row, own, window)
            known, code = np.unique(items, return_inverse=True)
            base = len(known) + 1
            keys = np.unique(np.concatenate([(of[row[own]] * base + code[own]) * base + base - 1, (of[row[i]] * base + code[i]) * base + code[j], (np.arange(len(persons)) * base + base - 1) * base + base - 1]))
            who, a, b = keys // (base * base), keys // base % base, keys % base
            full = whole[who]
            pairs, n = np.unique(a[full] * base + b[full], return_counts=True)
            name = lambda x: None if x == base - 1 else int(known[x])
            for p, k in zip(pairs, n):
                total[name(p // base), name(p % base)] += int(k)
            part = [(name(x), name(y), int(persons[w])) for x, y, w in zip(a[~full], b[~full], who[~full])]
            if part:
                yield pa.RecordBatch.from_pydict({"a": pa.array([x[0] for x in part], pa.int64()), "b": pa.array([x[1] for x in part], pa.int64()), "person": pa.array([x[2] for x in part], pa.int64()), "n": pa.array([1] * len(part), pa.int64())})
            if len(total) > _PARTIALS:
                yield _counted(total)
                total.clear()
        yield _counted(total)

    return run


def _counted(total: Counter) -> pa.RecordBatch:
    keys = list(total)
    return pa.RecordBatch.from_pydict({"a": pa.array([k[0] for k in keys], pa.int64()), "b": pa.array([k[1] for k in keys], pa.int64()), "person": pa.array([None] * len(keys), pa.int64()), "n": pa.array([total[k] for k in keys], pa.int64())})


def _summed(counts: DataFrame, keys: list[str]) -> DataFrame:
    whole = counts.where("person is null").groupBy(*keys).agg(F.sum("n").alias("n"))
    part = counts.where("person is not null").select(*keys, "person").distinct().groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return whole.unionByName(part).groupBy(*keys).agg(F.sum("n").alias("persons"))


def relevant_parts(items: list[int], times: list[float], own: int, window: float, rank: dict[int, int], follow: set[tuple[int, int]], least: int):
    """For each pivot in a block its rewritten part: (pivot, own, items, times).

    The part keeps what can be in a frequent pattern whose least frequent item is the pivot: the pivot, and items of
    higher frequency that stand within one window of a pivot and make a frequent pair with it. Parts of
    fewer than ``least`` different items, or without an own event, are left out.
    """
    n = len(items)
    for pivot in {x for x in items if x in rank}:
        top, keep = rank[pivot], set()
        for i in (i for i in range(n) if items[i] == pivot):
            keep.add(i)
            j = i + 1
            while j < n and times[j] < times[i] + window:
                if rank.get(items[j], top) < top and (pivot, items[j]) in follow:
                    keep.add(j)
                j += 1
            j = i - 1
            while j >= 0 and times[i] < times[j] + window:
                if rank.get(items[j], top) < top and (items[j], pivot) in follow:
                    keep.add(j)
                j -= 1
        kept = sorted(keep)
        mine = sum(i < own for i in kept)
        if mine and len({items[i] for i in kept}) >= least:
            yield pivot, mine, [items[i] for i in kept], [times[i] for i in kept]


def mine_part(pivot: int, own: int, items: list[int], times: list[float], window: float, follow: set[tuple[int, int]], least: int, most: int) -> set[tuple[int, ...]]:
    """All patterns of ``least`` to ``most`` different items that begin at an own event, lie in the window, hold the pivot and consist of frequent pairs."""
    found: set[tuple[int, ...]] = set()
    n = len(items)
    for start in range(own):
        # every reachable (pattern, position of its last event), nearest position only: a later one reaches no more
        level = {(items[start],): start}
        for size in range(2, most + 1):
            longer: dict[tuple[int, ...], int] = {}
            for pattern, at in level.items():
                missing = pivot not in pattern
                for j in range(at + 1, n):
                    if times[j] >= times[start] + window:
                        break
                    x = items[j]
                    if x in pattern or (missing and size == most and x != pivot):
                        continue
                    grown = (*pattern, x)
                    if longer.get(grown, n) > j and all((y, x) in follow for y in pattern):
                        longer[grown] = j
            if size >= least:
                found.update(p for p in longer if pivot in p)
            level = longer
            if not level:
                break
    return found


def frequent_subsequences(events: DataFrame, share: float = 0.05, window: float = 21_600.0, least: int = 3, most: int = 5) -> DataFrame:
    """Ordered patterns of ``least`` to ``most`` different places that at least ``share`` of the persons have: pattern, persons.

    ``events`` has person_id, time, event_id and place without nulls. A person has a pattern if it visits its places in this
    order, other events in between allowed, the last less than ``window`` after the first; each person counts once.
    Events are ordered by time, then event_id; repeated rows change nothing. Empty input gives no rows.

    1. Items and ordered pairs are counted over all sequences; all pairs of a frequent pattern are frequent.
    2. Items are ordered by frequency. Each sequence's relevant rewritten part goes to the partitions of every frequent
       pivot in it; a pivot's partition is divided by person, so that a frequent pivot is no single task.
    3. Each partition mines only the patterns that hold its pivot and no less frequent item.

    The frequent pairs are broadcast: at most the square of the number of frequent places.
    """
    if least < 2:
        raise ValueError("patterns have two places or more")
    spark = events.sparkSession
    hot = heavy_keys(events.select("person_id"), ["person_id"], HOT_PERSON)["person_id"]
    cut = spill(sequences(events, window, hot))
    short = spill(_summed(cut.mapInArrow(_count_short(window), _COUNTS), ["a", "b"]))
    total = (short.where("a is null").agg(F.sum("persons")).first()[0]) or 0
    enough = F.col("persons") >= F.lit(Decimal(str(share))) * F.lit(total)
    items = [x.a for x in short.where("a is not null and b is null").where(enough).orderBy(F.desc("persons"), "a").select("a").collect()]
    rank = {x: i for i, x in enumerate(items)}
    follow = {(x.a, x.b) for x in short.where("a is not null and b is not null").where(enough).select("a", "b").collect()}
    drop(short)
    shared = spark.sparkContext.broadcast((rank, follow))

    def rewrite(batches):
        rank, follow = shared.value
        inside = np.array(sorted({x for pair in follow for x in pair}), np.int64)
        for batch in batches:
            c = _columns(batch)
            times, size = _flat(batch, "times")
            items, _ = _flat(batch, "items")
            begin = np.cumsum(size) - size
            useful = np.isin(items, inside)
            out: dict[str, list] = {n: [] for n in ("pivot", "person", "hot", "own", "times", "items")}
            counts = np.add.reduceat(useful, begin) if len(items) else np.zeros(0, int)
            for r in np.flatnonzero(counts >= least):
                at = begin[r] + np.flatnonzero(useful[begin[r] : begin[r] + size[r]])
                own = int((at < begin[r] + c["own"][r]).sum())
                for pivot, mine, some, when in relevant_parts(items[at].tolist(), times[at].tolist(), own, window, rank, follow, least):
                    for name, value in (("pivot", pivot), ("person", int(c["person"][r])), ("hot", bool(c["hot"][r])), ("own", mine), ("times", when), ("items", some)):
                        out[name].append(value)
            yield pa.RecordBatch.from_arrays([pa.array(out["pivot"], pa.int64()), pa.array(out["person"], pa.int64()), pa.array(out["hot"], pa.bool_()), pa.array(out["own"], pa.int32()), pa.array(out["times"], pa.list_(pa.float64())), pa.array(out["items"], pa.list_(pa.int64()))], names=list(out))

    def mine(batches):
        _, follow = shared.value
        total: Counter = Counter()
        now, got, is_hot = None, set(), False

        def close():
            if is_hot:
                return [(list(p), now[1], 1) for p in got]
            total.update(got)
            return []

        def batch_of(rows):
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.list_(pa.int64())), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.int64())], names=["places", "person", "n"])

        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                if (r["pivot"], r["person"]) != now:
                    rows += close()
                    now, got, is_hot = (r["pivot"], r["person"]), set(), r["hot"]
                got |= mine_part(r["pivot"], r["own"], r["items"], r["times"], window, follow, least, most)
            if len(total) > _PARTIALS:
                rows += [(list(p), None, n) for p, n in total.items()]
                total.clear()
            yield batch_of(rows)
        yield batch_of(close() + [(list(p), None, n) for p, n in total.items()])

    parts = cut.mapInArrow(rewrite, "pivot bigint, person bigint, hot boolean, own int, times array<double>, items array<bigint>")
    salt = F.when(F.col("hot"), F.pmod(F.xxhash64("times"), F.lit(shuffle_width(spark)))).otherwise(F.lit(-1).cast("bigint"))
    parts = parts.repartition("pivot", "person", salt).sortWithinPartitions("pivot", "person")
    counts = _summed(parts.mapInArrow(mine, "places array<bigint>, person bigint, n bigint"), ["places"])
    return counts.where(enough).select(F.array_join(F.col("places").cast("array<string>"), ">").alias("pattern"), "persons")
