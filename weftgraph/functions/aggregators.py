"""Aggregators: one registry for attribute aggregation over any grouping.

Undefined values are skipped, and a group without defined values is undefined. Undefined keys make a group of their own. Where ties are possible the
result is fixed: most_common and its kin take the larger value, first takes the smallest.

vector, set and concatenate give all values of a group in one row, so a group must fit in a task there; so must the different values of a group for median.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_DIRECT: dict[str, Callable[[Column], Column]] = {
    "count": lambda x: F.nullif(F.count(x), F.lit(0)).cast("double"),
    "sum": F.sum,
    "max": F.max,
    "min": F.min,
    "average": F.avg,
    "first": F.min,
    "vector": lambda x: F.array_sort(F.collect_list(x)),
    "set": lambda x: F.array_sort(F.collect_set(x)),
    "std_deviation": lambda x: F.when(F.count(x) > 0, F.coalesce(F.stddev_samp(x), F.lit(0.0))),
    "concatenate": lambda x: F.flatten(F.collect_list(x)),
}
#: Over the different values x of a group and how often each occurs; an undefined value occurs 0 times.
_COUNTED: dict[str, Callable[[Column, Column], Column]] = {
    "median": lambda x, n: F.percentile(x, F.lit(0.5), n),
    "most_common": lambda x, n: F.max_by(x, F.struct(n, x)),
    "count_most_common": lambda x, n: F.nullif(F.max(n), F.lit(0)).cast("double"),
    "count_distinct": lambda x, n: F.nullif(F.count(x), F.lit(0)).cast("double"),
    "majority_50": lambda x, n: F.when(F.max(n) == 0, None).when(F.max(n) >= 0.5 * F.sum(n), F.max_by(x, F.struct(n, x))).otherwise(F.lit("")),
    "majority_100": lambda x, n: F.when(F.max(n) == 0, None).when(F.max(n) >= F.sum(n), F.max_by(x, F.struct(n, x))).otherwise(F.lit("")),
}
_WEIGHTED: dict[str, Callable[[Column, Column], Column]] = {
    "weighted_sum": lambda x, w: F.sum(x * w),
    "weighted_average": lambda x, w: F.try_divide(F.sum(x * w), F.sum(F.when(x.isNotNull(), w))),
    "by_max_weight": lambda x, w: F.max_by(x, F.when(x.isNotNull() & w.isNotNull(), F.struct(w, x))),
    "by_min_weight": lambda x, w: F.min_by(x, F.when(x.isNotNull() & w.isNotNull(), F.struct(w, x))),
}
_ELEMENTWISE = {f"elementwise_{n}": n for n in ("average", "min", "max", "sum", "std_deviation")}
NAMES = sorted([*_DIRECT, *_COUNTED, *_WEIGHTED, *_ELEMENTWISE])


def output_name(attribute: str, aggregator: str, prefix: str = "", suffix: bool = True, weight: str | None = None) -> str:
    name = f"{prefix}_{attribute}" if prefix else attribute
    if suffix:
        name += f"_{aggregator}" + (f"_by_{weight}" if weight else "")
    return name


def aggregate(df: DataFrame, keys: Sequence[str], specs: Sequence[tuple[str, str]], weight: str | None = None, prefix: str = "", suffix: bool = True, also: Sequence[Column] = ()) -> DataFrame:
    """Aggregate ``specs``, pairs of (attribute, aggregator), within groups of ``keys`` (none: over all rows). ``also`` are further aggregate columns.

    Value frequencies are counted once an attribute, by (keys, value), before they meet in a group, so neither hot groups nor hot values
    are held up in one task; sums, extremes and moments are combined before the shuffle. The groups with an element of ``keys`` and no
    defined value come out with nulls. Frames of several kinds meet by a last grouping and not by a join, so that null keys stay one group.
    """
    keys, frames, direct = list(keys), [], list(also)
    counted: dict[str, list[Column]] = {}
    vectors: dict[str, dict[str, str]] = {}
    order = []
    for attribute, name in specs:
        out = output_name(attribute, name, prefix, suffix, weight)
        order.append(out)
        x = F.col(attribute)
        if name in _DIRECT:
            direct.append(_DIRECT[name](x).alias(out))
        elif name in _WEIGHTED:
            if weight is None:
                raise ValueError(f"{name} needs a weight")
            direct.append(_WEIGHTED[name](x, F.col(weight)).alias(out))
        elif name in _COUNTED:
            counted.setdefault(attribute, []).append(_COUNTED[name](x, F.col("_n")).alias(out))
        elif name in _ELEMENTWISE:
            vectors.setdefault(attribute, {})[out] = _ELEMENTWISE[name]
        else:
            raise ValueError(f"no aggregator {name!r}; there are {NAMES}")
    if direct:
        frames.append(df.groupBy(*keys).agg(*direct))
    for attribute, columns in counted.items():
        frames.append(df.groupBy(*keys, attribute).agg(F.count(attribute).alias("_n")).groupBy(*keys).agg(*columns))
    for attribute, columns in vectors.items():
        each = df.select(*keys, F.posexplode_outer(attribute).alias("_at", "_x")).groupBy(*keys, "_at").agg(*(_DIRECT[kind](F.col("_x")).alias(out) for out, kind in columns.items()))
        rows = F.array_sort(F.collect_list(F.when(F.col("_at").isNotNull(), F.struct("_at", *columns))))
        frames.append(each.groupBy(*keys).agg(rows.alias("_rows")).select(*keys, *(F.when(F.size("_rows") > 0, F.col("_rows").getField(out)).alias(out) for out in columns)))
    if len(frames) == 1:
        return frames[0]
    if not frames:
        return df.select(*keys).distinct()
    every = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
    names = [c for c in frames[0].columns if c not in keys and c not in order] + list(dict.fromkeys(order))
    return every.groupBy(*keys).agg(*(F.first(c, ignorenulls=True).alias(c) for c in names))
