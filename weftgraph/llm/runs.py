"""Repeated consecutive events: runs found by a regex over symbol strings."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import shuffle_width, spill

_RUN = re.compile(r"([^\x00])\1*", re.S)
_FIRST_SYMBOL, _SURROGATES = 0x20, (0xD800, 0x800)
_SCHEMA = "person_id bigint, place bigint, first_event_id bigint, last_event_id bigint, startTime double, endTime double, events bigint, opens boolean, closes boolean"


def symbol_string(codes: np.ndarray, breaks: np.ndarray) -> tuple[str, np.ndarray]:
    """Events as one string: a code point for each code, a NUL before each break. Also each symbol's event number.

    Codes are dense within a batch, so they fit in the code points that are no surrogates.
    """
    points = codes.astype(np.uint32) + _FIRST_SYMBOL
    points[points >= _SURROGATES[0]] += _SURROGATES[1]
    at = np.arange(len(codes)) + np.cumsum(breaks)
    text = np.zeros(len(codes) + int(breaks.sum()), np.uint32)
    text[at] = points
    owner = np.zeros(len(text), np.int64)
    owner[at] = np.arange(len(codes))
    return text.tobytes().decode("utf-32-le"), owner


def _batch_runs(pdf: pd.DataFrame) -> pd.DataFrame:
    person, place = pdf["person_id"].to_numpy(), pdf["place"].to_numpy()
    breaks = np.zeros(len(pdf), bool)
    breaks[1:] = person[1:] != person[:-1]
    text, owner = symbol_string(pd.factorize(place)[0], breaks)
    spans = np.array([m.span() for m in _RUN.finditer(text)], np.int64).reshape(-1, 2)
    first, last = owner[spans[:, 0]], owner[spans[:, 1] - 1]
    ids, time = pdf["event_id"].to_numpy(), pdf["time"].to_numpy()
    return pd.DataFrame({
        "person_id": person[first], "place": place[first], "first_event_id": ids[first], "last_event_id": ids[last],
        "startTime": time[first], "endTime": time[last], "events": last - first + 1,
    })


def _partition_runs(min_events: int):
    def run(batches):
        held, fresh = None, True

        def out(runs: pd.DataFrame, last: bool):
            nonlocal fresh
            runs = runs.assign(opens=False, closes=False)
            if fresh and len(runs):
                runs.iloc[0, runs.columns.get_loc("opens")] = True
                fresh = False
            if last:
                runs.iloc[-1, runs.columns.get_loc("closes")] = True
            return runs[(runs["events"] >= min_events) | runs["opens"] | runs["closes"]]

        for pdf in batches:
            if not len(pdf):
                continue
            runs = _batch_runs(pdf)
            if held is not None:
                if held["person_id"].iloc[0] == runs["person_id"].iloc[0] and held["place"].iloc[0] == runs["place"].iloc[0]:
                    for c in ("first_event_id", "startTime"):
                        runs.loc[0, c] = held[c].iloc[0]
                    runs.loc[0, "events"] += held["events"].iloc[0]
                else:
                    runs = pd.concat([held, runs], ignore_index=True)
            held = runs.iloc[-1:].reset_index(drop=True)
            yield out(runs.iloc[:-1], False)
        if held is not None:
            yield out(held, True)

    return run


def collapse_runs(events: DataFrame, min_events: int = 1) -> DataFrame:
    """Collapse each longest run of consecutive events of a person at one place into one span.

    ``events`` has person_id, time, event_id and place without nulls; they are ordered by time, then event_id, repeated
    rows counting as events of their own. Returns person_id, place, first_event_id, last_event_id, startTime, endTime,
    events (their number) and duration, for runs of at least ``min_events``. Empty input gives no rows.

    Events are range-partitioned by (person, time, event), so that a person with many events is spread over many
    tasks. Within a partition, batches become symbol strings whose runs a backreference regex matches; the first and
    the last run of each partition, two rows a partition, are then stitched to their neighbours.
    """
    width = shuffle_width(events.sparkSession)
    ordered = events.select("person_id", "time", "event_id", "place").repartitionByRange(width, "person_id", "time", "event_id").sortWithinPartitions("person_id", "time", "event_id")
    runs = spill(ordered.mapInPandas(_partition_runs(min_events), _SCHEMA))
    inner = runs.where("not opens and not closes")
    over = Window.partitionBy("person_id").orderBy("startTime", "first_event_id", "last_event_id")
    joined = F.lag("closes").over(over) & F.col("opens") & (F.lag("place").over(over) == F.col("place"))
    edge = runs.where("opens or closes").withColumn("_new", F.when(F.coalesce(joined, F.lit(False)), 0).otherwise(1))
    edge = edge.withColumn("_run", F.sum("_new").over(over)).groupBy("person_id", "place", "_run").agg(
        F.min_by("first_event_id", F.struct("startTime", "first_event_id")).alias("first_event_id"),
        F.max_by("last_event_id", F.struct("endTime", "last_event_id")).alias("last_event_id"),
        F.min("startTime").alias("startTime"), F.max("endTime").alias("endTime"), F.sum("events").alias("events"),
    )
    both = inner.drop("opens", "closes").unionByName(edge.drop("_run"))
    return both.where(F.col("events") >= min_events).withColumn("duration", F.col("endTime") - F.col("startTime"))
