"""The clean events of people x events x locations: the last loaded row of each event, with its place."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import drop, rows_of, spill, split_join


def places(locations: DataFrame) -> DataFrame:
    """The place of every location: the id at the end of its ``alias_of`` chain. A written table of location, place.

    Chains are followed by pointer doubling, in as many steps as the logarithm of the longest. A chain that is a ring,
    or leads to an id that is not there, has no place, and its locations are left out.
    """
    ends = locations.where("location is not null").groupBy("location").agg(F.min("alias_of").alias("next"))
    ends = spill(ends.select("location", F.coalesce("next", "location").alias("at"), F.col("next").isNull().alias("done")))
    for _ in range(rows_of(ends).bit_length()):  # twice the number of rows: whatever is not done then never ends
        if not ends.where("not done").limit(1).count():
            break
        onward = ends.select(F.col("location").alias("at"), F.col("at").alias("onward"), F.col("done").alias("end"))
        step = spill(split_join(ends, onward, ["at"]).select("location", F.col("onward").alias("at"), F.col("end").alias("done")))
        drop(ends)
        ends = step
    return ends.where("done").select("location", F.col("at").alias("place"))


def clean_events(events: DataFrame, locations: DataFrame) -> DataFrame:
    """For each ``event_id`` the row loaded last, if it has person, time and a place: person_id, time, event_id, place.

    Of rows of one event loaded at one time the largest (person, time, location) counts, nulls being smallest. Rows
    without ``event_id`` and times that are no number are left out. Extra columns are not read.
    """
    rows = events.where("event_id is not null").select("event_id", F.struct("loaded_at", "person_id", "time", "location").alias("row"))
    last = rows.groupBy("event_id").agg(F.max("row").alias("row")).select("event_id", "row.person_id", "row.time", "row.location")
    last = last.where("person_id is not null and time is not null and not isnan(time) and location is not null")
    return split_join(last, places(locations), ["location"]).select("person_id", "time", "event_id", "place")
