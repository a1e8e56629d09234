"""Lookups with a time to live.

The first lookup of a place is fetched and answers the place's lookups for ``ttl_hours``; the first lookup after that is fetched
again, and so on. Which lookups are fetched thus depends on the whole history of a place. The chain is found by pointer jumping:
each moment points to the first one that it does not answer, and each round doubles the distance of all pointers and the
length of the known chain. Rows are dealt by place and moment, so that a busy place is spread over tasks; there are
as many rounds as the longest chain has binary digits.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from roadrisk.functions import clock
from roadrisk.operators.sequence import as_of_tables
from roadrisk.sources.scratch import cut_lineage

TTL_HOURS = 24
MIRROR = "2000-01-01 00:00:00"  # where time is turned round


def _mirrored(time: str):
    return clock.ntz(MIRROR) + (clock.ntz(MIRROR) - F.col(time))


def fetched(lookups: DataFrame, place: Sequence[str], time: str, lookup_id: str, ttl_hours: int = TTL_HOURS) -> DataFrame:
    """The lookups that are not answered by an earlier one: place, time and the smallest id of that moment."""
    moments = lookups.dropna(subset=[*place, time]).groupBy(*place, F.col(time).alias("_time")).agg(F.min(lookup_id).alias("_id"))
    moments = cut_lineage(moments)
    later = moments.select(*place, _mirrored("_time").alias("_then"), F.col("_time").alias("_to"))
    asked = moments.withColumn("_until", F.col("_time") + F.expr(f"INTERVAL {ttl_hours} HOURS")).withColumn("_then", _mirrored("_until"))
    pointers = as_of_tables(asked, place, "_then", {"next": (later, "_then", "_to")})
    pointers = cut_lineage(pointers.select(*place, "_time", F.col("next._to").alias("_to")).dropna(subset=["_to"]))
    chain = moments.groupBy(*place).agg(F.min("_time").alias("_time"))
    while True:
        onward = chain.join(pointers, [*place, "_time"]).select(*place, F.col("_to").alias("_time"))
        longer = cut_lineage(chain.unionByName(onward).distinct())
        if longer.count() == chain.count():
            break
        chain = longer
        second = pointers.select(*place, F.col("_to").alias("_end"), F.col("_time").alias("_to"))
        doubled = pointers.join(second, [*place, "_to"])
        pointers = cut_lineage(doubled.select(*place, "_time", F.col("_end").alias("_to")))
    return chain.join(moments, [*place, "_time"]).withColumnsRenamed({"_time": time, "_id": lookup_id})


def answered(lookups: DataFrame, place: Sequence[str], time: str, lookup_id: str, ttl_hours: int = TTL_HOURS) -> DataFrame:
    """Add ``answered_by`` and ``answered_at``: the fetched lookup whose answer each lookup gets, itself where it is fetched.
    A lookup without a place or time is fetched for itself."""
    sources = fetched(lookups, place, time, lookup_id, ttl_hours).withColumnsRenamed({time: "_time", lookup_id: "_id"})
    found = as_of_tables(lookups, place, time, {"_source": (sources, "_time", "_id")})
    return found.select(
        *lookups.columns,
        F.when(F.col("_source").isNull(), F.col(lookup_id)).otherwise(F.col("_source._id")).alias("answered_by"),
        F.when(F.col("_source").isNull(), F.col(time)).otherwise(F.col("_source._time")).alias("answered_at"),
    )
