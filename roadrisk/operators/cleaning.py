"""Parsing, validity filters and flags of raw points."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from roadrisk.config import TRIP_RULES, TripRules
from roadrisk.functions import clock
from roadrisk.operators.sequence import with_previous

MPH_TO_MS = 0.44704


def point_ties(points: DataFrame) -> tuple[str, ...]:
    """Columns that order points of the same time, as far as the table has them."""
    return tuple(name for name in ("seq",) if name in points.columns)


def parse_timestamps(df: DataFrame, column: str = "timestamp") -> DataFrame:
    """Text times become zone-free timestamps; other types are left alone."""
    if df.schema[column].dataType.typeName() != "string":
        return df
    return df.withColumn(column, F.to_timestamp_ntz(F.col(column)))


def valid_gps(df: DataFrame) -> DataFrame:
    return df.filter(F.col("latitude").between(-90, 90) & F.col("longitude").between(-180, 180))


def valid_speed(df: DataFrame, rules: TripRules = TRIP_RULES) -> DataFrame:
    return df.filter(F.col("speed_mph").between(0, rules.max_speed_mph))


def valid_points(df: DataFrame, rules: TripRules = TRIP_RULES) -> DataFrame:
    """Row filters of cleaning; the trip-length filter follows in ``valid_trips`` or after the trip
    aggregation, where it needs no second pass over the points."""
    parsed = parse_timestamps(df)
    return valid_speed(valid_gps(parsed), rules).filter(
        F.col("trip_id").isNotNull() & F.col("driver_id").isNotNull()
    )


def valid_trips(points: DataFrame, rules: TripRules = TRIP_RULES) -> DataFrame:
    """Points of trips that last long enough.

    The trip side is pre-aggregated; a trip with very many points is split by the adaptive
    skew join because only the semi join, not a window, touches the points.
    """
    length = clock.minutes_between(F.max("timestamp"), F.min("timestamp"))
    lasting = (
        points.groupBy("driver_id", "trip_id")
        .agg(length.alias("minutes"))
        .filter(F.col("minutes") >= rules.min_trip_minutes)
    )
    return points.join(lasting, ["driver_id", "trip_id"], "left_semi")


def clean(df: DataFrame, rules: TripRules = TRIP_RULES) -> DataFrame:
    """Whole cleaning step: parse, position, speed, trip length."""
    return valid_trips(valid_points(df, rules), rules)


def sort_points(df: DataFrame) -> DataFrame:
    """Output order; the tie-break column also lets the range sort cut a busy driver."""
    return df.orderBy("driver_id", "timestamp", *point_ties(df))


def of_driver(df: DataFrame, driver_id: str) -> DataFrame:
    return df.filter(F.col("driver_id") == driver_id)


def of_driver_or_fail(df: DataFrame, driver_id: str) -> DataFrame:
    """Rows of one driver; raises when there is none (runs a one-row probe)."""
    rows = of_driver(df, driver_id)
    if rows.isEmpty():
        raise ValueError(f"No data found for driver {driver_id}")
    return rows


def in_date_range(
    df: DataFrame, start: str | None = None, end: str | None = None, column: str = "timestamp"
) -> DataFrame:
    """Closed bounds; a bound without a time of day means midnight."""
    if start is not None:
        df = df.filter(F.col(column) >= clock.ntz(start))
    if end is not None:
        df = df.filter(F.col(column) <= clock.ntz(end))
    return df


def _flag(condition: Column) -> Column:
    """A comparison with a missing value is false."""
    return F.coalesce(condition, F.lit(False))


def overspeed(rules: TripRules = TRIP_RULES) -> Column:
    return _flag(F.col("speed_mph") > F.col("speed_limit_mph") + rules.speed_tolerance_mph)


def overspeed_raw() -> Column:
    return _flag(F.col("speed_mph") > F.col("speed_limit_mph"))


def harsh_braking(rules: TripRules = TRIP_RULES) -> Column:
    return _flag(F.col("acceleration_ms2") < rules.harsh_braking_ms2)


def harsh_acceleration(rules: TripRules = TRIP_RULES) -> Column:
    return _flag(F.col("acceleration_ms2") > rules.harsh_acceleration_ms2)


def with_acceleration(points: DataFrame, per_second: bool = False) -> DataFrame:
    """Acceleration from successive speeds of a trip, 0 for its first point.

    By default points are taken as one second apart; ``per_second`` divides by the elapsed time.
    """
    stepped = with_previous(
        points, ("driver_id", "trip_id"), "timestamp", point_ties(points), ("speed_mph", "timestamp")
    )
    change = (F.col("speed_mph") - F.col("prev_speed_mph")) * MPH_TO_MS
    if per_second:
        elapsed = clock.seconds_between(F.col("timestamp"), F.col("prev_timestamp"))
        change = change / F.nullif(elapsed, F.lit(0.0))
    first = F.col("prev_timestamp").isNull()
    return stepped.withColumn("computed_acceleration", F.when(first, 0.0).otherwise(change)).drop(
        "prev_speed_mph", "prev_timestamp"
    )
