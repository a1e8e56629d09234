"""Time arithmetic and calendar flags that do not depend on the session time zone."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from roadrisk.config import TRIP_RULES, TripRules

SECONDS_PER_DAY = 86_400


def ntz(text: str) -> Column:
    """A zone-free timestamp constant."""
    return F.lit(text).cast("timestamp_ntz")


def seconds_between(later: Column, earlier: Column) -> Column:
    """Elapsed seconds, with the fraction."""
    return (later - earlier).cast("interval second").cast("decimal(18,6)").cast("double")


def epoch_seconds(time: Column) -> Column:
    """Whole seconds since 1970."""
    return (time - ntz("1970-01-01 00:00:00")).cast("interval second").cast("bigint")


def epoch_micros(time: Column) -> Column:
    """Microseconds since 1970."""
    seconds = (time - ntz("1970-01-01 00:00:00")).cast("interval second").cast("decimal(18,6)")
    return (seconds * 1_000_000).cast("bigint")


def elapsed_whole_days(later: Column, earlier: Column) -> Column:
    """Complete 24-hour periods, rounded down also when negative."""
    return F.floor(seconds_between(later, earlier) / SECONDS_PER_DAY)


def minutes_between(later: Column, earlier: Column) -> Column:
    return seconds_between(later, earlier) / 60.0


def is_night(time: Column, rules: TripRules = TRIP_RULES) -> Column:
    begin, end = rules.night_hours
    hour = F.hour(time)
    if begin > end:
        return (hour >= begin) | (hour < end)
    return (hour >= begin) & (hour < end)


def is_weekend(time: Column) -> Column:
    return F.weekday(time) >= 5


def is_rush_hour(time: Column, rules: TripRules = TRIP_RULES) -> Column:
    """Half-open rush ranges, as used for trips."""
    hour = F.hour(time)
    flag = F.lit(False)
    for begin, end in rules.rush_hours:
        flag = flag | ((hour >= begin) & (hour < end))
    return flag


def is_context_rush_hour(time: Column) -> Column:
    """Closed rush ranges, as used for congestion: hours 9 and 19 count."""
    hour = F.hour(time)
    return hour.between(7, 9) | hour.between(17, 19)


def date_parts(time: Column) -> dict[str, Column]:
    """Text partition values of a date."""
    return {
        "year": F.date_format(time, "yyyy"),
        "month": F.date_format(time, "MM"),
        "day": F.date_format(time, "dd"),
    }
