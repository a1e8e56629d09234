"""Trip features from points and driver features from trips."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from roadrisk.config import (
    ML_FEATURES,
    ROAD_WEIGHTS,
    SLOT_SECONDS,
    TRIP_RULES,
    WEATHER_WEIGHTS,
    TripRules,
)
from roadrisk.functions import clock
from roadrisk.functions.geo import TRIP_EARTH_RADIUS, haversine_miles
from roadrisk.functions.scores import lookup
from roadrisk.operators import cleaning
from roadrisk.operators.sequence import SLOT, slot_window, time_slot, with_previous

TRIP_KEY = ("driver_id", "trip_id")


def step_distances(points: DataFrame, slot_seconds: int = SLOT_SECONDS) -> DataFrame:
    """Previous point and step length of every point; null at the first point of a trip."""
    stepped = with_previous(
        points, TRIP_KEY, "timestamp", cleaning.point_ties(points), ("latitude", "longitude"), slot_seconds
    )
    return stepped.withColumn(
        "step_miles",
        haversine_miles(
            F.col("prev_latitude"), F.col("prev_longitude"), F.col("latitude"), F.col("longitude")
        ),
    )


def _path(
    points: DataFrame, key: Sequence[str], ties: Sequence[str], radius: float, slot_seconds: int
) -> tuple[DataFrame, Column]:
    """Points with their step inside the slot, and the aggregate that gives the whole path length.

    Steps inside a slot are summed directly. The first and last point of every slot are gathered per
    trip (two entries per slot, bounded by the trip's time span) for the steps between slots. This
    keeps it at one full shuffle, with no window over a whole trip and no join.
    """
    order = slot_window(key, "timestamp", ties)
    here = F.struct(F.col("latitude").alias("lat"), F.col("longitude").alias("lon"))
    stepped = (
        points.withColumn(SLOT, time_slot("timestamp", slot_seconds))
        .withColumn("_before", F.lag(here).over(order))
        .withColumn("_is_last", F.lead(F.lit(1)).over(order).isNull())
        .withColumn(
            "_step",
            haversine_miles(
                F.col("_before.lat"), F.col("_before.lon"), F.col("latitude"), F.col("longitude"), radius
            ),
        )
        .withColumn(
            "_edge",
            F.when(
                F.col("_before").isNull() | F.col("_is_last"),
                F.struct(
                    F.col(SLOT).alias("slot"),
                    F.col("_before").isNotNull().alias("inside"),
                    F.col("latitude").alias("lat"),
                    F.col("longitude").alias("lon"),
                ),
            ),
        )
    )
    edges = F.sort_array(F.collect_list("_edge"))
    between = F.aggregate(
        edges,
        F.struct(
            F.lit(0.0).alias("miles"),
            F.lit(None).cast("double").alias("lat"),
            F.lit(None).cast("double").alias("lon"),
        ),
        lambda so_far, edge: F.struct(
            (
                so_far["miles"]
                + F.when(
                    ~edge["inside"] & so_far["lat"].isNotNull(),
                    haversine_miles(so_far["lat"], so_far["lon"], edge["lat"], edge["lon"], radius),
                ).otherwise(0.0)
            ).alias("miles"),
            edge["lat"].alias("lat"),
            edge["lon"].alias("lon"),
        ),
        lambda done: done["miles"],
    )
    return stepped, F.coalesce(F.sum("_step"), F.lit(0.0)) + between


def trip_durations(points: DataFrame) -> DataFrame:
    return (
        points.groupBy(*TRIP_KEY)
        .agg(F.min("timestamp").alias("start_time"), F.max("timestamp").alias("end_time"))
        .withColumn("duration_minutes", clock.minutes_between(F.col("end_time"), F.col("start_time")))
    )


def trip_distances(
    points: DataFrame, radius: float = TRIP_EARTH_RADIUS, slot_seconds: int = SLOT_SECONDS
) -> DataFrame:
    stepped, miles = _path(points, TRIP_KEY, cleaning.point_ties(points), radius, slot_seconds)
    return stepped.groupBy(*TRIP_KEY).agg(miles.alias("distance_miles"))


def trip_modes(points: DataFrame) -> DataFrame:
    """Most frequent category values; the smallest on ties, nulls ignored."""
    return points.groupBy(*TRIP_KEY).agg(
        F.mode("weather", True).alias("weather_condition"),
        F.mode("road_type", True).alias("road_type"),
        F.mode("time_of_day", True).alias("time_of_day"),
    )


def trip_features(
    points: DataFrame,
    group: Sequence[str] = (),
    rules: TripRules = TRIP_RULES,
    slot_seconds: int = SLOT_SECONDS,
) -> DataFrame:
    """One row of features per trip of valid points; trips that are too short are left out.

    ``group`` adds columns to the key, such as an upload or a bucket number.
    """
    key = [*group, *TRIP_KEY]
    stepped, miles = _path(points, key, cleaning.point_ties(points), TRIP_EARTH_RADIUS, slot_seconds)

    def events(flag: Column) -> Column:
        return F.sum(flag.cast("long"))

    def share(flag: Column) -> Column:
        return F.avg(flag.cast("double"))

    minutes = clock.minutes_between(F.col("end_time"), F.col("start_time"))
    return (
        stepped.groupBy(*key)
        .agg(
            F.min("timestamp").alias("start_time"),
            F.max("timestamp").alias("end_time"),
            miles.alias("distance_miles"),
            F.avg("speed_mph").alias("avg_speed"),
            F.max("speed_mph").alias("max_speed"),
            F.var_samp("speed_mph").alias("speed_variance"),
            events(cleaning.overspeed(rules)).alias("over_speed_events"),
            share(cleaning.overspeed(rules)).alias("over_speed_ratio"),
            events(cleaning.harsh_braking(rules)).alias("harsh_braking_count"),
            events(cleaning.harsh_acceleration(rules)).alias("harsh_acceleration_count"),
            F.avg("acceleration_ms2").alias("avg_acceleration"),
            F.min("acceleration_ms2").alias("max_deceleration"),
            F.mode("weather", True).alias("weather_condition"),
            F.mode("road_type", True).alias("road_type"),
            F.mode("time_of_day", True).alias("time_of_day"),
            F.coalesce(F.sum("phone_usage"), F.lit(0)).cast("long").alias("phone_usage_events"),
            F.avg("phone_usage").alias("phone_usage_ratio"),
        )
        .withColumn("duration_minutes", minutes)
        .filter(F.col("duration_minutes") >= rules.min_trip_minutes)
        .withColumn("is_night", clock.is_night(F.col("start_time"), rules))
        .withColumn("is_weekend", clock.is_weekend(F.col("start_time")))
        .withColumn("is_rush_hour", clock.is_rush_hour(F.col("start_time"), rules))
        .withColumn("is_long_trip", F.col("duration_minutes") > rules.long_trip_minutes)
    )


def driver_features(trips: DataFrame, group: Sequence[str] = ()) -> DataFrame:
    """One row per driver; ratios and averages are means over trips, not over points."""

    def share(name: str) -> Column:
        return F.avg(F.col(name).cast("double"))

    def mean_weight(name: str, weights: dict[str, float]) -> Column:
        # summed as decimals, so the result does not depend on the order of the rows
        exact = lookup(F.col(name), weights, 1.0).cast("decimal(12,6)")
        return F.sum(exact).cast("double") / F.count("*")

    return trips.groupBy(*group, "driver_id").agg(
        F.min("start_time").alias("period_start"),
        F.max("end_time").alias("period_end"),
        F.sum("distance_miles").alias("total_mileage"),
        F.avg("distance_miles").alias("avg_trip_distance"),
        F.avg("avg_speed").alias("avg_speed"),
        F.max("max_speed").alias("max_speed"),
        F.avg("speed_variance").alias("speed_variance"),
        F.sum("over_speed_events").alias("over_speed_events"),
        F.avg("over_speed_ratio").alias("over_speed_ratio"),
        F.sum("harsh_braking_count").alias("harsh_braking_count"),
        F.sum("harsh_acceleration_count").alias("harsh_acceleration_count"),
        F.avg("avg_acceleration").alias("avg_acceleration"),
        F.min("max_deceleration").alias("max_deceleration"),
        share("is_night").alias("night_driving_ratio"),
        share("is_weekend").alias("weekend_driving_ratio"),
        share("is_rush_hour").alias("rush_hour_ratio"),
        mean_weight("weather_condition", WEATHER_WEIGHTS).alias("weather_risk_score"),
        mean_weight("road_type", ROAD_WEIGHTS).alias("road_type_risk_score"),
        F.sum("phone_usage_events").alias("phone_usage_events"),
        F.avg("phone_usage_ratio").alias("phone_usage_ratio"),
        F.count("*").alias("trip_frequency"),
        F.avg("duration_minutes").alias("avg_trip_duration"),
        share("is_long_trip").alias("long_trip_ratio"),
    )


def features_of_all_drivers(
    raw: DataFrame,
    group: Sequence[str] = (),
    rules: TripRules = TRIP_RULES,
    slot_seconds: int = SLOT_SECONDS,
) -> DataFrame:
    """Raw points to driver features: one shuffle of points, then trip rows, then driver rows."""
    points = cleaning.valid_points(raw, rules)
    return driver_features(trip_features(points, group, rules, slot_seconds), group)


def feature_table(features: DataFrame) -> DataFrame:
    """The driver key and the 21 model columns."""
    return features.select("driver_id", *ML_FEATURES)


def failed_drivers(raw: DataFrame, features: DataFrame, rules: TripRules = TRIP_RULES) -> DataFrame:
    """Drivers of the raw points that got no features, with the reason."""
    valid = (
        F.col("latitude").between(-90, 90)
        & F.col("longitude").between(-180, 180)
        & F.col("speed_mph").between(0, rules.max_speed_mph)
        & F.col("trip_id").isNotNull()
    )
    seen = raw.groupBy("driver_id").agg(
        F.count("*").alias("raw_points"), F.count(F.when(valid, 1)).alias("valid_points")
    )
    reason = F.when(F.col("valid_points") == 0, "no valid points").otherwise("no trip long enough")
    return (
        seen.join(features.select("driver_id"), "driver_id", "left_anti")
        .withColumn("reason", reason)
    )


def unknown_drivers(asked: DataFrame, raw: DataFrame) -> DataFrame:
    """Asked-for drivers without any point."""
    return asked.join(raw.select("driver_id").distinct(), "driver_id", "left_anti").withColumn(
        "reason", F.lit("no data found")
    )


def driver_summary(points: DataFrame, start: str | None = None, end: str | None = None) -> DataFrame:
    """Summary of the driver view: sums of the raw flags and a rough distance of 0.01 per point."""
    return (
        cleaning.in_date_range(points, start, end)
        .groupBy("driver_id")
        .agg(
            F.count_distinct("trip_id").alias("total_trips"),
            (F.count(F.when(F.col("trip_id").isNotNull(), F.col("speed_mph"))) * 0.01).alias("total_distance"),
            F.avg("speed_mph").alias("avg_speed"),
            F.max("speed_mph").alias("max_speed"),
            F.sum("harsh_braking").alias("harsh_braking_events"),
            F.sum("harsh_acceleration").alias("harsh_acceleration_events"),
            F.sum("phone_usage").alias("phone_usage_events"),
            F.struct(F.min("timestamp").alias("start"), F.max("timestamp").alias("end")).alias("date_range"),
            F.count("*").alias("records_count"),
        )
    )


def dataset_profile(points: DataFrame) -> DataFrame:
    """One row describing a point table.

    Distinct counts come from a group per (driver, trip), so only one pre-aggregated shuffle is needed.
    """
    pairs = points.groupBy(*TRIP_KEY).agg(
        F.count("*").alias("points"),
        F.sum("speed_mph").alias("speed_sum"),
        F.count("speed_mph").alias("speed_count"),
        F.sum("harsh_braking").alias("harsh_braking"),
        F.sum("harsh_acceleration").alias("harsh_acceleration"),
        F.sum("phone_usage").alias("phone_usage"),
        F.min("timestamp").alias("first_time"),
        F.max("timestamp").alias("last_time"),
    )
    return pairs.agg(
        F.coalesce(F.sum("points"), F.lit(0)).alias("total_records"),
        F.count_distinct("trip_id").alias("total_trips"),
        F.count_distinct("driver_id").alias("unique_drivers"),
        (F.sum("speed_sum") / F.nullif(F.sum("speed_count"), F.lit(0))).alias("average_speed"),
        F.sum("harsh_braking").alias("harsh_braking_events"),
        F.sum("harsh_acceleration").alias("harsh_acceleration_events"),
        F.sum("phone_usage").alias("phone_usage_events"),
        F.min("first_time").alias("data_start"),
        F.max("last_time").alias("data_end"),
    )


def category_weights(trips: DataFrame) -> DataFrame:
    """Weather and road weight of every trip; unknown and null categories weigh 1."""
    return trips.withColumn(
        "weather_weight", lookup(F.col("weather_condition"), WEATHER_WEIGHTS, 1.0)
    ).withColumn("road_weight", lookup(F.col("road_type"), ROAD_WEIGHTS, 1.0))
