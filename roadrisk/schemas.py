"""Schemas of the sources."""

from __future__ import annotations

from pyspark.sql import types as T

from roadrisk.config import ML_FEATURES

_INTEGER_FEATURES = {
    "over_speed_events", "harsh_braking_count", "harsh_acceleration_count", "phone_usage_events",
    "trip_frequency",
}


def _schema(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in columns.items()])


POINTS = _schema(
    timestamp=T.TimestampNTZType(),
    driver_id=T.StringType(),
    trip_id=T.StringType(),
    seq=T.LongType(),
    latitude=T.DoubleType(),
    longitude=T.DoubleType(),
    speed_mph=T.DoubleType(),
    acceleration_ms2=T.DoubleType(),
    speed_limit_mph=T.DoubleType(),
    road_type=T.StringType(),
    weather=T.StringType(),
    time_of_day=T.StringType(),
    harsh_braking=T.IntegerType(),
    harsh_acceleration=T.IntegerType(),
    phone_usage=T.IntegerType(),
    over_speed_limit=T.IntegerType(),
)

PLAIN_POINTS = T.StructType([f for f in POINTS.fields if f.name != "seq"])

EVENTS = _schema(
    event_id=T.LongType(),
    driver_id=T.StringType(),
    trip_id=T.StringType(),
    timestamp=T.TimestampNTZType(),
    latitude=T.DoubleType(),
    longitude=T.DoubleType(),
    speed_mph=T.DoubleType(),
    acceleration=T.DoubleType(),
    harsh_braking=T.BooleanType(),
    harsh_acceleration=T.BooleanType(),
    phone_usage=T.BooleanType(),
    weather_condition=T.StringType(),
    road_type=T.StringType(),
)

FEATURES = T.StructType(
    [T.StructField("driver_id", T.StringType())]
    + [
        T.StructField(name, T.LongType() if name in _INTEGER_FEATURES else T.DoubleType())
        for name in ML_FEATURES
    ]
)

PREMIUMS = _schema(
    driver_id=T.StringType(),
    base_premium=T.DoubleType(),
    risk_score=T.DoubleType(),
    risk_level=T.StringType(),
    risk_multiplier=T.DoubleType(),
    mileage_adjustment=T.DoubleType(),
    temporal_adjustment=T.DoubleType(),
    contextual_adjustment=T.DoubleType(),
    final_premium=T.DoubleType(),
    calculation_date=T.StringType(),
)

LATEST_RISK = _schema(
    driver_id=T.StringType(),
    trip_id=T.StringType(),
    timestamp=T.TimestampNTZType(),
    event_id=T.LongType(),
    risk_score=T.DoubleType(),
    risk_events=T.ArrayType(T.StringType()),
    immediate_alerts=T.ArrayType(T.StringType()),
)

REQUEST_COUNTS = _schema(window_start=T.TimestampNTZType(), client_id=T.LongType(), requests=T.LongType())
