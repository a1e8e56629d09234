"""Queries on points, trips and drivers."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from roadrisk.config import ML_FEATURES, TRIP_RULES
from roadrisk.functions import clock
from roadrisk.functions.geo import haversine_miles
from roadrisk.operators import cleaning, feeds, trips
from roadrisk.plans.registry import query, shared


def miles(lat1: str, lon1: str, lat2: str, lon2: str, radius: str = "3959.0E0") -> str:
    """Haversine text for the reference SQL."""
    a = (
        f"pow(sin(radians({lat2} - {lat1}) / 2), 2) + cos(radians({lat1})) * cos(radians({lat2}))"
        f" * pow(sin(radians({lon2} - {lon1}) / 2), 2)"
    )
    return f"2 * {radius} * atan2(sqrt({a}), sqrt(1 - ({a})))"


def modes(source: str, key: str, column: str) -> str:
    return f"""SELECT {key}, {column} FROM (
  SELECT {key}, {column}, row_number() OVER (PARTITION BY {key} ORDER BY n DESC, {column}) AS rn
  FROM (SELECT {key}, {column}, count(*) AS n FROM {source} WHERE {column} IS NOT NULL GROUP BY {key}, {column})) WHERE rn = 1"""


def trip_sql(source: str, key: str) -> str:
    """Reference text of the trip features of ``source`` grouped by ``key``."""
    names = [k.strip() for k in key.split(",")]
    on = lambda other: " AND ".join(f"a.{k} = {other}.{k}" for k in names)
    return f"""
SELECT a.*, m1.weather AS weather_condition, m2.road_type, m3.time_of_day,
  hour(start_time) >= 22 OR hour(start_time) < 6 AS is_night, isodow(start_time) >= 6 AS is_weekend,
  hour(start_time) IN (7, 8, 17, 18) AS is_rush_hour, duration_minutes > 60 AS is_long_trip
FROM (
  SELECT {key}, min(timestamp) AS start_time, max(timestamp) AS end_time,
    (epoch_us(max(timestamp)) - epoch_us(min(timestamp))) / 60e6 AS duration_minutes,
    coalesce(sum({miles("plat", "plon", "latitude", "longitude")}), 0) AS distance_miles,
    avg(speed_mph) AS avg_speed, max(speed_mph) AS max_speed, var_samp(speed_mph) AS speed_variance,
    count(*) FILTER (speed_mph > speed_limit_mph + 5) AS over_speed_events,
    avg(CASE WHEN speed_mph > speed_limit_mph + 5 THEN 1.0E0 ELSE 0.0E0 END) AS over_speed_ratio,
    count(*) FILTER (acceleration_ms2 < -3.0E0) AS harsh_braking_count,
    count(*) FILTER (acceleration_ms2 > 3.0E0) AS harsh_acceleration_count,
    avg(acceleration_ms2) AS avg_acceleration, min(acceleration_ms2) AS max_deceleration,
    CAST(sum(phone_usage) AS BIGINT) AS phone_usage_events, avg(phone_usage) AS phone_usage_ratio
  FROM (SELECT *, lag(latitude) OVER w AS plat, lag(longitude) OVER w AS plon FROM {source}
        WINDOW w AS (PARTITION BY {key} ORDER BY timestamp, seq)) s
  GROUP BY {key}
) a JOIN ({modes(source, key, "weather")}) m1 ON {on("m1")}
JOIN ({modes(source, key, "road_type")}) m2 ON {on("m2")}
JOIN ({modes(source, key, "time_of_day")}) m3 ON {on("m3")}
WHERE duration_minutes >= 2"""


def driver_sql(source: str, key: str) -> str:
    return f"""
SELECT {key}, min(start_time) AS period_start, max(end_time) AS period_end, sum(distance_miles) AS total_mileage,
  avg(distance_miles) AS avg_trip_distance, avg(avg_speed) AS avg_speed, max(max_speed) AS max_speed,
  avg(speed_variance) AS speed_variance, CAST(sum(over_speed_events) AS BIGINT) AS over_speed_events,
  avg(over_speed_ratio) AS over_speed_ratio, CAST(sum(harsh_braking_count) AS BIGINT) AS harsh_braking_count,
  CAST(sum(harsh_acceleration_count) AS BIGINT) AS harsh_acceleration_count, avg(avg_acceleration) AS avg_acceleration,
  min(max_deceleration) AS max_deceleration, avg(CAST(is_night AS INT)) AS night_driving_ratio,
  avg(CAST(is_weekend AS INT)) AS weekend_driving_ratio, avg(CAST(is_rush_hour AS INT)) AS rush_hour_ratio,
  CAST(sum(CASE weather_condition WHEN 'rain' THEN 1.3 WHEN 'snow' THEN 1.8 WHEN 'fog' THEN 1.5 ELSE 1.0 END) AS DOUBLE) / count(*) AS weather_risk_score,
  CAST(sum(CASE road_type WHEN 'highway' THEN 1.2 WHEN 'suburban' THEN 0.9 WHEN 'rural' THEN 1.1 ELSE 1.0 END) AS DOUBLE) / count(*) AS road_type_risk_score,
  CAST(sum(phone_usage_events) AS BIGINT) AS phone_usage_events, avg(phone_usage_ratio) AS phone_usage_ratio,
  count(*) AS trip_frequency, avg(duration_minutes) AS avg_trip_duration, avg(CAST(is_long_trip AS INT)) AS long_trip_ratio
FROM {source} GROUP BY {key}"""


shared(
    "t_points",
    """SELECT * FROM telematics_raw WHERE latitude BETWEEN -90 AND 90 AND longitude BETWEEN -180 AND 180
AND speed_mph BETWEEN 0 AND 200""",
)
shared("t_trips", trip_sql("t_points", "driver_id, trip_id"))
shared("t_drivers", driver_sql("t_trips", "driver_id"))

POINT = "driver_id trip_id seq"
INTEGER_FEATURES = (
    "over_speed_events harsh_braking_count harsh_acceleration_count phone_usage_events trip_frequency"
)
DOUBLE_FEATURES = " ".join(n for n in ML_FEATURES if n not in INTEGER_FEATURES.split())
TRIP_KEEP = (
    "driver_id trip_id start_time end_time over_speed_events harsh_braking_count harsh_acceleration_count"
    " weather_condition road_type time_of_day phone_usage_events is_night is_weekend is_rush_hour is_long_trip"
)
TRIP_NUMS = (
    "duration_minutes distance_miles avg_speed max_speed speed_variance over_speed_ratio avg_acceleration"
    " max_deceleration phone_usage_ratio"
)


@query(
    "flt_timestamp_parse",
    keep="event_id parsed",
    sql="SELECT event_id, CAST(CAST(ts AS VARCHAR) AS TIMESTAMP) AS parsed FROM events",
)
def _(i):
    texts = i.table("events").select("event_id", F.col("ts").cast("string").alias("parsed"))
    return cleaning.parse_timestamps(texts, "parsed")


@query(
    "flt_valid_gps",
    keep=POINT,
    nums="latitude longitude",
    sql="SELECT * FROM telematics_raw WHERE latitude BETWEEN -90 AND 90 AND longitude BETWEEN -180 AND 180",
)
def _(i):
    return cleaning.valid_gps(i.telematics_raw)


@query(
    "flt_valid_speed",
    keep=POINT,
    nums="speed_mph",
    sql="SELECT * FROM telematics_raw WHERE speed_mph >= 0 AND speed_mph <= 200",
)
def _(i):
    return cleaning.valid_speed(i.telematics_raw)


@query(
    "flt_driver",
    keep=POINT,
    nums="speed_mph",
    sql="SELECT * FROM telematics_raw WHERE driver_id = 'driver_00007'",
)
def _(i):
    return cleaning.of_driver(i.telematics_raw, "driver_00007")


@query(
    "flt_date_range",
    keep="driver_id trip_id seq timestamp",
    sql="""SELECT * FROM telematics_raw
WHERE timestamp >= TIMESTAMP '2024-01-05 00:00:00' AND timestamp <= TIMESTAMP '2024-01-20 00:00:00'""",
)
def _(i):
    return cleaning.in_date_range(i.telematics_raw, "2024-01-05", "2024-01-20")


@query(
    "prj_overspeed",
    keep=POINT + " overspeed",
    sql="SELECT *, coalesce(speed_mph > speed_limit_mph + 5, FALSE) AS overspeed FROM telematics_raw",
)
def _(i):
    return i.telematics_raw.withColumn("overspeed", cleaning.overspeed())


@query(
    "prj_overspeed_raw",
    keep=POINT + " overspeed",
    sql="SELECT *, coalesce(speed_mph > speed_limit_mph, FALSE) AS overspeed FROM telematics_raw",
)
def _(i):
    return i.telematics_raw.withColumn("overspeed", cleaning.overspeed_raw())


@query(
    "prj_harsh_flags",
    keep=POINT + " braking accelerating",
    sql="SELECT *, acceleration_ms2 < -3.0E0 AS braking, acceleration_ms2 > 3.0E0 AS accelerating FROM telematics_raw",
)
def _(i):
    return i.telematics_raw.withColumn("braking", cleaning.harsh_braking()).withColumn(
        "accelerating", cleaning.harsh_acceleration()
    )


@query(
    "prj_time_flags",
    keep="event_id is_night is_early is_weekend is_rush_hour",
    sql="""SELECT event_id, hour(ts) >= 22 OR hour(ts) < 6 AS is_night, hour(ts) >= 1 AND hour(ts) < 5 AS is_early,
  isodow(ts) >= 6 AS is_weekend, (hour(ts) >= 7 AND hour(ts) < 9) OR (hour(ts) >= 17 AND hour(ts) < 19) AS is_rush_hour FROM events""",
)
def _(i):
    ts = F.col("ts")
    return i.table("events").select(
        "event_id",
        clock.is_night(ts).alias("is_night"),
        clock.is_night(ts, replace(TRIP_RULES, night_hours=(1, 5))).alias("is_early"),
        clock.is_weekend(ts).alias("is_weekend"),
        clock.is_rush_hour(ts).alias("is_rush_hour"),
    )


@query(
    "prj_rush_inclusive",
    keep="event_id is_rush_hour",
    sql="SELECT event_id, hour(ts) BETWEEN 7 AND 9 OR hour(ts) BETWEEN 17 AND 19 AS is_rush_hour FROM events",
)
def _(i):
    return i.table("events").select(
        "event_id", clock.is_context_rush_hour(F.col("ts")).alias("is_rush_hour")
    )


@query(
    "prj_long_trip",
    keep="driver_id trip_id is_long_trip",
    sql="""SELECT driver_id, trip_id, epoch_us(max(timestamp)) - epoch_us(min(timestamp)) > 3600000000 AS is_long_trip
FROM t_points GROUP BY driver_id, trip_id""",
)
def _(i):
    return trips.trip_durations(cleaning.valid_points(i.telematics_raw)).withColumn(
        "is_long_trip", F.col("duration_minutes") > TRIP_RULES.long_trip_minutes
    )


ACCELERATION_SQL = """SELECT driver_id, trip_id, seq, CASE WHEN lag(seq) OVER w IS NULL THEN 0.0E0
  ELSE (speed_mph - lag(speed_mph) OVER w) * 0.44704E0{divide} END AS computed_acceleration
FROM telematics_raw WINDOW w AS (PARTITION BY driver_id, trip_id ORDER BY timestamp, seq)"""


@query(
    "prj_acceleration",
    keep=POINT,
    nums="computed_acceleration",
    sql=ACCELERATION_SQL.format(divide=""),
)
def _(i):
    return cleaning.with_acceleration(i.telematics_raw)


@query(
    "prj_acceleration_per_second",
    keep=POINT,
    nums="computed_acceleration",
    sql=ACCELERATION_SQL.format(divide=" / ((epoch_us(timestamp) - epoch_us(lag(timestamp) OVER w)) / 1e6)"),
)
def _(i):
    return cleaning.with_acceleration(i.telematics_raw, per_second=True)


@query(
    "jn_valid_trips",
    keep="driver_id trip_id seq timestamp",
    sql="""SELECT p.* FROM t_points p JOIN (
  SELECT driver_id, trip_id FROM t_points GROUP BY driver_id, trip_id
  HAVING epoch_us(max(timestamp)) - epoch_us(min(timestamp)) >= 120000000) v USING (driver_id, trip_id)""",
)
def _(i):
    return cleaning.clean(i.telematics_raw)


STRICT_TRIPS = replace(TRIP_RULES, min_trip_minutes=95.0)


@query(
    "jn_failed_drivers",
    keep="driver_id reason",
    sql="""SELECT c.driver_id, CASE WHEN r.driver_id IS NULL THEN 'no data found' WHEN good = 0 THEN 'no valid points'
  ELSE 'no trip long enough' END AS reason
FROM customers_asked c LEFT JOIN (
  SELECT driver_id, count(*) FILTER (latitude BETWEEN -90 AND 90 AND speed_mph BETWEEN 0 AND 200) AS good
  FROM telematics_raw GROUP BY driver_id) r USING (driver_id)
WHERE c.driver_id NOT IN (SELECT driver_id FROM t_trips WHERE duration_minutes >= 95)""",
)
def _(i):
    raw = i.telematics_raw
    features = trips.features_of_all_drivers(raw, rules=STRICT_TRIPS)
    return trips.unknown_drivers(i.customers_asked, raw).unionByName(
        trips.failed_drivers(raw, features).select("driver_id", "reason")
    )


@query(
    "jn_category_weights",
    keep="driver_id trip_id",
    nums="weather_weight road_weight",
    sql="""SELECT driver_id, trip_id,
  CASE weather_condition WHEN 'clear' THEN 1.0E0 WHEN 'rain' THEN 1.3E0 WHEN 'snow' THEN 1.8E0 WHEN 'fog' THEN 1.5E0 ELSE 1.0E0 END AS weather_weight,
  CASE road_type WHEN 'highway' THEN 1.2E0 WHEN 'urban' THEN 1.0E0 WHEN 'suburban' THEN 0.9E0 WHEN 'rural' THEN 1.1E0 ELSE 1.0E0 END AS road_weight
FROM t_trips""",
)
def _(i):
    return trips.category_weights(trips.trip_features(cleaning.valid_points(i.telematics_raw)))


@query(
    "agg_trip_duration",
    keep="driver_id trip_id",
    nums="duration_minutes",
    sql="""SELECT driver_id, trip_id, (epoch_us(max(timestamp)) - epoch_us(min(timestamp))) / 60e6 AS duration_minutes
FROM t_points GROUP BY driver_id, trip_id""",
)
def _(i):
    return trips.trip_durations(cleaning.valid_points(i.telematics_raw))


@query(
    "agg_trip_distance",
    keep="driver_id trip_id",
    nums="distance_miles",
    sql=f"""SELECT driver_id, trip_id, coalesce(sum({miles("plat", "plon", "latitude", "longitude")}), 0) AS distance_miles
FROM (SELECT *, lag(latitude) OVER w AS plat, lag(longitude) OVER w AS plon FROM t_points
      WINDOW w AS (PARTITION BY driver_id, trip_id ORDER BY timestamp, seq)) s GROUP BY driver_id, trip_id""",
)
def _(i):
    return trips.trip_distances(cleaning.valid_points(i.telematics_raw))


@query("agg_trip_features", keep=TRIP_KEEP, nums=TRIP_NUMS, sql="SELECT * FROM t_trips")
def _(i):
    return trips.trip_features(cleaning.valid_points(i.telematics_raw))


@query(
    "agg_trip_mode",
    keep="driver_id trip_id weather_condition road_type time_of_day",
    sql=f"""SELECT driver_id, trip_id, m1.weather AS weather_condition, m2.road_type, m3.time_of_day
FROM ({modes("t_points", "driver_id, trip_id", "weather")}) m1
JOIN ({modes("t_points", "driver_id, trip_id", "road_type")}) m2 USING (driver_id, trip_id)
JOIN ({modes("t_points", "driver_id, trip_id", "time_of_day")}) m3 USING (driver_id, trip_id)""",
)
def _(i):
    return trips.trip_modes(cleaning.valid_points(i.telematics_raw))


@query(
    "agg_driver_features",
    keep="driver_id period_start period_end " + INTEGER_FEATURES,
    nums=DOUBLE_FEATURES,
    sql="SELECT * FROM t_drivers",
)
def _(i):
    return trips.driver_features(trips.trip_features(cleaning.clean(i.telematics_raw)))


@query(
    "agg_driver_features_all",
    keep="driver_id period_start period_end " + INTEGER_FEATURES,
    nums=DOUBLE_FEATURES,
    sql="SELECT * FROM t_drivers",
)
def driver_features_all(i):
    return trips.features_of_all_drivers(i.telematics_raw)


@query(
    "agg_driver_summary",
    keep="driver_id total_trips harsh_braking_events harsh_acceleration_events phone_usage_events range_start range_end records_count",
    nums="total_distance avg_speed max_speed",
    sql="""SELECT driver_id, count(DISTINCT trip_id) AS total_trips, count(speed_mph) * 0.01E0 AS total_distance,
  avg(speed_mph) AS avg_speed, max(speed_mph) AS max_speed, CAST(sum(harsh_braking) AS BIGINT) AS harsh_braking_events,
  CAST(sum(harsh_acceleration) AS BIGINT) AS harsh_acceleration_events, CAST(sum(phone_usage) AS BIGINT) AS phone_usage_events,
  min(timestamp) AS range_start, max(timestamp) AS range_end, count(*) AS records_count
FROM telematics_raw WHERE timestamp >= TIMESTAMP '2024-01-03 00:00:00' AND timestamp <= TIMESTAMP '2024-01-28 12:00:00'
GROUP BY driver_id""",
)
def _(i):
    return (
        trips.driver_summary(i.telematics_raw, "2024-01-03", "2024-01-28 12:00:00")
        .withColumn("range_start", F.col("date_range.start"))
        .withColumn("range_end", F.col("date_range.end"))
    )


@query(
    "agg_dataset_profile",
    keep="total_records total_trips unique_drivers harsh_braking_events harsh_acceleration_events phone_usage_events data_start data_end",
    nums="average_speed",
    sql="""SELECT count(*) AS total_records, count(DISTINCT trip_id) AS total_trips, count(DISTINCT driver_id) AS unique_drivers,
  avg(speed_mph) AS average_speed, CAST(sum(harsh_braking) AS BIGINT) AS harsh_braking_events,
  CAST(sum(harsh_acceleration) AS BIGINT) AS harsh_acceleration_events, CAST(sum(phone_usage) AS BIGINT) AS phone_usage_events,
  min(timestamp) AS data_start, max(timestamp) AS data_end FROM telematics_raw""",
)
def _(i):
    return trips.dataset_profile(i.telematics_raw)


@query(
    "win_step_distance",
    keep=POINT,
    nums="prev_latitude prev_longitude step_miles",
    sql=f"""SELECT driver_id, trip_id, seq, plat AS prev_latitude, plon AS prev_longitude,
  {miles("plat", "plon", "latitude", "longitude")} AS step_miles
FROM (SELECT *, lag(latitude) OVER w AS plat, lag(longitude) OVER w AS plon FROM t_points
      WINDOW w AS (PARTITION BY driver_id, trip_id ORDER BY timestamp, seq)) s""",
)
def _(i):
    return trips.step_distances(cleaning.valid_points(i.telematics_raw))


@query(
    "win_first_point",
    keep="driver_id trip_id start_time is_night is_weekend is_rush_hour",
    sql="SELECT * FROM t_trips",
)
def _(i):
    return trips.trip_features(cleaning.valid_points(i.telematics_raw))


@query(
    "srt_driver_time",
    keep="driver_id timestamp seq trip_id",
    sql="SELECT * FROM t_points ORDER BY driver_id, timestamp, seq",
)
def _(i):
    return cleaning.sort_points(cleaning.valid_points(i.telematics_raw))


@query(
    "set_union_trips",
    keep="driver_id trip_id seq device",
    nums="speed_mph",
    sql="""SELECT driver_id, trip_id, seq, speed_mph, NULL AS device FROM telematics_raw
UNION ALL SELECT driver_id, trip_id, event_id, speed_mph, 'live' FROM telematics_events""",
)
def _(i):
    stored = i.telematics_raw.select("driver_id", "trip_id", "seq", "speed_mph")
    live = i.telematics_events.select(
        "driver_id", "trip_id", F.col("event_id").alias("seq"), "speed_mph", F.lit("live").alias("device")
    )
    return feeds.union_trips(stored, live)


@query(
    "set_distinct_keys",
    keep="driver_id trip_id",
    sql="SELECT DISTINCT driver_id, trip_id FROM telematics_raw",
)
def _(i):
    return i.telematics_raw.select("driver_id", "trip_id").distinct()


@query(
    "fn_haversine",
    keep="event_id",
    nums="miles",
    sql=f"SELECT event_id, {miles('latitude', 'longitude', '40.7128E0', '-74.0060E0')} AS miles FROM telematics_events",
)
def _(i):
    return i.telematics_events.withColumn(
        "miles", haversine_miles(F.col("latitude"), F.col("longitude"), F.lit(40.7128), F.lit(-74.0060))
    )


@query(
    "fn_date_parts",
    keep="event_id year month day",
    sql="SELECT event_id, strftime(ts, '%Y') AS year, strftime(ts, '%m') AS month, strftime(ts, '%d') AS day FROM events",
)
def _(i):
    return i.table("events").withColumns(clock.date_parts(F.col("ts")))
