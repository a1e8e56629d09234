"""Queries on location context."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from roadrisk.functions import clock, scores as s
from roadrisk.operators import context, lookups
from roadrisk.plans.registry import query, shared
from roadrisk.plans.relations import AS_OF_EXTERNAL, Inputs
from roadrisk.plans.trip_queries import miles

NEWEST = 500  # of a place, in the top list only; small enough to take effect on small data
WEATHER_AGE = 6 * 3600
LOOKUP_HOURS = 24

shared("t_places", "SELECT DISTINCT latitude, longitude FROM context_requests")
shared(
    "t_crime",
    """SELECT l.latitude, l.longitude, c.incident_id, c.incident_type, c.date,
  row_number() OVER (PARTITION BY l.latitude, l.longitude ORDER BY c.date DESC, c.incident_id DESC) AS rn
FROM t_places l JOIN crime_incidents c ON c.latitude BETWEEN l.latitude - 5 / 69.0E0 AND l.latitude + 5 / 69.0E0
  AND c.longitude BETWEEN l.longitude - 5 / (69.0E0 * cos(radians(l.latitude))) AND l.longitude + 5 / (69.0E0 * cos(radians(l.latitude)))""",
)
shared(
    "t_crime_counts",
    f"""SELECT l.latitude, l.longitude, count(incident_id) AS incidents,
  count(*) FILTER (incident_type IN ('assault', 'robbery')) AS violent, count(*) FILTER (incident_type IN ('theft', 'burglary', 'vandalism')) AS property,
  count(*) FILTER (lower(incident_type) LIKE '%vehicle%') AS vehicle,
  count(*) FILTER (floor((epoch_us(TIMESTAMP '{AS_OF_EXTERNAL}') - epoch_us(date)) / 86400e6) <= 30) AS recent
FROM t_places l LEFT JOIN t_crime c ON c.latitude = l.latitude AND c.longitude = l.longitude GROUP BY l.latitude, l.longitude""",
)
shared(
    "t_crime_risk",
    """SELECT *, CASE WHEN crime_risk_score < 0.3E0 THEN 'low' WHEN crime_risk_score < 0.7E0 THEN 'medium' ELSE 'high' END AS risk_level FROM (
SELECT *, CASE WHEN incidents = 0 THEN 0.1E0 ELSE (0.4E0 * violent_score + 0.3E0 * property_score + 0.2E0 * vehicle_theft_score + 0.1E0 * frequency_factor
  + 0.2E0 * least(recent / 20.0E0, 1)) / 1.2E0 END AS crime_risk_score FROM (
SELECT *, CASE WHEN incidents = 0 THEN 0.1E0 ELSE least(violent / 20.0E0, 1) END AS violent_score, CASE WHEN incidents = 0 THEN 0.1E0 ELSE least(property / 50.0E0, 1) END AS property_score,
  CASE WHEN incidents = 0 THEN 0.1E0 ELSE least(vehicle / 10.0E0, 1) END AS vehicle_theft_score, CASE WHEN incidents = 0 THEN 0.1E0 ELSE least(incidents / 100.0E0, 1) END AS frequency_factor
FROM t_crime_counts) a) b""",
)
shared(
    "t_segments",
    f"""SELECT route_id, seq - 1 AS segment, {miles("plat", "plon", "latitude", "longitude", "3958.7613E0")} AS miles,
  least(latitude, plat) AS south, greatest(latitude, plat) AS north, least(longitude, plon) AS west, greatest(longitude, plon) AS east
FROM (SELECT *, lag(latitude) OVER w AS plat, lag(longitude) OVER w AS plon FROM route_points WINDOW w AS (PARTITION BY route_id ORDER BY seq)) p WHERE plat IS NOT NULL""",
)
shared(
    "t_recent_accidents",
    f"""SELECT latitude, longitude, severity, weather_conditions, count(*) AS n,
  count(*) FILTER (floor((epoch_us(TIMESTAMP '{AS_OF_EXTERNAL}') - epoch_us(date)) / 86400e6) <= 90) AS seasonal
FROM traffic_accidents WHERE date BETWEEN TIMESTAMP '{AS_OF_EXTERNAL}' - INTERVAL 365 DAY AND TIMESTAMP '{AS_OF_EXTERNAL}'
GROUP BY latitude, longitude, severity, weather_conditions""",
)
shared(
    "t_segment_accidents",
    """SELECT s.route_id, s.segment, a.severity, a.weather_conditions, CAST(sum(a.n) AS BIGINT) AS accidents, CAST(sum(a.seasonal) AS BIGINT) AS seasonal
FROM t_segments s JOIN t_recent_accidents a ON a.latitude BETWEEN s.south AND s.north AND a.longitude BETWEEN s.west AND s.east
GROUP BY s.route_id, s.segment, a.severity, a.weather_conditions""",
)
shared("t_lengths", "SELECT route_id, sum(miles) AS route_miles FROM t_segments GROUP BY route_id")
shared(
    "t_route_counts",
    """SELECT l.route_id, l.route_miles, CAST(coalesce(sum(accidents), 0) AS BIGINT) AS total_accidents, CAST(coalesce(sum(accidents) FILTER (severity = 'minor'), 0) AS BIGINT) AS minor,
  CAST(coalesce(sum(accidents) FILTER (severity = 'major'), 0) AS BIGINT) AS major, CAST(coalesce(sum(accidents) FILTER (severity = 'fatal'), 0) AS BIGINT) AS fatal,
  coalesce(sum(seasonal), 0) AS seasonal, coalesce(sum(accidents) FILTER (weather_conditions IN ('rain', 'snow', 'fog')), 0) AS bad
FROM t_lengths l LEFT JOIN t_segment_accidents a USING (route_id) GROUP BY l.route_id, l.route_miles""",
)
shared(
    "t_route_risk",
    """SELECT *, CASE WHEN total_accidents = 0 THEN 0.1E0 ELSE least(1.0E0, 0.3E0 * accident_density + 0.4E0 * (0.1E0 * minor + 0.3E0 * major + fatal) / total_accidents
  + 0.2E0 * seasonal_risk + 0.1E0 * weather_risk) END AS route_accident_score FROM (
SELECT *, total_accidents / greatest(route_miles, 1) AS accident_density, CASE WHEN total_accidents = 0 THEN 0.1E0 ELSE least(seasonal / 10.0E0, 1) END AS seasonal_risk,
  CASE WHEN total_accidents = 0 THEN 0.1E0 ELSE least(bad / total_accidents * 2.0E0, 1) END AS weather_risk FROM t_route_counts) c""",
)


def latest_sql(source: str, extra: str) -> str:
    return f"""SELECT r.request_id, r.station_id, r.timestamp, {extra} FROM context_requests r
ASOF LEFT JOIN (SELECT * FROM {source}) o ON o.station_id = r.station_id AND o.obs_ts <= r.timestamp"""


WEATHER_SCORE = """least(1.0E0, CASE WHEN conditions IN ('rain', 'snow') THEN 0.3E0 WHEN conditions = 'fog' THEN 0.4E0 ELSE 0.0E0 END
  + CASE WHEN visibility_miles < 1 THEN 0.2E0 WHEN visibility_miles < 3 THEN 0.1E0 ELSE 0.0E0 END
  + CASE WHEN precipitation_inches > 0.5E0 THEN 0.2E0 ELSE 0.0E0 END + CASE WHEN wind_speed_mph > 25 THEN 0.1E0 ELSE 0.0E0 END)"""
shared(
    "t_weather_at",
    latest_sql("weather_obs", "o.obs_id, o.obs_ts, conditions, visibility_miles, precipitation_inches, wind_speed_mph"),
)
shared("t_traffic_at", latest_sql("traffic_obs", "o.obs_id, average_speed_mph, typical_speed_mph"))
shared(
    "t_weather",
    f"""SELECT request_id, CASE WHEN fresh THEN obs_id ELSE -1 END AS weather_obs_id, CASE WHEN fresh THEN conditions ELSE 'unknown' END AS conditions,
  CASE WHEN fresh THEN {WEATHER_SCORE} ELSE 0.2E0 END AS weather_risk_score
FROM (SELECT *, obs_id IS NOT NULL AND epoch_us(timestamp) - epoch_us(obs_ts) <= {WEATHER_AGE}000000 AS fresh FROM t_weather_at) w""",
)
RUSH = "(hour(timestamp) BETWEEN 7 AND 9 OR hour(timestamp) BETWEEN 17 AND 19)"
shared(
    "t_traffic",
    f"""SELECT request_id, coalesce(obs_id, -1) AS traffic_obs_id, {RUSH} AS is_context_rush_hour,
  CASE WHEN obs_id IS NULL THEN 0.3E0 ELSE least(1.0E0, (1 - average_speed_mph / typical_speed_mph) * CASE WHEN {RUSH} THEN 1.3E0 ELSE 1.0E0 END) END AS congestion_risk_score
FROM t_traffic_at""",
)


def weather(i: Inputs) -> DataFrame:
    return context.weather_at(i.context_requests, i.weather_obs, WEATHER_AGE)


def crime(i: Inputs) -> DataFrame:
    places = context.distinct_lookups(i.context_requests)
    return context.crime_risk(places, i.crime_incidents, AS_OF_EXTERNAL)


@query(
    "src_context_tables",
    keep="source rows",
    sql=" UNION ALL ".join(
        f"SELECT '{n}' AS source, count(*) AS rows FROM {n}"
        for n in ("crime_incidents", "traffic_accidents", "weather_obs", "traffic_obs", "zip_demographics")
    ),
)
def _(i):
    result = None
    for name in ("crime_incidents", "traffic_accidents", "weather_obs", "traffic_obs", "zip_demographics"):
        part = getattr(i, name).agg(F.lit(name).alias("source"), F.count("*").alias("rows"))
        result = part if result is None else result.unionByName(part)
    return result


@query(
    "set_distinct_lookups",
    keep="request_id incidents",
    sql="""SELECT r.request_id, c.incidents FROM context_requests r JOIN t_crime_counts c ON c.latitude = r.latitude AND c.longitude = r.longitude""",
)
def _(i):
    return i.context_requests.join(crime(i), [*context.PLACE])


@query(
    "set_lookups_answered",
    keep="request_id answered_by answered_at fetched",
    nums="latitude longitude",
    sql=f"""SELECT r.*, f.request_id AS answered_by, f.timestamp AS answered_at, f.request_id = r.request_id AS fetched FROM context_requests r ASOF JOIN (
  WITH RECURSIVE a AS (SELECT latitude, longitude, min(timestamp) AS timestamp FROM context_requests GROUP BY latitude, longitude
    UNION ALL SELECT n.latitude, n.longitude, min(n.timestamp) FROM a JOIN context_requests n ON n.latitude = a.latitude AND n.longitude = a.longitude
      AND n.timestamp >= a.timestamp + INTERVAL {LOOKUP_HOURS} HOUR GROUP BY n.latitude, n.longitude)
  SELECT a.latitude, a.longitude, a.timestamp, min(c.request_id) AS request_id FROM a
  JOIN context_requests c ON c.latitude = a.latitude AND c.longitude = a.longitude AND c.timestamp = a.timestamp GROUP BY a.latitude, a.longitude, a.timestamp
) f ON f.latitude = r.latitude AND f.longitude = r.longitude AND f.timestamp <= r.timestamp""",
)
def _(i):
    found = lookups.answered(i.context_requests, context.PLACE, "timestamp", "request_id", LOOKUP_HOURS)
    return found.withColumn("fetched", F.col("answered_by") == F.col("request_id"))


@query(
    "fn_bbox",
    keep="request_id",
    nums="south north west east",
    sql="""SELECT request_id, latitude - 5 / 69.0E0 AS south, latitude + 5 / 69.0E0 AS north, longitude - 5 / (69.0E0 * cos(radians(latitude))) AS west,
  longitude + 5 / (69.0E0 * cos(radians(latitude))) AS east FROM context_requests""",
)
def _(i):
    return context.boxes(i.context_requests, 5.0)


@query(
    "jn_crime_bbox",
    keep="incident_id date",
    nums="latitude longitude",
    sql="SELECT * FROM t_crime",
)
def _(i):
    places = context.distinct_lookups(i.context_requests)
    return context.crime_in_box(places, i.crime_incidents)


@query(
    "srt_top_incidents",
    keep="newest oldest incidents",
    nums="latitude longitude",
    sql=f"""SELECT latitude, longitude, max(date) AS newest, min(date) AS oldest, count(*) AS incidents FROM t_crime WHERE rn <= {NEWEST} GROUP BY latitude, longitude""",
)
def _(i):
    places = context.distinct_lookups(i.context_requests)
    return (
        context.crime_in_box(places, i.crime_incidents, newest=NEWEST)
        .groupBy(*context.PLACE)
        .agg(F.max("date").alias("newest"), F.min("date").alias("oldest"), F.count("*").alias("incidents"))
    )


@query(
    "agg_crime_risk",
    keep="risk_level incidents recent",
    nums="latitude longitude crime_risk_score violent_score property_score vehicle_theft_score frequency_factor",
    sql="SELECT * FROM t_crime_risk",
)
def _(i):
    return crime(i)


@query(
    "jn_accidents_on_route",
    keep="route_id segment severity weather_conditions accidents",
    sql="SELECT * FROM t_segment_accidents",
)
def _(i):
    segments = context.route_segments(i.route_points)
    return context.accident_rows_on_routes(segments, i.traffic_accidents, AS_OF_EXTERNAL)


def geodesic_sql(rows: str, rounds: int = 8) -> str:
    """Lengths on the ellipsoid from (lat1, lon1) to (lat2, lon2), one nested select for each step."""
    f, a = "(1 / 298.257223563E0)", 6378137.0
    b = f"({a!r}E0 * (1 - {f}))"
    text = f"""SELECT *, sin(u1) AS s1, cos(u1) AS c1, sin(u2) AS s2, cos(u2) AS c2, dl AS x, dl AS before FROM (
SELECT *, atan((1 - {f}) * tan(radians(lat1))) AS u1, atan((1 - {f}) * tan(radians(lat2))) AS u2, radians(lon2 - lon1) AS dl FROM ({rows}) r) u"""

    def arc(inner: str) -> str:
        return f"""SELECT *, CASE WHEN q > 1e-15 THEN cs - 2 * s1 * s2 / q ELSE 0 END AS m FROM (SELECT *, 1 - az * az AS q FROM (
SELECT *, atan2(ss, cs) AS arc, CASE WHEN ss > 0 THEN c1 * c2 * sin(x) / ss ELSE 0 END AS az FROM (
SELECT *, sqrt(pow(c2 * sin(x), 2) + pow(c1 * s2 - s1 * c2 * cos(x), 2)) AS ss, s1 * s2 + c1 * c2 * cos(x) AS cs FROM ({inner}) i1) i2) i3) i4"""

    for _ in range(rounds):
        text = f"""SELECT * EXCLUDE (ss, cs, arc, az, q, m, c) REPLACE (x AS before, dl + (1 - c) * {f} * az * (arc + c * ss * (m + c * cs * (2 * m * m - 1))) AS x)
FROM (SELECT *, {f} / 16 * q * (4 + {f} * (4 - 3 * q)) AS c FROM ({arc(text)}) a1) a2"""
    return f"""SELECT *, {b} * big * (arc - k * ss * (m + k / 4 * (cs * (2 * m * m - 1) - k / 6 * m * (4 * ss * ss - 3) * (4 * m * m - 3)))) / 1609.344E0 AS miles, abs(x - before) < 1e-12 AS settled
FROM (SELECT *, 1 + w / 16384 * (4096 + w * (-768 + w * (320 - 175 * w))) AS big, w / 1024 * (256 + w * (-128 + w * (74 - 47 * w))) AS k
FROM (SELECT *, q * (({a!r}E0 * {a!r}E0 - {b} * {b}) / ({b} * {b})) AS w FROM ({arc(text)}) z1) z2) z3"""


ROUTE_STEPS = """SELECT * FROM (SELECT route_id, lag(latitude) OVER w AS lat1, lag(longitude) OVER w AS lon1, latitude AS lat2, longitude AS lon2
FROM route_points WINDOW w AS (PARTITION BY route_id ORDER BY seq)) p WHERE lat1 IS NOT NULL"""


@query(
    "agg_route_length",
    keep="route_id sphere_segments",
    nums="route_miles",
    sql=f"SELECT route_id, sum(miles) AS route_miles, count(*) FILTER (NOT settled) AS sphere_segments FROM ({geodesic_sql(ROUTE_STEPS)}) g GROUP BY route_id",
)
def _(i):
    return context.route_lengths(i.route_points)


@query(
    "agg_accident_risk",
    keep="route_id total_accidents",
    nums="route_miles route_accident_score accident_density seasonal_risk weather_risk",
    sql="SELECT * FROM t_route_risk",
)
def _(i):
    return context.accident_risk(i.route_points, i.traffic_accidents, AS_OF_EXTERNAL)


@query("agg_severity_breakdown", keep="route_id minor major fatal", sql="SELECT * FROM t_route_counts")
def _(i):
    return context.route_accidents(i.route_points, i.traffic_accidents, AS_OF_EXTERNAL)


@query(
    "jn_weather_asof",
    keep="request_id weather_obs_id conditions",
    sql="SELECT * FROM t_weather",
)
def _(i):
    return weather(i).fillna(-1, ["weather_obs_id"])


@query(
    "jn_traffic_asof",
    keep="request_id traffic_obs_id is_context_rush_hour",
    sql="SELECT * FROM t_traffic",
)
def _(i):
    return context.traffic_at(i.context_requests, i.traffic_obs).fillna(-1, ["traffic_obs_id"])


@query(
    "fn_weather_score",
    keep="obs_id",
    nums="score",
    sql=f"SELECT obs_id, {WEATHER_SCORE} AS score FROM weather_obs",
)
def _(i):
    score = s.weather_risk(
        F.col("conditions"), F.col("visibility_miles"), F.col("precipitation_inches"), F.col("wind_speed_mph")
    )
    return i.weather_obs.withColumn("score", score)


@query(
    "fn_congestion_score",
    keep="obs_id",
    nums="score",
    sql="""SELECT obs_id, CASE WHEN typical_speed_mph = 25 THEN 0.3E0 ELSE least(1.0E0, (1 - (average_speed_mph - 10) / (typical_speed_mph - 25))
  * CASE WHEN hour(obs_ts) BETWEEN 7 AND 9 OR hour(obs_ts) BETWEEN 17 AND 19 THEN 1.3E0 ELSE 1.0E0 END) END AS score FROM traffic_obs""",
)
def _(i):
    score = s.congestion_risk(
        F.col("average_speed_mph") - 10,
        F.col("typical_speed_mph") - 25,
        clock.is_context_rush_hour(F.col("obs_ts")),
    )
    return i.traffic_obs.withColumn("score", score)


CENSUS_FACTORS = """CASE WHEN known IS NULL THEN 1.0E0 WHEN coalesce(median_income, 50000) < 30000 THEN 1.2E0 WHEN coalesce(median_income, 50000) > 80000 THEN 0.9E0 ELSE 1.0E0 END AS income_factor,
  CASE WHEN known IS NULL THEN 1.0E0 WHEN population_density > 3000 THEN 1.1E0 WHEN population_density < 500 THEN 0.95E0 ELSE 1.0E0 END AS density_factor,
  CASE WHEN known IS NULL THEN 1.0E0 WHEN median_age < 30 THEN 1.05E0 WHEN median_age > 45 THEN 0.95E0 ELSE 1.0E0 END AS age_factor"""
shared(
    "t_census",
    f"""SELECT *, least(1.5E0, greatest(0.7E0, income_factor * density_factor * age_factor)) AS risk_multiplier FROM (
SELECT request_id, zip_code, coalesce(median_income, 0) AS median_income, coalesce(population_density, 0) AS population_density, {CENSUS_FACTORS}
FROM (SELECT r.*, z.zip_code AS known, z.* EXCLUDE (zip_code) FROM zip_requests r LEFT JOIN zip_demographics z ON z.zip_code = r.zip_code) j) f""",
)


@query(
    "jn_demographics",
    keep="request_id zip_code",
    nums="median_income population_density risk_multiplier",
    sql="SELECT * FROM t_census",
)
def _(i):
    return context.demographic_factors(i.zip_requests, i.zip_demographics)


@query(
    "fn_demographic_risk",
    keep="request_id",
    nums="income_factor density_factor age_factor risk_multiplier",
    sql="SELECT * FROM t_census",
)
def _(i):
    return context.demographic_factors(i.zip_requests, i.zip_demographics)


shared(
    "t_context",
    """SELECT *, 0.25E0 * crime_risk + 0.30E0 * weather_risk + 0.25E0 * traffic_risk + 0.20E0 * accident_risk AS contextual_risk_score FROM (
SELECT r.request_id, c.crime_risk_score AS crime_risk, w.weather_risk_score AS weather_risk, t.congestion_risk_score AS traffic_risk,
  CASE WHEN r.route_id IS NULL THEN 0.5E0 ELSE coalesce(a.route_accident_score, 0.4E0) END AS accident_risk, CASE WHEN r.route_id IS NULL THEN 0.7E0 ELSE 0.8E0 END AS confidence
FROM context_requests r JOIN t_crime_risk c ON c.latitude = r.latitude AND c.longitude = r.longitude
JOIN t_weather w USING (request_id) JOIN t_traffic t USING (request_id) LEFT JOIN t_route_risk a ON a.route_id = r.route_id) s""",
)


def combined(i: Inputs) -> DataFrame:
    observed = context.observed_at(i.context_requests, i.weather_obs, i.traffic_obs, WEATHER_AGE)
    routes = context.accident_risk(i.route_points, i.traffic_accidents, AS_OF_EXTERNAL)
    return context.combine(observed, crime(i), routes)


@query(
    "jn_context_sources",
    keep="request_id",
    nums="crime_risk weather_risk traffic_risk accident_risk",
    sql="SELECT * FROM t_context",
)
def _(i):
    return combined(i)


@query(
    "fn_combined_context",
    keep="request_id risk_level advice",
    nums="contextual_risk_score confidence",
    sql="""SELECT *, CASE WHEN contextual_risk_score < 0.3E0 THEN 'low' WHEN contextual_risk_score < 0.7E0 THEN 'medium' ELSE 'high' END AS risk_level,
  CASE WHEN contextual_risk_score > 0.7E0 THEN 'Consider avoiding this area during peak hours|Use extra caution due to high risk factors'
       WHEN contextual_risk_score > 0.4E0 THEN 'Moderate risk area - drive defensively' ELSE '' END AS advice FROM t_context""",
)
def _(i):
    return combined(i).withColumn("advice", F.array_join("recommendations", "|"))
