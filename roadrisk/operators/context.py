"""Location context: crime, accidents, weather, traffic, demographics and their combination.

Counts in boxes come from a quadtree of totals (``operators/boxes.py``): whole cells inside a box give one row each, and only
its border cells meet single points. Pairs of places and incidents are an equi join on grid cells with an exact filter.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from roadrisk.functions import clock, scores, text
from roadrisk.functions.geo import (
    MILES_PER_DEGREE,
    ROUTE_EARTH_RADIUS,
    cells_covering,
    grid_cell,
    haversine_miles,
    latitude_delta,
    longitude_delta,
    with_ellipsoid_miles,
)
from roadrisk.operators import boxes as quadtree
from roadrisk.operators.sequence import as_of_tables, not_older, with_previous

PLACE = ("latitude", "longitude")
RECENT_DAYS = 30
SEASON_DAYS = 90
LONG_SEGMENT_DEGREES = 0.5
SHORT_SIDE = 3
SEGMENT_LEVELS = range(-6, 15, 2)  # from cells of 64 degrees to some seven metres
ROUTE_SLOT_POINTS = 1000


def distinct_lookups(requests: DataFrame) -> DataFrame:
    """Each asked-for place once, so that repeated requests share one lookup."""
    return requests.select(*PLACE).distinct()


def boxes(lookups: DataFrame, radius_miles: float) -> DataFrame:
    """Bounds of the square around each place."""
    dlat = latitude_delta(radius_miles)
    dlon = longitude_delta(F.col("latitude"), radius_miles)
    return (
        lookups.withColumn("south", F.col("latitude") - dlat)
        .withColumn("north", F.col("latitude") + dlat)
        .withColumn("west", F.col("longitude") - dlon)
        .withColumn("east", F.col("longitude") + dlon)
    )


def _on_cells(box: DataFrame, cell_degrees: float) -> DataFrame:
    """One row per grid cell that the box covers."""
    rows = cells_covering(F.col("south"), F.col("north"), cell_degrees, 90.0)
    columns = cells_covering(F.col("west"), F.col("east"), cell_degrees, 180.0)
    return box.withColumn("_cell_lat", F.explode(rows)).withColumn("_cell_lon", F.explode(columns))


def _in_cell(points: DataFrame, lat: str, lon: str, cell_degrees: float) -> DataFrame:
    return points.withColumn("_cell_lat", grid_cell(F.col(lat), cell_degrees)).withColumn(
        "_cell_lon", grid_cell(F.col(lon), cell_degrees)
    )


def _inside(lat: str, lon: str) -> Column:
    return F.col(lat).between(F.col("south"), F.col("north")) & F.col(lon).between(
        F.col("west"), F.col("east")
    )


def _near(lookups: DataFrame, found: DataFrame, radius_miles: float) -> DataFrame:
    """Rows with a point (incident_lat, incident_lon) in the box around each place."""
    cell = radius_miles / MILES_PER_DEGREE
    return (
        _on_cells(boxes(lookups, radius_miles), cell)
        .join(_in_cell(found, "incident_lat", "incident_lon", cell), ["_cell_lat", "_cell_lon"])
        .filter(_inside("incident_lat", "incident_lon"))
    )


def crime_in_box(
    lookups: DataFrame, incidents: DataFrame, radius_miles: float = 5.0, newest: int | None = None
) -> DataFrame:
    """Incidents in the box around each place, the newest ones where a limit is given.

    With a limit, a whole cell inside a box gives its newest incidents only, and so does an exact point
    on the border, which is in or out of the box as one.
    """
    found = incidents.withColumnRenamed("latitude", "incident_lat").withColumnRenamed(
        "longitude", "incident_lon"
    )
    columns = [*PLACE, "incident_id", "incident_type", "severity", "incident_lat", "incident_lon", "date"]
    if newest is None:
        return _near(lookups, found, radius_miles).select(*columns)
    newest_first = (F.col("date").desc(), F.col("incident_id").desc())
    pairs = quadtree.newest(boxes(lookups, radius_miles), found, "incident_lat", "incident_lon", newest_first, newest)
    per_place = Window.partitionBy(*PLACE).orderBy(*newest_first)
    return (
        pairs.select(*columns)
        .withColumn("_rank", F.row_number().over(per_place))
        .filter(F.col("_rank") <= newest)
        .drop("_rank")
    )


def crime_risk(
    lookups: DataFrame,
    incidents: DataFrame,
    as_of_time: str,
    radius_miles: float = 5.0,
) -> DataFrame:
    """Crime scores of each place; a place without incidents gets 0.1 throughout."""

    def counted(flag: Column) -> Column:
        return F.count(F.when(flag, 1))

    kind = F.col("incident_type")
    age = clock.elapsed_whole_days(clock.ntz(as_of_time), F.col("date"))
    names = ("violent", "property", "vehicle", "recent", "incidents")
    per_point = incidents.groupBy(F.col("latitude").alias("incident_lat"), F.col("longitude").alias("incident_lon")).agg(
        counted(kind.isin("assault", "robbery")).alias("violent"),
        counted(kind.isin("theft", "burglary", "vandalism")).alias("property"),
        counted(F.lower(kind).contains("vehicle")).alias("vehicle"),
        counted(age <= RECENT_DAYS).alias("recent"),
        F.count("*").alias("incidents"),
    )
    inside = quadtree.sums(boxes(lookups, radius_miles), per_point, "incident_lat", "incident_lon", names)
    counts = inside.groupBy(*PLACE).agg(*[F.sum(n).alias(n) for n in names])

    def score(name: str, full: float) -> Column:
        return F.when(F.col("incidents") > 0, scores.capped(F.col(name) / full)).otherwise(0.1)

    overall = (
        F.col("violent_score") * 0.4
        + F.col("property_score") * 0.3
        + F.col("vehicle_theft_score") * 0.2
        + F.col("frequency_factor") * 0.1
        + scores.capped(F.col("recent") / 20.0) * 0.2
    ) / 1.2
    return (
        lookups.join(counts, [*PLACE], "left")
        .fillna(0, ["violent", "property", "vehicle", "recent", "incidents"])
        .withColumn("violent_score", score("violent", 20.0))
        .withColumn("property_score", score("property", 50.0))
        .withColumn("vehicle_theft_score", score("vehicle", 10.0))
        .withColumn("frequency_factor", score("incidents", 100.0))
        .withColumn("crime_risk_score", F.when(F.col("incidents") > 0, overall).otherwise(0.1))
        .withColumn("risk_level", scores.service_category(F.col("crime_risk_score")))
    )


def _route_steps(route_points: DataFrame) -> DataFrame:
    """Successive points of a route."""
    return with_previous(
        route_points,
        ("route_id",),
        "seq",
        (),
        ("latitude", "longitude"),
        slot=F.floor(F.col("seq") / ROUTE_SLOT_POINTS),
    ).filter(F.col("prev_latitude").isNotNull())


def route_segments(route_points: DataFrame) -> DataFrame:
    """Segments between successive points of a route, with their miles on a sphere and bounds."""
    lat, lon, lat0, lon0 = (F.col(c) for c in (*PLACE, "prev_latitude", "prev_longitude"))
    return _route_steps(route_points).select(
        "route_id",
        (F.col("seq") - 1).alias("segment"),
        haversine_miles(lat0, lon0, lat, lon, ROUTE_EARTH_RADIUS).alias("miles"),
        F.least(lat, lat0).alias("south"),
        F.greatest(lat, lat0).alias("north"),
        F.least(lon, lon0).alias("west"),
        F.greatest(lon, lon0).alias("east"),
    )


def route_lengths(route_points: DataFrame) -> DataFrame:
    """Miles of each route on the ellipsoid, and the number of its segments that had to be measured on a sphere."""
    steps = with_ellipsoid_miles(_route_steps(route_points), "prev_latitude", "prev_longitude", *PLACE, "miles")
    return steps.groupBy("route_id").agg(
        F.sum("miles").alias("route_miles"), F.count_if(~F.col("miles_settled")).alias("sphere_segments")
    )


def accidents_by_point(accidents: DataFrame, as_of_time: str, window_days: int = 365) -> DataFrame:
    """Accidents of the time window counted per exact point, before any join."""
    end = clock.ntz(as_of_time)
    start = end - F.expr(f"INTERVAL {window_days} DAYS")
    age = clock.elapsed_whole_days(end, F.col("date"))

    def counted(flag: Column) -> Column:
        return F.count(F.when(flag, 1))

    known = F.col("severity").isin("minor", "major", "fatal")
    return (
        accidents.filter(F.col("date").between(start, end))
        .groupBy(F.col("latitude").alias("accident_lat"), F.col("longitude").alias("accident_lon"))
        .agg(
            F.count("*").alias("accidents"),
            counted(F.col("severity") == "minor").alias("minor"),
            counted(F.col("severity") == "major").alias("major"),
            counted(F.col("severity") == "fatal").alias("fatal"),
            counted(~F.coalesce(known, F.lit(False))).alias("unknown"),
            counted(age <= SEASON_DAYS).alias("seasonal"),
            counted(F.col("weather_conditions").isin("rain", "snow", "fog")).alias("bad_weather"),
        )
    )


ACCIDENT_COUNTS = ("accidents", "minor", "major", "fatal", "unknown", "seasonal", "bad_weather")


def _is_long() -> Column:
    return F.greatest(F.col("north") - F.col("south"), F.col("east") - F.col("west")) > LONG_SEGMENT_DEGREES


def _segment_side() -> Column:
    """Cells along a segment: few for a short one, whose box holds few accidents."""
    return F.when(_is_long(), quadtree.SIDE).otherwise(SHORT_SIDE)


def _segment_sums(segments: DataFrame, points: DataFrame, names: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Sums over the points in the box of each segment. Only long segments, of more than LONG_SEGMENT_DEGREES, have whole cells;
    short ones, which are most, meet single points and are sent to one cell each."""
    place = ("accident_lat", "accident_lon")
    long = quadtree.sums(segments.filter(_is_long()), points, *place, names, by, _segment_side(), SEGMENT_LEVELS)
    return long.unionByName(quadtree.small_sums(segments.filter(~_is_long()), points, *place, names, by))


def route_accidents(
    route_points: DataFrame, accidents: DataFrame, as_of_time: str, window_days: int = 365
) -> DataFrame:
    """Accident counts of every route, summed over its segments (border accidents count for both)."""
    segments = route_segments(route_points)
    points = accidents_by_point(accidents, as_of_time, window_days)
    counts = _segment_sums(segments, points, ACCIDENT_COUNTS)
    none = F.lit(0).cast("long")
    rows = counts.select("route_id", F.lit(0.0).alias("miles"), *ACCIDENT_COUNTS).unionByName(
        segments.select("route_id", "miles", *[none.alias(name) for name in ACCIDENT_COUNTS])
    )
    return rows.groupBy("route_id").agg(
        F.sum("miles").alias("route_miles"), *[F.sum(name).alias(name) for name in ACCIDENT_COUNTS]
    )


def accident_risk(
    route_points: DataFrame, accidents: DataFrame, as_of_time: str, window_days: int = 365
) -> DataFrame:
    """Accident scores of every route.

    A route without accidents scores 0.1; one with an accident of unknown severity gets the default
    result, a score of 0.4 and no breakdown.
    """
    n = F.col("accidents")
    bad = F.col("unknown") > 0

    def choose(value: Column, empty: float, default: float | None) -> Column:
        return F.when(bad, F.lit(default)).when(n == 0, F.lit(empty)).otherwise(value)

    severity = F.col("minor") * 0.1 + F.col("major") * 0.3 + F.col("fatal") * 1.0
    density = n / F.greatest("route_miles", F.lit(1.0))
    seasonal = scores.capped(F.col("seasonal") / 10.0)
    weather = scores.capped(F.col("bad_weather") / n * 2)
    total = scores.capped(
        density * 0.3 + severity / F.greatest(n, F.lit(1)) * 0.4 + seasonal * 0.2 + weather * 0.1
    )
    rows = route_accidents(route_points, accidents, as_of_time, window_days)
    return rows.select(
        "route_id",
        "route_miles",
        F.when(bad, 0).otherwise(n).alias("total_accidents"),
        choose(total, 0.1, 0.4).alias("route_accident_score"),
        choose(density, 0.0, 0.0).alias("accident_density"),
        choose(seasonal, 0.1, None).alias("seasonal_risk"),
        choose(weather, 0.1, None).alias("weather_risk"),
        *[F.when(bad, 0).otherwise(F.col(name)).alias(name) for name in ("minor", "major", "fatal")],
    )


def accident_rows_on_routes(
    segments: DataFrame, accidents: DataFrame, as_of_time: str, window_days: int = 365
) -> DataFrame:
    """Accidents by route, segment, severity and weather, with their number.

    Accidents that agree in point, severity and weather are counted before the join, so the join
    carries counts and not single accidents.
    """
    end = clock.ntz(as_of_time)
    start = end - F.expr(f"INTERVAL {window_days} DAYS")
    grouped = (
        accidents.filter(F.col("date").between(start, end))
        .groupBy(
            F.col("latitude").alias("accident_lat"),
            F.col("longitude").alias("accident_lon"),
            "severity",
            "weather_conditions",
        )
        .agg(F.count("*").alias("accidents"))
    )
    kind = ("severity", "weather_conditions")
    return (
        _segment_sums(segments, grouped, ("accidents",), kind)
        .groupBy("route_id", "segment", *kind)
        .agg(F.sum("accidents").alias("accidents"))
    )


def _weather_scored(found: DataFrame) -> DataFrame:
    seen = F.col("weather")
    score = scores.weather_risk(
        seen["conditions"], seen["visibility_miles"], seen["precipitation_inches"], seen["wind_speed_mph"]
    )
    return (
        found.withColumn("weather_obs_id", seen["obs_id"])
        .withColumn("conditions", F.coalesce(seen["conditions"], F.lit("unknown")))
        .withColumn("weather_risk_score", F.when(seen.isNull(), 0.2).otherwise(score))
        .withColumn("weather_risk_level", scores.service_category(F.col("weather_risk_score")))
        .drop("weather")
    )


def _traffic_scored(found: DataFrame) -> DataFrame:
    seen = F.col("traffic")
    rush = clock.is_context_rush_hour(F.col("timestamp"))
    return (
        found.withColumn("traffic_obs_id", seen["obs_id"])
        .withColumn("is_context_rush_hour", rush)
        .withColumn(
            "congestion_risk_score",
            scores.congestion_risk(seen["average_speed_mph"], seen["typical_speed_mph"], rush),
        )
        .withColumn("traffic_risk_level", scores.service_category(F.col("congestion_risk_score")))
        .drop("traffic")
    )


def observed_at(
    requests: DataFrame,
    weather: DataFrame | None = None,
    traffic: DataFrame | None = None,
    weather_age_seconds: int | None = None,
    traffic_age_seconds: int | None = None,
) -> DataFrame:
    """Weather and congestion scores of each request from the latest observations of its station, in one pass."""
    sources = {"weather": (weather, weather_age_seconds, _weather_scored), "traffic": (traffic, traffic_age_seconds, _traffic_scored)}
    given = {name: source for name, source in sources.items() if source[0] is not None}
    found = as_of_tables(
        requests, ("station_id",), "timestamp", {name: (rows, "obs_ts", "obs_id") for name, (rows, _, _) in given.items()}
    )
    for name, (_, age, scored) in given.items():
        found = scored(not_older(found, "timestamp", name, "obs_ts", age))
    return found


def weather_at(
    requests: DataFrame, observations: DataFrame, max_age_seconds: int | None = None
) -> DataFrame:
    """Weather score of each request from the latest observation of its station."""
    return observed_at(requests, weather=observations, weather_age_seconds=max_age_seconds)


def traffic_at(
    requests: DataFrame, observations: DataFrame, max_age_seconds: int | None = None
) -> DataFrame:
    """Congestion score of each request from the latest observation of its station."""
    return observed_at(requests, traffic=observations, traffic_age_seconds=max_age_seconds)


def demographic_factors(requests: DataFrame, census: DataFrame) -> DataFrame:
    """Demographic multiplier by zip code; unknown codes get 1.

    Missing values count as 50,000 income, 1,000 density and age 35 in the factors, but are shown
    as 0.
    """
    known = census.withColumn("_known", F.lit(True))
    joined = requests.join(known, "zip_code", "left")
    factors = {
        "income_factor": scores.income_factor(F.col("median_income")),
        "density_factor": scores.density_factor(F.col("population_density")),
        "age_factor": scores.median_age_factor(F.col("median_age")),
        "risk_multiplier": scores.demographic_multiplier(
            F.col("median_income"), F.col("population_density"), F.col("median_age")
        ),
    }
    shown = (
        "population_density", "median_age", "median_income", "unemployment_rate",
        "vehicles_per_capita", "college_educated_pct",
    )
    return (
        joined.withColumns(
            {name: F.when(F.col("_known"), value).otherwise(1.0) for name, value in factors.items()}
        )
        .withColumns({name: F.coalesce(name, F.lit(0.0)) for name in shown})
        .drop("_known")
    )


def combine(
    requests: DataFrame, crime: DataFrame | None = None, route_scores: DataFrame | None = None
) -> DataFrame:
    """Context score of each request; a source without a value counts with its default.

    ``requests`` carry ``weather_risk_score`` and ``congestion_risk_score`` from ``observed_at``; places and routes are joined here. Requests without a route take 0.5 for accidents
    and a lower confidence.
    """
    joined = requests
    if crime is not None:
        joined = joined.join(crime.select(*PLACE, "crime_risk_score"), [*PLACE], "left")
    if route_scores is not None:
        joined = joined.join(route_scores.select("route_id", "route_accident_score"), "route_id", "left")

    def source(name: str, default: float) -> Column:
        return F.coalesce(name, F.lit(default)) if name in joined.columns else F.lit(default)

    routed = F.col("route_id").isNotNull() if "route_id" in joined.columns else F.lit(False)
    scored = (
        joined.withColumn("crime_risk", source("crime_risk_score", 0.3))
        .withColumn("weather_risk", source("weather_risk_score", 0.2))
        .withColumn("traffic_risk", source("congestion_risk_score", 0.3))
        .withColumn("_accident", F.when(routed, source("route_accident_score", 0.4)))
    )
    total = scores.combined_context_score(
        F.col("crime_risk"), F.col("weather_risk"), F.col("traffic_risk"), F.col("_accident")
    )
    return (
        scored.withColumn("accident_risk", F.coalesce("_accident", F.lit(0.5)))
        .withColumn("contextual_risk_score", total)
        .withColumn("risk_level", scores.service_category(F.col("contextual_risk_score")))
        .withColumn("confidence", scores.context_confidence(F.col("_accident")))
        .withColumn("recommendations", text.context_advice(F.col("contextual_risk_score")))
        .drop("_accident")
    )
