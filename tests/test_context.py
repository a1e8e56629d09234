"""Box joins and context scores against brute force."""

from __future__ import annotations

import math
import random
from datetime import datetime, timedelta

import pytest

from roadrisk.operators import context

NOW = datetime(2001, 8, 1)


def incidents(rng, n, hot=0.4):
    rows = []
    for k in range(n):
        if rng.random() < hot:  # one point holds many of them
            lat, lon = 40.5, -73.5
        else:
            lat, lon = round(40 + rng.random(), 3), round(-74 + rng.random(), 3)
        kind = rng.choice(["theft", "assault", "robbery", "Motor_VEHICLE_theft", "arson", None])
        rows.append((k, kind, "minor", lat, lon, NOW - timedelta(days=rng.randint(-3, 60), hours=rng.randint(0, 23))))
    return rows


@pytest.mark.parametrize("newest", [None, 15, 1000])
@pytest.mark.parametrize("radius", [2.0, 5.0])
def test_crime_in_box(spark, newest, radius):
    rng = random.Random(5)
    rows = incidents(rng, 500)
    places = sorted({(round(40 + rng.random(), 2), round(-74 + rng.random(), 2)) for _ in range(20)} | {(40.5, -73.5)})
    df = spark.createDataFrame(rows, "incident_id long, incident_type string, severity string, latitude double, longitude double, date timestamp_ntz")
    lookups = spark.createDataFrame(places, "latitude double, longitude double")
    pairs = context.crime_in_box(lookups, df, radius, newest).collect()
    got = {}
    for r in pairs:
        got.setdefault((r["latitude"], r["longitude"]), set()).add(r["incident_id"])
    assert len(pairs) == sum(len(v) for v in got.values())
    for lat, lon in places:
        dlat, dlon = radius / 69.0, radius / (69.0 * math.cos(math.radians(lat)))
        inside = [r for r in rows if abs(r[3] - lat) <= dlat and abs(r[4] - lon) <= dlon]
        inside.sort(key=lambda r: (r[5], r[0]), reverse=True)
        assert got.get((lat, lon), set()) == {r[0] for r in inside[:newest]}


def test_boxes_near_the_pole_and_the_date_line(spark):
    rows = [(1, "theft", "minor", 89.99, 170.0, NOW), (2, "theft", "minor", 0.0, 179.99, NOW)]
    df = spark.createDataFrame(rows, "incident_id long, incident_type string, severity string, latitude double, longitude double, date timestamp_ntz")
    lookups = spark.createDataFrame([(89.999, -170.0), (0.0, 179.95), (0.0, -179.95)], "latitude double, longitude double")
    got = {(r["latitude"], r["longitude"], r["incident_id"]) for r in context.crime_in_box(lookups, df).collect()}
    assert got == {(89.999, -170.0, 1), (0.0, 179.95, 2)}


def test_crime_scores(spark):
    rows = [(k, "assault", "minor", 40.0, -74.0, NOW - timedelta(days=30, hours=23)) for k in range(25)]
    rows += [(100 + k, "Vehicle_Theft", "minor", 40.0, -74.0, NOW - timedelta(days=31)) for k in range(4)]
    df = spark.createDataFrame(rows, "incident_id long, incident_type string, severity string, latitude double, longitude double, date timestamp_ntz")
    lookups = spark.createDataFrame([(40.01, -74.01), (10.0, 10.0)], "latitude double, longitude double")
    got = {r["latitude"]: r for r in context.crime_risk(lookups, df, "2001-08-01").collect()}
    near = got[40.01]
    assert (near["recent"], near["violent_score"], near["vehicle_theft_score"]) == (25, 1.0, 0.4)
    assert near["crime_risk_score"] == pytest.approx((0.4 + 0.2 * 0.4 + 0.1 * 0.29 + 0.2) / 1.2)
    assert got[10.0]["crime_risk_score"] == 0.1 and got[10.0]["frequency_factor"] == 0.1


ACCIDENT = "severity string, weather_conditions string, latitude double, longitude double, date timestamp_ntz"


def test_accident_scores(spark):
    route = spark.createDataFrame(
        [(1, k, 40.0 + 0.2 * k, -74.0) for k in range(3)] + [(2, k, 10.0, 10.0 + k) for k in range(2)] + [(3, 0, 50.0, 0.0), (3, 1, 50.1, 0.1)],
        "route_id long, seq long, latitude double, longitude double",
    )
    day = lambda n: NOW - timedelta(days=n)
    rows = [
        ("fatal", "rain", 40.1, -74.0, day(90)),
        ("minor", "clear", 40.2, -74.0, day(91)),  # on the border of both segments
        ("major", "fog", 40.3, -74.0, day(365)),
        ("major", "fog", 40.3, -74.0, day(366)),
        ("minor", "fog", 40.3, -74.1, day(1)),
        ("odd", "fog", 50.05, 0.05, day(1)),
    ]
    accidents = spark.createDataFrame(rows, ACCIDENT)
    got = {r["route_id"]: r for r in context.accident_risk(route, accidents, "2001-08-01").collect()}
    miles = 3958.7613 * math.radians(0.4)
    one = got[1]
    assert one["total_accidents"] == 4 and (one["minor"], one["major"], one["fatal"]) == (2, 1, 1)
    assert one["accident_density"] == pytest.approx(4 / miles)
    assert one["route_accident_score"] == pytest.approx(
        min(1.0, 0.3 * 4 / miles + 0.4 * (0.2 + 0.3 + 1.0) / 4 + 0.2 * 0.1 + 0.1 * 1.0)
    )
    assert got[2]["route_accident_score"] == 0.1 and got[2]["seasonal_risk"] == 0.1
    assert got[3]["route_accident_score"] == 0.4 and got[3]["total_accidents"] == 0
    segments = context.route_segments(route)
    counted = context.accident_rows_on_routes(segments, accidents, "2001-08-01")
    assert sum(r["accidents"] for r in counted.filter("route_id = 1").collect()) == 4


def test_missing_sources_take_defaults(spark):
    asked = spark.createDataFrame([(1, 40.0, -74.0, 7), (2, 40.0, -74.0, None)], "request_id long, latitude double, longitude double, route_id long")
    got = {r["request_id"]: r for r in context.combine(asked).collect()}
    base = 0.25 * 0.3 + 0.3 * 0.2 + 0.25 * 0.3
    assert got[1]["contextual_risk_score"] == pytest.approx(base + 0.2 * 0.4) and got[1]["confidence"] == 0.8
    assert got[2]["contextual_risk_score"] == pytest.approx(base + 0.2 * 0.5) and got[2]["confidence"] == 0.7


def test_unknown_zip(spark):
    asked = spark.createDataFrame([("x",), ("y",)], "zip_code string")
    census = spark.createDataFrame(
        [("x", None, 25.0, 20000.0, 0.1, 1.0, 0.2)],
        "zip_code string, population_density double, median_age double, median_income double, unemployment_rate double, vehicles_per_capita double, college_educated_pct double",
    )
    got = {r["zip_code"]: r for r in context.demographic_factors(asked, census).collect()}
    assert got["x"]["risk_multiplier"] == pytest.approx(1.26) and got["x"]["population_density"] == 0.0
    assert got["y"]["risk_multiplier"] == 1.0 and got["y"]["income_factor"] == 1.0
