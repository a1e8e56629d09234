"""Cleaning, trip and driver features against independent NumPy values and boundary cases."""

from __future__ import annotations

from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from roadrisk import schemas
from roadrisk.functions import clock
from roadrisk.functions.geo import haversine_miles
from roadrisk.operators import cleaning, trips
from tests.conftest import plain_rows

DAY = datetime(2024, 3, 9, 23, 30)


def points(spark, rows):
    base = dict(
        driver_id="d", trip_id="t", latitude=40.0, longitude=-74.0, speed_mph=30.0, acceleration_ms2=0.0,
        speed_limit_mph=30.0, road_type="urban", weather="clear", time_of_day="night", harsh_braking=0,
        harsh_acceleration=0, phone_usage=0, over_speed_limit=0,
    )
    data = []
    for n, row in enumerate(rows):
        full = {**base, "seq": n, "timestamp": DAY + timedelta(minutes=n), **row}
        data.append(tuple(full[f.name] for f in schemas.POINTS.fields))
    return spark.createDataFrame(data, schemas.POINTS)


def one(df):
    rows = df.collect()
    assert len(rows) == 1
    return rows[0]


def great_circle(lat1, lon1, lat2, lon2):
    p, q = np.radians([lat1, lon1]), np.radians([lat2, lon2])
    u = [np.cos(p[0]) * np.cos(p[1]), np.cos(p[0]) * np.sin(p[1]), np.sin(p[0])]
    v = [np.cos(q[0]) * np.cos(q[1]), np.cos(q[0]) * np.sin(q[1]), np.sin(q[0])]
    return 3959.0 * np.arctan2(np.linalg.norm(np.cross(u, v)), np.dot(u, v))


def test_haversine_agrees_with_vectors(spark):
    cases = [(40.0, -74.0, 40.1, -74.2), (0.0, 0.0, 0.0, 179.0), (-33.9, 18.4, 51.5, -0.1), (10.0, 10.0, 10.0, 10.0)]
    df = spark.createDataFrame(cases, "a double, b double, c double, d double")
    got = [r[0] for r in df.select(haversine_miles(F.col("a"), F.col("b"), F.col("c"), F.col("d"))).collect()]
    assert got == pytest.approx([great_circle(*c) for c in cases], abs=1e-6)


def test_validity_bounds_are_closed(spark):
    df = points(
        spark,
        [
            {"latitude": 90.0}, {"latitude": -90.0, "longitude": 180.0}, {"latitude": 90.01},
            {"longitude": -180.5}, {"latitude": None}, {"speed_mph": 0.0}, {"speed_mph": 200.0},
            {"speed_mph": 200.1}, {"speed_mph": -0.1}, {"speed_mph": None}, {"trip_id": None},
        ],
    )
    kept = {r["seq"] for r in cleaning.valid_points(df).collect()}
    assert kept == {0, 1, 5, 6}


def test_trip_length_is_measured_on_valid_points(spark):
    exact = points(spark, [{}, {}, {}])
    assert trips.trip_features(cleaning.valid_points(exact)).count() == 1
    cut = points(spark, [{}, {}, {"speed_mph": 300.0}])
    assert trips.trip_features(cleaning.valid_points(cut)).count() == 0
    assert cleaning.clean(cut).count() == 0 and cleaning.clean(exact).count() == 3


def test_strict_thresholds(spark):
    df = points(
        spark,
        [
            {"acceleration_ms2": -3.0, "speed_mph": 35.0},
            {"acceleration_ms2": 3.0, "speed_mph": 35.01},
            {"acceleration_ms2": -3.01, "speed_limit_mph": None},
            {"acceleration_ms2": 3.01, "phone_usage": 1},
        ],
    )
    row = one(trips.trip_features(df))
    assert (row["harsh_braking_count"], row["harsh_acceleration_count"], row["over_speed_events"]) == (1, 1, 1)
    assert row["over_speed_ratio"] == 0.25 and row["phone_usage_ratio"] == 0.25


def test_time_flags_by_hour(spark):
    rows = [(datetime(2024, 3, 8, h, 59, 59),) for h in range(24)]
    df = spark.createDataFrame(rows, "t timestamp_ntz")
    got = df.select(
        clock.is_night(F.col("t")), clock.is_rush_hour(F.col("t")), clock.is_context_rush_hour(F.col("t"))
    ).collect()
    assert [h for h, r in enumerate(got) if r[0]] == [0, 1, 2, 3, 4, 5, 22, 23]
    assert [h for h, r in enumerate(got) if r[1]] == [7, 8, 17, 18]
    assert [h for h, r in enumerate(got) if r[2]] == [7, 8, 9, 17, 18, 19]


def test_sixty_minutes_are_not_long(spark):
    sixty = points(spark, [{}, {"timestamp": DAY + timedelta(minutes=60)}])
    more = points(spark, [{}, {"timestamp": DAY + timedelta(minutes=60, microseconds=1)}])
    assert one(trips.trip_features(sixty))["is_long_trip"] is False
    assert one(trips.trip_features(more))["is_long_trip"] is True


def test_mode_ties_and_nulls(spark):
    df = points(
        spark,
        [{"weather": "snow"}, {"weather": "rain"}, {"weather": None}, {"weather": None}, {"weather": None}],
    ).withColumn("road_type", F.lit(None).cast("string"))
    row = one(trips.trip_modes(df))
    assert row["weather_condition"] == "rain" and row["road_type"] is None
    weights = one(trips.category_weights(trips.trip_modes(df)))
    assert (weights["weather_weight"], weights["road_weight"]) == (1.3, 1.0)


def simulated(seed: int) -> pd.DataFrame:
    rng = np.random.default_rng(seed)
    rows = []
    for driver in range(4):
        for trip in range(3 if driver else 1):
            time = DAY + timedelta(days=int(rng.integers(0, 9)), seconds=int(rng.integers(0, 80_000)))
            lat, lon = 40 + rng.random(), -74 + rng.random()
            for seq in range(400 if driver == 0 else int(rng.integers(2, 30))):
                rows.append((f"d{driver}", f"t{driver}_{trip}", seq, time, lat, lon, float(rng.integers(-2, 90)), rng.normal(0, 2)))
                time += timedelta(seconds=int(rng.choice([1, 30, 120, 5000])))
                lat, lon = lat + rng.normal(0, 0.01), lon + rng.normal(0, 0.01)
    return pd.DataFrame(
        rows, columns="driver_id trip_id seq timestamp latitude longitude speed_mph acceleration_ms2".split()
    )


@pytest.mark.parametrize("slot", [60, 3600])
def test_features_against_numpy(spark, slot):
    """One driver has a single trip that spans many slots and holds most of the points."""
    pdf = simulated(11)
    extra = dict(speed_limit_mph=40.0, road_type="rural", weather="fog", time_of_day="day", phone_usage=0)
    raw = spark.createDataFrame(
        plain_rows(pdf),
        "driver_id string, trip_id string, seq long, timestamp timestamp_ntz, latitude double,"
        " longitude double, speed_mph double, acceleration_ms2 double",
    )
    raw = raw.withColumns({k: F.lit(v) for k, v in extra.items()})
    got = {r["driver_id"]: r for r in trips.features_of_all_drivers(raw, slot_seconds=slot).collect()}
    good = pdf[pdf["speed_mph"] >= 0]
    for driver, rows in good.groupby("driver_id"):
        means = []
        for _, trip in rows.groupby("trip_id"):
            trip = trip.sort_values("timestamp")
            minutes = (trip["timestamp"].iloc[-1] - trip["timestamp"].iloc[0]).total_seconds() / 60
            if minutes < 2:
                continue
            place = trip[["latitude", "longitude"]].to_numpy()
            miles = sum(great_circle(*place[k - 1], *place[k]) for k in range(1, len(place)))
            speed = trip["speed_mph"].to_numpy()
            means.append((miles, speed.mean(), speed.var(ddof=1), (speed > 45).mean(), minutes, (trip["acceleration_ms2"] < -3).sum()))
        table = np.array(means)
        row = got[driver]
        assert row["trip_frequency"] == len(table)
        assert row["total_mileage"] == pytest.approx(table[:, 0].sum(), rel=1e-9)
        assert row["avg_speed"] == pytest.approx(table[:, 1].mean())
        assert row["speed_variance"] == pytest.approx(table[:, 2].mean())
        assert row["over_speed_ratio"] == pytest.approx(table[:, 3].mean())
        assert row["avg_trip_duration"] == pytest.approx(table[:, 4].mean())
        assert row["harsh_braking_count"] == table[:, 5].sum()
        assert (row["weather_risk_score"], row["road_type_risk_score"]) == pytest.approx((1.5, 1.1))


def test_acceleration(spark):
    df = points(spark, [{"speed_mph": 10.0}, {"speed_mph": 20.0}, {"speed_mph": 15.0}])
    values = [r["computed_acceleration"] for r in cleaning.with_acceleration(df).orderBy("seq").collect()]
    assert values == pytest.approx([0.0, 4.4704, -2.2352])
    slow = cleaning.with_acceleration(df, per_second=True).orderBy("seq").collect()
    assert [r["computed_acceleration"] for r in slow] == pytest.approx([0.0, 4.4704 / 60, -2.2352 / 60])


def test_date_only_end_means_midnight(spark):
    df = points(spark, [{"timestamp": datetime(2024, 3, 9)}, {"timestamp": datetime(2024, 3, 9, 0, 0, 1)}])
    assert cleaning.in_date_range(df, end="2024-03-09").count() == 1


def test_unknown_driver_raises(spark):
    with pytest.raises(ValueError):
        cleaning.of_driver_or_fail(points(spark, [{}]), "nobody")


def test_failed_drivers_have_reasons(spark):
    raw = points(spark, [{}, {}, {}, {"driver_id": "short"}, {"driver_id": "broken", "speed_mph": -1.0}])
    features = trips.features_of_all_drivers(raw)
    got = {r["driver_id"]: r["reason"] for r in trips.failed_drivers(raw, features).collect()}
    assert got == {"short": "no trip long enough", "broken": "no valid points"}
