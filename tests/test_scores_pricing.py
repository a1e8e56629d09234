"""Category cuts, rating bands, premiums and portfolio numbers at their boundaries."""

from __future__ import annotations

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from roadrisk.functions import scores as s, text
from roadrisk.operators import feeds, pricing


def values(spark, column, cells, kind="double"):
    df = spark.createDataFrame([(n, c) for n, c in enumerate(cells)], f"n int, x {kind}")
    return [r[0] for r in df.orderBy("n").select(column(F.col("x"))).collect()]


NAN = float("nan")


@pytest.mark.parametrize(
    "function, cells, want",
    [
        (s.training_category, [0.33, 0.331, 0.67, 0.671, NAN, None], ["low", "medium", "medium", "high", "high", "high"]),
        (s.service_category, [0.29, 0.3, 0.69, 0.7, NAN], ["low", "medium", "medium", "high", "high"]),
        (s.risk_level, [0.19, 0.2, 0.4, 0.6, 0.8, 1.5], ["very_low", "low", "medium", "high", "very_high", "very_high"]),
        (s.age_group, [15, 16, 25, 26, 65, 66, 100, 101], ["unknown", "16-25", "16-25", "26-35", "56-65", "66-100", "66-100", "unknown"]),
        (pricing.mileage_adjustment, [0, 5000, 5000.5, 5001, 15000, 20001, 30000.5, 30001, -1, None], [0.8, 0.8, 1.0, 0.9, 1.0, 1.3, 1.0, 1.5, 1.0, 1.0]),
        (lambda c: s.clamp(c, 0.0, 1.0), [-1.0, 0.4, 2.0, None], [0.0, 0.4, 1.0, None]),
        (s.income_factor, [29999, 30000, 80000, 80001, None], [1.2, 1.0, 1.0, 0.9, 1.0]),
        (s.density_factor, [499, 500, 3000, 3001, None], [0.95, 1.0, 1.0, 1.1, 1.0]),
        (s.median_age_factor, [29, 30, 45, 46, None], [1.05, 1.0, 1.0, 0.95, 1.0]),
    ],
)
def test_cuts(spark, function, cells, want):
    assert values(spark, function, [None if c is None else float(c) for c in cells]) == want


def test_congestion(spark):
    rows = [(30.0, 60.0, False), (30.0, 60.0, True), (0.0, 50.0, True), (60.0, 50.0, False), (30.0, 0.0, True), (None, 1.0, True)]
    df = spark.createDataFrame(rows, "a double, t double, r boolean")
    got = [r[0] for r in df.select(s.congestion_risk(F.col("a"), F.col("t"), F.col("r"))).collect()]
    assert got == pytest.approx([0.5, 0.65, 1.0, -0.2, 0.3, 0.3])


def test_weather_score(spark):
    rows = [("fog", 0.9, 0.6, 26.0), ("rain", 1.0, 0.5, 25.0), ("clear", 3.0, 0.0, 0.0), (None, None, None, None)]
    df = spark.createDataFrame(rows, "c string, v double, p double, w double")
    got = [r[0] for r in df.select(s.weather_risk(*[F.col(n) for n in "cvpw"])).collect()]
    assert got == pytest.approx([0.9, 0.4, 0.0, 0.0])


def test_context_advice(spark):
    assert [len(v) for v in values(spark, text.context_advice, [0.4, 0.41, 0.7, 0.71])] == [0, 1, 1, 2]


PROFILE = "driver_id string, age int, vehicle_type string, vehicle_year int, location_zip string"
FEATURES = (
    "driver_id string, total_mileage double, night_driving_ratio double, weekend_driving_ratio double, rush_hour_ratio double,"
    " weather_risk_score double, harsh_braking_count long, harsh_acceleration_count long, over_speed_ratio double, phone_usage_ratio double"
)


def portfolio(spark):
    profiles = spark.createDataFrame(
        [("a", 20, "luxury", 2015, "10001"), ("b", 40, "van", 2027, "nowhere"), ("c", 70, None, 2025, "90210")], PROFILE
    )
    scores = spark.createDataFrame([("a", 0.9), ("b", 0.1), ("c", 0.5)], "driver_id string, risk_score double")
    features = spark.createDataFrame(
        [
            ("a", 31000.0, 1.0, 1.0, 1.0, 1.8, 3, 4, 0.25, 0.5),
            ("b", 100.0, 0.0, 0.0, 0.0, 1.0, 0, 0, 0.0, 0.0),
            ("c", None, None, 0.5, None, None, 1, 1, 0.1, 0.1),
        ],
        FEATURES,
    )
    claims = spark.createDataFrame([("a",), ("a",), ("z",)], "driver_id string")
    zips = spark.createDataFrame(
        [("10001", 30, 5.2, 12.5), ("90210", 0, 1.1, 20.0)],
        "zip string, snow_days int, theft_rate double, accidents_per_1000 double",
    )
    return profiles, scores, features, claims, zips


def test_premium_by_hand(spark):
    got = {r["driver_id"]: r for r in pricing.price_all(*portfolio(spark), "2025-02-01 00:00:00").collect()}
    assert got["a"]["base_premium"] == pytest.approx(1200 * 1.5 * 1.2 * 1.6)
    assert got["a"]["final_premium"] == 5000.0 and got["a"]["details"]["base_premium_factors"]["claims_count"] == 2
    assert got["a"]["contextual_adjustment"] == pytest.approx(1.4 + 0.2 + 0.125)
    assert got["b"]["base_premium"] == pytest.approx(800 * 0.96)
    assert got["b"]["final_premium"] == pytest.approx(800 * 0.96 * 0.6 * 0.8)
    assert got["c"]["mileage_adjustment"] == 1.0 and got["c"]["temporal_adjustment"] == pytest.approx(1.05)
    assert got["c"]["contextual_adjustment"] == pytest.approx(1.0 + 0.11 + 0.15)
    words = pricing.premiums(
        pricing.with_zip_context(
            pricing.with_claims_count(pricing.pricing_inputs(*portfolio(spark)[:3]), portfolio(spark)[3]), portfolio(spark)[4]
        ),
        "2025-02-01",
    ).withColumn("t", text.premium_explanation())
    lines = words.filter("driver_id = 'a'").first()["t"].split("\n")
    assert lines[0] == "Premium Calculation for Driver a" and lines[4] == "Risk Level: Very_High (Score: 0.900)"
    assert "  Over Speed Ratio: 25.0%" in lines and lines[-1] == ""


def test_inputs_must_line_up(spark):
    profiles, scores, features, *_ = portfolio(spark)
    with pytest.raises(ValueError):
        pricing.pricing_inputs(profiles, scores.filter("driver_id <> 'a'"), features)
    with pytest.raises(ValueError):
        pricing.pricing_inputs(profiles, scores.union(scores.limit(1)), features)


def test_premium_change(spark):
    df = spark.createDataFrame(
        [(100.0, 104.99), (100.0, 105.0), (100.0, 95.0), (100.0, 95.01), (0.0, 50.0)], "current_premium double, new_premium double"
    )
    rows = pricing.premium_changes(df, "2024-02-01").collect()
    assert [r["change_category"] for r in rows] == ["minimal", "increase", "decrease", "minimal", None]
    assert str(rows[0]["effective_date"]) == "2024-03-02 00:00:00" and rows[4]["change_percentage"] is None


def test_quotes(spark):
    df = spark.createDataFrame(
        [(24, "luxury", 20000.0, 0.9), (25, None, None, 0.3), (65, "compact", 4999.0, None)],
        "age int, vehicle_type string, annual_mileage double, risk_score double",
    ).withColumn("driver_id", F.lit("d"))
    got = [r["final_premium"] for r in pricing.quotes(df).collect()]
    demo = ((65 - 16) / 70 + 4999 / 30000) / 2
    assert got == pytest.approx([1200 * 1.5 * 1.5 * 1.2, 880.0, 700 * 1.2 * (1.0 if demo >= 0.3 else 0.7) * 0.8])
    jittered = pricing.with_demo_scores(df, jitter=0.1).collect()[2]["risk_score"]
    assert abs(jittered - demo) <= 0.1


def test_overview_defaults(spark):
    none = spark.createDataFrame([], "driver_id string")
    priced = spark.createDataFrame([], "risk_score double, final_premium double")
    row = feeds.overview(none, priced).first().asDict()
    assert (row["total_drivers"], row["total_trips"], row["average_premium"], row["active_policies"]) == (10, 50, 850.0, 15)


def test_required_fields(spark):
    df = spark.createDataFrame([("p", None, None), ("p", "d", "c")], "policy_number string, driver_id string, coverage_details string")
    bad = feeds.quarantined(df, ("policy_number", "driver_id", "coverage_details")).collect()
    assert [(r["message"], r["first_message"]) for r in bad] == [
        ("Missing required fields: driver_id, coverage_details", "driver_id is required")
    ]
    assert feeds.accepted(df, ("driver_id",)).count() == 1


def test_webhook_totals_join_types_and_not_events(spark):
    """As many rows meet the subscriptions as there are types; repeated subscriptions, events without a type or id, repeated events."""
    events = spark.createDataFrame(
        [(k, "a") for k in range(50)] + [(7, "a"), (60, "b"), (None, "b"), (61, "c"), (62, None)], "event_id long, event_type string"
    )
    kind = "webhook_id long, partner_name string, is_active boolean, events array<string>, created_at timestamp_ntz"
    day = datetime(2024, 1, 1)
    subscriptions = spark.createDataFrame(
        [(1, "p", True, ["a", "b", "a"], day), (2, "q", True, ["a"], day), (2, "q", True, ["a"], day), (None, None, True, ["b"], day),
         (3, "p", False, ["a"], day), (4, "p", True, [None, "d"], day), (5, "p", True, ["a"], datetime(2023, 1, 1))],
        kind,
    )
    got = feeds.webhook_totals(events, subscriptions, "2024-01-02 00:00:00")
    rows = {(r["event_type"], r["webhook_id"], r["partner_name"]): (r["events"], r["first_event"], r["last_event"]) for r in got.collect()}
    assert rows == {
        ("a", 1, "p"): (51, 0, 49), ("a", 2, "q"): (102, 0, 49), ("b", 1, "p"): (2, 60, 60), ("b", None, None): (2, 60, 60),
    }
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Join") < plan.index("count(1)")  # counted below the join
    fanned = feeds.webhook_fanout(events, subscriptions, "2024-01-02 00:00:00")
    assert fanned.count() == sum(n for n, _, _ in rows.values())
