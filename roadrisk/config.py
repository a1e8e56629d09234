"""Settings of the operators; every operator takes them as keyword arguments."""

from __future__ import annotations

from dataclasses import dataclass

# Category weights, limits, rating tables, scores and texts that results depend on.
WEATHER_WEIGHTS = {"clear": 1.0, "rain": 1.3, "snow": 1.8, "fog": 1.5}
ROAD_WEIGHTS = {"highway": 1.2, "urban": 1.0, "suburban": 0.9, "rural": 1.1}
SPEED_LIMITS = {"residential": 25, "arterial": 35, "highway": 65, "interstate": 75}
DEFAULT_SPEED_LIMIT = 35

VEHICLE_BASE = {"sedan": 800, "suv": 900, "truck": 1000, "compact": 700, "luxury": 1200}
DEFAULT_VEHICLE_BASE = 800
AGE_BANDS = ((16, 25, 1.5), (26, 35, 1.1), (36, 55, 1.0), (56, 65, 0.9), (66, 100, 1.2))
MILEAGE_TIERS = (
    (0, 5000, 0.8),
    (5001, 10000, 0.9),
    (10001, 15000, 1.0),
    (15001, 20000, 1.1),
    (20001, 30000, 1.3),
    (30001, float("inf"), 1.5),
)
RISK_MULTIPLIERS = {"very_low": 0.6, "low": 0.8, "medium": 1.0, "high": 1.4, "very_high": 2.0}
RISK_LEVEL_TITLES = {
    "very_low": "Very_Low",
    "low": "Low",
    "medium": "Medium",
    "high": "High",
    "very_high": "Very_High",
}
CONTEXT_WEIGHTS = {"crime": 0.25, "weather": 0.30, "traffic": 0.25, "accidents": 0.20}
EVENT_ALERTS = {
    "harsh_braking": "Harsh braking detected",
    "harsh_acceleration": "Harsh acceleration detected",
    "speeding": "Speeding: {speed} mph in {limit} mph zone",
    "phone_usage": "Phone usage while driving",
}
PATTERN_ALERTS = {
    "pattern_harsh_driving": "Pattern of harsh driving detected",
    "pattern_speeding": "Repeated speeding violations detected",
}
HIGH_RISK_ADVICE = (
    "Consider avoiding this area during peak hours",
    "Use extra caution due to high risk factors",
)
MEDIUM_RISK_ADVICE = "Moderate risk area - drive defensively"
PORTFOLIO_ADVICE = {
    "many_high": "Consider additional driver training programs to reduce high-risk population",
    "many_low": "Opportunity to attract more low-risk drivers with competitive pricing",
    "wide_spread": "High premium variance suggests good risk differentiation",
}
ALERT_MESSAGE = "Risk Alert for Driver {driver}: {alerts}"
ALERT_SUBJECT = "Telematics Risk Alert - {severity}"
MISSING_FIELDS = "Missing required fields: {names}"
FIRST_MISSING = "{name} is required"
BATCH_TOO_LARGE = "Maximum batch size is {cap} drivers"
PREMIUM_TEXT = (
    ("Premium Calculation for Driver %s", "driver_id"),
    ("==================================================",),
    ("",),
    ("Base Premium: $%.2f", "base_premium"),
    ("Risk Level: %s (Score: %.3f)", "risk_title", "risk_score"),
    ("Risk Multiplier: %sx", "risk_multiplier"),
    ("",),
    ("Adjustments:",),
    ("  Mileage: %.3fx", "mileage_adjustment"),
    ("  Temporal: %.3fx", "temporal_adjustment"),
    ("  Contextual: %.3fx", "contextual_adjustment"),
    ("",),
    ("Final Premium: $%.2f", "final_premium"),
    ("",),
    ("Driving Behavior Highlights:",),
    ("  Harsh Braking Events: %s", "harsh_braking_count"),
    ("  Harsh Acceleration Events: %s", "harsh_acceleration_count"),
    ("  Over Speed Ratio: %.1f%%", "over_speed_percent"),
    ("  Phone Usage Ratio: %.1f%%", "phone_usage_percent"),
    ("",),
)
REQUIRED_UPLOAD_FIELDS = ("driver_id", "trip_data")
REQUIRED_POLICY_FIELDS = ("policy_number", "driver_id", "coverage_details")

ML_FEATURES = (
    "total_mileage", "avg_trip_distance", "avg_speed", "max_speed", "speed_variance",
    "over_speed_events", "over_speed_ratio", "harsh_braking_count", "harsh_acceleration_count",
    "avg_acceleration", "max_deceleration", "night_driving_ratio", "weekend_driving_ratio",
    "rush_hour_ratio", "weather_risk_score", "road_type_risk_score", "phone_usage_events",
    "phone_usage_ratio", "trip_frequency", "avg_trip_duration", "long_trip_ratio",
)


@dataclass(frozen=True)
class TripRules:
    """Thresholds of cleaning and trip features."""

    max_speed_mph: float = 200.0
    min_trip_minutes: float = 2.0
    long_trip_minutes: float = 60.0
    speed_tolerance_mph: float = 5.0
    harsh_braking_ms2: float = -3.0
    harsh_acceleration_ms2: float = 3.0
    night_hours: tuple[int, int] = (22, 6)
    rush_hours: tuple[tuple[int, int], ...] = ((7, 9), (17, 19))


@dataclass(frozen=True)
class StreamRules:
    """Scores and thresholds of live events."""

    speed_factor: float = 1.2
    braking_score: float = 0.1
    acceleration_score: float = 0.08
    speeding_score: float = 0.15
    phone_score: float = 0.12
    pattern_count: int = 3
    pattern_rows: int = 11
    harsh_pattern_score: float = 0.2
    speeding_pattern_score: float = 0.25
    rolling_rows: int = 100
    severe_above: float = 0.3


@dataclass(frozen=True)
class PricingRules:
    """Bounds and rates of the premium formula."""

    vehicle_year_rate: float = 0.02
    claim_rate: float = 0.3
    min_premium: float = 300.0
    max_premium: float = 5000.0
    default_mileage: float = 12000.0
    update_days: int = 30


@dataclass(frozen=True)
class ModelRules:
    """Hyper-parameters of the trained models."""

    test_share: int = 5  # one driver in five is held out
    seed: int = 42
    trees: int = 50
    forest_depth: int = 10
    rounds: int = 50
    boosting_depth: int = 6
    learning_rate: float = 0.1
    inverse_penalty: float = 1.0
    max_iterations: int = 1000
    min_rows: int = 5
    noise_sd: float = 0.1


TRIP_RULES = TripRules()
STREAM_RULES = StreamRules()
PRICING_RULES = PricingRules()
MODEL_RULES = ModelRules()

# Time slots split a long history so that one busy key never becomes one task.
SLOT_SECONDS = 3600
# Rolling frames are computed in stretches of this many rows of one key.
STRETCH_ROWS = 100_000
# Points that one task of a shuffle sorts in memory; more points mean more partitions.
POINTS_PER_TASK = 1_000_000
