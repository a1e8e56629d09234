"""Score formulas and category cuts.

The category functions have different cut points and comparison directions on purpose; they are
separate operators and must not be merged.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, functions as F

from roadrisk.config import AGE_BANDS, CONTEXT_WEIGHTS


def lookup(key: Column, values: Mapping[str, float], default: float) -> Column:
    """Value of a small fixed table; unknown and null keys get the default."""
    chain = None
    for name, value in values.items():
        hit = key == name
        chain = F.when(hit, F.lit(value)) if chain is None else chain.when(hit, F.lit(value))
    return F.lit(default) if chain is None else chain.otherwise(F.lit(default))


def band(value: Column, bands: tuple[tuple[float, float, object], ...], default: object) -> Column:
    """Result of the first closed band that holds the value."""
    chain = None
    for low, high, result in bands:
        inside = (value >= F.lit(low)) & (value <= F.lit(high))
        chain = F.when(inside, F.lit(result)) if chain is None else chain.when(inside, F.lit(result))
    return chain.otherwise(F.lit(default))


def below(value: Column, cuts: tuple[tuple[float, object], ...], otherwise: object) -> Column:
    """Result of the first cut that lies strictly above the value; null goes to ``otherwise``."""
    chain = None
    for cut, result in cuts:
        hit = value < F.lit(cut)
        chain = F.when(hit, F.lit(result)) if chain is None else chain.when(hit, F.lit(result))
    return chain.otherwise(F.lit(otherwise))


def clamp(value: Column, low: float, high: float) -> Column:
    """Value inside the bounds; null stays null (``greatest`` and ``least`` alone skip it)."""
    return F.when(value.isNotNull(), F.greatest(F.lit(low), F.least(value, F.lit(high))))


def capped(value: Column, cap: float = 1.0) -> Column:
    return F.when(value.isNotNull(), F.least(value, F.lit(cap)))


def training_category(score: Column) -> Column:
    """Closed cuts of the training target; missing scores are high."""
    usable = score.isNotNull() & ~F.isnan(score)
    return (
        F.when(usable & (score <= 0.33), "low").when(usable & (score <= 0.67), "medium").otherwise("high")
    )


def service_category(score: Column) -> Column:
    return below(score, ((0.3, "low"), (0.7, "medium")), "high")


def risk_level(score: Column) -> Column:
    """Five levels used for pricing."""
    return below(score, ((0.2, "very_low"), (0.4, "low"), (0.6, "medium"), (0.8, "high")), "very_high")


def age_group(age: Column) -> Column:
    return band(age, tuple((lo, hi, f"{lo}-{hi}") for lo, hi, _ in AGE_BANDS), "unknown")


def weather_risk(
    conditions: Column, visibility: Column, precipitation: Column, wind: Column
) -> Column:
    sky = lookup(conditions, {"rain": 0.3, "snow": 0.3, "fog": 0.4}, 0.0)
    sight = below(visibility, ((1.0, 0.2), (3.0, 0.1)), 0.0)
    wet = F.when(precipitation > 0.5, 0.2).otherwise(0.0)
    windy = F.when(wind > 25, 0.1).otherwise(0.0)
    return capped(sky + sight + wet + windy)


def congestion_risk(
    average_speed: Column, typical_speed: Column, rush: Column, default: float = 0.3
) -> Column:
    """Share of typical speed lost, raised in rush hours; may be negative."""
    slowdown = 1.0 - average_speed / F.nullif(typical_speed, F.lit(0.0))
    return F.coalesce(capped(slowdown * F.when(rush, 1.3).otherwise(1.0)), F.lit(default))


def income_factor(income: Column) -> Column:
    income = F.coalesce(income, F.lit(50000.0))
    return F.when(income < 30000, 1.2).when(income > 80000, 0.9).otherwise(1.0)


def density_factor(density: Column) -> Column:
    density = F.coalesce(density, F.lit(1000.0))
    return F.when(density > 3000, 1.1).when(density < 500, 0.95).otherwise(1.0)


def median_age_factor(age: Column) -> Column:
    age = F.coalesce(age, F.lit(35.0))
    return F.when(age < 30, 1.05).when(age > 45, 0.95).otherwise(1.0)


def demographic_multiplier(income: Column, density: Column, age: Column) -> Column:
    product = income_factor(income) * density_factor(density) * median_age_factor(age)
    return clamp(product, 0.7, 1.5)


def combined_context_score(
    crime: Column, weather: Column, traffic: Column, accidents: Column
) -> Column:
    """Weighted sum of the sources; without a route the accident share is one half."""
    parts = {
        "crime": crime,
        "weather": weather,
        "traffic": traffic,
        "accidents": F.coalesce(accidents, F.lit(0.5)),
    }
    total = None
    for name, score in parts.items():
        term = score * CONTEXT_WEIGHTS[name]
        total = term if total is None else total + term
    return total


def context_confidence(accidents: Column) -> Column:
    return F.when(accidents.isNull(), 0.7).otherwise(0.8)


def stable_fallback_score(driver_id: Column) -> Column:
    """Repeatable stand-in score of a driver without one: 0.3 to 0.795 in steps of 0.005."""
    bucket = F.conv(F.substring(F.md5(driver_id), 1, 8), 16, 10).cast("bigint") % 100
    return 0.3 + bucket / 200.0
