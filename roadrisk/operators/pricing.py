"""Premiums: rating factors, the premium formula, changes, quotes and portfolio analysis."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from roadrisk.config import (
    AGE_BANDS,
    DEFAULT_VEHICLE_BASE,
    MILEAGE_TIERS,
    PORTFOLIO_ADVICE,
    PRICING_RULES,
    RISK_MULTIPLIERS,
    VEHICLE_BASE,
    PricingRules,
)
from roadrisk.functions import clock, text
from roadrisk.functions.scores import age_group, band, below, clamp, lookup, risk_level, service_category
from roadrisk.operators.stats import exact_medians


def with_claims_count(profiles: DataFrame, claims: DataFrame) -> DataFrame:
    counts = claims.groupBy("driver_id").agg(F.count("*").alias("claims_count"))
    return profiles.join(counts, "driver_id", "left").withColumn(
        "claims_count", F.coalesce("claims_count", F.lit(0))
    )


def base_premium(as_of_year: int, rules: PricingRules = PRICING_RULES) -> Column:
    """Vehicle base × age band × vehicle age × claims; newer than the year lowers the price."""
    vehicle_age = F.lit(as_of_year) - F.col("vehicle_year")
    return (
        lookup(F.col("vehicle_type"), VEHICLE_BASE, DEFAULT_VEHICLE_BASE)
        * band(F.col("age"), AGE_BANDS, 1.0)
        * (1 + vehicle_age * rules.vehicle_year_rate)
        * (1 + F.col("claims_count") * rules.claim_rate)
    )


def mileage_adjustment(mileage: Column) -> Column:
    """Closed tiers; a value between two tiers keeps 1."""
    return band(mileage, MILEAGE_TIERS, 1.0)


def temporal_adjustment() -> Column:
    def share(name: str) -> Column:
        return F.coalesce(F.col(name), F.lit(0.0))

    return (
        1.0
        + share("night_driving_ratio") * 0.3
        + share("weekend_driving_ratio") * 0.1
        + share("rush_hour_ratio") * 0.2
    )


def with_zip_context(profiles: DataFrame, zip_context: DataFrame) -> DataFrame:
    """Optional lookups by zip code. No broadcast is forced: the side is one row per zip code, and
    the optimizer broadcasts it when its measured size is below the session's threshold."""
    return profiles.join(
        zip_context.select(
            F.col("zip").alias("location_zip"), "snow_days", "theft_rate", "accidents_per_1000"
        ),
        "location_zip",
        "left",
    )


def contextual_adjustment() -> Column:
    weather = F.when(
        F.col("snow_days").isNotNull(),
        1 + (F.coalesce("weather_risk_score", F.lit(1.0)) - 1) * 0.5,
    ).otherwise(1.0)
    theft = F.when(F.col("theft_rate").isNotNull(), F.least(F.col("theft_rate") / 10, F.lit(0.2)))
    accidents = F.when(
        F.col("accidents_per_1000").isNotNull(),
        F.least(F.col("accidents_per_1000") / 100, F.lit(0.15)),
    )
    return weather + F.coalesce(theft, F.lit(0.0)) + F.coalesce(accidents, F.lit(0.0))


def input_problems(profiles: DataFrame, scores: DataFrame, features: DataFrame) -> DataFrame:
    """Drivers that do not occur exactly once in each of the three pricing inputs."""
    sides = {"profiles": profiles, "scores": scores, "features": features}
    marked = None
    for side, df in sides.items():
        part = df.select("driver_id", *[F.lit(int(side == other)).alias(other) for other in sides])
        marked = part if marked is None else marked.unionByName(part)
    counted = marked.groupBy("driver_id").agg(*[F.sum(side).alias(side) for side in sides])
    return counted.filter(" OR ".join(f"{side} <> 1" for side in sides))


def pricing_inputs(
    profiles: DataFrame, scores: DataFrame, features: DataFrame, check: bool = True
) -> DataFrame:
    """Profile, score and features of every driver; raises when the inputs do not line up."""
    if check and not input_problems(profiles, scores, features).isEmpty():
        raise ValueError("profiles, scores and features must hold the same drivers, once each")
    return profiles.join(scores.select("driver_id", "risk_score"), "driver_id").join(
        features, "driver_id"
    )


def premiums(
    inputs: DataFrame, as_of: str, rules: PricingRules = PRICING_RULES
) -> DataFrame:
    """Premium of every input row (profile, claims count, zip context, score, features)."""
    as_of_year = int(as_of[:4])
    mileage = F.coalesce("total_mileage", F.lit(rules.default_mileage))
    priced = (
        inputs.withColumn("base_premium", base_premium(as_of_year, rules))
        .withColumn("risk_level", risk_level(F.col("risk_score")))
        .withColumn("risk_multiplier", lookup(F.col("risk_level"), RISK_MULTIPLIERS, 1.0))
        .withColumn("annual_mileage", mileage)
        .withColumn("mileage_adjustment", mileage_adjustment(F.col("annual_mileage")))
        .withColumn("temporal_adjustment", temporal_adjustment())
        .withColumn("contextual_adjustment", contextual_adjustment())
    )
    product = (
        F.col("base_premium")
        * F.col("risk_multiplier")
        * F.col("mileage_adjustment")
        * F.col("temporal_adjustment")
        * F.col("contextual_adjustment")
    )
    zero = F.lit(0)
    details = F.struct(
        F.struct(
            "vehicle_type",
            age_group(F.col("age")).alias("age_group"),
            (F.lit(as_of_year) - F.col("vehicle_year")).alias("vehicle_age"),
            "claims_count",
        ).alias("base_premium_factors"),
        F.struct(
            F.coalesce("harsh_braking_count", zero).alias("harsh_braking_events"),
            F.coalesce("harsh_acceleration_count", zero).alias("harsh_acceleration_events"),
            F.coalesce("over_speed_ratio", F.lit(0.0)).alias("over_speed_ratio"),
            F.coalesce("phone_usage_ratio", F.lit(0.0)).alias("phone_usage_ratio"),
        ).alias("telematics_factors"),
        F.struct(
            "location_zip",
            F.coalesce("weather_risk_score", F.lit(1.0)).alias("weather_risk"),
            "annual_mileage",
        ).alias("contextual_factors"),
    )
    return (
        priced.withColumn("final_premium", clamp(product, rules.min_premium, rules.max_premium))
        .withColumn("calculation_date", clock.ntz(as_of))
        .withColumn("details", details)
    )


def price_all(
    profiles: DataFrame,
    scores: DataFrame,
    features: DataFrame,
    claims: DataFrame,
    zip_context: DataFrame,
    as_of: str,
    check: bool = True,
    rules: PricingRules = PRICING_RULES,
) -> DataFrame:
    """Premiums of a whole portfolio."""
    inputs = pricing_inputs(profiles, scores, features, check)
    return premiums(with_zip_context(with_claims_count(inputs, claims), zip_context), as_of, rules)


def premium_export(priced: DataFrame) -> DataFrame:
    """The ten export columns; the date as ISO text."""
    return priced.select(
        "driver_id", "base_premium", "risk_score", "risk_level", "risk_multiplier",
        "mileage_adjustment", "temporal_adjustment", "contextual_adjustment", "final_premium",
        F.date_format("calculation_date", "yyyy-MM-dd'T'HH:mm:ss").alias("calculation_date"),
    )


def premium_changes(
    history: DataFrame, as_of: str, rules: PricingRules = PRICING_RULES
) -> DataFrame:
    """Change against the previous premium; from 0 there is no percentage and no category."""
    percent = (F.col("change_amount") / F.nullif("current_premium", F.lit(0.0))) * 100
    category = (
        F.when(F.abs("change_percentage") < 5, "minimal")
        .when(F.col("change_percentage") >= 5, "increase")
        .when(F.col("change_percentage").isNotNull(), "decrease")
    )
    return (
        history.withColumn("change_amount", F.col("new_premium") - F.col("current_premium"))
        .withColumn("change_percentage", percent)
        .withColumn("change_category", category)
        .withColumn("effective_date", clock.ntz(as_of) + F.expr(f"INTERVAL {rules.update_days} DAYS"))
        .withColumnRenamed("current_premium", "previous_premium")
    )


def demo_score(age: Column, mileage: Column, jitter: Column | float = 0.0) -> Column:
    """Stand-in score of a quote without one, from age and mileage."""
    age_factor = clamp((age - 16) / 70, 0.1, 1.0)
    mileage_factor = F.least(F.lit(1.0), F.coalesce(mileage, F.lit(12000.0)) / 30000)
    return clamp((age_factor + mileage_factor) / 2 + jitter, 0.1, 0.9)


def with_demo_scores(requests: DataFrame, jitter: float = 0.1, seed: int = 42) -> DataFrame:
    """Fill missing scores; ``jitter`` spreads them evenly by ± that much."""
    noise = (F.rand(seed) * 2 - 1) * jitter if jitter else F.lit(0.0)
    return requests.withColumn(
        "risk_score",
        F.coalesce("risk_score", demo_score(F.col("age"), F.col("annual_mileage"), noise)),
    )


def quotes(
    requests: DataFrame, jitter: float = 0.0, rules: PricingRules = PRICING_RULES
) -> DataFrame:
    """Simplified quotes; their bands differ from those of the premium formula."""
    mileage = F.coalesce("annual_mileage", F.lit(rules.default_mileage))
    product = (
        F.col("base_premium")
        * F.col("age_multiplier")
        * F.col("risk_multiplier")
        * F.col("mileage_adjustment")
    )
    return (
        with_demo_scores(requests, jitter)
        .withColumn(
            "base_premium", lookup(F.col("vehicle_type"), VEHICLE_BASE, DEFAULT_VEHICLE_BASE).cast("double")
        )
        .withColumn("age_multiplier", below(F.col("age"), ((25, 1.5), (35, 1.1), (65, 1.0)), 1.2))
        .withColumn("risk_multiplier", below(F.col("risk_score"), ((0.3, 0.7), (0.7, 1.0)), 1.5))
        .withColumn("mileage_adjustment", below(mileage, ((5000, 0.8), (15000, 1.0)), 1.2))
        .withColumn("contextual_adjustment", F.lit(1.0))
        .withColumn("risk_level", service_category(F.col("risk_score")))
        .withColumn("final_premium", clamp(product, rules.min_premium, rules.max_premium))
    )


def risk_distribution(priced: DataFrame) -> DataFrame:
    """Share of each level that occurs; the window runs over at most five counted rows."""
    return (
        priced.groupBy("risk_level")
        .agg(F.count("*").alias("drivers"))
        .withColumn("share", F.col("drivers") / F.sum("drivers").over(Window.partitionBy(F.lit(1))))
    )


def market_position(priced: DataFrame) -> DataFrame:
    """One row: count, mean, exact median, population deviation and range of premiums."""
    median = exact_medians(priced, ["final_premium"]).scalar()
    return priced.agg(
        F.count("*").alias("total_drivers"),
        F.avg("final_premium").alias("average_premium"),
        F.stddev_pop("final_premium").alias("premium_std"),
        F.min("final_premium").alias("min_premium"),
        F.max("final_premium").alias("max_premium"),
    ).withColumn("median_premium", median)


def recommendations(priced: DataFrame) -> DataFrame:
    """One row with the shares, the spread and the advice that follows from them."""

    def share(*levels: str) -> Column:
        return F.avg(F.col("risk_level").isin(*levels).cast("double"))

    return priced.agg(
        share("high", "very_high").alias("high_share"),
        share("very_low", "low").alias("low_share"),
        (F.stddev_pop("final_premium") / F.avg("final_premium")).alias("variation"),
    ).withColumn(
        "recommendations",
        text.present(
            (F.col("high_share") > 0.3, PORTFOLIO_ADVICE["many_high"]),
            (F.col("low_share") > 0.6, PORTFOLIO_ADVICE["many_low"]),
            (F.col("variation") > 0.5, PORTFOLIO_ADVICE["wide_spread"]),
        ),
    )
