"""Queries on scores, premiums and the portfolio."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from roadrisk.functions import scores as s, text
from roadrisk.operators import ml, pricing, stats, trips
from roadrisk.plans.registry import query, shared
from roadrisk.plans.relations import AS_OF_EVENTS, AS_OF_YEAR, Inputs
from roadrisk.plans.trip_queries import DOUBLE_FEATURES, INTEGER_FEATURES
from roadrisk.sources.scratch import cut_lineage

AS_OF = f"{AS_OF_YEAR}-02-01 00:00:00"

shared(
    "t_scored",
    """SELECT *, greatest(0.0E0, least(1.0E0, 0.5E0 + least(harsh_braking_count / 50.0E0, 0.2E0) + least(harsh_acceleration_count / 50.0E0, 0.2E0)
  + least(over_speed_ratio, 0.2E0) + least(phone_usage_ratio, 0.1E0) + least(night_driving_ratio * 0.1E0, 0.1E0))) AS risk_score FROM t_drivers""",
)
shared(
    "t_spread",
    """SELECT driver_id, CAST(('0x' || substr(md5(driver_id), 1, 8)) AS BIGINT) % 101 / 100.0E0 AS risk_score FROM drivers""",
)
shared(
    "t_rated",
    f"""SELECT p.*, coalesce(c.n, 0) AS claims_count, z.theft_rate, z.accidents_per_1000, z.zip IS NOT NULL AS zip_known, f.* EXCLUDE (driver_id),
  r.risk_score,
  CASE p.vehicle_type WHEN 'sedan' THEN 800 WHEN 'suv' THEN 900 WHEN 'truck' THEN 1000 WHEN 'compact' THEN 700 WHEN 'luxury' THEN 1200 ELSE 800 END
  * CASE WHEN age BETWEEN 16 AND 25 THEN 1.5E0 WHEN age BETWEEN 26 AND 35 THEN 1.1E0 WHEN age BETWEEN 36 AND 55 THEN 1.0E0
         WHEN age BETWEEN 56 AND 65 THEN 0.9E0 WHEN age BETWEEN 66 AND 100 THEN 1.2E0 ELSE 1.0E0 END
  * (1 + ({AS_OF_YEAR} - vehicle_year) * 0.02E0) * (1 + coalesce(c.n, 0) * 0.3E0) AS base_premium,
  CASE WHEN r.risk_score < 0.2E0 THEN 'very_low' WHEN r.risk_score < 0.4E0 THEN 'low' WHEN r.risk_score < 0.6E0 THEN 'medium' WHEN r.risk_score < 0.8E0 THEN 'high' ELSE 'very_high' END AS risk_level,
  CASE WHEN total_mileage BETWEEN 0 AND 5000 THEN 0.8E0 WHEN total_mileage BETWEEN 5001 AND 10000 THEN 0.9E0 WHEN total_mileage BETWEEN 10001 AND 15000 THEN 1.0E0
       WHEN total_mileage BETWEEN 15001 AND 20000 THEN 1.1E0 WHEN total_mileage BETWEEN 20001 AND 30000 THEN 1.3E0 WHEN total_mileage >= 30001 THEN 1.5E0 ELSE 1.0E0 END AS mileage_adjustment,
  1 + 0.3E0 * night_driving_ratio + 0.1E0 * weekend_driving_ratio + 0.2E0 * rush_hour_ratio AS temporal_adjustment,
  CASE WHEN z.zip IS NULL THEN 1.0E0 ELSE 1 + (weather_risk_score - 1) * 0.5E0 + least(z.theft_rate / 10, 0.2E0) + least(z.accidents_per_1000 / 100, 0.15E0) END AS contextual_adjustment
FROM drivers p JOIN t_drivers f USING (driver_id) JOIN t_spread r USING (driver_id)
LEFT JOIN (SELECT driver_id, count(*) AS n FROM claims GROUP BY driver_id) c USING (driver_id)
LEFT JOIN zip_context z ON z.zip = p.location_zip""",
)
shared(
    "t_premiums",
    """SELECT *, greatest(300.0E0, least(5000.0E0, base_premium * risk_multiplier * mileage_adjustment * temporal_adjustment * contextual_adjustment)) AS final_premium
FROM (SELECT *, CASE risk_level WHEN 'very_low' THEN 0.6E0 WHEN 'low' THEN 0.8E0 WHEN 'medium' THEN 1.0E0 WHEN 'high' THEN 1.4E0 ELSE 2.0E0 END AS risk_multiplier FROM t_rated) r""",
)


def features(i: Inputs) -> DataFrame:
    return trips.features_of_all_drivers(i.telematics_raw)


def rule_scored(i: Inputs) -> DataFrame:
    """Driver features with the rule score, free of noise."""
    return ml.with_synthetic_target(features(i), noise_sd=0.0)


def spread_scores(drivers: DataFrame) -> DataFrame:
    """Scores over the whole range 0 to 1, so that every risk level and multiplier occurs."""
    bucket = F.conv(F.substring(F.md5("driver_id"), 1, 8), 16, 10).cast("bigint") % 101
    return drivers.select("driver_id", (bucket / 100.0).alias("risk_score"))


def priced(i: Inputs, check: bool = False) -> DataFrame:
    """Premiums; the check runs a job of its own, so the features are then computed once before it."""
    profiles = i.drivers
    rows = cut_lineage(features(i)) if check else features(i)
    return pricing.price_all(profiles, spread_scores(profiles), rows, i.claims, i.zip_context, AS_OF, check)


@query(
    "fn_risk_category_ml",
    keep="driver_id category",
    sql="""SELECT driver_id, CASE WHEN y_pred <= 0.33E0 THEN 'low' WHEN y_pred <= 0.67E0 THEN 'medium' ELSE 'high' END AS category FROM scored_sample""",
)
def _(i):
    return i.scored_sample.withColumn("category", s.training_category(F.col("y_pred")))


@query(
    "fn_risk_category_api",
    keep="driver_id category",
    sql="""SELECT driver_id, CASE WHEN y_pred < 0.3E0 THEN 'low' WHEN y_pred < 0.7E0 THEN 'medium' ELSE 'high' END AS category FROM scored_sample""",
)
def _(i):
    return i.scored_sample.withColumn("category", s.service_category(F.col("y_pred")))


@query(
    "fn_risk_level5",
    keep="driver_id level",
    sql="""SELECT driver_id, CASE WHEN y_pred < 0.2E0 THEN 'very_low' WHEN y_pred < 0.4E0 THEN 'low' WHEN y_pred < 0.6E0 THEN 'medium'
  WHEN y_pred < 0.8E0 THEN 'high' ELSE 'very_high' END AS level FROM scored_sample""",
)
def _(i):
    return i.scored_sample.withColumn("level", s.risk_level(F.col("y_pred")))


@query(
    "fn_age_group",
    keep="driver_id age age_group",
    sql="""SELECT driver_id, age, CASE WHEN age BETWEEN 16 AND 25 THEN '16-25' WHEN age BETWEEN 26 AND 35 THEN '26-35' WHEN age BETWEEN 36 AND 55 THEN '36-55'
  WHEN age BETWEEN 56 AND 65 THEN '56-65' WHEN age BETWEEN 66 AND 100 THEN '66-100' ELSE 'unknown' END AS age_group FROM drivers""",
)
def _(i):
    return i.drivers.withColumn("age_group", s.age_group(F.col("age")))


@query(
    "fn_fallback_score",
    keep="driver_id",
    nums="score",
    sql="""SELECT driver_id, 0.3E0 + CAST(('0x' || substr(md5(driver_id), 1, 8)) AS BIGINT) % 100 / 200.0E0 AS score FROM customers_asked""",
)
def _(i):
    return i.customers_asked.withColumn("score", s.stable_fallback_score(F.col("driver_id")))


@query(
    "prj_clip_score",
    keep="driver_id",
    nums="score",
    sql="SELECT driver_id, greatest(0.0E0, least(1.0E0, y_pred * 1.5E0 - 0.2E0)) AS score FROM scored_sample",
)
def _(i):
    return i.scored_sample.withColumn("score", s.clamp(F.col("y_pred") * 1.5 - 0.2, 0.0, 1.0))


@query(
    "jn_claims_count",
    keep="driver_id claims_count",
    sql="""SELECT d.driver_id, count(c.claim_id) AS claims_count FROM drivers d LEFT JOIN claims c USING (driver_id) GROUP BY d.driver_id""",
)
def _(i):
    return pricing.with_claims_count(i.drivers, i.claims)


@query(
    "jn_zip_context",
    keep="driver_id location_zip",
    nums="theft_rate accidents_per_1000",
    sql="""SELECT d.driver_id, d.location_zip, z.theft_rate, z.accidents_per_1000 FROM drivers d LEFT JOIN zip_context z ON z.zip = d.location_zip""",
)
def _(i):
    return pricing.with_zip_context(i.drivers, i.zip_context)


@query(
    "jn_pricing_inputs",
    keep="driver_id vehicle_type age trip_frequency",
    nums="risk_score total_mileage",
    sql="""SELECT d.driver_id, vehicle_type, age, trip_frequency, s.risk_score, total_mileage
FROM drivers d JOIN t_spread s USING (driver_id) JOIN t_drivers f USING (driver_id)""",
)
def _(i):
    return pricing.pricing_inputs(i.drivers, spread_scores(i.drivers), cut_lineage(features(i)))


@query("prc_base", keep="driver_id claims_count", nums="base_premium", sql="SELECT * FROM t_rated")
def _(i):
    rated = pricing.with_claims_count(i.drivers, i.claims)
    return rated.withColumn("base_premium", pricing.base_premium(AS_OF_YEAR))


@query(
    "prc_mileage",
    keep="driver_id",
    nums="annual_mileage mileage_adjustment",
    sql="""SELECT driver_id, annual_mileage, CASE WHEN m BETWEEN 0 AND 5000 THEN 0.8E0 WHEN m BETWEEN 5001 AND 10000 THEN 0.9E0 WHEN m BETWEEN 10001 AND 15000 THEN 1.0E0
  WHEN m BETWEEN 15001 AND 20000 THEN 1.1E0 WHEN m BETWEEN 20001 AND 30000 THEN 1.3E0 WHEN m >= 30001 THEN 1.5E0 ELSE 1.0E0 END AS mileage_adjustment
FROM (SELECT driver_id, annual_mileage, coalesce(annual_mileage, 12000) + 0.5E0 AS m FROM premium_requests) r""",
)
def _(i):
    mileage = F.coalesce("annual_mileage", F.lit(12000.0)) + 0.5
    return i.premium_requests.withColumn("mileage_adjustment", pricing.mileage_adjustment(mileage))


@query(
    "prc_temporal",
    keep="driver_id",
    nums="temporal_adjustment",
    sql="""SELECT driver_id, 1 + 0.3E0 * night_driving_ratio + 0.1E0 * weekend_driving_ratio + 0.2E0 * rush_hour_ratio AS temporal_adjustment FROM t_drivers""",
)
def _(i):
    return features(i).withColumn("temporal_adjustment", pricing.temporal_adjustment())


@query("prc_contextual", keep="driver_id location_zip", nums="contextual_adjustment", sql="SELECT * FROM t_rated")
def _(i):
    joined = pricing.with_zip_context(i.drivers, i.zip_context).join(features(i), "driver_id")
    return joined.withColumn("contextual_adjustment", pricing.contextual_adjustment())


PREMIUM_KEEP = "driver_id risk_level"
PREMIUM_NUMS = (
    "base_premium risk_score risk_multiplier mileage_adjustment temporal_adjustment contextual_adjustment final_premium"
)


@query(
    "prc_premium",
    keep=PREMIUM_KEEP + " age_group vehicle_age claims_count harsh_braking_events location_zip",
    nums=PREMIUM_NUMS + " weather_risk annual_mileage",
    sql=f"""SELECT *, CASE WHEN age BETWEEN 16 AND 25 THEN '16-25' WHEN age BETWEEN 26 AND 35 THEN '26-35' WHEN age BETWEEN 36 AND 55 THEN '36-55'
  WHEN age BETWEEN 56 AND 65 THEN '56-65' WHEN age BETWEEN 66 AND 100 THEN '66-100' ELSE 'unknown' END AS age_group, {AS_OF_YEAR} - vehicle_year AS vehicle_age,
  harsh_braking_count AS harsh_braking_events, weather_risk_score AS weather_risk, total_mileage AS annual_mileage FROM t_premiums""",
)
def _(i):
    rows = priced(i).drop("claims_count", "location_zip", "annual_mileage")
    return rows.select(
        "*",
        "details.base_premium_factors.age_group",
        "details.base_premium_factors.vehicle_age",
        "details.base_premium_factors.claims_count",
        "details.telematics_factors.harsh_braking_events",
        "details.contextual_factors.location_zip",
        "details.contextual_factors.weather_risk",
        "details.contextual_factors.annual_mileage",
    )


@query("prc_batch", keep=PREMIUM_KEEP, nums=PREMIUM_NUMS, sql="SELECT * FROM t_premiums")
def _(i):
    return priced(i, check=True)


@query(
    "prc_change",
    keep="driver_id change_category effective_date",
    nums="previous_premium new_premium change_amount change_percentage",
    sql="""SELECT driver_id, current_premium AS previous_premium, new_premium, new_premium - current_premium AS change_amount, pct AS change_percentage,
  CASE WHEN abs(pct) < 5 THEN 'minimal' WHEN pct >= 5 THEN 'increase' WHEN pct IS NOT NULL THEN 'decrease' END AS change_category,
  TIMESTAMP '2024-03-02 00:00:00' AS effective_date
FROM (SELECT *, (new_premium - current_premium) / nullif(current_premium, 0) * 100 AS pct FROM premium_history) h""",
)
def _(i):
    return pricing.premium_changes(i.premium_history, AS_OF_EVENTS)


shared(
    "t_demo",
    """SELECT * EXCLUDE (risk_score), coalesce(risk_score, greatest(0.1E0, least(0.9E0, (greatest(0.1E0, least(1.0E0, (age - 16) / 70.0E0))
  + least(1.0E0, coalesce(annual_mileage, 12000) / 30000.0E0)) / 2))) AS risk_score FROM premium_requests""",
)
shared(
    "t_quotes",
    """SELECT *, greatest(300.0E0, least(5000.0E0, base_premium * age_multiplier * risk_multiplier * mileage_adjustment)) AS final_premium FROM (
  SELECT *, CASE vehicle_type WHEN 'suv' THEN 900.0E0 WHEN 'truck' THEN 1000.0E0 WHEN 'compact' THEN 700.0E0 WHEN 'luxury' THEN 1200.0E0 ELSE 800.0E0 END AS base_premium,
    CASE WHEN age < 25 THEN 1.5E0 WHEN age < 35 THEN 1.1E0 WHEN age < 65 THEN 1.0E0 ELSE 1.2E0 END AS age_multiplier,
    CASE WHEN risk_score < 0.3E0 THEN 0.7E0 WHEN risk_score < 0.7E0 THEN 1.0E0 ELSE 1.5E0 END AS risk_multiplier,
    CASE WHEN coalesce(annual_mileage, 12000) < 5000 THEN 0.8E0 WHEN coalesce(annual_mileage, 12000) < 15000 THEN 1.0E0 ELSE 1.2E0 END AS mileage_adjustment,
    CASE WHEN risk_score < 0.3E0 THEN 'low' WHEN risk_score < 0.7E0 THEN 'medium' ELSE 'high' END AS risk_level FROM t_demo) q""",
)


@query(
    "prc_api_quote",
    keep="driver_id risk_level",
    nums="base_premium risk_score age_multiplier risk_multiplier mileage_adjustment final_premium",
    sql="SELECT * FROM t_quotes",
)
def _(i):
    return pricing.quotes(i.premium_requests)


@query("prc_api_demo_score", keep="driver_id", nums="risk_score", sql="SELECT * FROM t_demo")
def _(i):
    return pricing.with_demo_scores(i.premium_requests, jitter=0.0)


@query(
    "fn_premium_text",
    keep="driver_id explanation",
    sql="""SELECT driver_id, 'Premium Calculation for Driver ' || driver_id || chr(10) || repeat('=', 50) || chr(10) || chr(10)
  || printf('Base Premium: $%.2f', round(base_premium, 9) + 1e-9) || chr(10)
  || 'Risk Level: ' || CASE risk_level WHEN 'very_low' THEN 'Very_Low' WHEN 'low' THEN 'Low' WHEN 'medium' THEN 'Medium' WHEN 'high' THEN 'High' ELSE 'Very_High' END
  || printf(' (Score: %.3f)', risk_score) || chr(10) || 'Risk Multiplier: ' || CAST(risk_multiplier AS VARCHAR) || 'x' || chr(10) || chr(10) || 'Adjustments:' || chr(10)
  || printf('  Mileage: %.3fx', mileage_adjustment) || chr(10) || printf('  Temporal: %.3fx', round(temporal_adjustment, 9) + 1e-9) || chr(10)
  || printf('  Contextual: %.3fx', round(contextual_adjustment, 9) + 1e-9) || chr(10) || chr(10) || printf('Final Premium: $%.2f', round(final_premium, 9) + 1e-9) || chr(10) || chr(10)
  || 'Driving Behavior Highlights:' || chr(10) || '  Harsh Braking Events: ' || CAST(harsh_braking_count AS VARCHAR) || chr(10)
  || '  Harsh Acceleration Events: ' || CAST(harsh_acceleration_count AS VARCHAR) || chr(10)
  || printf('  Over Speed Ratio: %.1f%%', round(over_speed_ratio * 100, 9) + 1e-9) || chr(10)
  || printf('  Phone Usage Ratio: %.1f%%', round(phone_usage_ratio * 100, 9) + 1e-9) || chr(10) AS explanation FROM t_premiums""",
)
def _(i):
    return priced(i).withColumn("explanation", text.premium_explanation())


@query(
    "agg_market_position",
    keep="total_drivers",
    nums="average_premium median_premium premium_std min_premium max_premium",
    sql="""SELECT count(*) AS total_drivers, avg(final_premium) AS average_premium, median(final_premium) AS median_premium, stddev_pop(final_premium) AS premium_std,
  min(final_premium) AS min_premium, max(final_premium) AS max_premium FROM t_quotes""",
)
def _(i):
    return pricing.market_position(pricing.quotes(i.premium_requests))


@query(
    "agg_risk_distribution",
    keep="risk_level drivers",
    nums="share",
    sql="""SELECT risk_level, count(*) AS drivers, count(*) / (SELECT count(*) FROM t_premiums) AS share FROM t_premiums GROUP BY risk_level""",
)
def _(i):
    return pricing.risk_distribution(priced(i))


@query(
    "agg_recommendations",
    keep="advice",
    nums="high_share low_share variation",
    sql="""SELECT *, concat_ws('|', CASE WHEN high_share > 0.3 THEN 'Consider additional driver training programs to reduce high-risk population' END,
  CASE WHEN low_share > 0.6 THEN 'Opportunity to attract more low-risk drivers with competitive pricing' END,
  CASE WHEN variation > 0.5 THEN 'High premium variance suggests good risk differentiation' END) AS advice
FROM (SELECT avg(CAST(risk_level IN ('high', 'very_high') AS INT)) AS high_share, avg(CAST(risk_level IN ('very_low', 'low') AS INT)) AS low_share,
  stddev_pop(final_premium) / avg(final_premium) AS variation FROM t_premiums) a""",
)
def _(i):
    return pricing.recommendations(priced(i)).withColumn("advice", F.array_join("recommendations", "|"))


@query(
    "agg_median_impute",
    keep="driver_id",
    nums="annual_mileage risk_score",
    sql="""SELECT driver_id, coalesce(annual_mileage, (SELECT median(annual_mileage) FROM premium_requests)) AS annual_mileage,
  coalesce(risk_score, (SELECT median(risk_score) FROM premium_requests)) AS risk_score FROM premium_requests""",
)
def _(i):
    return stats.impute_medians(i.premium_requests, ["annual_mileage", "risk_score"])


@query(
    "agg_regression_metrics",
    nums="mse r2",
    sql="""SELECT avg(pow(y_true - y_pred, 2)) AS mse, 1 - sum(pow(y_true - y_pred, 2)) / (SELECT sum(pow(y_true - m, 2)) FROM scored_sample, (SELECT avg(y_true) AS m FROM scored_sample)) AS r2
FROM scored_sample""",
)
def _(i):
    return stats.regression_metrics(i.scored_sample, "y_true", "y_pred")


shared(
    "t_labelled",
    """SELECT *, CASE WHEN y_true <= 0.33E0 THEN 'low' WHEN y_true <= 0.67E0 THEN 'medium' ELSE 'high' END AS label FROM scored_sample""",
)


CLASS_SCORES = {
    "low": "1 - y_pred",
    "medium": "1 - abs(y_pred - 0.5E0)",
    "high": "y_pred",
}


@query(
    "agg_auc_ovr",
    nums="macro_auc",
    sql="SELECT avg(auc) AS macro_auc FROM ("
    + " UNION ALL ".join(
        f"""SELECT sum(CASE WHEN p.s > n.s THEN 1.0E0 WHEN p.s = n.s THEN 0.5E0 ELSE 0.0E0 END) / count(*) AS auc FROM
(SELECT round({score}, 9) AS s FROM t_labelled WHERE label = '{label}') p, (SELECT round({score}, 9) AS s FROM t_labelled WHERE label <> '{label}') n"""
        for label, score in CLASS_SCORES.items()
    )
    + ") a",
)
def _(i):
    labelled = i.scored_sample.withColumn("label", s.training_category(F.col("y_true")))
    scored = labelled.withColumns(
        {f"p_{label}": F.round(F.expr(score), 9) for label, score in CLASS_SCORES.items()}
    )
    return stats.macro_auc(scored, "label", {label: f"p_{label}" for label in CLASS_SCORES})


@query(
    "ml_synthetic_target",
    keep="driver_id",
    nums="risk_score",
    sql="SELECT * FROM t_scored",
)
def _(i):
    return rule_scored(i)


@query(
    "ml_split",
    keep="driver_id split category",
    nums="risk_score",
    sql="""SELECT driver_id, risk_score, CASE WHEN CAST(('0x' || substr(md5(driver_id), 1, 8)) AS BIGINT) % 5 = 0 THEN 'test' ELSE 'train' END AS split,
  CASE WHEN risk_score <= 0.33E0 THEN 'low' WHEN risk_score <= 0.67E0 THEN 'medium' ELSE 'high' END AS category FROM t_scored""",
)
def _(i):
    return ml.with_split(rule_scored(i)).withColumn("category", s.training_category(F.col("risk_score")))


FEATURES = DOUBLE_FEATURES.split() + INTEGER_FEATURES.split()


@query(
    "ml_scale",
    keep="driver_id",
    nums=" ".join(FEATURES),
    sql="SELECT driver_id, "
    + ", ".join(
        f"CASE WHEN stddev_pop({n}) OVER () > 0 THEN ({n} - avg({n}) OVER ()) / stddev_pop({n}) OVER () ELSE 0.0E0 END AS {n}"
        for n in FEATURES
    )
    + " FROM t_drivers",
)
def _(i):
    return stats.standardize(features(i), FEATURES)


@query(
    "prj_ml_features",
    keep="column_count row_count",
    nums="feature_sum",
    sql=f"SELECT {len(FEATURES) } AS column_count, count(*) AS row_count, "
    + " + ".join(f"sum(coalesce({n}, 0))" for n in FEATURES)
    + " AS feature_sum FROM t_drivers",
)
def _(i):
    prepared = ml.prepare_features(rule_scored(i), target="risk_score")
    names = ml.numeric_features(rule_scored(i), "risk_score")
    total = None
    for name in names:
        total = F.sum(name) if total is None else total + F.sum(name)
    return prepared.agg(
        F.lit(len(names)).alias("column_count"), F.count("*").alias("row_count"), total.alias("feature_sum")
    )


@query(
    "prj_align_features",
    keep="driver_id extra_columns",
    nums="total_mileage avg_speed speed_variance night_driving_ratio missing_feature",
    sql="""SELECT driver_id, 0 AS extra_columns, total_mileage, avg_speed, coalesce(speed_variance, 0) AS speed_variance, night_driving_ratio, 0.0E0 AS missing_feature FROM t_drivers""",
)
def _(i):
    wanted = ["total_mileage", "avg_speed", "speed_variance", "night_driving_ratio", "missing_feature"]
    aligned = ml.align_features(features(i), wanted)
    return aligned.withColumn("extra_columns", F.lit(len(set(aligned.columns) - {"driver_id", *wanted})))
