"""CSV and JSON files with fixed schemas; nothing is inferred."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from roadrisk import schemas
from roadrisk.operators.pricing import premium_export
from roadrisk.operators.trips import feature_table

TIME_FORMAT = "yyyy-MM-dd HH:mm:ss[.SSSSSS]"


def _read_csv(spark: SparkSession, path: str, schema) -> DataFrame:
    """The header is checked against the schema, so a file with other columns fails."""
    return (
        spark.read.schema(schema)
        .option("header", True)
        .option("enforceSchema", False)
        .option("timestampNTZFormat", TIME_FORMAT)
        .csv(path)
    )


def _write_csv(df: DataFrame, path: str, mode: str) -> None:
    df.write.mode(mode).option("header", True).option("timestampNTZFormat", TIME_FORMAT).csv(path)


def read_points_csv(spark: SparkSession, path: str, numbered: bool = True) -> DataFrame:
    """Points with their place in the trip (``seq``), or the plain 15 columns without it."""
    return _read_csv(spark, path, schemas.POINTS if numbered else schemas.PLAIN_POINTS)


def write_points_csv(points: DataFrame, path: str, mode: str = "errorifexists") -> None:
    columns = [f.name for f in schemas.POINTS.fields if f.name in points.columns]
    _write_csv(points.select(*columns), path, mode)


def write_feature_csv(features: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Driver key and model columns, without the period."""
    _write_csv(feature_table(features), path, mode)


def read_feature_csv(spark: SparkSession, path: str) -> DataFrame:
    return _read_csv(spark, path, schemas.FEATURES)


def write_premium_csv(priced: DataFrame, path: str, mode: str = "errorifexists") -> None:
    _write_csv(premium_export(priced), path, mode)


def read_premium_csv(spark: SparkSession, path: str) -> DataFrame:
    return _read_csv(spark, path, schemas.PREMIUMS)


def read_uploads_json(spark: SparkSession, path: str) -> DataFrame:
    """Upload bodies, one JSON object per line, the trip records kept as text."""
    return spark.read.schema("upload_id bigint, driver_id string, trip_data string").json(path)
