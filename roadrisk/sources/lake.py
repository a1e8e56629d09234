"""Daily partitioned Parquet tables of raw events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession

from roadrisk import schemas
from roadrisk.functions.clock import date_parts

PARTITIONS = ("year", "month", "day")


def with_partitions(events: DataFrame, time: Column) -> DataFrame:
    return events.withColumns(date_parts(time))


def write_daily(events: DataFrame, folder: str, time: Column, mode: str = "append") -> None:
    """Write under ``year=/month=/day=`` of the given time.

    Rows are spread over the tasks they already sit in, so a busy day is written by many tasks; file
    size is a matter of the input split size.
    """
    with_partitions(events, time).write.mode(mode).partitionBy(*PARTITIONS).parquet(folder)


def create_event_table(spark: SparkSession, name: str, folder: str) -> str:
    """Table over the folder, with text partition columns."""
    columns = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in schemas.EVENTS.fields)
    spark.sql(
        f"CREATE TABLE IF NOT EXISTS {name} ({columns}, year STRING, month STRING, day STRING) USING parquet "
        f"OPTIONS (path '{folder}') PARTITIONED BY (year, month, day)"
    )
    return name


def register_partition(spark: SparkSession, table: str, folder: str, date: str) -> None:
    """Add the partition of one day; an existing one is left alone."""
    year, month, day = date.split("-")
    spark.sql(
        f"ALTER TABLE {table} ADD IF NOT EXISTS PARTITION (year='{year}', month='{month}', day='{day}') "
        f"LOCATION '{folder}/year={year}/month={month}/day={day}'"
    )


def register_all_partitions(spark: SparkSession, table: str) -> None:
    spark.sql(f"MSCK REPAIR TABLE {table}")
