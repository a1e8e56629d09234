"""Registry of named queries: a Spark callable and, where SQL can say it, a reference text."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from roadrisk.plans.relations import RELATIONS, Inputs, duckdb_text

# Compared doubles: the noise of summation order is rounded away first. Half a unit of that grid then
# moves every value off the ties, which the engines round differently, before the tail is cut.
NOISE_DIGITS, OFF_TIE, DIGITS = 10, 5e-11, 6


def _compared(column: str):
    return F.round(F.round(F.col(column), NOISE_DIGITS) + OFF_TIE, DIGITS).alias(column)


def _compared_text(column: str) -> str:
    return f"round(round({column}, {NOISE_DIGITS}) + {OFF_TIE}, {DIGITS}) AS {column}"


@dataclass(frozen=True)
class Query:
    name: str
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None


QUERIES: dict[str, Query] = {}
SHARED: dict[str, str] = {}  # common table expressions of the reference texts


def shared(name: str, text: str) -> None:
    SHARED[name] = text.strip()


def _with_clause(body: str) -> str:
    """The needed common table expressions, each after those it uses."""
    ordered: list[str] = []

    def visit(text: str, skip: str | None = None) -> None:
        words = set(re.findall(r"\b(?:FROM|JOIN)\s+([a-z_0-9]+)\b", text))
        for name in [*RELATIONS, *SHARED]:
            if name in words and name != skip and name not in ordered:
                definition = SHARED.get(name) or duckdb_text(name).strip()
                visit(definition, name)
                ordered.append(name)

    visit(body)
    if not ordered:
        return ""
    parts = [f"{name} AS ({SHARED.get(name) or duckdb_text(name).strip()})" for name in ordered]
    return "WITH " + ",\n".join(parts) + "\n"


def query(name: str, keep: str = "", nums: str = "", sql: str | None = None):
    """Register a query; ``keep`` columns are compared as they are, ``nums`` rounded to 6 digits."""
    kept, rounded = keep.split(), nums.split()

    def register(build: Callable[[Inputs], DataFrame]):
        def run(spark: SparkSession, folder: str) -> DataFrame:
            result = build(Inputs(spark, folder))
            if not kept and not rounded:
                return result
            return result.select(*kept, *[_compared(c) for c in rounded])

        text = None
        if sql is not None:
            columns = [*kept, *[_compared_text(c) for c in rounded]]
            text = f"{_with_clause(sql)}SELECT {', '.join(columns)} FROM (\n{sql.strip()}\n) q"
        QUERIES[name] = Query(name, run, text)
        return build

    return register
