"""Messages, advice lists and the premium explanation."""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F

from roadrisk import config


def present(*items: tuple[Column, Column | str]) -> Column:
    """Array of the texts whose condition holds, in order."""
    texts = [
        F.when(condition, text if isinstance(text, Column) else F.lit(text)) for condition, text in items
    ]
    return F.array_compact(F.array(*texts))


def filled(template: str, **values: Column) -> Column:
    """Template with its ``{name}`` places filled; null if a value is null."""
    parts = re.split(r"\{(\w+)\}", template)
    pieces = [values[part].cast("string") if k % 2 else F.lit(part) for k, part in enumerate(parts)]
    return F.concat(*pieces)


def missing_fields(fields: tuple[str, ...]) -> Column:
    return present(*[(F.col(name).isNull(), name) for name in fields])


def missing_fields_message(missing: Column) -> Column:
    """One message naming every missing field, null when there is none."""
    return F.when(F.size(missing) > 0, filled(config.MISSING_FIELDS, names=F.array_join(missing, ", ")))


def first_missing_message(missing: Column) -> Column:
    """Message of the first missing field only, null when there is none."""
    return F.when(F.size(missing) > 0, filled(config.FIRST_MISSING, name=F.element_at(missing, 1)))


def context_advice(score: Column) -> Column:
    return present(
        *[(score > 0.7, words) for words in config.HIGH_RISK_ADVICE],
        ((score > 0.4) & (score <= 0.7), config.MEDIUM_RISK_ADVICE),
    )


def alert_message(driver_id: Column, alerts: Column) -> Column:
    return filled(config.ALERT_MESSAGE, driver=driver_id, alerts=F.array_join(alerts, ", "))


def alert_subject(severity: Column) -> Column:
    return filled(config.ALERT_SUBJECT, severity=F.upper(severity))


def alert_severity(score: Column, severe_above: float = 0.3) -> Column:
    return F.when(score > severe_above, "high").otherwise("medium")


def premium_explanation() -> Column:
    """Readable account of one premium row (columns as made by ``pricing.premiums``).

    Numbers are rounded to nine digits first, so that the text does not depend on summation order;
    an exact decimal half is then rounded up.
    """
    title = F.lit(None).cast("string")
    for level, words in config.RISK_LEVEL_TITLES.items():
        title = F.when(F.col("risk_level") == level, words).otherwise(title)
    special = {
        "risk_title": title,
        "over_speed_percent": F.round(F.col("over_speed_ratio") * 100.0, 9),
        "phone_usage_percent": F.round(F.col("phone_usage_ratio") * 100.0, 9),
    }

    def value(place: str, name: str) -> Column:
        if name in special:
            return special[name]
        return F.col(name).cast("string") if place == "%s" else F.round(F.col(name), 9)

    lines = []
    for pattern, *names in config.PREMIUM_TEXT:
        places = re.findall(r"%s|%\.\df", pattern)
        values = [value(place, name) for place, name in zip(places, names)]
        lines.append(F.format_string(pattern, *values) if values else F.lit(pattern))
    return F.concat_ws("\n", *lines)
