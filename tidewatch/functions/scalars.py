"""Scalar expressions and driver-side helpers."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column
from pyspark.sql import functions as F


def add_business_days_10(day: Column) -> Column:
    """Ten weekdays (Monday to Friday) later; from a weekend, from its Friday on."""
    step = F.when(F.dayofweek(day) == 7, 13).when(F.dayofweek(day) == 1, 12).otherwise(14)
    return F.date_add(day, step)


def wall_date(text: Column) -> Column:
    """The calendar date as written, whatever the time zone says."""
    return F.to_date(F.substring(text, 1, 10))


def not_nan(x: Column) -> Column:
    """NULL for NaN and infinities."""
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


def in_unit_interval(x: Column, what: str) -> Column:
    """``x``, or an error where it is outside [0, 1]."""
    return F.when(x.between(0.0, 1.0) | x.isNull(), x).otherwise(F.raise_error(F.concat(F.lit(f"{what} must be within [0, 1]: "), x.cast("string"))).cast("double"))


def round_double(c: str, places: int) -> Column:
    """``c`` rounded as SQL engines round doubles: the product with 10**places goes
    to the nearest whole number, halves away from zero.  Spark's ``round`` goes by
    the shortest decimal text, which may be a half where the double is below it."""
    x = F.abs(c) * 10.0**places
    low = F.when(x < 2.0**53, F.floor(x).cast("double"))  # beyond, doubles are whole
    return F.when(low.isNull(), F.col(c)).otherwise(F.signum(c) * (low + F.when(x - low >= 0.5, 1.0).otherwise(0.0)) / 10.0**places).alias(c)


def canonical_json(value: object) -> str:
    """JSON with sorted keys and no spaces; other types by their text."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), default=str)


def config_hash(config: dict) -> str:
    return hashlib.sha256(canonical_json(config).encode()).hexdigest()


def row_digest(columns: list[str]) -> Column:
    """SHA-256 of a row's values by name; NULL differs from every text."""
    parts = [F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("~")) for c in sorted(columns)]
    return F.sha2(F.concat_ws("|", *parts), 256)
