"""Row-level expressions: dates, null handling, geography. All of them stay inside codegen."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_RADIUS_KM = 6371.0


def ntz(moment: datetime | str) -> Column:
    """A TIMESTAMP_NTZ literal (``F.lit(datetime)`` would make a zoned one)."""
    return F.lit(str(moment)).cast("timestamp_ntz")


def whole_days(start: Column, end: Column) -> Column:
    """Whole elapsed days from ``start`` to ``end`` (42 hours are 1), free of session time zones."""
    return F.extract(F.lit("DAY"), end - start).cast("int")


def non_negative(value: Column) -> Column:
    """Clip at zero but keep null (``greatest`` alone would turn null into zero)."""
    return F.when(value.isNotNull(), F.greatest(value, F.lit(0)))


def is_true(flag: Column) -> Column:
    """Null-safe truth: null counts as false."""
    return F.coalesce(flag, F.lit(False))


def nan_to_null(value: Column) -> Column:
    return F.when(~F.isnan(value), value)


def ratio_or_zero(numerator: Column, denominator: Column) -> Column:
    """``numerator / denominator`` with 0 for an empty denominator or a missing side."""
    return F.coalesce(F.try_divide(numerator, denominator), F.lit(0.0))


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance in km; null when any coordinate is null."""
    half_lat = F.radians(lat2 - lat1) / 2
    half_lon = F.radians(lon2 - lon1) / 2
    chord = F.pow(F.sin(half_lat), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(
        F.sin(half_lon), 2
    )
    return F.asin(F.sqrt(chord)) * (2 * EARTH_RADIUS_KM)


def age_years(birth: Column, at: Column) -> Column:
    """Age with one decimal, ties rounded to even."""
    return F.rint(whole_days(birth, at) / F.lit(365.25) * 10) / 10
