"""Unit columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _unit(unit: Column) -> Column:
    return F.upper(F.regexp_replace(F.trim(unit), "[µμ]", "u"))


def current_in_amps(value: Column, unit: Column) -> Column:
    """A current as amperes; a missing or unknown unit leaves the value."""
    u = _unit(unit)
    return F.when(u.isin("MA", "MAMP"), value / 1000).when(u.isin("UA", "UAMP"), value / 1000000).when(u.isin("NA", "NAMP"), value / 1000000000).otherwise(value)


def current_in_milliamps(value: Column, unit: Column) -> Column:
    return current_in_amps(value, unit) * 1000


def time_in_seconds(value: Column, unit: Column) -> Column:
    """A time as seconds; without a unit, a value of 1e-3 or more is taken as nanoseconds."""
    u = F.lower(F.trim(unit))
    scaled = F.when(u == "ns", value * 1e-9).when(u == "us", value * 1e-6).when(u == "ms", value * 1e-3).when(u == "s", value)
    return F.coalesce(scaled, F.when(F.abs(value) >= 1e-3, value * 1e-9).otherwise(value))


def display_current(value: Column, unit: Column) -> Column:
    """A current with the unit that suits its size."""
    a = F.abs(current_in_amps(value, unit))
    return F.when(a >= 1, F.format_string("%.3fA", a)).when(a >= 0.001, F.format_string("%.3fmA", a * 1000)).otherwise(F.format_string("%.3fuA", a * 1000000))
