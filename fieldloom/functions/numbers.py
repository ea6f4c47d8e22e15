"""Rounding, coercion, ratios, lengths and sizes as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def half_up(value: Column, digits: int = 0) -> Column:
    """Rounding with halves toward plus infinity, which differs from round() for negative halves."""
    scale = float(10**digits)
    return F.floor(value * scale + 0.5) / scale


def clamp(value: Column, low: float, high: float) -> Column:
    """value held between two bounds; null stays null, which greatest and least alone would turn into a bound."""
    return F.when(value.isNotNull(), F.greatest(F.least(value, F.lit(high)), F.lit(low)))


def ratio(part: Column, whole: Column) -> Column:
    """part/whole; 0 where the whole is 0."""
    return F.when(whole == 0, F.lit(0.0)).otherwise(part / whole)


def grade_percent(rise: Column, run: Column) -> Column:
    return F.lit(100.0) * ratio(rise, run)


def number_or_null(text: Column) -> Column:
    """A number, or null for anything else; blanks and nan are no numbers."""
    value = text.try_cast("double")
    return F.when(F.isnan(value), None).otherwise(value)


def first_present(*columns: Column) -> Column:
    """The first that is neither null nor empty."""
    return F.coalesce(*(F.when(c.cast("string") != "", c) for c in columns))


def truthy_unless_denied(tag: Column) -> Column:
    """A present tag is true unless it is no, false or 0."""
    return F.coalesce(tag.isNotNull() & ~F.lower(tag).isin("no", "false", "0", ""), F.lit(False))


def truthy_if_listed(tag: Column) -> Column:
    return F.coalesce(F.lower(tag).isin("yes", "true", "1", "designated"), F.lit(False))


def parse_length(text: Column) -> Column:
    """The first number of a text, with the first comma read as the decimal point; null without one."""
    return F.regexp_extract(F.regexp_replace(text, "^([^,]*),", "$1."), r"-?\d+(\.\d+)?", 0).try_cast("double")


def parse_bytes(text: Column) -> Column:
    """'12.5 MB' in bytes, rounded up; a number alone is bytes, and kB and KiB both are 1024."""
    pattern = r"(?i)^\s*([0-9]+(?:\.[0-9]+)?)\s*(B|[KMG]I?B)?\s*$"
    number, unit = F.regexp_extract(text, pattern, 1).try_cast("double"), F.upper(F.substring(F.regexp_extract(text, pattern, 2), 1, 1))
    power = F.when(unit == "K", 1024.0).when(unit == "M", 1024.0**2).when(unit == "G", 1024.0**3).otherwise(1.0)
    return F.ceil(number * power).cast("bigint")
