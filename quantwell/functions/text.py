"""Text expressions that requests and analyses share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def meter(c: Column) -> Column:
    """'m' for a metre in either case; other values as they are."""
    return F.when(F.lower(c) == "m", "m").otherwise(c)


def unit(c: Column) -> Column:
    """A unit without blanks around it; a metre in either case is 'm', a blank one null."""
    trimmed = F.trim(c)
    return F.when(F.lower(trimmed) == "m", "m").otherwise(F.nullif(trimmed, F.lit("")))


def iso_week(c: Column) -> Column:
    """'YYYY-Www' of a date or time."""
    year, week = F.extract(F.lit("YEAROFWEEK"), c), F.extract(F.lit("WEEK"), c)
    return F.concat(year.cast("string"), F.lit("-W"), F.lpad(week.cast("string"), 2, "0"))
