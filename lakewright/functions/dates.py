"""Calendar pieces."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Days after which a package may or is likely to be unmaintained.
RELEASE_DAYS, COMMIT_DAYS, ALONE_DAYS = {"possibly": 548, "likely": 1095}, {"possibly": 365, "likely": 730}, {"possibly": 730, "likely": 1095}


def iso_week(day: Column) -> Column:
    """struct(year, week) by ISO 8601; early January may be of the year before."""
    return F.struct(F.extract(F.lit("YEAROFWEEK"), day).cast("int").alias("year"), F.weekofyear(day).alias("week"))


def week_label(year: Column, week: Column) -> Column:
    """The day (week - 1) * 7 after the first of January, as `Jan 08`."""
    return F.date_format(F.date_add(F.make_date(year, F.lit(1), F.lit(1)), (week - 1) * 7), "MMM dd")


def quarter_label(stamp: Column) -> Column:
    return F.concat(F.year(stamp).cast("string"), F.lit(" Q"), F.quarter(stamp).cast("string"))


def maintenance_status(released: Column, committed: Column, archived: Column, as_of: date) -> Column:
    """likely_unmaintained, possibly_unmaintained, or null for active packages and those never released."""
    days = lambda c: (F.lit(as_of).cast("timestamp").cast("double") - c.cast("timestamp").cast("double")) / 86400

    def stale(level: str) -> Column:
        both = (days(released) >= RELEASE_DAYS[level]) & (days(committed) >= COMMIT_DAYS[level])
        return F.when(committed.isNotNull(), both).otherwise(days(released) >= ALONE_DAYS[level])

    return F.when(released.isNull(), None).when(archived, "likely_unmaintained").when(stale("likely"), "likely_unmaintained").when(stale("possibly"), "possibly_unmaintained")
