"""Download statistics: windows of days, weeks, categories."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import dates

#: Fixed values: (days, weeks, categories) of each period; an unknown one is the first.
PERIODS = {"4w": (28, 4, 8), "3m": (90, 12, 8), "6m": (180, 24, 8)}
COUNTED, UNNAMED = "without_mirrors", "null"


def period(name: str) -> tuple[int, int, int]:
    return PERIODS.get(name, PERIODS["4w"])


def since(df: DataFrame, day: Column, as_of: date, days: int) -> DataFrame:
    """Rows of the last `days` days before as_of, its own midnight and the first one included; unreadable dates go."""
    return df.filter(day.try_cast("date") >= F.lit(as_of - timedelta(days=days)))


def weekly(df: DataFrame, keys: list[str], day: str, category: str, value: str, weeks: int | None, counted: str = COUNTED) -> DataFrame:
    """Sums of one category by ISO week, the last `weeks` weeks of each key (None: all) with their labels."""
    week = dates.iso_week(F.col(day))
    sums = df.filter(F.col(category) == counted).groupBy(*keys, week["year"].alias("year"), week["week"].alias("week")).agg(F.sum(value).alias("downloads"))
    if weeks is None:
        return sums.withColumn("label", dates.week_label(F.col("year"), F.col("week")))
    recent = Window.partitionBy(*keys).orderBy(F.desc("year"), F.desc("week"))
    return sums.withColumn("_r", F.row_number().over(recent)).filter(F.col("_r") <= weeks).drop("_r").withColumn("label", dates.week_label(F.col("year"), F.col("week")))


def by_category(df: DataFrame, keys: list[str], category: str, value: str, top: int = 0) -> DataFrame:
    """Sums by category, unnamed ones left out; the `top` largest of each key (0: all), ties by name."""
    sums = df.filter(F.col(category).isNotNull() & ~F.col(category).isin(UNNAMED, "")).groupBy(*keys, F.col(category).alias("category")).agg(F.sum(value).alias("downloads"))
    if not top:
        return sums
    largest = Window.partitionBy(*keys).orderBy(F.desc("downloads"), "category")
    return sums.withColumn("_r", F.row_number().over(largest)).filter(F.col("_r") <= top).drop("_r")


def date_range(keys: list[str], day: str, *series: DataFrame) -> DataFrame:
    """First and last day over several series, whatever their categories."""
    every = series[0].select(*keys, day)
    for s in series[1:]:
        every = every.unionByName(s.select(*keys, day))
    return every.groupBy(*keys).agg(F.min(day).alias("first_day"), F.max(day).alias("last_day"))


def series_summary(weeks: DataFrame, keys: list[str]) -> DataFrame:
    """Total, rounded mean and largest week of each key; of equal weeks the first."""
    first = F.struct(F.col("downloads"), (-F.col("year")).alias("y"), (-F.col("week")).alias("w"))
    return weeks.groupBy(*keys).agg(
        F.sum("downloads").alias("total"), F.floor(F.avg("downloads") + 0.5).cast("bigint").alias("weekly_average"), F.max_by("label", first).alias("peak_label"), F.max("downloads").alias("peak")
    )


def sparkline(weeks: DataFrame, keys: list[str], width: int = 800, height: int = 100, margin: int = 10) -> DataFrame:
    """Points of a line over the weeks: x by place, y by share of the largest."""
    place = Window.partitionBy(*keys).orderBy("year", "week")
    whole = Window.partitionBy(*keys)
    n = F.greatest(F.count("*").over(whole) - 1, F.lit(1))
    x = (F.row_number().over(place) - 1) / n * width
    y = margin + (1 - F.col("downloads") / F.greatest(F.max("downloads").over(whole), F.lit(1))) * height
    return weeks.withColumns({"x": x, "y": y})
