"""Releases: cadence, sizes, platforms, best files."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import dates, versions, wheels


def version_times(files: DataFrame, keys: list[str], version: str, stamp: Column, order: str) -> DataFrame:
    """The upload time of each version: that of its first file with a readable one."""
    timed = files.withColumn("_t", stamp).filter("_t IS NOT NULL")
    return timed.groupBy(*keys, version).agg(F.min_by("_t", order).alias("released_at"))


def cadence(times: DataFrame, keys: list[str], as_of: date) -> DataFrame:
    """Last release, releases in the year up to as_of, and the mean days between releases to one decimal (0 for one)."""
    year_ago = F.add_months(F.lit(as_of), -12).cast("timestamp")
    span = (F.max("released_at").cast("double") - F.min("released_at").cast("double")) / 3600 / 24
    mean = F.when(F.count("*") >= 2, F.round(span / (F.count("*") - 1) * 10) / 10).otherwise(0.0)
    return times.withColumn("released_at", F.col("released_at").cast("timestamp")).groupBy(*keys).agg(
        F.max("released_at").alias("last_released_at"), F.count_if(F.col("released_at") >= year_ago).alias("releases_last_12mo"), mean.alias("avg_days_between_releases")
    )


def quarters(times: DataFrame, keys: list[str], as_of: date) -> DataFrame:
    """Releases of each quarter of two years up to as_of's own, zeros included."""
    first = F.trunc(F.add_months(F.lit(as_of), -24), "quarter")
    counts = times.filter(F.col("released_at") >= first.cast("timestamp")).groupBy(*keys, F.trunc(F.col("released_at").cast("date"), "quarter").alias("start")).agg(F.count("*").alias("n"))
    spine = times.select(*keys).distinct().select(*keys, F.explode(F.sequence(first, F.lit(as_of), F.expr("INTERVAL 3 MONTHS"))).alias("start"))
    return spine.join(counts, [*keys, "start"], "left").select(*keys, dates.quarter_label(F.col("start")).alias("quarter"), F.coalesce("n", F.lit(0)).alias("releases"))


def install_size(files: DataFrame, keys: list[str]) -> DataFrame:
    """The smallest wheel, else the smallest source archive, else 0. A size of 0 counts as not known, as long as a later file has one.

    Read in order, 0 means none so far; so what counts are the files after the last one of size 0, and that one itself only if it is the last.
    """
    known = F.col("size") > 0

    def least(kind: str) -> Column:
        of_kind = F.col("packagetype") == kind
        return F.coalesce(F.min(F.when(of_kind & known & (F.col("ord") >= F.coalesce(F.col(f"_zero_{kind}"), F.lit(-1))), F.col("size"))), F.lit(0)).cast("bigint")

    zero = lambda kind: F.max(F.when((F.col("packagetype") == kind) & (F.col("size") <= 0), F.col("ord"))).alias(f"_zero_{kind}")
    zeros = files.groupBy(*keys).agg(zero(wheels.WHEEL), zero(wheels.SDIST))
    found = files.join(zeros, keys).groupBy(*keys).agg(least(wheels.WHEEL).alias("_w"), least(wheels.SDIST).alias("_s"))
    return found.select(*keys, F.when(F.col("_w") > 0, F.col("_w")).otherwise(F.col("_s")).alias("install_size"))


def platforms(files: DataFrame, keys: list[str]) -> DataFrame:
    """Which platforms have wheels."""
    tag = F.when(F.col("packagetype") == wheels.WHEEL, wheels.platform_tag(F.col("filename"))).otherwise("")
    return files.withColumn("_tag", tag).groupBy(*keys).agg(*[F.bool_or(wheels.platform_flag(F.col("_tag"), flag)).alias(flag) for flag in wheels.FLAGS])


def first_format(files: DataFrame, keys: list[str]) -> DataFrame:
    """The tag of the first wheel with a whole name, platform-specific, or sdist-only."""
    tag = F.when(F.col("packagetype") == wheels.WHEEL, wheels.module_format(F.col("filename")))
    return files.withColumn("_tag", tag).groupBy(*keys).agg(F.coalesce(F.min_by("_tag", F.when(F.col("_tag").isNotNull(), F.col("ord"))), F.lit("sdist-only")).alias("module_format"))


def best_files(files: DataFrame, keys: list[str]) -> DataFrame:
    """The wheel to read (pure, then small, then by name), the source archive (by kind, then name), the wheel URL (first pure, else first)."""
    is_wheel, is_sdist = F.col("packagetype") == wheels.WHEEL, F.col("packagetype") == wheels.SDIST
    impure = ~wheels.is_pure(F.col("filename"))
    return files.groupBy(*keys).agg(
        F.min_by("filename", F.when(is_wheel, F.struct(impure, "size", "filename"))).alias("wheel"),
        F.min_by("filename", F.when(is_sdist, F.struct(wheels.sdist_rank(F.col("filename")), F.col("filename")))).alias("sdist"),
        F.coalesce(F.min_by("url", F.when(is_wheel, F.struct(impure, "ord"))), F.lit("")).alias("wheel_url"),
    )


def latest_version(df: DataFrame, keys: list[str], version: str) -> DataFrame:
    """The largest version of each key; of equal ones the smallest text."""
    key = F.struct(versions.version_key(F.col(version)).alias("k"))
    top = df.groupBy(*keys).agg(F.max(key).alias("_k"))
    return df.join(top, keys).filter(versions.version_key(F.col(version)) == F.col("_k.k")).groupBy(*keys).agg(F.min(version).alias("latest"))


def stub_version(stubs: DataFrame, keys: list[str], version: str, major: Column) -> DataFrame:
    """The largest stub version of the source's major version, else of all."""
    fit = (F.col(version) == major) | F.col(version).startswith(F.concat(major, F.lit(".")))
    order = F.struct(fit.cast("int"), versions.version_key(F.col(version)), F.col(version))
    return stubs.groupBy(*keys).agg(F.max_by(version, order).alias("stub_version"))


def in_time(versions_: DataFrame, keys: list[str]) -> DataFrame:
    """Versions with `place`, newest first by the text of the upload time, and `by_date`, by the time that it says; without one last, ties by version."""
    of = Window.partitionBy(*keys)
    place = F.row_number().over(of.orderBy(F.desc_nulls_last(F.nullif("upload_time", F.lit(""))), "version"))
    by_date = F.row_number().over(of.orderBy(F.desc_nulls_last(F.try_to_timestamp(F.nullif("upload_time", F.lit("")))), "version"))
    return versions_.withColumns({"place": place, "by_date": by_date})
