"""Numbers, dates and texts as people read them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CELL = 28
MOST_DEFAULT = 120


def one_decimal(numerator: Column, denominator: int) -> Column:
    """numerator / denominator with one decimal, exact ties to even; whole numbers in, so nothing is rounded twice."""
    n = numerator.cast("decimal(38,0)")
    tenths = F.bround(n * 10 / F.lit(denominator).cast("decimal(38,0)"), 0).cast("decimal(38,0)").cast("bigint")
    return F.concat(F.floor(tenths / 10).cast("string"), F.lit("."), (tenths % 10).cast("string"))


def human_bytes(n: Column) -> Column:
    """512 B, 1.5 KB, 1.0 MB and so on by 1024."""
    out = F.when(n < 1024, F.concat(n.cast("string"), F.lit(" B")))
    for power, unit in enumerate(("KB", "MB", "GB", "TB"), 1):
        out = out.when(n < 1024 ** (power + 1), F.concat(one_decimal(n, 1024**power), F.lit(f" {unit}")))
    return out.otherwise(F.concat(one_decimal(n, 1024**5), F.lit(" PB")))


def human_count(n: Column) -> Column:
    """45, 1.2K, 1M (millions are cut, not rounded), 1.5B."""
    return (
        F.when(n < 1000, n.cast("string"))
        .when(n < 10**6, F.concat(one_decimal(n, 1000), F.lit("K")))
        .when(n < 10**9, F.concat(F.floor(n / 10**6).cast("string"), F.lit("M")))
        .otherwise(F.concat(one_decimal(n, 10**9), F.lit("B")))
    )


def with_commas(n: Column) -> Column:
    return F.format_number(n, 0)


def cell(text: Column, most: int = CELL) -> Column:
    """At most 28 characters, the last an ellipsis if any were cut."""
    return F.when(F.char_length(text) > most, F.concat(F.substring(text, 1, most - 1), F.lit("…"))).otherwise(text)


def shown_default(value: Column) -> Column:
    """struct(shown, digest): a default cut to 120 characters, with eight bytes of SHA-256 of the whole if it was."""
    cut = F.char_length(value) > MOST_DEFAULT
    return F.struct(cell(value, MOST_DEFAULT).alias("shown"), F.when(cut, F.substring(F.sha2(value, 256), 1, 16)).otherwise("").alias("digest"))


def date_prefix(stamp: Column) -> Column:
    return F.substring(stamp, 1, 10)


def short_count(n: Column) -> Column:
    """The interface's count: 1.2B, 3.4M, 12K, 7."""
    return (
        F.when(n >= 10**9, F.concat(F.format_string("%.1f", n / 1e9), F.lit("B")))
        .when(n >= 10**6, F.concat(F.format_string("%.1f", n / 1e6), F.lit("M")))
        .when(n >= 1000, F.concat(F.format_string("%.0f", n / 1e3), F.lit("K")))
        .otherwise(n.cast("string"))
    )


def short_size(n: Column) -> Column:
    return (
        F.when(F.coalesce(n, F.lit(0)) == 0, "—")
        .when(n >= 1048576, F.concat(F.format_string("%.1f", n / 1048576), F.lit(" MB")))
        .when(n >= 1024, F.concat(F.format_string("%.0f", n / 1024), F.lit(" KB")))
        .otherwise(F.concat(n.cast("string"), F.lit(" B")))
    )


def short_date(stamp: Column) -> Column:
    return F.coalesce(F.date_format(F.try_to_timestamp(stamp), "MMM d, yyyy"), F.lit("—"))


def keywords(classifiers: Column, most: int = 5) -> Column:
    """Last segments of Topic and Framework classifiers, lower case, each once, the first five."""
    parts = F.transform(classifiers, lambda c: F.transform(F.split(c, "::"), lambda x: F.trim(x)))
    fit = F.filter(parts, lambda p: (F.size(p) >= 2) & p[0].isin("Topic", "Framework"))
    return F.slice(F.array_distinct(F.filter(F.transform(fit, lambda p: F.lower(F.element_at(p, -1))), lambda k: k != "")), 1, most)


def key_values(*pairs: tuple[str, Column]) -> Column:
    """`key: value` lines of the values that are given."""
    return F.concat_ws("\n", *[F.when(F.coalesce(v, F.lit("")) != "", F.concat(F.lit(f"{k}: "), v)) for k, v in pairs])
