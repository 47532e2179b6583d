"""Version order by the leading integers of dot-separated segments."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import names


def version_key(version: Column) -> Column:
    """Leading integers of the segments, 0 without one; trailing zeros go, so that 1 = 1.0 = 1.0.0rc1 as arrays."""
    numbers = F.transform(F.split(version, r"\."), lambda s: F.coalesce(F.regexp_extract(s, r"^\s*([+-]?[0-9]{1,18})", 1).try_cast("bigint"), F.lit(0).cast("bigint")))
    last = F.size(numbers) - F.coalesce(F.array_position(F.transform(F.reverse(numbers), lambda n: n != 0), True).cast("int"), F.lit(0)) + 1
    return F.when(F.exists(numbers, lambda n: n != 0), F.slice(numbers, F.lit(1), last)).otherwise(F.array().cast("array<bigint>"))


def compare(a: Column, b: Column) -> Column:
    """1, 0 or -1. A longer key is the larger one only by its sign beyond, which trailing zeros cannot hide."""
    ka, kb = version_key(a), version_key(b)
    n = F.greatest(F.size(ka), F.size(kb))
    pad = lambda k: F.concat(k, F.array_repeat(F.lit(0).cast("bigint"), n - F.size(k)))
    return F.when(pad(ka) > pad(kb), 1).when(pad(ka) < pad(kb), -1).otherwise(0)


def in_range(version: Column, after: Column, upto: Column) -> Column:
    """after < version <= upto, for versions that are given."""
    return (F.coalesce(version, F.lit("")) != "") & (compare(version, after) > 0) & (compare(version, upto) <= 0)


def diff_problem(old: Column, new: Column) -> Column:
    """What is wrong with the two ends of a diff; null if nothing is."""
    blank = lambda c: F.coalesce(c, F.lit("")) == ""
    return (
        F.when(blank(old) | blank(new), "both from and to are required")
        .when(~names.valid_version(old), "invalid from version")
        .when(~names.valid_version(new), "invalid to version")
        .when(compare(old, new) >= 0, "from must be older than to")
    )
