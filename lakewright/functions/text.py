"""Texts: what markup they are in, what a client wants, how a symbol reads."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What gives reStructuredText away, and media types that ask for text.
RST_SIGNS = (".. ", ":target:", ":alt:")
TEXT_TYPES = ("text/plain", "text/markdown", "text/*")


def looks_like_rst(text: Column) -> Column:
    out = F.lit(False)
    for sign in RST_SIGNS:
        out = out | text.contains(sign)
    return F.coalesce(out, F.lit(False))


def prefers_text(accept: Column) -> Column:
    """Whether an Accept header weighs a text type above all JSON ones; weights are held between 0 and 1, 1 if not readable."""
    ranges = F.transform(F.split(F.lower(F.coalesce(accept, F.lit(""))), ","), lambda r: F.struct(F.trim(F.split(r, ";")[0]).alias("t"), F.regexp_extract(r, r";\s*q\s*=\s*([^;\s]+)", 1).alias("q")))
    weighed = F.transform(ranges, lambda r: F.struct(r["t"].alias("t"), F.least(F.greatest(F.coalesce(r["q"].try_cast("double"), F.lit(1.0)), F.lit(0.0)), F.lit(1.0)).alias("q")))
    best = lambda fits: F.coalesce(F.array_max(F.transform(F.filter(weighed, lambda r: fits(r["t"])), lambda r: r["q"])), F.lit(0.0))
    return best(lambda t: t.isin(*TEXT_TYPES)) > best(lambda t: t.startswith("application/") | (t == "*/*"))


def attribute_signature(name: Column, annotation: Column, default: Column, is_property: Column, writable: Column) -> Column:
    """`x: int = 1`, or `property x: int [read-only]`; on one line."""
    given = lambda c: F.coalesce(c, F.lit("")) != ""
    body = F.concat(name, F.when(given(annotation), F.concat(F.lit(": "), annotation)).otherwise(""), F.when(given(default), F.concat(F.lit(" = "), default)).otherwise(""))
    ending = F.when(writable, "").otherwise(" [read-only]")
    return F.regexp_replace(F.when(is_property, F.concat(F.lit("property "), body, ending)).otherwise(body), r"[\r\n]", "")


def range_label(first: Column, last: Column) -> Column:
    """`Jan 3 – Feb 1, 2024`; the year on both sides only where it differs. Empty without a range."""
    same = F.year(first) == F.year(last)
    start = F.when(same, F.date_format(first, "MMM d")).otherwise(F.date_format(first, "MMM d, yyyy"))
    return F.coalesce(F.concat(start, F.lit(" – "), F.date_format(last, "MMM d, yyyy")), F.lit(""))
