"""Advisories: flattening and severity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Severities by rank.
RANKS = {"CRITICAL": 4, "HIGH": 3, "MEDIUM": 2, "LOW": 1}
SCHEMA = (
    "id string, summary string, severity array<struct<type: string, score: string>>, "
    "affected array<struct<ranges: array<struct<type: string, events: array<struct<introduced: string, fixed: string>>>>>>, references array<struct<url: string>>"
)


def flatten(vulns: DataFrame, keys: list[str]) -> DataFrame:
    """One row an advisory: first severity or Unknown, range and fix of the first ECOSYSTEM range, first reference."""
    given = lambda c: F.when(c != "", c)
    ranges = F.filter(F.try_element_at(F.col("affected"), F.lit(1))["ranges"], lambda r: r["type"] == "ECOSYSTEM")
    # one fold over the events of that range, named before it is used; the last ends that are given stand
    none = F.lit(None).cast("string")
    ends = F.aggregate(
        F.try_element_at(ranges, F.lit(1))["events"], F.struct(none.alias("low"), none.alias("high")),
        lambda done, e: F.struct(F.coalesce(given(e["introduced"]), done["low"]).alias("low"), F.coalesce(given(e["fixed"]), done["high"]).alias("high")),
    )
    first = lambda column, field: F.try_element_at(F.col(column), F.lit(1))[field]
    # one array of one struct: generated once a row, where a plain column would be spelled out again at each use
    rows = vulns.select(*keys, "id", "summary", first("severity", "score").alias("_severity"), first("references", "url").alias("_url"), F.explode(F.array(ends)).alias("_ends"))
    low, high = F.col("_ends.low"), F.col("_ends.high")
    return rows.select(
        *keys,
        "id",
        "summary",
        F.coalesce(given(F.col("_severity")), F.lit("Unknown")).alias("severity"),
        F.coalesce(F.concat(F.lit(">="), low, F.coalesce(F.concat(F.lit(", <"), high), F.lit(""))), F.lit("")).alias("affected_range"),
        F.coalesce(high, F.lit("")).alias("fixed_in"),
        F.coalesce("_url", F.lit("")).alias("url"),
    )


def severity_label(severity: Column) -> Column:
    """Upper case; of a CVSS vector by its impacts: any high, any low, none."""
    vector = F.when(severity.rlike("/[CIA]:H"), "HIGH").when(severity.rlike("/[CIA]:L"), "MEDIUM").otherwise("LOW")
    return F.when(severity.startswith("CVSS:"), vector).otherwise(F.upper(severity))


def rank(label: Column) -> Column:
    out = F.lit(0)
    for name, r in RANKS.items():
        out = F.when(label == name, r).otherwise(out)
    return out


def worst(vulns: DataFrame, keys: list[str], severity: str) -> DataFrame:
    """The worst severity of each key; what has no rank is UNKNOWN."""
    label = severity_label(F.col(severity))
    top = F.max(rank(label))
    name = F.lit("UNKNOWN")
    for text, r in RANKS.items():
        name = F.when(top == r, text).otherwise(name)
    return vulns.groupBy(*keys).agg(name.alias("max_severity"))
