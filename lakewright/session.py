"""Session defaults."""

from __future__ import annotations

from pyspark.sql import SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def session(name: str = "lakewright", **conf: str) -> SparkSession:
    """A session with the defaults this library expects; what the cluster sets stays."""
    return SparkSession.builder.appName(name).config(map=DEFAULTS | conf).getOrCreate()
