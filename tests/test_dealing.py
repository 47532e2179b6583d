"""Rows dealt out by weight."""

from __future__ import annotations

import random

import pytest
from lakewright.sources import archives
from pyspark.sql import functions as F


@pytest.mark.parametrize("at_once", [10_000, 40])
def test_dealt_evenly(spark, monkeypatch, at_once):
    """A folder of a few heavy archives and many light ones: no partition is a third above the mean, and no row is lost."""
    monkeypatch.setattr(archives, "DEALT_ROWS", at_once)
    draw = random.Random(2)
    rows = [(i, int(draw.paretovariate(1.2) * 1000)) for i in range(300)]
    rows = [(i, min(w, 20_000)) for i, w in rows] + [(300, None), (301, 0)]
    got = archives.dealt(spark.createDataFrame(rows, "k long, weight long"), "weight", 5).withColumn("at", F.spark_partition_id()).collect()
    assert sorted((r.k, r.weight or 0) for r in got) == sorted((k, w or 0) for k, w in rows)
    loads = [sum(r.weight or 0 for r in got if r["at"] == at) for at in range(5)]
    assert max(loads) < 1.3 * sum(loads) / 5
